"""Chat formatting in budgeted windows, in DataFrame functions only.

A conversation's rows become marked turns; texts are escaped, so that a control string inside a
text can never be taken for a mark, and ``read_turns`` gives back what went in.  A conversation
longer than ``budget`` tokens becomes several windows.  Windows are aligned to turns: prefix sums
of the turns' tokens tell where the next window must begin, the leading system turn is retained in
each, and the turns just before a window are repeated in it as far as ``history`` tokens and the
budget allow.  Assistant texts stand under the loss mask where they are new, and never where they
are repeated.

A conversation is worked on in blocks of ``span`` turn numbers, so a conversation with very many
turns is dealt over many tasks by (conversation, block); a window ends with its block, and no
history goes from one block to the next.  Conversations of more than one block are found by a
count of narrow rows, and only their leading system turn is copied into each block.  What is held
at once is the token counts of at most ``PART`` turns and the turns of one window; sums, ranks and
sorts stream and spill.

Defined results: null text and null role are empty; rows go by turn (null first), then role, then
text, so ties and repeated rows are turns of their own, in that order; a turn longer than the
budget has a window of its own, marked ``over``; a null conversation id is a conversation of its
own; an empty table gives no windows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

START, END = "<|im_start|>", "<|im_end|>"
#: Turns whose token counts are folded at once; a window ends there too.
PART = 1024
#: Tokens that a turn's marks cost.
MARKS = 4
_TURN = r"<\|im_start\|>([^\n]*)\n((?s:.*?))<\|im_end\|>\n"


def escape(text: Column) -> Column:
    """A text in which no ``<|`` is left: each ``<``, backslashes, ``|`` gets one backslash more."""
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", r"<$1|")


def escape_role(role: Column) -> Column:
    """A role on one line without marks."""
    for a, b in (("~", "~0"), ("\n", "~1"), ("<", "~2")):
        role = F.replace(role, F.lit(a), F.lit(b))
    return role


def unescape_role(role: Column) -> Column:
    for a, b in (("~2", "<"), ("~1", "\n"), ("~0", "~")):
        role = F.replace(role, F.lit(a), F.lit(b))
    return role


def rough_tokens(text: Column) -> Column:
    """About what a byte-pair vocabulary makes of a text: letters by fours, digits by threes, other signs alone."""
    return F.regexp_count(text, F.lit(r"\p{L}{1,4}|\p{N}{1,3}|[^\s\x0B\p{L}\p{N}]"))


def read_turns(text: Column) -> Column:
    """The (role, text) turns that a window's text marks, unescaped."""
    roles, texts = (F.regexp_extract_all(text, F.lit(_TURN), F.lit(k)) for k in (1, 2))
    return F.zip_with(roles, texts, lambda r, t: F.struct(unescape_role(r).alias("role"), unescape(t).alias("text")))


def read_loss(text: Column, loss: Column) -> Column:
    """The texts under a window's loss mask, unescaped."""
    return F.transform(loss, lambda s: unescape(F.substring(text, s["start"] + 1, s["end"] - s["start"])))


def _with_leads(rows: DataFrame) -> DataFrame:
    """``rows`` and, for each later block of a conversation, one row with ``copy`` that holds the
    leading system turn, or nothing if there is none."""
    head = rows.groupBy("conv").agg(F.min(F.struct("turn", "role")).alias("lead"), F.min("block").alias("low"), F.max("block").alias("high")).filter("high > low")
    wide = head.select(F.col("conv").alias("of"), "lead", "low")
    first = (F.col("conv").eqNullSafe(F.col("of"))) & (F.col("role") == "system") & (F.col("lead.role") == "system") & F.col("turn").eqNullSafe(F.col("lead.turn"))
    system = rows.filter("role = 'system'").join(wide, first).groupBy("of").agg(F.min("text").alias("said"))
    blocks = rows.select("conv", "block").distinct().join(wide, F.col("conv").eqNullSafe(F.col("of")) & (F.col("block") > F.col("low"))).select("conv", "block")
    copies = blocks.join(system, F.col("conv").eqNullSafe(F.col("of")), "left")
    copies = copies.select("conv", "block", F.lit(None).cast("long").alias("turn"), F.when(F.col("said").isNotNull(), "system").otherwise("").alias("role"), F.coalesce("said", F.lit("")).alias("text"), F.lit(True).alias("copy"))
    return rows.withColumn("copy", F.lit(False)).unionByName(copies)


def _begins(costs: Column, first: Column, later: Column) -> Column:
    """Where windows begin in a list of costs, with the costs before: a window takes turns while
    they fit its room, and one turn at least."""
    start = F.struct(F.lit(0).alias("at"), F.lit(0).cast("long").alias("before"), F.lit(0).cast("long").alias("used"), F.array().cast("array<struct<at:int,before:bigint>>").alias("out"))

    def step(acc: Column, cost: Column) -> Column:
        room = F.when(F.size(acc["out"]) <= 1, first).otherwise(later)
        fits = (F.size(acc["out"]) > 0) & (acc["used"] + cost <= room)
        mark = F.struct((acc["at"] + 1).alias("at"), acc["before"].alias("before"))
        return F.struct(
            (acc["at"] + 1).alias("at"),
            (acc["before"] + cost).alias("before"),
            F.when(fits, acc["used"] + cost).otherwise(cost).alias("used"),
            F.when(fits, acc["out"]).otherwise(F.array_append(acc["out"], mark)).alias("out"),
        )

    return F.aggregate(costs, start, step)["out"]


def windows(talk: DataFrame, budget: int = 2048, history: int = 512, span: int = 1024, tokens: Callable[[Column], Column] = rough_tokens, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row for each window: conv, block and start (its order), text, context (how many leading
    turns are retained or repeated), loss (start, end in code points), tokens, over."""
    rows = talk.select(F.col(conv).alias("conv"), F.col(turn).cast("long").alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    rows = rows.withColumn("block", F.coalesce(F.floor(F.col("turn") / span), F.lit(-(1 << 62))))
    cost = (tokens(F.col("role")) + tokens(F.col("text")) + MARKS).cast("long")
    rows = _with_leads(rows).withColumn("cost", cost)

    ordered = Window.partitionBy("conv", "block").orderBy(F.desc("copy"), "turn", "role", "text")
    rows = rows.withColumn("rn", F.sum(F.when(F.col("copy"), 0).otherwise(1)).over(ordered.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    lead = F.first(F.struct("role", "cost", "copy")).over(ordered)
    rows = rows.withColumn("lead", lead).withColumn("lead_cost", F.when(F.col("lead.role") == "system", F.col("lead.cost")).otherwise(0))
    rows = rows.withColumn("part", F.floor((F.greatest("rn", F.lit(1)) - 1) / PART)).withColumn("at", F.when(~F.col("copy"), (F.col("rn") - 1) % PART + 1).otherwise(0).cast("int"))
    holds = (F.col("part") == 0) & ~F.col("lead.copy")  # whether this part has the leading turn itself
    rows = rows.withColumn("first_room", F.lit(budget) - F.when(holds, 0).otherwise(F.col("lead_cost"))).withColumn("later_room", F.lit(budget - history) - F.col("lead_cost"))

    within = Window.partitionBy("conv", "block", "part").orderBy("rn")
    whole = within.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    costs = F.collect_list(F.when(~F.col("copy"), F.col("cost"))).over(whole)
    rows = rows.withColumn("costs", F.when(F.col("at") == 1, costs)).withColumn("before", F.sum(F.when(F.col("copy"), 0).otherwise(F.col("cost"))).over(within.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("cost"))
    rows = rows.withColumn("begins", F.when(F.col("at") == 1, _begins(F.col("costs"), F.col("first_room"), F.col("later_room"))))
    total = F.sum(F.when(F.col("copy"), 0).otherwise(F.col("cost"))).over(whole)
    rows = rows.withColumn("begins", F.max("begins").over(whole)).withColumn("total", total)

    said = Window.partitionBy("conv", "block").orderBy("part", "rn")
    rows = rows.withColumn("system", F.first(F.struct("role", "text")).over(said)).filter(~F.col("copy"))
    own = F.element_at(F.filter("begins", lambda b: b["at"] <= F.col("at")), -1)
    # a later window repeats this turn if all from it to the window's start fit the history, and
    # what the window itself takes leaves room
    ends = F.transform("begins", lambda b, k: F.struct(b["at"].alias("at"), b["before"].alias("before"), F.coalesce(F.try_element_at("begins", k + 2)["before"], F.col("total")).alias("after")))
    spare = lambda b: F.least(F.lit(history), F.lit(budget) - F.col("lead_cost") - (b["after"] - b["before"]))
    lead_itself = (F.col("at") == 1) & holds & (F.col("lead_cost") > 0)
    later = F.when(lead_itself, F.array().cast("array<int>")).otherwise(F.transform(F.filter(ends, lambda b: (b["at"] > F.col("at")) & (b["before"] - F.col("before") <= spare(b))), lambda b: b["at"]))
    rows = rows.withColumn("own", own["at"])
    retained = F.when((F.col("own") == F.col("at")) & (F.col("lead_cost") > 0) & ~lead_itself & ~(holds & (F.col("own") == 1)), F.col("system"))
    rows = rows.select("conv", "block", "part", "rn", "role", "text", "cost", "lead_cost", "own", retained.alias("system"), F.explode(F.concat(F.array("own"), later)).alias("start"))

    def piece(role: Column, text: Column) -> Column:
        return F.concat(F.lit(START), escape_role(role), F.lit("\n"), escape(text), F.lit(END + "\n"))

    turns = rows.select(
        "conv", "block", (F.col("part") * PART + F.col("start")).alias("start"),
        F.struct(
            "rn",
            (F.col("start") != F.col("own")).alias("again"),
            piece(F.col("role"), F.col("text")).alias("piece"),
            F.when((F.col("role") == "assistant") & (F.col("start") == F.col("own")), F.length(escape_role(F.col("role"))) + len(START) + 1).alias("skip"),
            "cost",
        ).alias("t"),
        F.when(F.col("system").isNotNull() & (F.col("start") == F.col("own")), F.struct(piece(F.col("system.role"), F.col("system.text")).alias("piece"), F.col("lead_cost").alias("cost"))).alias("s"),
    )
    made = turns.groupBy("conv", "block", "start").agg(F.array_sort(F.collect_list("t")).alias("t"), F.first("s", ignorenulls=True).alias("s"))
    head = F.coalesce(F.col("s.piece"), F.lit(""))
    zero = F.struct(F.length(head).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("out"))

    def mask(acc: Column, t: Column) -> Column:
        to = acc["at"] + F.length(t["piece"])
        cut = F.struct((acc["at"] + t["skip"]).alias("start"), (to - len(END) - 1).alias("end"))
        return F.struct(to.alias("at"), F.when(t["skip"].isNotNull(), F.array_append(acc["out"], cut)).otherwise(acc["out"]).alias("out"))

    used = F.aggregate("t", F.coalesce(F.col("s.cost"), F.lit(0)).cast("long"), lambda a, t: a + t["cost"])
    return made.select(
        "conv", "block", "start",
        F.concat(head, F.array_join(F.transform("t", lambda t: t["piece"]), "")).alias("text"),
        (F.size(F.filter("t", lambda t: t["again"])) + F.when(F.col("s").isNotNull(), 1).otherwise(0)).alias("context"),
        F.aggregate("t", zero, mask)["out"].alias("loss"),
        used.alias("tokens"),
        (used > budget).alias("over"),
    )


def digests(made: DataFrame) -> DataFrame:
    """Per conversation what its windows give back: each turn once, each loss text once, and sizes.
    A digest needs a conversation's whole text in order, so here, and only here, it is one row."""
    whole = made.groupBy("conv").agg(F.array_sort(F.collect_list(F.struct("block", "start", "text", "context", "loss"))).alias("w"))
    turns = F.flatten(F.transform("w", lambda w: F.slice(read_turns(w["text"]), w["context"] + 1, 1 << 30)))
    loss = F.array_join(F.flatten(F.transform("w", lambda w: read_loss(w["text"], w["loss"]))), "")
    whole = whole.select("conv", turns.alias("turns"), loss.alias("lost"), F.aggregate("w", F.lit(0).cast("long"), lambda a, w: a + F.length(w["text"])).alias("formatted_chars"))
    told = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return whole.select(
        F.col("conv").alias("conv_id"),
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(told, 256).alias("turns_sha256"),
        F.length("lost").cast("long").alias("loss_chars"),
        F.sha2("lost", 256).alias("loss_sha256"),
        "formatted_chars",
    )
