"""Secret scans and multipart credential linking, in DataFrame functions only.

Each text is read once per kind by one anchored regular expression, which gives matches with
their places; nothing is shuffled.  Strong kinds are reported as found.  Weak parts (an
identifier-like word, a secret-like word, an endpoint) say little alone: they are joined by
interval within their scope, a window of ``scope`` code points around the part, and reported
only when complementary parts co-occur there: a weak secret needs an identifier or an access
key near it, an identifier needs a secret, an endpoint needs both.

Defined results: null is an empty text without spans; overlapping kinds are all reported; a
repeated row gets a row each; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import partial, reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Kinds in the order of the report: name, pattern, group whose length counts, least length.
ASSIGN = ("assign", r"""(?i:(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+))""", 2, 12)
ACCESS = ("access", r"AKIA[A-Z0-9]{14,}", 0, 18)
HEX = ("hex", r"[0-9a-f]{16,}", 0, 16)
BASE = (ASSIGN, ACCESS, HEX)
#: Weak parts: identifiers, secrets and endpoints.
WEAK = (
    ("ident", r"""(?i:(client_?id|access_?key_?id|account|username|user|login)["']?\x20*[:=]\x20*["']?([A-Za-z0-9@+/_.-]+))""", 2, 3),
    ("opaque", r"(?<![A-Za-z0-9+/])(?=[A-Za-z+/]*[0-9])(?=[0-9a-z+/]*[A-Z])[A-Za-z0-9+/]{20,}={0,2}", 0, 20),
    ("endpoint", r"(?i:https?://[A-Za-z0-9.-]+(?::[0-9]+)?)", 0, 10),
)
#: Code points of a block in which redaction looks for a place.
BLOCK = 1024
#: What must occur near a part of each weak kind.
NEEDS = {"ident": (("opaque", "assign"),), "opaque": (("ident", "access"),), "endpoint": (("ident", "access"), ("opaque", "assign"))}


def _running(a: Column, op: Callable[[Column, Column], Column]) -> Column:
    """Running ``op`` of an array column, itself included, by doubling: each step lets every
    element take in the one 1, 2, 4, ... places before it, so the work is n log n."""

    def step(now: Column, k: Column) -> Column:
        by = F.pow(F.lit(2), k).cast("int")
        rest = F.size(now) - by
        return F.concat(F.slice(now, F.lit(1), by), F.zip_with(F.slice(now, by + 1, rest), F.slice(now, F.lit(1), rest), op))

    last = F.ceil(F.log2(F.size(a))).cast("int") - 1
    return F.when(F.size(a) < 2, a).otherwise(F.aggregate(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), a, step))


def _pieces(text: Column, pattern: str, group: int) -> Column:
    """Lengths of the pieces of a text that end with a match, of the match, and of its group.

    ``\\G`` and a lazy run take piece after piece, so a text without a match is read once;
    a plain search says so faster still.
    """
    empty = F.array().cast("array<struct<n:int,m:int,g:int>>")
    each = F.transform(
        F.regexp_extract_all(text, F.lit(rf"\G(?s:.*?)(?:{pattern})"), F.lit(0)),
        lambda p: F.struct(F.length(p).alias("n"), F.length(F.regexp_extract(p, pattern, 0)).alias("m"), F.length(F.regexp_extract(p, pattern, group)).alias("g")),
    )
    return F.when(F.regexp_like(text, F.lit(pattern)), each).otherwise(empty)


def places(at: DataFrame, kinds: tuple) -> DataFrame:
    """``at`` with a column ``all_<kind>`` for each kind: (start, end) of its leftmost matches
    that do not overlap, in code points, which are running sums of the pieces' lengths."""
    names = [name for name, *_ in kinds]
    keep = at.columns
    at = at.withColumns({f"pieces_{name}": _pieces(F.col("text"), p, g) for name, p, g, _ in kinds})
    at = at.withColumns({f"ends_{name}": F.col(f"pieces_{name}")["n"] for name in names})
    at = at.withColumns({f"ends_{name}": _running(F.col(f"ends_{name}"), lambda x, y: x + y) for name in names})
    at = at.select(*keep, *[F.zip_with(f"pieces_{n}", f"ends_{n}", lambda x, e: F.struct((e - x["m"]).alias("start"), e.alias("end"), x["g"].alias("g"))).alias(n) for n in names])
    at = at.select(*keep, *[F.filter(name, partial(_long, least)).alias(name) for name, _, _, least in kinds])
    return at.select(*keep, *[F.arrays_zip(F.col(n)["start"].alias("start"), F.col(n)["end"].alias("end")).alias(f"all_{n}") for n in names])


def _long(least: int, x: Column) -> Column:
    return x["g"] >= least


def _mark(place: Callable[[Column], Column], part: int, x: Column) -> Column:
    return F.struct(place(x).alias("at"), F.lit(part).alias("part"), (F.lit(None).cast("int") if part else place(x)).alias("best"))


def nearest(at: DataFrame, pairs: dict[str, tuple[str, list[str]]]) -> DataFrame:
    """``at`` with columns ``before_<x>`` and ``after_<x>`` for each pair of parts and others:
    by part the greatest end of the others up to its start, and by part from the last to the
    first the least start from its end on, negated.  All places are sorted once, and a running
    maximum of the others' passes over them."""
    keep = at.columns
    marks = {}
    for x, (parts, kinds) in pairs.items():
        others = F.concat(*[F.col(k) for k in kinds])
        for side, theirs, own in (("before", lambda o: o["end"], lambda p: p["start"]), ("after", lambda o: -o["start"], lambda p: -p["end"])):
            have = F.transform(others, partial(_mark, theirs, 0))
            want = F.transform(parts, partial(_mark, own, 1))
            marks[f"{side}_{x}"] = F.when((F.size(parts) > 0) & (F.size(others) > 0), F.array_sort(F.concat(have, want)))
    at = at.withColumns(marks)
    at = at.withColumns({f"best_{m}": F.col(m)["best"] for m in marks})
    at = at.withColumns({f"best_{m}": _running(F.col(f"best_{m}"), lambda x, y: F.greatest(x, y)) for m in marks})
    at = at.withColumns({m: F.filter(F.zip_with(m, f"best_{m}", lambda x, y: F.struct(x["part"].alias("part"), y.alias("best"))), lambda x: x["part"] == 1) for m in marks})
    return at.select(*keep, *[F.col(m)["best"].alias(m) for m in marks])


def _linked(parts: Column, sides: list[tuple[Column, Column]], scope: int) -> Column:
    """The parts, which are in order and do not overlap, that have on each of ``sides`` (nearest
    end before, nearest start after, by part) one at most ``scope`` code points away; what
    overlaps a part is not near it."""

    def near(p: Column, k: Column) -> Column:
        each = [F.coalesce(p["start"] - F.get(l, k) <= scope, F.lit(False)) | F.coalesce(-F.get(r, F.size(r) - 1 - k) - p["end"] <= scope, F.lit(False)) for l, r in sides]
        return reduce(lambda x, y: x & y, each)

    return F.filter(parts, near)


def _span(k: int, name: str, s: Column) -> Column:
    return F.struct(s["start"].alias("start"), F.lit(k).alias("kind"), F.lit(name).alias("name"), s["end"].alias("end"))


def _told(kinds: list[tuple[int, str, str]]) -> Column:
    """All spans as kind:start:end, by start and then kind as listed."""
    rows = [F.transform(F.col(c), partial(_span, k, name)) for k, name, c in kinds]
    return F.array_join(F.transform(F.array_sort(F.concat(*rows)), lambda s: F.concat_ws(":", s["name"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def scan(docs: DataFrame, scope: int = 200, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row of ``docs``: key, text, and an array of (start, end) for each kind, weak kinds
    already reduced to those linked."""
    at = docs.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    pairs = {f"{name}_{k}": (f"all_{name}", [f"all_{x}" for x in any_of]) for name, needs in NEEDS.items() for k, any_of in enumerate(needs)}
    at = nearest(places(at, (*BASE, *WEAK)), pairs)
    out = [F.col(f"all_{name}").alias(name) for name, *_ in BASE]
    out += [_linked(F.col(f"all_{name}"), [(F.col(f"before_{name}_{k}"), F.col(f"after_{name}_{k}")) for k in range(len(needs))], scope).alias(name) for name, needs in NEEDS.items()]
    return at.select("key", "text", *out)


def find_secrets(docs: DataFrame, scope: int = 200, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: counts of the base kinds, their digest, and all spans."""
    base = [(k, name, name) for k, (name, *_) in enumerate(BASE)]
    weak = [(k + len(BASE), name, name) for k, name in enumerate(NEEDS)]
    found = scan(docs, scope, key, text)
    return found.select(
        F.col("key").alias("doc_id"),
        *[F.size(name).cast("long").alias(f"n_{name}") for name, *_ in BASE],
        F.sha2(_told(base), 256).alias("base_sha256"),
        _told(base + weak).alias("spans"),
    )


def _stretch(a: Column, b: Column) -> Column:
    """The text from ``a`` up to ``b``, read from its own blocks, not from the text's beginning."""
    lo, hi = F.floor(a / BLOCK).cast("int"), F.floor((b - 1) / BLOCK).cast("int")
    return F.when(b > a, F.substring(F.array_join(F.slice("_blocks", lo + 1, hi - lo + 1), ""), a - lo * BLOCK + 1, b - a)).otherwise("")


def redact(docs: DataFrame, scope: int = 200, text: str = "text", mark: str = "[secret]") -> DataFrame:
    """``docs`` with every reported span of ``text`` replaced by ``mark``; other columns stay."""
    names = [name for name, *_ in (*BASE, *WEAK)]
    kept = F.struct(*[F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(docs.columns)])
    body = f"key.c{docs.columns.index(text)}"
    rows = scan(docs.select(kept.alias("_row"), F.col(text).alias("_text")), scope, "_row", "_text")
    rows = rows.select("key", "text", F.array_sort(F.concat(*[F.col(n) for n in names])).alias("_cuts"))
    some = F.size("_cuts") > 0
    rows = rows.withColumns({"_ends": F.col("_cuts")["end"], "_blocks": F.when(some, F.regexp_extract_all("text", F.lit(rf"(?s).{{1,{BLOCK}}}"), F.lit(0)))})
    rows = rows.withColumns({"_ends": _running(F.col("_ends"), lambda x, y: F.greatest(x, y))})
    # a cut that begins before an earlier one's end is part of it
    rows = rows.withColumns({"_seen": F.when(some, F.concat(F.array(F.lit(0)), F.slice("_ends", F.lit(1), F.size("_ends") - 1)))})
    parts = F.zip_with("_cuts", "_seen", lambda s, at: F.when(s["start"] < at, "").otherwise(F.concat(_stretch(at, s["start"]), F.lit(mark))))
    new = F.when(some, F.concat(F.array_join(parts, ""), _stretch(F.get("_ends", F.size("_ends") - 1), F.length("text")))).otherwise(F.col(body))
    return rows.select(*[(new if c == text else F.col(f"key.c{k}")).alias(c) for k, c in enumerate(docs.columns)])
