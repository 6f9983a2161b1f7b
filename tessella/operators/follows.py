"""From follows to an inbox: two hops, each bounded, and keys that fall back to titles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Levels of a follow, the stronger with the greater rank.
LEVELS = {"all": 3, "custom": 2, "participating": 1}
#: Reasons for a thread in an inbox, the nearer to the reader with the greater rank.
REASONS = {"author": 5, "participating": 4, "subscribed": 3, "organization": 2}
#: Follows that a task sorts.
FOLLOWS = 1 << 19


def _rank(of: dict[str, int], c: str) -> Column:
    return F.create_map(*[F.lit(x) for k, v in of.items() for x in (k, v)])[F.col(c)]


def _parts(follows: DataFrame) -> int:
    return max(follows.sparkSession.sparkContext.defaultParallelism, -(-follows.count() // FOLLOWS))


def sources(follows: DataFrame, owned: DataFrame, most: int) -> DataFrame:
    """(user, subject, level, reason, at, partial): what each user's follows lead to.

    ``follows`` (user, kind, target, level, at) of kinds ``repo``, ``owner`` and ``thread`` (target
    ``subject#thread``); ``owned`` (owner, subject).  Per user and subject the stronger level wins,
    then the newer, and a user keeps the ``most`` newest; ``partial`` tells that a user had more.
    Ignored targets lead nowhere.

    An owner's subjects come at the strongest level, with the time of the follow or later.  So of
    one owner's no more than its first ``most + 1`` can be kept without a follow of their own, and
    a user's newest owner of as many gives a time, ``floor``, that all that is kept reaches.
    Owners followed before it are not fanned out, and only a weaker follow of a subject that
    reaches it is held against the subject's owners, which could give it an older time.

    What a user has is dealt by user once and what an owner has by owner once; aggregations,
    windows and the union of both ways to a subject read these, so their tasks are as many.
    """
    parts = _parts(follows)
    live = follows.filter("level <> 'ignore'")
    repo = F.col("kind") == "repo"
    direct = live.filter("kind in ('repo', 'thread')").select(
        "user",
        F.when(repo, F.col("target")).otherwise(F.regexp_replace("target", "#[^#]*$", "")).alias("subject"),
        F.when(repo, F.col("level")).otherwise("participating").alias("level"),
        F.when(repo, "subscribed").otherwise("participating").alias("reason"),
        "at",
    )

    def mine(rows: DataFrame) -> DataFrame:
        return rows.repartition(parts, "user").groupBy("user", "subject").agg(F.max(F.struct(_rank(LEVELS, "level").alias("rank"), "at", "reason", "level")).alias("b"))

    own, nobody = mine(direct.filter("user is not null")), mine(direct.filter("user is null"))  # joined by user, or not: one exchange
    pairs = owned.filter("owner is not null").repartition(parts, "owner").distinct()
    few = pairs.withColumn("_k", F.row_number().over(Window.partitionBy("owner").orderBy("subject"))).filter(F.col("_k") <= most + 1).drop("_k")
    owners = live.filter("kind = 'owner'").select("user", F.col("target").alias("owner"), "at").repartition(parts, "owner").groupBy("user", "owner").agg(F.max("at").alias("at"))
    many = F.when(F.col("n") > most, F.col("at"))
    placed = owners.join(pairs.groupBy("owner").agg(F.count("*").alias("n")), "owner").select("user", "owner", "at", many.alias("many")).repartition(parts, "user")
    placed = placed.withColumn("floor", F.max("many").over(Window.partitionBy("user"))).drop("many")
    near = placed.filter("floor is null or at >= floor")
    weak = own.filter(F.col("b.rank") < LEVELS["all"]).join(placed.groupBy("user").agg(F.first("floor").alias("floor")), "user").filter("floor is null or b.at >= floor")
    owning = pairs.withColumnRenamed("subject", "_s")
    shadowed = weak.select("user", "subject").join(owning, F.col("subject").eqNullSafe(F.col("_s"))).join(owners, ["user", "owner"])
    fanned = near.select("user", "owner", "at").join(few, "owner").select("user", "subject", "at").unionByName(shadowed.select("user", "subject", "at")).repartition(parts, "user")
    strong = F.struct(F.lit(LEVELS["all"]).alias("rank"), "at", F.lit("organization").alias("reason"), F.lit("all").alias("level"))
    every = own.unionByName(nobody).unionByName(fanned.select("user", "subject", strong.alias("b")))
    best = every.groupBy("user", "subject").agg(F.max("b").alias("b")).select("user", "subject", "b.level", "b.reason", "b.at")
    newest = Window.partitionBy("user").orderBy(F.desc("at"), "subject")
    kept = best.withColumn("_k", F.row_number().over(newest)).filter(F.col("_k") <= most + 1)
    more = F.max("_k").over(Window.partitionBy("user")) > most
    return kept.withColumn("partial", more).filter(F.col("_k") <= most).drop("_k")


def inbox(found: DataFrame, events: DataFrame, follows: DataFrame, since: Column, each: int) -> DataFrame:
    """(user, subject, thread, n, latest, reason, partial): the threads that a user's sources bring.

    ``events`` (subject, thread, actor, author, at, id): of each subject the ``each`` newest since
    ``since`` count.  A user's own events and ignored threads are left out; a source watched at
    ``participating`` brings only what the user wrote or follows.
    """
    parts = _parts(follows)
    newest = Window.partitionBy("subject").orderBy(F.desc("at"), F.desc("id"))
    late = events.filter(F.col("at") >= since).withColumn("_k", F.row_number().over(newest)).filter(F.col("_k") <= each).drop("_k")
    threads = follows.filter("kind = 'thread'").select("user", "target", "level", "at").repartition(parts, "user", "target").groupBy("user", "target").agg(F.max_by("level", F.struct("at", "level")).alias("followed"))
    # what the source gives by itself: a rank travels, the target's text is made where it is joined
    given = F.when(F.col("author") == F.col("user"), REASONS["author"]).when(F.col("level") == "all", _rank(REASONS, "reason")).cast("tinyint")
    met = found.withColumnRenamed("at", "_at").join(late, "subject").filter(F.col("actor") != F.col("user")).select("user", "subject", "thread", "at", given.alias("_given"), "partial")
    target = F.concat("subject", F.lit("#"), "thread")
    met = met.repartition(parts, F.col("user"), target).withColumn("target", target).join(threads, ["user", "target"], "left").filter("followed is null or followed <> 'ignore'")
    rank = F.when(F.col("_given") == REASONS["author"], F.col("_given")).when(F.col("followed") == "all", REASONS["participating"]).otherwise(F.col("_given"))
    met = met.withColumn("_rank", rank.cast("int")).filter("_rank is not null")
    # "target" says what subject and thread say: rows are grouped where the join has dealt them
    grouped = met.groupBy("user", "subject", "thread", "target").agg(F.count("*").alias("n"), F.max("at").alias("latest"), F.max("_rank").alias("_rank"), F.first("partial").alias("partial"))
    named = F.create_map(*[F.lit(x) for k, v in REASONS.items() for x in (v, k)])[F.col("_rank")]
    return grouped.select("user", "subject", "thread", "n", "latest", named.alias("reason"), "partial")


def title_key(title: Column) -> Column:
    """Letters and digits of a title in lower case, one space between words."""
    return F.trim(F.regexp_replace(F.lower(title), "[^a-z0-9]+", " "))


def with_fallback(rows: DataFrame, entities: DataFrame, key: str, title: str, entity: str, name: str) -> DataFrame:
    """``rows`` with ``resolved``: their own key, else the one entity of the same title, else a key
    made of the title, else null; and ``by``, which of these it was.

    Titles that several entities share resolve nothing.  Only rows without a key are joined; their
    titles are met by equality, after each title's entities are counted.
    """
    one = entities.groupBy(title_key(F.col(name)).alias("_t")).agg(F.min(entity).alias("_one"), F.count_distinct(entity).alias("_n")).filter("_n = 1 and _t <> ''").drop("_n")
    own = F.nullif(F.col(key).cast("string"), F.lit(""))
    rows = rows.withColumn("_t", title_key(F.coalesce(F.col(title), F.lit("")))).withColumn("_own", own)
    has = rows.filter("_own is not null").select(*[c for c in rows.columns if c not in ("_t", "_own")], F.col("_own").alias("resolved"), F.lit("key").alias("by"))
    rest = rows.filter("_own is null").join(one, "_t", "left")
    made = F.coalesce(F.col("_one").cast("string"), F.when(F.col("_t") != "", F.concat(F.lit("title:"), "_t")))
    by = F.when(F.col("_one").isNotNull(), "title").when(F.col("_t") != "", "made")
    return has.unionByName(rest.select(*[c for c in has.columns if c not in ("resolved", "by")], made.alias("resolved"), by.alias("by")))
