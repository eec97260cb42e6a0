"""Reply links, bounded look-back repair of missing ones (JOIN1), and thread roots."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from threadloom.functions.ids import clean_id, subject_digest
from threadloom.operators.dedup import first_of_each
from threadloom.sources.scratch import discard, save

#: Rows of one block of the running number; a block is the most that one window group holds.
BLOCK = 4096


def running_number(df: DataFrame, part: str, order: str = "seq", block: int = BLOCK) -> DataFrame:
    """Adds ``rn``, the rank of each row within ``part`` by the unique integer ``order``, and no window over a whole part.

    Rows are numbered within blocks of ``block`` successive values of ``order``; a block's offset is the sum of the
    counts before it, so a part with a third of all rows is spread over many tasks.
    """
    rows = df.withColumn("_b", F.floor(F.col(order) / block))
    counts = rows.groupBy(part, "_b").agg(F.count(F.lit(1)).alias("_n"))
    before = W.partitionBy(part).orderBy("_b").rowsBetween(W.unboundedPreceding, -1)
    counts = counts.select(F.col(part).alias("_p"), F.col("_b").alias("_b2"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    rows = rows.join(counts, rows[part].eqNullSafe(counts["_p"]) & (rows["_b"] == counts["_b2"]))
    rank = F.row_number().over(W.partitionBy(part, "_b").orderBy(order))
    return rows.withColumn("rn", F.col("_before") + rank).drop("_b", "_p", "_b2", "_before")


def look_back(df: DataFrame, part: str, digest: str, order: str = "seq", depth: int = 10, block: int = BLOCK) -> DataFrame:
    """``order``, ``parent``: per row the nearest row with an equal ``digest`` among the ``depth`` rows before it in its part.

    An as-of join by row distance: each row also goes to the next block if it is within ``depth`` rows of it, so that
    every window group holds one digest of one block. All rows of ``df`` count in the distance.
    """
    rows = running_number(df.select(order, part, digest), part, order, block)
    own = F.floor(F.col("rn") / block)
    rows = rows.withColumn("_blk", F.explode(F.array_distinct(F.array(own, F.floor((F.col("rn") + depth) / block)))))
    w = W.partitionBy(part, "_blk", digest).orderBy("rn")
    rows = rows.withColumn("_prev", F.lag(F.struct("rn", order)).over(w)).where(own == F.col("_blk"))
    parent = F.when(F.col("rn") - F.col("_prev.rn") <= depth, F.col(f"_prev.{order}"))
    return rows.select(order, parent.alias("parent"))


def reply_links(rows: DataFrame, depth: int = 10) -> DataFrame:
    """``seq``, ``parent`` of each row that has a parent; ``rows``: ``seq cid ref mailbox digest re``.

    ``ref`` is the clean id of a reply link or null; ``digest`` is null where the subject is; ``re`` says that the
    subject starts with ``Re:``. A stated link that leads nowhere gives no parent; only rows without one are repaired.
    """
    stated = rows.where(F.col("ref").isNotNull()).select("seq", "ref")
    ids = rows.select(F.col("cid"), F.col("seq").alias("parent"))
    stated = stated.join(ids, stated["ref"] == ids["cid"]).select("seq", "parent")
    repaired = look_back(rows.where(F.col("digest").isNotNull()).select("seq", F.coalesce("mailbox", F.lit("")).alias("mailbox"), "digest"), "mailbox", "digest", depth=depth)
    open_ = rows.where(F.col("ref").isNull() & F.col("re")).select("seq")
    return stated.unionByName(repaired.where(F.col("parent").isNotNull()).join(open_, "seq", "left_semi"))


def roots(links: DataFrame, starts: DataFrame) -> DataFrame:
    """``seq``, ``root``, ``depth`` of every start (depth 0) and all its descendants, by pointer doubling.

    ``links``: ``seq``, ``parent``, one row per child; ``starts``: ``seq`` of the rows that are roots. Each round
    halves the open distance, so a chain of n links takes log2(n) rounds; rows whose way ends elsewhere drop out, and
    the rounds end when none is resolved, which leaves those that lead into a circle. The tables hold four short
    columns; a root that many rows point to is a skewed key, which adaptive execution splits.
    """
    spark = links.sparkSession
    start = starts.select("seq", F.col("seq").alias("ptr"), F.lit(0).alias("depth"), F.lit(True).alias("done"))
    state = save(links.join(starts, "seq", "left_anti").select("seq", F.col("parent").alias("ptr"), F.lit(1).alias("depth"), F.lit(False).alias("done")).unionByName(start), "links")
    open_before = None
    while True:
        left = state.where(~F.col("done")).count()
        if left in (0, open_before):
            break
        open_before = left
        to = state.select(F.col("seq").alias("ptr"), F.col("ptr").alias("next"), F.col("depth").alias("further"), F.col("done").alias("end"))
        moved = state.where(~F.col("done")).join(to, "ptr").select("seq", F.col("next").alias("ptr"), (F.col("depth") + F.col("further")).alias("depth"), F.col("end").alias("done"))
        after = save(state.where("done").unionByName(moved), "links")
        discard(spark, state)
        state = after
    return state.where("done").select("seq", F.col("ptr").alias("root"), "depth")


def paths(links: DataFrame, starts: DataFrame) -> DataFrame:
    """``seq``, ``depth``, ``path`` (the numbers from the root down, 19 digits each, split by ``/``) as :func:`roots` resolves them."""
    spark = links.sparkSession
    number = F.format_string("%019d", "seq")
    reached = save(roots(links, starts).select("seq", "depth"), "depths")
    start = reached.where("depth = 0").select("seq", F.col("seq").alias("ptr"), number.alias("path"), F.lit(True).alias("done"))
    rest = links.join(reached.where("depth > 0"), "seq", "left_semi").select("seq", F.col("parent").alias("ptr"), number.alias("path"), F.lit(False).alias("done"))
    state = save(rest.unionByName(start), "paths")
    while not state.where(~F.col("done")).isEmpty():
        to = state.select(F.col("seq").alias("ptr"), F.col("ptr").alias("next"), F.col("path").alias("above"), F.col("done").alias("end"))
        moved = state.where(~F.col("done")).join(to, "ptr").select("seq", F.col("next").alias("ptr"), F.concat_ws("/", "above", "path").alias("path"), F.col("end").alias("done"))
        after = save(state.where("done").unionByName(moved), "paths")
        discard(spark, state)
        state = after
    return state.select("seq", "path").join(reached, "seq")


def link_rows(messages: DataFrame, *more: str) -> DataFrame:
    """The kept rows as :func:`reply_links` needs them, and the columns ``more``."""
    ref = F.when(F.col("in_reply_to") != "", clean_id(F.col("in_reply_to")))
    ident = clean_id(F.col("message_id"))
    rows = messages.where(F.col("message_id").isNotNull()).select(
        "seq", ident.alias("cid"), ref.alias("ref"), "mailbox", subject_digest(F.col("subject")).alias("digest"), starts_reply(F.col("subject")).alias("re"), *more
    )
    return rows.join(first_of_each(messages, ident), "seq", "left_semi")


def is_start():
    """A root: no reply link, and a subject that is null or doesn't start with ``Re:``."""
    return F.col("ref").isNull() & ~F.col("re")


def starts_reply(subject: Column) -> Column:
    """Whether the subject starts with ``Re:`` (case-sensitive); null subjects don't."""
    return F.coalesce(subject.startswith("Re:"), F.lit(False))
