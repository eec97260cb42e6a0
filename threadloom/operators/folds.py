"""Folds and splits."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadloom.sources.scratch import save


def ranked(df: DataFrame, key: str, buckets: int | None = None) -> DataFrame:
    """Adds ``i``, the rank from 0 by the distinct string ``key``, without one window over all rows.

    Rows are numbered within range partitions by ``key``, as many as the session shuffles into; the partitions' counts,
    one number each, give the offsets.
    """
    buckets = buckets or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = save(df.repartitionByRange(buckets, key).withColumn("_p", F.spark_partition_id()), "ranked")
    counts = parts.groupBy("_p").count()
    before = counts.selectExpr("_p", "coalesce(sum(count) OVER (ORDER BY _p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS _before")
    return parts.withColumn("_r", F.expr(f"row_number() OVER (PARTITION BY _p ORDER BY {key})")).join(F.broadcast(before), "_p").withColumn("i", F.col("_before") + F.col("_r") - 1).drop("_p", "_r", "_before")


def k_folds(df: DataFrame, key: str, k: int = 10) -> DataFrame:
    """SMP1: ``fold`` in which a row is test: its rank by ``key`` modulo ``k``; all other folds train on it."""
    return ranked(df, key).select(key, F.pmod(F.col("i"), F.lit(k)).cast("int").alias("fold"))


def holdout(df: DataFrame, key: str, share: float = 0.9) -> DataFrame:
    """SMP2, SMP4: the first ``floor(share * n)`` rows by ``key`` train, the rest test."""
    rows = ranked(df, key)
    most = f"(SELECT floor(count(*) * CAST({share} AS DOUBLE)) FROM {{r}})"
    return rows.sparkSession.sql(f"SELECT {key}, CASE WHEN i < {most} THEN 'train' ELSE 'test' END AS part FROM {{r}}", r=rows)


def line_folds(lines: DataFrame, k: int = 10) -> DataFrame:
    """SMP3: fold of each line by its number in its file, for those who want messages cut; :func:`k_folds` keeps them whole."""
    return lines.select("filename", "phys_no", F.pmod(F.col("phys_no") - 1, F.lit(k)).cast("int").alias("fold")).distinct()


def split(df: DataFrame, key: str, folds: int = 10, test: list[str] | None = None) -> DataFrame:
    """SMP1, SMP2: ``fold``, ``key``, ``part`` of each fold's rows.

    ``folds`` above 1: every row is test in one fold and train in all others. 1: one fold, the first nine tenths train. 0: no
    fold, no row. ``test`` (the keys of a fixed test set): one fold, all others train.
    """
    spark = df.sparkSession
    if test is not None:
        return df.select(F.lit(0).alias("fold"), key, F.when(F.col(key).isin(test), "test").otherwise("train").alias("part"))
    if folds == 0:
        return spark.createDataFrame([], f"fold INT, {key} STRING, part STRING")
    if folds == 1:
        return holdout(df, key).select(F.lit(0).alias("fold"), key, "part")
    own = k_folds(df, key, folds).withColumnRenamed("fold", "_own")
    return own.select(F.explode(F.sequence(F.lit(0), F.lit(folds - 1))).alias("fold"), key, "_own").select("fold", key, F.when(F.col("fold") == F.col("_own"), "test").otherwise("train").alias("part"))
