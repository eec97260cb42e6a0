"""Parquet tables of one data folder, and size-checked broadcasts."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Most rows a lookup table may have to be broadcast; beyond it Spark chooses the join.
BROADCAST_ROWS = 20_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small(df: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` with a broadcast hint if it has at most ``most`` rows, else as it is.

    The check reads ``most`` + 1 rows at the most; a larger table is joined by shuffling.
    """
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def spread(df: DataFrame) -> DataFrame:
    """A scan with fewer partitions than there are cores, dealt out over them before costly Python work.

    Larger inputs have more partitions than that and stay as they are, so nothing is shuffled at scale. Only for plans
    without a shuffle, whose number of partitions is known before they run.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df._jdf.queryExecution().toRdd().getNumPartitions() >= cores else df.repartition(cores)
