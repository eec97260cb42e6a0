"""Keyed session state over a stream of rows that arrive in portions, drained into a table."""

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom.sources.scratch import discard, new_path


def closed_sessions(spark: SparkSession, arrivals: Iterable[DataFrame], schema: str, time: str, keys: list[str], timeout: str, late: str, values: list[Column]) -> DataFrame:
    """``keys`` and ``values`` (aliased aggregates) of every session of the rows that arrive, portion after portion.

    Each portion is written to the stream's folder and taken in by a run of the same query, so state, watermark and
    progress are carried on from its checkpoint, as after a restart. Structured Streaming keeps one state a key and
    session in the state store; a session is emitted once the watermark (the latest ``time`` less ``late``) has passed its
    ``timeout``, and rows that come later within ``late`` still reach it. The last portion must hold an end mark, a row
    with a ``time`` beyond all others, which closes what is open; its own session stays open and isn't emitted.
    """
    source, out, mark = new_path(spark, "arrivals"), new_path(spark, "sessions"), new_path(spark, "stream")
    spark.createDataFrame([], schema).write.parquet(source)  # the stream needs its folder

    def sessions():
        rows = spark.readStream.schema(schema).parquet(source).withWatermark(time, late)
        return rows.groupBy(F.session_window(time, timeout), *keys).agg(*values).drop("session_window")

    made = sessions().schema
    spark.createDataFrame([], made).write.parquet(out)  # an empty stream still gives a table
    for portion in arrivals:
        portion.write.mode("append").parquet(source)
        query = sessions().writeStream.format("parquet").option("path", out + "/rows").option("checkpointLocation", mark).outputMode("append").trigger(availableNow=True).start()
        query.awaitTermination()
    discard(spark, mark, source)
    return spark.read.schema(made).option("recursiveFileLookup", "true").parquet(out)
