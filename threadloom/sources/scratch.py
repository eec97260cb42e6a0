"""Tables written in the shared checkpoint folder, to cut lineage so that a lost executor costs no recomputation."""

import atexit
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_written: list = []


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; only where that is unset and one machine runs all (as in tests) one of our own."""
    d = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not d:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        d = "file://" + tempfile.mkdtemp(prefix="threadloom-")
        spark.sparkContext.setCheckpointDir(d)
        d = spark.sparkContext.getCheckpointDir()
    return d.rstrip("/")


def new_path(spark: SparkSession, what: str = "table") -> str:
    """A fresh path in the shared folder; removed when the session's program ends."""
    path = f"{shared_dir(spark)}/threadloom/{what}-{uuid.uuid4().hex}"
    if not _written:
        atexit.register(_sweep, spark)
    _written.append(path)
    return path


def save(df: DataFrame, what: str = "table") -> DataFrame:
    """``df`` written as Parquet and read again."""
    spark = df.sparkSession
    path = new_path(spark, what)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch = path
    return out


def discard(spark: SparkSession, *tables) -> None:
    """Removes saved tables (or paths) that no later plan reads."""
    jvm = spark.sparkContext._jvm
    for t in tables:
        if path := t if isinstance(t, str) else getattr(t, "_scratch", None):
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
            if path in _written:
                _written.remove(path)


def _sweep(spark: SparkSession) -> None:
    try:
        discard(spark, *_written)
    except Exception:  # noqa: BLE001  the session may be gone
        pass
