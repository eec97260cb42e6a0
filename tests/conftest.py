import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(__file__)))


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    s = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    return s


MESSAGES = "seq BIGINT, message_id STRING, msg_date STRING, from_name STRING, from_email STRING, to_name STRING, to_email STRING, subject STRING, in_reply_to STRING, text STRING, filename STRING, mailbox STRING, batch_id STRING, received_at TIMESTAMP"


@pytest.fixture(scope="session")
def messages(spark):
    """Builds a message table from dicts; columns that are missing are null, ``mailbox`` is 'm'."""

    def build(rows, extra=""):
        names = [c.split()[0] for c in (MESSAGES + extra).split(", ")]
        return spark.createDataFrame([tuple((r.get(n, "m" if n == "mailbox" else None)) for n in names) for r in rows], MESSAGES + extra)

    return build


@pytest.fixture(scope="session")
def mailboxes(spark):
    return spark.createDataFrame([("m", "en", "Europe/Paris", "dmy", "l@x"), ("us", "en", "America/New_York", "mdy", "l@x")], "mailbox STRING, lang STRING, tz_name STRING, date_order STRING, list_address STRING")
