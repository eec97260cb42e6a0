"""Ordered conversations from message rows (problem 3).

The reply links give every message its conversation's key (its root). The messages then run through a stream in the
order of their arrival, in several portions. Its event time is the time of sending; state is keyed by conversation and
holds its messages in sessions, so that those that arrive late find the ones sent before them. The watermark follows the
arrivals at a distance of ``LATE``; a session that it has passed by ``TIMEOUT`` is closed and emitted with its messages. An
end mark with the last possible time closes all that is open. A conversation that went on after a long silence, or has
more than ``BLOCK`` messages, comes in several pieces; these are judged together, and no state or row holds more than a block.
"""

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from threadloom.functions.ids import clean_id, subject_digest
from threadloom.operators.dedup import first_of_each
from threadloom.operators.threads import reply_links, roots, starts_reply
from threadloom.operators.timestamps import epoch_seconds
from threadloom.sources.scratch import discard, save
from threadloom.sources.tables import small
from threadloom.streaming.sessions import closed_sessions

#: Silence after which a session is emitted, and how late a message may come before its session is closed.
TIMEOUT, LATE = "60 days", "30 days"
#: Portions in which the messages arrive, and successive numbers of messages that one state holds.
PORTIONS, BLOCK = 4, 4096

_MEMBER = "root BIGINT, block BIGINT, seq BIGINT, epoch_s BIGINT, email STRING, filled BOOLEAN, event_at TIMESTAMP"


def _rows(messages: DataFrame, mailboxes: DataFrame) -> DataFrame:
    """The kept rows, without their texts: what links and the conditions need."""
    box = small(mailboxes.select(F.col("mailbox").alias("_box"), F.col("tz_name").alias("_tz"), F.col("date_order").alias("_o")).dropDuplicates(["_box"]))
    ref = F.when(F.col("in_reply_to") != "", clean_id(F.col("in_reply_to")))
    m = messages.where(F.col("message_id").isNotNull()).select(
        "seq",
        clean_id(F.col("message_id")).alias("cid"),
        ref.alias("ref"),
        "mailbox",
        "msg_date",
        subject_digest(F.col("subject")).alias("digest"),
        starts_reply(F.col("subject")).alias("re"),
        F.lower("from_email").alias("email"),
        F.coalesce(F.col("text").rlike(r"\S"), F.lit(False)).alias("filled"),
        "received_at",
    )
    m = m.join(first_of_each(messages, clean_id(F.col("message_id"))), "seq", "left_semi")
    m = m.join(box, m["mailbox"] == box["_box"], "left")
    return m.withColumn("epoch_s", epoch_seconds(F.col("msg_date"), F.col("_tz"), F.col("_o"))).drop("msg_date", "_box", "_tz", "_o")


def _arrivals(members: DataFrame, portions: int):
    """The messages in portions by arrival, the end mark with the last.

    The event time is that of sending, but within ``LATE`` before arrival and not after it: a clock that is wrong or a
    delivery later than that neither moves the watermark on nor falls behind it, so no row is dropped.
    """
    spark = members.sparkSession
    late = F.expr(f"received_at - INTERVAL {LATE}")
    sent = F.coalesce(F.timestamp_seconds("epoch_s"), F.col("received_at"))
    rows = members.select("root", F.floor(F.col("seq") / BLOCK).alias("block"), "seq", "epoch_s", "email", "filled", F.least(F.greatest(sent, late), F.col("received_at")).alias("event_at"), "received_at")
    at = rows.select(F.unix_micros("received_at").cast("double").alias("t")).approxQuantile("t", [i / portions for i in range(1, portions)], 0.05) if portions > 1 else []
    slot = F.lit(0)
    for t in sorted(set(at)):
        slot = slot + (F.unix_micros("received_at") > F.lit(int(t))).cast("int")
    end = spark.range(1).selectExpr("-1L AS root", "0L AS block", "-1L AS seq", "CAST(NULL AS BIGINT) AS epoch_s", "CAST(NULL AS STRING) AS email", "false AS filled", "TIMESTAMP '9990-01-01 00:00:00' AS event_at")
    last = len(set(at))
    for i in range(last + 1):
        part = rows.where(slot == i).drop("received_at")
        yield part.unionByName(end) if i == last else part


def _emitted(members: DataFrame, portions: int) -> DataFrame:
    """``root``, ``seq``, ``epoch_s``, ``email``, ``filled`` as the stream emits them, every message once."""
    message = F.collect_list(F.struct("seq", "epoch_s", "email", "filled")).alias("messages")
    pieces = closed_sessions(members.sparkSession, _arrivals(members, portions), _MEMBER, "event_at", ["root", "block"], TIMEOUT, LATE, [message])
    return pieces.where("root >= 0").select("root", F.explode("messages").alias("m")).select("root", "m.*")


def _validated(messages: DataFrame) -> DataFrame:
    """``root`` and its sender, of the conversations that stay."""
    first = F.max(F.when(F.col("seq") == F.col("root"), F.col("email")))
    whole = messages.groupBy("root").agg(F.count(F.lit(1)).alias("n"), F.min("email").alias("e_min"), F.max("email").alias("e_max"), first.alias("e_root"), F.min("filled").alias("filled"), F.min(F.col("epoch_s").isNotNull()).alias("dated"))
    other = (F.col("e_min") != F.col("e_root")) | (F.col("e_max") != F.col("e_root"))
    return whole.where((F.col("n") >= 2) & other & F.col("filled") & F.col("dated")).select("root", "e_root")


def turns(members: DataFrame) -> DataFrame:
    """Adds ``turn``, from 1 by ``epoch_s``, then ``seq``; numbered within days, so that no group is a whole conversation."""
    rows = members.withColumn("_day", F.floor(F.col("epoch_s") / 86400))
    days = rows.groupBy("root", "_day").agg(F.count(F.lit(1)).alias("_n"))
    before = W.partitionBy("root").orderBy("_day").rowsBetween(W.unboundedPreceding, -1)
    days = days.select("root", "_day", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    rank = F.row_number().over(W.partitionBy("root", "_day").orderBy("epoch_s", "seq"))
    return rows.join(days, ["root", "_day"]).withColumn("turn", (F.col("_before") + rank).cast("int")).drop("_day", "_before")


def conversations(messages: DataFrame, mailboxes: DataFrame, portions: int = PORTIONS) -> DataFrame:
    """``root_seq``, ``turn``, ``seq``, ``role`` (initiator: the sender of the root; responder: anyone else) of the conversations that stay.

    Broken ones (a message without a readable date, or whose links lead nowhere or in a circle), empty ones (a message
    without text) and unanswered ones (no second message, or none by another sender) are left out as a whole. Rows
    without a ``received_at`` count as received in 1970. An empty table gives an empty result.
    """
    spark = messages.sparkSession
    rows = save(_rows(messages, mailboxes), "rows")
    start = rows.where(F.col("ref").isNull() & ~F.col("re")).select("seq")
    found = roots(reply_links(rows), start)
    answered = found.groupBy("root").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("root")
    members = found.join(answered, "root", "left_semi").join(rows.select("seq", "epoch_s", "email", "filled", F.coalesce("received_at", F.timestamp_seconds(F.lit(0))).cast("timestamp").alias("received_at")), "seq")
    members = save(members.select("root", "seq", "epoch_s", "email", "filled", "received_at"), "members")
    discard(spark, rows)
    emitted = _emitted(members, portions)
    if emitted.count() != members.count():
        raise RuntimeError("the stream has lost messages")
    stay = emitted.join(_validated(emitted), "root")
    role = F.when(F.col("email") == F.col("e_root"), "initiator").otherwise("responder")
    return turns(stay.select("root", "epoch_s", "seq", role.alias("role"))).select(F.col("root").alias("root_seq"), "turn", "seq", "role")
