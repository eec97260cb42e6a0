"""Exactly one copy of each message that was delivered more than once (problem 1).

Identifiers pass through a bijection that splits them into a well-mixed 64-bit word and the rest of the
identifier. The word's top bits (the quotient) name a shard; its low bits and the rest are the complete
remainder. Since quotient and remainder give the identifier back, equal keys mean equal identifiers: there are no
false matches. Each task first enters its own rows in a small table, so an identifier with a third of all rows costs one
row a task. What is left is shuffled once, by shard, and entered in the shard's table, which like that of a quotient
filter is a run of sorted remainders for each quotient; the sort spills, so a shard needs no memory of its size.
"""

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from threadloom.functions.ids import clean_id

#: Bits of the quotient. 2**16 shards; Spark spreads them over its tasks.
QUOTIENT_BITS = 16
#: Most identifiers of a task's own table; a full one is handed on and begun anew.
LOCAL = 200_000
#: Shards over which a batch's repeated rows are dealt.
SPREAD = 4096


def _word(b: Column, start: int) -> Column:
    """Eight bytes from ``start`` as a BIGINT, short input padded with zero bytes."""
    return F.conv(F.rpad(F.hex(F.substring(b, start, 8)), 16, "0"), 16, -10).cast("bigint")


def quotient_key(ident: Column, bits: int = QUOTIENT_BITS) -> list[Column]:
    """Columns ``q`` (INT shard) and ``r_low`` (BIGINT), ``r_len`` (INT), ``r_rest`` (STRING): a bijective image of ``ident``.

    One Feistel step (head XOR hash of tail) and two xor-shifts, each invertible, mix the head word.
    The head has the characters 1 to 8 of the identifier's bytes; its length tells padding from zero bytes.
    """
    b = F.encode(ident, "UTF-8")
    rest = F.hex(F.substring(b, 9, 1 << 30))
    w = _word(b, 1).bitwiseXOR(F.xxhash64(rest))
    w = w.bitwiseXOR(F.shiftrightunsigned(w, 29))
    w = w.bitwiseXOR(F.shiftleft(w, 35))
    low = w.bitwiseAND(F.lit((1 << (64 - bits)) - 1))
    return [
        F.shiftrightunsigned(w, 64 - bits).cast("int").alias("q"),
        low.alias("r_low"),
        F.octet_length(ident).alias("r_len"),
        rest.alias("r_rest"),
    ]


def first_of_each(df: DataFrame, ident: Column, order: str = "seq", bits: int = QUOTIENT_BITS) -> DataFrame:
    """One column ``order``: per identifier its smallest value. Null identifiers are never equal and are left out.

    Spark's hash aggregate is the shard's table; it inserts each identifier once on the map side too, so an
    identifier with a third of all rows costs one row per map task. An empty identifier is an identifier.
    """
    keys = ["q", "r_low", "r_len", "r_rest"]
    rows = df.where(ident.isNotNull()).select(*quotient_key(ident, bits), F.col(order))
    return rows.groupBy(*keys).agg(F.min(order).alias(order)).select(order)


KEY = "q INT, r_low BIGINT, r_len INT, r_rest STRING, seq BIGINT"


def _entered(batches):
    """A task's own table: each identifier with its smallest ``seq``; rows it knows already are handed on as repeated, without remainder."""
    table: dict = {}
    for batch in batches:
        gone = []
        for *key, seq in zip(*(c.to_pylist() for c in batch.columns)):
            key = tuple(key)
            if key not in table:
                table[key] = seq
            elif (old := table[key]) != seq:
                if old is None or seq is not None and seq < old:
                    table[key], seq = seq, old
                gone.append(seq)
        if gone:
            # on their way through the shuffle these are dealt out, so that a hot identifier's aren't all in its shard
            yield _batch([i % SPREAD for i in range(len(gone))], [None] * len(gone), [None] * len(gone), [None] * len(gone), gone, True)
        if len(table) > LOCAL:
            yield _batch(*zip(*table), list(table.values()), False)
            table = {}
    if table:
        yield _batch(*zip(*table), list(table.values()), False)


def _batch(q, low, size, rest, seq, repeated: bool) -> pa.RecordBatch:
    types = [pa.int32(), pa.int64(), pa.int32(), pa.string(), pa.int64(), pa.bool_()]
    return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip((q, low, size, rest, seq, [repeated] * len(seq)), types)], ["q", "r_low", "r_len", "r_rest", "seq", "repeated"])


def repeated_deliveries(messages: DataFrame, bits: int = QUOTIENT_BITS) -> DataFrame:
    """``seq`` of every row whose cleaned ``message_id`` stands in a row with a smaller ``seq``.

    Rows with a null id never repeat another; a null ``seq`` counts as the largest; rows that agree in id and ``seq`` are
    one row. An empty table gives an empty result; further columns are ignored.
    """
    ident = clean_id(F.col("message_id"))
    rows = messages.where(F.col("message_id").isNotNull()).select(*quotient_key(ident, bits), F.col("seq").cast("bigint").alias("seq"))
    shards = rows.mapInArrow(_entered, KEY + ", repeated BOOLEAN").repartition("q")
    place = F.rank().over(W.partitionBy("q", "r_low", "r_len", "r_rest", "repeated").orderBy(F.asc_nulls_last("seq")))
    return shards.withColumn("place", place).where(F.col("repeated") | (F.col("place") > 1)).select("seq")


def kept_rows(messages: DataFrame) -> DataFrame:
    """The messages with a clean id, one row per id (the smallest ``seq``), with the column ``cid`` added.

    The rows are found by a semi join on ``seq``, so no text is shuffled by identifier and a hot one stays harmless.
    """
    ident = clean_id(F.col("message_id"))
    first = first_of_each(messages, ident)
    return messages.where(ident.isNotNull()).withColumn("cid", ident).join(first, "seq", "left_semi")
