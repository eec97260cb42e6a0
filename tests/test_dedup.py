import random

from pyspark.sql import functions as F

from threadloom.functions.ids import clean_id, strip_brackets, subject_digest
from threadloom.operators.dedup import first_of_each, kept_rows, quotient_key, repeated_deliveries


def test_ids(spark):
    df = spark.createDataFrame([("<a@b>",), ("x <a> y",), ("a",), (None,), (" <a b> ",), ("",), ("a>b<c",)], "i STRING")
    got = [(r[0], r[1]) for r in df.select(strip_brackets(F.col("i")), clean_id(F.col("i"))).collect()]
    assert got == [("a@b", "a@b"), ("a", "a"), ("a", "a"), (None, None), ("a b", "a+b"), ("", ""), ("c", "c")]
    s = spark.createDataFrame([("Re: Re: Aide é 9!",), ("Report",), (None,)], "s STRING")
    assert [r[0] for r in s.select(subject_digest(F.col("s"))).collect()] == ["aideé", "port", None]


def test_quotient_key_is_a_bijection(spark):
    random.seed(1)
    ids = {"".join(random.choices("ab\0", k=random.randint(0, 20))) for _ in range(4000)} | {"é" * n for n in range(30)}
    df = spark.createDataFrame([(i,) for i in ids], "i STRING")
    assert df.select(*quotient_key(F.col("i"))).distinct().count() == len(ids)


def test_repeats(spark, messages):
    rows = [{"seq": 1, "message_id": "<a>"}, {"seq": 2, "message_id": " a "}, {"seq": 3, "message_id": None}, {"seq": 4, "message_id": None}, {"seq": 5, "message_id": "A"}, {"seq": 6, "message_id": ""}, {"seq": 7, "message_id": "<>"}]
    m = messages(rows, ", cid STRING, q INT, r_low BIGINT")
    assert sorted(r.seq for r in repeated_deliveries(m).collect()) == [2, 7]
    assert sorted(r.seq for r in kept_rows(m).collect()) == [1, 5, 6]
    assert repeated_deliveries(messages([])).count() == 0


def test_hot_identifier(spark):
    df = spark.range(20000).select(F.col("id").alias("seq"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("i"))
    assert first_of_each(df, F.col("i")).count() == 20000 - 6667 + 1


def test_one_shuffle_and_hot_identifiers(spark, messages, monkeypatch):
    rows = [{"seq": i if i % 50 else None, "message_id": f"<{i % 7 if i % 3 else 'hot'}>"} for i in range(3000)] + [{"seq": 1, "message_id": "<1>"}]
    random.Random(2).shuffle(rows)
    first = {}
    for r in rows:
        k = r["message_id"]
        if r["seq"] is not None and r["seq"] < first.get(k, 1 << 60):
            first[k] = r["seq"]
    want = sorted((r["seq"] for r in rows if r["seq"] is not None and r["seq"] != first[r["message_id"]]))
    for local in (200_000, 2):
        monkeypatch.setattr("threadloom.operators.dedup.LOCAL", local)
        found = repeated_deliveries(messages(rows).repartition(5))
        got = [r.seq for r in found.collect()]
        assert sorted(x for x in got if x is not None) == want and None in got
    plan = repeated_deliveries(messages(rows))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("hashpartitioning(q") == 1 and "Join" not in plan
