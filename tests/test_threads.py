import random

from pyspark.sql import functions as F

from threadloom.operators.graph import Graph, quote_blocks
from threadloom.operators.threads import look_back, roots, running_number


def test_running_number_and_look_back(spark):
    random.seed(4)
    rows = [(i, random.choice(["hot", "hot", "b"]), random.choice("abcdefghijklmnop")) for i in random.sample(range(5000), 3000)]
    df = spark.createDataFrame(rows, "seq BIGINT, part STRING, digest STRING")
    by, want_rn, want = {}, {}, {}
    for s, p, d in sorted(rows):
        seen = by.setdefault(p, [])
        want_rn[s] = len(seen) + 1
        want[s] = next((q for q, e in reversed(seen[-10:]) if e == d), None)
        seen.append((s, d))
    assert {r.seq: r.rn for r in running_number(df, "part", block=64).collect()} == want_rn
    assert {r.seq: r.parent for r in look_back(df, "part", "digest", block=64).collect()} == want


def test_distance_of_ten(spark):
    rows = [(0, "m", "x")] + [(i, "m", f"n{i}") for i in range(1, 10)] + [(10, "m", "x"), (11, "p", "x")] + [(12 + i, "p", f"o{i}") for i in range(10)] + [(30, "p", "x")]
    got = {r.seq: r.parent for r in look_back(spark.createDataFrame(rows, "seq BIGINT, mailbox STRING, digest STRING"), "mailbox", "digest").collect()}
    assert got[10] == 0 and got[30] is None


def test_roots_with_chain_and_circle(spark):
    links = [(i, i - 1) for i in range(1, 70)] + [(200, 201), (201, 200), (202, 200), (300, 999)]
    got = {r.seq: (r.root, r.depth) for r in roots(spark.createDataFrame(links, "seq BIGINT, parent BIGINT"), spark.createDataFrame([(0,)], "seq BIGINT")).collect()}
    assert got == {i: (0, i) for i in range(70)}
    assert roots(spark.createDataFrame([], "seq BIGINT, parent BIGINT"), spark.createDataFrame([], "seq BIGINT")).count() == 0


def test_graph(messages):
    t = "> a\nb\n> c"
    m = messages([
        {"seq": 1, "message_id": "<a>", "subject": "s", "text": "x", "filename": "f1"}, {"seq": 2, "message_id": "<b>", "in_reply_to": "<a>", "text": t, "filename": "f2"}, {"seq": 3, "message_id": "<c>", "in_reply_to": "a", "text": t, "filename": "f3"},
        {"seq": 4, "message_id": "<d>", "in_reply_to": "<gone>"}, {"seq": 5, "message_id": "<e>", "subject": "Re: s"}, {"seq": 6, "message_id": "<f>", "subject": "RE: s"},
    ])
    g = Graph(m)
    assert {(r.seq, r.parent) for r in g.edges.collect()} == {(2, 1), (3, 1), (5, 1)}
    assert {(r.root, r.height, r.messages) for r in g.heights().collect()} == {(1, 2, 4), (6, 1, 1)}
    assert {r.seq for r in g.orphans().collect()} == {4}
    assert {(r.parent, r.seq) for r in g.later_replies().collect()} == {(1, 3), (1, 5)}
    assert [(r.source_seq, r.reply_seq) for r in g.couples().collect()] == [(1, 3)]
    empty = Graph(messages([])).statistics().collect()[0]
    assert empty.threads == 0 and empty.messages_per_thread is None


def test_quote_blocks(spark):
    df = spark.createDataFrame([("a",), ("> a",), ("> a\n> b\nx\n> c\n\n",), (None,), ("",)], "t STRING")
    assert [r[0] for r in df.select(quote_blocks(F.col("t"))).collect()] == [0, 1, 2, None, 0]
