import random

from threadloom.llm import consensus as C

SCHEMA = "label_id BIGINT, thread STRING, doc_no INT, sent_no INT, sid STRING, annotator STRING, ord INT, boundary STRING, tag STRING, a INT, k INT"


def _table(spark, rows):
    return spark.createDataFrame([(i, t, 1, 1, s, a, o, "T", g, None, None) for i, (t, s, a, o, g) in enumerate(rows)], SCHEMA)


def test_usable_labels(spark):
    rows = [("t", "1.1", "a", 1, "CIV"), ("t", "1.1", "a", 2, " q – add"), ("t", "1.1", "a", 3, "?"), ("t", "1.10", "a", 1, "Answer_Acknowledgement"), ("t", "1.1", "b", 1, None), (None, "1.1", "c", 1, "O"), ("t", "1.1", None, 1, "O")]
    assert {(r.sid, r.annotator, C.TAGS[r.k]) for r in C.usable_labels(_table(spark, rows)).collect()} == {("1.1", "a", "Q-ADD"), ("1.10", "a", "A-ACKN")}


def test_truth_is_found(spark):
    random.seed(11)
    error = {"good1": 0.05, "good2": 0.1, "mid": 0.3, "spam1": 0.95, "spam2": 0.95, "mixed": 0.25}
    truth, rows = {}, []
    for i in range(900):
        truth[f"{i}"] = t = random.choice(C.TAGS)
        for a in random.sample(list(error), 4):
            wrong = random.random() < error[a]
            g = random.choice(C.TAGS) if wrong else t
            if a == "mixed" and t == "A-ADD":
                g = "A-A"  # a steady mistake
            rows.append(("t", f"{i}", a, 1, g))
    out, people = C.consensus(_table(spark, rows))
    got = {r.sid: r for r in out.collect()}
    assert sum(got[s].tag == t for s, t in truth.items()) / len(truth) > 0.9
    r = {x.annotator: x.reliability for x in people.collect()}
    assert r["good1"] > r["mid"] > r["spam1"] and all(0 <= x.agreement <= 1 for x in got.values())


def test_many_annotators_by_join(spark):
    """Beyond the bound of the broadcast: the same acts and bounds, one for every annotator."""
    random.seed(5)
    acts = {f"{i}": random.choice(C.TAGS[:6]) for i in range(150)}
    rows = [("t", i, f"a{random.randrange(40)}", 1, t if random.random() < 0.8 else random.choice(C.TAGS)) for i, t in acts.items() for _ in range(4)]
    few, many = C.consensus(_table(spark, rows)), C.consensus(_table(spark, rows), sent=3)
    one = lambda r: (r.sid, r.tag, round(r.support, 3), round(r.agreement, 6), r.labels)
    assert sorted(map(one, few[0].collect())) == sorted(map(one, many[0].collect()))
    two = lambda r: (r.annotator, r.n, round(r.error_bound, 3))
    assert sorted(map(two, few[1].collect())) == sorted(map(two, many[1].collect())) and many[1].count() == len({a for _, _, a, _, _ in rows})


def test_few_labels_and_empty(spark):
    out, _ = C.consensus(_table(spark, [("t", "1", a, 1, "O") for a in "ab"] + [("t", "2", a, 1, g) for a, g in zip("abc", ("U", "O", "CIV"))]))
    assert [r.sid for r in out.collect()] == ["2"]
    assert C.consensus(_table(spark, []))[0].count() == 0
    assert C.error_bound(C.np.array([0.0]), C.np.array([1.0]))[0] > C.error_bound(C.np.array([0.0]), C.np.array([500.0]))[0]
