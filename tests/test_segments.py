import random

from pyspark.sql import functions as F

from threadloom.operators import align as A
from threadloom.operators import folds as K
from threadloom.operators import learn as L
from threadloom.operators import segments as S


def _seq(spark, gold, result, fold="f"):
    return spark.createDataFrame([(fold, i, "a", g, r, 0.5) for i, (g, r) in enumerate(zip(gold, result))], "fold STRING, pos INT, act STRING, gold STRING, result STRING, confidence DOUBLE")


def test_identity_and_misses(spark):
    same = _seq(spark, "TFFTFT", "TFFTFT")
    assert S.windowdiff(same).collect()[0].windowdiff == 0 and S.pk(same).collect()[0].pk == 0 and S.ghd(same).collect()[0].ghd == 0
    a = S.agreement(same).collect()[0]
    assert (a.accuracy, a.precision, a.recall, a.f1, a.segment_ratio) == (1, 1, 1, 1, 1)
    miss = _seq(spark, "FFTFFTFFF", "FFTFFFFFF")
    assert S.ghd(miss).collect()[0].ghd == round(2 / 9, 6)
    none = S.agreement(_seq(spark, "FF", "FF")).collect()[0]
    assert none.precision is None and none.f1 is None and S.pk(_seq(spark, "FF", "FF")).collect()[0].pk is None


def _wd(g, r):
    n, k = len(g), int(len(g) / (g.count("T") + 1) / 2)
    return sum(abs(g[i : i + k + 1].count("T") - r[i : i + k + 1].count("T")) for i in range(n - k)) / n


def _pk(g, r):
    n, k = len(g), max(int(len(g) / (2 * g.count("T")) + 0.5), 1)
    w = [("T" not in g[i + 1 : i + k], "T" not in r[i + 1 : i + k]) for i in range(n - k + 1)]
    same, miss, alarm = (sum(x) / len(w) for x in ([a for a, _ in w], [b and not a for a, b in w], [a and not b for a, b in w]))
    return miss * (1 - same) + alarm * same


def test_metrics_against_brute_force(spark):
    random.seed(3)
    data = {f"f{i}": ["".join(random.choices("TF", [1, 2 + i % 7], k=5 + i)) for _ in "ab"] for i in range(30)}
    df = None
    for f, (g, r) in data.items():
        x = _seq(spark, g, r, f)
        df = x if df is None else df.unionByName(x)
    wd = {r.fold: r.windowdiff for r in S.windowdiff(df).collect()}
    pk = {r.fold: r.pk for r in S.pk(df).collect()}
    for f, (g, r) in data.items():
        assert abs((wd.get(f) or 0) - _wd(g, r)) < 1e-5
        assert pk[f] is None if "T" not in g else abs(pk[f] - _pk(g, r)) < 1e-5


def test_ghd_brute_force():
    def slow(a, b):
        if not a or not b:
            return 2 * len(a or b)
        return min(slow(a[:-1], b) + 2, slow(a, b[:-1]) + 2, slow(a[:-1], b[:-1]) + abs(a[-1] - b[-1]))

    random.seed(5)
    for _ in range(60):
        a, b = (sorted(random.sample(range(20), random.randint(0, 5))) for _ in "ab")
        assert S.ghd_distance(a, b) == slow(a, b)


def test_tags(spark):
    for bits, want in (("1", ["BE"]), ("11", ["B", "E"]), ("111", ["B", "I", "E"]), ("101", ["BE", "O", "BE"]), ("0", ["O"])):
        df = spark.createDataFrame([("c", i, b == "1") for i, b in enumerate(bits)], "couple STRING, pos INT, aligned BOOLEAN")
        assert [r.tag for r in S.bieo(df).orderBy("pos").collect()] == want


def test_combination(spark):
    r = spark.createDataFrame([("f", 0, "T", 0.74), ("f", 1, "T", 0.75), ("f", 2, "F", 0.9), ("f", 3, "T", 0.9)], "fold STRING, pos INT, result STRING, confidence DOUBLE")
    b = spark.createDataFrame([("f", i, "T" if i == 2 else "F") for i in range(4)], "fold STRING, pos INT, baseline STRING")
    labels = lambda **k: "".join(x.label for x in S.combined(r, b, **k).orderBy("pos").collect())
    assert labels() == "FTTT" and labels(max_boundaries=2) == "FFTT" and labels(max_boundaries=0) == "FFFF" and labels(drop_last=True) == "FFTT"


def _cost(pairs, a, b):
    return sum(75 if None in p else 0 if a[p[0]].lower() == b[p[1]].lower() else 100 for p in pairs)


def test_alignment_is_optimal(monkeypatch):
    def best(a, b):
        row = [75 * j for j in range(len(b) + 1)]
        for x in a:
            last, row[0] = row[0], row[0] + 75
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], min(row[j] + 75, row[j - 1] + 75, last + (0 if x == y else 100))
        return row[-1]

    random.seed(7)
    for _ in range(40):
        a, b = (random.choices("abcde", k=random.randint(0, 12)) for _ in "ab")
        p = A.align(a, b)
        assert _cost(p, a, b) == best(a, b)
        assert [i for i, _ in p if i is not None] == list(range(len(a))) and [j for _, j in p if j is not None] == list(range(len(b)))
    monkeypatch.setattr(A, "KEPT", 200)
    a = [f"w{i}" for i in range(60)]
    p = A.align(a, ["new", *a[:40], "x", *a[45:]])
    assert [i for i, _ in p if i is not None] == list(range(60)) and sum(i is not None and j is not None for i, j in p) >= 55


def test_aligned_lines():
    got = A.aligned_lines("First question here ?\nSecond question there ?\nBye\n", "> First question here ?\nanswer one\n> Second question there ?\nanswer two\n")
    tags = [t for s, _, t in got if s]
    assert tags.count("O") < len(tags) and any(r and "First" in r for _, r, _ in got)
    assert A.aligned_lines("", "") == [] and A.aligned_lines(None, "> x\n") is not None


def test_folds(spark):
    df = spark.createDataFrame([(f"n{i:04d}",) for i in range(95)], "name STRING")
    assert {r.name: r.fold for r in K.k_folds(df, "name").collect()} == {f"n{i:04d}": i % 10 for i in range(95)}
    assert sum(r.part == "train" for r in K.holdout(df, "name").collect()) == 85


def test_crf_learns_by_folds(spark):
    rows = [(s % 3, f"s{s}", i, [(s * 7 + i) % 3, 7], "T" if (s * 7 + i) % 3 == 0 else "F") for s in range(30) for i in range(12)]
    df = spark.createDataFrame(rows, "fold INT, sequence STRING, pos INT, ids ARRAY<INT>, gold STRING")
    got = {(r.sequence, r.pos): r.result for r in L.label_crf_folds(df, L.train_crf_folds(df, 3, buckets=16)).collect()}
    assert sum(got[f, p] == g for _, f, p, _, g in rows) == len(rows)
    # a fold's own labels don't reach its model
    w = [L.train_crf_folds(df.withColumn("gold", F.when(F.col("fold") == 1, x).otherwise(F.col("gold"))), 3, buckets=16)[0] for x in ("T", "F")]
    assert (w[0][1] == w[1][1]).all() and (w[0][0] != w[1][0]).any()
    none = df.limit(0)
    assert L.label_crf_folds(none, L.train_crf_folds(none, 3, buckets=16)).count() == 0


def test_alignment_is_the_same_at_every_size(monkeypatch):
    rng = random.Random(8)
    for _ in range(30):
        a, b = ([rng.choice("abcdE") for _ in range(rng.randrange(40))] for _ in range(2))
        monkeypatch.setattr(A, "KEPT", 1 << 40)
        whole = A.align(a, b)
        monkeypatch.setattr(A, "KEPT", 10)
        assert A.align(a, b) == whole
        assert [i for i, _ in whole if i is not None] == list(range(len(a))) and [j for _, j in whole if j is not None] == list(range(len(b)))
    a = [f"w{rng.randrange(400)}" for _ in range(3000)]
    b = a[:1000] + ["x"] * 50 + a[1200:]
    monkeypatch.setattr(A, "KEPT", 4_000_000)
    cost = sum(75 if i is None or j is None else 0 if a[i] == b[j] else 100 for i, j in A.align(a, b))
    assert cost <= 50 * 100 + 150 * 75


def test_patterns():
    p = S.pattern_columns(window=5, syntactic=True, groups=24)
    assert len(p) == 5 * (36 + 24) and S.pattern_lines(p)[0] == "*00000:%x[-2,0]"
    assert S.pattern_columns(syntactic=False, groups=0, thematic=True)[0][1] == [(-2, 42)]


def test_all_boundaries_are_combined(spark, tmp_path):
    from threadloom.plans import segments

    acts = ["Q", "A"] * 10
    spark.createDataFrame([("t", 1, i + 1, f"1.{i + 1}", "x") for i in range(20)], "thread STRING, doc_no INT, sent_no INT, sid STRING, text STRING").write.parquet(str(tmp_path / "corpus_sentences.parquet"))
    spark.createDataFrame([("t", f"1.{i + 1}", i, f"l{i}", a, "T") for i, a in enumerate(acts)], "thread STRING, sid STRING, ord INT, label_id STRING, tag STRING, boundary STRING").write.parquet(str(tmp_path / "bc3_labelled.parquet"))
    got = [r.label for r in segments.QUERIES["combine_results"](spark, str(tmp_path)).collect()]
    assert got == ["T"] * 20
