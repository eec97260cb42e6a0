from threadloom.operators import evaluate as E
from threadloom.operators import folds as K
from threadloom.operators import tagged as T


def _seq(spark, **folds):
    rows = [(f, i, g, r, c) for f, (gold, result, conf) in folds.items() for i, (g, r, c) in enumerate(zip(gold, result, conf))]
    return spark.createDataFrame(rows, "fold STRING, pos INT, gold STRING, result STRING, confidence DOUBLE")


def test_training_part_is_all_other_folds(spark):
    s = _seq(spark, a=("TFFF", "TFFF", [1.0] * 4), b=("TFTFTF", "FFFFFT", [0.9, 0.9, 0.9, 0.9, 0.9, 0.8]))
    assert {(r.fold, r.n, r.n_train, r.t_train) for r in E.training(s).collect()} == {("a", 4, 6, 3), ("b", 6, 4, 1)}
    base = {(r.fold, r.pos): r.baseline for r in E.trained_baseline(s).collect()}
    assert "".join(base["a", i] for i in range(4)) == "TFTF" and "".join(base["b", i] for i in range(6)) == "TFTFTF"  # ceil(6/4), ceil(4/2)
    one = E.smart_combined(s, E.trained_baseline(s), s).where("fold = 'b'").orderBy("pos").collect()
    assert "".join(r.label for r in one) == "TFFFFF"  # floor(1 * 6 / 4) boundary
    alone = _seq(spark, a=("TF", "TF", [1.0] * 2))
    assert [r.baseline for r in E.trained_baseline(alone).orderBy("pos").collect()] == ["T", "T"]
    assert [r.label for r in E.smart_combined(alone, E.trained_baseline(alone), alone).orderBy("pos").collect()] == ["F", "F"]


def test_label_and_score(spark):
    df = spark.createDataFrame([("f", 0, "T/0.8300"), ("f", 1, "F"), ("f", 2, None), ("f", 3, "F/x")], "fold STRING, pos INT, column STRING")
    assert [(r.label, r.score) for r in E.split_scores(df).orderBy("pos").collect()] == [("T", 0.83), ("F", None), (None, None), ("F", None)]


def test_average_at_a_tie_in_any_order(spark):
    """0.3941025 is rounded up; doubles added in the second order give 0.394102."""
    for order in ([0.098419, 0.511555, 0.029725, 0.936711], [0.098419, 0.029725, 0.936711, 0.511555]):
        rows = [(str(i), "recall", v, round(1 - v, 6), None, None) for i, v in enumerate(order)] + [("4", "recall", None, None, None, None)]
        one = E.averaged(spark.createDataFrame(rows, "fold STRING, metric STRING, result DOUBLE, baseline DOUBLE, texttiling DOUBLE, gold DOUBLE").coalesce(1))
        assert one.dtypes == [("metric", "string")] + [(c, "double") for c in (*E.SYSTEMS, "gold")]
        assert [tuple(r) for r in one.collect()] == [("recall", 0.394103, 0.605898, None, None)]


def test_multiclass(spark):
    rows = spark.createDataFrame([("a", "a", "b"), ("a", "b", "b"), ("b", "b", "b"), ("c", "a", "b")], "act STRING, one STRING, two STRING")
    got = {r.guess: (r.precision, r.recall) for r in E.multiclass(rows, "act", "one", "two").collect()}
    assert got == {"one": (0.375, 0.5), "two": (0.0625, 0.25)}
    assert E.multiclass(rows.limit(0), "act", "one").count() == 0


def test_statistics_of_the_training_part(spark):
    lines = spark.createDataFrame([(f"f{i}", 1, "B\t" + " ".join(["w"] * (i + 1) + [f"only{i}"])) for i in range(4)] + [("f9", 1, None)], "filename STRING, phys_no INT, raw STRING")
    folds = spark.createDataFrame([(f"f{i}", i % 2) for i in range(4)], "filename STRING, fold INT")
    r = T.records(lines)
    mean = {x.fold: x.number_of_tokens for x in E.train_averages(T.line_features(r), folds, T.NUMERIC).collect()}
    assert mean == {0: 4.0, 1: 3.0}  # files 1 and 3; 0 and 2
    tokens = {(x.fold, x.token): x.n for x in E.train_tokens(r, folds, 2, 0.2).collect()}
    assert tokens == {(0, "w"): 6, (1, "w"): 4}
    top = {(x.fold, x.rank): x.ngram for x in E.train_ngrams(T.ngram_rows(lines), folds, 2, 1).collect()}
    assert top[0, 1] == "w w" and len(top) == 2
    tiers = E.tiers(T.line_features(r), E.train_averages(T.line_features(r), folds, T.NUMERIC), folds, T.NUMERIC, T.tier)
    assert {x.filename: x.number_of_tokens for x in tiers.collect()}["f2"] == "number_of_tokens_high"


def test_splits(spark):
    files = spark.createDataFrame([(f"n{i:02d}",) for i in range(20)], "filename STRING")
    ten = K.split(files, "filename")
    assert ten.count() == 200 and ten.where("part = 'test'").groupBy("filename").count().where("count = 1").count() == 20
    assert K.split(files, "filename", 1).where("part = 'train'").count() == 18 and K.split(files, "filename", 0).count() == 0
    assert [r.filename for r in K.split(files, "filename", test=["n03"]).where("part = 'test'").collect()] == ["n03"]


def test_hinges(spark):
    kept = spark.createDataFrame([("f", 1, "He sees boxes"), ("f", 2, "@NULL")], "filename STRING, line_number INT, kept STRING")
    a, b = T.hinge_columns(kept).orderBy("line_number").collect()
    assert (a.first_1, a.first_tag_1, a.first_lemma_3, a.last_1, a.last_tag_1, b.first_1, b.first_2, b.last_lemma_3) == ("He", "PRP", "boxe", "boxes", "NNS", "@NULL", "NULL.TOKEN", "NULL.TOKEN")


def test_limited_files(spark):
    rows = [(f"f{i}", "text/plain", "UTF-8", "true" if i % 2 else "false") for i in range(10)]
    files = spark.createDataFrame(rows, "filename STRING, mime STRING, encoding STRING, is_initial STRING")
    names = lambda df: sorted(r.filename for r in df.collect())
    assert names(T.limited_files(files, 3)) == ["f1", "f3", "f5"] and names(T.limited_files(files, 3, False)) == ["f1"]


def test_bayes_on_unseen_classes(spark):
    from threadloom.operators import learn as L

    schema = "tokens ARRAY<STRING>, act STRING"
    train = spark.createDataFrame([(["what", "is"], "Q"), (["what", "now"], "Q"), (["it", "is"], "A"), (["it", "was"], "A")], schema)
    test = spark.createDataFrame([(["what"], "Q"), (["it"], "A"), (["was"], "new"), ([], "Q")], schema)
    got = [r.prediction for r in L.predicted(L.naive_bayes(train, "tokens", "act"), test).collect()]
    assert got[:3] == ["Q", "A", "A"] and got[3] in ("Q", "A")
