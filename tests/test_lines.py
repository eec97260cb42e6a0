from pyspark.sql import functions as F

from threadloom.operators import tagged as T
from threadloom.sinks import exports as E


def _lines(spark, *raw):
    return spark.createDataFrame([("f", i + 1, r) for i, r in enumerate(raw)], "filename STRING, phys_no INT, raw STRING")


def test_records_and_numbering(spark):
    got = T.records(_lines(spark, "# head", "B\tHello you ?", None, "x", "I\té > b", "#foo bar baz")).orderBy("line_number").collect()
    assert [(r.line_number, r.tag, r.label, list(r.tokens), r.total_lines) for r in got] == [(1, "B", "T", ["Hello", "you", "?"], 2), (4, "I", "F", ["é", ">", "b"], 2), (5, "#foo", "F", ["bar", "baz"], 2)]
    assert T.records(_lines(spark)).count() == 0


def test_thinning(spark):
    for tags, kept in (("I", "I"), ("II", "II"), ("III", "II"), ("BIIIIE", "BIIE")):
        got = T.thinned(_lines(spark, *[f"{t}\tx" for t in tags])).orderBy("phys_no").collect()
        assert "".join(r.tag for r in got) == kept
    assert T.thinned(_lines(spark, "I\tx", "I\tx", "", "I\tx", "I\tx")).count() == 3


def test_features(spark):
    r = T.line_features(T.records(_lines(spark, "B\tWho shall I , you ?"))).collect()[0]
    assert r.number_of_tokens == 6 and r.has_interrogating_word and r.starts_with_interrogating_form and r.first_personal_pronoun == "YOU"
    assert not r.contains_modal_word and not r.has_early_punctuation and r.has_question_mark and r.ends_with_question_mark
    assert T.line_features(T.records(_lines(spark, "B\tWho shall I")), fix_modal=True).collect()[0].contains_modal_word
    assert T.line_features(T.records(_lines(spark, "I\té")), unicode_text=True, exclude_label=True).collect()[0].number_of_chars == 1
    assert T.line_features(T.records(_lines(spark, "I\té"))).collect()[0].number_of_chars == 4


def test_tiers(spark):
    df = spark.createDataFrame([(v,) for v in (1.0, 3.0, 4.0, 6.0, 6.01)], "v DOUBLE")
    assert [r[0] for r in df.select(T.tier(F.col("v"), F.lit(4.0))).collect()] == ["low", "low", "high", "high", "highest"]
    assert [r[0] for r in df.select(T.tier(F.col("v"), F.lit(4.0), fix_tiers=True)).collect()] == ["lowest", "low", "high", "high", "highest"]


def test_length_outliers_use_the_population_deviation(spark):
    df = spark.createDataFrame([(f, i, "x y") for f, n in (("a", 1), ("b", 3)) for i in range(n)], "filename STRING, phys_no INT, raw STRING")
    assert {(r.filename, r.kept_new, r.kept_old) for r in T.length_outliers(df).collect()} == {("a", True, True), ("b", True, True)}


def test_exports(spark):
    f = T.line_features(T.records(_lines(spark, "B\ta b ?", "I\tc d")))
    rows = E.arff_rows(f).collect()
    head = E.arff_header("r", [x for x in f.dtypes if x[0] not in ("line_number", "label")], ["T", "F"])
    assert {len(r.line.split(",")) for r in rows} == {sum(x.startswith("@attribute") for x in head)}
    assert [r.line for r in E.sequence_tsv(f, ["number_of_tokens"]).orderBy("line_number").collect()] == ["3\tT", "2\tF", ""]


def test_all_ngrams_are_looked_up(spark, tmp_path):
    from threadloom.plans import tagged

    spark.createDataFrame([("f", i + 1, f"I a{i:03d} b{i:03d} c{i:03d}") for i in range(330)], "filename STRING, phys_no INT, raw STRING").write.parquet(str(tmp_path / "tagged_lines.parquet"))
    got = {r.line_number: r.hits for r in tagged.QUERIES["ngram_hits"](spark, str(tmp_path)).collect()}
    assert got == {i + 1: 3 for i in range(330)}
