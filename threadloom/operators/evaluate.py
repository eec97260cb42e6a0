"""Evaluation fold by fold: statistics of the training part only, and three systems side by side.

In every fold all other folds train. What a training part holds is the total less the fold's own, so one pass gives it for
all folds. A sequence table is that of :mod:`threadloom.operators.segments`.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadloom.operators import segments as S

SYSTEMS = ["result", "baseline", "texttiling"]


def cohesion_labels(marked: DataFrame, sentences: DataFrame) -> DataFrame:
    """``fold``, ``pos``, ``texttiling``: T where a sentence shares no word of four letters with the one before it."""
    return marked.sparkSession.sql(
        r"""
        WITH t AS (SELECT thread, sid, min(text) AS text FROM {s} GROUP BY thread, sid),
             w AS (SELECT m.thread AS fold, CAST(row_number() OVER o - 1 AS INT) AS pos, words, lag(words) OVER o AS before
                   FROM (SELECT m.*, regexp_extract_all(lower(coalesce(text, '')), '[a-z]{{4,}}', 0) AS words FROM {m} m LEFT JOIN t USING (thread, sid)) m
                   WINDOW o AS (PARTITION BY m.thread ORDER BY doc_no, sent_no, sid))
        SELECT fold, pos, CASE WHEN coalesce(arrays_overlap(words, before), false) THEN 'F' ELSE 'T' END AS texttiling FROM w
        """,
        m=marked,
        s=sentences,
    )


def training(seq: DataFrame) -> DataFrame:
    """``fold``, ``n``, ``n_train``, ``t_train``: length of each fold, and length and gold boundaries of what trains it."""
    own = seq.groupBy("fold").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("gold") == "T").alias("t"))
    total = own.agg(F.struct(F.sum("n").alias("n"), F.sum("t").alias("t")).alias("whole"))
    every = seq.sparkSession.sql("SELECT fold, n, t, (SELECT whole FROM {t}) AS whole FROM {o}", t=total, o=own)
    return every.select("fold", "n", (F.col("whole.n") - F.col("n")).alias("n_train"), (F.col("whole.t") - F.col("t")).alias("t_train"))


def trained_baseline(seq: DataFrame) -> DataFrame:
    """EVAL6: ``fold``, ``pos``, ``baseline``: a boundary every ``ceil`` of the mean segment of the training labels."""
    return seq.sparkSession.sql(
        """
        SELECT fold, pos, CASE WHEN pos % period = 0 THEN 'T' ELSE 'F' END AS baseline
        FROM {s} JOIN (SELECT fold, greatest(CAST(ceil(CAST(n_train AS DOUBLE) / (t_train + 1)) AS INT), 1) AS period FROM {t}) USING (fold)
        """,
        s=seq,
        t=training(seq),
    )


def smart_combined(results: DataFrame, base: DataFrame, seq: DataFrame, min_confidence: float = 0.75) -> DataFrame:
    """EVAL7: :func:`segments.combined` with as many boundaries as the training part has for the fold's length."""
    return results.sparkSession.sql(
        """
        WITH j AS (SELECT fold, pos, CASE WHEN baseline = 'T' THEN 1D WHEN result = 'T' THEN confidence ELSE 0D END AS score FROM {r} JOIN {b} USING (fold, pos)),
             m AS (SELECT fold, CAST(floor(t_train * coalesce(try_divide(CAST(n AS DOUBLE), n_train), 0D)) AS INT) AS most FROM {t}),
             k AS (SELECT fold, pos, row_number() OVER (PARTITION BY fold ORDER BY score DESC, pos) AS rn FROM j WHERE score >= CAST({c} AS DOUBLE))
        SELECT j.fold, j.pos, CASE WHEN k.pos IS NULL THEN 'F' ELSE 'T' END AS label
        FROM j LEFT JOIN (SELECT k.fold, k.pos FROM k JOIN m USING (fold) WHERE rn <= most) k ON j.fold = k.fold AND j.pos = k.pos
        """,
        r=results,
        b=base,
        t=training(seq),
        c=min_confidence,
    )


def scored_labels(seq: DataFrame) -> DataFrame:
    """The labeller's column ``label/score`` of each position."""
    return seq.select("fold", "pos", F.concat("result", F.lit("/"), F.format_string("%.4f", F.col("confidence"))).alias("column"))


def split_scores(columns: DataFrame) -> DataFrame:
    """EVAL8: ``label`` and ``score`` of a column ``label/score``; without a slash the score is null."""
    return columns.select("fold", "pos", F.split_part("column", F.lit("/"), F.lit(1)).alias("label"), F.expr("try_cast(nullif(split_part(column, '/', 2), '') AS DOUBLE)").alias("score"))


def systems(seq: DataFrame, marked: DataFrame, sentences: DataFrame) -> DataFrame:
    """EVAL11: one sequence for each fold and system: ``fold`` is the system and the fold, ``result`` its label."""
    wide = seq.join(trained_baseline(seq), ["fold", "pos"]).join(cohesion_labels(marked, sentences), ["fold", "pos"])
    each = F.explode(F.array(*[F.struct(F.lit(s).alias("system"), F.col(s).alias("label")) for s in SYSTEMS]))
    return wide.select("fold", "pos", "gold", each.alias("x")).select(F.concat_ws("\t", "x.system", "fold").alias("fold"), "pos", "gold", F.col("x.label").alias("result"))


def score_table(of: DataFrame) -> DataFrame:
    """D15, AGG9: ``fold``, ``metric`` and the value of each system; the last metric is the number of boundaries, gold ones in ``gold``."""
    counts = of.groupBy("fold").agg(F.lit("boundaries").alias("metric"), F.count_if(F.col("result") == "T").cast("double").alias("value"), F.count_if(F.col("gold") == "T").cast("double").alias("gold"))
    rows = S.metric_rows(of).withColumn("gold", F.lit(None).cast("double")).unionByName(counts)
    long = rows.select(F.split_part("fold", F.lit("\t"), F.lit(2)).alias("fold"), F.split_part("fold", F.lit("\t"), F.lit(1)).alias("system"), "metric", "value", "gold")
    of_system = lambda s: F.max(F.when(F.col("system") == s, F.col("value"))).alias(s)
    return long.groupBy("fold", "metric").agg(*map(of_system, SYSTEMS), F.max("gold").alias("gold"))


def averaged(scores: DataFrame) -> DataFrame:
    """AGG9: the mean over the folds; folds where a value is undefined don't count for it.

    Values are added as decimals: a sum of doubles depends on the order of the folds, and so would the last digit at a tie.
    """
    mean = lambda c: F.round(F.avg(F.col(c).cast("decimal(24,12)")), 6).cast("double").alias(c)
    return scores.groupBy("metric").agg(*map(mean, [*SYSTEMS, "gold"]))


def score_lines(average: DataFrame) -> DataFrame:
    """SNK7: ``at``, ``line`` of the layout: per cent with two decimals, and the differences of the result from both others."""
    value = lambda c: F.coalesce(F.format_string("%.2f", F.col(c) * 100), F.lit("-"))
    less = lambda c: F.coalesce(F.format_string("%.2f", (F.col("result") - F.col(c)) * 100), F.lit("-"))
    count = lambda c: F.coalesce(F.format_string("%.0f", F.floor(c).cast("double")), F.lit("-"))
    at = F.array_position(F.array(*map(F.lit, ["windowdiff", "pk", "ghd", "accuracy", "precision", "recall", "f1", "segment_ratio", "boundaries"])), F.col("metric"))
    ratios = F.concat_ws("\t", F.concat(F.lit("# "), "metric", F.lit(":")), value("result"), value("baseline"), less("baseline"), value("texttiling"), less("texttiling"))
    counts = F.concat_ws("\t", F.lit("# boundaries:"), count("result"), count("baseline"), count("texttiling"), count("gold"))
    return average.select(at.cast("int").alias("at"), F.when(F.col("metric") == "boundaries", counts).otherwise(ratios).alias("line"))


def multiclass(rows: DataFrame, truth: str, *guesses: str) -> DataFrame:
    """EVAL10: ``guess``, ``precision``, ``recall``, ``f1``, averaged over the classes by their frequency; a class never guessed has precision 0."""
    each = F.explode(F.array(*[F.struct(F.lit(g).alias("guess"), F.col(g).alias("label")) for g in guesses]))
    return rows.sparkSession.sql(
        """
        WITH l AS (SELECT guess, label, truth, count(*) AS n FROM {r} GROUP BY guess, label, truth),
             g AS (SELECT guess, label, sum(n) AS n FROM l GROUP BY guess, label),
             t AS (SELECT guess, truth, sum(n) AS n FROM l GROUP BY guess, truth),
             c AS (SELECT t.guess, t.n, coalesce(l.n, 0) / t.n AS r, coalesce(try_divide(coalesce(l.n, 0), g.n), 0D) AS p
                   FROM t LEFT JOIN l ON l.guess = t.guess AND l.label = t.truth AND l.truth = t.truth LEFT JOIN g ON g.guess = t.guess AND g.label = t.truth)
        SELECT guess, round(sum(n * p) / sum(n), 6) AS precision, round(sum(n * r) / sum(n), 6) AS recall, round(sum(n * coalesce(try_divide(2 * p * r, p + r), 0D)) / sum(n), 6) AS f1 FROM c GROUP BY guess
        """,
        r=rows.select(F.col(truth).alias("truth"), each.alias("x")).select("truth", "x.guess", "x.label"),
    )


def fold_sums(rows: DataFrame, key: str, folds: int) -> DataFrame:
    """``fold``, ``key``, ``n``: how often a key occurs in what trains each of ``folds`` folds: in all, less in the fold itself.

    Rows are counted by fold and key before they are shuffled; the rest are joins and sums of these counts.
    """
    own = rows.groupBy("fold", key).agg(F.count(F.lit(1)).alias("own"))
    total = own.groupBy(key).agg(F.sum("own").alias("total"))
    every = total.withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(folds - 1))))
    return every.join(own, ["fold", key], "left").select("fold", key, (F.col("total") - F.coalesce("own", F.lit(0))).alias("n"))


def train_averages(features: DataFrame, folds: DataFrame, numeric: list[str]) -> DataFrame:
    """AGG2 of the training part: ``fold`` and the averages over the lines of all files of other folds."""
    rows = features.join(folds, "filename")
    sums = [F.sum(F.col(c).cast("double")).alias(c) for c in numeric] + [F.count(c).alias("n_" + c) for c in numeric]
    own = rows.groupBy("fold").agg(*sums)
    total = own.agg(*[F.sum(c).alias(c) for c in own.columns if c != "fold"]).select(F.struct("*").alias("t"))
    with_total = features.sparkSession.sql("SELECT o.*, (SELECT t FROM {t}) AS t FROM {o} o", t=total, o=own)
    return with_total.select("fold", *[F.try_divide(F.col(f"t.{c}") - F.coalesce(c, F.lit(0.0)), F.col(f"t.n_{c}") - F.col(f"n_{c}")).alias(c) for c in numeric])


def train_tokens(records: DataFrame, of_fold: DataFrame, folds: int, quotient: float = 0.075 / 150) -> DataFrame:
    """AGG1, FLT6 of the training part: ``fold``, ``token``, ``n`` of the tokens that occur there more often than ``quotient`` of all."""
    tokens = records.join(of_fold, "filename").select("fold", F.explode(F.transform("tokens", F.lower)).alias("token"))
    return records.sparkSession.sql(
        "SELECT fold, token, n FROM {c} JOIN (SELECT fold, sum(n) AS s FROM {c} GROUP BY fold) USING (fold) WHERE n > s * CAST({q} AS DOUBLE)", c=fold_sums(tokens, "token", folds), q=quotient
    )


def train_ngrams(grams: DataFrame, of_fold: DataFrame, folds: int, k: int = 1000) -> DataFrame:
    """D13 of the training part: ``fold``, ``rank``, ``ngram``: its ``k`` most frequent n-grams; ties by name.

    Spark drops the ranks above ``k`` in each task before the window's shuffle, so no task sorts a whole fold.
    """
    counted = fold_sums(grams.join(of_fold, "filename").select("fold", "ngram"), "ngram", folds)
    ranked = f"SELECT fold, ngram, CAST(row_number() OVER (PARTITION BY fold ORDER BY n DESC, ngram) AS INT) AS rank FROM {{c}} WHERE n > 0"
    return counted.sparkSession.sql(f"SELECT fold, rank, ngram FROM ({ranked}) WHERE rank <= {k}", c=counted)


def tiers(features: DataFrame, averages: DataFrame, of_fold: DataFrame, numeric: list[str], tier) -> DataFrame:
    """FT28 by the training part's averages; ``averages`` has a row for each of the few folds."""
    mean = averages.select("fold", F.struct(*numeric).alias("_a"))
    rows = features.join(of_fold, "filename").join(F.broadcast(mean), "fold")
    return rows.select("fold", "filename", "line_number", *[F.when(F.col(k).isNotNull() & F.col(f"_a.{k}").isNotNull(), F.concat(F.lit(k + "_"), tier(F.col(k), F.col(f"_a.{k}")))).alias(k) for k in numeric])
