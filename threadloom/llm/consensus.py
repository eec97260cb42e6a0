"""One speech act per sentence from annotators who disagree (problem 5).

Confidence-aware truth discovery. Each annotator's error rate is replaced by the upper end of its confidence interval,
the summed error divided by a low chi-squared quantile with as many degrees of freedom as the annotator has labels, so
a contributor of few labels is trusted little however well these agree. Two steps alternate: given the acts, each
annotator's error bound and the label distances (the surprise of a label given an act, pulled towards the bound) are
computed; given these, each sentence takes the act with the smallest summed distance to its labels. Acts are kept as
weights over the 15 classes until the end. The model has 225 numbers an annotator. Up to ``SENT`` annotators it is
broadcast each round; beyond, it stays a table that the labels are joined with. Both give the same, and no annotator
shares another's model. The labels themselves never leave the executors.
"""

import re

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadloom.sources.scratch import save

# The acts' abbreviations and class names.
ACTS = {
    "Q-Q": "QUESTION-QUESTION",
    "Q-ADD": "QUESTION-ADD",
    "Q-PROB": "QUESTION-PROBLEM",
    "Q-CONF": "QUESTION-CONFIRMATION",
    "Q-CORR": "QUESTION-CORRECTION",
    "Q-RES": "QUESTION-RESOLUTION",
    "A-A": "ANSWER-ANSWER",
    "A-ADD": "ANSWER-ADD",
    "A-CONF": "ANSWER-CONFIRMATION",
    "A-CORR": "ANSWER-CORRECTION",
    "A-OBJ": "ANSWER-OBJECTION",
    "A-ACKN": "ANSWER-ACKNOWLEDGMENT",
    "U": "UNGRAMMATICAL",
    "CIV": "CIVILITY",
    "O": "OTHER",
}
TAGS = list(ACTS)
K = len(TAGS)
#: Share of the chi-squared distribution below the quantile, as its normal deviate (2.5 %).
LOW = -1.959964
ROUNDS = 12
#: Most annotators whose models are broadcast: 36 MB.
SENT = 20_000
#: Labels a row of an annotator's table must have to count as much as the bound.
WEIGHT = 4.0


def usable_labels(labels: DataFrame) -> DataFrame:
    """``thread``, ``sid``, ``annotator``, ``k`` (0-14): the usable label with the highest ``ord`` of each annotator and sentence.

    A tag is usable if its letters are those of an act's abbreviation or class name, whatever the case, blanks and
    dashes. Null ``thread``, ``sid`` or ``annotator`` makes a label unusable; of equal ``ord`` the larger ``label_id`` counts.
    """
    letters = lambda s: re.sub("[^A-Z]", "", s)
    code = {letters(w): i for i, (a, n) in enumerate(ACTS.items()) for w in (a, n, n.replace("GMENT", "GEMENT"))}
    names = F.create_map(*[F.lit(x) for kv in code.items() for x in kv])
    k = F.try_element_at(names, F.regexp_replace(F.upper("tag"), "[^A-Z]", ""))
    rows = labels.select("thread", "sid", "annotator", k.alias("k"), F.struct("ord", "label_id").alias("o")).dropna()
    return rows.groupBy("thread", "sid", "annotator").agg(F.max_by("k", "o").alias("k"))


def error_bound(wrong: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Upper bounds on error rates: summed error over the low chi-squared quantile (Wilson-Hilferty), at most 0.97."""
    n = np.maximum(n, 1.0)
    q = n * np.maximum(1 - 2 / (9 * n) + LOW * np.sqrt(2 / (9 * n)), 0.02) ** 3
    return np.clip((wrong + 0.5) / q, 1e-3, 0.97)


def distances(counts: np.ndarray, pooled: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Label distances [annotator, act, label] and error bounds from weighted label counts of the same shape; ``pooled``: the counts of all annotators."""
    n, right = counts.sum((1, 2)), np.trace(counts, axis1=1, axis2=2)
    bound = error_bound(n - right, n)
    off = (counts.sum(0) if pooled is None else pooled) * (1 - np.eye(K)) + 0.5 * (1 - np.eye(K))
    off /= off.sum(1, keepdims=True)
    base = bound[:, None, None] * off + (1 - bound)[:, None, None] * np.eye(K)
    model = (counts + WEIGHT * base) / (counts.sum(2, keepdims=True) + WEIGHT)
    return -np.log(model), bound


def _weights(a: np.ndarray, k: np.ndarray, item: np.ndarray, n: int, model: np.ndarray | None, prior: np.ndarray) -> np.ndarray:
    """Weights of the acts of ``n`` items whose labels ``k`` annotators ``a`` gave."""
    if model is None:
        w = np.zeros((n, K))
        np.add.at(w, (item, k), 1.0)
        return w / w.sum(1, keepdims=True)
    d = np.tile(-np.log(prior), (n, 1))
    np.add.at(d, item, model[a, :, k])
    w = np.exp(d.min(1, keepdims=True) - d)
    return w / w.sum(1, keepdims=True)


def _prior(pooled: np.ndarray) -> np.ndarray:
    return (pooled.sum(1) + 1) / (pooled.sum() + K)


def _settled(change: float, total: float) -> bool:
    return change <= 1e-4 * max(1.0, total)


OUT = "thread STRING, sid STRING, tag STRING, support DOUBLE, agreement DOUBLE, labels INT"
PEOPLE = "annotator STRING, n BIGINT, error_bound DOUBLE, reliability DOUBLE"


def _decided(df: pd.DataFrame, w: np.ndarray, same: np.ndarray, prior: np.ndarray) -> pd.DataFrame:
    n = same.sum(1)
    best = (w + 1e-12 * prior).argmax(1)
    agree = (same * (same - 1)).sum(1) / np.maximum(n * (n - 1), 1)
    return pd.DataFrame({"thread": df["thread"], "sid": df["sid"], "tag": np.array(TAGS, object)[best], "support": w.max(1), "agreement": agree, "labels": n.astype("int32")})


def consensus(labels: DataFrame, least: int = 3, rounds: int = ROUNDS, sent: int = SENT) -> tuple[DataFrame, DataFrame]:
    """Sentences with usable labels of ``least`` annotators, and the annotators' reliability.

    The first: ``thread``, ``sid``, ``tag``, ``support`` (weight of the act), ``agreement`` (share of the pairs of labels that
    agree), ``labels``. The second: ``annotator``, ``n`` (usable labels), ``error_bound``, ``reliability`` (1 less the bound), a
    row for each. Ties go to the act that is more frequent, then to the guidelines' order. Empty input gives empty results.
    """
    votes = save(usable_labels(labels), "votes")
    people = votes.groupBy("annotator").agg(F.count(F.lit(1)).alias("n"))
    enough = votes.groupBy("thread", "sid").agg(F.sort_array(F.collect_list(F.struct("annotator", "k"))).alias("v")).where(F.size("v") >= least)
    items = save(enough.select(F.monotonically_increasing_id().alias("i"), "thread", "sid", F.col("v.annotator").alias("a"), F.col("v.k").alias("k")), "items")
    if people.limit(sent + 1).count() <= sent:
        return _by_broadcast(items, people, rounds)
    return _by_join(items, people, rounds)


def _by_broadcast(items: DataFrame, people: DataFrame, rounds: int) -> tuple[DataFrame, DataFrame]:
    spark = items.sparkSession
    known = people.orderBy("annotator").toPandas()
    number = {p: i for i, p in enumerate(known["annotator"])}
    size = max(len(number), 1)

    def flat(df: pd.DataFrame):
        size = df["a"].str.len().to_numpy()
        a = np.array([number[x] for v in df["a"] for x in v], "int64")
        return a, np.concatenate([np.asarray(x, "int64") for x in df["k"]]), np.repeat(np.arange(len(df)), size)

    model, prior, bound = None, np.full(K, 1 / K), np.full(size, 0.5)
    counts = np.zeros((size, K, K))
    for _ in range(rounds):
        sent = spark.sparkContext.broadcast((model, prior))

        def tally(batches, sent=sent):
            total = np.zeros((size, K, K))
            for df in batches:
                if len(df):
                    a, k, item = flat(df)
                    w = _weights(a, k, item, len(df), *sent.value)
                    np.add.at(total, (a, slice(None), k), w[item])
            u, t, l = np.nonzero(total)
            yield pd.DataFrame({"u": u.astype("int32"), "t": t.astype("int32"), "l": l.astype("int32"), "w": total[u, t, l]})

        part = items.select("a", "k").mapInPandas(tally, "u INT, t INT, l INT, w DOUBLE").groupBy("u", "t", "l").agg(F.sum("w").alias("w")).toPandas()
        before, counts = counts, np.zeros((size, K, K))
        counts[part["u"], part["t"], part["l"]] = part["w"]
        model, bound = distances(counts)
        prior = _prior(counts.sum(0))
        if _settled(np.abs(counts - before).sum(), counts.sum()):
            break
    sent = spark.sparkContext.broadcast((model, prior))

    def decide(batches):
        for df in batches:
            if len(df):
                a, k, item = flat(df)
                same = np.zeros((len(df), K))
                np.add.at(same, (item, k), 1.0)
                yield _decided(df, _weights(a, k, item, len(df), *sent.value), same, sent.value[1])

    rows = [(p, int(n), float(b), float(1 - b)) for p, n, b in zip(known["annotator"], known["n"], bound)]
    return items.select("thread", "sid", "a", "k").mapInPandas(decide, OUT), spark.createDataFrame(rows, PEOPLE)


def _by_join(items: DataFrame, people: DataFrame, rounds: int) -> tuple[DataFrame, DataFrame]:
    """The same steps with the annotators' models as a table: two joins of narrow labels a round, and 225 numbers on the driver."""
    spark = items.sparkSession
    given = items.select("i", F.explode(F.arrays_zip("a", "k")).alias("v")).select("i", F.col("v.a").alias("a"), F.col("v.k").alias("l"))
    one = lambda c, t: F.element_at(c, t + 1)
    sums = lambda c: F.array(*[F.sum(one(c, t)) for t in range(K)])
    share = F.transform(F.sequence(F.lit(0), F.lit(K - 1)), lambda t: F.size(F.filter("k", lambda x: x == t)) / F.size("k"))
    weights = items.select("i", share.alias("w"))
    before = None
    for _ in range(rounds):
        counts = save(given.join(weights, "i").groupBy("a", "l").agg(sums(F.col("w")).alias("c")), "counts")
        pooled = np.zeros((K, K))
        for r in counts.groupBy("l").agg(sums(F.col("c")).alias("c")).collect():
            pooled[:, r.l] = r.c
        prior = _prior(pooled)

        def measure(batches, pooled=pooled):
            for df in batches:
                if len(df):
                    each = np.zeros((len(df), K, K))
                    for j, v in enumerate(df["v"]):
                        for r in v:
                            each[j, :, r["l"]] = r["c"]
                    d, bound = distances(each, pooled)
                    yield pd.DataFrame({"a": df["a"], "d": [[row.tolist() for row in x.T] for x in d], "bound": bound})

        models = counts.groupBy("a").agg(F.collect_list(F.struct("l", "c")).alias("v")).mapInPandas(measure, "a STRING, d ARRAY<ARRAY<DOUBLE>>, bound DOUBLE")
        models = save(models, "models")
        cost = given.join(models.select("a", F.posexplode("d").alias("l", "d")), ["a", "l"]).groupBy("i").agg(sums(F.col("d")).alias("d"))
        cost = cost.select("i", F.zip_with("d", F.array(*[F.lit(float(-np.log(p))) for p in prior]), lambda x, y: x + y).alias("d"))
        low = cost.select("i", F.transform("d", lambda x: F.exp(F.array_min("d") - x)).alias("w"))
        weights = save(low.select("i", F.transform("w", lambda x: x / F.aggregate("w", F.lit(0.0), lambda s, y: s + y)).alias("w")), "weights")
        changed = None
        if before is not None:
            both = counts.join(before.withColumnRenamed("c", "b"), ["a", "l"], "full")
            zero = F.array(*[F.lit(0.0)] * K)
            gap = F.aggregate(F.zip_with(F.coalesce("c", zero), F.coalesce("b", zero), lambda x, y: F.abs(x - y)), F.lit(0.0), lambda s, y: s + y)
            changed = both.agg(F.sum(gap).alias("n")).collect()[0].n or 0.0
        before = counts
        if changed is not None and _settled(changed, pooled.sum()):
            break

    def decide(batches):
        for df in batches:
            if len(df):
                same = np.array([np.bincount(np.asarray(k, "int64"), minlength=K) for k in df["k"]], "float64")
                yield _decided(df, np.array(df["w"].tolist()), same, prior)

    out = items.join(weights, "i").select("thread", "sid", "k", "w").mapInPandas(decide, OUT)
    bounds = people.join(models.select(F.col("a").alias("annotator"), "bound"), "annotator", "left").withColumn("bound", F.coalesce("bound", F.lit(0.5)))
    return out, bounds.select("annotator", "n", F.col("bound").alias("error_bound"), (1 - F.col("bound")).alias("reliability"))
