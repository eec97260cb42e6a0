"""Sequence labelling and bags of words."""

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LABELS = ["F", "T"]


def viterbi(emission: np.ndarray, transition: np.ndarray) -> np.ndarray:
    """The best label sequence; ``emission``: positions by labels, ``transition``: from by to."""
    n, k = emission.shape
    score, back = emission[0].copy(), np.zeros((n, k), "int32")
    for i in range(1, n):
        total = score[:, None] + transition
        back[i] = total.argmax(0)
        score = total.max(0) + emission[i]
    out = np.zeros(n, "int32")
    out[-1] = score.argmax()
    for i in range(n - 1, 0, -1):
        out[i - 1] = back[i, out[i]]
    return out


#: Weights of each of the models that are trained side by side.
FOLD_BUCKETS = 1 << 16


def hashed(features: Column, buckets: int = FOLD_BUCKETS) -> Column:
    """The feature numbers of an array of features."""
    return F.transform(features, lambda x: F.pmod(F.crc32(x), F.lit(buckets)).cast("int"))


def _messages(rows: DataFrame, *columns: str) -> DataFrame:
    return rows.groupBy("fold", "sequence").agg(F.array_sort(F.collect_list(F.struct("pos", *columns))).alias("s"))


def train_crf_folds(rows: DataFrame, folds: int, rounds: int = 3, labels: list[str] = LABELS, buckets: int = FOLD_BUCKETS) -> tuple[np.ndarray, np.ndarray]:
    """CRF2 with SMP1: an averaged structured perceptron for each fold, trained on the sequences of all others in the same passes.

    ``rows``: ``fold sequence pos ids gold``. By iterative parameter mixing: in each round every task runs over its
    sequences from the mixed weights and sends back what it has, bounded by the models' size (``folds`` x ``buckets`` x
    labels); the driver averages. The weights' average is kept by the sum of the updates times their number, so a
    sequence costs its own features only. The model is a linear chain like the original's, its training isn't, so its
    scores can't be compared digit by digit.
    """
    k = len(labels)
    code = {x: i for i, x in enumerate(labels)}
    w, t = np.zeros((folds, buckets, k)), np.zeros((folds, k, k))
    seqs = _messages(rows, "ids", "gold").select("fold", F.col("s.ids").alias("x"), F.col("s.gold").alias("y"))
    for _ in range(rounds):
        sent = rows.sparkSession.sparkContext.broadcast((w, t))

        def run(batches, sent=sent):
            w, t = (x.copy() for x in sent.value)
            late_w, late_t, n = np.zeros_like(w), np.zeros_like(t), 0
            for df in batches:
                for fold, x, y in zip(df["fold"], df["x"], df["y"]):
                    ids = [np.asarray(i, "int64") for i in x]
                    gold = [code[v] for v in y]
                    for m in range(folds):
                        if m == fold:
                            continue
                        got = viterbi(np.array([w[m][i].sum(0) for i in ids]), t[m])
                        for j, (g, p) in enumerate(zip(gold, got)):
                            if g != p:
                                for a, d in ((g, 1.0), (p, -1.0)):
                                    np.add.at(w[m], (ids[j], a), d)
                                    np.add.at(late_w[m], (ids[j], a), d * n)
                            if j and (gold[j - 1] != got[j - 1] or g != p):
                                for a, b, d in ((gold[j - 1], g, 1.0), (got[j - 1], p, -1.0)):
                                    t[m, a, b] += d
                                    late_t[m, a, b] += d * n
                    n += 1
            if n:
                mean_w, mean_t = w - late_w / n, t - late_t / n
                m, i = np.nonzero(np.abs(mean_w).sum(2))
                yield pd.DataFrame({"m": m.astype("int32"), "i": i, "v": mean_w[m, i].tolist(), "n": 0.0})
                yield pd.DataFrame({"m": np.arange(folds, dtype="int32"), "i": -1, "v": mean_t.reshape(folds, -1).tolist(), "n": 1.0})

        parts = seqs.mapInPandas(run, "m INT, i BIGINT, v ARRAY<DOUBLE>, n DOUBLE")
        mixed = parts.groupBy("m", "i").agg(F.array(*[F.sum(F.get("v", F.lit(j))) for j in range(k * k)]).alias("v"), F.sum("n").alias("n")).toPandas()
        tasks = max(float(mixed["n"].max()), 1.0) if len(mixed) else 1.0
        w, t = np.zeros((folds, buckets, k)), np.zeros((folds, k, k))
        edge = mixed["i"].to_numpy() < 0
        own, both = mixed[~edge], mixed[edge]
        if len(own):
            w[own["m"], own["i"]] = np.array([v[:k] for v in own["v"]], "float64") / tasks
        for m, v in zip(both["m"], both["v"]):
            t[m] = np.array(v, "float64").reshape(k, k) / tasks
        sent.unpersist()
    return w, t


def label_crf_folds(rows: DataFrame, model: tuple[np.ndarray, np.ndarray], labels: list[str] = LABELS) -> DataFrame:
    """``fold``, ``sequence``, ``pos``, ``gold``, ``result``, ``confidence``: each sequence labelled by the model that hasn't seen it."""
    sent = rows.sparkSession.sparkContext.broadcast(model)
    seqs = _messages(rows, "ids", "gold").select("fold", "sequence", F.col("s.pos").alias("pos"), F.col("s.ids").alias("x"), F.col("s.gold").alias("y"))

    def run(batches):
        w, t = sent.value
        for df in batches:
            out = []
            for fold, sequence, pos, x, y in zip(df["fold"], df["sequence"], df["pos"], df["x"], df["y"]):
                e = np.array([w[fold][np.asarray(i, "int64")].sum(0) for i in x])
                got = viterbi(e, t[fold])
                p = np.exp(e - e.max(1, keepdims=True))
                p /= p.sum(1, keepdims=True)
                out += [(int(fold), sequence, int(i), g, labels[r], float(q[r])) for i, g, r, q in zip(pos, y, got, p)]
            yield pd.DataFrame(out, columns=["fold", "sequence", "pos", "gold", "result", "confidence"])

    return seqs.mapInPandas(run, "fold INT, sequence STRING, pos INT, gold STRING, result STRING, confidence DOUBLE")


def naive_bayes(rows: DataFrame, tokens: str, label: str):
    """CRF3: multinomial naive Bayes with smoothing 1 on hashed token counts; gives the fitted pipeline."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import NaiveBayes
    from pyspark.ml.feature import HashingTF, StringIndexer

    return Pipeline(stages=[StringIndexer(inputCol=label, outputCol="_label", stringOrderType="frequencyDesc", handleInvalid="keep"), HashingTF(inputCol=tokens, outputCol="_tf", numFeatures=1 << 16), NaiveBayes(featuresCol="_tf", labelCol="_label", smoothing=1.0)]).fit(rows)


def predicted(fitted, rows: DataFrame) -> DataFrame:
    """``rows`` with ``prediction``, the name of the class; classes that the training rows lacked are never predicted."""
    from pyspark.ml.feature import IndexToString

    out = fitted.transform(rows).withColumnRenamed("prediction", "_prediction")
    return IndexToString(inputCol="_prediction", outputCol="prediction", labels=[*fitted.stages[0].labels, "none"]).transform(out)


def bag(tokens: Column) -> Column:
    """D17: token counts of an array as a map, keys in order."""
    names = F.array_sort(F.array_distinct(tokens))
    return F.map_from_arrays(names, F.transform(names, lambda n: F.size(F.filter(tokens, lambda t: t == n))))


def merged(a: Column, b: Column) -> Column:
    """AGG11: the sum of two bags."""
    return F.map_zip_with(F.coalesce(a, F.expr("map()").cast("map<string,int>")), F.coalesce(b, F.expr("map()").cast("map<string,int>")), lambda _, x, y: F.coalesce(x, F.lit(0)) + F.coalesce(y, F.lit(0)))


# Endings and words of the rule tagger.
_CLOSED = {"DT": "the a an this that these those", "PRP": "i you he she it we they me him her us them", "IN": "in on at of for with from by about into over after before", "CC": "and or but", "MD": "can could may might must shall should will would", "VBZ": "is has does", "VBP": "am are have do", "VBD": "was were had did", "WP": "who what", "WRB": "when where how why", "WDT": "which", "TO": "to"}
_ENDINGS = [("ing", "VBG"), ("ed", "VBD"), ("ly", "RB"), ("s", "NNS")]


def tag_words(tokens: Column) -> Column:
    """STR15: a rule tagger behind the same interface as a trained one: closed classes, endings, else ``NN`` (not the original's tagger)."""
    def tag(t):
        low = F.lower(t)
        out = F.when(low.rlike("^[0-9.]+$"), "CD").when(~low.rlike(r"\p{L}"), ".")
        for k, words in _CLOSED.items():
            out = out.when(low.isin(*words.split()), k)
        for end, k in _ENDINGS:
            out = out.when(low.endswith(end) & (F.length(low) > len(end) + 2), k)
        return out.otherwise("NN")

    return F.transform(tokens, tag)


def lemma(token: Column, tag: Column) -> Column:
    """STR14: lower case without the commonest verb or noun ending, by the tag (a stand-in for a dictionary)."""
    low = F.lower(token)
    verb = F.regexp_replace(low, r"(?<=\w{3})(?:ing|ed|es|s)$", "")
    noun = F.regexp_replace(F.regexp_replace(low, r"(?<=\w{2})ies$", "y"), r"(?<=\w{2}[^s])s$", "")
    return F.when(tag.startswith("V"), verb).otherwise(noun)


def first_verb_form(tags: Column) -> Column:
    """FT18: the first verb tag, or ``NO_VERB``."""
    return F.coalesce(F.try_element_at(F.filter(tags, lambda t: t.isin("VB", "VBD", "VBG", "VBN", "VBP", "VBZ")), F.lit(1)), F.lit("NO_VERB"))
