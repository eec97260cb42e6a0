"""Boundaries, windows over label sequences, and segmentation metrics.

A sequence table has ``fold``, ``pos`` (from 0 without gaps), ``gold``, ``result`` (T or F) and further columns. Windows
whose length depends on the fold are equi-joins on running sums; these are formed within blocks of ``BLOCK`` positions, to
which the sums of the blocks before are added, and neighbours are joined by position. So a fold with a third of all rows is
spread over many tasks. What a fold needs in order (:func:`ghd`, the rank of :func:`combined`) holds its boundaries only.
"""

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from threadloom.sources.scratch import save


#: Positions of one block of a running sum.
BLOCK = 4096


def running(rows: DataFrame, keys: list[str], sums: dict[str, str]) -> DataFrame:
    """``rows`` with running sums, by ``pos`` within ``keys``, of SQL expressions by name."""
    x = rows.withColumn("_b", F.floor(F.col("pos") / BLOCK))
    own = x.groupBy(*keys, "_b").agg(*[F.sum(F.expr(e)).alias(n) for n, e in sums.items()])
    before = W.partitionBy(*keys).orderBy("_b").rowsBetween(W.unboundedPreceding, -1)
    offset = own.select(*[F.col(k).alias("_" + k) for k in keys], F.col("_b").alias("_of"), *[F.coalesce(F.sum(n).over(before), F.lit(0)).alias("_" + n) for n in sums])
    same = x["_b"] == offset["_of"]
    for k in keys:
        same = same & x[k].eqNullSafe(offset["_" + k])
    inside = W.partitionBy(*keys, "_b").orderBy("pos")
    return x.join(offset, same).select(*[x[c] for c in rows.columns], *[(F.col("_" + n) + F.sum(F.expr(e)).over(inside)).alias(n) for n, e in sums.items()])


def annotated(sentences: DataFrame, labels: DataFrame) -> DataFrame:
    """JOIN4: each sentence with its first and last act (by ``ord``), ``none`` without; keys count once, ``sid`` is a string."""
    key, order, act = ["thread", "sid"], F.struct("ord", "label_id"), F.upper(F.trim("tag"))
    s = sentences.groupBy(*key).agg(F.min("doc_no").alias("doc_no"), F.min("sent_no").alias("sent_no"))
    a = labels.where("tag IS NOT NULL").groupBy(*key).agg(F.min_by(act, order).alias("act"), F.max_by(act, order).alias("last_act"), F.avg((F.col("boundary") == "T").cast("double")).alias("confidence"))
    none = lambda c: F.coalesce(c, F.lit("none")).alias(c)
    return s.join(a, key, "left").select("thread", "doc_no", "sent_no", "sid", none("act"), none("last_act"), F.coalesce("confidence", F.lit(0.0)).alias("confidence"))


def boundaries(acts: DataFrame) -> DataFrame:
    """WIN3, WIN4: ``changed`` where the act differs from the one before in the same document, ``guideline`` also between two Q-Q or O."""
    return acts.sparkSession.sql(
        """
        SELECT thread, doc_no, sent_no, sid, act, last_act, confidence, p IS DISTINCT FROM act AS changed, p IS DISTINCT FROM act OR act IN ('Q-Q', 'O') AS guideline, q IS DISTINCT FROM last_act AS last_changed
        FROM (SELECT *, lag(act) OVER w AS p, lag(last_act) OVER w AS q FROM {a} WINDOW w AS (PARTITION BY thread, doc_no ORDER BY sent_no, sid))
        """,
        a=acts,
    )


def sequences(marked: DataFrame) -> DataFrame:
    """The label sequences of the threads: gold by the first annotations, result by the last; numbered within documents."""
    before = W.partitionBy("thread").orderBy("doc_no").rowsBetween(W.unboundedPreceding, -1)
    docs = marked.groupBy("thread", "doc_no").agg(F.count(F.lit(1)).alias("n"))
    docs = docs.select(F.col("thread").alias("_t"), F.col("doc_no").alias("_d"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_before"))
    rows = marked.join(docs, marked["thread"].eqNullSafe(docs["_t"]) & marked["doc_no"].eqNullSafe(docs["_d"]))
    place = F.row_number().over(W.partitionBy("thread", "doc_no").orderBy("sent_no", "sid"))
    mark = lambda c: F.when(F.col(c), "T").otherwise("F")
    return rows.select(F.col("thread").alias("fold"), (F.col("_before") + place - 1).cast("int").alias("pos"), "act", mark("changed").alias("gold"), mark("last_changed").alias("result"), "confidence")


def _sums(seq: DataFrame) -> DataFrame:
    return running(seq.select("fold", "pos", "gold", "result"), ["fold"], {"g": "CAST(gold = 'T' AS INT)", "r": "CAST(result = 'T' AS INT)"})


_COUNTS = "n AS (SELECT fold, count(*) AS n, count_if(gold = 'T') AS t FROM {s} GROUP BY fold)"


def windowdiff(seq: DataFrame, variant: str = "sum") -> DataFrame:
    """EVAL1, WIN12: difference of the boundary counts of windows of k + 1 positions, k half the mean gold segment.

    ``sum`` adds the differences and divides by the length; ``normalized`` counts the windows that differ and divides by their number.
    """
    one = "abs(dg - dr)" if variant == "sum" else "CAST(dg <> dr AS INT)"
    by = "max(n)" if variant == "sum" else "count(*)"
    return seq.sparkSession.sql(
        f"""
        WITH {_COUNTS}, k AS (SELECT fold, n, CAST(floor(CAST(n AS DOUBLE) / (t + 1) / 2) AS INT) AS k FROM n),
             d AS (SELECT a.fold, n, b.g - a.g + CAST(a.gold = 'T' AS INT) AS dg, b.r - a.r + CAST(a.result = 'T' AS INT) AS dr
                   FROM {{c}} a JOIN k USING (fold) JOIN {{c}} b ON a.fold = b.fold AND a.pos + k.k = b.pos)
        SELECT fold, round(CAST(sum({one}) AS DOUBLE) / {by}, 6) AS windowdiff FROM d GROUP BY fold
        """,
        s=seq,
        c=_sums(seq),
    )


def pk(seq: DataFrame, variant: str = "product") -> DataFrame:
    """EVAL2: Pk with k = N / (2 boundaries), rounded; null without gold boundaries.

    ``product``: misses times differing plus false alarms times same references; ``mismatch``: the rate of windows that disagree.
    """
    value = "miss * (1 - same) + alarm * same" if variant == "product" else "miss + alarm"
    return seq.sparkSession.sql(
        f"""
        WITH {_COUNTS}, k AS (SELECT fold, n, greatest(CAST(round(try_divide(CAST(n AS DOUBLE), 2 * t)) AS INT), 1) AS k FROM n WHERE t > 0),
             d AS (SELECT a.fold, b.g = a.g AS sg, b.r = a.r AS sr FROM {{c}} a JOIN k USING (fold) JOIN {{c}} b ON a.fold = b.fold AND a.pos + k.k - 1 = b.pos),
             p AS (SELECT fold, avg(CAST(sg AS DOUBLE)) AS same, avg(CAST(sr AND NOT sg AS DOUBLE)) AS miss, avg(CAST(sg AND NOT sr AS DOUBLE)) AS alarm FROM d GROUP BY fold)
        SELECT n.fold, round({value}, 6) AS pk FROM n LEFT JOIN p USING (fold)
        """,
        s=seq,
        c=_sums(seq),
    )


def ghd_distance(system: list[int], gold: list[int], insert: float = 2.0, delete: float = 2.0, shift: float = 1.0) -> float:
    """EVAL3: generalised Hamming distance of two boundary lists; one row of the table is kept."""
    row = [j * insert for j in range(len(gold) + 1)]
    for i, h in enumerate(system, 1):
        last, row[0] = row[0], i * delete
        for j, r in enumerate(gold, 1):
            last, row[j] = row[j], min(row[j] + delete, row[j - 1] + insert, last + shift * abs(h - r))
    return row[-1]


def ghd(seq: DataFrame, insert: float = 2.0, delete: float = 2.0, shift: float = 1.0) -> DataFrame:
    """EVAL3: the distance of each fold divided by its length; only boundary positions reach Python."""
    rows = seq.groupBy("fold").agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_list(F.when(F.col("result") == "T", F.col("pos")))).alias("s"), F.array_sort(F.collect_list(F.when(F.col("gold") == "T", F.col("pos")))).alias("g"))

    @F.pandas_udf("double")
    def distance(s: pd.Series, g: pd.Series) -> pd.Series:
        return pd.Series([ghd_distance(list(map(int, a)), list(map(int, b)), insert, delete, shift) for a, b in zip(s, g)])

    return rows.select("fold", F.round(distance("s", "g") / F.col("n"), 6).alias("ghd"))


def agreement(seq: DataFrame) -> DataFrame:
    """EVAL4, EVAL5, AGG8: accuracy, precision, recall, F1 of label T and the ratio of boundaries; a ratio without denominator is null."""
    return seq.sparkSession.sql(
        """
        WITH c AS (SELECT fold, count(*) AS n, count_if(gold = result) AS same, count_if(gold = 'T') AS g, count_if(result = 'T') AS r, count_if(gold = 'T' AND result = 'T') AS b FROM {s} GROUP BY fold),
             p AS (SELECT fold, CAST(same AS DOUBLE) / n AS accuracy, try_divide(CAST(b AS DOUBLE), r) AS precision, try_divide(CAST(b AS DOUBLE), g) AS recall, try_divide(CAST(r AS DOUBLE), g) AS ratio FROM c)
        SELECT fold, round(accuracy, 6) AS accuracy, round(precision, 6) AS precision, round(recall, 6) AS recall, round(try_divide(2 * precision * recall, precision + recall), 6) AS f1, round(ratio, 6) AS segment_ratio FROM p
        """,
        s=seq,
    )


def metric_rows(seq: DataFrame) -> DataFrame:
    """``fold``, ``metric``, ``value`` of all metrics, a union and no join; the labels are computed once and saved."""
    seq, out = save(seq.select("fold", "pos", "gold", "result"), "labels"), None
    for df in (windowdiff(seq), pk(seq), ghd(seq), agreement(seq)):
        names = [c for c in df.columns if c != "fold"]
        rows = df.select("fold", F.explode(F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).alias("value")) for c in names])).alias("x")).select("fold", "x.metric", "x.value")
        out = rows if out is None else out.unionByName(rows)
    return out


def scores(seq: DataFrame) -> DataFrame:
    """AGG9: the metrics averaged over the folds, one row a metric; undefined values don't count."""
    return metric_rows(seq).groupBy("metric").agg(F.round(F.avg("value"), 6).alias("value"))


def periodic_baseline(seq: DataFrame) -> DataFrame:
    """EVAL6: a boundary every ``ceil(N / (T + 1))`` positions from the first."""
    return seq.sparkSession.sql(
        "SELECT fold, pos, CASE WHEN pos % period = 0 THEN 'T' ELSE 'F' END AS baseline FROM {s} JOIN (SELECT fold, CAST(ceil(CAST(count(*) AS DOUBLE) / (count_if(gold = 'T') + 1)) AS INT) AS period FROM {s} GROUP BY fold) USING (fold)", s=seq
    )


def combined(results: DataFrame, base: DataFrame, max_boundaries: int = -1, min_confidence: float = 0.75, drop_last: bool = False) -> DataFrame:
    """EVAL7, JOIN9, SRT1-2: positions where the base, or the result with enough confidence, has a boundary, best first.

    ``results``: ``fold pos result confidence``; ``base``: ``fold pos baseline``. ``max_boundaries`` below 0 keeps all; with
    ``drop_last`` it then leaves out the last, as the slice of the original did.
    """
    if max_boundaries < 0 and not drop_last:  # nothing to rank
        score = F.when(F.col("baseline") == "T", 1.0).when(F.col("result") == "T", F.col("confidence")).otherwise(0.0)
        return results.join(base, ["fold", "pos"]).select("fold", "pos", F.when(score >= min_confidence, "T").otherwise("F").alias("label"))
    cut = f"rn <= {max_boundaries}" if max_boundaries >= 0 else "rn < m"
    return results.sparkSession.sql(
        f"""
        WITH j AS (SELECT fold, pos, CASE WHEN baseline = 'T' THEN 1D WHEN result = 'T' THEN confidence ELSE 0D END AS score FROM {{r}} JOIN {{b}} USING (fold, pos)),
             k AS (SELECT fold, pos, row_number() OVER (PARTITION BY fold ORDER BY score DESC, pos) AS rn, count(*) OVER (PARTITION BY fold) AS m FROM j WHERE score >= {min_confidence}D)
        SELECT j.fold, j.pos, CASE WHEN k.pos IS NULL THEN 'F' ELSE 'T' END AS label FROM j LEFT JOIN (SELECT fold, pos FROM k WHERE {cut}) k ON j.fold = k.fold AND j.pos = k.pos
        """,
        r=results,
        b=base,
    )


def segments(seq: DataFrame) -> DataFrame:
    """WIN7: the number of the segment of each position; a segment starts at a gold boundary."""
    rows = running(seq.select("fold", "pos", "act", "gold"), ["fold"], {"segment": "CAST(gold = 'T' AS INT)"})
    return rows.select("fold", "pos", "act", F.col("segment").cast("int").alias("segment"))


def segment_vote(seq: DataFrame) -> DataFrame:
    """EVAL9: each segment's act: the one of its acts that was seen most often in the fold up to its end; ties by name."""
    seen = running(segments(seq), ["fold", "act"], {"seen": "1"})
    last = seen.groupBy("fold", "segment", "act").agg(F.max("seen").alias("seen"))
    best = F.min_by("act", F.struct(-F.col("seen"), "act"))
    return last.groupBy("fold", "segment").agg(best.alias("vote"))


def majority(seq: DataFrame) -> DataFrame:
    """AGG10: the most frequent act of each fold; ties by name."""
    return seq.sparkSession.sql("SELECT fold, act FROM (SELECT fold, act, row_number() OVER (PARTITION BY fold ORDER BY count(*) DESC, act) AS n FROM {s} GROUP BY fold, act) WHERE n = 1", s=seq)


def next_labels(seq: DataFrame) -> DataFrame:
    """WIN6, FLT11: the label of the next position, T after the last; read before acts ``none`` are dropped."""
    after = seq.select("fold", (F.col("pos") - 1).alias("pos"), F.col("gold").alias("next_label"))
    return seq.where("act <> 'none'").select("fold", "pos", "act").join(after, ["fold", "pos"], "left").select("fold", "pos", "act", F.coalesce("next_label", F.lit("T")).alias("next_label"))


def bieo(rows: DataFrame) -> DataFrame:
    """WIN1: tags of aligned rows (``couple``, ``pos``, ``aligned``): B, I, E, BE by the neighbours, O if not aligned."""
    return rows.sparkSession.sql(
        """
        SELECT couple, pos, CASE WHEN NOT aligned THEN 'O' WHEN NOT p AND NOT n THEN 'BE' WHEN NOT p THEN 'B' WHEN NOT n THEN 'E' ELSE 'I' END AS tag
        FROM (SELECT *, lag(aligned, 1, false) OVER w AS p, lead(aligned, 1, false) OVER w AS n FROM {r} WINDOW w AS (PARTITION BY couple ORDER BY pos))
        """,
        r=rows,
    )


def pattern_columns(window: int = 5, syntactic: bool = True, groups: int = 24, lexical: int = 0, thematic: bool = False) -> list[tuple[str, list[tuple[int, int]]]]:
    """CRF1: feature templates ``(id, [(offset, column), ...])``; column numbers don't move when a set is off.

    The hinge columns are 0-17 (six tokens of form, lemma, tag), then 24 stylistic, then the n-grams, then one thematic.
    """
    start = -(window // 2)
    out, n = [], 0

    def add(cells):
        nonlocal n
        out.append((f"{n:05d}", cells))
        n += 1

    for off in range(start, start + window):
        if syntactic:
            for group in (0, 9):
                for form in range(3):
                    b = group + form
                    for cols in ((b,), (b + 3,), (b + 6,), (b, b + 3), (b + 3, b + 6), (b, b + 3, b + 6)):
                        add([(off, c) for c in cols])
        for c in [*range(18, 18 + groups), *range(42, 42 + lexical), *([42 + lexical] if thematic else [])]:
            add([(off, c)])
    return out


def pattern_lines(patterns) -> list[str]:
    """SNK9: the templates as text."""
    return [f"*{i}:" + "/".join(f"%x[{o},{c}]" for o, c in cells) for i, cells in patterns]


def window_features(rows: DataFrame, patterns, columns: list[str]) -> DataFrame:
    """WIN8, CRF1: each template's value for each row, ``fold``, ``pos``, ``features``; cells outside the sequence are ``_x``."""
    def cell(o, c):
        if o == 0:
            return F.col(columns[c])
        f = F.lag if o < 0 else F.lead
        return f(F.col(columns[c]), abs(o), "_x").over(W.partitionBy("fold").orderBy("pos"))

    return rows.select("fold", "pos", F.array(*[F.concat_ws("/", F.lit(i), *[cell(o, c) for o, c in cells]) for i, cells in patterns]).alias("features"))
