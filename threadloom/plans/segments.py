"""Queries over annotated sentences and label sequences, and their SQL."""

from pyspark.sql import functions as F

from threadloom.operators import folds as K
from threadloom.operators import segments as S
from threadloom.sources.tables import table

_A = """s AS (SELECT thread, sid, min(doc_no) AS doc_no, min(sent_no) AS sent_no FROM corpus_sentences GROUP BY thread, sid),
a AS (SELECT thread, sid, arg_min(upper(trim(tag)), (ord, label_id)) AS act, arg_max(upper(trim(tag)), (ord, label_id)) AS last_act, avg((boundary = 'T')::INT::DOUBLE) AS confidence FROM bc3_labelled WHERE tag IS NOT NULL GROUP BY thread, sid),
acts AS (SELECT s.thread, s.doc_no, s.sent_no, s.sid, coalesce(act, 'none') AS act, coalesce(last_act, 'none') AS last_act, coalesce(confidence, 0) AS confidence FROM s LEFT JOIN a USING (thread, sid)),
m AS (SELECT *, lag(act) OVER w IS DISTINCT FROM act AS changed, lag(act) OVER w IS DISTINCT FROM act OR act IN ('Q-Q', 'O') AS guideline, lag(last_act) OVER w IS DISTINCT FROM last_act AS last_changed FROM acts WINDOW w AS (PARTITION BY thread, doc_no ORDER BY sent_no, sid)),
q AS (SELECT thread AS fold, (row_number() OVER (PARTITION BY thread ORDER BY doc_no, sent_no, sid) - 1)::INT AS pos, act, CASE WHEN changed THEN 'T' ELSE 'F' END AS gold, CASE WHEN last_changed THEN 'T' ELSE 'F' END AS result, confidence FROM m)"""
_N = f"{_A}, n AS (SELECT fold, count(*) AS n, count(*) FILTER (WHERE gold = 'T') AS t FROM q GROUP BY fold)"
_WD = """SELECT a.fold, sum(abs(dg - dr))::DOUBLE / max(n) AS v FROM (
  SELECT x.fold, n, x.pos, sum((y.gold = 'T')::INT) AS dg, sum((y.result = 'T')::INT) AS dr FROM (SELECT q.*, n, floor(n::DOUBLE / (t + 1) / 2)::INT AS k FROM q JOIN n USING (fold)) x
  JOIN q y ON x.fold = y.fold AND y.pos BETWEEN x.pos AND x.pos + k WHERE x.pos + k < n GROUP BY ALL) a GROUP BY a.fold"""
_PK = """SELECT fold, avg((sr AND NOT sg)::INT) * (1 - avg(sg::INT)) + avg((sg AND NOT sr)::INT) * avg(sg::INT) AS v FROM (
  SELECT x.fold, x.pos, coalesce(bool_and(y.gold <> 'T'), true) AS sg, coalesce(bool_and(y.result <> 'T'), true) AS sr FROM (SELECT q.*, n, greatest(round(n::DOUBLE / (2 * t))::INT, 1) AS k FROM q JOIN n USING (fold) WHERE t > 0) x
  LEFT JOIN q y ON x.fold = y.fold AND y.pos BETWEEN x.pos + 1 AND x.pos + k - 1 WHERE x.pos + k <= n GROUP BY x.fold, x.pos) GROUP BY fold"""
_AG = """SELECT fold, same::DOUBLE / n AS accuracy, CASE WHEN r > 0 THEN b::DOUBLE / r END AS precision, CASE WHEN g > 0 THEN b::DOUBLE / g END AS recall, CASE WHEN g > 0 THEN r::DOUBLE / g END AS ratio
FROM (SELECT fold, count(*) AS n, count(*) FILTER (WHERE gold = result) AS same, count(*) FILTER (WHERE gold = 'T') AS g, count(*) FILTER (WHERE result = 'T') AS r, count(*) FILTER (WHERE gold = 'T' AND result = 'T') AS b FROM q GROUP BY fold)"""
#: The edit distance of boundary lists, a cell a step: ``p`` is the row before, ``c`` the row so far.
GHD_SQL = """gl AS (SELECT fold, count(*) AS n, coalesce(list(pos ORDER BY pos) FILTER (WHERE result = 'T'), []) AS h, coalesce(list(pos ORDER BY pos) FILTER (WHERE gold = 'T'), []) AS r FROM q GROUP BY fold),
gw AS (SELECT fold, n, h, r, 0 AS i, list_transform(generate_series(0, len(r)), lambda j: j * 2.0::DOUBLE) AS p, []::DOUBLE[] AS c FROM gl
       UNION ALL
       SELECT fold, n, h, r, CASE WHEN len(c) = len(r) + 1 THEN i + 1 ELSE i END, CASE WHEN len(c) = len(r) + 1 THEN c ELSE p END,
              CASE WHEN len(c) = len(r) + 1 THEN [] WHEN len(c) = 0 THEN [(i + 1) * 2.0::DOUBLE]
                   ELSE list_append(c, least(p[len(c) + 1] + 2, c[len(c)] + 2, p[len(c)] + abs(h[i + 1] - r[len(c)]))) END
       FROM gw WHERE i < len(h)),
gd AS (SELECT fold, p[len(r) + 1] / n AS v FROM gw WHERE i = len(h) AND len(c) = 0)"""
_BASE = "b AS (SELECT fold, pos, CASE WHEN pos % period = 0 THEN 'T' ELSE 'F' END AS baseline FROM q JOIN (SELECT fold, ceil(n::DOUBLE / (t + 1))::INT AS period FROM n) USING (fold))"
_SEG = "g AS (SELECT fold, pos, act, sum((gold = 'T')::INT) OVER (PARTITION BY fold ORDER BY pos)::INT AS segment FROM q)"


def _acts(s, d):
    return S.annotated(table(s, d, "corpus_sentences"), table(s, d, "bc3_labelled"))


def _marked(s, d):
    return S.boundaries(_acts(s, d))


def _seq(s, d):
    return S.sequences(_marked(s, d))


def _files(s, d):
    return table(s, d, "tagged_files").select("filename").distinct()


def _tags(s, d):
    return _seq(s, d).select(F.col("fold").alias("couple"), "pos", (F.col("gold") == "F").alias("aligned"))


QUERIES = {
    "annotation_lookup": lambda s, d: _acts(s, d).withColumn("confidence", F.round("confidence", 6)),
    "boundary_on_change": lambda s, d: _marked(s, d).select("thread", "sid", "changed", "guideline"),
    "label_sequences": lambda s, d: _seq(s, d).withColumn("confidence", F.round("confidence", 6)),
    "windowdiff": lambda s, d: S.windowdiff(_seq(s, d)),
    "pk": lambda s, d: S.pk(_seq(s, d)),
    "ghd": lambda s, d: S.ghd(_seq(s, d)),
    "accuracy_prf": lambda s, d: S.agreement(_seq(s, d)),
    "score_table": lambda s, d: S.scores(_seq(s, d)),
    "periodic_baseline": lambda s, d: S.periodic_baseline(_seq(s, d)),
    "combine_results": lambda s, d: S.combined(_seq(s, d), S.periodic_baseline(_seq(s, d))),
    "segment_ids": lambda s, d: S.segments(_seq(s, d)),
    "segment_vote": lambda s, d: S.segment_vote(_seq(s, d)),
    "majority_act": lambda s, d: S.majority(_seq(s, d)),
    "next_labels": lambda s, d: S.next_labels(_seq(s, d)),
    "bieo_tags": lambda s, d: S.bieo(_tags(s, d)),
    "kfold_assign": lambda s, d: K.k_folds(_files(s, d), "filename"),
    "holdout_split": lambda s, d: K.holdout(_files(s, d), "filename"),
    "line_folds": lambda s, d: K.line_folds(table(s, d, "tagged_lines")),
}
SQL = {
    "annotation_lookup": f"WITH {_A} SELECT * REPLACE (round(confidence, 6) AS confidence) FROM acts",
    "boundary_on_change": f"WITH {_A} SELECT thread, sid, changed, guideline FROM m",
    "label_sequences": f"WITH {_A} SELECT * REPLACE (round(confidence, 6) AS confidence) FROM q",
    "windowdiff": f"WITH {_N} SELECT fold, round(v, 6) AS windowdiff FROM ({_WD})",
    "pk": f"WITH {_N} SELECT n.fold, round(v, 6) AS pk FROM n LEFT JOIN ({_PK}) p USING (fold)",
    "accuracy_prf": f"WITH {_A} SELECT fold, round(accuracy, 6) AS accuracy, round(precision, 6) AS precision, round(recall, 6) AS recall, round(CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) END, 6) AS f1, round(ratio, 6) AS segment_ratio FROM ({_AG})",
    "ghd": f"WITH RECURSIVE {_A}, {GHD_SQL} SELECT fold, round(v, 6) AS ghd FROM gd",
    "score_table": f"""WITH RECURSIVE {_N}, {GHD_SQL}, w AS (SELECT avg(round(wd.v, 6)) AS windowdiff, avg(round(pk.v, 6)) AS pk, avg(round(gd.v, 6)) AS ghd, avg(round(accuracy, 6)) AS accuracy, avg(round(precision, 6)) AS precision, avg(round(recall, 6)) AS recall,
avg(round(CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) END, 6)) AS f1, avg(round(ratio, 6)) AS segment_ratio FROM n LEFT JOIN ({_WD}) wd USING (fold) LEFT JOIN ({_PK}) pk USING (fold) LEFT JOIN gd USING (fold) LEFT JOIN ({_AG}) ag USING (fold))
SELECT unnest(['windowdiff', 'pk', 'ghd', 'accuracy', 'precision', 'recall', 'f1', 'segment_ratio']) AS metric, unnest([round(windowdiff, 6), round(pk, 6), round(ghd, 6), round(accuracy, 6), round(precision, 6), round(recall, 6), round(f1, 6), round(segment_ratio, 6)]) AS value FROM w""",
    "periodic_baseline": f"WITH {_N}, {_BASE} SELECT * FROM b",
    "combine_results": f"WITH {_N}, {_BASE} SELECT fold, pos, CASE WHEN baseline = 'T' OR result = 'T' AND confidence >= 0.75 THEN 'T' ELSE 'F' END AS label FROM q JOIN b USING (fold, pos)",
    "segment_ids": f"WITH {_A}, {_SEG} SELECT * FROM g",
    "segment_vote": f"WITH {_A}, {_SEG}, v AS (SELECT fold, segment, act, max(seen) AS seen FROM (SELECT *, count(*) OVER (PARTITION BY fold, act ORDER BY pos) AS seen FROM g) GROUP BY ALL) SELECT fold, segment, act AS vote FROM v QUALIFY row_number() OVER (PARTITION BY fold, segment ORDER BY seen DESC, act) = 1",
    "majority_act": f"WITH {_A} SELECT fold, act FROM (SELECT fold, act, count(*) AS n FROM q GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY fold ORDER BY n DESC, act) = 1",
    "next_labels": f"WITH {_A} SELECT fold, pos, act, next_label FROM (SELECT *, lead(gold, 1, 'T') OVER (PARTITION BY fold ORDER BY pos) AS next_label FROM q) WHERE act <> 'none'",
    "bieo_tags": f"WITH {_A}, r AS (SELECT fold AS couple, pos, gold = 'F' AS al FROM q) SELECT couple, pos, CASE WHEN NOT al THEN 'O' WHEN p AND n THEN 'I' WHEN p THEN 'E' WHEN n THEN 'B' ELSE 'BE' END AS tag FROM (SELECT *, lag(al, 1, false) OVER w AS p, lead(al, 1, false) OVER w AS n FROM r WINDOW w AS (PARTITION BY couple ORDER BY pos))",
    "kfold_assign": "SELECT filename, ((row_number() OVER (ORDER BY filename) - 1) % 10)::INT AS fold FROM (SELECT DISTINCT filename FROM tagged_files)",
    "holdout_split": "SELECT filename, CASE WHEN row_number() OVER (ORDER BY filename) - 1 < floor(count(*) OVER () * 0.9) THEN 'train' ELSE 'test' END AS part FROM (SELECT DISTINCT filename FROM tagged_files)",
    "line_folds": "SELECT DISTINCT filename, phys_no, ((phys_no - 1) % 10)::INT AS fold FROM tagged_lines",
}
