"""Queries of the fold-wise evaluation and of the full feature tables, and their SQL."""

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from threadloom.operators import evaluate as E
from threadloom.operators import folds as K
from threadloom.operators import learn as L
from threadloom.operators import segments as S
from threadloom.operators import tagged as T
from threadloom.plans import segments as PS
from threadloom.plans import tagged as PT
from threadloom.sinks import exports as X
from threadloom.sources.scratch import new_path, save
from threadloom.sources.tables import table

FOLDS = 10


def _records(s, d):
    return T.records(PT._lines(s, d))


def _of_fold(s, d):
    return K.k_folds(PT._lines(s, d).select("filename").distinct(), "filename", FOLDS)


def _systems(s, d):
    marked = save(PS._marked(s, d), "marked")  # read by all that follows
    return E.systems(save(S.sequences(marked), "labels"), marked, table(s, d, "corpus_sentences"))


def _smart(s, d):
    seq = save(PS._seq(s, d), "labels")
    return E.smart_combined(seq, E.trained_baseline(seq), seq)


def _grams(s, d):
    return T.ngram_rows(PT._lines(s, d))


def _voted(s, d):
    """Each sentence with its act, the act of the last annotation as a line's guess, and the vote of its segment."""
    seq = PS._seq(s, d).where("act <> 'none'")
    acts = PS._marked(s, d)
    rows = acts.sparkSession.sql(
        "SELECT thread AS fold, CAST(row_number() OVER (PARTITION BY thread ORDER BY doc_no, sent_no, sid) - 1 AS INT) AS pos, act, last_act, CASE WHEN changed THEN 'T' ELSE 'F' END AS gold FROM {m}", m=acts
    )
    guess = rows.select("fold", "pos", F.col("last_act").alias("act"), "gold")
    votes = S.segments(guess).join(S.segment_vote(guess), ["fold", "segment"]).select("fold", "pos", "vote")
    return rows.join(votes, ["fold", "pos"]).join(seq.select("fold", "pos"), ["fold", "pos"]).select("act", F.col("last_act").alias("by_line"), F.col("vote").alias("by_segment"))


def all_columns(s, d):
    """Every column of the feature table: 18 hinge columns, 24 of style (numbers as tiers), one of topic; and the label."""
    r = _records(s, d)
    f = T.line_features(r)
    tiers = T.discretised(f)
    verbs = r.select("filename", "line_number", L.first_verb_form(L.tag_words(F.col("tokens"))).alias("first_verb_form"))
    key = ["filename", "line_number"]
    flags = f.select(*key, *PT.ALL_FLAGS, "first_personal_pronoun", "label")
    topic = T.texttiling_labels(r, PT._tt(r))
    return T.hinge_columns(T.frequent_tokens(PT._lines(s, d))).join(tiers, key).join(flags, key).join(verbs, key).join(topic, key)


COLUMNS = [*T.HINGES, *T.NUMERIC, *PT.ALL_FLAGS, "first_personal_pronoun", "first_verb_form", "text_tiling_boundary"]


def _files(s, d):
    f = all_columns(s, d).join(K.holdout(PT._lines(s, d).select("filename").distinct(), "filename"), "filename")
    return X.sequence_files(f, _records(s, d), COLUMNS)


#: The templates over all columns of the feature table; the n-grams are many and mostly absent, so those of a line are features of their own.
PATTERNS = S.pattern_columns(thematic=True)


def _windows(s, d):
    rows = all_columns(s, d).select(F.col("filename").alias("fold"), F.col("line_number").alias("pos"), "label", *[F.col(c).cast("string").alias(c) for c in COLUMNS])
    return S.window_features(rows, PATTERNS, COLUMNS)


def crf_rows(s, d):
    """``fold``, ``sequence``, ``pos``, ``ids``, ``gold`` of every line: window features of all columns and of the n-grams around it."""
    r = _records(s, d)
    hits = T.ngram_hits(r, [x.ngram for x in sorted(T.top_ngrams(PT._lines(s, d)).collect(), key=lambda x: x.rank)])
    w = W.partitionBy("filename").orderBy("line_number")
    around = [F.transform(F.split(F.coalesce(F.lag("ngrams", -o).over(w) if o else F.col("ngrams"), F.lit("")), r"\|"), lambda g, o=o: F.concat(F.lit(f"g{o}/"), g)) for o in range(-2, 3)]
    grams = hits.select("filename", "line_number", F.concat(*around).alias("grams"))
    rows = _windows(s, d).withColumnsRenamed({"fold": "filename", "pos": "line_number"}).join(grams, ["filename", "line_number"]).join(r.select("filename", "line_number", "label"), ["filename", "line_number"]).join(_of_fold(s, d), "filename")
    return rows.select("fold", F.col("filename").alias("sequence"), F.col("line_number").alias("pos"), L.hashed(F.concat("features", "grams")).alias("ids"), F.col("label").alias("gold"))


def _crf(s, d):
    rows = save(crf_rows(s, d), "crf")
    return L.label_crf_folds(rows, L.train_crf_folds(rows, FOLDS))


def _fold_files(s, d):
    """STR13: the test lines of each fold in a folder of its own, read back by folder."""
    path = new_path(s, "folds")
    r = _records(s, d).join(_of_fold(s, d), "filename")
    X.write_lines(r.select("fold", "filename", "line_number", F.concat_ws("\t", "filename", F.col("line_number").cast("string"), "label").alias("line")), path, "fold", ["filename", "line_number"])
    return s.read.text(path).select(F.col("fold").cast("int").alias("fold"), F.col("value").alias("line"))


def _split_variants(s, d):
    files = PT._lines(s, d).select("filename").distinct()
    test = [r.filename for r in files.orderBy("filename").limit(5).collect()]
    out = None
    for name, df in (("ten", K.split(files, "filename")), ("one", K.split(files, "filename", 1)), ("none", K.split(files, "filename", 0)), ("fixed", K.split(files, "filename", test=test))):
        df = df.select(F.lit(name).alias("variant"), "fold", "filename", "part")
        out = df if out is None else out.unionByName(df)
    return out


QUERIES = {
    "texttiling_labels": lambda s, d: E.cohesion_labels(PS._marked(s, d), table(s, d, "corpus_sentences")),
    "training_counts": lambda s, d: E.training(PS._seq(s, d)),
    "trained_baseline": lambda s, d: E.trained_baseline(PS._seq(s, d)),
    "combine_smart": _smart,
    "label_scores": lambda s, d: E.split_scores(E.scored_labels(PS._seq(s, d))),
    "system_scores": lambda s, d: E.score_table(_systems(s, d)),
    "average_scores": lambda s, d: E.averaged(E.score_table(_systems(s, d))),
    "score_lines": lambda s, d: E.score_lines(E.averaged(E.score_table(_systems(s, d)))),
    "line_and_segment_scores": lambda s, d: E.multiclass(_voted(s, d), "act", "by_line", "by_segment"),
    "fold_averages": lambda s, d: E.train_averages(T.line_features(_records(s, d)), _of_fold(s, d), T.NUMERIC).select("fold", *[F.round(k, 6).alias(k) for k in T.NUMERIC]),
    "fold_tiers": lambda s, d: E.tiers(T.line_features(_records(s, d)), E.train_averages(T.line_features(_records(s, d)), _of_fold(s, d), T.NUMERIC), _of_fold(s, d), T.NUMERIC, T.tier),
    "fold_tokens": lambda s, d: E.train_tokens(_records(s, d), _of_fold(s, d), FOLDS),
    "fold_ngrams": lambda s, d: E.train_ngrams(_grams(s, d), _of_fold(s, d), FOLDS),
    "hinge_columns": lambda s, d: T.hinge_columns(T.frequent_tokens(PT._lines(s, d))),
    "feature_table": all_columns,
    "sequence_files": _files,
    "arff_all": lambda s, d: X.arff_rows(T.line_features(_records(s, d))),
    "window_features": lambda s, d: _windows(s, d).select("fold", "pos", F.array_join("features", " ").alias("features")),
    "crf_labels": _crf,
    "crf_scores": lambda s, d: S.agreement(_crf(s, d).select(F.col("fold").cast("string").alias("fold"), "pos", "gold", "result")),
    "fold_files": _fold_files,
    "split_variants": _split_variants,
    "limited_files": lambda s, d: T.limited_files(table(s, d, "tagged_files"), 50).select("filename", F.lit("selected").alias("how")).unionByName(T.limited_files(table(s, d, "tagged_files"), 50, False).select("filename", F.lit("listed").alias("how"))),
    "label_limit": lambda s, d: T.labelled_sequence(PT._lines(s, d), limit=10),
}

_W = "row_number() OVER (PARTITION BY thread ORDER BY doc_no, sent_no, sid) - 1"
_TT = f"""x AS (SELECT thread, sid, min(text) AS text FROM corpus_sentences GROUP BY thread, sid),
tt AS (SELECT thread AS fold, ({_W})::INT AS pos, CASE WHEN list_has_any(words, lag(words) OVER (PARTITION BY thread ORDER BY doc_no, sent_no, sid)) THEN 'F' ELSE 'T' END AS texttiling
       FROM (SELECT m.*, regexp_extract_all(lower(coalesce(text, '')), '[a-z]{{4,}}') AS words FROM m LEFT JOIN x USING (thread, sid)))"""
_TRAIN = "tr AS (SELECT fold, n, (sum(n) OVER () - n)::BIGINT AS n_train, (sum(t) OVER () - t)::BIGINT AS t_train FROM n)"
_TB = "tb AS (SELECT fold, pos, CASE WHEN pos % period = 0 THEN 'T' ELSE 'F' END AS baseline FROM q JOIN (SELECT fold, greatest(ceil(n_train::DOUBLE / (t_train + 1))::INT, 1) AS period FROM tr) USING (fold))"
_SYS = f"""{PS._A.replace("q AS (SELECT thread", "q0 AS (SELECT thread")}, n0 AS (SELECT fold, count(*) AS n, count(*) FILTER (WHERE gold = 'T') AS t FROM q0 GROUP BY fold), {_TT},
{_TRAIN.replace("FROM n)", "FROM n0)")}, {_TB.replace("FROM q JOIN", "FROM q0 JOIN")},
q AS (SELECT unnest(['result', 'baseline', 'texttiling']) || chr(9) || fold AS fold, pos, gold, unnest([result, baseline, texttiling]) AS result FROM q0 JOIN tb USING (fold, pos) JOIN tt USING (fold, pos)),
n AS (SELECT fold, count(*) AS n, count(*) FILTER (WHERE gold = 'T') AS t FROM q GROUP BY fold)"""
GHD_SQL = PS.GHD_SQL
_TABLE = f"""{GHD_SQL}, w AS (SELECT n.fold, accuracy, precision, recall, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) END AS f1, wd.v AS windowdiff, pk.v AS pk, gd.v AS ghd, ratio AS segment_ratio,
  (SELECT count(*) FROM q WHERE q.fold = n.fold AND result = 'T')::DOUBLE AS boundaries, t::DOUBLE AS gold
  FROM n LEFT JOIN ({PS._WD}) wd USING (fold) LEFT JOIN ({PS._PK}) pk USING (fold) LEFT JOIN gd USING (fold) LEFT JOIN ({PS._AG}) ag USING (fold)),
l AS (SELECT split_part(fold, chr(9), 1) AS system, split_part(fold, chr(9), 2) AS fold, gold, unnest(['accuracy', 'precision', 'recall', 'f1', 'windowdiff', 'pk', 'ghd', 'segment_ratio', 'boundaries']) AS metric,
      unnest([accuracy, precision, recall, f1, windowdiff, pk, ghd, segment_ratio, boundaries]) AS value FROM w),
st AS (SELECT fold, metric, round(max(value) FILTER (WHERE system = 'result'), 6) AS result, round(max(value) FILTER (WHERE system = 'baseline'), 6) AS baseline, round(max(value) FILTER (WHERE system = 'texttiling'), 6) AS texttiling,
       max(gold) FILTER (WHERE metric = 'boundaries') AS gold FROM l GROUP BY fold, metric),
av AS (SELECT metric, round(avg(result), 6) AS result, round(avg(baseline), 6) AS baseline, round(avg(texttiling), 6) AS texttiling, round(avg(gold), 6) AS gold FROM st GROUP BY metric)"""
_REC = f"WITH RECURSIVE {_SYS}, {_TABLE}"
_V = "coalesce(printf('%.2f', {0} * 100), '-')"
_D = "coalesce(printf('%.2f', (result - {0}) * 100), '-')"
_C = "coalesce(printf('%.0f', floor({0})), '-')"
_OF = "fo AS (SELECT filename, ((row_number() OVER (ORDER BY filename) - 1) % 10)::INT AS fold FROM (SELECT DISTINCT filename FROM tagged_lines))"
_FA = "ow AS (SELECT fold, " + ", ".join(f"coalesce(sum({k}), 0) AS s_{k}, count({k}) AS n_{k}" for k in T.NUMERIC) + " FROM f JOIN fo USING (filename) GROUP BY fold), fa AS (SELECT fold, " + ", ".join(f"CASE WHEN sum(n_{k}) OVER () - n_{k} > 0 THEN (sum(s_{k}) OVER () - s_{k}) / (sum(n_{k}) OVER () - n_{k}) END AS {k}" for k in T.NUMERIC) + " FROM ow)"
_FT = """own AS (SELECT fold, {0} AS k, count(*) AS n FROM {1} JOIN fo USING (filename) GROUP BY ALL),
tot AS (SELECT k, sum(n) AS n FROM own GROUP BY k), trn AS (SELECT f.fold, tot.k, (tot.n - coalesce(own.n, 0))::BIGINT AS n FROM tot CROSS JOIN (SELECT unnest(range(10))::INT AS fold) f LEFT JOIN own ON own.fold = f.fold AND own.k = tot.k)"""
_GRAM_ROWS = """gr AS (SELECT filename, unnest(list_concat(list_transform(generate_series(1, greatest(len(w) - 1, 1)), lambda i: array_to_string(w[i:i + 1], ' ')), list_transform(generate_series(1, greatest(len(w) - 2, 1)), lambda i: array_to_string(w[i:i + 2], ' ')))) AS ngram
      FROM (SELECT filename, list_transform(tokens, lambda t: lower(t)) AS w FROM r))"""


def tag_sql(x):
    """The rule tagger as a SQL expression."""
    low = f"lower({x})"
    closed = " ".join(f"WHEN {low} IN {PT._in(w.split())} THEN '{k}'" for k, w in L._CLOSED.items())
    ends = " ".join(f"WHEN ends_with({low}, '{e}') AND length({low}) > {len(e) + 2} THEN '{k}'" for e, k in L._ENDINGS)
    return f"CASE WHEN regexp_matches({low}, '^[0-9.]+$') THEN 'CD' WHEN NOT regexp_matches({low}, '\\p{{L}}') THEN '.' {closed} {ends} ELSE 'NN' END"


def lemma_sql(x):
    low = f"lower({x})"
    return f"CASE WHEN starts_with({tag_sql(x)}, 'V') THEN regexp_replace({low}, '(\\w{{3}})(?:ing|ed|es|s)$', '\\1') ELSE regexp_replace(regexp_replace({low}, '(\\w{{2}})ies$', '\\1y'), '(\\w{{2}}[^s])s$', '\\1') END"


_HINGE_CELLS = ", ".join(f"coalesce({f(f'k[{sign}{i}]')}, 'NULL.TOKEN') AS {end}_{kind}{i}" if kind == "" else f"CASE WHEN k[{sign}{i}] IS NULL THEN 'NULL.TOKEN' ELSE {f(f'k[{sign}{i}]')} END AS {end}_{kind}{i}" for end, sign in (("first", ""), ("last", "-")) for kind, f in (("", lambda x: x), ("lemma_", lemma_sql), ("tag_", tag_sql)) for i in (1, 2, 3))
_HI = f"""he AS (SELECT filename, line_number, unnest(tokens) AS t, generate_subscripts(tokens, 1) AS pos FROM r), hc AS (SELECT lower(t) AS token, count(*) AS n FROM he GROUP BY 1), ho AS (SELECT token FROM hc WHERE n > (SELECT sum(n) FROM hc) * 0.0005::DOUBLE),
hk AS (SELECT filename, line_number, string_agg(t, ' ' ORDER BY pos) AS kept FROM he WHERE lower(t) IN (SELECT token FROM ho) GROUP BY ALL),
hi AS (SELECT filename, line_number, {_HINGE_CELLS} FROM (SELECT r.filename, r.line_number, string_split(coalesce(kept, '@NULL'), ' ') AS k FROM r LEFT JOIN hk USING (filename, line_number)))"""
_VERB = f"coalesce(list_filter(list_transform(tokens, lambda t: {tag_sql('t')}), lambda g: g IN ('VB', 'VBD', 'VBG', 'VBN', 'VBP', 'VBZ'))[1], 'NO_VERB')"
_TIERS = "av8 AS (SELECT " + ", ".join(f"avg({k}) AS a_{k}" for k in T.NUMERIC) + " FROM f), ti AS (SELECT filename, line_number, " + ", ".join(f"CASE WHEN {k} IS NULL THEN NULL WHEN {k} > 1.5 * a_{k} THEN '{k}_highest' WHEN {k} < a_{k} THEN '{k}_low' ELSE '{k}_high' END AS {k}" for k in T.NUMERIC) + " FROM f CROSS JOIN av8)"
_FLAGS_SQL = f"fl AS (SELECT filename, line_number, label, {', '.join(f'{e} AS {k}' for k, e in PT.ALL_FLAGS.items())}, {PT._PRONOUN} AS first_personal_pronoun, {_VERB} AS first_verb_form, CASE WHEN line_number % 4 = 1 THEN 'S' ELSE 'O' END AS text_tiling_boundary FROM r)"
_ALL = f"{PT._F}, {_HI}, {_TIERS}, {_FLAGS_SQL}, al AS (SELECT * FROM hi JOIN ti USING (filename, line_number) JOIN fl USING (filename, line_number))"
_CELLS = " || chr(9) || ".join(f"replace(coalesce({c}::VARCHAR, '@NULL'), '#', '\\#')" for c in COLUMNS)
_PART = "pa AS (SELECT filename, CASE WHEN row_number() OVER (ORDER BY filename) - 1 < floor(count(*) OVER () * 0.9) THEN 'train' ELSE 'test' END AS part FROM (SELECT DISTINCT filename FROM tagged_lines))"
_INTS = ["number_of_tokens", "number_of_chars", "number_of_quote_symbols", "average_token_length"]
_ARFF = " || ',' || ".join([f"coalesce({k}::{'INT' if k in _INTS else 'DECIMAL(18,6)'}::VARCHAR, '?')" for k in T.NUMERIC] + [f"upper({k}::VARCHAR)" for k in PT.ARFF_FLAGS])


def _cell_sql(o, c):
    return f"{COLUMNS[c]}::VARCHAR" if o == 0 else f"{'lag' if o < 0 else 'lead'}({COLUMNS[c]}::VARCHAR, {abs(o)}, '_x') OVER w"


_WINDOWS = "concat_ws(' ', " + ", ".join(f"concat_ws('/', '{i}', {', '.join(_cell_sql(*x) for x in cells)})" for i, cells in PATTERNS) + ")"
SQL = {
    "arff_all": f"WITH {PT._F}, fl AS (SELECT filename, line_number, label, {', '.join(f'{e} AS {k}' for k, e in PT.ALL_FLAGS.items())} FROM r) SELECT filename, line_number, {_ARFF} || ',' || label AS line FROM f JOIN fl USING (filename, line_number)",
    "window_features": f"WITH {_ALL} SELECT filename AS fold, line_number AS pos, {_WINDOWS} AS features FROM al WINDOW w AS (PARTITION BY filename ORDER BY line_number)",
    "texttiling_labels": f"WITH {PS._A}, {_TT} SELECT * FROM tt",
    "training_counts": f"WITH {PS._N}, {_TRAIN} SELECT * FROM tr",
    "trained_baseline": f"WITH {PS._N}, {_TRAIN}, {_TB} SELECT * FROM tb",
    "combine_smart": f"""WITH {PS._N}, {_TRAIN}, {_TB}, j AS (SELECT fold, pos, CASE WHEN baseline = 'T' THEN 1 WHEN result = 'T' THEN confidence ELSE 0 END AS score FROM q JOIN tb USING (fold, pos)),
k AS (SELECT fold, pos, row_number() OVER (PARTITION BY fold ORDER BY score DESC, pos) AS rn FROM j WHERE score >= 0.75),
o AS (SELECT k.fold, k.pos FROM k JOIN tr USING (fold) WHERE rn <= floor(t_train * CASE WHEN n_train > 0 THEN n::DOUBLE / n_train ELSE 0 END))
SELECT fold, pos, CASE WHEN (fold, pos) IN (SELECT (fold, pos) FROM o) THEN 'T' ELSE 'F' END AS label FROM j""",
    "label_scores": f"WITH {PS._A}, c AS (SELECT fold, pos, result || '/' || printf('%.4f', confidence) AS c FROM q) SELECT fold, pos, split_part(c, '/', 1) AS label, split_part(c, '/', 2)::DOUBLE AS score FROM c",
    "system_scores": f"{_REC} SELECT * FROM st",
    "average_scores": f"{_REC} SELECT * FROM av",
    "score_lines": f"""{_REC} SELECT list_position(['windowdiff', 'pk', 'ghd', 'accuracy', 'precision', 'recall', 'f1', 'segment_ratio', 'boundaries'], metric)::INT AS at,
CASE WHEN metric = 'boundaries' THEN '# boundaries:' || chr(9) || {_C.format("result")} || chr(9) || {_C.format("baseline")} || chr(9) || {_C.format("texttiling")} || chr(9) || {_C.format("gold")}
ELSE '# ' || metric || ':' || chr(9) || {_V.format("result")} || chr(9) || {_V.format("baseline")} || chr(9) || {_D.format("baseline")} || chr(9) || {_V.format("texttiling")} || chr(9) || {_D.format("texttiling")} END AS line FROM av""",
    "line_and_segment_scores": f"""WITH {PS._A}, z AS (SELECT thread AS fold, ({_W})::INT AS pos, act, last_act, changed FROM m),
g AS (SELECT fold, pos, last_act, sum(changed::INT) OVER (PARTITION BY fold ORDER BY pos)::INT AS segment FROM z),
v AS (SELECT fold, segment, last_act, max(seen) AS seen FROM (SELECT *, count(*) OVER (PARTITION BY fold, last_act ORDER BY pos) AS seen FROM g) GROUP BY ALL),
u AS (SELECT fold, segment, last_act AS vote FROM v QUALIFY row_number() OVER (PARTITION BY fold, segment ORDER BY seen DESC, last_act) = 1),
p AS (SELECT unnest(['by_line', 'by_segment']) AS guess, act AS truth, unnest([z.last_act, vote]) AS label FROM z JOIN g USING (fold, pos) JOIN u USING (fold, segment) WHERE act <> 'none'),
k AS (SELECT guess, truth, count(*) AS n, count(*) FILTER (WHERE label = truth) AS b, (SELECT count(*) FROM p p2 WHERE p2.guess = p.guess AND p2.label = p.truth) AS h FROM p GROUP BY guess, truth),
x AS (SELECT guess, n, b::DOUBLE / n AS r, CASE WHEN h > 0 THEN b::DOUBLE / h ELSE 0 END AS p FROM k)
SELECT guess, round(sum(n * p) / sum(n), 6) AS precision, round(sum(n * r) / sum(n), 6) AS recall, round(sum(n * CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END) / sum(n), 6) AS f1 FROM x GROUP BY guess""",
    "fold_averages": f"WITH {PT._F}, {_OF}, {_FA} SELECT fold, {', '.join(f'round({k}, 6) AS {k}' for k in T.NUMERIC)} FROM fa",
    "fold_tiers": f"WITH {PT._F}, {_OF}, {_FA} SELECT fold, filename, line_number, " + ", ".join(f"CASE WHEN f.{k} IS NULL OR fa.{k} IS NULL THEN NULL WHEN f.{k} > 1.5 * fa.{k} THEN '{k}_highest' WHEN f.{k} < fa.{k} THEN '{k}_low' ELSE '{k}_high' END AS {k}" for k in T.NUMERIC) + " FROM f JOIN fo USING (filename) JOIN fa USING (fold)",
    "fold_tokens": f"WITH {PT._R}, {_OF}, tk AS (SELECT filename, lower(unnest(tokens)) AS token FROM r), {_FT.format('token', 'tk')} SELECT fold, k AS token, n FROM trn WHERE n > (SELECT sum(n) FROM trn t WHERE t.fold = trn.fold) * 0.0005::DOUBLE",
    "fold_ngrams": f"WITH {PT._R}, {_OF}, {_GRAM_ROWS}, gq AS (SELECT * FROM gr WHERE ngram LIKE '% %'), {_FT.format('ngram', 'gq')} SELECT fold, (row_number() OVER (PARTITION BY fold ORDER BY n DESC, k))::INT AS rank, k AS ngram FROM trn WHERE n > 0 QUALIFY rank <= 1000",
    "hinge_columns": f"WITH {PT._R}, {_HI} SELECT * FROM hi",
    "feature_table": f"WITH {_ALL} SELECT filename, line_number, label, {', '.join(COLUMNS)} FROM al",
    "sequence_files": f"""WITH {_ALL}, {_PART}, b AS (SELECT *, {_CELLS} AS cells FROM al JOIN pa USING (filename)),
o AS (SELECT 'train' AS file, filename, line_number, cells || chr(9) || label AS line FROM b WHERE part = 'train' UNION ALL SELECT 'test', filename, line_number, cells FROM b WHERE part = 'test'
      UNION ALL SELECT 'gold', filename, line_number, label FROM b WHERE part = 'test' UNION ALL SELECT 'origin', b.filename, b.line_number, r.line FROM b JOIN r USING (filename, line_number) WHERE part = 'test')
SELECT * FROM o UNION ALL SELECT file, filename, max(line_number) + 1, '' FROM o GROUP BY file, filename""",
    "fold_files": f"WITH {PT._R}, {_OF} SELECT fold, filename || chr(9) || line_number || chr(9) || label AS line FROM r JOIN fo USING (filename)",
    "split_variants": f"""WITH fi AS (SELECT filename, row_number() OVER (ORDER BY filename) - 1 AS i, count(*) OVER () AS n FROM (SELECT DISTINCT filename FROM tagged_lines))
SELECT 'ten' AS variant, f::INT AS fold, filename, CASE WHEN i % 10 = f THEN 'test' ELSE 'train' END AS part FROM fi CROSS JOIN range(10) t(f)
UNION ALL SELECT 'one', 0, filename, CASE WHEN i < floor(n * 0.9) THEN 'train' ELSE 'test' END FROM fi
UNION ALL SELECT 'fixed', 0, filename, CASE WHEN i < 5 THEN 'test' ELSE 'train' END FROM fi""",
    "limited_files": "SELECT filename, 'selected' AS how FROM (SELECT filename FROM tagged_files WHERE is_initial = 'true' AND encoding = 'UTF-8' AND mime = 'text/plain' ORDER BY filename LIMIT 50) UNION ALL SELECT filename, 'listed' FROM (SELECT * FROM tagged_files ORDER BY filename LIMIT 50) WHERE is_initial = 'true' AND encoding = 'UTF-8' AND mime = 'text/plain'",
    "label_limit": f"SELECT * FROM ({PT.SQL['labelled_sequence']}) WHERE pos < 10",
}
