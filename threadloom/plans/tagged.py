"""Queries over tagged lines, and their SQL."""

from pyspark.sql import functions as F

from threadloom.operators import tagged as T
from threadloom.sources.tables import table

_L = "l AS (SELECT DISTINCT filename, phys_no, coalesce(raw, '') AS raw FROM tagged_lines)"
_W = r"t AS (SELECT *, list_filter(regexp_split_to_array(raw, '\s+'), lambda x: x <> '') AS w FROM l)"
_R = rf"""{_L}, {_W},
n AS (SELECT filename, raw, w, row_number() OVER (PARTITION BY filename ORDER BY phys_no)::INT AS line_number FROM t WHERE NOT coalesce(w[1] = '#', false)),
s AS (SELECT filename, count(*) FILTER (WHERE NOT starts_with(raw, '#') AND length(trim(raw)) > 1)::INT AS total_lines FROM t GROUP BY filename),
r AS (SELECT n.filename, line_number, total_lines, raw AS line, w[1] AS tag, CASE WHEN w[1] IN ('B', 'BE') THEN 'T' ELSE 'F' END AS label, w[2:] AS tokens
      FROM n JOIN s USING (filename) WHERE len(w) >= 2)"""


def _in(words):
    return "(" + ", ".join("'" + w + "'" for w in words) + ")"


def _share(p):
    return f"CASE WHEN strlen(line) > 0 THEN len(regexp_extract_all(line, '{p}'))::DOUBLE / strlen(line) END"


def _within(words):
    return "regexp_matches(lower(line), '" + "|".join(words) + "')"


_NUM = {
    "position": "CASE WHEN total_lines > 0 THEN line_number::DOUBLE / total_lines END",
    "number_of_tokens": "len(tokens)::DOUBLE",
    "number_of_chars": "strlen(line)::DOUBLE",
    "number_of_quote_symbols": "len(regexp_extract_all(line, '>'))::DOUBLE",
    "average_token_length": "floor(list_sum(list_transform(tokens, lambda t: strlen(t)))::DOUBLE / len(tokens))",
    "proportion_of_uppercase_chars": _share("[A-Z]"),
    "proportion_of_alphabetic_chars": _share("[A-Za-z]"),
    "proportion_of_numeric_chars": _share("[0-9]"),
}
_FLAGS = {
    "has_question_mark": "contains(line, '?')",
    "ends_with_question_mark": r"regexp_matches(line, '\? *$')",
    "has_colon": "contains(line, ':')",
    "has_semicolon": "contains(line, ';')",
    "has_early_punctuation": f"coalesce(list_max(list_filter(list_transform(tokens, lambda t, i: CASE WHEN t IN {_in(T.PUNCTUATION)} THEN i - 1 END), lambda x: x IS NOT NULL)), 999) < 4",
    "has_interrogating_word": f"list_has_any(list_transform(tokens, lambda t: lower(t)), {list(T.INTERROGATING_WORDS)})",
    "starts_with_interrogating_form": f"lower(tokens[1]) IN {_in(T.INTERROGATING_STARTS)}",
    "contains_modal_word": _within(T.MODALS),
    "contains_plan_phrase": _within(T.PLAN_PHRASES),
    "contains_first_person_mark": _within(T.FIRST_PERSON),
    "contains_second_person_mark": _within(T.SECOND_PERSON),
    "contains_third_person_mark": _within(T.THIRD_PERSON),
}
#: All flags; those above are the ones of ``line_flags``' first form.
ALL_FLAGS = {k: e for name, e in _FLAGS.items() for k, e in ([(name, e)] + ([("ends_with_" + name[4:], rf"regexp_matches(line, '{dict(has_colon=':', has_semicolon=';')[name]} *$')")] if name in ("has_colon", "has_semicolon") else []))}
#: The flags in the order of the feature table.
ARFF_FLAGS = ["has_question_mark", "ends_with_question_mark", "has_colon", "ends_with_colon", "has_semicolon", "ends_with_semicolon", *[k for k in _FLAGS if not k.startswith(("has_question", "ends_with", "has_colon", "has_semicolon"))]]
_PRONOUN = f"upper(coalesce(list_filter(list_transform(tokens, lambda t: lower(t)), lambda t: t IN {_in(T.PERSONAL_PRONOUNS)})[-1], 'NO_PERSONAL_PRONOUN'))"
_F = _R + ",\nf AS (SELECT filename, line_number, " + ", ".join(f"{e} AS {k}" for k, e in _NUM.items()) + " FROM r)"


def _lines(spark, d):
    return table(spark, d, "tagged_lines")


def _features(spark, d):
    return T.line_features(T.records(_lines(spark, d)))


def _numeric(spark, d):
    return _features(spark, d).select("filename", "line_number", *[F.round(F.col(k).cast("double"), 6).alias(k) for k in T.NUMERIC])


def _averages(spark, d):
    return T.feature_averages(_features(spark, d)).select(*[F.round(k, 6).alias(k) for k in T.NUMERIC])


def _tt(rows):
    return rows.where("line_number % 4 = 1").select("filename", "line_number", F.lit("S").alias("tt_label"))


def _texttiling(spark, d):
    r = T.records(_lines(spark, d))
    return T.texttiling_labels(r, _tt(r))


def _ngram_hits(spark, d):
    grams = T.top_ngrams(_lines(spark, d)).collect()  # a list of fixed length that goes into one expression, as the reference's own list does
    return T.ngram_hits(T.records(_lines(spark, d)), [x.ngram for x in sorted(grams, key=lambda x: x.rank)])


QUERIES = {
    "metadata_filter": lambda s, d: T.metadata_filter(table(s, d, "tagged_files")),
    "comment_lines": lambda s, d: T.comment_counts(_lines(s, d)),
    "tagged_records": lambda s, d: T.records(_lines(s, d)).select("filename", "line_number", "total_lines", "tag", "label", F.size("tokens").alias("n_tokens")),
    "length_outliers": lambda s, d: T.length_outliers(_lines(s, d)),
    "irun_thinning": lambda s, d: T.thinned(_lines(s, d)),
    "neighbour_tags": lambda s, d: T.neighbours(_lines(s, d)),
    "token_counts": lambda s, d: T.token_counts(_lines(s, d)),
    "rare_token_filter": lambda s, d: T.frequent_tokens(_lines(s, d)),
    "hinge_tokens": lambda s, d: T.hinge_tokens(T.records(_lines(s, d))),
    "line_features": _numeric,
    "line_flags": lambda s, d: _features(s, d).select("filename", "line_number", "first_personal_pronoun", *ALL_FLAGS),
    "feature_averages": _averages,
    "discretised_lines": lambda s, d: T.discretised(_features(s, d)),
    "top_ngrams": lambda s, d: T.top_ngrams(_lines(s, d)),
    "ngram_hits": _ngram_hits,
    "texttiling_join": _texttiling,
    "labelled_sequence": lambda s, d: T.labelled_sequence(_lines(s, d)),
}
_GRAMS = (
    _R
    + """,
g AS (SELECT unnest(list_concat(list_transform(generate_series(1, greatest(len(w) - 1, 1)), lambda i: array_to_string(w[i:i + 1], ' ')), list_transform(generate_series(1, greatest(len(w) - 2, 1)), lambda i: array_to_string(w[i:i + 2], ' ')))) AS ngram
      FROM (SELECT list_transform(tokens, lambda t: lower(t)) AS w FROM r)),
top AS (SELECT ngram, count(*) AS n FROM g WHERE ngram LIKE '% %' GROUP BY ngram)"""
)
SQL = {
    "metadata_filter": "SELECT * FROM tagged_files WHERE is_initial = 'true' AND encoding = 'UTF-8' AND mime = 'text/plain'",
    "comment_lines": rf"WITH {_L} SELECT filename, count(*) FILTER (WHERE regexp_matches(raw, '^\s*#(\s|$)')) AS by_token, count(*) FILTER (WHERE starts_with(raw, '#')) AS by_character FROM l GROUP BY filename",
    "tagged_records": f"WITH {_R} SELECT filename, line_number, total_lines, tag, label, len(tokens)::INT AS n_tokens FROM r",
    "length_outliers": f"""WITH {_L}, c AS (SELECT filename, count(*) AS physical, count(*) FILTER (WHERE NOT starts_with(raw, '#')) AS plain FROM l GROUP BY filename),
s AS (SELECT ceil(avg(plain) + stddev_pop(plain)) AS a, avg(physical) + stddev_pop(physical) AS b FROM c)
SELECT filename, physical, physical <= a AS kept_new, physical <= b AS kept_old FROM c CROSS JOIN s""",
    "irun_thinning": f"""WITH {_L}, {_W},
x AS (SELECT filename, phys_no, CASE WHEN len(w) > 1 THEN w[1] END AS tag, lead(CASE WHEN len(w) > 1 THEN w[1] END) OVER (PARTITION BY filename ORDER BY phys_no) AS nt FROM t WHERE NOT starts_with(raw, '#')),
p AS (SELECT *, lag(tag) OVER (PARTITION BY filename ORDER BY phys_no) AS pt FROM x WHERE tag IS NOT NULL)
SELECT filename, phys_no, tag FROM p WHERE tag <> 'I' OR coalesce(pt, '') <> 'I' OR coalesce(nt, '') <> 'I'""",
    "neighbour_tags": f"WITH {_R} SELECT filename, line_number, tag, lag(tag) OVER v AS previous_tag, lead(tag) OVER v AS next_tag FROM r WINDOW v AS (PARTITION BY filename ORDER BY line_number)",
    "token_counts": f"WITH {_R} SELECT lower(t) AS token, count(*) AS n FROM (SELECT unnest(tokens) AS t FROM r) GROUP BY 1",
    "rare_token_filter": f"""WITH {_R}, e AS (SELECT filename, line_number, unnest(tokens) AS t, generate_subscripts(tokens, 1) AS pos FROM r),
c AS (SELECT lower(t) AS token, count(*) AS n FROM e GROUP BY 1), o AS (SELECT token FROM c WHERE n > (SELECT sum(n) FROM c) * 0.0005::DOUBLE),
k AS (SELECT filename, line_number, string_agg(t, ' ' ORDER BY pos) AS kept FROM e WHERE lower(t) IN (SELECT token FROM o) GROUP BY ALL)
SELECT r.filename, r.line_number, coalesce(kept, '@NULL') AS kept FROM r LEFT JOIN k USING (filename, line_number)""",
    "hinge_tokens": f"WITH {_R} SELECT filename, line_number, " + ", ".join(f"coalesce(tokens[{s}{i}], 'NULL.TOKEN') AS {n}_{i}" for n, s in (("first", ""), ("last", "-")) for i in (1, 2, 3)) + " FROM r",
    "line_features": f"WITH {_F} SELECT filename, line_number, " + ", ".join(f"round({k}, 6) AS {k}" for k in _NUM) + " FROM f",
    "line_flags": f"WITH {_R} SELECT filename, line_number, {_PRONOUN} AS first_personal_pronoun, " + ", ".join(f"{e} AS {k}" for k, e in ALL_FLAGS.items()) + " FROM r",
    "feature_averages": f"WITH {_F} SELECT " + ", ".join(f"round(avg({k}), 6) AS {k}" for k in _NUM) + " FROM f",
    "discretised_lines": f"WITH {_F}, a AS (SELECT " + ", ".join(f"avg({k}) AS a_{k}" for k in _NUM) + " FROM f) SELECT filename, line_number, "
    + ", ".join(f"CASE WHEN {k} IS NULL THEN NULL WHEN {k} > 1.5 * a_{k} THEN '{k}_highest' WHEN {k} < a_{k} THEN '{k}_low' ELSE '{k}_high' END AS {k}" for k in _NUM) + " FROM f CROSS JOIN a",
    "top_ngrams": f"WITH {_GRAMS} SELECT row_number() OVER (ORDER BY n DESC, ngram)::INT AS rank, ngram FROM top ORDER BY n DESC, ngram LIMIT 1000",
    "ngram_hits": f"""WITH {_GRAMS}, u AS (SELECT ngram, row_number() OVER (ORDER BY n DESC, ngram) AS k FROM top QUALIFY k <= 1000),
h AS (SELECT filename, line_number, string_agg(ngram, '|' ORDER BY k) AS ngrams, count(*)::INT AS hits FROM r JOIN u ON contains(line, ngram) GROUP BY ALL)
SELECT r.filename, r.line_number, coalesce(hits, 0) AS hits, coalesce(ngrams, '') AS ngrams FROM r LEFT JOIN h USING (filename, line_number)""",
    "texttiling_join": f"WITH {_R} SELECT filename, line_number, CASE WHEN line_number % 4 = 1 THEN 'S' ELSE 'O' END AS text_tiling_boundary FROM r",
    "labelled_sequence": f"""WITH {_L}, {_W} SELECT filename, (row_number() OVER (PARTITION BY filename ORDER BY phys_no) - 1)::INT AS pos,
CASE w[1] WHEN 'O' THEN 'F' WHEN 'S' THEN 'T' ELSE w[1] END AS label FROM t WHERE NOT starts_with(raw, '#') AND len(w) > 1""",
}
