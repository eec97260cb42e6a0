"""Tagged message lines: selection, numbering, labels, statistics, line features and their discretisation.

Input ``lines``: ``filename``, ``phys_no``, ``raw`` (``TAG<white space>tokens``, ``#`` comments, blank lines);
``files``: the header data. Repeated rows count once; a null ``raw`` is a blank line. Nothing here leaves the JVM.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadloom.operators.learn import lemma, tag_words

# Words of the line features.
INTERROGATING_WORDS = ["who", "when", "where", "what", "which", "what", "how"]
INTERROGATING_STARTS = ["who", "when", "where", "what", "which", "what", "how", "is", "are", "am", "will", "do", "does", "have", "has"]
PERSONAL_PRONOUNS = ["i", "you", "he", "she", "we", "they"]
MODALS = ["may", "must", "musnshall", "shanwill", "might", "should", "would", "could"]
MODALS_FIXED = ["may", "must", "musn", "shall", "shan", "will", "might", "should", "would", "could"]
PLAN_PHRASES = ["i will", "i am going to", "we will", "we are going to", "i plan to", "we plan to"]
FIRST_PERSON = ["me", "us", "i", "we", "my", "mine", "myself", "ourselves"]
SECOND_PERSON = ["you", "your", "yours", "yourself", "yourselves"]
THIRD_PERSON = ["he", "she", "they", "his", "their", "hers", "him", "her", "them"]
PUNCTUATION = [".", ";", ":", "?", "!", ","]

#: The numeric features, averaged and discretised.
NUMERIC = ["position", "number_of_tokens", "number_of_chars", "number_of_quote_symbols", "average_token_length", "proportion_of_uppercase_chars", "proportion_of_alphabetic_chars", "proportion_of_numeric_chars"]


def _sql_list(words: list[str]) -> str:
    return ", ".join("'" + w.replace("'", "''") + "'" for w in words)


def distinct_lines(lines: DataFrame) -> DataFrame:
    return lines.select("filename", "phys_no", F.coalesce("raw", F.lit("")).alias("raw")).distinct()


def metadata_filter(files: DataFrame, only_initial: bool = True, only_utf8: bool = True, only_text_plain: bool = True) -> DataFrame:
    """FLT1, FLT2: files whose header data pass the case-sensitive predicates; a null field fails its predicate."""
    cond = F.lit(True)
    for on, col, want in ((only_initial, "is_initial", "true"), (only_utf8, "encoding", "UTF-8"), (only_text_plain, "mime", "text/plain")):
        if on:
            cond &= F.col(col).eqNullSafe(want)
    return files.where(cond)


def comment_counts(lines: DataFrame) -> DataFrame:
    """FLT4: lines per file that are comments by their first token and by their first character."""
    return distinct_lines(lines).groupBy("filename").agg(F.count_if(F.col("raw").rlike(r"^\s*#(\s|$)")).alias("by_token"), F.count_if(F.col("raw").startswith("#")).alias("by_character"))


def records(lines: DataFrame) -> DataFrame:
    """FLT4-5, PRJ1-3: one row per labelled line.

    ``line_number`` counts the non-comment lines, blanks included, from 1; ``total_lines`` the lines that don't start
    with ``#`` and have more than one character; ``label`` is T for the tags B and BE.
    """
    return lines.sparkSession.sql(
        r"""
        WITH t AS (SELECT filename, phys_no, raw, filter(split(raw, '\\s+'), x -> x <> '') AS words FROM {l}),
             n AS (SELECT filename, raw, words, row_number() OVER (PARTITION BY filename ORDER BY phys_no) AS line_number FROM t WHERE NOT coalesce(try_element_at(words, 1) = '#', false)),
             s AS (SELECT filename, count_if(NOT startswith(raw, '#') AND length(trim(raw)) > 1) AS total_lines FROM t GROUP BY filename)
        SELECT n.filename, CAST(line_number AS INT) AS line_number, CAST(total_lines AS INT) AS total_lines, raw AS line, words[0] AS tag,
               CASE WHEN words[0] IN ('B', 'BE') THEN 'T' ELSE 'F' END AS label, slice(words, 2, size(words) - 1) AS tokens
        FROM n JOIN s USING (filename) WHERE size(words) >= 2
        """,
        l=distinct_lines(lines),
    )


def length_outliers(lines: DataFrame) -> DataFrame:
    """FLT3: files that are no longer than mean plus population deviation; ``new``: rounded up, non-comment counts, ``old``: all lines."""
    return lines.sparkSession.sql(
        """
        WITH c AS (SELECT filename, count(*) AS physical, count_if(NOT startswith(raw, '#')) AS plain FROM {l} GROUP BY filename),
             s AS (SELECT struct(ceil(avg(plain) + stddev_pop(plain)) AS most_new, avg(physical) + stddev_pop(physical) AS most_old) AS most FROM c)
        SELECT filename, physical, physical <= (SELECT most FROM s).most_new AS kept_new, physical <= (SELECT most FROM s).most_old AS kept_old FROM c
        """,
        l=distinct_lines(lines),
    )


def thinned(lines: DataFrame) -> DataFrame:
    """FLT7: rows left after the interior of runs of three or more I is dropped.

    The previous tag is that of the row before with two or more tokens, the next tag that of the next physical line if it has as many.
    """
    return lines.sparkSession.sql(
        r"""
        WITH t AS (SELECT filename, phys_no, filter(split(raw, '\\s+'), x -> x <> '') AS w FROM {l} WHERE NOT startswith(raw, '#')),
             x AS (SELECT filename, phys_no, CASE WHEN size(w) > 1 THEN w[0] END AS tag,
                          lead(CASE WHEN size(w) > 1 THEN w[0] END) OVER (PARTITION BY filename ORDER BY phys_no) AS next_tag FROM t),
             p AS (SELECT *, lag(tag) OVER (PARTITION BY filename ORDER BY phys_no) AS previous_tag FROM x WHERE tag IS NOT NULL)
        SELECT filename, phys_no, tag FROM p WHERE NOT (tag = 'I' AND coalesce(previous_tag, '') = 'I' AND coalesce(next_tag, '') = 'I')
        """,
        l=distinct_lines(lines),
    )


def neighbours(lines: DataFrame) -> DataFrame:
    """WIN5: each record's tag with the tags before and after it in its file."""
    return lines.sparkSession.sql(
        "SELECT filename, line_number, tag, lag(tag) OVER w AS previous_tag, lead(tag) OVER w AS next_tag FROM {r} WINDOW w AS (PARTITION BY filename ORDER BY line_number)", r=records(lines)
    )


def token_counts(lines: DataFrame) -> DataFrame:
    """AGG1: occurrences of each token in lower case."""
    return records(lines).select(F.explode("tokens").alias("t")).groupBy(F.lower("t").alias("token")).agg(F.count(F.lit(1)).alias("n"))


def frequent_tokens(lines: DataFrame, quotient: float = 0.075 / 150) -> DataFrame:
    """FLT6: per record the tokens that occur more often than ``quotient`` times the number of all tokens, in order.

    The counts are joined by key, so a vocabulary of any size works; Spark broadcasts it while it is small.
    """
    return lines.sparkSession.sql(
        """
        WITH often AS (SELECT token FROM {c} WHERE n > (SELECT sum(n) FROM {c}) * CAST({q} AS DOUBLE)),
             e AS (SELECT filename, line_number, pos, t FROM {r} LATERAL VIEW posexplode(tokens) x AS pos, t),
             k AS (SELECT filename, line_number, array_sort(collect_list(struct(pos, t))) AS l FROM e JOIN often ON lower(e.t) = often.token GROUP BY filename, line_number)
        SELECT r.filename, r.line_number, coalesce(array_join(l.t, ' '), '@NULL') AS kept FROM {r} r LEFT JOIN k USING (filename, line_number)
        """,
        c=token_counts(lines),
        r=records(lines),
        q=quotient,
    )


def hinge_tokens(rows: DataFrame) -> DataFrame:
    """WIN11: the first and last three tokens, ``NULL.TOKEN`` where there is none."""
    pick = lambda i: F.coalesce(F.try_element_at("tokens", F.lit(i)), F.lit("NULL.TOKEN"))
    return rows.select("filename", "line_number", *[pick(i).alias(f"first_{i}") for i in (1, 2, 3)], *[pick(-i).alias(f"last_{i}") for i in (1, 2, 3)])


#: The hinge columns in the order the feature patterns count them: forms, lemmas and tags of the first three tokens, then of the last three.
HINGES = [f"{end}_{kind}{i}" for end in ("first", "last") for kind in ("", "lemma_", "tag_") for i in (1, 2, 3)]


def hinge_columns(kept: DataFrame) -> DataFrame:
    """FT25: the 18 hinge columns of rows ``filename line_number kept`` of :func:`frequent_tokens`; ``NULL.TOKEN`` where there is none."""
    tokens = F.split("kept", " ")
    rows = kept.select("filename", "line_number", F.transform(F.arrays_zip(tokens.alias("t"), tag_words(tokens).alias("g")), lambda x: F.struct(x["t"].alias("form"), lemma(x["t"], x["g"]).alias("lemma"), x["g"].alias("tag"))).alias("w"))
    pick = lambda i, f: F.coalesce(F.try_element_at("w", F.lit(i))[f], F.lit("NULL.TOKEN"))
    each = [pick(sign * i, f) for sign in (1, -1) for f in ("form", "lemma", "tag") for i in (1, 2, 3)]
    return rows.select("filename", "line_number", *[c.alias(n) for c, n in zip(each, HINGES)])


def limited_files(files: DataFrame, most: int, selected: bool = True) -> DataFrame:
    """FLT8, SRT3: the first ``most`` files by name, of those that :func:`metadata_filter` selects, or of all before it selects."""
    first = lambda df: df.orderBy("filename").limit(most)
    return first(metadata_filter(files)) if selected else metadata_filter(first(files))


def line_features(rows: DataFrame, unicode_text: bool = False, fix_modal: bool = False, exclude_label: bool = False) -> DataFrame:
    """FT1-FT17 and FT19-FT24 of each record, one expression a feature, so that unused ones are pruned.

    Lengths and character classes count bytes and ASCII unless ``unicode_text``; ``exclude_label`` takes the tag off the line first.
    """
    line = F.expr(r"regexp_replace(line, '^\\s*\\S+\\s', '')") if exclude_label else F.col("line")
    rows = rows.withColumn("line", line)
    size = "char_length(line)" if unicode_text else "octet_length(line)"
    classes = (r"\\p{Lu}", r"\\p{L}", r"\\p{Nd}") if unicode_text else ("[A-Z]", "[A-Za-z]", "[0-9]")
    share = lambda c: f"try_divide(CAST(regexp_count(line, '{c}') AS DOUBLE), {size})"
    token_size = "char_length(t)" if unicode_text else "octet_length(t)"
    low = "transform(tokens, t -> lower(t))"
    some = lambda words: f"arrays_overlap({low}, array({_sql_list(words)}))"
    within = lambda words: "lower(line) RLIKE '" + "|".join(words) + "'"
    numeric = {
        "position": "try_divide(CAST(line_number AS DOUBLE), total_lines)",
        "number_of_tokens": "size(tokens)",
        "number_of_chars": size,
        "number_of_quote_symbols": "regexp_count(line, '>')",
        "average_token_length": f"CAST(floor(try_divide(CAST(aggregate(tokens, 0, (s, t) -> s + {token_size}) AS DOUBLE), size(tokens))) AS INT)",
        "proportion_of_uppercase_chars": share(classes[0]),
        "proportion_of_alphabetic_chars": share(classes[1]),
        "proportion_of_numeric_chars": share(classes[2]),
    }
    flags = {f"{how}_{name}": f"{'contains' if how == 'has' else 'endswith'}({'line' if how == 'has' else 'rtrim(line)'}, '{c}')" for name, c in (("question_mark", "?"), ("colon", ":"), ("semicolon", ";")) for how in ("has", "ends_with")}
    # the index of the last punctuation token decides
    flags["has_early_punctuation"] = f"size(tokens) - coalesce(nullif(array_position(reverse(transform(tokens, t -> t IN ({_sql_list(PUNCTUATION)}))), true), 0), size(tokens) - 999) < 4"
    flags["has_interrogating_word"] = some(INTERROGATING_WORDS)
    flags["starts_with_interrogating_form"] = f"coalesce(lower(try_element_at(tokens, 1)) IN ({_sql_list(INTERROGATING_STARTS)}), false)"
    flags["contains_modal_word"] = within(MODALS_FIXED if fix_modal else MODALS)
    flags["contains_plan_phrase"] = within(PLAN_PHRASES)
    flags["contains_first_person_mark"] = within(FIRST_PERSON)
    flags["contains_second_person_mark"] = within(SECOND_PERSON)
    flags["contains_third_person_mark"] = within(THIRD_PERSON)
    words = {"first_personal_pronoun": f"upper(coalesce(try_element_at(filter({low}, t -> t IN ({_sql_list(PERSONAL_PRONOUNS)})), -1), 'NO_PERSONAL_PRONOUN'))"}
    return rows.select("filename", "line_number", "label", *[F.expr(e).alias(k) for k, e in (numeric | flags | words).items()])


def feature_averages(features: DataFrame) -> DataFrame:
    """AGG2: one row with the averages of the numeric features."""
    return features.agg(*[F.avg(k).alias(k) for k in NUMERIC])


def tier(value, average, fix_tiers: bool = False):
    """FT28: ``highest`` above 1.5 averages, ``low`` below one, else ``high``; ``lowest`` (below a half) is only reached with ``fix_tiers``."""
    out = F.when(value > 1.5 * average, "highest")
    if fix_tiers:
        out = out.when(value < average / 2, "lowest")
    return out.when(value < average, "low").when(value < average / 2, "lowest").otherwise("high")


def discretised(features: DataFrame, fix_tiers: bool = False) -> DataFrame:
    """FT28, JOIN11: the numeric features as tiers of the corpus average, a scalar subquery."""
    averages = feature_averages(features).select(F.struct(*NUMERIC).alias("a"))
    rows = features.sparkSession.sql("SELECT f.*, (SELECT a FROM {a}) AS _average FROM {f} f", a=averages, f=features)
    return rows.select("filename", "line_number", *[F.when(F.col(k).isNotNull(), F.concat(F.lit(k + "_"), tier(F.col(k), F.col(f"_average.{k}"), fix_tiers))).alias(k) for k in NUMERIC])


def ngram_rows(lines: DataFrame) -> DataFrame:
    """``filename``, ``ngram``: every lower-case sequence of two or three tokens of a line."""
    low = F.expr("transform(tokens, t -> lower(t))")
    grams = F.expr("explode(concat(transform(sequence(1, greatest(size(w) - 1, 1)), i -> array_join(slice(w, i, 2), ' ')), transform(sequence(1, greatest(size(w) - 2, 1)), i -> array_join(slice(w, i, 3), ' '))))")
    return records(lines).select("filename", low.alias("w")).select("filename", grams.alias("ngram")).where("ngram LIKE '% %'")


def top_ngrams(lines: DataFrame, k: int = 1000) -> DataFrame:
    """D13: ``rank``, ``ngram``: the ``k`` most frequent lower-case sequences of two or three tokens; ties by name. A top-k report."""
    grams = ngram_rows(lines).groupBy("ngram").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "ngram").limit(k)
    return grams.selectExpr("row_number() OVER (ORDER BY n DESC, ngram) AS rank", "ngram")


def ngram_hits(rows: DataFrame, ngrams: list[str]) -> DataFrame:
    """JOIN10, FT26: which n-grams a line contains, case-sensitively, as one array expression and not as a column for each."""
    hits = F.filter(F.array(*map(F.lit, ngrams)), lambda g: F.contains(F.col("line"), g)) if ngrams else F.array().cast("array<string>")
    return rows.select("filename", "line_number", F.size(hits).alias("hits"), F.array_join(hits, "|").alias("ngrams"))


def texttiling_labels(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """JOIN3, FT27: the label of the same line of the parallel file, ``O`` past its end."""
    return rows.join(labels.select("filename", "line_number", "tt_label"), ["filename", "line_number"], "left").select("filename", "line_number", F.coalesce("tt_label", F.lit("O")).alias("text_tiling_boundary"))


def labelled_sequence(lines: DataFrame, limit: int | None = None, old: bool = False) -> DataFrame:
    """SRC15: the label of each non-comment line, mapped (new ``O`` to F, ``S`` to T; old ``F`` and ``O`` to ``.``), positions from 0.

    ``limit`` keeps the first labels of each file.
    """
    out = lines.sparkSession.sql(
        r"""
        WITH t AS (SELECT filename, phys_no, filter(split(raw, '\\s+'), x -> x <> '') AS w FROM {l} WHERE NOT startswith(raw, '#'))
        SELECT filename, CAST(row_number() OVER (PARTITION BY filename ORDER BY phys_no) - 1 AS INT) AS pos, w[0] AS label FROM t WHERE size(w) > 1
        """,
        l=distinct_lines(lines),
    )
    label = F.when(F.col("label").isin("F", "O"), ".").when(F.col("label") == "S", "T") if old else F.when(F.col("label") == "O", "F").when(F.col("label") == "S", "T")
    out = out.withColumn("label", label.otherwise(F.col("label")))
    return out.where(F.col("pos") < limit) if limit else out
