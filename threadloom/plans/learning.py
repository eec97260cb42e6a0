"""Queries over aligned couples, mail sources, exports and learned labels, and their SQL."""

from pyspark.sql import functions as F

from threadloom.functions import text as X
from threadloom.operators import align as A
from threadloom.operators import folds as K
from threadloom.operators import graph as G
from threadloom.operators import learn as L
from threadloom.operators import segments as S
from threadloom.operators import tagged as T
from threadloom.plans import evaluation as PV
from threadloom.plans import graph as PG
from threadloom.plans import segments as PS
from threadloom.plans import tagged as PT
from threadloom.sinks import exports as E
from threadloom.sources import corpus, mail
from threadloom.sources.scratch import new_path, save
from threadloom.sources.tables import table


def _couples(s, d):
    m = table(s, d, "messages")
    g, text = G.Graph(m), m.select("seq", "text")
    c = g.couples().select("source_seq", "reply_seq")
    return c.join(text.select(F.col("seq").alias("source_seq"), F.col("text").alias("source_text")), "source_seq").join(text.select(F.col("seq").alias("reply_seq"), F.col("text").alias("reply_text")), "reply_seq")


def _mime(s, d):
    raw = F.concat_ws("", F.lit("Content-Type: "), F.coalesce("mime", F.lit("text/plain")), F.lit('; charset="'), F.coalesce("encoding", F.lit("us-ascii")), F.lit('"\nContent-Transfer-Encoding: quoted-printable\n\nbody'))
    return table(s, d, "tagged_files").select("filename", raw.alias("raw")).select("filename", *mail.mime_fields(F.col("raw")))


def _round_trip(s, d):
    """All messages with all their fields rendered, written as mailbox files, scanned and parsed; a text or in_reply_to that is null comes back empty."""
    path = new_path(s, "mbox")
    mail.render_mbox(table(s, d, "messages")).select(F.concat(F.lit("From sender\n"), "raw").alias("value")).write.text(path)
    raw = mail.scan_mbox(s, path + "/*.txt").select(F.regexp_extract("raw", r"\AX-Seq: (-?\d+)\n", 1).cast("bigint").alias("seq"), mail.unquoted(F.col("raw")).alias("raw"))
    return mail.parse_messages(raw)


def _write(df, s, name, by, order):
    path = new_path(s, name)
    E.write_lines(df, path, by, order)
    return path


def _tagged_files(s, d):
    """The tagged files written as text, a header of eight fields before the lines, and scanned again."""
    lines = T.distinct_lines(table(s, d, "tagged_lines")).where("phys_no IS NOT NULL AND raw NOT LIKE '#%'").select("filename", F.col("phys_no").cast("bigint").alias("at"), F.col("raw").alias("line"))
    names = lines.select("filename").distinct()
    heads = table(s, d, "tagged_files").dropDuplicates(["filename"]).join(names, "filename", "left_semi")
    field = lambda c: F.coalesce(F.regexp_replace(c, r"[\t\r\n]", " "), F.lit("null"))
    head = heads.select("filename", F.lit(-1).cast("bigint").alias("at"), F.concat(F.lit("# "), F.concat_ws("\t", *map(field, corpus.HEADER[1:]))).alias("line"))
    return corpus.scan_tagged(s, _write(lines.unionByName(head).where("NOT contains(line, '\r')"), s, "tagged", "filename", ["at"]))


def _labels_scanned(s, d):
    """JOIN3 over a folder of label files that is written from the rule of ``texttiling_join`` and scanned."""
    r = T.records(PT._lines(s, d))
    top = r.groupBy("filename").agg(F.max("line_number").alias("n"))
    every = top.select("filename", F.explode(F.sequence(F.lit(1), "n")).alias("at")).select("filename", "at", F.when(F.col("at") % 4 == 1, "S").otherwise("O").alias("line"))
    labels = corpus.scan_labels(s, _write(every, s, "labels", "filename", ["at"]))
    return T.texttiling_labels(r, labels)


def _labelled(s, d):
    """Annotated sentences written as ``label tag tokens`` and scanned."""
    path = new_path(s, "labelled")
    E.gold_text(PS._marked(s, d), table(s, d, "corpus_sentences")).select(F.regexp_replace("line", r"[\r\n]", " ")).write.text(path)
    return corpus.scan_labelled(s, path).groupBy("label", "tag").agg(F.count(F.lit(1)).alias("lines"), F.sum(F.size("tokens")).alias("tokens"))


def _ngram_list(s, d):
    """The n-grams written one a line, in order, and scanned; the list has 1000 lines at most, one file."""
    path = new_path(s, "ngrams")
    T.top_ngrams(PT._lines(s, d)).orderBy("rank").coalesce(1).select("ngram").write.text(path)
    return corpus.scan_words(s, path)


def _corpus_xml(s, d):
    """The sentences written as corpus XML, a thread an element, and scanned with ids as strings."""
    x = table(s, d, "corpus_sentences").where("thread IS NOT NULL AND sid IS NOT NULL").groupBy("thread", "sid").agg(F.min("doc_no").alias("doc_no"), F.min("sent_no").alias("sent_no"), F.min("text").alias("text"))
    esc = lambda c: F.replace(F.replace(F.replace(F.coalesce(c, F.lit("")), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    sent = F.concat(F.lit('<Sent id="'), esc(F.col("sid")), F.lit('">'), esc(F.regexp_replace("text", r"[\r\n\x00-\x08\x0b\x0c\x0e-\x1f]", " ")), F.lit("</Sent>"))
    docs = x.select("thread", "doc_no", "sent_no", "sid", sent.alias("e")).groupBy("thread", "doc_no").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("sent_no", "sid", "e"))), lambda y: y["e"]), "").alias("e"))
    threads = docs.groupBy("thread").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("doc_no", "e"))), lambda y: F.concat(F.lit("<DOC><Text>"), y["e"], F.lit("</Text></DOC>"))), "").alias("e"))
    files = threads.select(F.col("thread").alias("part"), F.lit(0).alias("at"), F.concat(F.lit("<root><thread><listno>"), esc(F.col("thread")), F.lit("</listno>"), "e", F.lit("</thread></root>")).alias("line"))
    path = _write(files, s, "xml", "part", ["at"])
    return corpus.scan_sentences(s, path).select("thread", "sid", "doc_no", F.coalesce("text", F.lit("")).alias("text"))


def _annotation_xml(s, d):
    """The acts written as annotation XML, the act being the element's name, and scanned."""
    acts = PS._acts(s, d).where("act <> 'none'").select("thread", "doc_no", "sent_no", "sid", F.lower(F.regexp_replace("act", "[^A-Za-z]", "")).alias("act")).where("act <> ''")
    each = F.transform(F.array_sort(F.collect_list(F.struct("doc_no", "sent_no", "sid", "act"))), lambda x: F.concat(F.lit("<"), x["act"], F.lit(' id="'), x["sid"], F.lit('"/>')))
    files = acts.groupBy("thread").agg(F.array_join(each, "").alias("e")).select("thread", F.lit(0).alias("at"), F.concat(F.lit("<root><thread><listno>"), "thread", F.lit("</listno><annotation><labels>"), "e", F.lit("</labels></annotation></thread></root>")).alias("line"))
    return corpus.scan_annotations(s, _write(files, s, "annotations", "thread", ["at"]))


def _reloaded(s, d):
    m, path = table(s, d, "messages"), new_path(s, "graph")
    G.Graph(m).save(path)
    return G.Graph.load(m, path)


def _saved_messages(s, d):
    path = new_path(s, "messages")
    E.write_messages(table(s, d, "messages"), path)
    return s.read.parquet(path).select("seq", "message_id", "subject", "text")


def _parts(s, d):
    """MIM4-8: bodies of four makes, by sequence number, as :func:`mail.render_mbox` writes them; the text that is found."""
    raw = mail.render_mbox(table(s, d, "messages"))
    return mail.parse_messages(raw.select("seq", mail.unquoted(F.col("raw")).alias("raw"))).select("seq", "text")


def _features(s, d):
    return PT._features(s, d)


def _bayes(s, d):
    """Fitted on the sentences of the first four fifths of the threads, applied to those of the rest."""
    rows = table(s, d, "corpus_sentences").where("text IS NOT NULL").groupBy("thread", "sid").agg(F.min("text").alias("text")).join(PS._acts(s, d).select("thread", "sid", "act").where("act <> 'none'"), ["thread", "sid"]).withColumn("tokens", X.words(F.lower("text")))
    rows = save(rows.join(K.holdout(rows.select("thread").distinct(), "thread", 0.8), "thread"), "bayes")
    fitted = L.naive_bayes(rows.where("part = 'train'"), "tokens", "act")
    return L.predicted(fitted, rows.where("part = 'test'")).select("thread", "sid", "act", "prediction")


def _bags(s, d):
    r = T.records(PT._lines(s, d)).withColumn("low", F.transform("tokens", F.lower))
    return r.select("filename", "line_number", F.array_join(F.transform(F.map_entries(L.merged(L.bag(F.col("low")), L.bag(F.slice("low", 1, 1)))), lambda e: F.concat_ws(":", e["key"], e["value"].cast("string"))), " ").alias("bag"))


QUERIES = {
    "couple_alignment": lambda s, d: A.couple_lines(_couples(s, d)),
    "couple_documents": lambda s, d: A.couple_documents(_couples(s, d)).select("source_seq", F.length("document").alias("size"), "source_end", "document_end"),
    "tagged_text": lambda s, d: E.tagged_text(A.couple_lines(_couples(s, d)), G.Graph(table(s, d, "messages")).couples().select("source_seq", "source_file")),
    "mime_fields": _mime,
    "mbox_round_trip": lambda s, d: _round_trip(s, d).drop("date"),
    "mbox_dates": lambda s, d: _round_trip(s, d).select("seq", "date"),
    "mime_bodies": _parts,
    "tagged_file_lines": lambda s, d: _tagged_files(s, d)[0].where("raw NOT LIKE '#%'").select("filename", "raw"),
    "tagged_file_heads": lambda s, d: _tagged_files(s, d)[1],
    "texttiling_scan": _labels_scanned,
    "labelled_corpus": _labelled,
    "ngram_list": _ngram_list,
    "corpus_xml": _corpus_xml,
    "annotation_xml": _annotation_xml,
    "graph_reloaded": lambda s, d: _reloaded(s, d).edges,
    "messages_saved": _saved_messages,
    "run_counts": lambda s, d: G.Graph(table(s, d, "messages")).run_counts(),
    "word_sign_tokens": lambda s, d: table(s, d, "corpus_sentences").where("text IS NOT NULL").select("thread", "sid", F.array_join(X.words_and_signs(F.col("text")), " ").alias("tokens")).distinct(),
    "break_tokens": lambda s, d: table(s, d, "messages").where("text IS NOT NULL").select("seq", F.array_join(X.tokens_with_breaks(F.col("text")), " ").alias("tokens")),
    "sequence_tsv": lambda s, d: E.sequence_tsv(_features(s, d), ["number_of_tokens", "number_of_quote_symbols", "has_colon"]),
    "arff_rows": lambda s, d: E.arff_rows(_features(s, d).select("filename", "line_number", "number_of_tokens", "has_colon", "has_question_mark", "label")),
    "gold_text": lambda s, d: E.gold_text(PS._marked(s, d), table(s, d, "corpus_sentences")),
    "score_text": lambda s, d: E.score_text(S.scores(PS._seq(s, d))),
    "strip_html": lambda s, d: E.strip_html(PS._seq(s, d)),
    "graph_report": lambda s, d: E.graph_report(G.Graph(table(s, d, "messages"))),
    "pattern_lines": lambda s, d: s.createDataFrame([(x,) for x in S.pattern_lines(S.pattern_columns(lexical=100, thematic=True))], "line STRING"),
    "naive_bayes": _bayes,
    "naive_bayes_scores": lambda s, d: PV.E.multiclass(_bayes(s, d), "act", "prediction"),
    "bag_of_words": _bags,
    "word_tags": lambda s, d: T.records(PT._lines(s, d)).select("filename", "line_number", F.array_join(L.tag_words(F.col("tokens")), " ").alias("tags"), L.first_verb_form(L.tag_words(F.col("tokens"))).alias("first_verb_form")),
}
_STRIP = "'<tr>' || string_agg('<td class=\"' || lower({0}) || '\"></td>', '' ORDER BY pos) || '</tr>'"
#: Characters of words, and of signs, as Java's Unicode classes have them.
_WORD = r"[\p{L}\p{Nl}\p{M}\p{Nd}\p{Pc}\x{200c}\x{200d}\x{24b6}-\x{24e9}]"
_SIGN = r"[^\p{L}\p{Nl}\p{M}\p{Nd}\p{Pc}\x{200c}\x{200d}\x{24b6}-\x{24e9}\s\x0b\x{85}\p{Z}]"
_GOLD = rf"gt AS (SELECT thread, sid, min(text) AS text FROM corpus_sentences WHERE text IS NOT NULL GROUP BY ALL), go AS (SELECT m.thread, m.sid, CASE WHEN changed THEN 'T' ELSE 'F' END AS label, act, array_to_string(regexp_extract_all(text, '{_WORD}+|{_SIGN}+'), ' ') AS words FROM m JOIN gt USING (thread, sid))"
_SCORES = ["windowdiff", "pk", "ghd", "accuracy", "precision", "recall", "f1", "segment_ratio"]
SQL = {
    "mime_fields": "SELECT filename, coalesce(encoding, 'us-ascii') AS charset, 'quoted-printable' AS transfer_encoding, coalesce(mime, 'text/plain') AS content_type FROM tagged_files",
    "mbox_round_trip": "SELECT seq, nullif(from_name, '') AS from_name, nullif(from_email, '') AS from_email, nullif(to_name, '') AS to_name, nullif(to_email, '') AS to_email, message_id, subject, coalesce(in_reply_to, '') AS in_reply_to, coalesce(text, '') AS text FROM messages",
    "mime_bodies": "SELECT seq, coalesce(text, '') AS text FROM messages",
    "tagged_file_lines": "SELECT filename, raw FROM (SELECT DISTINCT filename, phys_no, coalesce(raw, '') AS raw FROM tagged_lines) WHERE NOT starts_with(raw, '#') AND NOT contains(raw, chr(13))",
    "tagged_file_heads": "SELECT filename, " + ", ".join(f"coalesce(regexp_replace({c}, '[\\t\\r\\n]', ' ', 'g'), 'null') AS {c}" for c in corpus.HEADER[1:]) + " FROM tagged_files WHERE filename IN (SELECT filename FROM tagged_lines WHERE NOT starts_with(coalesce(raw, ''), '#') AND NOT contains(coalesce(raw, ''), chr(13)))",
    "texttiling_scan": PT.SQL["texttiling_join"],
    "labelled_corpus": rf"WITH {PS._A}, {_GOLD}, k AS (SELECT list_filter(regexp_split_to_array(label || chr(9) || act || chr(9) || words, '[ \t\n\r\f\v]+'), lambda x: x <> '') AS w FROM go) SELECT w[1] AS label, w[2] AS tag, count(*) AS lines, sum(len(w) - 2)::BIGINT AS tokens FROM k WHERE len(w) > 2 AND w[2] <> 'none' GROUP BY ALL",
    "gold_text": f"WITH {PS._A}, {_GOLD} SELECT thread, sid, label || chr(9) || act || chr(9) || words AS line FROM go",
    "ngram_list": f"SELECT rank, trim(ngram) AS ngram FROM ({PT.SQL['top_ngrams']})",
    "corpus_xml": r"SELECT thread, sid, dense_rank() OVER (PARTITION BY thread ORDER BY doc_no)::INT AS doc_no, trim(regexp_replace(coalesce(text, ''), '[\r\n\x00-\x08\x0b\x0c\x0e-\x1f]', ' ', 'g')) AS text FROM (SELECT thread, sid, min(doc_no) AS doc_no, min(text) AS text FROM corpus_sentences GROUP BY ALL)",
    "annotation_xml": f"WITH {PS._A} SELECT thread, (row_number() OVER (PARTITION BY thread ORDER BY doc_no, sent_no, sid) - 1)::INT AS ord, sid, act AS tag FROM (SELECT thread, doc_no, sent_no, sid, lower(regexp_replace(act, '[^A-Za-z]', '', 'g')) AS act FROM acts WHERE act <> 'none') WHERE act <> ''",
    "graph_reloaded": PG.SQL["reply_links"],
    "messages_saved": "SELECT seq, message_id, subject, text FROM messages",
    "run_counts": f"""WITH {PG._K} SELECT 'repaired' AS what, count(*) AS n FROM e WHERE seq NOT IN (SELECT seq FROM x WHERE ref IS NOT NULL) UNION ALL SELECT 'threads', count(*) FROM st
UNION ALL SELECT 'couples', count(*) FROM ({PG.SQL["reply_couples"]}) UNION ALL SELECT 'failures', count(*) FROM ({PG.SQL["couple_failures"]})""",
    "couple_documents": f"""SELECT source_seq, length(a.text || chr(10) || b.text)::INT AS size, length(a.text)::INT AS source_end, (length(a.text) + 1 + length(b.text))::INT AS document_end
FROM ({PG.SQL["reply_couples"]}) c JOIN messages a ON a.seq = source_seq JOIN messages b ON b.seq = reply_seq""",
    "graph_report": f"""SELECT 1 AS section, seq::VARCHAR AS line FROM ({PG.SQL["answered_roots"]}) UNION ALL SELECT 2, parent || ' <- ' || child FROM ({PG.SQL["reply_lists"]}) UNION ALL SELECT 3, seq || ' -> ' || parent FROM ({PG.SQL["reply_links"]})
UNION ALL SELECT 4, count(*)::VARCHAR FROM messages WHERE message_id IS NULL UNION ALL SELECT 5, parent || ' <- ' || seq FROM ({PG.SQL["later_replies"]}) UNION ALL SELECT 6, path || ' ' || entry FROM ({PG.SQL["thread_tree"]})
UNION ALL SELECT 6, unnest([{", ".join(f"'{c}: ' || coalesce({c}::VARCHAR, 'NaN')" for c in ("threads", "messages", "messages_per_thread", "replies", "node_degree", "average_height", "average_height_of_answered", "null_ids"))}]) FROM ({PG.SQL["graph_statistics"]})
UNION ALL SELECT 7, id || ' ' || coalesce(filename, '') FROM ({PG.SQL["file_names"]})""",
    "score_text": f"""WITH RECURSIVE {PS._N}, {PV.GHD_SQL}, w AS (SELECT avg(round(wd.v, 6)) AS windowdiff, avg(round(pk.v, 6)) AS pk, avg(round(gd.v, 6)) AS ghd, avg(round(accuracy, 6)) AS accuracy, avg(round(precision, 6)) AS precision, avg(round(recall, 6)) AS recall,
avg(round(CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) END, 6)) AS f1, avg(round(ratio, 6)) AS segment_ratio FROM n LEFT JOIN ({PS._WD}) wd USING (fold) LEFT JOIN ({PS._PK}) pk USING (fold) LEFT JOIN gd USING (fold) LEFT JOIN ({PS._AG}) ag USING (fold)),
l AS (SELECT unnest([{", ".join(f"'{m}'" for m in _SCORES)}]) AS metric, unnest([{", ".join(f"round({m}, 6)" for m in _SCORES)}]) AS value FROM w)
SELECT metric, printf('%-24s%8s', metric, coalesce(printf('%.2f', value * 100), '-')) AS line FROM l""",
    "pattern_lines": """WITH o AS (SELECT unnest(range(-2, 3)) AS o), h AS (SELECT g * 9 + f AS b, g, f FROM range(2) a(g), range(3) c(f)),
c AS (SELECT o, 0 AS s, b AS i, k, CASE k WHEN 0 THEN [b] WHEN 1 THEN [b + 3] WHEN 2 THEN [b + 6] WHEN 3 THEN [b, b + 3] WHEN 4 THEN [b + 3, b + 6] ELSE [b, b + 3, b + 6] END AS cs FROM o, h, range(6) d(k)
      UNION ALL SELECT o, 1, c, 0, [c] FROM o, (SELECT unnest(list_concat(range(18, 42), range(42, 142), [142])) AS c)),
n AS (SELECT *, row_number() OVER (ORDER BY o, s, i, k) - 1 AS n FROM c)
SELECT '*' || printf('%05d', n) || ':' || array_to_string(list_transform(cs, lambda x: '%x[' || o || ',' || x || ']'), '/') AS line FROM n""",
    "word_tags": f"WITH {PT._R} SELECT filename, line_number, array_to_string(list_transform(tokens, lambda t: {PV.tag_sql('t')}), ' ') AS tags, {PV._VERB} AS first_verb_form FROM r",
    "word_sign_tokens": rf"SELECT DISTINCT thread, sid, array_to_string(regexp_extract_all(text, '{_WORD}+|{_SIGN}+'), ' ') AS tokens FROM corpus_sentences WHERE text IS NOT NULL",
    "break_tokens": rf"SELECT seq, array_to_string(regexp_extract_all(text, '{_WORD}+|\n|{_SIGN}'), ' ') AS tokens FROM messages WHERE text IS NOT NULL",
    "sequence_tsv": f"WITH {PT._R}, o AS (SELECT filename, line_number, len(tokens) || chr(9) || len(regexp_extract_all(line, '>')) || chr(9) || contains(line, ':') || chr(9) || label AS line FROM r) SELECT * FROM o UNION ALL SELECT filename, max(line_number) + 1, '' FROM o GROUP BY filename",
    "arff_rows": f"WITH {PT._R} SELECT filename, line_number, len(tokens) || ',' || upper(contains(line, ':')::VARCHAR) || ',' || upper(contains(line, '?')::VARCHAR) || ',' || label AS line FROM r",
    "strip_html": f"WITH {PS._A} SELECT fold, '<table>' || {_STRIP.format('gold')} || {_STRIP.format('result')} || '</table>' AS html FROM q GROUP BY fold",
    "bag_of_words": f"""WITH {PT._R}, w AS (SELECT filename, line_number, lower(unnest(tokens)) AS t FROM r UNION ALL SELECT filename, line_number, lower(tokens[1]) FROM r),
c AS (SELECT filename, line_number, t, count(*) AS n FROM w GROUP BY ALL) SELECT filename, line_number, string_agg(t || ':' || n, ' ' ORDER BY t) AS bag FROM c GROUP BY ALL""",
}
