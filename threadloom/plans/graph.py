"""Queries over the reply graph and texts of messages, and their SQL."""

from pyspark.sql import functions as F

from threadloom.functions import text as X
from threadloom.functions.ids import clean_id, subject_digest
from threadloom.operators import graph as G
from threadloom.plans.general import CLEAN_ID_SQL
from threadloom.sources.tables import table

_ID, _REF = CLEAN_ID_SQL.format("message_id"), CLEAN_ID_SQL.format("in_reply_to")
_DIGEST = r"lower(regexp_replace(regexp_replace(subject, '\P{L}', '', 'g'), '^(Re)+', ''))"
_K = rf"""x AS (SELECT *, {_ID} AS cid, CASE WHEN in_reply_to <> '' THEN {_REF} END AS ref, {_DIGEST} AS digest, coalesce(starts_with(subject, 'Re:'), false) AS re
      FROM messages WHERE message_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY {_ID} ORDER BY seq) = 1),
b AS (SELECT *, row_number() OVER (PARTITION BY mailbox ORDER BY seq) AS rn FROM x WHERE subject IS NOT NULL),
e AS (SELECT a.seq, p.seq AS parent FROM x a JOIN x p ON a.ref = p.cid
      UNION ALL SELECT a.seq, max(c.seq) FROM b a JOIN b c ON a.mailbox = c.mailbox AND a.digest = c.digest AND c.rn BETWEEN a.rn - 10 AND a.rn - 1 WHERE a.ref IS NULL AND a.re GROUP BY a.seq),
st AS (SELECT seq FROM x WHERE ref IS NULL AND NOT re)"""
_T = f"RECURSIVE {_K}, t AS (SELECT seq, seq AS root, 0 AS depth, printf('%019d', seq) AS path FROM st UNION ALL SELECT e.seq, root, depth + 1, path || printf('/%019d', e.seq) FROM t JOIN e ON e.parent = t.seq)"
_H = f"{_T}, h AS (SELECT root, (max(depth) + 1)::INT AS height, count(*) AS messages FROM t GROUP BY root)"
_BLOCKS = r"(SELECT count(*) FROM (SELECT line, lag(line) OVER (ORDER BY i) AS prev FROM (SELECT unnest(string_split(regexp_replace(text, '\n+$', ''), chr(10))) AS line, generate_subscripts(string_split(regexp_replace(text, '\n+$', ''), chr(10)), 1) AS i)) WHERE starts_with(line, '>') AND NOT coalesce(starts_with(prev, '>'), false))"


def _g(s, d):
    return G.Graph(table(s, d, "messages"))


def _m(s, d):
    return table(s, d, "messages")


def _lines(s, d):
    return _m(s, d).where("text IS NOT NULL").select("seq", F.posexplode(F.split("text", "\n")).alias("i", "line"))


QUERIES = {
    "message_ids": lambda s, d: _m(s, d).select("seq", clean_id(F.col("message_id")).alias("id"), clean_id(F.col("in_reply_to")).alias("reply_to")),
    "subject_digest": lambda s, d: _m(s, d).select("seq", subject_digest(F.col("subject")).alias("digest")),
    "message_keys": lambda s, d: G.message_keys(_m(s, d)),
    "run_statistics": lambda s, d: G.run_statistics(_m(s, d)),
    "file_names": lambda s, d: G.file_names(_m(s, d)),
    "reply_links": lambda s, d: _g(s, d).edges,
    "orphans": lambda s, d: _g(s, d).orphans(),
    "thread_roots": lambda s, d: _g(s, d).threads(),
    "thread_heights": lambda s, d: _g(s, d).heights(),
    "reply_lists": lambda s, d: _g(s, d).children(),
    "answered_roots": lambda s, d: _g(s, d).started(),
    "later_replies": lambda s, d: _g(s, d).later_replies(),
    "graph_statistics": lambda s, d: _g(s, d).statistics(),
    "thread_tree": lambda s, d: _g(s, d).tree(),
    "quote_blocks": lambda s, d: _m(s, d).select("seq", F.coalesce(G.quote_blocks(F.col("text")), F.lit(0)).alias("blocks"), G.inline_reply(F.col("text")).alias("inline")),
    "reply_couples": lambda s, d: _g(s, d).couples(),
    "couple_failures": lambda s, d: _g(s, d).failures(),
    "unquoted_lines": lambda s, d: _lines(s, d).where(F.col("line").startswith(">")).select("seq", "i", X.unquoted(F.col("line")).alias("line")),
    "reply_only_alignment": lambda s, d: _lines(s, d).select("seq", "i", F.when(F.col("line").startswith(">"), X.unquoted(F.col("line"))).alias("source_line"), F.col("line").alias("reply_line")),
    "normalised_texts": lambda s, d: _m(s, d).select("seq", X.single_breaks(X.cut_at_nul(F.col("text"))).alias("single_breaks"), X.single_blanks(F.col("text")).alias("single_blanks"), X.masked_numbers(F.col("subject")).alias("masked_subject")),
    "word_counts": lambda s, d: _m(s, d).select("seq", F.coalesce(F.size(X.words(F.col("text"))), F.lit(0)).alias("words"), X.escaped(F.col("subject")).alias("subject")),
}
SQL = {
    "message_ids": f"SELECT seq, {_ID} AS id, {_REF} AS reply_to FROM messages",
    "subject_digest": f"SELECT seq, {_DIGEST} AS digest FROM messages",
    "message_keys": "SELECT seq, k AS message_key, count(*) OVER (PARTITION BY k) > 1 AS repeated FROM (SELECT seq, CASE WHEN received_at IS NULL THEN 'seq-' || seq ELSE strftime(received_at AT TIME ZONE 'UTC', '%Y-%b-%d-%a-%H-%M-%S') || '-UTC-' || coalesce(from_email, 'null') END AS k FROM messages)",
    "run_statistics": f"SELECT count(*) AS messages, count(*) FILTER (WHERE message_id IS NULL) AS null_ids, count(*) FILTER (WHERE in_reply_to <> '') AS linked, count(*) FILTER (WHERE coalesce(in_reply_to, '') = '' AND starts_with(subject, 'Re:')) AS replies_by_subject, count(DISTINCT {_ID}) AS distinct_ids FROM messages",
    "file_names": f"SELECT id, filename FROM (SELECT {_ID} AS id, filename, row_number() OVER (PARTITION BY {_ID} ORDER BY CASE WHEN filename IS NULL THEN -1 ELSE seq END DESC) AS n FROM messages WHERE message_id IS NOT NULL) WHERE n = 1",
    "reply_links": f"WITH {_K} SELECT * FROM e",
    "orphans": f"WITH {_K} SELECT seq FROM x WHERE seq NOT IN (SELECT seq FROM st) AND seq NOT IN (SELECT seq FROM e)",
    "thread_roots": f"WITH {_T} SELECT seq, root, depth FROM t",
    "thread_heights": f"WITH {_H} SELECT * FROM h",
    "reply_lists": f"WITH {_K} SELECT parent, seq AS child, row_number() OVER (PARTITION BY parent ORDER BY seq) AS n FROM e",
    "answered_roots": f"WITH {_K} SELECT seq, seq IN (SELECT parent FROM e) AS answered FROM st",
    "later_replies": f"WITH {_K} SELECT parent, seq FROM (SELECT *, row_number() OVER (PARTITION BY parent ORDER BY seq) AS n FROM e) WHERE n > 1 OR parent NOT IN (SELECT seq FROM st)",
    "graph_statistics": f"""WITH {_H} SELECT (SELECT count(*) FROM st) AS threads, (SELECT count(*) FROM st) + (SELECT count(*) FROM e) AS messages,
round(((SELECT count(*) FROM st) + (SELECT count(*) FROM e))::DOUBLE / (SELECT count(*) FROM st), 6) AS messages_per_thread, (SELECT count(*) FROM e) AS replies,
round((SELECT count(*)::DOUBLE / count(DISTINCT parent) FROM e), 6) AS node_degree, (SELECT round(avg(height), 6) FROM h) AS average_height,
(SELECT round(avg(height), 6) FROM h WHERE root IN (SELECT parent FROM e)) AS average_height_of_answered, (SELECT count(*) FROM messages WHERE message_id IS NULL) AS null_ids""",
    "thread_tree": f"WITH {_T} SELECT t.seq, path, repeat('  ', depth) || cid AS entry FROM t JOIN x USING (seq)",
    "quote_blocks": f"SELECT seq, coalesce(n, 0)::INT AS blocks, coalesce(n >= 2, false) AS inline FROM (SELECT seq, CASE WHEN text IS NOT NULL THEN {_BLOCKS} END AS n FROM messages)",
    "reply_couples": f"""WITH {_K}, q AS (SELECT seq, filename AS reply_file FROM x WHERE filename IS NOT NULL AND {_BLOCKS} >= 2)
SELECT parent AS source_seq, q.seq AS reply_seq, p.filename AS source_file, reply_file FROM q JOIN e ON e.seq = q.seq JOIN x p ON p.seq = e.parent WHERE p.filename IS NOT NULL QUALIFY row_number() OVER (PARTITION BY parent ORDER BY q.seq DESC) = 1""",
    "couple_failures": f"""WITH {_K}, q AS (SELECT seq, filename FROM x WHERE {_BLOCKS} >= 2)
SELECT seq FROM q WHERE seq NOT IN (SELECT q.seq FROM q JOIN e ON e.seq = q.seq JOIN x p ON p.seq = e.parent WHERE p.filename IS NOT NULL AND q.filename IS NOT NULL)""",
    "unquoted_lines": "SELECT seq, (i - 1)::INT AS i, regexp_replace(line, '^[> ]+', '') AS line FROM (SELECT seq, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM messages) WHERE starts_with(line, '>')",
    "reply_only_alignment": "SELECT seq, (i - 1)::INT AS i, CASE WHEN starts_with(line, '>') THEN regexp_replace(line, '^[> ]+', '') END AS source_line, line AS reply_line FROM (SELECT seq, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM messages)",
    "normalised_texts": r"SELECT seq, regexp_replace(text, '\n\n+', chr(10), 'g') AS single_breaks, regexp_replace(text, '[ \t\n]+', ' ', 'g') AS single_blanks, regexp_replace(subject, '[0-9]', '#', 'g') AS masked_subject FROM messages",
    "word_counts": r"SELECT seq, coalesce(len(list_filter(regexp_split_to_array(text, '\s+'), lambda t: t <> '')), 0)::INT AS words, replace(subject, '#', '\#') AS subject FROM messages",
}
