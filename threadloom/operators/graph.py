"""The reply graph of a mailbox archive: edges, heights, trees, couples and statistics.

All works on the kept rows (one per clean id); ``edges`` are ``seq``, ``parent`` of :func:`reply_links`.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadloom.functions.ids import clean_id
from threadloom.operators.dedup import kept_rows
from threadloom.operators.threads import is_start, link_rows, paths, reply_links, roots, running_number
from threadloom.sources.scratch import save


class Graph:
    """Edges, starts and resolved threads of a message table; each is computed once and kept in the shared folder.

    What is kept are narrow rows: no text and no file name. Operators that need those read them from the messages.
    """

    def __init__(self, messages: DataFrame):
        self.messages = messages
        self.rows = save(link_rows(messages), "rows")
        self.edges = save(reply_links(self.rows), "edges")
        self.starts = self.rows.where(is_start()).select("seq")

    def save(self, path: str) -> None:
        """SNK2: the graph's tables under ``path``, what was there is replaced."""
        self.rows.write.mode("overwrite").parquet(path + "/rows")
        self.edges.write.mode("overwrite").parquet(path + "/edges")

    @classmethod
    def load(cls, messages: DataFrame, path: str) -> "Graph":
        """SRC14: a saved graph, nothing is linked anew; one that isn't there is computed."""
        spark = messages.sparkSession
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path + "/edges/_SUCCESS")
        if not p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p):
            return cls(messages)
        g = cls.__new__(cls)
        g.messages, g.rows, g.edges = messages, spark.read.parquet(path + "/rows"), spark.read.parquet(path + "/edges")
        g.starts = g.rows.where(is_start()).select("seq")
        return g

    def run_counts(self) -> DataFrame:
        """AGG13: links found by subject, threads, couples and inline replies that make none."""
        stated = self.rows.where(F.col("ref").isNotNull()).select("seq")
        count = lambda name, df: df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("what"), "n")
        parts = [("repaired", self.edges.join(stated, "seq", "left_anti")), ("threads", self.starts), ("couples", self.couples()), ("failures", self.failures())]
        out = count(*parts[0])
        for p in parts[1:]:
            out = out.unionByName(count(*p))
        return out

    def threads(self) -> DataFrame:
        return roots(self.edges, self.starts)

    def orphans(self) -> DataFrame:
        """Replies by their subject for which no earlier message was found, and stated links that lead nowhere."""
        return self.rows.join(self.starts, "seq", "left_anti").join(self.edges, "seq", "left_anti").select("seq")

    def heights(self) -> DataFrame:
        """REC1, AGG7: height (a leaf has 1) and number of messages of every thread."""
        return self.threads().groupBy("root").agg((F.max("depth") + 1).alias("height"), F.count(F.lit(1)).alias("messages"))

    def children(self) -> DataFrame:
        """AGG5, JOIN6: the distinct replies of each parent with their number in order of arrival.

        One row a reply and no list, so that a message with very many replies is no large row.
        """
        return running_number(self.edges, "parent").select("parent", F.col("seq").alias("child"), F.col("rn").alias("n"))

    def started(self) -> DataFrame:
        """JOIN7: roots, and whether they have a reply."""
        parents = self.edges.select(F.col("parent").alias("seq"), F.lit(True).alias("answered")).distinct()
        return self.starts.join(parents, "seq", "left").select("seq", F.coalesce("answered", F.lit(False)).alias("answered"))

    def later_replies(self) -> DataFrame:
        """JOIN8, WIN9: couples without the first reply to a root."""
        root = self.starts.select(F.col("seq").alias("parent"), F.lit(True).alias("is_root"))
        return running_number(self.edges, "parent").join(root, "parent", "left").where("is_root IS NULL OR rn > 1").select("parent", "seq")

    def statistics(self) -> DataFrame:
        """AGG6: one row; messages are those in threads and replies without, orphans excluded. Without roots the ratios are null."""
        return self.messages.sparkSession.sql(
            """
            WITH t AS (SELECT count(*) AS n FROM {s}), e AS (SELECT struct(count(*) AS replies, count(DISTINCT parent) AS parents) AS v FROM {e}),
                 h AS (SELECT struct(avg(height) AS every, avg(CASE WHEN a.root IS NOT NULL THEN height END) AS answered) AS v
                       FROM {h} h LEFT JOIN (SELECT DISTINCT parent AS root FROM {e}) a ON h.root = a.root),
                 x AS (SELECT (SELECT n FROM t) AS threads, (SELECT v FROM e) AS e, (SELECT v FROM h) AS h, count_if(message_id IS NULL) AS null_ids FROM {m})
            SELECT threads, e.replies + threads AS messages, round(try_divide(CAST(e.replies + threads AS DOUBLE), threads), 6) AS messages_per_thread, e.replies AS replies,
                   round(try_divide(CAST(e.replies AS DOUBLE), e.parents), 6) AS node_degree, round(h.every, 6) AS average_height, round(h.answered, 6) AS average_height_of_answered, null_ids
            FROM x
            """,
            s=self.starts,
            e=self.edges,
            h=self.heights(),
            m=self.messages,
        )

    def tree(self) -> DataFrame:
        """SRT4: every message of a thread with its place in pre-order (``path``, a text that sorts) and its indented id.

        Pointer doubling: a row holds the part of its path below its pointer, so a thread of n levels takes log2(n) joins.
        The paths themselves are the result and as long as their thread is deep.
        """
        cid = self.rows.select("seq", "cid")
        out = paths(self.edges, self.starts)
        return out.join(cid, "seq").select("seq", "path", F.concat(F.repeat(F.lit("  "), F.col("depth")), F.col("cid")).alias("entry"))

    def kept(self, condition, *columns: str) -> DataFrame:
        """``columns`` of the kept rows with ``condition``, read from the messages where it is pushed down."""
        return self.messages.where(condition).select("seq", *columns).join(self.rows.select("seq"), "seq", "left_semi")

    def couples(self) -> DataFrame:
        """JOIN2: the last inline reply to each message and the file names of both; both sides need one."""
        inline = self.kept(inline_reply(F.col("text")) & F.col("filename").isNotNull(), "filename").withColumnRenamed("filename", "reply_file")
        source = self.kept(F.col("filename").isNotNull(), "filename").select(F.col("seq").alias("parent"), F.col("filename").alias("source_file"))
        pairs = inline.join(self.edges, "seq").join(source, "parent")
        return pairs.groupBy("parent").agg(F.max_by(F.struct("seq", "reply_file", "source_file"), "seq").alias("r")).select(F.col("parent").alias("source_seq"), F.col("r.seq").alias("reply_seq"), "r.source_file", "r.reply_file")

    def failures(self) -> DataFrame:
        """Inline replies that make no couple because a parent or a file name is missing."""
        inline = self.kept(inline_reply(F.col("text")), "filename")
        source = self.kept(F.col("filename").isNotNull()).select(F.col("seq").alias("parent"))
        good = inline.where("filename IS NOT NULL").join(self.edges, "seq").join(source, "parent").select("seq")
        return inline.select("seq").join(good, "seq", "left_anti")


def quote_blocks(text):
    """WIN2: the number of maximal runs of lines that start with ``>``; trailing empty lines don't count."""
    lines = F.split(F.regexp_replace(text, r"\n+$", ""), "\n")
    step = lambda s, x: F.struct((s["n"] + F.when(x.startswith(">") & ~s["q"], 1).otherwise(0)).alias("n"), x.startswith(">").alias("q"))
    return F.aggregate(lines, F.struct(F.lit(0).alias("n"), F.lit(False).alias("q")), step, lambda s: s["n"])


def inline_reply(text):
    """A message answers inline if it has two quote blocks or more; null texts don't."""
    return F.coalesce(quote_blocks(text) >= 2, F.lit(False))


def file_names(messages: DataFrame) -> DataFrame:
    """JOIN5: the file name of each clean id; the last row wins."""
    rows = messages.where("message_id IS NOT NULL").select(clean_id(F.col("message_id")).alias("id"), "filename", "seq")
    return rows.groupBy("id").agg(F.max_by("filename", "seq").alias("filename"))


def message_keys(messages: DataFrame) -> DataFrame:
    """SRC3, SRC4: a readable key from date and sender, and whether another row has it; without a date it comes from ``seq``."""
    stamp = F.date_format("received_at", "yyyy-MMM-dd-EEE-HH-mm-ss")
    key = F.when(F.col("received_at").isNull(), F.concat(F.lit("seq-"), F.col("seq").cast("string"))).otherwise(F.concat_ws("-", stamp, F.lit("UTC"), F.coalesce("from_email", F.lit("null"))))
    rows = messages.select("seq", key.alias("message_key"))
    twice = rows.groupBy("message_key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("message_key", F.lit(True).alias("repeated"))
    return rows.join(twice, "message_key", "left").select("seq", "message_key", F.coalesce("repeated", F.lit(False)).alias("repeated"))


def run_statistics(messages: DataFrame) -> DataFrame:
    """FLT9, AGG13: messages processed, with and without id, with a reply link, replies by subject alone."""
    return messages.sparkSession.sql(
        """
        SELECT count(*) AS messages, count_if(message_id IS NULL) AS null_ids, count_if(coalesce(in_reply_to <> '', false)) AS linked,
               count_if(coalesce(in_reply_to, '') = '' AND coalesce(startswith(subject, 'Re:'), false)) AS replies_by_subject, (SELECT count(*) FROM {k}) AS distinct_ids
        FROM {m}
        """,
        m=messages,
        k=kept_rows(messages.select("seq", "message_id")),
    )
