"""Tagged message files and annotated-corpus XML as tables."""

import xml.etree.ElementTree as ET

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

HEADER = ["path", "message_id", "mime", "encoding", "is_initial", "from_address", "from_personal", "to_address", "to_personal"]


def scan_tagged(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """SRC7, SRC8: lines (``filename phys_no raw``) and header data of a folder of tagged files.

    The header is the first of the leading ``#`` lines with eight tab-separated fields; files without have none. A file is
    read as one value, since its lines have no numbers of their own; one message is one file. Where the files lie in folders
    ``filename=...``, as :func:`threadloom.sinks.exports.write_lines` writes them, these give the names.
    """
    files = spark.read.text(path, wholetext=True)
    name = F.col("filename").cast("string") if "filename" in files.columns else F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1)
    whole = files.select(name.alias("filename"), "value")
    body = F.regexp_replace("value", r"\n\z", "")
    lines = whole.select("filename", F.posexplode(F.split(body, "\n")).alias("i", "raw")).select("filename", (F.col("i") + 1).alias("phys_no"), "raw")
    head = lines.groupBy("filename").agg(F.min(F.when(~F.col("raw").startswith("#"), F.col("phys_no"))).alias("body"))
    fields = F.split(F.expr("substring(raw, 3)"), "\t")
    heads = lines.join(head, "filename").where(F.col("raw").startswith("#") & (F.col("phys_no") < F.coalesce("body", F.lit(1 << 30)))).select("filename", "phys_no", fields.alias("f")).where(F.size("f") == 8)
    heads = heads.groupBy("filename").agg(F.min_by("f", "phys_no").alias("f"))
    return lines, heads.select("filename", *[F.col("f")[i].alias(k) for i, k in enumerate(HEADER[1:])])


def scan_labelled(spark: SparkSession, path: str) -> DataFrame:
    """SRC16: ``label tag tokens`` of the lines with more than two tokens whose tag isn't ``none``; a line is a row, files are split anywhere."""
    w = F.filter(F.split("value", r"\s+"), lambda x: x != "")
    rows = spark.read.text(path).select(w.alias("w")).where("size(w) > 2")
    return rows.select(F.col("w")[0].alias("label"), F.col("w")[1].alias("tag"), F.expr("slice(w, 3, size(w) - 2)").alias("tokens")).where("tag <> 'none'")


def scan_labels(spark: SparkSession, path: str) -> DataFrame:
    """SRC9: ``filename line_number tt_label`` of a parallel folder of label files, one label a line."""
    lines, _ = scan_tagged(spark, path)
    return lines.select("filename", F.col("phys_no").alias("line_number"), F.trim("raw").alias("tt_label"))


def scan_words(spark: SparkSession, path: str) -> DataFrame:
    """SRC10: ``rank``, ``ngram`` of a list with one n-gram a line, in file order."""
    whole = spark.read.text(path, wholetext=True).select(F.posexplode(F.split(F.regexp_replace("value", r"\n\z", ""), "\n")).alias("i", "w"))
    return whole.select((F.col("i") + 1).alias("rank"), F.trim("w").alias("ngram"))


def scan_sentences(spark: SparkSession, path: str) -> DataFrame:
    """SRC11: ``thread doc_no sent_no sid text`` of corpus XML; an explicit schema keeps ids as strings ('1.10' isn't '1.1')."""
    schema = "listno STRING, DOC ARRAY<STRUCT<Text: STRUCT<Sent: ARRAY<STRUCT<_id: STRING, _VALUE: STRING>>>>>"
    docs = spark.read.format("xml").option("rowTag", "thread").schema(schema).load(path).select(F.col("listno").alias("thread"), F.posexplode("DOC").alias("d", "doc"))
    return docs.select("thread", (F.col("d") + 1).alias("doc_no"), F.posexplode("doc.Text.Sent").alias("s", "sent")).select("thread", "doc_no", (F.col("s") + 1).alias("sent_no"), F.col("sent._id").alias("sid"), F.trim("sent._VALUE").alias("text"))


def scan_annotations(spark: SparkSession, path: str) -> DataFrame:
    """SRC12: ``thread ord sid tag`` of annotation XML; the tag is the element's name, only a thread's first annotation counts."""

    def run(batches):
        for df in batches:
            rows = []
            for text in df["value"]:
                for thread in ET.fromstring(text).iter("thread"):
                    first = thread.find("annotation")
                    labels = first.find("labels") if first is not None else None
                    rows += [(thread.findtext("listno"), i, e.get("id"), e.tag) for i, e in enumerate(labels if labels is not None else [])]
            yield pd.DataFrame(rows, columns=["thread", "ord", "sid", "tag"])

    return spark.read.text(path, wholetext=True).mapInPandas(run, "thread STRING, ord INT, sid STRING, tag STRING")
