"""Text exports of feature tables, tagged lines, scores and reply graphs.

Each gives a table of ordered lines (``file``, ``at``, ``line``); :func:`write_lines` writes one text file a value of ``file``.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadloom.functions.text import escaped, two_decimals, words_and_signs
from threadloom.operators.graph import file_names


def sequence_tsv(features: DataFrame, columns: list[str], label: str | None = "label") -> DataFrame:
    """SNK5: rows of tab-separated features, the label last if asked for, and an empty line after each message."""
    cells = [escaped(F.coalesce(F.col(c).cast("string"), F.lit("@NULL"))) for c in columns] + ([F.col(label)] if label else [])
    rows = features.select("filename", "line_number", F.concat_ws("\t", *cells).alias("line"))
    ends = rows.groupBy("filename").agg((F.max("line_number") + 1).alias("line_number")).select("filename", "line_number", F.lit("").alias("line"))
    return rows.unionByName(ends)


def sequence_files(features: DataFrame, records: DataFrame, columns: list[str]) -> DataFrame:
    """SNK5: the lines of the four files of a split; ``features`` has ``part`` (train or test) beside ``columns`` and ``label``.

    ``train``: features and label; ``test``: features; ``gold``: the label alone; ``origin``: the line as it stands. An empty line ends each message.
    """
    of = lambda part: features.where(F.col("part") == part)
    named = lambda name, df: df.select(F.lit(name).alias("file"), "filename", "line_number", "line")
    test = of("test").select("filename", "line_number")
    return (
        named("train", sequence_tsv(of("train"), columns))
        .unionByName(named("test", sequence_tsv(of("test"), columns, None)))
        .unionByName(named("gold", sequence_tsv(of("test"), [], "label")))
        .unionByName(named("origin", sequence_tsv(records.join(test, ["filename", "line_number"], "left_semi").withColumnRenamed("line", "_line"), [], "_line")))
    )


def arff_header(relation: str, schema: list[tuple[str, str]], labels: list[str]) -> list[str]:
    """SNK6: header lines; string attributes are left out here and in the rows, so both have as many."""
    kinds = {"boolean": "{TRUE, FALSE}", "int": "integer", "bigint": "integer", "double": "real"}
    return [f"@relation {relation}", "", *[f"@attribute {n} {kinds[t]}" for n, t in schema if t in kinds], "@attribute class {" + ", ".join(labels) + "}", "", "@data"]


def arff_rows(features: DataFrame, label: str = "label") -> DataFrame:
    """SNK6: data rows of the numeric and boolean columns and the class; missing values are ``?``."""
    names = [(n, t) for n, t in features.dtypes if t in ("boolean", "int", "bigint", "double") and n != "line_number"]
    cell = lambda n, t: F.coalesce(F.upper(F.col(n).cast("string")) if t == "boolean" else F.round(n, 6).cast("decimal(18,6)").cast("string") if t == "double" else F.col(n).cast("string"), F.lit("?"))
    return features.select("filename", "line_number", F.concat_ws(",", *[cell(*x) for x in names], F.col(label)).alias("line"))


def tagged_text(lines: DataFrame, files: DataFrame | None = None) -> DataFrame:
    """SNK4: ``TAG<tab>line`` of the aligned source lines that have a reply side; with ``files`` (``source_seq``, ``source_file``) first ``# path``."""
    rows = lines.where("reply_line IS NOT NULL").select("source_seq", "pos", F.concat_ws("\t", "tag", "source_line").alias("line"))
    if files is None:
        return rows
    return rows.unionByName(files.select("source_seq", F.lit(-1).alias("pos"), F.concat(F.lit("# "), "source_file").alias("line")))


def gold_text(marked: DataFrame, sentences: DataFrame) -> DataFrame:
    """SNK10: ``T/F<tab>act<tab>tokens`` of each sentence."""
    words = F.array_join(words_and_signs(F.col("text")), " ")
    text = sentences.where("text IS NOT NULL").groupBy("thread", "sid").agg(F.min("text").alias("text"))
    return marked.join(text, ["thread", "sid"]).select("thread", "sid", F.concat_ws("\t", F.when(F.col("changed"), "T").otherwise("F"), "act", words).alias("line"))


def score_text(scores: DataFrame) -> DataFrame:
    """SNK7: one line a metric, two decimals, in percent."""
    return scores.select("metric", F.format_string("%-24s%8s", F.col("metric"), F.coalesce(two_decimals(F.col("value"), True), F.lit("-"))).alias("line"))


def strip_html(seq: DataFrame) -> DataFrame:
    """SNK8: each fold's gold, result and, if there is one, baseline labels as rows of coloured cells. A strip is one line of HTML, so a fold is one row."""
    cell = lambda c: F.concat(F.lit('<td class="'), F.lower(c), F.lit('"></td>'))
    row = lambda c: F.concat(F.lit("<tr>"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", c))), lambda x: cell(x[c])), ""), F.lit("</tr>"))
    return seq.groupBy("fold").agg(F.concat(F.lit("<table>"), row("gold"), row("result"), *([row("baseline")] if "baseline" in seq.columns else []), F.lit("</table>")).alias("html"))


def graph_report(graph) -> DataFrame:
    """SNK3: the seven sections of the reply graph, one line a row.

    1 roots; 2 replies by parent; 3 parents by reply; 4 number of messages without id; 5 couples without first replies; 6 trees
    and statistics; 7 file names by id.
    """
    part = lambda n, df, line: df.select(F.lit(n).alias("section"), line.cast("string").alias("line"))
    stats = graph.statistics()
    numbers = stats.select(F.explode(F.array(*[F.concat(F.lit(c + ": "), F.coalesce(F.col(c).cast("string"), F.lit("NaN"))) for c in stats.columns])).alias("line"))
    return (
        part(1, graph.starts, F.col("seq"))
        .unionByName(part(2, graph.children(), F.concat_ws(" <- ", "parent", "child")))
        .unionByName(part(3, graph.edges, F.concat_ws(" -> ", "seq", "parent")))
        .unionByName(part(4, graph.messages.agg(F.count_if(F.col("message_id").isNull()).alias("n")), F.col("n")))
        .unionByName(part(5, graph.later_replies(), F.concat_ws(" <- ", "parent", "seq")))
        .unionByName(part(6, graph.tree(), F.concat_ws(" ", "path", "entry")))
        .unionByName(part(6, numbers, F.col("line")))
        .unionByName(part(7, file_names(graph.messages), F.concat_ws(" ", "id", F.coalesce("filename", F.lit("")))))
    )


def write_lines(df: DataFrame, path: str, by: str, order: list[str]) -> None:
    """Writes the column ``line`` as text, a folder for each value of ``by``, rows in ``order`` within it."""
    df.repartition(by).sortWithinPartitions(by, *order).select(by, "line").write.mode("overwrite").partitionBy(by).text(path)


def write_messages(df: DataFrame, path: str) -> None:
    """SNK1, SNK2: a message or graph table, the folder emptied first."""
    df.write.mode("overwrite").parquet(path)
