"""Queries of the operators for training data, with their SQL where SQL can say it."""

import secrets

from threadloom.llm.consensus import consensus
from threadloom.llm.conversations import conversations
from threadloom.llm.encoding import examine
from threadloom.llm.newtext import new_lines, settled_lines
from threadloom.llm.packing import fill, pack
from threadloom.llm.privacy import clashes
from threadloom.llm.privacy import find as find_items
from threadloom.llm.privacy import replace as replace_items
from threadloom.llm.residue import clean_documents, is_residue, score
from threadloom.llm.tokens import token_ids
from threadloom.sources.tables import table


def p2_found(spark, d):
    return examine(table(spark, d, "messages"), twins=False).select("seq", "field_name")


def p2_restored(spark, d):
    return examine(table(spark, d, "messages"))


def p3_found(spark, d):
    return conversations(table(spark, d, "messages"), table(spark, d, "mailboxes")).drop("role")


def p3_conversations(spark, d):
    return conversations(table(spark, d, "messages"), table(spark, d, "mailboxes"))


def p4_found(spark, d):
    return find_items(table(spark, d, "messages"))


def _key(spark):
    """The secret of the session, or one for this run alone."""
    return spark.conf.get("spark.threadloom.key", None) or secrets.token_hex(16)


def p4_placeholders(spark, d):
    return replace_items(table(spark, d, "messages"), _key(spark))


def p4_surrogates(spark, d):
    return replace_items(table(spark, d, "messages"), _key(spark), style="surrogate")


def p4_clashes(spark, d):
    """Codes that several items share: no row is the result that is wanted."""
    return clashes(find_items(table(spark, d, "messages")), _key(spark))


def p5_found(spark, d):
    return consensus(table(spark, d, "bc3_labelled"))[0].select("thread", "sid", "tag")


def p5_agreement(spark, d):
    return consensus(table(spark, d, "bc3_labelled"))[0]


def p5_reliability(spark, d):
    return consensus(table(spark, d, "bc3_labelled"))[1]


def p7_found(spark, d):
    return new_lines(table(spark, d, "messages"), ("seq", "line_no"))


def p7_lines(spark, d):
    return new_lines(table(spark, d, "messages"))


def p7_settled(spark, d):
    """How many lines are new, and how many others compression or their form settled."""
    return settled_lines(table(spark, d, "messages")).groupBy("how").count()


def p8_ids(spark, d):
    return token_ids(table(spark, d, "documents"))


def p9_containers(spark, d):
    return pack(table(spark, d, "documents"), table(spark, d, "containers"))


def p9_fill(spark, d):
    return fill(p9_containers(spark, d), table(spark, d, "containers"))


def p10_found(spark, d):
    return score(table(spark, d, "documents")).where(is_residue()).select("doc_id")


def p10_clean(spark, d):
    return clean_documents(table(spark, d, "documents")).select("doc_id", "text")


QUERIES = {"p2_found": p2_found, "p2_restored": p2_restored, "p3_found": p3_found, "p3_conversations": p3_conversations, "p4_found": p4_found, "p4_placeholders": p4_placeholders, "p4_surrogates": p4_surrogates, "p4_clashes": p4_clashes, "p5_found": p5_found, "p5_agreement": p5_agreement, "p5_reliability": p5_reliability, "p7_found": p7_found, "p7_lines": p7_lines, "p7_settled": p7_settled, "p8_ids": p8_ids, "p9_containers": p9_containers, "p9_fill": p9_fill, "p10_found": p10_found, "p10_clean": p10_clean}
SQL = {}
