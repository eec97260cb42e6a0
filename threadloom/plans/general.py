"""Queries of the general data operators, with their SQL where SQL can say it."""

from threadloom.operators.dedup import repeated_deliveries
from threadloom.operators.timestamps import sending_times
from threadloom.sources.tables import table

#: DuckDB expression of the clean id of {0}.
CLEAN_ID_SQL = r"""replace(regexp_replace(split_part(CASE WHEN instr({0}, '<') > 0 THEN substr({0}, instr({0}, '<') + 1) ELSE {0} END, '>', 1), '^\s+|\s+$', '', 'g'), ' ', '+')"""


def p1_found(spark, d):
    return repeated_deliveries(table(spark, d, "messages"))


def p1_kept(spark, d):
    """The rows that remain: one per identifier, and all without one."""
    m = table(spark, d, "messages")
    return m.select("seq").join(repeated_deliveries(m), "seq", "left_anti")


def p6_found(spark, d):
    return sending_times(table(spark, d, "messages"), table(spark, d, "mailboxes"))


QUERIES = {"p1_found": p1_found, "p1_kept": p1_kept, "p6_found": p6_found}
SQL = {
    "p1_found": f"""
SELECT seq FROM (SELECT seq, row_number() OVER (PARTITION BY {CLEAN_ID_SQL.format("message_id")} ORDER BY seq) AS n
                 FROM messages WHERE message_id IS NOT NULL) WHERE n > 1""",
    "p1_kept": f"""
SELECT seq FROM (SELECT seq, message_id, row_number() OVER (PARTITION BY {CLEAN_ID_SQL.format("message_id")} ORDER BY seq) AS n FROM messages) WHERE n = 1 OR message_id IS NULL""",
}
