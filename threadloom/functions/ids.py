"""Identifier and subject expressions (STR1-STR3); all stay inside code generation."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def strip_brackets(c: Column) -> Column:
    """STR1: from after the first ``<`` (or the start) to the first ``>`` after it (or the end); null stays null."""
    tail = F.when(F.locate("<", c) > 0, c.substr(F.locate("<", c) + 1, F.length(c))).otherwise(c)
    return F.substring_index(tail, ">", 1)


def clean_id(c: Column) -> Column:
    """STR1, outer white space off, then STR2 (blanks become ``+``)."""
    return F.replace(F.regexp_replace(strip_brackets(c), r"^\s+|\s+$", ""), F.lit(" "), F.lit("+"))


def subject_digest(c: Column) -> Column:
    """STR3: letters only, leading ``Re`` runs off, lower case (so ``Report`` gives ``port``)."""
    return F.lower(F.regexp_replace(F.regexp_replace(c, r"\P{L}", ""), r"^(Re)+", ""))
