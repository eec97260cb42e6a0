"""Text expressions on columns (STR4-STR12, SRC2); all stay inside code generation."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def cut_at_nul(c: Column) -> Column:
    """SRC2: the text before the first NUL."""
    return F.substring_index(c, "\u0000", 1)


def unquoted(c: Column) -> Column:
    """STR4: a line without its quotation prefix."""
    return F.regexp_replace(c, "^[> ]+", "")


def single_breaks(c: Column) -> Column:
    """STR5: blank lines off."""
    return F.regexp_replace(c, "\n\n+", "\n")


def single_blanks(c: Column) -> Column:
    """STR6: runs of blanks, tabs and line feeds become one blank."""
    return F.regexp_replace(c, "[ \t\n]+", " ")


def masked_numbers(c: Column) -> Column:
    """STR7: every digit becomes ``#``."""
    return F.regexp_replace(c, "[0-9]", "#")


def words(c: Column) -> Column:
    """STR8: the pieces between white space, none empty."""
    return F.filter(F.split(c, r"\s+"), lambda t: t != "")


def words_and_signs(c: Column) -> Column:
    """STR9: runs of word characters and runs of other signs."""
    return F.regexp_extract_all(c, F.lit(r"(?U)\w+|[^\w\s]+"), F.lit(0))


def tokens_with_breaks(c: Column) -> Column:
    """STR10: words, single signs and line feeds."""
    return F.regexp_extract_all(c, F.lit(r"(?U)\w+|\n|[^\w\s]"), F.lit(0))


def escaped(c: Column) -> Column:
    """STR11: ``#`` as ``\\#``, so that a data row isn't read as a comment."""
    return F.replace(c, F.lit("#"), F.lit("\\#"))


def two_decimals(c: Column, percent: bool = False) -> Column:
    """STR12."""
    return F.format_string("%.2f", (c * 100 if percent else c).cast("double"))
