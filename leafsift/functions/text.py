"""Text expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words are runs of two or more letters, digits or underscores.
WORD = r"([\p{L}\p{N}_]{2,})"


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(1))


def keyword_csv(keywords: Column) -> Column:
    return F.array_join(F.transform(keywords, lambda k: F.lower(k)), ",")


def bytes_without_spaces(text: Column) -> Column:
    return F.octet_length(F.replace(text, F.lit(" "), F.lit("")))


def safe_int(text: Column) -> Column:
    """Empty text counts as 0; anything else must be a number."""
    return F.when(text == "", F.lit(0)).otherwise(text.cast("int"))


def three_decimals(number: Column) -> Column:
    return F.format_string("%.3f", F.coalesce(number.cast("double"), F.lit(-1.0)))


def first_or_empty(values: Column) -> Column:
    return F.coalesce(F.try_element_at(values, F.lit(1)), F.lit(""))


def pick(values: Column, positions: Column) -> Column:
    """Elements of ``values`` at zero-based ``positions``, in that order."""
    return F.transform(positions, lambda i: F.element_at(values, (i + 1).cast("int")))
