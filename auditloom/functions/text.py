"""Expressions on ledger text, where null and an empty text mean the same."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A number with decimal point, exponent allowed.
NUMBER = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"
#: JSON text that is a number, or a string that holds one between blanks.
JSON_NUMBER_TEXT = r'^(-?[0-9]+(\.[0-9]+)?([eE][+-]?[0-9]+)?|"\s*[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\s*")$'


def norm(c: Column | str) -> Column:
    """Trimmed text, null as ''."""
    return F.coalesce(F.trim(F.col(c) if isinstance(c, str) else c), F.lit(""))


def filled(c: Column | str) -> Column:
    """Trimmed text, blank as null."""
    t = F.trim(F.col(c) if isinstance(c, str) else c)
    return F.when(t != "", t)
