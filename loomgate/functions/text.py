"""Text expressions shared by several operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A word is a longest run of letters and digits.
WORD = r"[\p{L}\p{N}]+"


def words(c: Column) -> Column:
    """Lower-case words of ``c`` in order; null and empty texts have none."""
    return F.coalesce(F.regexp_extract_all(F.lower(c), F.lit(WORD), F.lit(0)), F.array().cast("array<string>"))


def plain(c: Column) -> Column:
    """Without outer blanks and case."""
    return F.lower(F.trim(c))


def session_key(c: Column) -> Column:
    """Session ids are written in any case, with stray blanks and / for :."""
    return F.translate(plain(c), "/", ":")
