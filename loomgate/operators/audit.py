"""Rule suites: every rule is a named predicate, the result one row a rule."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def check_rules(df: DataFrame, rules: dict[str, Column], by: list[str] | None = None) -> DataFrame:
    """``rule, n_rows, n_failed`` (and ``by``): how many rows break each rule.

    All rules are evaluated in one scan and one aggregation.  A predicate that
    is null counts as broken.
    """
    keys = by or []
    wide = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows"), *[F.count_if(~F.coalesce(c, F.lit(False))).alias(r) for r, c in rules.items()])
    each = F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), F.col(r).alias("n_failed")) for r in rules])).alias("x")
    return wide.select(*keys, "n_rows", each).select(*keys, "x.rule", "n_rows", "x.n_failed")


def failing_rows(df: DataFrame, key: str, rules: dict[str, Column]) -> DataFrame:
    """``key, failed``: the names of the rules each failing row breaks."""
    names = F.array_compact(F.array(*[F.when(~F.coalesce(c, F.lit(False)), F.lit(r)) for r, c in rules.items()]))
    return df.select(key, names.alias("failed")).filter(F.size("failed") > 0)
