"""Small statistical expressions and exact percentiles."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgate.session import discard, durable

#: Rows up to which percentiles are taken in one aggregation; beyond, ranks are found by splitting.
DIRECT_ROWS = 1_000_000


def jain(x: Column) -> Column:
    """Jain's fairness index of non-negative loads; 1 where all are zero."""
    v = F.greatest(x.cast("double"), F.lit(0.0))
    return F.when(F.sum(v * v) > 0, F.pow(F.sum(v), 2) / (F.count(F.lit(1)) * F.sum(v * v))).otherwise(1.0)


def clamp_probability(p: Column) -> Column:
    """Into [0, 1]; null where it is not a finite number."""
    return F.when(~F.isnan(p) & (F.abs(p) != float("inf")), F.greatest(F.lit(0.0), F.least(F.lit(1.0), p)))


def strict_probability(p: Column, what: str = "probability") -> Column:
    """``clamp_probability`` that fails on a null, NaN or infinity."""
    return F.coalesce(clamp_probability(p), F.raise_error(F.lit(f"{what} is not a finite number")).cast("double"))


def zero_error_bound(n: Column, alpha: float = 0.05) -> Column:
    """Exact upper bound on a rate after n trials without an error."""
    return 1 - F.pow(F.lit(alpha), 1 / n)


def next_down(x: Column) -> Column:
    """The largest double below a finite x."""
    return F.call_function("java_method", F.lit("java.lang.Math"), F.lit("nextDown"), x.cast("double")).cast("double")


def exact_percentiles(df: DataFrame, keys: list[str], value: str, qs: dict[str, float], direct: int | None = None) -> DataFrame:
    """``keys, n`` and linearly interpolated percentiles per group; nulls do not count.

    ``df`` should be cheap to read several times (a table).  Up to ``direct``
    rows it is one aggregation over the counts of equal values.  Beyond, the
    two ranks around each percentile are found by counting in buckets and
    splitting only the buckets that hold one, so no task holds more than
    ``direct`` values whatever the size of a group.
    """
    limit = DIRECT_ROWS if direct is None else direct
    known = df.filter(F.col(value).isNotNull()).select(*keys, F.col(value).cast("double").alias("_v"))
    if known.count() <= limit:
        counted = known.groupBy(*keys, "_v").agg(F.count(F.lit(1)).alias("_n"))
        return counted.groupBy(*keys).agg(F.sum("_n").alias("n"), *[F.percentile("_v", q, F.col("_n")).alias(name) for name, q in qs.items()])
    near = [F.array(F.floor((F.col("n") - 1) * F.lit(float(q))), F.ceil((F.col("n") - 1) * F.lit(float(q)))) for q in sorted(set(qs.values()))]
    found = values_at(known, keys, F.array_distinct(F.flatten(F.array(*near))), limit)
    at = lambda q: (F.col("n") - 1) * F.lit(float(q))
    pick = lambda rank: F.max(F.when(F.col("_rank") == rank, F.col("_v")))
    ends = [c for name, q in qs.items() for c in (pick(F.floor(at(q))).alias(f"_a_{name}"), pick(F.ceil(at(q))).alias(f"_b_{name}"))]
    wide = found.groupBy(*keys, "n").agg(*ends)
    value_at = lambda name, q: F.col(f"_a_{name}") + (F.col(f"_b_{name}") - F.col(f"_a_{name}")) * (at(q) - F.floor(at(q)))
    return wide.select(*keys, "n", *[value_at(name, q).alias(name) for name, q in qs.items()])


def grouped_percentiles(df: DataFrame, keys: list[str], aggregates: list[Column], values: dict[str, dict[str, float]]) -> DataFrame:
    """``df.groupBy(keys).agg(aggregates)`` with percentiles ``{column: {name: q}}`` beside; one aggregation up to DIRECT_ROWS rows."""
    if df.count() <= DIRECT_ROWS:
        ps = [F.percentile(v, q).alias(name) for v, qs in values.items() for name, q in qs.items()]
        return df.groupBy(*keys).agg(*aggregates, *ps)
    out = df.groupBy(*keys).agg(*aggregates)
    for v, qs in values.items():
        ps = exact_percentiles(df, keys, v, qs).drop("n")
        named = ps.select(*[F.col(k).alias(f"_k_{k}") for k in keys], *qs)
        out = out.join(named, _same(out, named, keys), "left").drop(*[f"_k_{k}" for k in keys])
    return out


def _same(left: DataFrame, right: DataFrame, keys: list[str]) -> list[Column]:
    return [left[k].eqNullSafe(right[f"_k_{k}"]) for k in keys]


def values_at(rows: DataFrame, keys: list[str], ranks: Column, limit: int) -> DataFrame:
    """``keys, n, _rank, _v``: the values of ``_v`` at the 0-based ``ranks``, an array over the size ``n`` of the group.

    No task holds more than ``limit`` rows of a group, unless they are equal.
    """
    size = F.floor(F.log(F.greatest(F.abs("_v"), F.lit(1e-300))) / math.log(1.05)) + 20_000
    sign = F.when(F.col("_v") == 0, 0).when(F.col("_v") > 0, size).otherwise(-size)
    hist = rows.groupBy(*keys, sign.cast("bigint").alias("_b")).agg(F.count(F.lit(1)).alias("_c"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
    hist = hist.withColumn("n", F.sum("_c").over(Window.partitionBy(*keys))).withColumn("_base", F.lit(0).cast("bigint"))

    def holding(hist: DataFrame, part: list[str]) -> DataFrame:
        """Buckets that hold a wanted rank, with the number of rows before them."""
        w = Window.partitionBy(*keys, *part).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
        placed = hist.withColumn("_base", F.col("_base") + F.coalesce(F.sum("_c").over(w), F.lit(0)))
        mine = F.filter(ranks, lambda r: (r >= F.col("_base")) & (r < F.col("_base") + F.col("_c")))
        return placed.withColumn("_ranks", mine).filter(F.size("_ranks") > 0).select(*keys, "n", "_base", "_c", "_lo", "_hi", "_ranks")

    state = durable(holding(hist, []), "ranks")
    while True:
        wide = state.filter((F.col("_c") > limit) & (F.col("_lo") < F.col("_hi")))
        if not wide.limit(1).count():
            break
        small = state.filter((F.col("_c") <= limit) | (F.col("_lo") >= F.col("_hi")))
        names = wide.select(*[F.col(k).alias(f"_k_{k}") for k in keys], "n", "_base", "_lo", "_hi")  # a few a group
        inside = rows.join(names, [*_same(rows, names, keys), rows["_v"].between(names["_lo"], names["_hi"])]).drop(*[f"_k_{k}" for k in keys])
        cell = F.least(F.lit(1023), F.floor((F.col("_v") - F.col("_lo")) / (F.col("_hi") - F.col("_lo")) * 1024)).alias("_b")
        finer = inside.groupBy(*keys, "n", "_base", F.col("_lo").alias("_from"), cell).agg(F.count(F.lit(1)).alias("_c"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
        fresh = durable(small.unionByName(holding(finer, ["_from"])), "ranks")
        discard(state)
        state = fresh
    flat = state.filter("_lo = _hi").select(*keys, "n", F.explode("_ranks").alias("_rank"), F.col("_lo").alias("_v"))
    open_ = state.filter("_lo < _hi")
    names = open_.select(*[F.col(k).alias(f"_k_{k}") for k in keys], "n", "_base", "_lo", "_hi", "_ranks")
    inside = rows.join(names, [*_same(rows, names, keys), rows["_v"].between(names["_lo"], names["_hi"])]).drop(*[f"_k_{k}" for k in keys])
    w = Window.partitionBy(*keys, "_base").orderBy("_v")
    at = inside.withColumn("_rank", F.col("_base") + F.row_number().over(w) - 1)
    return flat.unionByName(at.filter(F.array_contains("_ranks", F.col("_rank"))).select(*keys, "n", "_rank", "_v"))
