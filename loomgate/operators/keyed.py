"""Joins and ranks that hold up when one key owns a third of the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgate.session import durable

#: Rows of hot keys that are broadcast, at most; with more hot keys the join is salted instead.
MAX_HOT_KEYS = 10_000
#: A key with more rows than this is hot, whatever its share of the table.
MIN_HOT_ROWS = 200_000


def hot_keys(df: DataFrame, keys: list[str], rows: int) -> DataFrame | None:
    """``keys, _n`` of the keys with more than ``rows`` rows, as a table; None where there are none.

    ``df`` should be a table: its rows are counted first, and the keys only
    where any of them can be hot.  Null keys are never hot.
    """
    if df.count() <= rows:
        return None
    known = df.filter(F.expr(" and ".join(f"`{k}` is not null" for k in keys)))
    hot = durable(known.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > rows), "hot")
    return hot if hot.limit(1).count() else None


def salted_join(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner", rows: int = MIN_HOT_ROWS) -> DataFrame:
    """Equi-join in which a hot key of ``left`` is dealt over as many tasks as it has ``rows`` rows.

    The rows of ``right`` with a hot key are repeated once a task, all others
    stay single.  ``how`` is inner, left, left_semi or left_anti; null keys match nothing.
    """
    hot = hot_keys(left, keys, rows)
    if hot is None:
        return left.join(right, keys, how)
    hot = hot.withColumn("_parts", F.ceil(F.col("_n") / rows).cast("int")).drop("_n")
    if hot.count() <= MAX_HOT_KEYS:
        hot = F.broadcast(hot)
    parts = F.coalesce("_parts", F.lit(1))
    dealt = left.join(hot, keys, "left").withColumn("_salt", F.pmod(F.xxhash64(*left.columns), parts).cast("int")).drop("_parts")
    spread = right.join(hot, keys, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), parts - 1))).drop("_parts")
    return dealt.join(spread, [*keys, "_salt"], how).drop("_salt")


def lookup_join(facts: DataFrame, dim: DataFrame, key: str, how: str = "inner", min_hot: int = MIN_HOT_ROWS) -> DataFrame:
    """Join ``facts`` with ``dim`` (at most one row a key) without a hot task.

    Keys with more than ``min_hot`` rows go through a broadcast of just their
    rows of ``dim`` while there are at most MAX_HOT_KEYS of them, and are
    salted beyond; all other keys are joined by shuffle.  ``facts`` should be
    cheap to read twice (a table).  ``how`` is inner or left; null keys match nothing.
    """
    hot = hot_keys(facts, [key], min_hot)
    if hot is None:
        return facts.join(dim, key, how)
    if hot.count() > MAX_HOT_KEYS:
        return salted_join(facts, dim, [key], how, min_hot)
    names = F.broadcast(hot.select(key))  # at most MAX_HOT_KEYS rows
    cold = facts.join(names, key, "left_anti").join(dim, key, how)
    return cold.unionByName(facts.join(names, key, "left_semi").join(F.broadcast(dim.join(names, key, "left_semi")), key, how))


def global_position(df: DataFrame, order: list[Column], name: str = "pos", parts: int | None = None) -> DataFrame:
    """0-based position of each row in the total order ``order``, as a table.

    Range partitioning, a sort inside each partition and one offset a
    partition: no window over all rows.  ``order`` must be total.  The driver
    sees, and sends back, one number a partition.
    """
    spark = df.sparkSession
    n = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.repartitionByRange(n, *order).sortWithinPartitions(*order)
    numbered = durable(ranged.withColumn("_mid", F.monotonically_increasing_id()), "position")
    part = F.shiftright("_mid", 33)
    sizes = sorted((r[0], r[1]) for r in numbered.groupBy(part.alias("p")).count().collect())
    offsets, total = {}, 0
    for p, size in sizes:
        offsets[p], total = total, total + size
    if not offsets:
        return numbered.withColumn(name, F.lit(0).cast("bigint")).drop("_mid")
    lookup = spark.createDataFrame(sorted(offsets.items()), "_part bigint, _offset bigint")
    within = F.col("_mid").bitwiseAND(F.lit((1 << 33) - 1))
    placed = numbered.withColumn("_part", part).join(F.broadcast(lookup), "_part")
    return placed.withColumn(name, F.col("_offset") + within).drop("_mid", "_part", "_offset")
