"""Prefix sums and queue recurrences in blocks.

Both are scans with an associative combination, so an order of any length is
cut into blocks; each block is scanned by a window of its own and a small
table with one row a block carries the state from block to block.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgate.session import durable

#: Rows that a block is meant to hold.
BLOCK_ROWS = 100_000


def prefix_scan(df: DataFrame, keys: list[str], block: Column, order: list[str], value: Column, name: str) -> DataFrame:
    """Running sum of ``value``, itself included, per key in the order (block, *order).

    ``block`` must rise with the order wanted.  Null values count as 0.
    """
    # read twice, so it is kept: scans in a row would else repeat all that came before
    rows = durable(df.withColumn("_block", block).withColumn("_x", F.coalesce(value, F.lit(0))), "scan")
    blocks = rows.groupBy(*keys, "_block").agg(F.sum("_x").alias("_t"))
    before = F.sum("_t").over(Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1))
    blocks = blocks.select(*keys, "_block", F.coalesce(before, F.lit(0)).alias("_before"))
    w = Window.partitionBy(*keys, "_block").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.join(blocks, [*keys, "_block"]).withColumn(name, (F.col("_before") + F.sum("_x").over(w)).cast("bigint")).drop("_block", "_x", "_before")


def lindley(jobs: DataFrame, keys: list[str], arrival: str, cost: str, order: str, block_us: int, name: str) -> DataFrame:
    """Adds ``name``: max(the one before of the key, arrival) + cost, in the order (arrival, order).

    That is S + max(arrival - (S - cost)) with S the running cost and the
    maximum over all rows up to it: two scans, both in blocks of ``block_us``
    of arrival time.  All times are whole microseconds.
    """
    w = Window.partitionBy(*keys, "_block").orderBy(arrival, order).rowsBetween(Window.unboundedPreceding, 0)
    rows = jobs.withColumn("_block", F.floor(F.col(arrival) / block_us)).withColumn("_s", F.sum(cost).over(w))
    rows = durable(rows.withColumn("_m", F.max(F.col(arrival) - (F.col("_s") - F.col(cost))).over(w)), "lindley")
    blocks = rows.groupBy(*keys, "_block").agg(F.max("_s").alias("_bs"), F.max("_m").alias("_bm"))
    before = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.withColumn("_s0", F.coalesce(F.sum("_bs").over(before), F.lit(0)))
    blocks = blocks.withColumn("_m0", F.max(F.col("_bm") - F.col("_s0")).over(before)).select(*keys, "_block", "_s0", "_m0")
    done = F.col("_s0") + F.col("_s") + F.greatest(F.col("_m") - F.col("_s0"), F.col("_m0"))
    return rows.join(blocks, [*keys, "_block"]).withColumn(name, done.cast("bigint")).drop("_block", "_s", "_m", "_s0", "_m0")


def fifo_times(jobs: DataFrame, keys: list[str], arrival: str = "arrival_us", service: str = "service_us", order: str = "event_id", block_us: int = 60_000_000) -> DataFrame:
    """Adds ``start_us``, ``completion_us`` and ``wait_us`` of a single first-come server per key without an age limit."""
    out = lindley(jobs, keys, arrival, service, order, block_us, "completion_us")
    return out.withColumn("start_us", F.col("completion_us") - F.col(service)).withColumn("wait_us", F.col("start_us") - F.col(arrival))


def busy_periods(timed: DataFrame, keys: list[str], arrival: str = "arrival_us", order: str = "event_id", block_us: int = 60_000_000) -> DataFrame:
    """Adds ``busy_id``: the number of the busy period, from 1.

    In first-come order a job opens a period exactly when it does not wait:
    its start is its arrival and lies at or after the last completion.
    """
    opens = F.when(F.col("wait_us") == 0, 1).otherwise(0)
    return prefix_scan(timed, keys, F.floor(F.col(arrival) / block_us), [arrival, order], opens, "busy_id")


def idle_groups(timed: DataFrame, keys: list[str], arrival: str = "arrival_us", order: str = "event_id", block_us: int = 60_000_000) -> DataFrame:
    """Adds ``group_id``: stretches of whole busy periods, at most one beginning in a block of arrival time.

    A group begins with the first job of a block that opens a busy period, so
    it holds about a block of jobs and only grows beyond where the server is
    never idle for longer.  Groups can be served apart from each other.
    """
    w = Window.partitionBy(*keys, "_block").orderBy(arrival, order).rowsBetween(Window.unboundedPreceding, 0)
    rows = timed.withColumn("_block", F.floor(F.col(arrival) / block_us)).withColumn("_open", F.max(F.col("wait_us") == 0).over(w))
    rows = durable(rows, "groups")
    blocks = rows.groupBy(*keys, "_block").agg(F.max("_open").alias("_any"))
    last = F.last(F.when(F.col("_any"), F.col("_block")), ignorenulls=True).over(Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1))
    blocks = blocks.select(*keys, "_block", F.coalesce(last, F.lit(-1)).alias("_last"))
    return rows.join(blocks, [*keys, "_block"]).withColumn("group_id", F.when(F.col("_open"), F.col("_block")).otherwise(F.col("_last"))).drop("_block", "_open", "_last")
