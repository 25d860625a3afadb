"""A sample with wished shares per category.

Every member of a cell gets the same inclusion probability; members lie in
random order inside the cells, and the cells one after another.  One random
start and the crossings of whole numbers by the running sum of probabilities
pick the sample: each cell gets its expected number rounded up or down.  Cells
left under their floor then get the next members in the same random order.
The running sum needs a row's position only, which comes from range
partitioning and one offset a partition; no cell is ever in one task.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomgate.functions.text import plain
from loomgate.operators.keyed import global_position
from loomgate.session import durable

#: Fixed-point unit of inclusion probabilities.
UNIT = 1 << 20
CELL = ["source", "hard_required", "input_length_tercile"]


def profiled_cells(selection: DataFrame, records: DataFrame) -> DataFrame:
    """Distinct ``event_id`` with its cell; actions without a tercile or a record are in none."""
    chosen = selection.filter(F.col("input_length_tercile").isNotNull()).select("event_id", plain(F.col("input_length_tercile")).alias("input_length_tercile")).distinct()
    known = records.select("event_id", plain(F.col("source")).alias("source"), "hard_required").distinct()
    return chosen.join(known, "event_id").select("event_id", *CELL).distinct()


def cell_report(frame: DataFrame, targets: DataFrame) -> DataFrame:
    """One row a target: ``target_id``, its cell, ``target_share``, ``wanted``, ``n_floor``, ``available``, ``met``.

    A target wants the larger of ``min_rows`` and ``target_share *
    sample_size`` members.  A cell nobody is in has 0 available; a target with
    a null in its cell matches no member.
    """
    have = frame.groupBy(*CELL).agg(F.countDistinct("event_id").alias("available"))
    wished = targets.select("target_id", plain(F.col("source")).alias("source"), "hard_required", plain(F.col("input_length_tercile")).alias("input_length_tercile"), "target_share", "min_rows", "sample_size")
    out = wished.join(have, CELL, "left").withColumn("available", F.coalesce("available", F.lit(0)).cast("bigint"))
    wanted = F.greatest(F.coalesce(F.col("min_rows"), F.lit(0)).cast("double"), F.coalesce(F.col("target_share") * F.col("sample_size"), F.lit(0.0)))
    out = out.withColumn("wanted", wanted).withColumn("n_floor", F.least(F.coalesce("min_rows", F.lit(0)), "available").cast("bigint"))
    return out.select("target_id", *CELL, "target_share", "wanted", "n_floor", "available", (F.col("available") >= F.col("wanted")).alias("met"))


def start_of(seed: str) -> int:
    """The random start, in units of 1 / UNIT."""
    return int.from_bytes(hashlib.md5(seed.encode()).digest()[:4], "big") % UNIT


def quota_sample(frame: DataFrame, report: DataFrame, seed: str = "quota") -> DataFrame:
    """``target_id, event_id`` of the sample; ``report`` is a ``cell_report``.

    Deterministic in the seed and the set of members.  A cell gets its wanted
    number (all members, where fewer are there) rounded up or down, and never
    less than its floor.  Two targets with the same cell draw separately.
    """
    plan = report.withColumn("total", F.round(F.least("wanted", F.col("available").cast("double")) * UNIT).cast("bigint"))
    order = Window.orderBy("target_id").rowsBetween(Window.unboundedPreceding, -1)  # one row a target
    plan = durable(
        plan.withColumn("first", F.coalesce(F.sum("available").over(order), F.lit(0))).withColumn("base", F.coalesce(F.sum("total").over(order), F.lit(0))), "plan"
    )
    small = plan.select("target_id", *CELL, "n_floor", "available", "total", "first", "base")
    placed = frame.join(small.select("target_id", *CELL), CELL).select("target_id", F.md5(F.concat_ws("|", F.lit(seed), "target_id", "event_id")).alias("h"), "event_id")
    placed = global_position(placed, [F.col("target_id"), F.col("h"), F.col("event_id")])
    u = start_of(seed)

    def crossing(rank):
        share = F.floor(F.col("total").cast("decimal(20,0)") * rank.cast("decimal(18,0)") / F.col("available"))
        return F.floor((F.col("base") + share + F.lit(u)) / UNIT)

    ranked = placed.join(small.drop(*CELL), "target_id").withColumn("rank", F.col("pos") - F.col("first") + 1)
    ranked = ranked.withColumn("chosen", crossing(F.col("rank")) > crossing(F.col("rank") - 1))
    got = durable(ranked.groupBy("target_id", "n_floor").agg(F.sum(F.col("chosen").cast("bigint")).alias("got")).filter(F.col("got") < F.col("n_floor")), "repair")
    first = ranked.filter("chosen").select("target_id", "event_id")
    # the first n_floor ranks hold at least n_floor - got rows that were not chosen
    spare = ranked.filter(~F.col("chosen") & (F.col("rank") <= F.col("n_floor"))).join(got.select("target_id", "got"), "target_id")
    spare = spare.withColumn("k", F.row_number().over(Window.partitionBy("target_id").orderBy("rank"))).filter(F.col("k") <= F.col("n_floor") - F.col("got"))
    return first.unionByName(spare.select("target_id", "event_id"))


def sample_report(sample: DataFrame, report: DataFrame) -> DataFrame:
    """What ``sample`` reached of each target of ``report``: adds ``drawn``, ``wished_share``, ``drawn_share`` and ``met``.

    A target is unmet when the sampler took every member of its cell and that
    is fewer than wanted.  An empty sample has shares of 0.
    """
    got = sample.groupBy("target_id").agg(F.count(F.lit(1)).alias("drawn"))
    out = report.drop("met").join(F.broadcast(got), "target_id", "left").withColumn("drawn", F.coalesce("drawn", F.lit(0).cast("bigint")))  # one row a target
    total = F.sum("drawn").over(Window.partitionBy())
    exhausted = (F.col("drawn") >= F.col("available")) & (F.col("available") < F.col("wanted"))
    share = F.when(total > 0, F.col("drawn") / total).otherwise(0.0)
    return out.select("*", F.coalesce("target_share", F.lit(0.0)).alias("wished_share"), share.alias("drawn_share"), (~exhausted).alias("met"))
