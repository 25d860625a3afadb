"""Spikes, stuck values and impossible readings, each against its own source.

One shuffle brings the readings of a source and a stretch of time together;
there, re-deliveries are dropped and runs of equal values are numbered.  The
normal level of a source comes from log-bucket histograms: small sketches that
are counted in every partition and hour and merged by addition.  The exact
median is then found inside the one bucket that holds it, by bucketing again
and again, so no task ever gets all readings of a large source.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomgate.functions.text import plain
from loomgate.session import durable

#: Relative width of a sketch bucket.
GAMMA = 1.05
HOUR_US = 3_600_000_000
#: Broadcast the per-source levels up to this many sources, shuffle beyond.
MAX_BROADCAST_SOURCES = 50_000


def is_finite(v):
    return v.isNotNull() & ~F.isnan(v) & (F.abs(v) != F.lit(float("inf")))


def log_bucket(v):
    """Bucket of a finite value; ordered, symmetric about zero."""
    size = F.floor(F.log(F.greatest(F.abs(v), F.lit(1e-300))) / math.log(GAMMA)) + F.lit(20_000)
    return F.when(v == 0, 0).when(v > 0, size).otherwise(-size).cast("int")


def chunk_width(df: DataFrame, source: list[str], time_us: str, chunk_rows: int) -> int:
    """Microseconds of time that hold at most about ``chunk_rows`` rows of the busiest source."""
    busiest = df.groupBy(*source, F.floor(F.col(time_us) / HOUR_US).alias("h")).count().agg(F.max("count")).first()[0] or 1
    width = HOUR_US * chunk_rows / busiest
    return max(1, int(HOUR_US * 2 ** math.floor(math.log2(width / HOUR_US))))


def prepare_readings(df: DataFrame, key: str, source: list[str], at: str, values: list[str], chunk_rows: int = 200_000) -> DataFrame:
    """Distinct readings with ``<v>__prev``, ``<v>__next`` and ``<v>__run``, as a table.

    Columns: ``_id``, the sources ``_s0``.., ``_t`` (microseconds), ``_chunk``
    and per value its number, the readings before and after it (nulls are no
    readings), the time of the one before and the number of its run of equal
    readings inside the chunk.  Rows with the same key count once, with the
    earliest time.  Rows without a time get runs of one.
    """
    cols = [F.col(key).alias("_id"), F.unix_micros(F.col(at).cast("timestamp")).alias("_t")]
    cols += [F.col(s).alias(f"_s{i}") for i, s in enumerate(source)]
    cols += [F.col(v).cast("double").alias(f"_v{i}") for i, v in enumerate(values)]
    src = [f"_s{i}" for i in range(len(source))]
    rows = df.select(*cols)
    width = chunk_width(rows, src, "_t", chunk_rows)
    others = ["_t", *src, *[f"_v{i}" for i in range(len(values))]]
    once = rows.filter(F.col("_id").isNotNull()).groupBy("_id").agg(F.min(F.struct(F.col("_t").isNull().alias("_none"), *others)).alias("r")).select("_id", *[f"r.{c}" for c in others])
    rows = once.unionByName(rows.filter(F.col("_id").isNull()))
    # a row without a time stands alone in a negative chunk of its own
    rows = rows.withColumn("_chunk", F.coalesce(F.floor(F.col("_t") / width), -1 - F.pmod(F.xxhash64("_id"), F.lit(1 << 40))))
    over = f"OVER (PARTITION BY {', '.join(src)}, _chunk ORDER BY _t, _id)"
    for i in range(len(values)):
        rows = rows.withColumn(f"_p{i}", F.expr(f"lag(_v{i}) IGNORE NULLS {over}")).withColumn(f"_n{i}", F.expr(f"lead(_v{i}) IGNORE NULLS {over}"))
        rows = rows.withColumn(f"_pt{i}", F.expr(f"lag(if(_v{i} is null, null, _t)) IGNORE NULLS {over}"))
    for i in range(len(values)):
        starts = F.col(f"_v{i}").isNotNull() & ~F.col(f"_v{i}").eqNullSafe(F.col(f"_p{i}"))
        rows = rows.withColumn(f"_r{i}", F.sum(F.when(starts, 1).otherwise(0)).over(Window.partitionBy(*src, "_chunk").orderBy("_t", "_id").rowsBetween(Window.unboundedPreceding, 0)).cast("int"))
    return durable(rows, "readings")


def _long(prepared: DataFrame, n_values: int, *keep: str) -> DataFrame:
    """One row a finite reading: ``_m`` says which value column it is of."""
    each = F.explode(F.array(*[F.struct(F.lit(i).alias("_m"), F.col(f"_v{i}").alias("_v")) for i in range(n_values)])).alias("x")
    src = [c for c in prepared.columns if c.startswith("_s")]
    return prepared.select(*src, *keep, each).select(*src, *keep, "x._m", "x._v").filter(is_finite(F.col("_v")))


def _hour_of(t: str):
    return F.pmod(F.floor(F.col(t) / HOUR_US), F.lit(24))


def level_sketch(prepared: DataFrame, n_values: int) -> DataFrame:
    """Histogram sketch by source, value column and hour of the day; mergeable by adding counts."""
    src = [c for c in prepared.columns if c.startswith("_s")]
    return _long(prepared.withColumn("_hour", _hour_of("_t")), n_values, "_hour").groupBy(*src, "_m", "_hour", log_bucket(F.col("_v")).alias("_b")).agg(
        F.count(F.lit(1)).alias("_c"), F.min("_v").alias("_min"), F.max("_v").alias("_max")
    )


def _narrow(hist: DataFrame, keys: list[str]) -> DataFrame:
    """The stretch of values that holds the two middle ranks. hist: keys, _b, _c, _min, _max, _before, _n."""
    w = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, 0)
    cum = hist.withColumn("_cum", F.col("_before") + F.sum("_c").over(w))
    low, high = F.floor((F.col("_n") - 1) / 2), F.floor(F.col("_n") / 2)
    return (
        cum.filter((F.col("_cum") > low) & (F.col("_cum") - F.col("_c") <= high))
        .groupBy(*keys, "_n")
        .agg(F.min("_min").alias("_lo"), F.max("_max").alias("_hi"), F.min(F.col("_cum") - F.col("_c")).alias("_before"), F.sum("_c").alias("_inside"))
    )


def exact_medians(prepared: DataFrame, sketch: DataFrame, n_values: int, limit: int = 100_000) -> DataFrame:
    """Exact median of the finite readings by source and value column (``_m``, ``_median``).

    Starts from the sketch and splits the stretch that holds the middle ranks
    into 1,024 until at most ``limit`` readings, or one value, are left in it.
    """
    src = [c for c in prepared.columns if c.startswith("_s")]
    keys = [*src, "_m"]
    hist = sketch.groupBy(*keys, "_b").agg(F.sum("_c").alias("_c"), F.min("_min").alias("_min"), F.max("_max").alias("_max"))
    total = F.sum("_c").over(Window.partitionBy(*keys))
    state = durable(_narrow(hist.withColumn("_n", total).withColumn("_before", F.lit(0)), keys), "median")
    readings = _long(prepared, n_values)

    def inside(state: DataFrame) -> DataFrame:
        small = state.select(*[F.col(k).alias("k" + k) for k in keys], "_n", "_lo", "_hi", "_before")
        if state.count() <= MAX_BROADCAST_SOURCES * n_values:
            small = F.broadcast(small)
        on = [F.col(k).eqNullSafe(F.col("k" + k)) for k in keys]
        return readings.join(small, on).drop(*["k" + k for k in keys]).filter(F.col("_v").between(F.col("_lo"), F.col("_hi")))

    for _ in range(64):
        if not state.filter((F.col("_inside") > limit) & (F.col("_lo") < F.col("_hi"))).limit(1).count():
            break
        part = F.when(F.col("_hi") > F.col("_lo"), F.least(F.lit(1023), F.floor((F.col("_v") - F.col("_lo")) / (F.col("_hi") - F.col("_lo")) * 1024))).otherwise(0)
        finer = inside(state).groupBy(*keys, "_n", "_before", part.alias("_b")).agg(F.count(F.lit(1)).alias("_c"), F.min("_v").alias("_min"), F.max("_v").alias("_max"))
        state = durable(_narrow(finer, keys), "median")
    values = inside(state).groupBy(*keys, "_n", "_before", F.col("_v").alias("_b")).agg(F.count(F.lit(1)).alias("_c"))
    found = _narrow(values.withColumn("_min", F.col("_b")).withColumn("_max", F.col("_b")), keys)
    return found.select(*keys, ((F.col("_lo") + F.col("_hi")) / 2).alias("_median"))


def frozen_ids(prepared: DataFrame, i: int, least: int) -> DataFrame:
    """Ids of readings of value ``i`` in runs of ``least`` or more equal readings, also across chunks."""
    src = [c for c in prepared.columns if c.startswith("_s")]
    v, p, n, r = (F.col(f"_{x}{i}") for x in "vpnr")
    near = prepared.filter(F.col("_t").isNotNull() & v.isNotNull() & (p.isNull() | n.isNull() | (v == p) | (v == n)))
    keys = [*src, "_chunk", f"_r{i}"]
    runs = near.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_len"), F.first(v).alias("_v"), F.max(p.isNull()).alias("_first"), F.max(n.isNull()).alias("_last")
    )
    edges = runs.filter(F.col("_first") | F.col("_last"))
    w = Window.partitionBy(*src).orderBy("_chunk", f"_r{i}")
    linked = (F.lag("_chunk").over(w) != F.col("_chunk")) & (F.lag("_v").over(w) == F.col("_v")) & F.lag("_last").over(w) & F.col("_first")
    chains = edges.withColumn("_chain", F.sum(F.when(linked, 0).otherwise(1)).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    chains = chains.withColumn("_len", F.sum("_len").over(Window.partitionBy(*src, "_chain")))
    long_runs = runs.filter(~F.col("_first") & ~F.col("_last")).select(*keys, "_len").unionByName(chains.select(*keys, "_len")).filter(F.col("_len") >= least).drop("_len")
    renamed = long_runs.select(*[F.col(k).alias("k" + k) for k in keys])
    return near.join(renamed, [F.col(k).eqNullSafe(F.col("k" + k)) for k in keys], "left_semi").select("_id")


def _fences(sketch: DataFrame, expand: float) -> DataFrame:
    """``_q1, _q3, _low, _high, _n`` by source, value column and hour of the day, from the merged sketch."""
    keys = [*[c for c in sketch.columns if c.startswith("_s")], "_m", "_hour"]
    w = Window.partitionBy(*keys)
    cum = sketch.withColumn("_cum", F.sum("_c").over(w.orderBy("_b").rowsBetween(Window.unboundedPreceding, 0))).withColumn("_n", F.sum("_c").over(w))
    quart = cum.groupBy(*keys).agg(
        F.max("_n").alias("_n"), F.min(F.when(F.col("_cum") >= F.col("_n") * 0.25, F.col("_max"))).alias("_q1"), F.min(F.when(F.col("_cum") >= F.col("_n") * 0.75, F.col("_max"))).alias("_q3")
    )
    spread = F.greatest(F.col("_q3") - F.col("_q1"), F.abs(F.col("_q3")) * (GAMMA - 1)) * expand
    return quart.withColumn("_low", F.col("_q1") - spread).withColumn("_high", F.col("_q3") + spread)


def sudden_ids(prepared: DataFrame, levels: DataFrame, i: int, jump: float, within_us: int) -> DataFrame:
    """Ids of readings of value ``i`` more than ``jump`` times above or below the one before, of at most ``within_us`` earlier.

    Of the two the one farther from the level of the source is meant.  The
    first reading of a chunk is held against the last one of the chunk before.
    """
    src = [c for c in prepared.columns if c.startswith("_s")]
    v = F.col(f"_v{i}")
    rows = prepared.filter(F.col("_t").isNotNull() & v.isNotNull()).select(*src, "_id", "_t", v.alias("_v"), F.col(f"_p{i}").alias("_p"), F.col(f"_pt{i}").alias("_pt"), F.col(f"_n{i}").alias("_n"))
    w = Window.partitionBy(*src).orderBy("_t", "_id")
    edges = rows.filter(F.col("_p").isNull() | F.col("_n").isNull()).withColumn("_lp", F.lag("_v").over(w)).withColumn("_lt", F.lag("_t").over(w))
    edges = edges.filter(F.col("_p").isNull()).select(*src, "_id", "_t", "_v", F.col("_lp").alias("_p"), F.col("_lt").alias("_pt"))
    both = rows.filter(F.col("_p").isNotNull()).drop("_n").unionByName(edges).filter(is_finite(F.col("_v")) & is_finite(F.col("_p")) & (F.col("_v") > 0) & (F.col("_p") > 0))
    ratio = F.greatest(F.col("_v") / F.col("_p"), F.col("_p") / F.col("_v"))
    steep = both.filter((ratio > jump) & (F.col("_t") - F.col("_pt") <= within_us))
    off = lambda c: F.abs(F.log(F.col(c) / F.col(f"_med{i}")))
    return steep.join(levels, [F.col(s).eqNullSafe(F.col("k" + s)) for s in src]).filter((F.col(f"_med{i}") > 0) & (off("_v") > off("_p"))).select("_id")


def flag_readings(
    df: DataFrame,
    key: str = "measurement_id",
    source: tuple[str, ...] = ("tier", "runner_id"),
    at: str = "measured_at",
    values: tuple[str, ...] = ("wall_ms", "cuda_ms"),
    status: str | None = "status",
    factor: float = 4.0,
    frozen: int = 8,
    part_excess: float | None = 0.05,
    expand: float = 3.0,
    jump: float = 4.0,
    jump_within_us: int = HOUR_US,
    chunk_rows: int = 200_000,
) -> DataFrame:
    """Keys of faulty readings with the reasons: ``<key>, reasons array<string>``.

    ``df`` is the raw table; only rows whose status is ok count, a key counts
    once, nulls are no readings.  A reading is a candidate when it lies outside
    the fence of its source and hour of the day: ``expand`` interquartile
    ranges beyond the quartiles of the sketch, but never farther out than
    ``factor`` times the source's level or its ``factor``-th part.  An exact
    check against the median follows.  Reasons:

    * ``impossible``: not finite, or zero or less;
    * ``fence``: outside the fence of the hour;
    * ``level``: outside the fence, and over ``factor`` times the source's
      exact median of that column or under its ``factor``-th part;
    * ``sudden``: more than ``jump`` times above or below the reading before, if
      that is at most ``jump_within_us`` old, and the farther of both from the median;
    * ``frozen``: no variance in ``frozen`` or more successive readings;
    * ``excess``: the second value is above the first by more than ``part_excess`` of it.

    A null source is a source of its own; rows with a null key are kept apart
    and returned with a null key.  An empty table gives an empty result.
    """
    rows = df.filter(plain(F.col(status)) == "ok") if status else df
    prepared = prepare_readings(rows, key, list(source), at, list(values), chunk_rows)
    n = len(values)
    src = [c for c in prepared.columns if c.startswith("_s")]
    sketch = durable(level_sketch(prepared, n), "sketch")
    medians = exact_medians(prepared, sketch, n)
    levels = durable(medians.groupBy(*[F.col(s).alias("k" + s) for s in src]).agg(*[F.max(F.when(F.col("_m") == i, F.col("_median"))).alias(f"_med{i}") for i in range(n)]), "levels")
    side = F.broadcast(levels) if levels.count() <= MAX_BROADCAST_SOURCES else levels
    sides = [c for i in range(n) for c in (F.max(F.when(F.col("_m") == i, F.col("_low"))).alias(f"_low{i}"), F.max(F.when(F.col("_m") == i, F.col("_high"))).alias(f"_high{i}"))]
    fences = durable(_fences(sketch, expand).groupBy(*[F.col(s).alias("f" + s) for s in src], F.col("_hour").alias("f_hour")).agg(*sides), "fences")
    by_hour = F.broadcast(fences) if fences.count() <= MAX_BROADCAST_SOURCES else fences
    reasons = []
    for i in range(n):
        v, med = F.col(f"_v{i}"), F.col(f"_med{i}")
        high, low = (F.when(med > 0, c).otherwise(f) for c, f in ((F.least(f"_high{i}", med * factor), F.col(f"_high{i}")), (F.greatest(f"_low{i}", med / factor), F.col(f"_low{i}"))))
        outside = is_finite(v) & ((v > high) | (v < low))
        reasons.append(F.when(v.isNotNull() & (~is_finite(v) | (v <= 0)), F.lit("impossible")))
        reasons.append(F.when(outside, F.lit("fence")))
        reasons.append(F.when(is_finite(v) & (outside | (med <= 0)) & ((v > med * factor) | (v < med / factor)), F.lit("level")))
    if part_excess is not None and n > 1:
        reasons.append(F.when(is_finite(F.col("_v0")) & is_finite(F.col("_v1")) & (F.col("_v1") > F.col("_v0") * (1 + part_excess)), F.lit("excess")))
    of_source = [F.col(s).eqNullSafe(F.col("k" + s)) for s in src]
    of_hour = [*[F.col(s).eqNullSafe(F.col("f" + s)) for s in src], _hour_of("_t").eqNullSafe(F.col("f_hour"))]
    flagged = prepared.join(side, of_source, "left").join(by_hour, of_hour, "left").select("_id", F.array_compact(F.array(*reasons)).alias("r")).filter(F.size("r") > 0)
    for i in range(n):
        flagged = flagged.unionByName(frozen_ids(prepared, i, frozen).select("_id", F.array(F.lit("frozen")).alias("r")))
        flagged = flagged.unionByName(sudden_ids(prepared, side, i, jump, jump_within_us).select("_id", F.array(F.lit("sudden")).alias("r")))
    return flagged.groupBy(F.col("_id").alias(key)).agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("r")))).alias("reasons"))


def hour_fences(df: DataFrame, key: str = "measurement_id", source: tuple[str, ...] = ("tier", "runner_id"), at: str = "measured_at", values: tuple[str, ...] = ("wall_ms", "cuda_ms"), status: str | None = "status", expand: float = 3.0) -> DataFrame:
    """Fences by source, value column and hour of the day, from merged sketches.

    Quartiles are the largest readings of buckets of the log-bucket sketch
    (relative error below GAMMA - 1); the fences are ``expand`` interquartile
    ranges outside them, but never tighter than one bucket.  Hours without
    readings have no row.
    """
    rows = df.filter(plain(F.col(status)) == "ok") if status else df
    prepared = prepare_readings(rows, key, list(source), at, list(values))
    quart = _fences(level_sketch(prepared, len(values)), expand)
    names = F.element_at(F.array(*[F.lit(v) for v in values]), F.col("_m") + 1).alias("metric")
    return quart.select(*[F.col(f"_s{i}").alias(s) for i, s in enumerate(source)], names, F.col("_hour").alias("hour"), *[F.col("_" + c).alias(c) for c in ("n", "q1", "q3", "low", "high")])
