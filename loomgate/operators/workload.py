"""Synthetic traffic: arrivals, tenants, service draws, thresholds, routes.

All randomness is a hash of the identifiers, so a trace is the same on every
run and partitioning.  Times are whole microseconds.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgate.functions.hashing import stable_key, uniform
from loomgate.functions.stats import clamp_probability, next_down, zero_error_bound
from loomgate.operators.keyed import global_position
from loomgate.operators.scans import BLOCK_ROWS, prefix_scan
from loomgate.session import durable


@dataclass(frozen=True)
class Regime:
    """Offered load of a trace; ``peak`` and ``duty`` make it a two-state modulated process."""

    name: str
    rho: float
    peak: float | None = None
    to_peak: float = 0.05
    duty: float = 0.2

    def __post_init__(self) -> None:
        if self.rho <= 0 or (self.peak is not None and self.peak <= 0):
            raise ValueError("offered loads must be positive")
        if self.peak is not None and not (0 < self.duty < 1 and 0 < self.to_peak <= 1 and 0 < self.to_background <= 1):
            raise ValueError("the probabilities of the modulated process must lie in (0, 1]")

    @property
    def to_background(self) -> float:
        return self.to_peak * (1 - self.duty) / self.duty


# Offered loads of the published replays.
REGIMES = (Regime("low", 0.35), Regime("near_saturation", 0.8), Regime("burst", 0.55, peak=1.25))


def traces(jobs: DataFrame, regimes: tuple[Regime, ...], seeds: tuple[int, ...]) -> DataFrame:
    """Each job once a regime and seed, with ``rho``, ``peak``, ``p`` and ``q`` of its regime."""
    each = F.explode(F.array(*[F.struct(F.lit(r.name).alias("regime"), F.lit(s).alias("seed"), F.lit(float(r.rho)).alias("rho"), F.lit(r.peak).cast("double").alias("peak"), F.lit(r.to_peak).alias("p"), F.lit(r.to_background).alias("q")) for r in regimes for s in seeds])).alias("t")
    return jobs.select("*", each).select(*jobs.columns, "t.*")


def _state(before: Column, fixed: Column, swaps: Column, since: Column) -> Column:
    """State after a stretch: the last fixed one, or the one before it, and the parity of the swaps since."""
    return F.when(fixed.isNotNull(), (fixed + swaps - since) % 2).otherwise((before + swaps) % 2)


def arrivals(traced: DataFrame, reference_us: int, n_jobs: int) -> DataFrame:
    """Adds ``peaking`` and ``arrival_us``; ``n_jobs`` a trace sets the number of blocks.

    Jobs come in hash order.  Before each arrival the modulated process may
    change its state: from background to peak where a uniform number is below
    p, back where it is below q.  Below both it swaps the state, between them
    it fixes it (peak where p > q).  A block is scanned for either state it may
    begin with; a small table with one row a block then tells which it was.
    """
    if reference_us <= 0:
        raise ValueError("the reference service time must be positive")
    keys = ["regime", "seed"]
    digits = max(0, int(np.ceil(np.log(max(n_jobs, 1) / BLOCK_ROWS) / np.log(16))))
    rows = traced.withColumn("_h", stable_key(F.col("seed"), F.col("regime"), F.col("event_id")))
    rows = rows.withColumn("_u", F.when(F.col("peak").isNotNull(), uniform("state", F.col("seed"), F.col("regime"), F.col("event_id"))))
    rows = rows.withColumn("_g", -F.log(1 - uniform("gap", F.col("seed"), F.col("regime"), F.col("event_id"))) * F.lit(float(reference_us))).withColumn("_block", F.substring("_h", 1, digits))
    w = Window.partitionBy(*keys, "_block").orderBy("_h", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("_swaps", F.sum(F.when(F.col("_u") < F.least("p", "q"), 1).otherwise(0)).over(w))
    fixes = (F.col("_u") >= F.least("p", "q")) & (F.col("_u") < F.greatest("p", "q"))
    rows = rows.withColumn("_fix", F.last(F.when(fixes, F.struct((F.col("p") > F.col("q")).cast("int").alias("to"), F.col("_swaps").alias("at"))), ignorenulls=True).over(w))
    for s in (0, 1):
        rows = rows.withColumn(f"_k{s}", _state(F.lit(s), F.col("_fix.to"), F.col("_swaps"), F.col("_fix.at")))
        gap = F.round(F.col("_g") / F.when(F.col(f"_k{s}") == 1, F.col("peak")).otherwise(F.col("rho"))).cast("bigint")
        rows = rows.withColumn(f"_t{s}", F.sum(gap).over(w))
    rows = durable(rows.drop("_u", "_g", "_swaps", "_fix", "rho", "peak", "p", "q"), "arrivals")
    last = lambda c: F.max_by(c, F.struct("_h", "event_id")).alias(c)
    blocks = rows.groupBy(*keys, "_block").agg(last("_k0"), last("_k1"), last("_t0"), last("_t1"))
    before = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.withColumn("_b", F.sum(F.when(F.col("_k0") > F.col("_k1"), 1).otherwise(0)).over(Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, 0)))
    fixed = F.last(F.when(F.col("_k0") == F.col("_k1"), F.struct(F.col("_k0").alias("to"), F.col("_b").alias("at"))), ignorenulls=True).over(before)
    blocks = blocks.withColumn("_f", fixed).withColumn("_sb", F.coalesce(F.lag("_b").over(Window.partitionBy(*keys).orderBy("_block")), F.lit(0)))
    blocks = blocks.withColumn("_start", _state(F.lit(0), F.col("_f.to"), F.col("_sb"), F.col("_f.at")))
    total = F.when(F.col("_start") == 1, F.col("_t1")).otherwise(F.col("_t0"))
    blocks = blocks.select(*keys, "_block", "_start", F.coalesce(F.sum(total).over(before), F.lit(0)).alias("_from"))
    chosen = lambda c: F.when(F.col("_start") == 1, F.col(c + "1")).otherwise(F.col(c + "0"))
    out = rows.join(blocks, [*keys, "_block"]).withColumn("peaking", chosen("_k") == 1).withColumn("arrival_us", (F.col("_from") + chosen("_t")).cast("bigint"))
    return out.drop("_h", "_block", "_k0", "_k1", "_t0", "_t1", "_start", "_from")


def service_samples(measurements: DataFrame, strict: bool = False) -> DataFrame:
    """``measurement_id, tier, input_length_tercile, us`` of the good measurements of a known length.

    ``strict``: a good measurement whose time is not a positive finite number
    fails, as does a tier without samples in a bin that the other has; else
    such measurements are left out.
    """
    v = F.col("wall_ms")
    rows = measurements.filter((F.col("status") == "ok") & F.col("input_length_tercile").isNotNull())
    positive = v.isNotNull() & ~F.isnan(v) & (v > 0) & (v < float("inf"))
    if strict:
        bad = rows.filter(~F.coalesce(positive, F.lit(False))).limit(3).collect()
        if bad:
            raise ValueError(f"service times must be positive and finite: {[r['measurement_id'] for r in bad]}")
        per = {(r[0], r[1]) for r in rows.select("tier", "input_length_tercile").distinct().collect()}  # tiers times bins
        empty = sorted({(t, b) for t, _ in per for _, b in per} - per)
        if empty:
            raise ValueError(f"no service samples for {empty}")
    return rows.filter(positive).select("measurement_id", "tier", "input_length_tercile", F.round(v * 1000).cast("bigint").alias("us"))


def service_index(samples: DataFrame, block_rows: int = BLOCK_ROWS) -> tuple[DataFrame, DataFrame]:
    """(samples with ``k`` from 0 per tier and tercile in the order of ``measurement_id``; their number ``n_samples``)."""
    keys = ["tier", "input_length_tercile"]
    numbered = prefix_scan(samples, keys, F.floor(F.col("measurement_id") / block_rows), ["measurement_id"], F.lit(1), "k")
    return numbered.withColumn("k", F.col("k") - 1), samples.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_samples"), F.sum("us").alias("total_us"))


def draw_services(jobs: DataFrame, samples: DataFrame, tiers: tuple[str, ...] = ("light", "strong")) -> DataFrame:
    """Adds, for each tier, one sampled time ``<tier>_us`` of the job's tercile and their mean ``<tier>_mean_us``.

    A job of a bin without samples fails; none is dropped.
    """
    numbered, sizes = service_index(samples)
    out = jobs
    for t in tiers:
        mine = sizes.filter(F.col("tier") == t).select("input_length_tercile", "n_samples", F.floor(F.col("total_us") / F.col("n_samples")).alias(f"{t}_mean_us"))
        out = out.join(F.broadcast(mine), "input_length_tercile", "left")  # one row a tercile
        out = out.withColumn("k", F.floor(uniform("service", F.col("seed"), F.col("event_id"), F.lit(t)) * F.col("n_samples"))).drop("n_samples")
        picked = numbered.filter(F.col("tier") == t).select("input_length_tercile", "k", F.col("us").alias(f"{t}_us"))
        out = out.join(picked, ["input_length_tercile", "k"], "left").drop("k")
        missing = F.raise_error(F.concat(F.lit(f"no {t} service sample for a job of length bin "), F.coalesce("input_length_tercile", F.lit("null")))).cast("bigint")
        out = out.withColumn(f"{t}_us", F.coalesce(f"{t}_us", missing))
    return out


def light_threshold(calibration: DataFrame, epsilon: float = 0.02) -> DataFrame:
    """One row: the largest cutoff under which the light tier allowed no unsafe calibration row.

    ``calibration``: ``unsafe`` boolean, ``label``, ``risk_score``.  A risk is
    accepted when it is at most ``threshold``: just below the least risk of an
    unsafe allow, 1 where there is none, and -1 (nothing is accepted) where
    that least risk is 0.  ``feasible`` tells whether both sides have rows, no
    unsafe row is accepted and the zero-error bound is within ``epsilon``.
    """
    risk = clamp_probability(F.col("risk_score"))
    allow = F.col("label") == "0"
    # an unsafe allow without a usable risk is one of risk 0
    worst = F.min(F.when(F.col("unsafe") & allow, F.coalesce(risk, F.lit(0.0))))
    below = F.when(worst.isNull(), 1.0).when(worst <= 0, -1.0).otherwise(next_down(worst)).alias("threshold")
    cut = calibration.agg(below)
    both = calibration.withColumn("_risk", F.coalesce(risk, F.when(F.col("unsafe"), 0.0).otherwise(2.0))).join(F.broadcast(cut))  # one row
    accepted = allow & (F.col("_risk") <= F.col("threshold"))
    out = both.groupBy("threshold").agg(
        F.count_if("unsafe").alias("n_unsafe"), F.count_if(F.col("unsafe") & allow).alias("n_unsafe_allow"), F.count_if(F.col("unsafe") & accepted).alias("n_false_allow"),
        F.count_if(~F.col("unsafe")).alias("n_benign"), F.count_if(~F.col("unsafe") & allow).alias("n_benign_allow"), F.count_if(~F.col("unsafe") & accepted).alias("n_benign_accepted"),
    )
    bound = zero_error_bound(F.greatest(F.col("n_unsafe"), F.lit(1)))
    out = out.withColumn("epsilon", F.lit(float(epsilon))).withColumn("bound", F.round(bound, 9)).withColumn("all_to_strong", F.col("threshold") < 0)
    out = out.withColumn("benign_rate", F.round(F.col("n_benign_accepted") / F.greatest("n_benign", F.lit(1)), 9))
    return out.withColumn("feasible", (F.col("n_unsafe") > 0) & (F.col("n_benign") > 0) & (F.col("n_false_allow") == 0) & (bound <= epsilon))


def checked_threshold(report: DataFrame, strict: bool = True) -> float:
    """The threshold of a ``light_threshold``; ``strict`` fails where it is not feasible.  Without calibration rows it is -1."""
    row = report.first()
    if strict and (row is None or not row["n_unsafe"] or not row["n_benign"]):
        raise ValueError("the calibration rows lack an unsafe or a benign side")
    if strict and row["n_false_allow"]:
        raise ValueError("the threshold accepts unsafe calibration rows")
    if strict and not row["feasible"]:
        raise ValueError(f"the calibration sample is too small: bound {row['bound']} over {row['epsilon']}")
    return row["threshold"] if row is not None and row["n_unsafe"] else -1.0


def accepted_risk(threshold: float) -> Column:
    """Whether the risk is a finite number that, clamped, is at most ``threshold``; never null."""
    return F.coalesce(clamp_probability(F.col("risk_score")) <= threshold, F.lit(False))


def cascade_tier(threshold: float) -> Column:
    """Only jobs that are not hard and have an accepted risk go to the light tier."""
    return F.when(~F.coalesce("hard_required", F.lit(False)) & accepted_risk(threshold), "light").otherwise("strong")


def serial_plan(threshold: float) -> Column:
    """``struct<stages, label, reason>`` of the two-stage plan, which never lets a light abstention stand."""

    def plan(stages: list[str], label: Column, reason: str) -> Column:
        return F.struct(F.array(*[F.lit(s) for s in stages]).alias("stages"), label.alias("label"), F.lit(reason).alias("reason"))

    light, strong = F.col("light_label"), F.col("strong_label")
    return (
        F.when(F.coalesce("hard_required", F.lit(False)), plan(["strong"], strong, "hard_to_strong"))
        .when((light == "0") & accepted_risk(threshold), plan(["light"], light, "light_allow"))
        .when(light == "1", plan(["light"], light, "light_block"))
        .when(light == "2", plan(["light", "strong"], strong, "light_abstain_to_strong"))
        .otherwise(plan(["light", "strong"], strong, "risk_to_strong"))
    )


DECISIONS = {"0": "allow", "1": "block", "2": "abstain"}


def decision(label: Column, timed_out: Column) -> Column:
    """Allow, block or abstain; a job that timed out is abstained from."""
    known = F.create_map(*[F.lit(x) for kv in DECISIONS.items() for x in kv])
    return F.when(timed_out, "abstain").otherwise(F.element_at(known, label))


def _light_tenants(loads: list[int], size: int, ranks: np.ndarray) -> np.ndarray:
    """Which of the loads each of a run of equal sessions goes to, always the least, ties to the first.

    Item i goes where the i-th smallest of the levels load, load + size, load
    + 2 size, .. is; its level is found by bisection over their counts.
    """
    base = np.array(loads, dtype=np.int64)
    below = lambda x: np.maximum(0, (x[:, None] - base[None, :] + size - 1) // size).sum(axis=1)  # noqa: E731  levels < x
    lo = np.full(len(ranks), base.min(), dtype=np.int64)
    hi = base.min() + size * (ranks + 1) + 1
    while (hi - lo > 1).any():  # the largest x with at most rank levels below it
        mid = (lo + hi) // 2
        fits = below(mid) <= ranks
        lo, hi = np.where(fits, mid, lo), np.where(fits, hi, mid)
    at = (lo[:, None] >= base[None, :]) & ((lo[:, None] - base[None, :]) % size == 0)
    nth = ranks - below(lo)
    return np.argmax(np.cumsum(at, axis=1) == (nth + 1)[:, None], axis=1)


def tenant_plan(sizes: list[tuple[int, int]], tenants: int, heavy_share: float) -> dict[int, tuple[int, list[int]]]:
    """For each session size: how many of its sessions tenant 0 takes, and the loads of the others before the rest of them.

    ``sizes``: (size, number of sessions).  Tenant 0 takes sessions, large ones
    first, while it is below its share and that does not bring it farther
    from it; where it would get none, it takes the first.
    """
    total = sum(n * c for n, c in sizes)
    target, heavy, taken = round(total * heavy_share), 0, {}
    ordered = sorted(sizes, reverse=True)
    for n, c in ordered:
        # the k-th more is taken while heavy + (k - 1) n < target and that is no nearer than heavy + k n
        k = max(0, min(c, (2 * (target - heavy) + n) // (2 * n))) if heavy < target else 0
        taken[n], heavy = k, heavy + k * n
    if ordered and not heavy:
        taken[ordered[0][0]] = 1
    loads, plan = [0] * (tenants - 1), {}
    for n, c in ordered:
        rest = c - taken[n]
        plan[n] = (taken[n], list(loads))
        if not loads or not rest:
            continue
        # whole levels first, then the few that are left one by one
        lo, hi = min(loads), min(loads) + n * (rest + 1)
        count = lambda x: sum(max(0, -(-(x - v) // n)) for v in loads)  # noqa: E731, B023
        while hi - lo > 1:
            mid = (lo + hi) // 2
            lo, hi = (mid, hi) if count(mid) <= rest else (lo, mid)
        left = rest - count(lo)
        loads = [v + n * max(0, -(-(lo - v) // n)) for v in loads]
        for t in sorted((t for t in range(len(loads)) if loads[t] == lo))[:left]:
            loads[t] += n
    return plan


def assign_tenants(sessions: DataFrame, tenants: int, heavy_share: float) -> DataFrame:
    """``session_id, n, tenant_id``: whole sessions to tenants, the large ones first, equal ones in hash order.

    Tenant 0 takes sessions while it is below its share of all actions and
    that does not bring it farther from it; the others go one by one to the
    tenant with the least load.  ``sessions``: ``session_id, n``.  Sessions of
    one size differ in their rank only, so the greedy choice is made for sizes
    (there are at most about sqrt(2 * actions) of them) and each session finds
    its tenant by its position.
    """
    if tenants < 1 or (tenants < 2 and heavy_share < 1):
        raise ValueError("a heavy tenant needs others beside it")
    sizes = [(r[0], r[1]) for r in sessions.groupBy("n").count().collect()]
    plan = tenant_plan(sizes, tenants, heavy_share)
    firsts, before = {}, 0
    for n, c in sorted(sizes, reverse=True):
        firsts[n], before = before, before + c
    shared = sessions.sparkSession.sparkContext.broadcast((plan, firsts))
    placed = global_position(sessions.select("session_id", "n"), [F.desc("n"), F.substring(F.sha2(F.coalesce("session_id", F.lit("")), 256), 1, 16).asc(), F.asc_nulls_first("session_id")])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        plan, firsts = shared.value
        for pdf in batches:
            out = np.zeros(len(pdf), dtype=np.int32)
            n, pos = pdf["n"].to_numpy(), pdf["pos"].to_numpy()
            for size in np.unique(n):
                at = np.nonzero(n == size)[0]
                heavy, loads = plan[int(size)]
                rank = pos[at] - firsts[int(size)] - heavy
                rest = at[rank >= 0]
                if len(rest):
                    out[rest] = 1 + _light_tenants(loads, int(size), rank[rank >= 0])
            yield pdf[["session_id", "n"]].assign(tenant_id=out)

    return placed.mapInPandas(run, "session_id string, n bigint, tenant_id int")
