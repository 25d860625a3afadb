"""Queries over raw measurements: faulty readings and hourly fences."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomgate.operators.anomalies import GAMMA, flag_readings, hour_fences
from loomgate.sources import table


#: Reasons that make a reading a case; fences and sudden changes alone do not.
CASES = ("impossible", "level", "frozen", "excess")


def p4_found(spark, sf_dir):
    """Readings that are a spike, frozen or impossible for their (tier, runner)."""
    flagged = flag_readings(table(spark, sf_dir, "service_profile"))
    return flagged.filter(F.arrays_overlap("reasons", F.array(*[F.lit(c) for c in CASES]))).select("measurement_id")


def p4_reason_counts(spark, sf_dir):
    """How many readings each reason flags."""
    flagged = flag_readings(table(spark, sf_dir, "service_profile"))
    return flagged.select(F.explode("reasons").alias("reason")).groupBy("reason").agg(F.count(F.lit(1)).alias("n_readings"))


def p4_flags(spark, sf_dir):
    """Every flagged reading with its reasons, those outside the fence of their hour and sudden ones included."""
    return flag_readings(table(spark, sf_dir, "service_profile")).select("measurement_id", F.array_join("reasons", ",").alias("reasons"))


def p4_hour_fences(spark, sf_dir):
    """Normal range of each source by hour of the day."""
    out = hour_fences(table(spark, sf_dir, "service_profile"))
    return out.select("tier", "runner_id", "metric", "hour", "n", *[F.round(c, 6).alias(c) for c in ("q1", "q3", "low", "high")])


QUERIES = {f.__name__: f for f in (p4_found, p4_reason_counts, p4_flags, p4_hour_fences)}

_READINGS = f"""
with b as (
  select measurement_id, any_value(tier) tier, any_value(runner_id) runner_id, any_value(wall_ms) wall_ms,
         any_value(cuda_ms) cuda_ms, any_value(measured_at) measured_at
  from service_profile where lower(trim(status)) = 'ok' group by measurement_id),
l as (
  select measurement_id, tier, runner_id, measured_at, 'w' m, wall_ms v from b where wall_ms is not null
  union all
  select measurement_id, tier, runner_id, measured_at, 'c', cuda_ms from b where cuda_ms is not null),
med as (select tier, runner_id, m, median(v) med from l where isfinite(v) group by all),
s as (
  select *, case when v = lag(v) over w then 0 else 1 end ch from l
  window w as (partition by tier, runner_id, m order by measured_at, measurement_id)),
g as (
  select *, sum(ch) over (partition by tier, runner_id, m order by measured_at, measurement_id rows unbounded preceding) run
  from s),
hb as (
  select tier, runner_id, m, (epoch_us(measured_at) // 3600000000) % 24 h, floor(ln(greatest(abs(v), 1e-300)) / ln({GAMMA})) b, sign(v) sg, count(*) c, max(v) mx
  from l where isfinite(v) group by all),
hc as (select *, sum(c) over w cum, sum(c) over (partition by tier, runner_id, m, h) n from hb window w as (partition by tier, runner_id, m, h order by sg * (b + 20000) rows unbounded preceding)),
hq as (select tier, runner_id, m, h, max(n)::bigint n, min(mx) filter (cum >= n * 0.25) q1, min(mx) filter (cum >= n * 0.75) q3 from hc group by 1, 2, 3, 4),
hf as (select *, q1 - greatest(q3 - q1, abs(q3) * {GAMMA - 1}) * 3 low, q3 + greatest(q3 - q1, abs(q3) * {GAMMA - 1}) * 3 high from hq),
lv as (
  select l.*, med, low, high, lag(v) over o pv, lag(epoch_us(l.measured_at)) over o pt
  from l left join med using (tier, runner_id, m) left join hf on hf.tier = l.tier and hf.runner_id = l.runner_id and hf.m = l.m and hf.h = (epoch_us(l.measured_at) // 3600000000) % 24
  window o as (partition by l.tier, l.runner_id, l.m order by l.measured_at, measurement_id)),
flags as (
  select measurement_id, 'impossible' reason from l where not isfinite(v) or v <= 0
  union select measurement_id, 'level' from l join med using (tier, runner_id, m)
    where isfinite(v) and (v > 4 * med or v < med / 4)
  union select measurement_id, 'fence' from lv where isfinite(v) and (v > least(high, 4 * med) or v < greatest(low, med / 4))
  union select measurement_id, 'sudden' from lv where isfinite(v) and isfinite(pv) and v > 0 and pv > 0 and greatest(v / pv, pv / v) > 4
    and epoch_us(measured_at) - pt <= 3600000000 and abs(ln(v / med)) > abs(ln(pv / med))
  union select measurement_id, 'frozen' from
    (select measurement_id from g qualify count(*) over (partition by tier, runner_id, m, run) >= 8)
  union select measurement_id, 'excess' from b where isfinite(cuda_ms) and isfinite(wall_ms) and cuda_ms > wall_ms * 1.05)
"""

ORACLE = {
    "p4_found": _READINGS + "select distinct measurement_id from flags where reason not in ('fence', 'sudden')",
    "p4_flags": _READINGS + "select measurement_id, string_agg(distinct reason, ',' order by reason) reasons from flags group by 1",
    "p4_hour_fences": _READINGS
    + """select tier, runner_id, case m when 'w' then 'wall_ms' else 'cuda_ms' end metric, h as "hour", n, round(q1, 6) q1, round(q3, 6) q3, round(low, 6) low, round(high, 6) high from hf""",
    "p4_reason_counts": _READINGS + "select reason, count(*) n_readings from flags group by reason",
}
