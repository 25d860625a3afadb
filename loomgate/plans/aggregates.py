"""Aggregations, quotas and samples over the domain tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from loomgate.functions.hashing import stable_key
from loomgate.functions.stats import exact_percentiles, jain
from loomgate.operators.selection import cut_points, equal_quota, largest_remainder, top_by_hash
from loomgate.plans.base import EV, RC, SP, events, measurements, records
from loomgate.sources import table

QS = {"p50": 0.5, "p95": 0.95, "p99": 0.99}


def _latencies(spark, d):
    v = F.col("wall_ms")
    return measurements(spark, d).filter((F.col("status") == "ok") & v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))


def a_counts_by_source_split(spark, d):
    return events(spark, d).groupBy("source", "split").agg(F.count(F.lit(1)).alias("n"), F.count_if("hard_required").alias("n_hard"))


def a_latency_summary_rollup(spark, d):
    """Exact percentiles by tier and tercile, with a total for each tier."""
    rows = _latencies(spark, d).select("tier", F.explode(F.array(F.coalesce("input_length_tercile", F.lit("unknown")), F.lit("all"))).alias("bin"), "wall_ms")
    out = exact_percentiles(rows, ["tier", "bin"], "wall_ms", QS)
    return out.select("tier", "bin", "n", *[F.round(q, 2).alias(q) for q in QS])


def a_service_means(spark, d):
    """Mean service by tier and tercile, in whole microseconds; and relative to all of the strong tier."""
    us = F.round(F.col("wall_ms") * 1000).cast("bigint")
    rows = _latencies(spark, d).filter("wall_ms > 0 and input_length_tercile is not null").select("tier", "input_length_tercile", us.alias("us"))
    per = rows.groupBy("tier", "input_length_tercile").agg(F.count(F.lit(1)).alias("n"), F.sum("us").alias("total_us"))
    strong = rows.filter("tier = 'strong'").agg(F.sum("us") / F.count(F.lit(1))).first()[0]
    return per.select("tier", "input_length_tercile", "n", F.floor(F.col("total_us") / F.col("n")).alias("mean_us"), F.round(F.col("total_us") / F.col("n") / F.lit(strong), 6).alias("relative_cost"))


def a_jain_sessions(spark, d):
    """Fairness of the load of sessions, by source."""
    loads = events(spark, d).groupBy("source", "session_id").agg(F.count(F.lit(1)).alias("n"))
    return loads.groupBy("source").agg(F.count(F.lit(1)).alias("n_sessions"), F.round(jain(F.col("n")), 9).alias("jain"))


def a_quality_exclusions(spark, d):
    e = events(spark, d).filter("quality_score is not null")
    return e.groupBy("risk_category").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("quality_score") < 7).alias("n_excluded"))


def a_repetition_histogram(spark, d):
    """How many (tier, action) have how many measurements."""
    per = measurements(spark, d).groupBy("tier", "event_id").agg(F.count(F.lit(1)).alias("repetitions"))
    return per.groupBy("tier", "repetitions").agg(F.count(F.lit(1)).alias("n"))


def a_function_frequency(spark, d):
    return events(spark, d).select("domain", F.explode("target_functions").alias("tool")).groupBy("domain", "tool").agg(F.count(F.lit(1)).alias("n"))


def a_interference_rate(spark, d):
    """Share of readings whose two clocks differ by more than a tenth."""
    off = F.abs(F.col("wall_ms") - F.col("cuda_ms")) / F.greatest("wall_ms", F.lit(0.001)) > 0.10
    rows = _latencies(spark, d).filter(F.col("cuda_ms").isNotNull() & ~F.isnan("cuda_ms"))
    return rows.groupBy("tier").agg(F.count(F.lit(1)).alias("n"), F.count_if(off).alias("n_off"))


def w_terciles(spark, d):
    """Cut points of the token counts and the sizes of the three bins they make."""
    s = table(spark, d, "profiling_selection").select("event_id", "profiling_input_tokens").distinct()
    lo, hi = cut_points(s, "profiling_input_tokens")
    t = F.col("profiling_input_tokens")
    name = F.when(t <= lo, "short").when(t <= hi, "medium").otherwise("long")
    return s.filter(t.isNotNull()).groupBy(name.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.max(t).alias("longest"))


def w_topk_hash(spark, d):
    """Five actions of each domain by seeded hash order."""
    return top_by_hash(events(spark, d).select("domain", "event_id"), ["domain"], stable_key("pick", F.col("event_id")), "event_id", 5)


def w_largest_remainder(spark, d):
    """200 places for the injection cases, in proportion to their domains."""
    n = events(spark, d).filter("source = 'agentdojo'").groupBy("domain").agg(F.count(F.lit(1)).alias("n"))
    return largest_remainder(n, "domain", "n", 200)


def w_bounded_allocation(spark, d):
    """32 profiling places over the terciles, never more than there are actions."""
    s = table(spark, d, "profiling_selection").filter("input_length_tercile is not null").select("event_id", "input_length_tercile").distinct()
    n = s.groupBy("input_length_tercile").agg(F.count(F.lit(1)).alias("n"))
    return largest_remainder(n, "input_length_tercile", "n", 32, capacity="n")


def w_equal_quota(spark, d):
    """150 places split evenly over the strata of risky plans."""
    e = events(spark, d).filter("source = 'safetoolbench'").select("domain").distinct()
    return equal_quota(e, "domain", stable_key("quota", F.col("domain")), 150)


def w_coverage_first(spark, d):
    """One case of every injection task first, then by hash order, up to 20 a domain."""
    e = events(spark, d).filter("source = 'agentdojo'").select("domain", "event_id", F.regexp_extract("event_id", r"injection_task_(\d+)", 1).alias("task"), stable_key("cover", F.col("event_id")).alias("h"))
    first = F.row_number().over(Window.partitionBy("domain", "task").orderBy("h"))
    ranked = e.withColumn("covers", first == 1)
    order = [F.when(F.col("covers"), 0).otherwise(1), F.when(F.col("covers"), F.col("task")).otherwise(F.col("h")), "h"]
    w = Window.partitionBy("domain").orderBy(*order)
    n_tasks = F.sum(F.col("covers").cast("int")).over(Window.partitionBy("domain"))
    return ranked.withColumn("k", F.row_number().over(w)).withColumn("t", n_tasks).filter(F.col("k") <= F.greatest(F.lit(20), F.col("t"))).select("domain", "event_id", "covers")


def l_balanced_holdout(spark, d):
    """Ten unseen risky plans of each category, by hash order."""
    e = events(spark, d).filter("source = 'safetoolbench' and instruction_sha256 is not null and risk_category is not null")
    seen = e.filter("split = 'calibration'").select("instruction_sha256").distinct()
    fresh = e.filter("split = 'evaluation'").join(seen, "instruction_sha256", "left_anti").select("risk_category", "event_id")
    return top_by_hash(fresh, ["risk_category"], stable_key("holdout", F.col("event_id")), "event_id", 10)


def l_stratified_sample(spark, d):
    """A profiling sample of 120 with proportional quotas for source and tercile, by hash order."""
    s = table(spark, d, "profiling_selection").filter("input_length_tercile is not null").select("event_id", "input_length_tercile").distinct()
    r = records(spark, d).select("event_id", "source")
    frame = s.join(r, "event_id").select("event_id", F.concat_ws("|", "source", "input_length_tercile").alias("stratum"))
    quota = largest_remainder(frame.groupBy("stratum").agg(F.count(F.lit(1)).alias("n")), "stratum", "n", 120, capacity="n")
    return top_by_hash(frame.join(F.broadcast(quota), "stratum"), ["stratum"], stable_key("strata", F.col("event_id")), "event_id", F.col("quota")).select("stratum", "event_id")


QUERIES = {
    f.__name__: f
    for f in (
        a_counts_by_source_split, a_latency_summary_rollup, a_service_means, a_jain_sessions, a_quality_exclusions, a_repetition_histogram,
        a_function_frequency, a_interference_rate, w_terciles, w_topk_hash, w_largest_remainder, w_bounded_allocation, w_equal_quota, w_coverage_first,
        l_balanced_holdout, l_stratified_sample,
    )
}

_LAT = f"{SP}, lat as (select * from sp where status = 'ok' and isfinite(wall_ms))"
_PCT = ", ".join(f"round(quantile_cont(wall_ms, {q}), 2) {n}" for n, q in QS.items())


def _key(*parts: str) -> str:
    return "sha256(" + " || '|' || ".join(parts) + ")"


def _hamilton(strata: str, key: str, total: int, capacity: bool) -> str:
    """Largest remainder in SQL over a CTE ``n(key, n)``."""
    ties = f"n - base desc, {key} desc" if capacity else key
    return f"""{strata}, b as (select {key}, n, n * {total} / (sum(n) over ())::double raw from n),
        f as (select {key}, n, raw, {'least(floor(raw), n)' if capacity else 'floor(raw)'} base from b)
        select {key}, (base + case when row_number() over (order by raw - base desc, {ties}) <= {total} - sum(base) over () then 1 else 0 end)::bigint quota from f"""


_TERC = "s as (select distinct event_id, input_length_tercile from profiling_selection where input_length_tercile is not null)"
_FRAME = f"{RC}, {_TERC}, fr as (select event_id, source || '|' || input_length_tercile stratum from s join rc using (event_id)), n as (select stratum, count(*) n from fr group by 1)"

ORACLE = {
    "a_counts_by_source_split": f"with {EV} select source, split, count(*) n, count(*) filter (hard_required) n_hard from ev group by 1, 2",
    "a_latency_summary_rollup": f"with {_LAT} select tier, coalesce(input_length_tercile, 'unknown') bin, count(*) n, {_PCT} from lat group by 1, 2 union all select tier, 'all', count(*), {_PCT} from lat group by 1",
    "a_service_means": f"""with {_LAT}, r as (select tier, input_length_tercile, round(wall_ms * 1000)::bigint us from lat where wall_ms > 0 and input_length_tercile is not null)
        select tier, input_length_tercile, count(*) n, (sum(us) // count(*))::bigint mean_us, round(sum(us)::bigint / count(*) / (select sum(us)::bigint / count(*) from r where tier = 'strong'), 6) relative_cost from r group by 1, 2""",
    "a_jain_sessions": f"with {EV}, l as (select source, session_id, count(*) n from ev group by 1, 2) select source, count(*) n_sessions, round(pow(sum(n), 2)::double / (count(*) * sum(n * n)), 9) jain from l group by 1",
    "a_quality_exclusions": f"with {EV} select risk_category, count(*) n, count(*) filter (quality_score < 7) n_excluded from ev where quality_score is not null group by 1",
    "a_repetition_histogram": f"with {SP}, p as (select tier, event_id, count(*) repetitions from sp group by 1, 2) select tier, repetitions, count(*) n from p group by 1, 2",
    "a_function_frequency": f"with {EV}, t as (select domain, unnest(target_functions) tool from ev) select domain, tool, count(*) n from t group by 1, 2",
    "a_interference_rate": f"with {_LAT} select tier, count(*) n, count(*) filter (abs(wall_ms - cuda_ms) / greatest(wall_ms, 0.001) > 0.10) n_off from lat where cuda_ms is not null and not isnan(cuda_ms) group by 1",
    "w_terciles": """with s as (select distinct event_id, profiling_input_tokens t from profiling_selection where profiling_input_tokens is not null),
        o as (select t, row_number() over (order by t, event_id) - 1 r, count(*) over () n from s),
        c as (select max(t) filter (r = n // 3) lo, max(t) filter (r = 2 * n // 3) hi from o)
        select case when t <= lo then 'short' when t <= hi then 'medium' else 'long' end bin, count(*) n, max(t) longest from s, c group by 1""",
    "w_topk_hash": f"with {EV} select domain, event_id from ev qualify row_number() over (partition by domain order by {_key(chr(39) + 'pick' + chr(39), 'event_id')}, event_id) <= 5",
    "w_largest_remainder": _hamilton(f"with {EV}, n as (select domain, count(*) n from ev where source = 'agentdojo' group by 1)", "domain", 200, False),
    "w_bounded_allocation": _hamilton(f"with {_TERC}, n as (select input_length_tercile, count(*) n from s group by 1)", "input_length_tercile", 32, True),
    "w_equal_quota": f"with {EV}, s as (select distinct domain from ev where source = 'safetoolbench') select domain, (150 // count(*) over () + case when row_number() over (order by {_key(chr(39) + 'quota' + chr(39), 'domain')}, domain) <= 150 % count(*) over () then 1 else 0 end)::bigint quota from s",
    "w_coverage_first": rf"""with {EV}, e as (select domain, event_id, regexp_extract(event_id, 'injection_task_(\d+)', 1) task, {_key("'cover'", 'event_id')} h from ev where source = 'agentdojo'),
        c as (select *, row_number() over (partition by domain, task order by h) = 1 covers from e),
        k as (select *, row_number() over (partition by domain order by case when covers then 0 else 1 end, case when covers then task else h end, h) k, sum(covers::int) over (partition by domain) t from c)
        select domain, event_id, covers from k where k <= greatest(20, t)""",
    "l_balanced_holdout": f"""with {EV}, e as (select * from ev where source = 'safetoolbench' and instruction_sha256 is not null and risk_category is not null)
        select risk_category, event_id from e where split = 'evaluation' and instruction_sha256 not in (select instruction_sha256 from e where split = 'calibration')
        qualify row_number() over (partition by risk_category order by {_key("'holdout'", 'event_id')}, event_id) <= 10""",
    "l_stratified_sample": f"with {_hamilton('q as (with ' + _FRAME, 'stratum', 120, True)}), {_FRAME} select stratum, event_id from fr join q using (stratum) qualify row_number() over (partition by stratum order by {_key(chr(39) + 'strata' + chr(39), 'event_id')}, event_id) <= quota",
}
