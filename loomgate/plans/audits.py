"""Audits of caches, selections and measurements."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomgate.functions.stats import exact_percentiles
from loomgate.functions.text import plain
from loomgate.operators.audit import check_rules, failing_rows
from loomgate.plans.base import EV, SC, SP, events, measurements, scores
from loomgate.sources import table


def _cache(spark, d):
    e = events(spark, d).select("event_id", F.col("source").alias("e_source"), F.col("split").alias("e_split"))
    s = table(spark, d, "score_cache").withColumn("source", plain(F.col("source")))
    n = s.groupBy("tier", "event_id").agg(F.count(F.lit(1)).alias("n_same"))
    return s.join(n, ["tier", "event_id"]).join(e, "event_id", "left")


def _cache_rules():
    p = F.col("constrained_label_probabilities")
    total = p["0"] + p["1"] + p["2"]
    return {
        "status_ok": F.col("status") == "ok",
        "unique": F.col("n_same") == 1,
        "known_action": F.col("e_source").isNotNull(),
        "same_source": F.col("source") == F.col("e_source"),
        "same_split": F.col("split").eqNullSafe(F.col("e_split")),
        "label_known": F.col("label").isin("0", "1", "2"),
        "sums_to_one": F.abs(total - 1) <= 1e-5,
        "risk_is_rest": F.abs(F.col("risk_score") - p["1"] - p["2"]) <= 1e-5,
        "tercile_known": F.col("input_length_tercile").isin("short", "medium", "long"),
    }


def v_cache_rules(spark, d):
    """Rows of the score cache that break each rule, by tier."""
    return check_rules(_cache(spark, d), _cache_rules(), ["tier"])


def v_cache_failures(spark, d):
    """Actions with broken score rows, and what is broken."""
    rows = failing_rows(_cache(spark, d).withColumn("k", F.concat_ws("|", "tier", "event_id")), "k", _cache_rules())
    return rows.select("k", F.array_join("failed", ",").alias("failed")).groupBy("k", "failed").agg(F.count(F.lit(1)).alias("n"))


def v_cross_tier(spark, d):
    """Both tiers must agree on the source, the split and the length bin of an action."""
    s = scores(spark, d)
    a = s.filter("tier = 'light'").select("event_id", F.struct("source", "split", "input_length_tercile").alias("l"))
    b = s.filter("tier = 'strong'").select("event_id", F.struct("source", "split", "input_length_tercile").alias("s"))
    both = a.join(b, "event_id", "full_outer")
    return check_rules(both, {"in_both": F.col("l").isNotNull() & F.col("s").isNotNull(), "same_source": F.col("l.source") == F.col("s.source"), "same_bin": F.col("l.input_length_tercile") == F.col("s.input_length_tercile")})


def v_measurement_rules(spark, d):
    """Measurements that break the rules of a profile."""
    m = measurements(spark, d)
    w = F.col("wall_ms")
    return check_rules(m, {
        "status_ok": F.col("status") == "ok", "positive_wall": w.isNotNull() & ~F.isnan(w) & (w > 0) & (w < float("inf")), "one_output_token": F.col("output_tokens") == 1,
        "tercile_known": F.col("input_length_tercile").isin("short", "medium", "long"),
    }, ["tier"])


def v_maximum_wait(spark, d):
    """The age limit that follows from the strong tier: ceil(max(5000, 4 * p95))."""
    v = F.col("wall_ms")
    rows = measurements(spark, d).filter((F.col("status") == "ok") & v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    p = exact_percentiles(rows, ["tier"], "wall_ms", {"p95": 0.95})
    return p.select("tier", F.round("p95", 4).alias("p95"), F.ceil(F.greatest(F.lit(5000.0), 4 * F.col("p95"))).alias("maximum_wait_ms"))


def v_selection_rules(spark, d):
    """Selected actions must be known, have a bin and a prompt digest, and come from the split they say."""
    e = events(spark, d).select("event_id", "split")
    s = table(spark, d, "profiling_selection").distinct().join(e, "event_id", "left")
    return check_rules(s, {
        "known_action": F.col("split").isNotNull(), "has_bin": F.col("input_length_tercile").isNotNull(),
        "digest_form": F.col("profiling_prompt_sha256").rlike("^[0-9a-fA-F]{64}$"), "split_agrees": F.col("selection_source_split") == F.col("split"),
    })


QUERIES = {f.__name__: f for f in (v_cache_rules, v_cache_failures, v_cross_tier, v_measurement_rules, v_maximum_wait, v_selection_rules)}


def _rules_sql(ctes: str, source: str, rules: dict[str, str], by: str = "") -> str:
    """One row a rule; rules are SQL predicates."""
    k, g = (f"{by}, ", f" group by {by}") if by else ("", "")
    return f"with {ctes} " + " union all ".join(f"select {k}'{r}' as rule, count(*) n_rows, count(*) filter (not coalesce({p}, false)) n_failed from {source}{g}" for r, p in rules.items())


_CACHE = f"{EV}, ca as (select s.* replace (lower(trim(s.source)) as source), count(*) over (partition by s.tier, s.event_id) n_same, ev.source e_source, ev.split e_split from score_cache s left join ev using (event_id))"
_P = "constrained_label_probabilities"
_CACHE_SQL = {
    "status_ok": "status = 'ok'", "unique": "n_same = 1", "known_action": "e_source is not null", "same_source": "source = e_source", "same_split": "split is not distinct from e_split",
    "label_known": "label in ('0', '1', '2')", "sums_to_one": f"abs({_P}['0'] + {_P}['1'] + {_P}['2'] - 1) <= 1e-5", "risk_is_rest": f"abs(risk_score - {_P}['1'] - {_P}['2']) <= 1e-5",
    "tercile_known": "input_length_tercile in ('short', 'medium', 'long')",
}
_FAILED = " || ".join(f"case when coalesce({p}, false) then '' else '{r},' end" for r, p in _CACHE_SQL.items())

ORACLE = {
    "v_cache_rules": _rules_sql(_CACHE, "ca", _CACHE_SQL, "tier"),
    "v_cache_failures": f"with {_CACHE}, f as (select tier || '|' || event_id k, rtrim({_FAILED}, ',') failed from ca) select k, failed, count(*) n from f where failed <> '' group by 1, 2",
    "v_cross_tier": _rules_sql(f"{SC}, b as (select l.event_id le, s.event_id se, l.source ls, s.source ss, l.input_length_tercile lt, s.input_length_tercile st from (select * from sc where tier = 'light') l full outer join (select * from sc where tier = 'strong') s using (event_id))", "b", {"in_both": "le is not null and se is not null", "same_source": "ls = ss", "same_bin": "lt = st"}),
    "v_measurement_rules": _rules_sql(SP, "sp", {"status_ok": "status = 'ok'", "positive_wall": "isfinite(wall_ms) and wall_ms > 0", "one_output_token": "output_tokens = 1", "tercile_known": "input_length_tercile in ('short', 'medium', 'long')"}, "tier"),
    "v_maximum_wait": f"with {SP}, p as (select tier, quantile_cont(wall_ms, 0.95) p95 from sp where status = 'ok' and isfinite(wall_ms) group by 1) select tier, round(p95, 4) p95, ceil(greatest(5000.0, 4 * p95))::bigint maximum_wait_ms from p",
    "v_selection_rules": _rules_sql(f"{EV}, se as (select s.*, ev.split from (select distinct * from profiling_selection) s left join ev using (event_id))", "se", {"known_action": "split is not null", "has_bin": "input_length_tercile is not null", "digest_form": "regexp_full_match(profiling_prompt_sha256, '[0-9a-fA-F]{64}')", "split_agrees": "selection_source_split = split"}),
}
