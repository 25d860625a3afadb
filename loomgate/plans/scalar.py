"""Scalar functions, filters and joins over the domain tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomgate.functions.hashing import uniform, uniform_sql
from loomgate.functions.stats import clamp_probability
from loomgate.functions.text import plain
from loomgate.operators.selection import first_by_key
from loomgate.plans.base import EV, RC, SC, SP, events, measurements, records, scores
from loomgate.sources import table

# Words that must not reach a verifier.
LEAKAGE_WORDS = (
    "ground_truth_safety", "attack_label", "injection_label", "security_outcome", "benchmark_outcome", "post_execution",
    "target_function", "target_functions", "injection_task", "injection case", "quality_score", "risk_category",
    "calibration_label", "dangerous_true", "benign_expected", "hostile_injection", "prompt_injection", "indirect_prompt_injection",
)

TEMPLATE = "state: {state_summary}\nintent: {user_intent}\ntool: {tool_name}\narguments: {tool_arguments}\nhard: {hard_required}\n"
#: White space as Unicode has it, for engines whose \\s is narrower.
BLANKS = r"[\s\x{0B}\x{1C}-\x{1F}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"
FIELDS = ("state_summary", "user_intent", "tool_name", "tool_arguments")


def f_normalized_instruction_hash(spark, d):
    text = F.trim(F.regexp_replace(F.lower("user_intent"), BLANKS, " "))
    return records(spark, d).select("event_id", F.sha2(text, 256).alias("normalized_sha256"))


def f_render_template(spark, d):
    """Placeholders are replaced one after another, so later ones inside earlier values count."""
    out = F.lit(TEMPLATE)
    for f in FIELDS:
        out = F.replace(out, F.lit("{" + f + "}"), F.coalesce(F.col(f), F.lit("")))
    out = F.replace(out, F.lit("{hard_required}"), F.when(F.col("hard_required"), "true").otherwise("false"))
    return records(spark, d).select("event_id", F.sha2(out, 256).alias("rendered_sha256"), F.length(out).cast("bigint").alias("n_chars"))


def f_prompt_digest_check(spark, d):
    """Stored prompt digests that differ from the prompt's own."""
    bad = F.sha2("rendered_prompt", 256) != F.lower("rendered_prompt_sha256")
    return records(spark, d).groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.count_if(bad).alias("n_wrong"))


def f_softmax_risk(spark, d):
    """Softmax over the logs of the three label probabilities; risk is what is not allow."""
    p = F.col("constrained_label_probabilities")
    rows = scores(spark, d).select("tier", "event_id", *[F.log(F.greatest(p[c], F.lit(1e-12))).alias("l" + c) for c in "012"]).filter("l0 is not null and l1 is not null and l2 is not null")
    top = F.greatest("l0", "l1", "l2")
    e = [F.exp(F.col("l" + c) - top) for c in "012"]
    return rows.select("tier", "event_id", F.round((e[1] + e[2]) / (e[0] + e[1] + e[2]), 6).alias("risk"))


def f_ordered_distinct_tools(spark, d):
    tools = F.array_distinct("tool_names")
    return events(spark, d).filter(F.col("tool_names").isNotNull()).select("event_id", F.array_join(tools, " | ").alias("tools"), F.size(tools).cast("bigint").alias("n_tools"))


def f_stable_key_uniform(spark, d):
    return events(spark, d).select("event_id", uniform(F.lit("u"), F.col("event_id")).alias("u"))


def f_parse_ids(spark, d):
    part = F.split("event_id", ":")
    return events(spark, d).select(
        "event_id", part[0].alias("family"), part[1].alias("area"), F.size(part).cast("bigint").alias("n_parts"), F.expr("try_cast(nullif(regexp_extract(try_element_at(split(event_id, ':'), 3), '([0-9]+)$', 1), '') as bigint)").alias("task_no")
    )


def f_version_parts(spark, d):
    parts = F.transform(F.regexp_extract_all("source_version", F.lit(r"(\d+)"), F.lit(1)), lambda x: x.cast("bigint"))
    v = events(spark, d).filter(F.col("source_version").rlike(r"^(v|bundle-v)\d")).select("source", parts.alias("p"))
    return v.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.array_join(F.max("p"), ".").alias("newest"))


def p_clamp_risk(spark, d):
    return scores(spark, d).filter("status = 'ok'").groupBy("tier").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(clamp_probability(F.col("risk_score"))), 4).alias("sum_risk"), F.count_if((F.col("risk_score") < 0) | (F.col("risk_score") > 1)).alias("n_outside"))


def p_eligibility_role(spark, d):
    """Eligibility defaults to true; the role follows from source and split."""
    role = F.when(F.col("e.source") != "tau2-bench", "risk_latency_only").when(F.col("split") == "evaluation", "tau_evaluation").when(F.col("split") == "calibration", "calibration").otherwise("none")
    e = events(spark, d).select("event_id", "source", "split").alias("e")
    r = records(spark, d).select("event_id", F.coalesce("eligible_for_profiling", F.lit(True)).alias("eligible"))
    return e.join(r, "event_id").groupBy(role.alias("role"), "eligible").agg(F.count(F.lit(1)).alias("n"))


def p_leakage_words(spark, d):
    """Records whose texts hold a word that must not be seen."""
    text = F.lower(F.concat_ws("\n", *[F.coalesce(F.col(c), F.lit("")) for c in FIELDS]))
    hit = F.exists(F.array(*[F.lit(w) for w in LEAKAGE_WORDS]), lambda w: F.contains(text, w))
    return records(spark, d).groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.count_if(hit).alias("n_leaking"))


def p_service_samples(spark, d):
    v = F.col("wall_ms")
    ok = (F.col("status") == "ok") & v.isNotNull() & ~F.isnan(v) & (v > 0) & (v < float("inf"))
    return measurements(spark, d).filter(ok & F.col("input_length_tercile").isNotNull()).groupBy("tier", "input_length_tercile").agg(F.count(F.lit(1)).alias("n"), F.min(v).alias("least"), F.max(v).alias("most"))


def _tiers(spark, d, columns=("label", "risk_score", "input_length_tercile", "source", "split")):
    s = scores(spark, d)
    side = lambda t: s.filter(F.col("tier") == t).select("event_id", *[F.col(c).alias(f"{t}_{c}") for c in columns])
    return side("light"), side("strong")


def j_score_join_consistent(spark, d):
    """Evaluation actions with both scores."""
    light, strong = _tiers(spark, d)
    e = events(spark, d).filter("split = 'evaluation'").select("event_id", "source")
    return e.join(light, "event_id").join(strong, "event_id").filter(F.col("light_input_length_tercile") == F.col("strong_input_length_tercile")).select("event_id", "source", "light_label", "strong_label", "light_risk_score", "strong_risk_score")


def j_cross_tier_full_outer(spark, d):
    light, strong = _tiers(spark, d)
    side = F.when(F.col("strong_source").isNull(), "light only").when(F.col("light_source").isNull(), "strong only").when((F.col("light_source") != F.col("strong_source")) | (F.col("light_input_length_tercile") != F.col("strong_input_length_tercile")), "differ").otherwise("equal")
    return light.join(strong, "event_id", "full_outer").groupBy(side.alias("state")).agg(F.count(F.lit(1)).alias("n"))


def j_missing_extra(spark, d):
    """Actions without a light score, and light scores without an action."""
    have = scores(spark, d).filter("tier = 'light'").select("event_id")
    want = events(spark, d).filter(F.col("source").isin("tau2-bench", "safetoolbench")).select("event_id")
    every = events(spark, d).select("event_id")
    return want.join(have, "event_id", "left_anti").select("event_id", F.lit("missing").alias("state")).unionByName(have.join(every, "event_id", "left_anti").select("event_id", F.lit("extra").alias("state")))


def j_holdout_anti(spark, d):
    """Held-out risky plans whose instruction is not among the calibration instructions."""
    e = events(spark, d).filter("source = 'safetoolbench' and instruction_sha256 is not null")
    seen = e.filter("split = 'calibration'").select("instruction_sha256")
    return e.filter("split = 'evaluation'").join(seen, "instruction_sha256", "left_anti").groupBy("risk_category").agg(F.count(F.lit(1)).alias("n"))


def j_disjointness(spark, d):
    """Instructions on both sides of the split."""
    e = events(spark, d).filter("instruction_sha256 is not null")
    a, b = (e.filter(F.col("split") == s).select("instruction_sha256") for s in ("calibration", "evaluation"))
    return a.intersect(b)


def j_cases_by_domain(spark, d):
    """Per domain: user tasks, injection tasks, pairs that could be and that are."""
    e = events(spark, d).filter("source = 'agentdojo'").select("domain", F.regexp_extract("event_id", r"user_task_(\d+)", 1).alias("u"), F.regexp_extract("event_id", r"injection_task_(\d+)", 1).alias("i"))
    return e.groupBy("domain").agg(F.count_distinct("u").alias("n_user"), F.count_distinct("i").alias("n_injection"), F.count_distinct("u", "i").alias("n_pairs")).withColumn("n_possible", F.col("n_user") * F.col("n_injection"))


def j_hard_flag_fail_closed(spark, d):
    """Hard if a target is a hard tool of its domain or a tool the registry does not know."""
    r = table(spark, d, "capability_registry").select(plain(F.col("source")).alias("source"), "domain", "tool", "capability_class").distinct()
    per = r.groupBy("source", "domain").agg(F.collect_set("tool").alias("known"), F.collect_set(F.when(F.col("capability_class") == "hard", F.col("tool"))).alias("hard"))
    tools = F.coalesce("target_functions", F.when(F.col("tool_name").isNotNull(), F.array("tool_name")))
    e = events(spark, d).select("event_id", "source", "domain", tools.alias("tools")).filter("tools is not null").join(per, ["source", "domain"], "left")
    none = F.array().cast("array<string>")
    flag = F.arrays_overlap("tools", F.coalesce("hard", none)) | (F.size(F.array_except("tools", F.coalesce("known", none))) > 0)
    return e.select("event_id", F.coalesce(flag, F.lit(False)).alias("hard"))


def w_dedup_first(spark, d):
    """The first action of each prompt, and how many others it stands for."""
    r = records(spark, d).select("event_id", F.lower("rendered_prompt_sha256").alias("sha"))
    return r.groupBy("sha").agg(F.min("event_id").alias("event_id"), (F.count(F.lit(1)) - 1).alias("n_removed"))


def w_dedup_across_files(spark, d):
    """The first risky plan of each instruction in (file, row) order, above the quality floor."""
    e = events(spark, d).filter("instruction_sha256 is not null and quality_score >= 7")
    e = e.select("instruction_sha256", F.format_string("%s|%012d|%s", "source_file", "source_row_index", "event_id").alias("place"), "event_id", "source_file")
    return first_by_key(e, "instruction_sha256", "place").select("event_id", "source_file")


QUERIES = {
    f.__name__: f
    for f in (
        f_normalized_instruction_hash, f_render_template, f_prompt_digest_check, f_softmax_risk, f_ordered_distinct_tools, f_stable_key_uniform,
        f_parse_ids, f_version_parts, p_clamp_risk, p_eligibility_role, p_leakage_words, p_service_samples, j_score_join_consistent,
        j_cross_tier_full_outer, j_missing_extra, j_holdout_anti, j_disjointness, j_cases_by_domain, j_hard_flag_fail_closed, w_dedup_first,
        w_dedup_across_files,
    )
}

_RENDER = f"'{TEMPLATE}'"
for _f in FIELDS:
    _RENDER = f"replace({_RENDER}, '{{{_f}}}', coalesce({_f}, ''))"
_RENDER = f"replace({_RENDER}, '{{hard_required}}', case when hard_required then 'true' else 'false' end)"
_TIERS = f"with {SC}, l as (select * from sc where tier = 'light'), s as (select * from sc where tier = 'strong')"

ORACLE = {
    "f_normalized_instruction_hash": f"with {RC} select event_id, sha256(trim(regexp_replace(lower(user_intent), '{BLANKS}', ' ', 'g'))) normalized_sha256 from rc",
    "f_render_template": f"with {RC}, r as (select event_id, {_RENDER} t from rc) select event_id, sha256(t) rendered_sha256, length(t) n_chars from r",
    "f_prompt_digest_check": f"with {RC} select source, count(*) n, count(*) filter (sha256(rendered_prompt) <> lower(rendered_prompt_sha256)) n_wrong from rc group by source",
    "f_softmax_risk": f"""with {SC}, x as (select tier, event_id, ln(greatest(constrained_label_probabilities['0'], 1e-12)) a, ln(greatest(constrained_label_probabilities['1'], 1e-12)) b,
        ln(greatest(constrained_label_probabilities['2'], 1e-12)) c from sc where constrained_label_probabilities['0'] is not null and constrained_label_probabilities['1'] is not null and constrained_label_probabilities['2'] is not null)
        select tier, event_id, round((exp(b) + exp(c)) / (exp(a) + exp(b) + exp(c)), 6) risk from x""",
    "f_ordered_distinct_tools": f"with {EV}, t as (select event_id, list_filter(tool_names, lambda x, i: list_position(tool_names, x) = i) t from ev where tool_names is not null) select event_id, array_to_string(t, ' | ') tools, len(t) n_tools from t",
    "f_stable_key_uniform": f"with {EV} select event_id, {uniform_sql("'u'", 'event_id')} u from ev",
    "f_parse_ids": f"with {EV}, p as (select event_id, string_split(event_id, ':') p from ev) select event_id, p[1] family, p[2] area, len(p) n_parts, try_cast(nullif(regexp_extract(coalesce(p[3], ''), '([0-9]+)$', 1), '') as bigint) task_no from p",
    "f_version_parts": rf"with {EV}, v as (select source, list_transform(regexp_extract_all(source_version, '(\d+)', 1), lambda x: x::bigint) p from ev where regexp_matches(source_version, '^(v|bundle-v)\d')) select source, count(*) n, array_to_string(max(p), '.') newest from v group by source",
    "p_clamp_risk": f"with {SC} select tier, count(*) n, round(sum(case when isfinite(risk_score) then greatest(0.0, least(1.0, risk_score)) end), 4) sum_risk, count(*) filter (risk_score < 0 or risk_score > 1) n_outside from sc where status = 'ok' group by tier",
    "p_eligibility_role": f"""with {EV}, {RC} select case when ev.source <> 'tau2-bench' then 'risk_latency_only' when ev.split = 'evaluation' then 'tau_evaluation' when ev.split = 'calibration' then 'calibration' else 'none' end as role,
        coalesce(eligible_for_profiling, true) eligible, count(*) n from ev join rc using (event_id) group by 1, 2""",
    "p_leakage_words": f"with {RC}, t as (select source, lower({' || chr(10) || '.join(f'coalesce({c}, {chr(39)}{chr(39)})' for c in FIELDS)}) t from rc) select source, count(*) n, count(*) filter ({' or '.join(f'contains(t, {chr(39)}{w}{chr(39)})' for w in LEAKAGE_WORDS)}) n_leaking from t group by source",
    "p_service_samples": f"with {SP} select tier, input_length_tercile, count(*) n, min(wall_ms) least, max(wall_ms) most from sp where status = 'ok' and isfinite(wall_ms) and wall_ms > 0 and input_length_tercile is not null group by 1, 2",
    "j_score_join_consistent": f"{_TIERS}, {EV} select ev.event_id, ev.source, l.label light_label, s.label strong_label, l.risk_score light_risk_score, s.risk_score strong_risk_score from ev join l using (event_id) join s using (event_id) where ev.split = 'evaluation' and l.input_length_tercile = s.input_length_tercile",
    "j_cross_tier_full_outer": f"{_TIERS} select case when s.source is null then 'light only' when l.source is null then 'strong only' when l.source <> s.source or l.input_length_tercile <> s.input_length_tercile then 'differ' else 'equal' end state, count(*) n from l full outer join s using (event_id) group by 1",
    "j_missing_extra": f"{_TIERS}, {EV} select event_id, 'missing' state from ev where source in ('tau2-bench', 'safetoolbench') and event_id not in (select event_id from l) union all select event_id, 'extra' from l where event_id not in (select event_id from ev)",
    "j_holdout_anti": f"with {EV}, e as (select * from ev where source = 'safetoolbench' and instruction_sha256 is not null) select risk_category, count(*) n from e where split = 'evaluation' and instruction_sha256 not in (select instruction_sha256 from e where split = 'calibration') group by 1",
    "j_disjointness": f"with {EV} select instruction_sha256 from ev where split = 'calibration' and instruction_sha256 is not null intersect select instruction_sha256 from ev where split = 'evaluation'",
    "j_cases_by_domain": rf"with {EV}, e as (select domain, regexp_extract(event_id, 'user_task_(\d+)', 1) u, regexp_extract(event_id, 'injection_task_(\d+)', 1) i from ev where source = 'agentdojo') select domain, count(distinct u) n_user, count(distinct i) n_injection, count(distinct (u, i)) n_pairs, count(distinct u) * count(distinct i) n_possible from e group by domain",
    "j_hard_flag_fail_closed": f"""with {EV}, t as (select event_id, source, domain, unnest(coalesce(target_functions, [tool_name])) tool from ev where target_functions is not null or tool_name is not null),
        r as (select lower(trim(source)) source, domain, tool, bool_or(capability_class = 'hard') hard from capability_registry group by all)
        select event_id, bool_or(coalesce(r.hard, true)) hard from t left join r using (source, domain, tool) group by event_id""",
    "w_dedup_first": f"with {RC} select lower(rendered_prompt_sha256) sha, min(event_id) event_id, count(*) - 1 n_removed from rc group by 1",
    "w_dedup_across_files": f"with {EV} select event_id, source_file from ev where instruction_sha256 is not null and quality_score >= 7 qualify row_number() over (partition by instruction_sha256 order by source_file, source_row_index, event_id) = 1",
}
