"""Selections, set operations and audits of manifests, records, caches and replays."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomgate.functions.hashing import stable_key
from loomgate.functions.text import plain
from loomgate.operators.audit import check_rules, failing_rows
from loomgate.operators.selection import equal_quota, exact_subset, fixed_quota_sample, largest_remainder, top_by_hash
from loomgate.plans.aggregates import w_coverage_first
from loomgate.plans.base import EV, RC, SC, SP, events, measurements, records, scores
from loomgate.plans.queueing import CANDIDATE, METHODS, REGIMES, SEEDS, _metrics, replay
from loomgate.plans.scalar import j_hard_flag_fail_closed
from loomgate.sources import table

# What a file name says about its plans, and fields that must not reach a verifier.
FILE_KINDS = {"BO": "Bias & Offensiveness", "PD": "Property Damage", "PI": "Physical Injury", "PL": "Privacy Leak"}
FORBIDDEN = ("instruction", "explanation", "used_api", "output")
#: Least volumes, for tables of this size: actions, hard ones, benign and unsafe calibration rows.
VOLUMES = {"n_actions": 1000, "n_hard": 100, "n_benign_calibration": 50, "n_unsafe_calibration": 149}
SELECTED = ["event_id", "source", "domain", "split", "tool_name", "hard_required"]


def p_scored_five(spark, d):
    """Actions that the five-method replay scores."""
    e = events(spark, d).filter("(source = 'tau2-bench' and split in ('calibration', 'evaluation')) or (source = 'safetoolbench' and split = 'calibration')")
    return e.select("event_id", "source", "split")


def p_scored_serial(spark, d):
    """Actions that the serial replay scores."""
    return events(spark, d).filter(F.col("source").isin("tau2-bench", "safetoolbench")).select("event_id", "source")


def p_evaluation_slice(spark, d):
    """Size and source mix of the evaluation slice, beside what the replay could use."""
    s = scores(spark, d).filter("status = 'ok'").groupBy("event_id").agg(F.count_distinct("tier").alias("tiers"))
    e = events(spark, d).filter("split = 'evaluation'").join(s, "event_id", "left")
    return e.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.coalesce("tiers", F.lit(0)) == 2).alias("n_scored"))


def p_forbidden_fields(spark, d):
    """Records whose arguments have a top-level field that must not be there."""
    keys = F.json_object_keys("tool_arguments")
    bad = F.coalesce(F.arrays_overlap(keys, F.array(*[F.lit(f) for f in FORBIDDEN])), F.lit(False))
    return records(spark, d).groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.count_if(bad).alias("n_forbidden"), F.count_if(keys.isNotNull()).alias("n_objects"))


def p_first_of_source(spark, d):
    """The first five actions of each source by id."""
    return top_by_hash(events(spark, d).select("source", "event_id"), ["source"], F.col("event_id"), "event_id", 5)


def j_manifest_records(spark, d):
    """Manifest and records column by column, as text, a null like an empty text; and what is on one side only."""
    columns = ("source", "source_version", "tool_name", "hard_required")
    text = lambda side, c: F.coalesce(F.col(f"{side}.{c}").cast("string"), F.lit(""))
    e, r = events(spark, d).alias("e"), records(spark, d).alias("r")
    both = e.join(r, F.col("e.event_id") == F.col("r.event_id"), "full_outer")
    one = F.when(F.col("r.event_id").isNull(), "manifest only").when(F.col("e.event_id").isNull(), "records only")
    differ = F.concat_ws(",", *[F.when(text("e", c) != text("r", c), F.lit(c)) for c in columns])
    return both.groupBy(F.coalesce(one, F.when(differ == "", F.lit("equal")).otherwise(differ)).alias("state")).agg(F.count(F.lit(1)).alias("n"))


def a_prompt_digests(spark, d):
    """The prompt digests of each source with their number, copies counted."""
    return records(spark, d).filter("rendered_prompt_sha256 is not null").groupBy("source", F.lower("rendered_prompt_sha256").alias("sha")).agg(F.count(F.lit(1)).alias("n"))


def o_tasks_by_number(spark, d):
    """Tasks of an area in the order of their numbers, not of their text."""
    from pyspark.sql import Window

    part = F.split("event_id", ":")
    t = events(spark, d).filter("source = 'tau2-bench'").select(part[1].alias("area"), F.expr("try_cast(split(event_id, ':')[2] as bigint)").alias("task")).filter("task is not null").distinct()
    return t.withColumn("place", F.row_number().over(Window.partitionBy("area").orderBy("task")).cast("bigint"))


def u_same_actions(spark, d):
    """Whether the two tiers have scored the same actions, and what differs."""
    s = scores(spark, d).filter("status = 'ok' and event_id is not null")
    a, b = (s.filter(F.col("tier") == t).select("event_id").distinct().withColumn(t, F.lit(True)) for t in ("light", "strong"))
    both = a.join(b, "event_id", "full_outer").agg(F.count_if(F.col("strong").isNull()).alias("n_light_only"), F.count_if(F.col("light").isNull()).alias("n_strong_only"))
    return both.withColumn("same", (F.col("n_light_only") == 0) & (F.col("n_strong_only") == 0))


def u_known_tools(spark, d):
    """Tools of a source in the registry or in the manifest."""
    e = events(spark, d)
    tools = F.array_union(F.coalesce("target_functions", F.array().cast("array<string>")), F.coalesce("tool_names", F.array().cast("array<string>")))
    used = e.select("source", F.explode(F.array_union(tools, F.array("tool_name"))).alias("tool"))
    known = table(spark, d, "capability_registry").select(plain(F.col("source")).alias("source"), "tool")
    return used.unionByName(known).filter("tool is not null").distinct()


def f_selection_digest(spark, d):
    """Digest of each source's selection: the sum of the digests of its rows as canonical JSON; any order gives the same."""
    row = F.to_json(F.struct(*sorted(SELECTED)), {"ignoreNullFields": "false"})
    number = F.conv(F.substring(F.sha2(row, 256), 1, 15), 16, 10).cast("decimal(20,0)")
    return events(spark, d).groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.sum(number).cast("string").alias("digest"))


def f_masked_labels(spark, d):
    """Label probabilities with abstention masked out."""
    p = F.map_filter("constrained_label_probabilities", lambda k, v: k.isin("0", "1"))
    total = F.aggregate(F.map_values(p), F.lit(0.0), lambda a, x: a + x)
    return scores(spark, d).filter("status = 'ok' and constrained_label_probabilities is not null").select("tier", "event_id", F.round(p["0"] / total, 6).alias("allow"), F.round(p["1"] / total, 6).alias("block"))


def f_call_tools(spark, d):
    """Tool names of planned calls: the keys of each call but ``use_times``; nothing for other forms."""
    r = records(spark, d).filter("source = 'safetoolbench'")
    calls = F.from_json("tool_arguments", "array<map<string,string>>")
    names = F.filter(F.flatten(F.transform(calls, lambda c: F.map_keys(c))), lambda k: k != "use_times")
    return r.select("event_id", F.array_join(F.coalesce(names, F.array().cast("array<string>")), ",").alias("tools"))


def f_json_list(spark, d):
    """Lists of tools as JSON text with a blank after each comma."""
    text = F.concat(F.lit("["), F.array_join(F.transform("tool_names", lambda t: F.concat(F.lit('"'), t, F.lit('"'))), ", "), F.lit("]"))
    return events(spark, d).filter("tool_names is not null").select("event_id", text.alias("tools"))


def f_first_present(spark, d):
    """The first text of a record that says something."""
    said = [F.when(F.trim(c) != "", F.trim(c)) for c in ("state_summary", "user_intent", "policy_text")]
    names = F.when(said[0].isNotNull(), "state_summary").when(said[1].isNotNull(), "user_intent").when(said[2].isNotNull(), "policy_text").otherwise("none")
    return records(spark, d).select("event_id", names.alias("field"), F.length(F.coalesce(*said, F.lit(""))).cast("bigint").alias("n_chars"))


def f_file_kinds(spark, d):
    """Kinds of plans by the prefix of their file, with its path in one notation."""
    path = F.translate("source_file", "\\", "/")
    kind = F.element_at(F.create_map(*[F.lit(x) for kv in FILE_KINDS.items() for x in kv]), F.regexp_extract(path, r"query_([A-Z]{2})_[A-Z]{2}\.json$", 1))
    return events(spark, d).filter("source_file is not null").groupBy(path.alias("path"), F.coalesce(F.try_element_at(F.array(kind), F.lit(1)), F.lit("unknown")).alias("kind")).agg(F.count(F.lit(1)).alias("n"))


def l_exact_subset(spark, d):
    """Whole sessions whose evaluation actions are exactly 100 together."""
    s = events(spark, d).filter("source = 'tau2-bench' and split = 'evaluation' and session_id is not null").groupBy("session_id").agg(F.count(F.lit(1)).alias("n"))
    return exact_subset(s, 100, stable_key("subset", F.col("session_id")))


def l_source_audit(spark, d):
    """Per file: plans, those under the quality floor, copies of an earlier plan's instruction, and what is left."""
    e = events(spark, d).filter("source = 'safetoolbench'").withColumn("good", F.coalesce(F.col("quality_score") >= 7, F.lit(False)))
    place = F.format_string("%s|%012d|%s", F.coalesce("source_file", F.lit("")), F.coalesce("source_row_index", F.lit(0)), F.col("event_id"))
    e = e.withColumn("place", place)
    first = e.filter("good and instruction_sha256 is not null").groupBy("instruction_sha256").agg(F.min("place").alias("first"))
    rows = e.join(first, "instruction_sha256", "left").withColumn("kept", F.col("good") & (F.coalesce("first", F.col("place")) == F.col("place")))
    return rows.groupBy("source_file").agg(F.count(F.lit(1)).alias("n"), F.count_if(~F.col("good")).alias("n_low"), F.count_if(F.col("good") & ~F.col("kept")).alias("n_copies"), F.count_if("kept").alias("n_kept"))


def l_equal_quota_pick(spark, d):
    """60 calibration plans, the same number from each stratum, by hash order."""
    e = events(spark, d).filter("source = 'safetoolbench' and split = 'calibration'").select("domain", "event_id")
    quota = equal_quota(e.select("domain").distinct(), "domain", stable_key("quota", F.col("domain")), 60)
    return top_by_hash(e.join(F.broadcast(quota), "domain"), ["domain"], stable_key("calibration", F.col("event_id")), "event_id", F.col("quota")).select("domain", "event_id")


def l_case_pick(spark, d):
    """60 injection cases in proportion to their domains, those that cover an injection task first, with the fail-closed hard flag."""
    from pyspark.sql import Window

    n = events(spark, d).filter("source = 'agentdojo'").groupBy("domain").agg(F.count(F.lit(1)).alias("n"))
    quota = largest_remainder(n, "domain", "n", 60)
    cases = w_coverage_first(spark, d).join(F.broadcast(quota), "domain")  # one row a domain
    w = Window.partitionBy("domain").orderBy(F.desc("covers"), stable_key("case", F.col("event_id")), "event_id")
    covering = F.sum(F.col("covers").cast("int")).over(Window.partitionBy("domain"))
    picked = cases.withColumn("k", F.row_number().over(w)).withColumn("c", covering).filter(F.col("k") <= F.greatest("quota", "c"))
    return picked.select("domain", "event_id", "covers").join(j_hard_flag_fail_closed(spark, d), "event_id", "left")


def l_envelopes(spark, d):
    """Cases left after taking out those under review, with the targets that a reviewer put in place of the declared ones."""
    e = events(spark, d).filter("source = 'agentdojo'")
    out = e.filter("semantic_label_review = 'PENDING'").select("event_id")
    override = F.when(F.size(F.coalesce("target_functions", F.array().cast("array<string>"))) == 0, F.coalesce("tool_names", F.array().cast("array<string>"))).otherwise(F.col("target_functions"))
    return e.join(out, "event_id", "left_anti").select("event_id", F.array_join(override, ",").alias("targets"))


def l_volume_gates(spark, d):
    """Whether the selection is large enough, gate by gate."""
    e = events(spark, d)
    unsafe = (F.col("split") == "calibration") & (F.col("ground_truth_safety") == "unsafe_for_light_allow")
    benign = (F.col("split") == "calibration") & (F.col("ground_truth_safety") == "benign_expected")
    one = e.agg(F.count(F.lit(1)).alias("n_actions"), F.count_if("hard_required").alias("n_hard"), F.count_if(benign).alias("n_benign_calibration"), F.count_if(unsafe).alias("n_unsafe_calibration"))
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("gate"), F.col(k).alias("n"), F.lit(v).alias("least")) for k, v in VOLUMES.items()])).alias("g")
    return one.select(each).select("g.gate", "g.n", F.col("g.least").cast("bigint").alias("least"), (F.col("g.n") >= F.col("g.least")).alias("passes"))


_BINS = ("long", "medium", "short")


def _quota_frame(spark, d):
    s = table(spark, d, "profiling_selection").select("event_id", plain(F.col("input_length_tercile")).alias("bin")).filter("bin is not null").distinct()
    return s.join(records(spark, d).select("event_id", (F.col("source") == "safetoolbench").alias("is_first"), F.coalesce("hard_required", F.lit(False)).alias("is_hard")), "event_id")


def l_fixed_quota_sample(spark, d):
    """Four actions of each length bin, three of them risky plans, and at least two hard ones among the others."""
    return fixed_quota_sample(_quota_frame(spark, d), {b: 4 for b in _BINS}, 3, 2, stable_key("fixed", F.col("event_id")))


def _record_checks():
    return {
        "has_record": F.col("r_source").isNotNull(), "same_source": F.col("source") == F.col("r_source"), "same_version": F.col("source_version").eqNullSafe(F.col("r_version")), "same_hard_flag": F.col("hard_required").eqNullSafe(F.col("r_hard")),
        "prompt_digest": F.col("r_own") == F.col("r_sha"), "split_known": F.col("split").isin("calibration", "evaluation"), "quality": (F.col("source") != "safetoolbench") | (F.col("quality_score") >= 7),
        "instruction_known": (F.col("source") != "safetoolbench") | F.col("instruction_sha256").isNotNull(), "tool_known": F.col("tool_name").isNotNull() | (F.size("tool_names") > 0) | (F.size("target_functions") > 0),
    }


def _with_records(spark, d):
    own = F.sha2("rendered_prompt", 256)
    r = records(spark, d).select("event_id", F.col("source").alias("r_source"), F.col("source_version").alias("r_version"), F.col("hard_required").alias("r_hard"), F.lower("rendered_prompt_sha256").alias("r_sha"), own.alias("r_own"))
    return events(spark, d).join(r, "event_id", "left")


def v_manifest_rules(spark, d):
    """Actions that break each of nine rules, by source."""
    return check_rules(_with_records(spark, d), _record_checks(), ["source"])


def v_manifest_failures(spark, d):
    """Actions with broken rules, and which."""
    return failing_rows(_with_records(spark, d), "event_id", _record_checks()).select("event_id", F.array_join("failed", ",").alias("failed"))


def v_manifest_readiness(spark, d):
    """What stands between the held-out plans and a verdict: open reviews and mappings, repeated and shared instructions."""
    e = events(spark, d).filter("source = 'safetoolbench'")
    side = e.groupBy("split").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("instruction_sha256").alias("n_instructions"), F.count_if(F.col("semantic_label_review").isNull() | (F.col("semantic_label_review") != "PASS")).alias("n_unreviewed"), F.count_if(F.coalesce("hard_mapping_status", F.lit("")) == "pending_review").alias("n_unmapped"))
    shared = e.filter("split is not null and instruction_sha256 is not null").groupBy("instruction_sha256").agg(F.count_distinct("split").alias("k")).agg(F.count_if(F.col("k") > 1).alias("n_shared"))
    out = side.join(F.broadcast(shared))  # one row
    return out.withColumn("ready", (F.col("n_unreviewed") == 0) & (F.col("n_unmapped") == 0) & (F.col("n_instructions") == F.col("n")) & (F.col("n_shared") == 0))


def v_cache_fields(spark, d):
    """Rows of the score cache that break the rules of the serial replay, by tier."""
    s = table(spark, d, "score_cache").withColumn("source", plain(F.col("source")))
    ok = F.col("status") == "ok"
    return check_rules(s, {
        "has_id": F.coalesce(F.length(F.trim("event_id")), F.lit(0)) > 0, "contract": F.col("score_cache_contract_version") == "serial.v2", "model": F.col("model_id").isNotNull() & F.col("revision").isNotNull(),
        "prompt_digest": F.lower("verifier_prompt_sha256").rlike("^[0-9a-f]{64}$"), "policy_digest": F.lower("policy_sha256").rlike("^[0-9a-f]{64}$"), "template_digest": F.lower("template_sha256").rlike("^[0-9a-f]{64}$"),
        "one_token": ~ok | (F.col("output_tokens") == 1), "label": ~ok | F.col("label").isin("0", "1", "2"), "probabilities": ~ok | (F.size("constrained_label_probabilities") == 3),
        "risk_in_range": ~ok | F.col("risk_score").between(0, 1), "input_tokens": F.col("input_tokens") > 0,
    }, ["tier"])


def v_selection_counts(spark, d):
    """Profiled actions by role and bin, with the number of different prompts."""
    s = table(spark, d, "profiling_selection").distinct()
    return s.groupBy("selection_role", "input_length_tercile").agg(F.count_distinct("event_id").alias("n"), F.count_distinct("profiling_prompt_sha256").alias("n_prompts"))


def v_measurement_recompute(spark, d):
    """Repetitions of each tier: actions whose repetitions are not numbered without gaps, or differ in prompt or input length."""
    m = measurements(spark, d)
    per = m.groupBy("tier", "event_id").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("repetition").alias("k"), (F.max("repetition") - F.min("repetition") + 1).alias("span"), F.count_distinct(F.lower("profiling_prompt_sha256")).alias("p"), F.count_distinct("input_tokens").alias("t"))
    return per.groupBy("tier").agg(F.count(F.lit(1)).alias("n_actions"), F.count_if((F.col("n") != F.col("k")) | (F.col("k") != F.col("span"))).alias("n_gaps"), F.count_if(F.col("p") > 1).alias("n_prompts_differ"), F.count_if(F.col("t") > 1).alias("n_tokens_differ"))


def v_digest_chain(spark, d):
    """Prompt digests from record to selection to measurement: how many actions agree at each link."""
    s = table(spark, d, "profiling_selection").select("event_id", F.lower("profiling_prompt_sha256").alias("s_sha")).distinct()
    r = records(spark, d).select("event_id", F.lower("rendered_prompt_sha256").alias("r_sha"))
    m = measurements(spark, d).groupBy("event_id").agg(F.min(F.lower("profiling_prompt_sha256")).alias("m_lo"), F.max(F.lower("profiling_prompt_sha256")).alias("m_hi"))
    both = s.join(r, "event_id", "left").join(m, "event_id", "left")
    return both.agg(
        F.count(F.lit(1)).alias("n_selected"), F.count_if(F.col("r_sha").isNull()).alias("n_no_record"), F.count_if(F.col("r_sha") == F.col("s_sha")).alias("n_record_agrees"), F.count_if(F.col("m_lo").isNull()).alias("n_unmeasured"),
        F.count_if((F.col("m_lo") == F.col("s_sha")) & (F.col("m_hi") == F.col("s_sha"))).alias("n_measurement_agrees"),
    )


def v_holdout(spark, d):
    """Held-out plans of each category: how many, how many instructions, and how many are also calibration instructions."""
    e = events(spark, d).filter("source = 'safetoolbench' and risk_category is not null")
    seen = e.filter("split = 'calibration' and instruction_sha256 is not null").select("instruction_sha256").distinct().withColumn("seen", F.lit(True))
    h = e.filter("split = 'evaluation'").join(seen, "instruction_sha256", "left")
    return h.groupBy("risk_category").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("instruction_sha256").alias("n_instructions"), F.count_if(F.coalesce("seen", F.lit(False))).alias("n_seen"))


def v_replay(spark, d):
    """Audit of the replays: every method has every scenario with all jobs, none downgraded, failed open or over the age limit."""
    m = _metrics(replay(spark, d))
    same = m.groupBy("regime", "seed").agg(F.min("n").alias("lo"), F.max("n").alias("hi"), F.count(F.lit(1)).alias("k"))
    whole = same.agg(F.every((F.col("lo") == F.col("hi")) & (F.col("k") == len(METHODS))).alias("paired"))
    per = m.groupBy("method").agg((F.count(F.lit(1)) == len(REGIMES) * len(SEEDS)).alias("complete"), F.every((F.col("n_hard_downgrades") == 0) & (F.col("n_fail_open") == 0)).alias("closed"), F.every(F.col("wait_max") <= 5_000_000).alias("within_limit"), F.every(F.col("n_completed") + F.col("n_starved") == F.col("n")).alias("all_accounted"), F.every(F.col("n_final_light_abstain") == 0).alias("contained"))
    return per.join(F.broadcast(whole))  # one row


def v_scenario_completeness(spark, d):
    """Jobs, completed and timed out, of each scenario of virtual finish."""
    done = replay(spark, d, (CANDIDATE,))
    return done.groupBy("regime", "seed").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("event_id").alias("n_different"), F.count_if("timed_out").alias("n_timed_out"))


QUERIES = {
    f.__name__: f
    for f in (
        p_scored_five, p_scored_serial, p_evaluation_slice, p_forbidden_fields, p_first_of_source, j_manifest_records, a_prompt_digests, o_tasks_by_number, u_same_actions, u_known_tools, f_selection_digest,
        f_masked_labels, f_call_tools, f_json_list, f_first_present, f_file_kinds, l_exact_subset, l_source_audit, l_equal_quota_pick, l_case_pick, l_envelopes, l_volume_gates, l_fixed_quota_sample,
        v_manifest_rules, v_manifest_failures, v_manifest_readiness, v_cache_fields, v_selection_counts, v_measurement_recompute, v_digest_chain, v_holdout, v_replay, v_scenario_completeness,
    )
}
