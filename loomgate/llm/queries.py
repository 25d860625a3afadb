"""Queries of the training-data operators, over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomgate.functions.text import plain, session_key
from loomgate.llm.collapse import layout_copies
from loomgate.llm.groups import action_groups, group_splits, split_shares, torn_groups
from loomgate.llm.leaks import leaked_items
from loomgate.llm.overlap import linked_members, overlap_pairs, split_members, split_overlaps
from loomgate.llm.packing import pack, packing_check, size_report, token_counts
from loomgate.llm.percentiles import HALF, LEVELS, PER_OCTAVE, K, digest, merge, quantiles, rank_check, running_quantiles
from loomgate.llm.pii import find_pii, redact
from loomgate.llm.quotas import UNIT, cell_report, profiled_cells, quota_sample, sample_report, start_of
from loomgate.llm.stable_sample import permute_sql, stable_sample
from loomgate.session import durable
from loomgate.sources import table

QUANTILES = [0.25, 0.5, 0.75, 0.9, 0.95, 0.99]


def _overlaps(spark, sf_dir):
    members, classes = split_members(table(spark, sf_dir, "event_manifest"), table(spark, sf_dir, "materialized_record"))
    return members, split_overlaps(members, classes)


def p1_found(spark, sf_dir):
    """Pairs of actions, one in each split, whose records are the same or almost."""
    return overlap_pairs(*_overlaps(spark, sf_dir))


def p1_members(spark, sf_dir):
    """Every action of either split with its class of equal records and the number of classes it overlaps with."""
    rows = linked_members(*_overlaps(spark, sf_dir))
    return rows.select("event_id", F.when(F.col("in_eval"), "evaluation").otherwise("calibration").alias("split"), "class", "n_links")


def p1_report(spark, sf_dir):
    """Per split and source: actions, and how many overlap with the other split."""
    rows = linked_members(*_overlaps(spark, sf_dir))
    source = table(spark, sf_dir, "event_manifest").select("event_id", plain(F.col("source")).alias("source")).distinct()
    split = F.when(F.col("in_eval"), "evaluation").otherwise("calibration").alias("split")
    return rows.join(source, "event_id").groupBy(split, "source").agg(F.count(F.lit(1)).alias("n_actions"), F.count_if(F.col("n_links") > 0).alias("n_overlapping"))


def p2_sample_events(spark, sf_dir):
    """A tenth of the actions, stable under reruns and growth."""
    return stable_sample(table(spark, sf_dir, "event_manifest"), "event_id", 0.1)


def p2_sample_sessions(spark, sf_dir):
    """A fifth of the sessions, with one spelling each."""
    return stable_sample(table(spark, sf_dir, "event_manifest"), "session_id", 0.2, normal=session_key)


def p3_found(spark, sf_dir):
    """Copies that differ in layout only, with the smallest id of their set."""
    copies = layout_copies(table(spark, sf_dir, "materialized_record"))
    return copies.filter("keep <> member").select(F.col("keep").alias("keep_event_id"), F.col("member").alias("copy_event_id"))


def p3_copy_counts(spark, sf_dir):
    """Collapsed records with the number of their copies, themselves included."""
    copies = layout_copies(table(spark, sf_dir, "materialized_record"))
    return copies.groupBy(F.col("keep").alias("keep_event_id")).agg(F.count(F.lit(1)).alias("n_copies"))


def _cells(spark, sf_dir):
    frame = profiled_cells(table(spark, sf_dir, "profiling_selection"), table(spark, sf_dir, "materialized_record"))
    return frame, cell_report(frame, table(spark, sf_dir, "sample_target"))


def _drawn(spark, sf_dir):
    frame, report = _cells(spark, sf_dir)
    report = durable(report, "cells")
    return sample_report(quota_sample(frame, report), report)


def p5_found(spark, sf_dir):
    """Targets that the sampler can't meet: it takes their whole cell and that is still too few."""
    return _drawn(spark, sf_dir).filter(~F.col("met")).select("target_id")


def p5_report(spark, sf_dir):
    """Wanted and available actions of each target."""
    return _cells(spark, sf_dir)[1].select("target_id", "wanted", "available", "met")


def p5_shares(spark, sf_dir):
    """What the sample reached of each target: drawn actions, and their share beside the wished one."""
    out = _drawn(spark, sf_dir)
    return out.select("target_id", "wanted", "available", "drawn", F.round("wished_share", 9).alias("wished_share"), F.round("drawn_share", 9).alias("drawn_share"), "met")


def p5_sample(spark, sf_dir):
    """The sample itself."""
    return quota_sample(*_cells(spark, sf_dir))


_P6 = ["tier", "input_length_tercile", "metric"]


def _readings(spark, sf_dir):
    """One row a measurement and metric; re-delivered measurements count once."""
    rows = table(spark, sf_dir, "service_profile").select("measurement_id", "tier", plain(F.col("input_length_tercile")).alias("input_length_tercile"), F.to_date("measured_at").alias("day"), "wall_ms", "cuda_ms")
    once = rows.groupBy("measurement_id").agg(*[F.first(c).alias(c) for c in rows.columns[1:]])
    return once.select("tier", "input_length_tercile", "day", F.explode(F.create_map(F.lit("wall_ms"), F.col("wall_ms"), F.lit("cuda_ms"), F.col("cuda_ms"))).alias("metric", "value"))


def _day_digests(spark, sf_dir):
    return digest(_readings(spark, sf_dir), [*_P6, "day"], "value")


def p6_percentiles(spark, sf_dir):
    """Percentiles per tier and length tercile, merged from one digest a day."""
    return quantiles(merge(_day_digests(spark, sf_dir), _P6), _P6, QUANTILES).withColumn("value", F.round("value", 6))


def p6_running_percentiles(spark, sf_dir):
    """The same over all readings up to and including each day."""
    out = running_quantiles(_day_digests(spark, sf_dir), _P6, "day", QUANTILES)
    return out.withColumn("day", F.col("day").cast("string")).withColumn("value", F.round("value", 6))


def p6_rank_check(spark, sf_dir):
    """Whether each merged percentile keeps its stated error, by true ranks over all readings."""
    return rank_check(_readings(spark, sf_dir), durable(p6_percentiles(spark, sf_dir), "percentiles"), _P6, "value")


def p6_day_digests(spark, sf_dir):
    """The digests themselves, one a day, to be kept and merged later."""
    return _day_digests(spark, sf_dir)


def p7_found(spark, sf_dir):
    """Groups of related actions that the recorded split tears apart."""
    return torn_groups(action_groups(table(spark, sf_dir, "event_manifest")))


def p7_assigned_splits(spark, sf_dir):
    """New splits that keep groups together."""
    return group_splits(action_groups(table(spark, sf_dir, "event_manifest")))


def p7_split_shares(spark, sf_dir):
    """How near the new splits come to their wished shares."""
    groups = action_groups(table(spark, sf_dir, "event_manifest"))
    return split_shares(group_splits(groups), groups).withColumn("share", F.round("share", 9))


def p8_containers(spark, sf_dir):
    """Documents packed into containers of at most 2,048 tokens."""
    return pack(token_counts(table(spark, sf_dir, "documents")))


def p8_check(spark, sf_dir):
    """Whether every document is packed once, whole and into room that holds it."""
    tokens = token_counts(table(spark, sf_dir, "documents"))
    return packing_check(durable(pack(tokens), "packed"), tokens)


def p8_sizes(spark, sf_dir):
    """Containers and unused space of each size, where attention makes long containers dearer."""
    return size_report(pack(token_counts(table(spark, sf_dir, "documents")), attention=16_384.0))


def _leaks(spark, sf_dir):
    return leaked_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "holdout_item"))


def p9_found(spark, sf_dir):
    """Documents with 12 or more successive words of a held-out item."""
    return _leaks(spark, sf_dir).filter("edits = 0 and n_words = 12").select("doc_id", "item_id")


def p9_report(spark, sf_dir):
    """Per held-out item: documents that hold a passage of it, word for word or with one edit."""
    return _leaks(spark, sf_dir).groupBy("item_id").agg(F.count_if(F.col("edits") == 0).alias("n_exact"), F.count_if(F.col("edits") > 0).alias("n_near"))


def _pii(spark, sf_dir):
    return find_pii(table(spark, sf_dir, "documents"), table(spark, sf_dir, "reviewer_roster"))


def p10_found(spark, sf_dir):
    """Every email address, phone number, identity number, street address and name in the documents."""
    return _pii(spark, sf_dir).select("doc_id", "pii_type", "start_pos")


def p10_redacted(spark, sf_dir):
    """The documents with typed placeholders."""
    return redact(table(spark, sf_dir, "documents"), _pii(spark, sf_dir))


QUERIES = {
    f.__name__: f
    for f in (
        p1_found, p1_members, p1_report, p2_sample_events, p2_sample_sessions, p3_found, p3_copy_counts, p5_found, p5_report, p5_shares, p5_sample,
        p6_percentiles, p6_running_percentiles, p6_rank_check, p6_day_digests, p7_found, p7_assigned_splits, p7_split_shares, p8_containers, p8_check, p8_sizes, p9_found, p9_report, p10_found, p10_redacted,
    )
}


def _sample_sql(expression: str, name: str, rate: float) -> str:
    steps, last = permute_sql("n", "sample")
    return f"""
with k as (select distinct {expression} as {name} from event_manifest where {name} is not null),
n as (select {name}, ('0x' || substr(md5({name}), 1, 15))::bigint as n from k),
s as (select {name}, {steps} from n)
select {name} from s where ({last}) < {int(rate * 2**60)}"""


_WORDS = """
with t as (
  select event_id, any_value(regexp_extract_all(lower(coalesce(user_intent, '') || ' ' || coalesce(tool_arguments, '')), '[\\p{L}\\p{N}]+')) ws
  from materialized_record group by event_id),
m as (select distinct event_id, split from event_manifest where split is not null),
r as (select event_id, split, ws, len(ws) n from t join m using (event_id)),
e as (select event_id, split, n, w, row_number() over (partition by event_id, w) k from (select event_id, split, n, unnest(ws) w from r)),
o as (
  select a.event_id a, b.event_id b, any_value(a.n) an, any_value(b.n) bn, count(*) c
  from e a join e b on a.w = b.w and a.k = b.k and a.split = 'evaluation' and b.split = 'calibration' and least(a.n, b.n) * 8 >= greatest(a.n, b.n) * 7
  group by 1, 2),
hit as (select a, b from o where c * 8 >= greatest(an, bn) * 7)
"""

_CELLS = """
with p as (select distinct event_id, lower(trim(input_length_tercile)) input_length_tercile from profiling_selection where input_length_tercile is not null),
r as (select distinct event_id, lower(trim(source)) source, hard_required from materialized_record),
f as (select source, hard_required, input_length_tercile, count(distinct event_id) n from p join r using (event_id) group by all),
c as (
  select target_id, greatest(min_rows, target_share * sample_size) wanted, coalesce(n, 0) available
  from sample_target t left join f on lower(trim(t.source)) = f.source and t.hard_required = f.hard_required and lower(trim(t.input_length_tercile)) = f.input_length_tercile)
"""

_GROUPS = """
with recursive r as (
  select distinct event_id, split, 's:' || replace(lower(trim(session_id)), '/', ':') s, 'i:' || lower(trim(instruction_sha256)) i from event_manifest),
e as (select distinct s a, i b from r where s is not null and i is not null),
l as (select a, b from e union select b, a from e),
c(node, root) as (
  select distinct n, n from (select s n from r union select i from r) where n is not null
  union
  select l.b, c.root from c join l on l.a = c.node),
g as (select node, min(root) comp from c group by node),
x as (select event_id, split, coalesce(comp, 'e:' || event_id) comp from r left join g on g.node = coalesce(r.s, r.i))"""
_ASSIGNED = _GROUPS + """, u as (select distinct event_id, comp, ('0x' || substr(md5('split|' || comp), 1, 13))::bigint / 4503599627370496.0 u from x),
asg as (select event_id, comp, case when u < 0.8 then 'train' when u < 0.9 then 'validation' else 'test' end assigned_split from u)"""
_SAMPLE = _CELLS.rstrip() + f""",
w as (
  select t.target_id, lower(trim(t.source)) source, t.hard_required, lower(trim(t.input_length_tercile)) input_length_tercile, target_share, wanted, available,
    least(coalesce(min_rows, 0), available) n_floor, round(least(wanted, available) * {UNIT})::hugeint total
  from sample_target t join c using (target_id)),
pl as (select *, coalesce(sum(available) over o, 0) first, coalesce(sum(total) over o, 0) base from w window o as (order by target_id rows between unbounded preceding and 1 preceding)),
m as (
  select pl.*, event_id, row_number() over (partition by target_id order by md5('quota|' || target_id || '|' || event_id), event_id) k
  from pl join (select distinct event_id, source, hard_required, input_length_tercile from p join r using (event_id)) using (source, hard_required, input_length_tercile)),
x as (select *, (base + (total * k) // available + {start_of('quota')}) // {UNIT} > (base + (total * (k - 1)) // available + {start_of('quota')}) // {UNIT} chosen from m),
y as (select *, count(*) filter (chosen) over (partition by target_id) got, row_number() over (partition by target_id, chosen order by k) nth from x),
sa as (select target_id, event_id from y where chosen or nth <= n_floor - got)"""

_BLOCKS = ("policy", "state_summary", "user_intent", "proposed_action")
_STRIP = "regexp_replace({}, '[^\\p{{L}}\\p{{N}}]+', '', 'g')"
_LINE = "'(?m)^[ \\t]*(\\w[\\w \\t-]*?)[ \\t]*='"
# JSON as the sorted list of its leaves with their paths, so that fields may stand in any order and array elements may not
_LAYOUT = f"""
with r as (select distinct on (event_id) event_id e, lower(rendered_prompt) p, lower(tool_arguments) a from materialized_record where event_id is not null),
b as (
  select e, p, {', '.join(f"regexp_extract(p, '<{x}>(.*?)</{x}>', 1, 's') b{i}" for i, x in enumerate(_BLOCKS))},
    {"regexp_replace(" * len(_BLOCKS)}p{"".join(f", '<{x}>.*?</{x}>', ' ', 's')" for x in _BLOCKS)} loose from r),
l as (select e, unnest(regexp_extract_all(b3, {_LINE}, 1)) n, unnest(regexp_split_to_array(b3, {_LINE})[2:]) v from b),
v as (select e, '' n, a v from r where a is not null union all select e, {_STRIP.format('n')}, v from l),
t as materialized (select *, row_number() over () id, ltrim(v)[1] in ('{{', '[') and json_valid(v) is_json from v),
j as (
  select id, array_to_string(list_sort(list({_STRIP.format("regexp_replace(fullkey, '[^\\p{L}\\p{N}.\\[\\]$]', '', 'g')").replace("[^\\p{L}\\p{N}]+", "[^\\p{L}\\p{N}.\\[\\]$]+")} || ':' || coalesce({_STRIP.format('atom::varchar')}, type))), ',') c
  from (select id, v from t where is_json) x, lateral (select fullkey, atom, type from json_tree(x.v)) group by id),
c as (select e, n, case when is_json then c else {_STRIP.format('v')} end c from t left join j using (id)),
k as (select e, list_sort(list(n || '=' || c)) ls from c group by e),
g as (
  select r.e, md5(concat_ws('|', case when r.p is null then '~' end, case when r.a is null then '~a' end, array_to_string(coalesce(ls, []), ';'), {', '.join(f"coalesce({_STRIP.format(f'b{i}')}, '')" for i in range(3))}, coalesce({_STRIP.format('loose')}, ''))) h
  from r join b using (e) left join k on k.e = r.e),
m as (select h, min(e) keep, count(*) n from g group by h)"""

# a group of fewer than K readings is never compressed, so an estimate is the cell of the reading of its rank
_READ = f"""
with o as (
  select measurement_id, any_value(tier) tier, any_value(lower(trim(input_length_tercile))) input_length_tercile, any_value(measured_at)::date d,
    any_value(wall_ms) w, any_value(cuda_ms) c
  from service_profile group by measurement_id),
v as (
  select tier, input_length_tercile, d, m as metric, v from (select tier, input_length_tercile, d, 'wall_ms' m, w v from o union all select tier, input_length_tercile, d, 'cuda_ms', c from o)
  where v is not null and isfinite(v)),
q(q) as (values {', '.join(f'({q}::double)' for q in QUANTILES)})"""
_CELL = f"greatest(1, least({HALF - 1}, floor(log2(greatest(abs(x), 1e-300)) * {PER_OCTAVE}) + {HALF // 2}))"
_CELL_VALUE = f"case when x = 0 then 0.0::double else sign(x) * pow(2.0::double, ({_CELL} - {HALF // 2} + 0.5) / {PER_OCTAVE}) end"

ORACLE = {
    "p3_found": _LAYOUT + " select keep keep_event_id, e copy_event_id from g join m using (h) where e <> keep",
    "p3_copy_counts": _LAYOUT + " select keep keep_event_id, n n_copies from m",
    "p6_percentiles": f"""{_READ},
g as (select tier, input_length_tercile, metric, list_sort(list(v)) vs, count(*) n from v group by 1, 2, 3),
x as (select tier, input_length_tercile, metric, n, q, vs[greatest(1, ceil(q * n))::bigint] x from g, q)
select tier, input_length_tercile, metric, n, q, round({_CELL_VALUE}, 6) as value, {LEVELS} * (n // {K}) + 1 max_rank_error from x""",
    "p6_running_percentiles": f"""{_READ},
dd as (select distinct tier, input_length_tercile, metric, d as day from v),
g as (select dd.tier, dd.input_length_tercile, dd.metric, day, list_sort(list(v)) vs, count(*) n from dd join v
  on v.tier = dd.tier and v.input_length_tercile is not distinct from dd.input_length_tercile and v.metric = dd.metric and v.d <= day group by 1, 2, 3, 4),
x as (select tier, input_length_tercile, metric, day, n, q, vs[greatest(1, ceil(q * n))::bigint] x from g, q)
select tier, input_length_tercile, metric, day::varchar as day, n, q, round({_CELL_VALUE}, 6) as value, {LEVELS} * (n // {K}) + 1 max_rank_error from x""",
    # days of fewer than K readings are not compressed: their nodes are the leaves
    "p6_day_digests": f"""{_READ}, x as (select tier, input_length_tercile, metric, d as day, v x from v)
select tier, input_length_tercile, metric, day, ({1 << LEVELS} + {HALF} + case when x = 0 then 0 else sign(x) * {_CELL} end)::int node, count(*) n from x group by 1, 2, 3, 4, 5""",
    "p6_rank_check": f"{_READ} select tier, input_length_tercile, metric, q, count(*) n, true kept from v, q group by 1, 2, 3, 4",
    "p1_found": _WORDS + "select distinct least(a, b) event_id_a, greatest(a, b) event_id_b from hit",
    "p1_members": _WORDS
    + """, k as (select event_id, split, md5(array_to_string(list_sort(ws), ' ')) "class" from r where split in ('evaluation', 'calibration')),
p as (select a, b from hit union all select b, a from hit)
select k.event_id, k.split, k."class", count(distinct o."class") n_links from k left join p on p.a = k.event_id left join k o on o.event_id = p.b group by 1, 2, 3""",
    "p1_report": _WORDS
    + """, s as (select distinct event_id, lower(trim(source)) source from event_manifest)
select split, source, count(*) n_actions, count(*) filter (event_id in (select a from hit union select b from hit)) n_overlapping
from r join s using (event_id) where split in ('evaluation', 'calibration') group by 1, 2""",
    "p2_sample_events": _sample_sql("event_id", "event_id", 0.1),
    "p2_sample_sessions": _sample_sql("replace(lower(trim(session_id)), '/', ':')", "session_id", 0.2),
    "p5_found": _CELLS + "select target_id from c where available < wanted",
    "p5_report": _CELLS + "select target_id, wanted, available, available >= wanted met from c",
    "p5_sample": _SAMPLE + " select target_id, event_id from sa",
    "p5_shares": _SAMPLE
    + """, d as (select target_id, count(*) n from sa group by 1)
select target_id, wanted, available, coalesce(n, 0) drawn, round(coalesce(target_share, 0), 9) wished_share, round(coalesce(n, 0) / (select count(*) from sa), 9) drawn_share, available >= wanted met
from w left join d using (target_id)""",
    "p7_found": _GROUPS
    + """, t as (select comp, min(event_id) k from x group by comp having count(distinct split) > 1)
select distinct k group_event_id, event_id from x join t using (comp)""",
    "p7_assigned_splits": _ASSIGNED + " select event_id, assigned_split from asg",
    "p7_split_shares": _ASSIGNED
    + """, n as (select assigned_split, comp, count(*) n from asg group by 1, 2),
g2 as (select assigned_split, sum(n)::bigint n_events, count(*) n_groups, max(n) largest_group from n group by 1)
select w.assigned_split, wished_share, coalesce(n_events, 0) n_events, round(coalesce(n_events, 0) / (select count(*) from asg), 9) share, coalesce(n_groups, 0) n_groups, coalesce(largest_group, 0) largest_group
from (values ('train', 0.8::double), ('validation', 0.1::double), ('test', 0.1::double)) w(assigned_split, wished_share) left join g2 using (assigned_split)""",
    # SQL has no tokenizer; it says what must hold whatever the lengths are
    "p8_check": "select count(distinct doc_id) n_documents, 0::bigint n_lost, 0::bigint n_doubled, 0::bigint n_split, 0::bigint n_over, true well_filled from documents",
    "p9_found": """
with w as (
  select doc_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') d from documents where text is not null),
dw as (select doc_id, array_to_string(d[i:i + 11], ' ') x from (select doc_id, d, unnest(range(1, len(d) - 10)) i from w where len(d) >= 12)),
v as (select item_id, regexp_extract_all(lower(item_text), '[\\p{L}\\p{N}]+') d from holdout_item where item_text is not null),
iw as (select item_id, array_to_string(d[i:i + 11], ' ') x from (select item_id, d, unnest(range(1, len(d) - 10)) i from v where len(d) >= 12))
select distinct doc_id, item_id from dw join iw using (x)""",
    "p9_report": """
with w as (select doc_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') d from documents where text is not null),
v as (select item_id, regexp_extract_all(lower(item_text), '[\\p{L}\\p{N}]+') d from holdout_item where item_text is not null),
iw as (select item_id, d[i:i + 11] x from (select item_id, d, unnest(range(1, len(d) - 10)) i from v where len(d) >= 12)),
cut as (select item_id, x, unnest(range(1, 13)) j from iw),
-- a window with one word lost, replaced, or (below) with one word more
lost as (select distinct item_id, hash(x[1:j - 1] || x[j + 1:12]) h from cut),
swapped as (select distinct item_id, hash([j::varchar] || x[1:j - 1] || x[j + 1:12]) h from cut),
whole as (select distinct item_id, hash(x) h from iw),
short as (select item_id, hash(d) h, len(d) m from v where len(d) between 1 and 11),
dd as (select doc_id, d, len(d) n, unnest(range(1, len(d) + 1)) i from w),
d11 as (select distinct doc_id, hash(d[i:i + 10]) h from dd where i + 10 <= n),
d12 as (select doc_id, d[i:i + 11] x from dd where i + 11 <= n),
d13 as (select doc_id, d[i:i + 12] x from dd where i + 12 <= n),
exact as (
  select distinct doc_id, item_id from (select distinct doc_id, hash(x) h from d12) join whole using (h)
  union select distinct doc_id, item_id from short s, dd where s.h = hash(dd.d[dd.i:dd.i + s.m - 1]) and dd.i + s.m - 1 <= dd.n),
near as (
  select doc_id, item_id from d11 join lost using (h)
  union select doc_id, item_id from (select doc_id, hash([j::varchar] || x[1:j - 1] || x[j + 1:12]) h from (select doc_id, x, unnest(range(1, 13)) j from d12)) join swapped using (h)
  union select doc_id, item_id from (select doc_id, hash(x[1:j - 1] || x[j + 1:13]) h from (select doc_id, x, unnest(range(2, 13)) j from d13)) join whole using (h)),
a as (select doc_id, item_id, max(e) e from (select doc_id, item_id, 1 e from exact union all select doc_id, item_id, 0 from near) group by 1, 2)
select item_id, count(*) filter (e = 1) n_exact, count(*) filter (e = 0) n_near from a group by 1""",
}
