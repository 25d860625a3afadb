"""DuckDB SQL of the replay queries: the same traces, the same event loop as recursive queries."""

from __future__ import annotations

from loomgate.functions.hashing import mix_constants, mixed_sql, uniform_sql
from loomgate.operators.workload import REGIMES
from loomgate.plans import queueing as q
from loomgate.plans.base import EV, SC, SP

_REGIMES = ", ".join(f"('{r.name}', {r.rho}::double, {'null' if r.peak is None else r.peak}::double, {r.to_peak}::double, {r.to_background!r}::double)" for r in REGIMES)
_U = uniform_sql
_RISK = "case when isfinite(risk_score) then greatest(0.0, least(1.0, risk_score)) end"
_OK = f"coalesce({_RISK} <= (select thr from th), false)"
_BASE = f"""{EV}, {SC}, {SP},
  cal as (select ground_truth_safety = 'unsafe_for_light_allow' unsafe, label, {_RISK} risk from ev join sc using (event_id)
    where ev.split = 'calibration' and ground_truth_safety in ('unsafe_for_light_allow', 'benign_expected') and tier = 'light' and status = 'ok'),
  wo as (select min(coalesce(risk, 0.0)) filter (unsafe and label = '0') w, count(*) filter (unsafe) nu from cal),
  th as materialized (select case when nu = 0 then -1.0 when w is null then 1.0 when w <= 0 then -1.0 else nextafter(w::double, '-infinity'::double) end::double thr from wo),
  sx as (select ev.event_id, ev.session_id, coalesce(ev.hard_required, false) hard_required, ground_truth_safety, l.input_length_tercile, s.input_length_tercile t2, l.label light_label, l.risk_score, s.label strong_label
    from ev left join sc l on l.event_id = ev.event_id and l.tier = 'light' and l.status = 'ok' left join sc s on s.event_id = ev.event_id and s.tier = 'strong' and s.status = 'ok'
    where ev.split = 'evaluation'),
  sw as (select *, case when light_label is null then 'no light score' when strong_label is null then 'no strong score' when input_length_tercile is null or t2 is null then 'no length bin'
    when input_length_tercile <> t2 then 'length bins differ' end why from sx),
  jb as (select * exclude (t2, why) from sw where why is null)"""
_TENANTS = f"""
  ss as (select session_id, count(*) n from ev where split = 'evaluation' group by 1),
  so as materialized (select *, row_number() over (order by n desc, substr(sha256(coalesce(session_id, '')), 1, 16), session_id nulls first) i, round_even((sum(n) over ()) * {q.HEAVY_SHARE}::double, 0)::bigint target from ss),
  hv(i, h, heavy) as (
    select 0::bigint, 0::bigint, false
    union all
    select so.i, case when h < target and abs(h + n - target) <= abs(h - target) then h + n else h end, h < target and abs(h + n - target) <= abs(h - target) from hv join so on so.i = hv.i + 1),
  lo as materialized (select so.*, row_number() over (order by so.i) j from so join hv using (i) where not heavy),
  lt(j, loads, t) as (
    select 0::bigint, list_transform(range({q.TENANTS - 1}), lambda x: 0::bigint), 0::bigint
    union all
    select lo.j, list_transform(loads, lambda x, k: x + case when k = list_position(loads, list_min(loads)) then n else 0 end), list_position(loads, list_min(loads))::bigint from lt join lo on lo.j = lt.j + 1),
  tn as materialized (select session_id, n, 0 tenant_id from so join hv using (i) where heavy union all select session_id, n, t::int from lo join lt using (j))"""
_ARRIVALS = f"""{_BASE}, {_TENANTS},
  smp as materialized (select measurement_id, tier, input_length_tercile, round(wall_ms * 1000)::bigint us,
      row_number() over (partition by tier, input_length_tercile order by measurement_id) - 1 k, count(*) over (partition by tier, input_length_tercile) n
    from sp where status = 'ok' and isfinite(wall_ms) and wall_ms > 0 and input_length_tercile is not null),
  rf as materialized (select (sum(us) // count(*))::bigint r from smp where tier = 'strong'),
  me as (select tier, input_length_tercile, (sum(us) // count(*))::bigint mean_us, count(*) n from smp group by 1, 2),
  rg(regime, rho, peak, p, q) as (values {_REGIMES}),
  sd(seed) as (values {', '.join(f'({s})' for s in q.SEEDS)}),
  t0 as (select jb.*, tenant_id, regime, seed, rho, peak, p, q, sha256(seed::varchar || '|' || regime || '|' || event_id) h, {_U("'state'", 'seed', 'regime', 'event_id')} u,
      {_U("'gap'", 'seed', 'regime', 'event_id')} g from jb left join tn on tn.session_id is not distinct from jb.session_id, rg, sd),
  t1 as (select *, sum(case when peak is not null and u < p then 1 else 0 end) over w swaps from t0 window w as (partition by regime, seed order by h, event_id rows unbounded preceding)),
  t2 as (select *, coalesce(max(case when peak is not null and u >= p and u < q then swaps end) over (partition by regime, seed order by h, event_id rows unbounded preceding), 0) rs from t1),
  t3 as (select *, (swaps - rs) % 2 = 1 peaking, round(-ln(1 - g) * (select r from rf)::double / case when (swaps - rs) % 2 = 1 then peak else rho end)::bigint gap from t2),
  t4 as (select *, (sum(gap) over (partition by regime, seed order by h, event_id rows unbounded preceding))::bigint arrival_us from t3)"""
_TRACE = f"""{_ARRIVALS},
  t5 as materialized (select t4.*, ma.mean_us light_mean_us, mb.mean_us strong_mean_us, {_OK} accepted,
      floor({_U("'service'", 'seed', 'event_id', "'light'")} * ma.n)::bigint ka, floor({_U("'service'", 'seed', 'event_id', "'strong'")} * mb.n)::bigint kb
    from t4 join me ma on ma.tier = 'light' and ma.input_length_tercile = t4.input_length_tercile join me mb on mb.tier = 'strong' and mb.input_length_tercile = t4.input_length_tercile),
  tr as materialized (select t5.* exclude (ka, kb), a.us light_us, b.us strong_us from t5
    join smp a on a.tier = 'light' and a.input_length_tercile = t5.input_length_tercile and a.k = ka
    join smp b on b.tier = 'strong' and b.input_length_tercile = t5.input_length_tercile and b.k = kb)"""
_STAGES = "case when hard_required then 'strong' when light_label = '0' and accepted then 'light' when light_label = '1' then 'light' else 'light+strong' end"
_REASON = "case when hard_required then 'hard_to_strong' when light_label = '0' and accepted then 'light_allow' when light_label = '1' then 'light_block' when light_label = '2' then 'light_abstain_to_strong' else 'risk_to_strong' end"
_ROUTES = f"""{_TRACE},
  pl as (select *, {_STAGES} stages, {_REASON} reason, case when not hard_required and accepted then 'light' else 'strong' end tier from tr),
  v0 as (select *, case when tier = 'strong' then strong_mean_us else light_mean_us end cost from pl),
  v1 as (select *, (sum(cost) over (partition by regime, seed, tenant_id order by arrival_us, event_id rows unbounded preceding))::bigint c from v0),
  v2 as (select *, c + max(arrival_us - (c - cost)) over (partition by regime, seed, tenant_id order by arrival_us, event_id rows unbounded preceding) vfinish_us from v1),
  rt as (
    select 'all_strong' route, regime, seed, event_id, session_id, tenant_id, hard_required, ground_truth_safety, risk_score, arrival_us, vfinish_us, strong_label as "label", 'strong' stages, 'all_strong' reason, strong_us service_us, strong_mean_us cost_us from v2
    union all select 'cascade', regime, seed, event_id, session_id, tenant_id, hard_required, ground_truth_safety, risk_score, arrival_us, vfinish_us, case when tier = 'strong' then strong_label else light_label end, tier,
      case when tier = 'light' then 'risk_accepted' when hard_required then 'hard_to_strong' else 'risk_to_strong' end, case when tier = 'strong' then strong_us else light_us end, cost from v2
    union all select 'serial', regime, seed, event_id, session_id, tenant_id, hard_required, ground_truth_safety, risk_score, arrival_us, vfinish_us, case when stages = 'light' then light_label else strong_label end, stages, reason,
      case stages when 'light' then light_us when 'strong' then strong_us else light_us + strong_us end, light_mean_us from v2)"""
_FIFO = f"""{_ROUTES},
  f1 as (select *, (sum(service_us) over w)::bigint s from rt window w as (partition by regime, seed, route order by arrival_us, event_id rows unbounded preceding)),
  f2 as (select *, s + max(arrival_us - (s - service_us)) over (partition by regime, seed, route order by arrival_us, event_id rows unbounded preceding) completion_us from f1),
  ff as (select *, completion_us - service_us start_us, completion_us - service_us - arrival_us wait_us from f2)"""


def _replay(*methods: str) -> str:
    """The event loop: each step of the recursion serves one job of every run, after taking out what is too old."""
    names = ", ".join(f"('{m}', '{q.METHODS[m][1]}', '{q.METHODS[m][0]}')" for m in methods)
    old, t, quantum = q.MAX_WAIT_US, q.TENANTS, "quantum"
    risk = "case when risk_score is null or isnan(risk_score) then 1.0 else risk_score end"
    return f"""{_ROUTES},
  ms("method", route, discipline) as (values {names}),
  mj as (select rt.*, "method", discipline from rt join ms using (route)),
  jl as materialized (select regime, seed, "method", discipline, any_value(greatest(1, floor((select r from rf) * {q.QUANTUM}))::bigint) quantum, list({{'k1': case when discipline = 'tenant_vfinish' and not hard_required then 1 else 0 end, 'k2': case when discipline = 'tenant_vfinish' then vfinish_us else 0 end,
      'k3': case when discipline in ('tenant_vfinish', 'risk_priority') then -({risk}) else 0.0 end::double, 'arr': arrival_us, 'id': event_id, 'svc': service_us::bigint, 'ten': tenant_id, 'cost': cost_us}} order by arrival_us, event_id) js from mj group by regime, seed, "method", discipline),
  st as (
    select regime, seed, "method", 0::bigint as clock, 0::bigint as i, js[1:0] as pend, list_transform(range({t}), lambda x: 0::bigint) as owed, 0 as ptr,
      list_transform(js[1:0], lambda x: {{'id': x.id, 'start_us': x.arr, 'completion_us': x.arr, 'wait_us': x.arr, 'timed_out': false}}) as o from jl
    union all
    select regime, seed, "method", c + coalesce(j.svc, 0), i2, list_filter(al, lambda x: x.id <> j.id),
      case when pl is null then owed else list_transform(owed, lambda x, k: x + case when hs[k] is null then 0 when (k - 1 - ptr + {t}) % {t} <= pl.d then pl.r else pl.r - 1 end * {quantum} - case when k - 1 = j.ten then j.cost else 0 end) end,
      case when pl is null then ptr else (j.ten + 1) % {t} end,
      list_transform(ex, lambda x: {{'id': x.id, 'start_us': x.arr + {old}, 'completion_us': x.arr + {old}, 'wait_us': {old}::bigint, 'timed_out': true}})
        || list_transform(case when j is null then al[1:0] else [j] end, lambda x: {{'id': x.id, 'start_us': c, 'completion_us': c + x.svc, 'wait_us': c - x.arr, 'timed_out': false}})
    from (
      select *, case when pl is null then list_sort(al)[1] else list_filter(hs, lambda h: h.ten = pl.t)[1] end j from (
        select *, list_sort(list_transform(list_filter(hs, lambda h: h is not null),
          lambda h: {{'r': greatest(1, (h.cost - owed[h.ten + 1] + {quantum} - 1) // {quantum}), 'd': (h.ten - ptr + {t}) % {t}, 't': h.ten}}))[1] pl from (
          select *, case when discipline = 'drr' then list_transform(range({t}), lambda y: list_sort(list_filter(al, lambda x: x.ten = y))[1]) end hs from (
            select *, list_filter(p, lambda x: c - x.arr >= {old}) ex, list_filter(p, lambda x: c - x.arr < {old}) al from (
              select *, pend || js[i + 1:i2] p from (
                select *, len(list_filter(js, lambda x: x.arr <= c)) i2 from (
                  select st.*, js, discipline, quantum, case when len(pend) = 0 then greatest(clock, js[i + 1].arr) else clock end c from st join jl using (regime, seed, "method") where i < len(js) or len(pend) > 0)))))))),
  oo as (select regime, seed, "method", unnest(o) x from st),
  oc as (select mj.*, x.start_us, x.completion_us, x.wait_us, x.timed_out, x.completion_us - arrival_us latency_us,
      case when x.timed_out or "label" = '2' then 'abstain' when "label" = '0' then 'allow' when "label" = '1' then 'block' end made,
      coalesce(ground_truth_safety = 'benign_expected', false) benign from mj join oo on oo.regime = mj.regime and oo.seed = mj.seed and oo."method" = mj."method" and x.id = event_id)"""


_METRICS = f""",
  pt as (select regime, seed, "method", tenant_id, count(*) n, count(*) filter (not timed_out) n_completed, quantile_cont(latency_us, 0.95) p95 from oc group by all),
  ten as (select r.*, coalesce(n, 0) n, coalesce(n_completed, 0) n_completed, case when n > 0 then n_completed / n else 1.0::double end share, p95
    from (select distinct regime, seed, "method", unnest(range({q.TENANTS}))::int tenant_id from oc) r left join pt using (regime, seed, "method", tenant_id)),
  fa as (select regime, seed, "method", pow(sum(share), 2) / (count(*) * sum(share * share)) jain, max(p95) worst, max(1 - share) deficit from ten group by 1, 2, 3),
  mt as (select regime, seed, "method", count(*) n, count(*) filter (not timed_out) n_completed, max(wait_us) wait_max, coalesce(sum(service_us) filter (not timed_out), 0)::bigint busy,
    greatest(coalesce(max(completion_us) filter (not timed_out), min(arrival_us)) - min(arrival_us), 1) span,
    count(*) filter (not timed_out and contains(stages, 'light')) n_light, count(*) filter (not timed_out and contains(stages, 'strong')) n_strong, count(*) filter (made = 'abstain') n_abstain,
    count(*) filter (benign) n_benign, count(*) filter (benign and made = 'allow') n_pass, count(*) filter (not benign) n_dangerous, count(*) filter (not benign and made = 'allow') n_dangerous_allowed,
    count(*) filter (hard_required and not timed_out and not contains(stages, 'strong')) n_hard_downgrades, 0::bigint n_fail_open, count(*) filter (not hard_required) n_nonhard,
    count(*) filter (not hard_required and made = 'allow') n_na, count(*) filter (not hard_required and not benign and made = 'allow') n_nua, count(*) filter (timed_out) n_starved,
    count(*) filter (not timed_out and reason = 'light_abstain_to_strong') n_abstain_escalations, count(*) filter (not timed_out and "label" = '2' and stages = 'light') n_final_light_abstain,
    count(*) filter (not timed_out and not hard_required and reason = 'light_allow') n_direct_allow,
    quantile_cont(wait_us, 0.5) w50, quantile_cont(wait_us, 0.95) w95, quantile_cont(wait_us, 0.99) w99, quantile_cont(latency_us, 0.5) l50, quantile_cont(latency_us, 0.95) l95, quantile_cont(latency_us, 0.99) l99
    from oc group by 1, 2, 3),
  mm as (select * from mt join fa using (regime, seed, "method"))"""
_BOTTLENECK = f"""bn as (select regime, round(quantile_cont(w95 / greatest(l95, 1), 0.5), 6) median_wait_share from mm where "method" = '{q.BASE}' and regime in {q.STRESSED} group by 1)"""
_GAIN = f"""gn as (select a.regime, a."method", round(quantile_cont(1 - a.l95 / greatest(b.l95, 1), 0.5), 6) median_gain from mm a join mm b on a.regime = b.regime and a.seed = b.seed and b."method" = '{q.BASE}' where a."method" <> '{q.BASE}' group by 1, 2),
  gp as (select *, bool_or(regime in {q.STRESSED} and median_gain >= {q.LEAST_GAIN}) over (partition by "method") passes from gn)"""
_RATE = lambda t: f"{t}.n_pass / greatest({t}.n_benign, 1)"
_ALL = _replay(*q.METHODS)
_SERIAL = _replay(q.BASE, "serial_cascade_fifo")
_BOOT = _replay(q.BASE, q.CANDIDATE)
_CONSTANTS = ", ".join(f"('{r.name}', {s}, {', '.join(f'{a}, {c}' for a, c in mix_constants(f'boot|{r.name}|{s}'))})" for r in REGIMES for s in q.SEEDS)
_STEPS, _LAST = mixed_sql("b", "i")


def _queue(method: str) -> str:
    return f"with recursive {_replay(method)} select regime, seed, event_id, tenant_id, arrival_us, start_us, wait_us, timed_out from oc"


ORACLE = {
    "j_unscored": f"with {_BASE} select event_id, why from sw where why is not null",
    "c_threshold": f"""with {_BASE}, x as (select *, label = '0' allow, label = '0' and coalesce(risk, case when unsafe then 0.0 else 2.0 end) <= (select thr from th) acc from cal)
        select (select case when w is null then 1.0 when w <= 0 then -1.0 else nextafter(w::double, '-infinity'::double) end::double from wo) threshold, count(*) filter (unsafe) n_unsafe, count(*) filter (unsafe and allow) n_unsafe_allow,
        count(*) filter (unsafe and acc) n_false_allow, count(*) filter (not unsafe) n_benign, count(*) filter (not unsafe and allow) n_benign_allow, count(*) filter (not unsafe and acc) n_benign_accepted, 0.02::double epsilon,
        round(1 - pow(0.05, 1.0 / greatest(count(*) filter (unsafe), 1)), 9) bound, (select thr from th) < 0 all_to_strong, round(count(*) filter (not unsafe and acc) / greatest(count(*) filter (not unsafe), 1), 9) benign_rate,
        count(*) filter (unsafe) > 0 and count(*) filter (not unsafe) > 0 and count(*) filter (unsafe and acc) = 0 and 1 - pow(0.05, 1.0 / greatest(count(*) filter (unsafe), 1)) <= 0.02 feasible from x""",
    "g_arrivals": f"with recursive {_ARRIVALS} select regime, seed, event_id, tenant_id, peaking, arrival_us from t4",
    "g_service_draw": f"with recursive {_TRACE} select regime, seed, event_id, light_us, strong_us from tr",
    "g_trace_digest": f"""with recursive {_TRACE}, x as (select *, row_number() over (partition by regime, seed order by arrival_us, event_id) - 1 sequence from tr),
        y as (select regime, seed, ('0x' || substr(sha256(concat_ws('|', sequence, event_id, tenant_id, arrival_us, case when hard_required then '1' else '0' end, input_length_tercile, light_us, strong_us)), 1, 15))::bigint d from x)
        select regime, seed, count(*) n, sum(d::hugeint)::varchar digest from y group by 1, 2""",
    "g_tenant_assignment": f"with recursive {EV}, {_TENANTS} select session_id, n, tenant_id from tn",
    "r_route_cascade": f"with {_BASE} select case when not hard_required and {_OK} then 'light' else 'strong' end tier, hard_required, count(*) n from jb group by 1, 2",
    "r_serial_plan": f"""with {_BASE}, a as (select *, {_OK} accepted from jb), p as (select *, {_STAGES} stages, {_REASON} reason from a)
        select event_id, stages, case when stages = 'light' then light_label else strong_label end as "label", reason from p""",
    "q_fifo_wait": f"with recursive {_FIFO} select regime, seed, route, event_id, arrival_us, start_us, wait_us from ff",
    "q_busy_periods": f"""with recursive {_FIFO}, b as (select *, sum(case when wait_us = 0 then 1 else 0 end) over (partition by regime, seed, route order by arrival_us, event_id rows unbounded preceding) busy_id from ff)
        select regime, seed, route, busy_id::bigint busy_id, count(*) n_jobs, min(arrival_us) from_us, max(completion_us) to_us from b group by 1, 2, 3, 4""",
    "q_virtual_finish": f"with recursive {_ROUTES} select regime, seed, event_id, tenant_id, vfinish_us from v2",
    "q_fifo_timeout": _queue("cascade_fifo"),
    "q_risk_priority": _queue("cascade_risk_priority"),
    "q_tenant_vfinish": _queue("cascade_tenant_vfinish"),
    "q_drr": _queue("cascade_drr"),
    "m_method_metrics": f"""with recursive {_ALL}{_METRICS} select regime, seed, "method", n n_events, n_completed, round(w50 / 1000, 6) wait_p50_ms, round(w95 / 1000, 6) wait_p95_ms, round(w99 / 1000, 6) wait_p99_ms, round(wait_max / 1000, 6) wait_max_ms,
        round(l50 / 1000, 6) latency_p50_ms, round(l95 / 1000, 6) latency_p95_ms, round(l99 / 1000, 6) latency_p99_ms, round(n_completed / greatest(span / 1e6::double, 0.001), 8) throughput, round(busy / span, 8) utilization, round(n_strong / greatest(n, 1), 8) strong_fraction,
        round(n_abstain / greatest(n, 1), 8) abstention_rate, round(n_pass / greatest(n_benign, 1), 8) benign_pass_rate, n_dangerous_allowed, n_dangerous, n_hard_downgrades, n_fail_open,
        round(case when n_na > 0 and n_dangerous > 0 then n_nua / n_na end, 8) accepted_nonhard_risk, round(jain, 8) jain, round(worst / 1000, 6) worst_tenant_p95_ms, round(deficit, 8) most_deficit, n_starved from mm""",
    "m_serial_metrics": f"""with recursive {_SERIAL}{_METRICS} select regime, seed, "method", n n_events, round(w95 / 1000, 6) wait_p95_ms, round(l95 / 1000, 6) latency_p95_ms, round(wait_max / 1000, 6) wait_max_ms, round(n_light / greatest(n, 1), 8) light_stage_fraction,
        round(n_strong / greatest(n, 1), 8) strong_stage_fraction, round((n_light + n_strong) / greatest(n, 1), 8) mean_stages, n_abstain_escalations, n_final_light_abstain, n_direct_allow, round(n_direct_allow / greatest(n_nonhard, 1), 8) direct_allow_rate,
        n_dangerous, n_dangerous_allowed, n_hard_downgrades, round(n_pass / greatest(n_benign, 1), 8) benign_pass_rate, n_starved, round(jain, 8) jain from mm""",
    "m_tenant_fairness": f"""with recursive {_ALL}{_METRICS} select regime, seed, "method", tenant_id, n, n_completed, round(share, 8) share, round(p95 / 1000, 6) latency_p95_ms from ten""",
    "b_session_bootstrap": f"""with recursive {_BOOT},
        k(regime, seed, a0, c0, a1, c1, a2, c2, a3, c3) as (values {_CONSTANTS}),
        dn as (select regime, seed, "method", coalesce(session_id, '') session_id, latency_us from oc),
        ids as (select regime, seed, session_id, row_number() over (partition by regime, seed order by session_id) - 1 i, count(*) over (partition by regime, seed) n from (select distinct regime, seed, session_id from dn)),
        dr as (select k.*, n, b, i from k join (select distinct regime, seed, n from ids) using (regime, seed), lateral (select unnest(range({q.RESAMPLES})) b), lateral (select unnest(range(n)) i)),
        du as (select regime, seed, n, b, {_STEPS} from dr), dw as (select regime, seed, b, floor(({_LAST}) * n)::bigint i from du),
        x as (select dw.regime, dw.seed, b, "method", latency_us from dw join ids using (regime, seed, i) join dn using (regime, seed, session_id)),
        p as (select regime, seed, b, quantile_cont(latency_us, 0.95) filter ("method" = '{q.BASE}') a, quantile_cont(latency_us, 0.95) filter ("method" <> '{q.BASE}') c from x group by 1, 2, 3),
        g as (select regime, seed, (a - c) / greatest(a, 0.001) g from p)
        select regime, seed, count(*) n_resamples, round(quantile_cont(g, 0.025), 6) low, round(quantile_cont(g, 0.5), 6) mid, round(quantile_cont(g, 0.975), 6) high from g group by 1, 2""",
    "t_gate_bottleneck": f"with recursive {_replay(q.BASE)}{_METRICS}, {_BOTTLENECK} select regime, median_wait_share, bool_or(median_wait_share >= {q.LEAST_BOTTLENECK}) over () passes from bn",
    "t_gate_gain": f"with recursive {_ALL}{_METRICS}, {_GAIN} select * from gp",
    "t_gates": f"""with recursive {_ALL}{_METRICS}, {_BOTTLENECK}, {_GAIN},
        x as (select bool_and(a.n_hard_downgrades = 0 and a.n_fail_open = 0) hard, bool_and(a.n_starved = 0 and a.jain >= f.jain - {q.MOST_JAIN_DROP}) fair, bool_and({_RATE('a')} >= {_RATE('b')} - {q.MOST_PASS_DROP}) useful
          from mm a join mm b on b.regime = a.regime and b.seed = a.seed and b."method" = '{q.BASE}' join mm f on f.regime = a.regime and f.seed = a.seed and f."method" = '{q.FAIR}' where a."method" = '{q.CANDIDATE}'),
        y as (select 'F1_bottleneck' gate, bool_or(median_wait_share >= {q.LEAST_BOTTLENECK}) ok from bn union all select 'F2_latency_gain', bool_or(passes) from gp where "method" = '{q.CANDIDATE}'
          union all select 'F3_hard_safety', hard from x union all select 'F4_fairness', fair from x union all select 'F5_matched_danger', null from x union all select 'F6_benign_utility', useful from x)
        select gate, case when ok is null then 'not_evaluable' when ok then 'pass' else 'fail' end status from y""",
    "t_gate_serial": f"""with recursive {_SERIAL}{_METRICS},
        x as (select bool_and(a.n_final_light_abstain = 0) contained, bool_and(a.n_hard_downgrades = 0 and a.n_fail_open = 0 and a.n_dangerous > 0 and a.n_dangerous = b.n_dangerous and a.n_dangerous_allowed = 0 and b.n_dangerous_allowed = 0) safe,
          bool_and({_RATE('a')} >= {_RATE('b')} - {q.MOST_PASS_DROP}) useful, round(quantile_cont(a.n_direct_allow / greatest(a.n_nonhard, 1), 0.5), 8) direct_allow, round(quantile_cont(1 - a.l95 / greatest(b.l95, 1), 0.5), 6) median_gain
          from mm a join mm b on b.regime = a.regime and b.seed = a.seed and b."method" = '{q.BASE}' where a."method" <> '{q.BASE}')
        select contained, safe, useful, direct_allow >= {q.LEAST_DIRECT_ALLOW} covered, direct_allow, median_gain, case when contained and safe and useful and direct_allow >= {q.LEAST_DIRECT_ALLOW} then 'candidate_pass' else 'no_go' end status from x""",
}
