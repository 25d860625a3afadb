"""Closed forms against event loops, and the disciplines' properties."""

import random

import pytest

from loomgate.operators.queues import PICKS, DeficitRoundRobin, register_discipline, server_of, simulate, virtual_finish
from loomgate.operators.scans import busy_periods, fifo_times, idle_groups, prefix_scan
from loomgate.operators.workload import REGIMES, Regime, arrivals, assign_tenants, cascade_tier, checked_threshold, draw_services, light_threshold, serial_plan, service_samples, traces

SCHEMA = "regime string, method string, arrival_us bigint, sequence string, event_id string, service_us bigint, tenant_id int, risk_score double, hard_required boolean, cost_us bigint"


def jobs(n, seed, load=0.9):
    rng, t, out = random.Random(seed), 0, []
    for i in range(n):
        t += int(rng.expovariate(load / 100))
        e = f"e{i:04d}"
        out.append((f"r{seed}", "m", t, e, e, rng.randrange(0, 200), rng.randrange(4), round(rng.random(), 2), rng.random() < 0.2, rng.randrange(1, 200)))
    return out


@pytest.fixture(scope="module")
def queue(spark):
    rows = jobs(300, 1) + jobs(200, 2, 1.4)
    df = virtual_finish(spark.createDataFrame(rows, SCHEMA), ["regime"], block_us=800)
    timed = fifo_times(df, ["regime"], block_us=700)
    return rows, idle_groups(busy_periods(timed, ["regime"], block_us=900), ["regime"], block_us=600).cache()


def by_event(done):
    return {(r["regime"], r["event_id"]): (r["start_us"], r["completion_us"], r["wait_us"], r["timed_out"]) for r in done.collect()}


def loop(rows, pick, cap, quantum=None):
    """The plainest event loop: scans all that wait; with a quantum, visits one tenant after another."""
    out = {}
    for regime in {r[0] for r in rows}:
        mine = sorted((r for r in rows if r[0] == regime), key=lambda r: (r[2], r[3]))
        clock, finish, tuples = 0, {}, []
        for r in mine:
            finish[r[6]] = max(finish.get(r[6], 0), r[2]) + r[9]
            tuples.append((r[2], r[3], r[5], r[6], r[7], r[8], finish[r[6]], r[9]))
        waiting, i, at, deficit = [], 0, 0, [0] * 4
        while i < len(tuples) or waiting:
            if not waiting:
                clock = max(clock, tuples[i][0])
            while i < len(tuples) and tuples[i][0] <= clock:
                waiting.append(tuples[i])
                i += 1
            for j in [j for j in waiting if clock - j[0] >= cap]:
                waiting.remove(j)
                out[(regime, j[1])] = (j[0] + cap, j[0] + cap, cap, True)
            if not waiting:
                continue
            j = None if quantum else min(waiting, key=pick)
            while j is None:
                queue = [w for w in waiting if w[3] == at]
                if queue:
                    deficit[at] += quantum
                    first = min(queue, key=lambda w: w[:2])
                    if first[7] <= deficit[at]:
                        deficit[at] -= first[7]
                        j = first
                at = (at + 1) % 4
            waiting.remove(j)
            out[(regime, j[1])] = (clock, clock + j[2], clock - j[0], False)
            clock += j[2]
    return out


def test_fifo_closed_form(queue):
    rows, timed = queue
    want = loop(rows, PICKS["fifo"], 10**12)
    assert {(r["regime"], r["event_id"]): (r["start_us"], r["completion_us"], r["wait_us"], False) for r in timed.collect()} == want


RUN = ["regime", "method"]


@pytest.mark.parametrize("discipline", ["fifo", "risk_priority", "tenant_vfinish"])
@pytest.mark.parametrize("cap", [150, 1000])
def test_disciplines_by_group(queue, discipline, cap):
    """Groups of busy periods, served apart, give what one loop over the trace gives."""
    rows, timed = queue
    assert timed.select("regime", "group_id").distinct().count() > 4
    assert by_event(simulate(timed, RUN, {"m": discipline}, cap, 4)) == loop(rows, PICKS[discipline], cap)


@pytest.mark.parametrize("quantum", [20, 150, 1000])
@pytest.mark.parametrize("cap", [300, 10**12])
def test_deficit_round_robin(queue, cap, quantum):
    rows, timed = queue
    assert by_event(simulate(timed, RUN, {"m": "drr"}, cap, 4, quantum)) == loop(rows, None, cap, quantum)


def test_several_methods_and_a_registered_one(queue):
    from pyspark.sql import functions as F

    rows, timed = queue
    register_discipline("shortest", lambda j: (j[2], j[0], j[1]))
    both = timed.withColumn("method", F.explode(F.array(F.lit("a"), F.lit("b"), F.lit("c"))))
    done = simulate(both, RUN, {"a": "shortest", "b": "drr", "c": "fifo"}, 500, 4, 100)
    for m, want in (("a", loop(rows, PICKS["shortest"], 500)), ("b", loop(rows, None, 500, 100)), ("c", loop(rows, PICKS["fifo"], 500))):
        assert by_event(done.filter(F.col("method") == m)) == want


def test_deficit_round_robin_needs_a_quantum():
    with pytest.raises(ValueError):
        DeficitRoundRobin(10, 2, 0)
    server = DeficitRoundRobin(10, 2, 1)
    server.feed((0, "a", 1, 0, 0.0, False, 0, 10**9))
    with pytest.raises(RuntimeError):
        server.advance()


def test_hard_job_and_timeout():
    """Two jobs at once, 20 ms of service, an age limit of 5 ms: the second is abstained from."""
    server, a, b = server_of("fifo", 5, 2, 1), (0, "a", 20, 0, 0.0, True, 0, 1), (0, "b", 20, 0, 0.0, False, 0, 1)
    assert server.feed(a) + server.feed(b) + server.advance() == [(a, 0, 20, 0, False), (b, 5, 5, 5, True)]


def test_unknown_discipline(queue):
    with pytest.raises(ValueError):
        simulate(queue[1], RUN, {"m": "nonsense"}, 10)


def test_prefix_scan_with_nulls_and_ties(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([("k", i, i % 3 if i % 4 else None) for i in range(40)], "k string, i int, v int")
    got = {r["i"]: r["s"] for r in prefix_scan(df, ["k"], F.floor(F.col("i") / 7), ["i"], F.col("v"), "s").collect()}
    run = 0
    for i in range(40):
        run += (i % 3) if i % 4 else 0
        assert got[i] == run


@pytest.mark.parametrize("duty", [0.2, 0.5, 0.8])
@pytest.mark.parametrize("n_jobs", [400, 10**8])
def test_modulated_arrivals(spark, duty, n_jobs):
    """The form in blocks, of which n_jobs sets the number, is the step-by-step process; also where peaks are the rule."""
    from loomgate.functions.hashing import stable_key, uniform
    from pyspark.sql import functions as F

    r = Regime("burst", 0.4, peak=1.2, duty=duty)
    df = spark.createDataFrame([(f"e{i}",) for i in range(400)], "event_id string")
    t = traces(df, (r,), (1,))
    got = {x["event_id"]: (x["peaking"], x["arrival_us"]) for x in arrivals(t, 100_000, n_jobs).collect()}
    keys = [F.col("seed"), F.col("regime"), F.col("event_id")]
    steps = t.select("event_id", stable_key(*keys).alias("h"), uniform("state", *keys).alias("u"), (-F.log(1 - uniform("gap", *keys)) * 100_000.0).alias("g")).orderBy("h", "event_id").collect()
    peak, clock = False, 0
    for s in steps:
        if s["u"] < (r.to_background if peak else r.to_peak):
            peak = not peak
        clock += int(s["g"] / (1.2 if peak else 0.4) + 0.5)
        assert got[s["event_id"]] == (peak, clock)
    assert len(REGIMES) == 3


def test_regimes_and_samples_are_checked(spark):
    for bad in ({"rho": 0}, {"rho": 0.4, "peak": 1.2, "duty": 1.0}, {"rho": 0.4, "peak": 1.2, "duty": 0.01}, {"rho": 0.4, "peak": -1.0}):
        with pytest.raises(ValueError):
            Regime("x", **bad)
    schema = "measurement_id bigint, tier string, status string, input_length_tercile string, wall_ms double"
    good = [(1, "light", "ok", "short", 5.0), (2, "strong", "ok", "short", 7.0), (3, "strong", "oom", "short", 0.0), (4, "light", "ok", None, 3.0)]
    pool = service_samples(spark.createDataFrame(good, schema), strict=True)
    assert {r["measurement_id"]: r["us"] for r in pool.collect()} == {1: 5000, 2: 7000}
    for bad in ((5, "light", "ok", "short", 0.0), (5, "light", "ok", "short", float("nan")), (5, "light", "ok", "short", None), (5, "light", "ok", "long", 5.0)):
        with pytest.raises(ValueError):
            service_samples(spark.createDataFrame([*good, bad], schema), strict=True)
    jobs = spark.createDataFrame([("e1", 1, "short")], "event_id string, seed int, input_length_tercile string")
    assert [(r["light_us"], r["strong_us"]) for r in draw_services(jobs, pool).collect()] == [(5000, 7000)]
    for tercile in ("long", None):
        with pytest.raises(Exception, match="no light service sample"):
            draw_services(spark.createDataFrame([("e1", 1, tercile)], jobs.schema), pool).collect()


def test_threshold_and_plan(spark):
    import math

    schema = "unsafe boolean, label string, risk_score double"
    rows = [(False, "0", 0.1), (False, "0", 0.2), (False, "0", None), (True, "0", 0.2), (True, "1", 0.05)]
    got = light_threshold(spark.createDataFrame(rows, schema), 0.99)
    r = got.first()
    assert (r["n_unsafe_allow"], r["n_benign_allow"], r["n_benign_accepted"], r["n_false_allow"], r["feasible"]) == (1, 3, 1, 0, True)
    assert r["threshold"] == math.nextafter(0.2, -math.inf) == checked_threshold(got)
    assert light_threshold(spark.createDataFrame([(True, "1", 0.3), (False, "0", 0.9)], schema)).first()["threshold"] == 1.0
    for risk in (0.0, None, float("nan")):
        assert light_threshold(spark.createDataFrame([(True, "0", risk), (False, "0", 0.9)], schema)).first()["threshold"] == -1.0
    for bad, why in (([], "side"), ([(True, "1", 0.3)], "side"), ([(True, "1", 0.3), (False, "0", 0.1)], "small")):
        with pytest.raises(ValueError, match=why):
            checked_threshold(light_threshold(spark.createDataFrame(bad, schema)))
    assert checked_threshold(light_threshold(spark.createDataFrame([], schema)), strict=False) == -1.0
    jobs = [(1, False, "2", "0", 0.0), (2, False, "0", "1", 0.9), (3, False, "0", "1", 0.1), (4, True, "0", "1", 0.0), (5, False, "1", "0", 0.0), (6, False, "0", "1", None), (7, False, "0", "1", float("nan")), (8, None, "0", "1", 0.1)]
    df = spark.createDataFrame(jobs, "k int, hard_required boolean, light_label string, strong_label string, risk_score double")
    got = {r["k"]: (r["p"]["stages"], r["p"]["label"]) for r in df.select("k", serial_plan(0.5).alias("p")).collect()}
    both, light = ["light", "strong"], ["light"]
    assert got == {1: (both, "0"), 2: (both, "1"), 3: (light, "0"), 4: (["strong"], "1"), 5: (light, "1"), 6: (both, "1"), 7: (both, "1"), 8: (light, "0")}
    tiers = {r["k"]: r["t"] for r in df.select("k", cascade_tier(0.5).alias("t")).collect()}
    assert {k for k, t in tiers.items() if t == "light"} == {1, 3, 5, 8}  # a risk that is no number goes to the strong tier


def greedy(sizes, tenants, share):
    target, heavy, taken, loads, out = round(sum(sizes) * share), 0, set(), [0] * tenants, []
    for i, n in enumerate(sizes):
        if heavy < target and abs(heavy + n - target) <= abs(heavy - target):
            taken.add(i)
            heavy += n
    for i, n in enumerate(sizes):
        t = 0 if i in (taken or {0}) else min(range(1, tenants), key=lambda k: (loads[k], k))
        loads[t] += n if t else 0
        out.append(t)
    return out


@pytest.mark.parametrize("share", [0.05, 0.2, 0.5])
def test_tenants_are_the_greedy_ones(spark, share):
    """Sessions of equal size are placed together, as one by one."""
    import hashlib

    rng = random.Random(4)
    rows = [(f"s{i}", rng.choice([1, 1, 1, 2, 3, 9, rng.randrange(1, 40)])) for i in range(150)] + [(None, 4)]
    got = {r["session_id"]: r["tenant_id"] for r in assign_tenants(spark.createDataFrame(rows, "session_id string, n bigint"), 5, share).collect()}
    order = sorted(rows, key=lambda r: (-r[1], hashlib.sha256((r[0] or "").encode()).hexdigest()[:16]))
    assert [got[r[0]] for r in order] == greedy([r[1] for r in order], 5, share)
    assert assign_tenants(spark.createDataFrame([], "session_id string, n bigint"), 5, share).collect() == []
