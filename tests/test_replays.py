"""Replays with the heavy tenant and the age limit, and exact percentiles."""

import random

import pytest
from pyspark.sql import functions as F

from loomgate.functions.stats import exact_percentiles
from loomgate.plans import queueing


def test_replays_see_the_heavy_tenant(spark, sf_dir):
    """Whole sessions, and tenant 0 has the share of jobs that its sessions have."""
    want = {r["session_id"]: r["tenant_id"] for r in queueing.tenants(spark, sf_dir).collect()}
    jobs = {r["event_id"]: r["session_id"] for r in queueing.jobs(spark, sf_dir).collect()}
    done = queueing.q_drr(spark, sf_dir).filter("regime = 'low' and seed = 1").collect()
    assert {r["event_id"]: r["tenant_id"] for r in done} == {e: want[jobs[e]] for e in (r["event_id"] for r in done)}
    assert len(done) == len(jobs)
    share = sum(r["tenant_id"] == 0 for r in done) / len(done)
    assert 0.4 < share < 0.6


def test_jobs_are_not_lost_silently(spark, sf_dir):
    lost = queueing.j_unscored(spark, sf_dir).count()
    assert lost and queueing.jobs(spark, sf_dir).count() + lost == queueing._scored(spark, sf_dir).count()
    with pytest.raises(ValueError, match="replayed"):
        queueing.jobs(spark, sf_dir, strict=True)


def test_flagship_has_the_age_limit(spark):
    import __spark_entry__ as entry

    rows = entry.entry(spark).collect()
    assert {r["method"] for r in rows} == set(queueing.METHODS)
    assert max(r["wait_max_ms"] for r in rows) <= queueing.MAX_WAIT_US / 1000


@pytest.mark.parametrize("direct", [1, 30, 10**6])
def test_percentiles_by_splitting_are_exact(spark, direct):
    """Groups with ties, one value, nulls, zeros and negative values, also where no task may hold more than one value."""
    rng = random.Random(3)
    rows = [(rng.choice(["a", "a", "b", None]), rng.choice([0.0, 5.0, -3.0, rng.random(), rng.lognormvariate(3, 2), None])) for _ in range(900)] + [("one", 7.0), ("none", None)]
    df = spark.createDataFrame(rows, "g string, v double")
    qs = {"p0": 0.0, "p50": 0.5, "p95": 0.95, "p100": 1.0}
    want = {r["g"]: r for r in df.filter("v is not null").groupBy("g").agg(F.count("v").alias("n"), *[F.percentile("v", q).alias(k) for k, q in qs.items()]).collect()}
    got = {r["g"]: r for r in exact_percentiles(df, ["g"], "v", qs, direct=direct).collect()}
    assert got.keys() == want.keys() == {"a", "b", None, "one"}
    assert all(got[g]["n"] == want[g]["n"] and all(abs(got[g][k] - want[g][k]) < 1e-9 for k in qs) for g in want)


def test_bootstrap_is_brute_force(spark):
    """Resamples with their rows written out, sessions of unequal size, one of them without a pair."""
    import random

    import numpy as np

    from loomgate.operators.bootstrap import session_bootstrap, session_draws

    rng = random.Random(5)
    rows = [(f"r{k}", 1, f"s{rng.randrange(12):02d}", base, rng.randrange(50)) for k in range(2) for base in (True, False) for _ in range(150)]
    rows += [("r0", 1, "lonely", True, 10**6)]
    df = spark.createDataFrame(rows, "regime string, seed int, session_id string, base boolean, latency bigint")
    got = {(r["regime"], r["b"]): r["gain"] for r in session_bootstrap(df, ["regime", "seed"], 90).collect()}
    assert len(got) == 180
    for (regime, b), gain in got.items():
        names = sorted({r[2] for r in rows if r[0] == regime} - {"lonely"})
        drawn = [names[i] for i in session_draws((regime, 1), b, len(names))]
        a, c = (np.percentile([r[4] for s in drawn for r in rows if r[0] == regime and r[2] == s and r[3] == base], 95) for base in (True, False))
        assert abs(gain - (a - c) / max(a, 0.001)) < 1e-9
