"""Faulty readings against brute force, and the defined results of odd inputs."""

import math
import random
import statistics
from datetime import datetime, timedelta

import pytest

from loomgate.operators.anomalies import flag_readings, hour_fences

SCHEMA = "measurement_id bigint, tier string, runner_id string, status string, wall_ms double, cuda_ms double, measured_at timestamp_ntz, reasons string"


def brute(rows):
    once = {}
    for r in rows:
        if r[3] is not None and r[3].strip().lower() == "ok" and r[0] is not None:
            once.setdefault(r[0], r)
    out = set()
    for src in {(r[1], r[2]) for r in once.values()}:
        mine = sorted((r for r in once.values() if (r[1], r[2]) == src), key=lambda r: (r[6] is not None, r[6] or datetime(1, 1, 1), r[0]))
        for c in (4, 5):
            finite = [r[c] for r in mine if r[c] is not None and math.isfinite(r[c])]
            med = statistics.median(finite) if finite else None
            seq = [r for r in mine if r[c] is not None and r[6] is not None]
            i = 0
            while i < len(seq):
                j = i
                while j + 1 < len(seq) and seq[j + 1][c] == seq[i][c]:
                    j += 1
                if j - i + 1 >= 8:
                    out |= {r[0] for r in seq[i : j + 1]}
                i = j + 1
            for r in mine:
                v = r[c]
                if v is not None and (not math.isfinite(v) or v <= 0 or v > 4 * med or v < med / 4):
                    out.add(r[0])
        for r in mine:
            if r[4] is not None and r[5] is not None and math.isfinite(r[4]) and math.isfinite(r[5]) and r[5] > r[4] * 1.05:
                out.add(r[0])
    return out


def sudden(rows):
    """More than fourfold off the reading before, within an hour, and farther from the median than that."""
    once = {}
    for r in rows:
        if r[3] is not None and r[3].strip().lower() == "ok" and r[6] is not None:
            once.setdefault(r[0], r)
    out = set()
    for src in {(r[1], r[2]) for r in once.values()}:
        mine = sorted((r for r in once.values() if (r[1], r[2]) == src), key=lambda r: (r[6], r[0]))
        for c in (4, 5):
            seq = [r for r in mine if r[c] is not None]
            finite = [r[c] for r in seq if math.isfinite(r[c])]
            med = statistics.median(finite) if finite else 1.0
            for p, r in zip(seq, seq[1:]):
                if all(math.isfinite(x[c]) and x[c] > 0 for x in (p, r)) and r[6] - p[6] <= timedelta(hours=1):
                    if max(r[c] / p[c], p[c] / r[c]) > 4 and abs(math.log(r[c] / med)) > abs(math.log(p[c] / med)):
                        out.add(r[0])
    return out


def test_redelivered_with_another_time_counts_once(spark):
    """The earliest row of a key counts, wherever its copies lie."""
    start = datetime(2026, 1, 1)
    rows = [(i, "a", "b", "ok", 10.0 + i / 100, 9.0, start + timedelta(minutes=i), None) for i in range(50)]
    rows += [(7, "a", "b", "ok", 500.0, 9.0, start + timedelta(hours=5), None)]
    assert not [r for r in flag_readings(spark.createDataFrame(rows, SCHEMA)).collect() if "level" in r["reasons"]]


@pytest.fixture(scope="module")
def rows():
    rng, start, out = random.Random(7), datetime(2026, 1, 1), []
    for i in range(1500):
        runner = "gpu-0" if rng.random() < 0.5 else f"gpu-{rng.randrange(4)}"
        wall = rng.lognormvariate(3, 0.2)
        cuda = wall * 0.97
        if rng.random() < 0.03:
            wall = rng.choice([float("nan"), float("inf"), 0.0, -1.0, wall * 9, wall / 9, None])
        if rng.random() < 0.02:
            cuda = None
        at = start + timedelta(minutes=i if i % 5 else i - 1)
        if 400 <= i < 700 and runner == "gpu-0":
            wall, cuda = 25.0, 24.0
        out.append((i, "light", runner, rng.choice(["ok", " OK", "ok", "oom"]), wall, cuda, at, "clash"))
    out += [r for r in out[:200]]
    out += [(5000, None, "gpu-9", "ok", 3.0, 2.0, None, None), (5001, "light", None, None, 3.0, 2.0, start, None)]
    return out


@pytest.mark.parametrize("chunk_rows", [20, 200_000])
def test_same_as_brute_force(spark, rows, chunk_rows):
    """Also with runs of equal readings over many chunks."""
    flagged = flag_readings(spark.createDataFrame(rows, SCHEMA), chunk_rows=chunk_rows).collect()
    assert {r[0] for r in flagged if set(r[1]) - {"fence", "sudden"}} == brute(rows)
    assert {r[0] for r in flagged if "sudden" in r[1]} == sudden(rows)
    assert all("fence" in r[1] for r in flagged if "level" in r[1])


def test_median_is_exact_after_many_splits(spark, rows):
    from loomgate.operators.anomalies import exact_medians, level_sketch, prepare_readings

    df = spark.createDataFrame(rows, SCHEMA)
    p = prepare_readings(df, "measurement_id", ["tier", "runner_id"], "measured_at", ["wall_ms", "cuda_ms"])
    a, b = (sorted(map(tuple, exact_medians(p, level_sketch(p, 2), 2, limit=n).collect()), key=str) for n in (1, 100_000))
    assert a == b


def test_empty_table(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert flag_readings(df).collect() == []
    assert hour_fences(df).collect() == []


def test_all_null_values(spark):
    df = spark.createDataFrame([(1, "a", "b", "ok", None, None, None, None)], SCHEMA)
    assert flag_readings(df).collect() == []


def test_fences_hold_the_middle(spark, rows):
    for r in hour_fences(spark.createDataFrame(rows, SCHEMA)).collect():
        assert r["low"] <= r["q1"] <= r["q3"] <= r["high"]
