"""Quotas, cut points, joins and positions."""

import random

import pytest
from pyspark.sql import functions as F

from loomgate.operators.keyed import global_position, lookup_join
from loomgate.operators.selection import cut_points, equal_quota, first_by_key, largest_remainder
from loomgate.streaming.windows import windowed_levels


def test_bounded_allocation(spark):
    df = spark.createDataFrame([("a", 80), ("b", 10), ("c", 2)], "k string, n bigint")
    got = {r["k"]: r["quota"] for r in largest_remainder(df, "k", "n", 32, capacity="n").collect()}
    assert sum(got.values()) == 32 and all(got[k] <= n for k, n in (("a", 80), ("b", 10), ("c", 2)))


def test_largest_remainder_sums(spark):
    rng = random.Random(3)
    for total in (7, 100):
        df = spark.createDataFrame([(f"k{i}", rng.randrange(1, 50)) for i in range(9)], "k string, n bigint")
        assert sum(r["quota"] for r in largest_remainder(df, "k", "n", total).collect()) == total
    assert sorted(r["quota"] for r in equal_quota(df, "k", F.col("k"), 20).collect()) == [2] * 7 + [3] * 2


def test_cut_points(spark):
    values = [random.Random(i).randrange(50) for i in range(100)]
    s = sorted(values)
    assert cut_points(spark.createDataFrame([(v,) for v in values] + [(None,)], "v int"), "v") == [s[33], s[66]]


def test_first_by_key_ignores_null_keys(spark):
    df = spark.createDataFrame([("a", 2, "x"), ("a", 1, "y"), (None, 0, "z")], "k string, o int, v string")
    assert [tuple(r) for r in first_by_key(df, "k", "o").collect()] == [("a", 1, "y")]


@pytest.mark.parametrize("how", ["inner", "left"])
def test_lookup_join_with_hot_and_null_keys(spark, how):
    facts = spark.createDataFrame([("h", i) for i in range(500)] + [("c", 1), ("d", 2), (None, 3)], "k string, i int").cache()
    dim = spark.createDataFrame([("h", "H"), ("c", "C")], "k string, v string")
    got = sorted(map(str, lookup_join(facts, dim, "k", how, min_hot=50).collect()))
    assert got == sorted(map(str, facts.join(dim, "k", how).collect()))


def test_global_position(spark):
    rng = random.Random(1)
    df = spark.createDataFrame([(rng.randrange(5), i) for i in range(500)], "a int, i int")
    got = [(r["a"], r["i"]) for r in sorted(global_position(df, [F.col("a"), F.col("i")]).collect(), key=lambda r: r["pos"])]
    assert got == sorted(got) and len(got) == 500
    assert global_position(df.filter("a > 9"), [F.col("a"), F.col("i")]).collect() == []


def test_stream_levels(spark, tmp_path, sf_dir):
    """A stream with re-deliveries ends with the same closed windows as a batch."""
    src = spark.read.parquet(f"{sf_dir}/service_profile.parquet")
    src.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(src.schema).parquet(str(tmp_path / "in"))
    q = windowed_levels(stream).writeStream.format("memory").queryName("levels").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    got = {tuple(r) for r in spark.table("levels").select("window_start", "tier", "runner_id", "n").collect()}
    want = {tuple(r) for r in windowed_levels(src).select("window_start", "tier", "runner_id", "n").collect()}
    assert got and got <= want


def test_fixed_quotas(spark):
    """Exact bins, exact share of the first source, at least the hard minimum, and errors where there are too few."""
    import random

    from loomgate.operators.selection import fixed_quota_sample, share_out

    rng = random.Random(2)
    rows = [(f"e{i:03d}", rng.choice(["long", "short", "short", "medium", None]), rng.random() < 0.3, rng.random() < 0.4) for i in range(200)]
    frame = spark.createDataFrame(rows, "event_id string, bin string, is_first boolean, is_hard boolean")
    quotas = {"long": 8, "medium": 8, "short": 12}
    got = fixed_quota_sample(frame, quotas, 7, 6, F.sha2("event_id", 256)).collect()
    by = {r[0]: r for r in rows}
    assert {b: sum(r["bin"] == b for r in got) for b in quotas} == quotas and len({r["event_id"] for r in got}) == 28
    assert sum(by[r["event_id"]][2] for r in got) == 7 and sum(by[r["event_id"]][3] and not by[r["event_id"]][2] for r in got) >= 6
    for bad in (({"long": 500}, 0, 0), (quotas, 99, 0), (quotas, 0, 99)):
        with pytest.raises(ValueError):
            fixed_quota_sample(frame, bad[0], bad[1], bad[2], F.col("event_id"))
    assert share_out(5, {"a": 10, "b": 10, "c": 1}) == {"a": 2, "b": 3, "c": 0} and share_out(0, {}) == {}


def test_exact_subset(spark):
    import random

    from loomgate.operators.selection import exact_subset

    rng = random.Random(3)
    for _ in range(4):
        sizes = [(f"s{i}", rng.choice([3, 5, 9, 14])) for i in range(12)]
        for target in (0, 1, 8, 31, 50, 1000):
            sums = {0}
            for _, n in sizes:
                sums |= {x + n for x in sums}
            got = exact_subset(spark.createDataFrame(sizes, "session_id string, n bigint"), target, F.col("session_id")).collect()
            assert sum(r["n"] for r in got) == (target if target in sums else 0)
            assert len({r["session_id"] for r in got}) == len(got)


def test_actions_and_archive_rows(spark):
    import hashlib

    from loomgate.operators.selection import archive_matches, pick_action

    kind = "id string, acts array<struct<action_id:string, v:int>>"
    acts = [("a_0", 1), ("b", 2), ("z_0", 3)]
    got = {r["id"]: r["action"]["v"] for r in pick_action(spark.createDataFrame([("b", acts), ("x_2", acts), ("a_0", acts)], kind), "acts", "id").collect()}
    assert got == {"b": 2, "x_2": 3, "a_0": 1}
    for bad in ("none", "x_9"):
        with pytest.raises(Exception, match="no action"):
            pick_action(spark.createDataFrame([(bad, acts)], kind), "acts", "id").collect()
    sha = hashlib.sha256(b"do it now").hexdigest()
    events = spark.createDataFrame([("e1", "f", 0, sha.upper()), ("e2", "f", 1, sha), ("e3", "f", 9, sha), ("e4", None, None, None)], "event_id string, source_file string, source_row_index bigint, instruction_sha256 string")
    rows = spark.createDataFrame([("f", 0, "Do  it\nNOW "), ("f", 1, "other")], "member string, row_index int, instruction string")
    assert {r["event_id"]: r["verified"] for r in archive_matches(events, rows, "instruction").collect()} == {"e1": True, "e2": False, "e3": False, "e4": False}


@pytest.mark.parametrize("direct", [10**6, 5])
def test_cut_points_of_many_values(spark, direct):
    rng = random.Random(9)
    values = [rng.randrange(-50, 400) for _ in range(700)] + [7] * 90
    df = spark.createDataFrame([(v,) for v in values] + [(None,)], "v int")
    values.sort()
    assert cut_points(df, "v", direct=direct) == [values[len(values) // 3], values[2 * len(values) // 3]]
    assert cut_points(df.filter("v > 999"), "v", direct=direct) == [None, None]
