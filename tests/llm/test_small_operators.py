"""Stable samples, quotas, percentiles, groups and packing on small fixtures."""

import math
import random

import pytest
from pyspark.sql import functions as F

from loomgate.llm.groups import action_groups, connected_components, group_splits, torn_groups
from loomgate.llm.packing import container_cost, pack, pack_histogram, packing_check, size_report, token_counts
from loomgate.llm.percentiles import digest, merge, quantiles, rank_check, running_quantiles
from loomgate.llm.quotas import cell_report, profiled_cells, quota_sample, sample_report
from loomgate.llm.stable_sample import MASK, permute, stable_sample


def ids(df):
    return {r[0] for r in df.collect()}


def test_sample_is_stable_under_growth_and_partitioning(spark):
    old = spark.createDataFrame([(f"e{i}", "x") for i in range(3000)] + [(None, "x")], "event_id string, _n string")
    new = spark.createDataFrame([(f"n{i}", "x") for i in range(2000)], "event_id string, _n string")
    a = ids(stable_sample(old, "event_id", 0.1))
    b = ids(stable_sample(old.union(old).union(new).repartition(7), "event_id", 0.1))
    assert a == {x for x in b if x.startswith("e")} and 220 < len(a) < 380
    assert a <= ids(stable_sample(old, "event_id", 0.3))
    assert len(ids(stable_sample(old, "event_id", 1.0))) == 3000 and not ids(stable_sample(old, "event_id", 0.0))
    assert not ids(stable_sample(old.filter("event_id = 'none'"), "event_id", 0.5))
    with pytest.raises(ValueError):
        stable_sample(old, "event_id", 1.5)


def test_permutation_has_no_collisions(spark):
    df = spark.range(20000).select(permute(F.col("id"), "s").alias("p"))
    got = [r[0] for r in df.collect()]
    assert len(set(got)) == 20000 and all(0 <= p <= (MASK << 30 | MASK) for p in got)


def test_quota_sample(spark):
    rng = random.Random(2)
    sel = [(f"e{i}", rng.choice(["short", "short", "long", None]), "x") for i in range(900)]
    rec = [(f"e{i}", rng.choice([" TAU", "tau", "dojo"]) if i else "rare", i % 2 == 0) for i in range(900)]
    targets = [(1, "tau", True, "short", 0.5, 1, 200), (2, "dojo", False, "long", 0.1, 30, 200), (3, "rare", True, "short", 0.0, 5, 200), (4, "none", True, "long", 0.2, 1, 200), (5, "tau", False, "long", 0.003, 1, 200)]
    frame = profiled_cells(spark.createDataFrame(sel + sel[:50], "event_id string, input_length_tercile string, source string"), spark.createDataFrame(rec + rec[:50], "event_id string, source string, hard_required boolean"))
    report = cell_report(frame, spark.createDataFrame(targets, "target_id int, source string, hard_required boolean, input_length_tercile string, target_share double, min_rows bigint, sample_size bigint"))
    cells = {r["target_id"]: r for r in report.collect()}
    n = lambda s, h, t: sum(1 for a, b in zip(sel, rec) if b[1].strip().lower() == s and b[2] == h and a[1] == t)
    assert [cells[k]["available"] for k in (1, 2, 4)] == [n("tau", True, "short"), n("dojo", False, "long"), 0]
    assert not cells[4]["met"] and not cells[3]["met"] and cells[1]["met"]
    got = quota_sample(frame, report).collect()
    again = {tuple(r) for r in quota_sample(frame.repartition(9), report).collect()}
    assert {tuple(r) for r in got} == again and len({r["event_id"] for r in got}) == len(got)
    count = lambda k: sum(r["target_id"] == k for r in got)
    assert abs(count(1) - min(100, cells[1]["available"])) <= 1 and count(4) == 0 and count(5) >= 1
    assert abs(count(2) - min(30, cells[2]["available"])) <= 1 and count(2) >= min(30, cells[2]["available"]) and count(3) == min(5, cells[3]["available"])
    reached = {r["target_id"]: r for r in sample_report(quota_sample(frame, report), report).collect()}
    assert all(reached[k]["drawn"] == count(k) and reached[k]["met"] == cells[k]["met"] for k in reached) and len(reached) == 5
    assert abs(sum(r["drawn_share"] for r in reached.values()) - 1) < 1e-9 and reached[1]["wished_share"] == 0.5
    assert quota_sample(frame.filter("event_id = 'none'"), cell_report(frame.filter("event_id = 'none'"), spark.createDataFrame(targets, "target_id int, source string, hard_required boolean, input_length_tercile string, target_share double, min_rows bigint, sample_size bigint"))).collect() == []


@pytest.mark.parametrize("k", [40, 1600])
def test_percentiles_within_the_stated_error(spark, k):
    rng = random.Random(4)
    rows = [(rng.choice(["a", "a", None]), i % 5, rng.choice([rng.lognormvariate(3, 1), -rng.random(), 0.0, 7.0])) for i in range(6000)]
    rows += [("a", 0, v) for v in (None, float("nan"), float("inf"), float("-inf"))]
    df = spark.createDataFrame(rows, "g string, day int, v double")
    merged = quantiles(merge(digest(df, ["g", "day"], "v", k), ["g"], k), ["g"], [0.0, 0.1, 0.5, 0.9, 1.0], k).collect()
    assert len(merged) == 10
    for r in merged:
        values = sorted(v for g, _, v in rows if g == r["g"] and v is not None and math.isfinite(v))
        assert r["n"] == len(values)
        slack = abs(r["value"]) * 0.004 + 1e-9
        low, high = sum(v < r["value"] - slack for v in values), sum(v <= r["value"] + slack for v in values)
        assert low - r["max_rank_error"] <= max(1, math.ceil(r["q"] * r["n"])) <= high + r["max_rank_error"]
    assert quantiles(digest(df.filter("day > 9"), ["g"], "v", k), ["g"], [0.5], k).collect() == []


@pytest.mark.parametrize("k", [40, 1600])
def test_running_percentiles_and_their_check(spark, k):
    """Each day's result is that of all rows up to it; nulls in keys, days and values; ties."""
    rng = random.Random(11)
    rows = [(rng.choice(["a", "b", None]), rng.choice([None, 1, 2, 5]), rng.choice([rng.lognormvariate(2, 1), 3.0, None])) for _ in range(3000)]
    df = spark.createDataFrame(rows, "g string, day int, v double")
    got = running_quantiles(digest(df, ["g", "day"], "v", k), ["g"], "day", [0.1, 0.5, 0.99], k).collect()
    assert len(got) == 3 * 4 * 3
    for r in got:
        values = sorted(v for g, d, v in rows if g == r["g"] and v is not None and (d is None or (r["day"] is not None and d <= r["day"])))
        assert r["n"] == len(values)
        slack = abs(r["value"]) * 0.004
        low, high = sum(v < r["value"] - slack for v in values), sum(v <= r["value"] + slack for v in values)
        assert low - r["max_rank_error"] <= math.ceil(r["q"] * r["n"]) <= high + r["max_rank_error"]
    merged = quantiles(merge(digest(df, ["g", "day"], "v", k), ["g"], k), ["g"], [0.1, 0.5, 0.99], k)
    checked = rank_check(df, merged, ["g"], "v").collect()
    assert len(checked) == 9 and all(r["kept"] for r in checked)
    wrong = rank_check(df, merged.withColumn("value", F.col("value") * 9), ["g"], "v").collect()
    assert not any(r["kept"] for r in wrong if r["q"] == 0.1)  # a loose digest may keep the others
    assert running_quantiles(digest(df.filter("day > 9"), ["g", "day"], "v", k), ["g"], "day", [0.5], k).collect() == []


def find(edges):
    up = {}

    def root(x):
        up.setdefault(x, x)
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        if a is not None and b is not None:
            x, y = root(a), root(b)
            up[max(x, y)] = min(x, y)
    return {x: root(x) for x in list(up)}


@pytest.mark.parametrize("shape", ["random", "chain", "star", "loops"])
def test_components(spark, shape):
    rng = random.Random(6)
    edges = {
        "random": [(f"n{rng.randrange(300)}", f"n{rng.randrange(300)}") for _ in range(220)],
        "chain": [(f"n{i:03d}", f"n{i + 1:03d}") for i in range(60)],
        "star": [("hub", f"n{i}") for i in range(150)] + [("hub", "n1"), ("n1", "hub")],
        "loops": [("a", "a"), ("b", None), (None, "c"), ("d", "e")],
    }[shape]
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "a string, b string"), min_hot=40).collect()}
    assert got == find(edges)


def test_groups_stay_together(spark):
    rows = [("e1", "evaluation", "S/1 ", "AB"), ("e2", "calibration", "s:1", None), ("e3", None, "s:2", "ab"), ("e4", "evaluation", "s:3", "cd"), ("e5", "evaluation", None, "CD"), ("e6", "evaluation", None, None), ("e6", "evaluation", None, None)]
    groups = action_groups(spark.createDataFrame(rows, "event_id string, split string, session_id string, instruction_sha256 string"))
    assert {tuple(r) for r in torn_groups(groups).collect()} == {("e1", "e1"), ("e1", "e2"), ("e1", "e3")}
    parts = {r["event_id"]: r["assigned_split"] for r in group_splits(groups).collect()}
    assert len(parts) == 6 and parts["e1"] == parts["e2"] == parts["e3"] and parts["e4"] == parts["e5"]
    none = action_groups(spark.createDataFrame([], "event_id string, split string, session_id string, instruction_sha256 string"))
    assert torn_groups(none).collect() == [] and group_splits(none).collect() == []


def best_fit(counts, sizes):
    """Capacity that plain best-fit decreasing takes, its bins shrunk to a permitted size."""
    from bisect import bisect_left, insort

    room = []
    for n in sorted((n for n, c in counts.items() for _ in range(c)), reverse=True):
        i = bisect_left(room, n)
        insort(room, (room.pop(i) if i < len(room) else max(sizes)) - n)
    return sum(min(s for s in sizes if s >= max(sizes) - r) for r in room)


def test_packing_histogram():
    rng = random.Random(8)
    counts = {n: rng.randrange(0, 30) for n in range(1, 101)}
    patterns = pack_histogram(counts, (25, 50, 100))
    used = {}
    for size, times, uses in patterns:
        assert sum(n * k for n, k in uses.items()) <= size and times > 0
        for n, k in uses.items():
            used[n] = used.get(n, 0) + k * times
    assert used == {n: c for n, c in counts.items() if c}
    assert sum(s * t for s, t, _ in patterns) <= best_fit(counts, (25, 50, 100)) * 1.002
    assert pack_histogram({}, (4,)) == []
    with pytest.raises(ValueError):
        pack_histogram({5: 1}, (4,))


def test_sizes_are_chosen_by_cost():
    """Long containers that cost more than their length are opened only for long items; without that cost they are best."""
    rng = random.Random(10)
    counts = {n: rng.randrange(1, 60) for n in range(1, 700)} | {1500: 40}
    sizes = (256, 512, 1024, 2048)
    plain = pack_histogram(counts, sizes)
    dear = pack_histogram(counts, sizes, attention=16_384.0)
    cost = lambda patterns: sum(container_cost(s, attention=16_384.0) * t for s, t, _ in patterns)
    number = lambda patterns, size: sum(t for s, t, _ in patterns if s == size)
    assert number(plain, 2048) > 100 and number(plain, 1024) < 5
    assert number(dear, 1024) > 100 and number(dear, 2048) <= 45 and cost(dear) < cost(plain)
    for patterns in (plain, dear):
        total = sum(n * c for n, c in counts.items())
        assert sum(s * t for s, t, _ in patterns) <= total * 1.01


def test_packing_check(spark):
    tokens = spark.createDataFrame([(i, i * 7 % 150) for i in range(300)], "doc_id bigint, n_tokens bigint")
    packed = pack(tokens, sizes=(50, 100))
    good = packing_check(packed, tokens, cap=100).first()
    assert good["n_documents"] == 300 and not any(good[c] for c in ("n_lost", "n_doubled", "n_split", "n_over")) and good["well_filled"]
    bad = packing_check(packed.filter("doc_id <> 5").union(packed.filter("doc_id = 6")), tokens, cap=100).first()
    assert bad["n_lost"] == 1 and bad["n_doubled"] == 1 and bad["n_split"] == 1
    assert sum(r["n_tokens"] for r in size_report(packed).collect()) == sum(i * 7 % 150 for i in range(300))
    assert packing_check(pack(tokens.filter("doc_id < 0")), tokens.filter("doc_id < 0")).first()["n_documents"] == 0


def test_pack_documents(spark):
    rng = random.Random(9)
    tokens = spark.createDataFrame([(i, rng.choice([0, 1, 40, 40, rng.randrange(1, 300)])) for i in range(500)], "doc_id bigint, n_tokens bigint")
    got = pack(tokens, sizes=(50, 100)).collect()
    want = {r["doc_id"]: r["n_tokens"] for r in tokens.collect()}
    for doc, n in want.items():
        pieces = sorted((r["start_token"], r["n_tokens"]) for r in got if r["doc_id"] == doc)
        assert sum(p[1] for p in pieces) == n and len(pieces) == max(1, -(-n // 100))
        assert all(a[0] + a[1] == b[0] for a, b in zip(pieces, pieces[1:]))
    load, size = {}, {}
    for r in got:
        if r["container_id"] is None:
            assert r["n_tokens"] == 0
        else:
            load[r["container_id"]] = load.get(r["container_id"], 0) + r["n_tokens"]
            size[r["container_id"]] = r["container_size"]
    counts = {}
    for r in got:
        if r["n_tokens"]:
            counts[r["n_tokens"]] = counts.get(r["n_tokens"], 0) + 1
    assert all(load[c] <= size[c] for c in load) and sum(size.values()) <= best_fit(counts, (50, 100)) * 1.002
    assert pack(tokens.filter("doc_id < 0")).collect() == []


def test_token_counts(spark):
    df = spark.createDataFrame([(1, "Hello world"), (2, ""), (3, None), (4, "<|endoftext|> " * 50)], "doc_id bigint, text string")
    got = {r["doc_id"]: r["n_tokens"] for r in token_counts(df).collect()}
    assert got[1] == 2 and got[2] == got[3] == 0 and got[4] > 100
