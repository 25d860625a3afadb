"""Joins with hot keys give what plain joins give."""

import random

import pytest

from loomgate.operators import keyed


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


@pytest.fixture
def tables(spark):
    rng = random.Random(3)
    left = spark.createDataFrame([(rng.choice(["hot", "hot", "warm", None, *"abcdef"]), i) for i in range(600)], "k string, i int")
    right = spark.createDataFrame([("hot", 1), ("warm", 2), ("a", 3), (None, 4), ("zzz", 5)], "k string, v int")
    return left, right


@pytest.mark.parametrize("how", ["inner", "left"])
@pytest.mark.parametrize("most", [10_000, 1])
def test_lookup_join_with_hot_keys(monkeypatch, tables, how, most):
    """Through the broadcast of hot rows, and through salting where there are too many hot keys."""
    monkeypatch.setattr(keyed, "MAX_HOT_KEYS", most)
    left, right = tables
    assert rows(keyed.lookup_join(left, right, "k", how, 40)) == rows(left.join(right, "k", how))


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_salted_join(tables, how):
    left, right = tables
    many = right.union(right.filter("k = 'hot'"))
    assert rows(keyed.salted_join(left, many, ["k"], how, 40)) == rows(left.join(many, "k", how))
    assert rows(keyed.salted_join(left.filter("i < 0"), many, ["k"], how, 40)) == []
