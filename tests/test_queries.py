"""Every core query against its SQL, and the driver's contract."""

import importlib

import pytest

import __spark_entry__ as entry

QUERIES, ORACLE = {}, {}
for _m in entry._MODULES:
    _mod = importlib.import_module(_m)
    QUERIES.update(getattr(_mod, "QUERIES", {}))
    ORACLE.update(getattr(_mod, "ORACLE", {}))


@pytest.fixture(scope="module", autouse=True)
def one_replay():
    """All queries of this module read one replay of all methods; test_replays.py runs replays of their own."""
    from pyspark.sql import functions as F

    from loomgate.plans import queueing, selections

    whole, traces, kept = queueing.replay, queueing.trace, {}

    def replay(spark, d, methods=tuple(queueing.METHODS)):
        if d not in kept:
            kept[d] = whole(spark, d)
        return kept[d].filter(F.col("method").isin(*methods))

    def trace(spark, d, draws=True):
        if (d, draws) not in kept:
            df, mean = traces(spark, d, draws)
            kept[(d, draws)] = (queueing.durable(df, "trace"), mean)
        return kept[(d, draws)]

    patch = pytest.MonkeyPatch()
    patch.setattr(queueing, "replay", replay)
    patch.setattr(selections, "replay", replay)
    patch.setattr(queueing, "trace", trace)
    yield
    patch.undo()


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_same_as_sql(agree, name):
    agree(QUERIES[name], ORACLE[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_runs_without_sql(spark, sf_dir, name):
    assert QUERIES[name](spark, sf_dir).count() > 0


def test_contract(spark):
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).columns
