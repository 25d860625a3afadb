"""Percentiles from mergeable dyadic-tree digests.

Values are quantized to a bounded ordered universe of 2**16 cells (256 cells
an octave on either side of zero).  A digest is a set of nodes of the binary
tree over the universe with counts; nodes too light are folded into their
parent.  Digests merge by adding counts node by node, so days or partitions
can be kept and combined later.  The rank error is deterministic: at most
LEVELS * n / k of n values.  Quantizing adds a relative error below 2**(1/256) - 1
for magnitudes between 2**-63 and 2**64; smaller ones read as the smallest
cell, zero has a cell of its own.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LEVELS = 16
#: Compression: the rank error is at most LEVELS / K = 0.1 % of n, a tenth of what the 99th percentile leaves above it.
K = 16_000
HALF = 1 << (LEVELS - 1)
PER_OCTAVE = 256


def cell(v: Column) -> Column:
    """Cell of a finite value, 0 .. 2**16 - 1, in the order of the values."""
    size = F.greatest(F.lit(1), F.least(F.lit(HALF - 1), F.floor(F.log2(F.greatest(F.abs(v), F.lit(1e-300))) * PER_OCTAVE) + HALF // 2)).cast("int")
    return F.when(v == 0, HALF).when(v > 0, HALF + size).otherwise(HALF - size).cast("int")


def cell_value(c: Column) -> Column:
    """Geometric middle of a cell."""
    size = F.pow(F.lit(2.0), (F.abs(c - HALF) - HALF // 2 + 0.5) / PER_OCTAVE)
    return F.when(c == HALF, 0.0).when(c > HALF, size).otherwise(-size)


def _compress(nodes: np.ndarray, counts: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Fold light sibling pairs into their parents, leaves first. Nodes are heap numbers, the root is 1."""
    n = int(counts.sum())
    cap = n // k
    dense = np.zeros(2 << LEVELS, dtype=np.int64)
    np.add.at(dense, nodes, counts)
    if cap:
        for level in range(LEVELS, 0, -1):
            lo, hi = 1 << level, 2 << level
            left, right, up = dense[lo:hi:2], dense[lo + 1 : hi : 2], dense[lo // 2 : hi // 2]
            fold = (left + right + up <= cap) & (left + right > 0)
            up[fold] += left[fold] + right[fold]
            left[fold] = 0
            right[fold] = 0
    kept = np.nonzero(dense)[0]
    return kept, dense[kept]


def digest(df: DataFrame, keys: list[str], value: str, k: int = K) -> DataFrame:
    """Digests ``keys, node, n`` of the finite values of ``value``.

    Leaf counts are aggregated in the JVM first, so a group is at most 2**16
    rows when it is compressed, however many values it has.  Nulls, NaN and
    infinities are not counted; null keys form groups of their own.
    """
    v = F.col(value)
    finite = df.filter(v.isNotNull() & ~F.isnan(v) & (F.abs(v) != F.lit(float("inf"))))
    leaves = finite.groupBy(*keys, (cell(v) + (1 << LEVELS)).alias("node")).agg(F.count(F.lit(1)).alias("n"))
    return _compressed(leaves, keys, k)


def _compressed(nodes: DataFrame, keys: list[str], k: int) -> DataFrame:
    types = dict(nodes.dtypes)
    schema = ", ".join([*(f"`{c}` {types[c]}" for c in keys), "node int", "n bigint"])

    def run(key: tuple[Any, ...], pdf: pd.DataFrame) -> pd.DataFrame:
        node, n = _compress(pdf["node"].to_numpy(), pdf["n"].to_numpy(), k)
        out = pd.DataFrame({"node": node.astype("int32"), "n": n})
        for i, c in enumerate(keys):
            out.insert(i, c, pd.Series([key[i]] * len(out), dtype=pdf[c].dtype))
        return out

    return nodes.groupBy(*keys).applyInPandas(run, schema)


def merge(digests: DataFrame, keys: list[str], k: int = K) -> DataFrame:
    """Digests over fewer keys: counts of equal nodes are added, then compressed again."""
    return _compressed(digests.groupBy(*keys, "node").agg(F.sum("n").alias("n")), keys, k)


def _estimates(node: np.ndarray, count: np.ndarray, qs: list[float], k: int) -> pd.DataFrame:
    """Columns n, q, leaf and max_rank_error of one digest."""
    level = np.floor(np.log2(node)).astype(int)
    last = ((node + 1) << (LEVELS - level)) - 1 - (1 << LEVELS)
    order = np.lexsort((-level, last))
    last, count = last[order], count[order]
    total, running = int(count.sum()), np.cumsum(count)
    at = [last[min(np.searchsorted(running, max(1, np.ceil(q * total))), len(last) - 1)] for q in qs]
    return pd.DataFrame({"n": total, "q": qs, "leaf": np.array(at, dtype="int32"), "max_rank_error": LEVELS * (total // k) + 1})


_ESTIMATE = "n bigint, q double, leaf int, max_rank_error bigint"


def quantiles(digests: DataFrame, keys: list[str], qs: list[float], k: int = K) -> DataFrame:
    """``keys, n, q, value, max_rank_error``: an estimate for each quantile of each digest.

    The true rank of ``value`` is within ``max_rank_error`` of q * n, up to the
    width of a cell.  Each digest has at most a few times k nodes.
    """
    types = dict(digests.dtypes)
    schema = ", ".join([*(f"`{c}` {types[c]}" for c in keys), _ESTIMATE])

    def run(key: tuple[Any, ...], pdf: pd.DataFrame) -> pd.DataFrame:
        out = _estimates(pdf["node"].to_numpy(), pdf["n"].to_numpy(), qs, k)
        for i, c in enumerate(keys):
            out.insert(i, c, pd.Series([key[i]] * len(out), dtype=pdf[c].dtype))
        return out

    return digests.groupBy(*keys).applyInPandas(run, schema).withColumn("value", cell_value(F.col("leaf"))).drop("leaf")


def running_quantiles(digests: DataFrame, keys: list[str], step: str, qs: list[float], k: int = K) -> DataFrame:
    """``quantiles`` of everything up to and including each ``step`` (a day) of each group.

    The steps of a group are merged one after another in a stream sorted by
    step: a task holds one tree of 2 * 2**16 counts, however many steps there
    are.  Steps that are null come first.
    """
    types = dict(digests.dtypes)
    schema = ", ".join([*(f"`{c}` {types[c]}" for c in (*keys, step)), _ESTIMATE])
    names = [*keys, step]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, group, tree = None, None, np.zeros(2 << LEVELS, dtype=np.int64)

        def closed() -> pd.DataFrame:
            nonlocal tree
            full = np.nonzero(tree)[0]
            node, n = _compress(full, tree[full], k)
            tree = np.zeros(2 << LEVELS, dtype=np.int64)
            tree[node] = n
            out = _estimates(node, n, qs, k)
            for i, c in enumerate(names):
                out.insert(i, c, [held[i]] * len(out))
            return out

        for pdf in batches:
            text = [pdf[c].astype(object).where(pdf[c].notna(), None) for c in names]
            edge = np.ones(len(pdf), dtype=bool)
            edge[1:] = False
            for t in text:
                edge[1:] |= t.to_numpy()[1:] != t.to_numpy()[:-1]
            starts = [*np.nonzero(edge)[0].tolist(), len(pdf)]
            for a, b in zip(starts, starts[1:]):
                mine = tuple(t.iloc[a] for t in text)
                if held is not None and mine != held:
                    yield closed()
                if mine[:-1] != group:
                    group = mine[:-1]
                    tree[:] = 0
                held = mine
                np.add.at(tree, pdf["node"].to_numpy()[a:b], pdf["n"].to_numpy()[a:b])
        if held is not None:
            yield closed()

    ordered = digests.repartition(*keys).sortWithinPartitions(*names)
    return ordered.select(*names, "node", "n").mapInPandas(run, schema).withColumn("value", cell_value(F.col("leaf"))).drop("leaf")


def rank_check(values: DataFrame, estimates: DataFrame, keys: list[str], value: str) -> DataFrame:
    """``keys, q, n, kept``: whether each estimate keeps its stated rank error, by true ranks.

    Counts all ``values`` below and up to each estimate, give or take the width
    of a cell.  One aggregation: the estimates of a group are a short array.
    """
    v = F.col(value)
    finite = values.filter(v.isNotNull() & ~F.isnan(v) & (F.abs(v) != F.lit(float("inf"))))
    qs = sorted(r[0] for r in estimates.select("q").distinct().collect())  # the quantiles asked for
    wide = estimates.groupBy(*keys).agg(*[F.max(F.when(F.col("q") == q, F.col("value"))).alias(f"_e{i}") for i, q in enumerate(qs)], F.max("max_rank_error").alias("_err"))
    both = finite.join(F.broadcast(wide), [finite[c].eqNullSafe(wide[c]) for c in keys]).select(*[finite[c] for c in keys], v.alias("_v"), *[f"_e{i}" for i in range(len(qs))], "_err")
    width = 2 ** (1 / PER_OCTAVE) - 1
    counts = [F.max("_err").alias("_err"), F.count(F.lit(1)).alias("n")]
    for i in range(len(qs)):
        e, slack = F.col(f"_e{i}"), F.abs(F.col(f"_e{i}")) * width + 1e-9
        counts += [F.count_if(F.col("_v") < e - slack).alias(f"_l{i}"), F.count_if(F.col("_v") <= e + slack).alias(f"_h{i}")]
    counted = both.groupBy(*keys).agg(*counts)
    rank = lambda q: F.greatest(F.lit(1), F.ceil(F.col("n") * q))
    each = F.explode(F.array(*[F.struct(F.lit(q).alias("q"), ((F.col(f"_l{i}") - F.col("_err") <= rank(q)) & (rank(q) <= F.col(f"_h{i}") + F.col("_err"))).alias("kept")) for i, q in enumerate(qs)]))
    return counted.select(*keys, "n", each.alias("x")).select(*keys, "x.q", "n", "x.kept")
