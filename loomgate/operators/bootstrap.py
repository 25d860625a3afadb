"""Paired bootstrap over whole sessions."""

from __future__ import annotations

from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgate.functions.hashing import mixed

#: Tasks that share the resamples of one key; each holds all rows of the key.
PARTS = 4


def session_draws(key: tuple[Any, ...], b: int, n: int) -> np.ndarray:
    """The n sessions of resample ``b``, as numbers in the order of their names."""
    return np.floor(mixed(b, np.arange(n), "|".join(["boot", *map(str, key)])) * n).astype(np.int64)


def _weighted_percentile(values: np.ndarray, weights: np.ndarray, q: float) -> float:
    """Linearly interpolated percentile of sorted values that count ``weights`` times each."""
    cum = np.cumsum(weights)
    at = (cum[-1] - 1) * q
    low, high = (values[np.searchsorted(cum, k, side="right")] for k in (np.floor(at), np.ceil(at)))
    return float(low + (high - low) * (at - np.floor(at)))


def session_bootstrap(rows: DataFrame, keys: list[str], resamples: int, q: float = 0.95) -> DataFrame:
    """``keys, b, gain``: the part by which the percentile of the others is under that of ``base``, per resample.

    ``rows``: keys, ``session_id``, ``base`` boolean, ``latency``.  Sessions
    that only one of the two has are left out.  A resample gives each session
    a weight; its rows are never expanded.
    """
    types = dict(rows.dtypes)
    schema = ", ".join([*(f"`{k}` {types[k]}" for k in keys), "b int, gain double"])

    def run(key: tuple[Any, ...], pdf: pd.DataFrame) -> pd.DataFrame:
        *key, part = key
        names = pdf["session_id"].fillna("")
        paired = sorted(set(names[pdf["base"]]) & set(names[~pdf["base"]]))
        session = pd.Index(paired).get_indexer(names)
        sides = []
        for base in (True, False):
            mine = (pdf["base"] == base).to_numpy() & (session >= 0)
            latency = pdf["latency"].to_numpy()[mine]
            order = np.argsort(latency, kind="stable")
            sides.append((latency[order], session[mine][order]))
        out = []
        for b in range(part, resamples if paired else 0, PARTS):
            w = np.bincount(session_draws(tuple(key), b, len(paired)), minlength=len(paired))
            a, c = (_weighted_percentile(v, w[s], q) for v, s in sides)
            out.append((*key, b, (a - c) / max(a, 0.001)))
        return pd.DataFrame(out, columns=[*keys, "b", "gain"])

    parts = rows.withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))))
    return parts.groupBy(*keys, "_part").applyInPandas(run, schema)
