"""Digests and hash-uniform numbers; the same in any engine with SHA-256."""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def stable_key(*parts: Column | str) -> Column:
    """SHA-256 hex of the parts joined by |; a null part is written None."""
    return F.sha2(F.concat_ws("|", *[F.coalesce((p if isinstance(p, Column) else F.lit(p)).cast("string"), F.lit("None")) for p in parts]), 256)


def uniform(*parts: Column | str) -> Column:
    """A number in [0, 1) from the first 52 bits of the stable key."""
    return F.conv(F.substring(stable_key(*parts), 1, 13), 16, 10).cast("bigint").cast("double") / float(1 << 52)


def uniform_sql(*parts: str) -> str:
    """``uniform`` in SQL; parts are SQL expressions."""
    joined = " || '|' || ".join(f"coalesce(cast({p} as varchar), 'None')" for p in parts)
    return f"(cast(cast('0x' || substr(sha256({joined}), 1, 13) as bigint) as double) / 4503599627370496.0)"


def canonical_json_digest(columns: list[str]) -> Column:
    """SHA-256 of a row as JSON with sorted keys, nulls written out; floats in Spark's notation."""
    return F.sha2(F.to_json(F.struct(*sorted(columns)), {"ignoreNullFields": "false"}), 256)


_MASK = (1 << 30) - 1


def mix_constants(seed: str, rounds: int = 4) -> list[tuple[int, int]]:
    """(odd multiplier, addend) of each round of ``mixed``, both below 2**30."""
    out = []
    for r in range(rounds):
        digest = hashlib.sha256(f"{seed}|{r}".encode()).digest()
        out.append(((int.from_bytes(digest[:4], "big") & _MASK) | 1, int.from_bytes(digest[4:8], "big") & _MASK))
    return out


def mixed(high: int, low: np.ndarray, seed: str) -> np.ndarray:
    """Numbers in [0, 1) from pairs of numbers below 2**30: a Feistel network of the two, whole arrays at a time."""
    left, right = np.full(len(low), high, dtype=np.int64), low.astype(np.int64)
    for a, c in mix_constants(seed):
        t = right * a + c
        left, right = right, left ^ (((t >> 17) ^ t) & _MASK)
    return (left.astype(np.float64) * (1 << 30) + right) / float(1 << 60)


def mixed_sql(high: str, low: str, rounds: int = 4) -> tuple[str, str]:
    """(select list of round columns, final expression) of ``mixed`` in SQL; the constants are columns a0, c0, a1, .."""
    steps = [f"({high})::bigint as l0, ({low})::bigint as r0"]
    for i in range(rounds):
        t = f"(r{i} * a{i} + c{i})"
        steps.append(f"r{i} as l{i + 1}, xor(l{i}, xor({t} >> 17, {t}) & {_MASK}) as r{i + 1}")
    return ", ".join(steps), f"((l{rounds}::double * {1 << 30} + r{rounds}) / {float(1 << 60)})"
