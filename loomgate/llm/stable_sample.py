"""A sample that depends on nothing but the identifier.

Identifiers are mapped to a fixed domain of 2**60 numbers and permuted by a
balanced Feistel network; those whose image lies under rate * 2**60 are in.
The permutation has no collisions and no state: reruns, other partitionings
and new rows change nothing for a row already judged, and a larger rate keeps
every row of a smaller one.  All of it is built-in arithmetic, so it runs
inside the scan; only the chosen identifiers are made distinct.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HALF_BITS = 30
MASK = (1 << HALF_BITS) - 1
ROUNDS = 6


def round_constants(seed: str) -> list[tuple[int, int]]:
    """(odd multiplier, addend) of each round, both below 2**30, from the seed."""
    out = []
    for r in range(ROUNDS):
        digest = hashlib.md5(f"{seed}|{r}".encode()).digest()
        out.append(((int.from_bytes(digest[:4], "big") & MASK) | 1, int.from_bytes(digest[4:8], "big") & MASK))
    return out


def identifier(c: Column) -> Column:
    """Numeric identifier in [0, 2**60) of a string key."""
    return F.conv(F.substring(F.md5(c), 1, 15), 16, 10).cast("bigint")


def permute(number: Column, seed: str) -> Column:
    """Feistel permutation of [0, 2**60)."""

    def turn(state, constants):
        mixed = state["r"] * constants["a"] + constants["b"]
        mixed = F.shiftright(mixed, 17).bitwiseXOR(mixed).bitwiseAND(F.lit(MASK))
        return F.struct(state["r"].alias("l"), state["l"].bitwiseXOR(mixed).alias("r"))

    rounds = F.array(*[F.struct(F.lit(a).cast("bigint").alias("a"), F.lit(b).cast("bigint").alias("b")) for a, b in round_constants(seed)])
    start = F.struct(F.shiftright(number, HALF_BITS).alias("l"), number.bitwiseAND(F.lit(MASK)).alias("r"))
    return F.aggregate(rounds, start, turn, lambda state: F.shiftleft(state["l"], HALF_BITS).bitwiseOR(state["r"]))


def stable_sample(df: DataFrame, key: str, rate: float, seed: str = "sample", normal=lambda c: c) -> DataFrame:
    """Distinct chosen keys of ``df``, as column ``key`` written by ``normal``.

    Null keys are never chosen; an empty table gives an empty sample; rate 0
    chooses none and rate 1 all.  Repeated rows count once.
    """
    if not 0 <= rate <= 1:
        raise ValueError("rate must lie between 0 and 1")
    limit = int(rate * (1 << (2 * HALF_BITS)))
    named = df.select(normal(F.col(key)).alias(key)).filter(F.col(key).isNotNull())
    return named.filter(permute(identifier(F.col(key)), seed) < F.lit(limit)).distinct()


def permute_sql(number: str, seed: str) -> tuple[str, str]:
    """(select list of round columns, final expression) of the permutation in SQL."""
    steps = [f"{number} >> {HALF_BITS} as l0, {number} & {MASK} as r0"]
    for i, (a, b) in enumerate(round_constants(seed)):
        m = f"(r{i} * {a} + {b})"
        steps.append(f"r{i} as l{i + 1}, xor(l{i}, xor({m} >> 17, {m}) & {MASK}) as r{i + 1}")
    return ", ".join(steps), f"(l{ROUNDS} << {HALF_BITS}) | r{ROUNDS}"
