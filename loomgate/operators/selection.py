"""Deterministic selection: quotas, hash-ordered picks, cut points."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgate.functions.stats import DIRECT_ROWS, values_at


def largest_remainder(weights: DataFrame, key: str, weight: str, total: int, capacity: str | None = None) -> DataFrame:
    """``key, quota``: shares of ``total`` in proportion to ``weight``, remainders to the largest fractions.

    Ties go to the smaller key; with ``capacity`` (equal to the weight) to the
    larger spare capacity, then the larger key, and no quota exceeds it.  One
    row a stratum: the window runs over strata, not over records.
    """
    everything = Window.partitionBy()
    raw = F.col(weight) * total / F.sum(weight).over(everything)
    rows = weights.withColumn("_raw", raw).withColumn("_base", F.floor("_raw"))
    ties: list[Column] = [F.col(key)]
    if capacity:
        rows = rows.withColumn("_base", F.least("_base", capacity))
        ties = [F.desc(F.col(capacity) - F.col("_base")), F.desc(key)]
    spare = F.lit(total) - F.sum("_base").over(everything)
    rank = F.row_number().over(Window.orderBy(F.desc(F.col("_raw") - F.col("_base")), *ties))
    return rows.withColumn("_left", spare).select(key, (F.col("_base") + F.when(rank <= F.col("_left"), 1).otherwise(0)).cast("bigint").alias("quota"))


def equal_quota(strata: DataFrame, key: str, order: Column, total: int) -> DataFrame:
    """``key, quota``: total split evenly, the first strata in ``order`` get one more."""
    n = F.count(F.lit(1)).over(Window.partitionBy())
    rank = F.row_number().over(Window.orderBy(order, key))
    return strata.select(key, (F.floor(F.lit(total) / n) + F.when(rank <= F.lit(total) % n, 1).otherwise(0)).cast("bigint").alias("quota"))


def top_by_hash(df: DataFrame, group: list[str], order: Column, tie: str, k: Column | int) -> DataFrame:
    """The first ``k`` rows of each group in hash order; k may be a column.

    A constant k is pushed down, so each partition keeps k rows a group before
    the shuffle.
    """
    ranked = df.withColumn("_rank", F.row_number().over(Window.partitionBy(*group).orderBy(order, tie)))
    return ranked.filter(F.col("_rank") <= k).drop("_rank")


def cut_points(df: DataFrame, value: str, parts: int = 3, direct: int = DIRECT_ROWS) -> list[int]:
    """The elements at ranks n/parts, 2n/parts, .. (0-based, rounded down) of an integer column; nulls where there are none.

    Up to ``direct`` different values are put in order by their counts; with
    more, only the buckets that hold a wanted rank are split until they fit.
    """
    counts = df.filter(F.col(value).isNotNull()).groupBy(value).agg(F.count(F.lit(1)).alias("n"))
    if counts.limit(direct + 1).count() > direct:
        rows = df.filter(F.col(value).isNotNull()).select(F.lit(1).alias("_g"), F.col(value).cast("double").alias("_v"))
        found = values_at(rows, ["_g"], F.array(*[F.floor(F.col("n") * i / parts) for i in range(1, parts)]), direct).collect()  # parts - 1 ranks
        at = {r["_rank"]: int(r["_v"]) for r in found}
        return [at[found[0]["n"] * i // parts] for i in range(1, parts)]
    cum = counts.withColumn("upto", F.sum("n").over(Window.orderBy(value).rowsBetween(Window.unboundedPreceding, 0))).withColumn("all", F.sum("n").over(Window.partitionBy()))
    picked = cum.select(*[F.min(F.when(F.col("upto") > F.floor(F.col("all") * i / parts), F.col(value))).alias(f"c{i}") for i in range(1, parts)]).first()
    return [picked[f"c{i}"] for i in range(1, parts)]


def first_by_key(df: DataFrame, key: str, order: str) -> DataFrame:
    """One row a key, the one with the smallest ``order``; null keys are dropped."""
    others = [c for c in df.columns if c != key]
    return df.filter(F.col(key).isNotNull()).groupBy(key).agg(F.min_by(F.struct(*others), F.col(order)).alias("r")).select(key, "r.*")


def fixed_quota_sample(frame: DataFrame, quotas: dict[str, int], first_quota: int, hard_minimum: int, order: Column) -> DataFrame:
    """``event_id, bin, part`` of a sample with exact quotas for the bins.

    ``frame``: distinct ``event_id``, ``bin``, ``is_first`` (the first source)
    and ``is_hard``.  ``first_quota`` members come from the first source, and
    at least ``hard_minimum`` hard ones from the others; both are shared out
    over the bins in proportion to what the bins have, the rest of each bin is
    filled from the other sources.  ``order`` decides who is taken.  A bin or
    part that has too few members fails.  Only counts per bin reach the driver.
    """
    rows = frame.filter(F.col("bin").isin(*quotas))
    have = {r["bin"]: r for r in rows.groupBy("bin").agg(F.count_if("is_first").alias("first"), F.count_if(~F.col("is_first") & F.col("is_hard")).alias("hard"), F.count_if(~F.col("is_first")).alias("other")).collect()}
    n = lambda b, part: have[b][part] if b in have else 0
    first = share_out(first_quota, {b: min(n(b, "first"), quotas[b]) for b in quotas})
    hard = share_out(hard_minimum, {b: min(n(b, "hard"), quotas[b] - first[b]) for b in quotas})
    for b, total in quotas.items():
        if n(b, "other") < total - first[b]:
            raise ValueError(f"bin {b} has {n(b, 'other')} members of the other sources, {total - first[b]} are needed")
    spark = frame.sparkSession
    wish = spark.createDataFrame([(b, first[b], hard[b], quotas[b] - first[b]) for b in quotas], "bin string, q_first bigint, q_hard bigint, q_other bigint")
    part = F.when(F.col("is_first"), 0).when(F.col("is_hard"), 1).otherwise(2)
    ranked = rows.withColumn("_h", order).withColumn("_part", part)
    ranked = ranked.withColumn("_k", F.row_number().over(Window.partitionBy("bin", "_part").orderBy("_h", "event_id"))).join(F.broadcast(wish), "bin")  # one row a bin
    taken = F.when(F.col("is_first"), F.when(F.col("_k") <= F.col("q_first"), "first")).when(F.col("is_hard") & (F.col("_k") <= F.col("q_hard")), "hard")
    ranked = ranked.withColumn("_taken", taken)
    sure = ranked.filter(F.col("_taken").isNotNull()).select("event_id", "bin", F.col("_taken").alias("part"))
    rest = ranked.filter(F.col("_taken").isNull() & ~F.col("is_first"))
    fill = rest.withColumn("_k", F.row_number().over(Window.partitionBy("bin").orderBy("_h", "event_id"))).filter(F.col("_k") <= F.col("q_other") - F.col("q_hard"))
    return sure.unionByName(fill.select("event_id", "bin", F.lit("fill").alias("part")))


def share_out(total: int, capacities: dict[str, int]) -> dict[str, int]:
    """``total`` in proportion to the capacities and never beyond them; remainders as in ``largest_remainder``."""
    room = sum(capacities.values())
    if total > room:
        raise ValueError(f"{total} places, but only {room} members")
    raw = {k: c * total / room if room else 0.0 for k, c in capacities.items()}
    out = {k: min(int(raw[k]), c) for k, c in capacities.items()}
    by_fraction = sorted(sorted(capacities, reverse=True), key=lambda k: (-(raw[k] - out[k]), -(capacities[k] - out[k])))
    for k in by_fraction[: total - sum(out.values())]:
        out[k] += 1
    return out


#: Groups that the exact subset takes; it is sequential, with one number for each sum up to the target.
MAX_SUBSET_GROUPS = 1_000_000


def exact_subset(groups: DataFrame, target: int, order: Column) -> DataFrame:
    """``session_id, n`` of whole groups whose sizes sum to exactly ``target``, or no row where there are none.

    Groups are tried in ``order``; of several subsets the one that is complete
    first is taken.  Sequential by nature: it holds ``target`` numbers and at
    most MAX_SUBSET_GROUPS sizes on the driver, and fails beyond.
    """
    import numpy as np

    rows = groups.select("session_id", "n").orderBy(order, "session_id").limit(MAX_SUBSET_GROUPS + 1).collect()
    if len(rows) > MAX_SUBSET_GROUPS:
        raise ValueError("too many groups for an exact subset")
    reached = np.full(target + 1, -1, dtype=np.int64)  # which group first made each sum
    reached[0] = len(rows)
    for i, r in enumerate(rows):
        n = r["n"]
        if 0 < n <= target:
            fresh = (reached[n:] < 0) & (reached[: target + 1 - n] >= 0)
            reached[n:][fresh] = i
        if reached[target] >= 0:
            break
    out, left = [], target if reached[target] >= 0 else 0
    while left:
        r = rows[int(reached[left])]
        out.append((r["session_id"], r["n"]))
        left -= r["n"]
    return groups.sparkSession.createDataFrame(out, "session_id string, n bigint")


def pick_action(df: DataFrame, actions: str, action_id: str) -> DataFrame:
    """Adds ``action``: the element of ``actions`` (structs with ``action_id``) with the id, else the one at its trailing number, from 0.

    A row that has neither fails.
    """
    named = F.get(F.filter(F.col(actions), lambda a: a["action_id"] == F.col(action_id)), F.lit(0))
    at = F.expr(f"try_cast(nullif(regexp_extract(`{action_id}`, '([0-9]+)$', 1), '') as int)")
    place = F.when(at < F.size(actions), F.get(F.col(actions), at))
    found = df.withColumn("action", F.coalesce(named, place))
    known = F.when(F.col("action").isNull(), F.raise_error(F.concat(F.lit("no action "), F.coalesce(action_id, F.lit("null"))))).otherwise(F.lit(True))
    return found.filter(known)


def archive_matches(events: DataFrame, rows: DataFrame, text: str) -> DataFrame:
    """``events`` joined with archive ``rows`` by (source_file = member, source_row_index = row_index), and ``verified``.

    An event is verified when the digest of the row's normalised ``text`` is
    its ``instruction_sha256``; one without a row is kept, unverified.
    """
    plain = F.trim(F.regexp_replace(F.lower(F.col(text)), r"\s+", " "))
    side = rows.select(F.col("member").alias("source_file"), F.col("row_index").cast("bigint").alias("source_row_index"), text, F.sha2(plain, 256).alias("_digest"))
    out = events.join(side, ["source_file", "source_row_index"], "left")
    return out.withColumn("verified", F.coalesce(F.col("_digest") == F.lower("instruction_sha256"), F.lit(False))).drop("_digest")
