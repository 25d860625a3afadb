"""Splits that keep related records together.

Sessions and instructions are nodes; an action that has both links them, so
the graph has one edge for each distinct (session, instruction) pair, not one
for each action.  Components come from alternating large-star and small-star
steps; a round is two aggregations and two joins that split hot nodes, and its
result is a table in the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, Window
from pyspark.sql import functions as F

from loomgate.functions.text import plain, session_key
from loomgate.operators.keyed import MIN_HOT_ROWS, lookup_join
from loomgate.session import discard, durable

#: Far above the squared logarithm of any number of nodes; a guard, not a cap.
MAX_ROUNDS = 200


def _kept(edges: DataFrame, name: str = "edges") -> tuple[DataFrame, tuple]:
    """(edges as a table, their number and checksum), counted while they are written."""
    seen = Observation()
    out = durable(edges.observe(seen, F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("x")), name)
    return out, (seen.get["n"], seen.get["x"])


def _stars(edges: DataFrame, n: int, min_hot: int) -> DataFrame:
    """One large-star and one small-star step over edges (a > b)."""
    many = n > min_hot  # small enough tables have no hot node, and need no table between the steps
    join = (lambda rows, least: lookup_join(rows, least, "a", min_hot=min_hot)) if many else (lambda rows, least: rows.join(least, "a"))
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    large = join(both.filter("b > a"), least).select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
    if many:
        large = durable(large, "large")
    least = large.groupBy("a").agg(F.min("b").alias("m"))
    two = F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct("a", F.col("m").alias("b"))))
    return join(large, least).select(two.alias("e")).select("e.*").filter("a <> b").distinct()


def connected_components(edges: DataFrame, min_hot: int = MIN_HOT_ROWS) -> DataFrame:
    """``node, component`` for every node of ``edges`` (``a``, ``b``: strings).

    The component is named by its smallest node.  Loops, repeated edges and
    edges in both directions are allowed; edges with a null end are ignored.
    Nodes are numbered once; the rounds carry numbers only.  Nodes with a
    single neighbour are set aside first and take its component in the end.
    """
    ends = durable(edges.filter(F.col("a").isNotNull() & F.col("b").isNotNull()).select("a", "b").distinct(), "ends")
    nodes = durable(ends.select(F.explode(F.array("a", "b")).alias("node")).distinct().withColumn("id", F.monotonically_increasing_id()), "nodes")
    numbered = lookup_join(ends.filter("a <> b"), nodes.select(F.col("node").alias("a"), F.col("id").alias("x")), "a", min_hot=min_hot)
    numbered = numbered.join(nodes.select(F.col("node").alias("b"), F.col("id").alias("y")), "b")
    whole, (n, _) = _kept(numbered.select(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b")).distinct())
    discard(ends)
    # a leaf is an end of one edge only; of two leaves that have only each other, the smaller stays
    ways = whole.unionByName(whole.select(F.col("b").alias("a"), F.col("a").alias("b")))
    alone = ways.groupBy("a").agg(F.count(F.lit(1)).alias("ways"), F.min("b").alias("stem")).filter("ways = 1").select(F.col("a").alias("leaf"), "stem")
    alone = durable(alone, "leaves")
    mutual = alone.select(F.col("leaf").alias("stem"), F.col("stem").alias("leaf"))
    leaves = alone.join(mutual, ["leaf", "stem"], "left_anti").unionByName(alone.join(mutual, ["leaf", "stem"], "left_semi").filter("leaf > stem"))
    cut = leaves.select(F.greatest("leaf", "stem").alias("a"), F.least("leaf", "stem").alias("b"))
    current, before = _kept(whole.join(cut, ["a", "b"], "left_anti"))
    discard(whole)
    for _ in range(MAX_ROUNDS):
        if not before[0]:
            break
        fresh, after = _kept(_stars(current, before[0], min_hot))
        discard(current)
        current = fresh
        if after == before:
            break
        before = after
    else:
        raise RuntimeError("components did not settle")
    stem = nodes.select("node", "id").join(leaves.withColumnRenamed("leaf", "id"), "id", "left").withColumn("stem", F.coalesce("stem", "id"))
    roots = current.select(F.col("a").alias("stem"), F.col("b").alias("root"))
    rooted = durable(lookup_join(durable(stem, "stems"), roots, "stem", "left", min_hot).select("node", F.coalesce("root", "stem").alias("root")), "rooted")
    names = rooted.groupBy("root").agg(F.min("node").alias("component"))
    return lookup_join(rooted, names, "root", min_hot=min_hot).select("node", "component")


def action_groups(manifest: DataFrame) -> DataFrame:
    """``event_id, split, component`` of each distinct action, as a table.

    Actions are related through the same session (case, outer blanks and / for
    : ignored) or the same instruction digest (case ignored), also through
    others.  An action with neither is a group of its own.
    """
    session = F.when(F.col("session_id").isNotNull(), F.concat(F.lit("s:"), session_key(F.col("session_id"))))
    instruction = F.when(F.col("instruction_sha256").isNotNull(), F.concat(F.lit("i:"), plain(F.col("instruction_sha256"))))
    rows = durable(manifest.select("event_id", "split", session.alias("s"), instruction.alias("i")).distinct(), "actions")
    labels = connected_components(rows.select(F.col("s").alias("a"), F.col("i").alias("b")).distinct())
    keyed = rows.select("event_id", "split", F.coalesce("s", "i").alias("node"))
    joined = lookup_join(keyed, labels, "node", "left")
    return durable(joined.select("event_id", "split", F.coalesce("component", "node", F.concat(F.lit("e:"), "event_id")).alias("component")), "groups")


def torn_groups(groups: DataFrame) -> DataFrame:
    """``group_event_id, event_id`` of the groups with more than one non-null split."""
    facts = groups.groupBy("component").agg(F.min("event_id").alias("group_event_id"), F.min("split").alias("lo"), F.max("split").alias("hi")).filter("lo <> hi")
    return lookup_join(groups.select("component", "event_id"), facts.select("component", "group_event_id"), "component").select("group_event_id", "event_id").distinct()


def group_splits(groups: DataFrame, shares: tuple[tuple[str, float], ...] = (("train", 0.8), ("validation", 0.1), ("test", 0.1)), seed: str = "split") -> DataFrame:
    """``event_id, assigned_split``: the component's hash falls into one of the share ranges."""
    u = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(seed), "component")), 1, 13), 16, 10).cast("double") / float(1 << 52)
    edge, pick = 0.0, None
    for name, share in shares[:-1]:
        edge += share
        pick = F.when(u < edge, name) if pick is None else pick.when(u < edge, name)
    chosen = F.lit(shares[-1][0]) if pick is None else pick.otherwise(shares[-1][0])
    return groups.select("event_id", chosen.alias("assigned_split")).distinct()


def split_shares(assigned: DataFrame, groups: DataFrame, shares: tuple[tuple[str, float], ...] = (("train", 0.8), ("validation", 0.1), ("test", 0.1))) -> DataFrame:
    """``assigned_split, wished_share, n_events, share, n_groups, largest_group``: what a split reached.

    Groups never part, so one large group can keep a share from being met;
    ``largest_group`` tells its size.  Splits without events are listed.
    """
    sized = assigned.join(groups.select("event_id", "component").distinct(), "event_id").groupBy("assigned_split", "component").agg(F.count_distinct("event_id").alias("n"))
    got = sized.groupBy("assigned_split").agg(F.sum("n").alias("n_events"), F.count(F.lit(1)).alias("n_groups"), F.max("n").alias("largest_group"))
    wished = assigned.sparkSession.createDataFrame(list(shares), "assigned_split string, wished_share double")
    out = wished.join(got, "assigned_split", "left")
    n = [F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in ("n_events", "n_groups", "largest_group")]
    total = F.sum("n_events").over(Window.partitionBy())  # one row a split
    return out.select("assigned_split", "wished_share", *n).withColumn("share", F.when(total > 0, F.col("n_events") / total).otherwise(0.0))
