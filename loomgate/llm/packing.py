"""Texts packed into containers of bounded token length.

Lengths are whole numbers up to the capacity, so the packing problem is the
histogram of lengths: at most one count a length, whatever the corpus.  The
driver packs that histogram by best fit with several capacities (see
``pack_histogram``) and shrinks each container to the smallest permitted size
that holds its contents.  Items then find their place by their position among
the items of equal length, which needs no window.  Only texts longer than a
container are split.
"""

from __future__ import annotations

import base64
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgate.operators.keyed import global_position
from loomgate.session import durable

#: Pre-tokenization pattern that belongs to the rank files (fixed value).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"


def token_counts(df: DataFrame, key: str = "doc_id", text: str = "text", tokenizer: str = TOKENIZER) -> DataFrame:
    """``<key>, n_tokens`` of whole texts, as a table; null and empty texts have 0 tokens.

    ``tokenizer`` is a rank file every executor can read.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import tiktoken

        with open(tokenizer, "rb") as f:
            ranks = {base64.b64decode(t): int(r) for t, r in map(bytes.split, f)}
        encode = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        for pdf in batches:
            yield pd.DataFrame({key: pdf[key], "n_tokens": [len(encode(t)) if t else 0 for t in pdf[text]]})

    kind = dict(df.dtypes)[key]
    return durable(df.select(key, text).mapInPandas(run, f"`{key}` {kind}, n_tokens bigint"), "tokens")


def container_cost(size: int, overhead: float = 64.0, attention: float = 0.0) -> float:
    """Cost of a container in tokens: its size, a fixed part, and size ** 2 / ``attention`` for what grows with the square (0: nothing)."""
    return size + overhead + (size * size / attention if attention else 0.0)


def _filled(size: int, longest: int, lengths: list[int], left: dict[int, int]) -> int:
    """Tokens that a new container of ``size`` would hold: the longest item, then always the largest that fits."""
    room, i = size - longest, bisect_left(lengths, longest)
    used = {longest: 1}
    i = min(i, len(lengths) - 1)
    while room and i >= 0:
        n = lengths[i]
        k = min(room // n, left[n] - used.get(n, 0))
        room -= k * n
        i = min(i, bisect_left(lengths, room + 1)) - 1
    return size - room


def pack_histogram(counts: dict[int, int], sizes: tuple[int, ...], overhead: float = 64.0, attention: float = 0.0) -> list[tuple[int, int, dict[int, int]]]:
    """Patterns (size, how many containers, {length: items in each}) that hold all items exactly once.

    Best fit with several capacities, on counts: lengths from the longest down,
    each to the open containers with the least room that holds it.  Where none
    does, the permitted size is opened whose cost for each token it is going to
    hold is least, judged by filling it from all items that are left; of equal
    costs the larger.  In the end each container shrinks to the smallest
    permitted size that holds its contents.  Containers with equal contents are
    one pattern, so the work depends on the lengths, not on the items.
    """
    left = {n: c for n, c in counts.items() if c > 0}
    if any(n < 1 or n > max(sizes) for n in left):
        raise ValueError("lengths must lie between 1 and the largest size")
    lengths = sorted(left)
    rooms: list[int] = []  # sorted rooms of the open containers
    open_: dict[int, list[tuple[int, int, dict[int, int]]]] = {}  # room -> (size, containers, contents)

    def put(room: int, size: int, times: int, uses: dict[int, int]) -> None:
        if times:
            if room not in open_:
                insort(rooms, room)
                open_[room] = []
            open_[room].append((size, times, uses))

    while lengths:
        n = lengths[-1]
        while left[n]:
            i = bisect_left(rooms, n)
            if i < len(rooms):
                room = rooms[i]
                size, times, uses = open_[room].pop()
                if not open_[room]:
                    del open_[room]
                    rooms.pop(i)
                k = min(room // n, left[n])  # the fullest container that holds one goes on being the fullest
                t = min(times, max(1, left[n] // k))
                put(room, size, times - t, uses)
                put(room - k * n, size, t, {**uses, n: uses.get(n, 0) + k})
            else:
                size = min(sorted((s for s in sizes if s >= n), reverse=True), key=lambda s: round(container_cost(s, overhead, attention) / _filled(s, n, lengths, left), 12))
                k = min(size // n, left[n])
                t = left[n] // k
                put(size - k * n, size, t, {n: k})
            left[n] -= k * t
        lengths.pop()
        del left[n]
    out = []
    for room in rooms:
        for size, times, uses in open_[room]:
            out.append((min(s for s in sizes if s >= size - room), times, uses))
    return out


def pack(tokens: DataFrame, key: str = "doc_id", sizes: tuple[int, ...] = (256, 512, 1024, 2048), overhead: float = 64.0, attention: float = 0.0) -> DataFrame:
    """``container_id, container_size, <key>, piece_no, start_token, n_tokens`` of every item.

    A text of more than ``max(sizes)`` tokens is cut into full containers and a
    rest; no other text is split.  Texts without tokens are listed with a null
    container.  Repeated keys are packed as often as they come.
    """
    cap = max(sizes)
    pieces = F.when(F.col("n_tokens") <= cap, F.array(F.lit(0).cast("bigint"))).otherwise(F.sequence(F.lit(0).cast("bigint"), F.ceil(F.col("n_tokens") / cap) - 1))
    items = tokens.select(key, F.explode(pieces).alias("piece_no"), "n_tokens")
    items = items.select(key, "piece_no", (F.col("piece_no") * cap).alias("start_token"), F.least(F.lit(cap).cast("bigint"), F.col("n_tokens") - F.col("piece_no") * cap).alias("n_tokens"))
    counts = {r[0]: r[1] for r in items.filter("n_tokens > 0").groupBy("n_tokens").count().collect()}  # at most cap rows
    patterns = pack_histogram(counts, sizes, overhead, attention)
    firsts, before = {}, 0
    for n in sorted(counts):
        firsts[n], before = before, before + counts[n]
    slots = items.sparkSession.sparkContext.broadcast((_slots(patterns), firsts))  # a few numbers a pattern and length
    order = [F.col("n_tokens"), F.xxhash64(key, "piece_no"), F.col(key), F.col("piece_no")]
    placed = global_position(items.filter("n_tokens > 0"), order)

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        table, first = slots.value
        for pdf in batches:
            ids, kind = np.zeros(len(pdf), dtype=np.int64), np.zeros(len(pdf), dtype=np.int64)
            length, pos = pdf["n_tokens"].to_numpy(), pdf["pos"].to_numpy()
            for n in np.unique(length):
                at = np.nonzero(length == n)[0]
                starts, each, base, size = table[int(n)]
                rank = pos[at] - first[int(n)]
                s = np.searchsorted(starts, rank, side="right") - 1
                ids[at] = base[s] + (rank - starts[s]) // each[s]
                kind[at] = size[s]
            yield pdf.drop(columns="pos").assign(container_id=ids, container_size=kind)

    columns = ["container_id", "container_size", key, "piece_no", "start_token", "n_tokens"]
    schema = ", ".join(f"`{c}` {t}" for c, t in [*items.dtypes, ("container_id", "bigint"), ("container_size", "bigint")])
    none = F.lit(None).cast("bigint")
    empty = items.filter("n_tokens = 0").select(none.alias("container_id"), none.alias("container_size"), *columns[2:])
    return placed.mapInPandas(assign, schema).select(*columns).unionByName(empty)


def _slots(patterns: list[tuple[int, int, dict[int, int]]]) -> dict[int, tuple[np.ndarray, ...]]:
    """Per length: first position, items a container, first container and size of each pattern that uses it."""
    made: dict[int, list[tuple[int, int, int, int]]] = {}
    taken: dict[int, int] = {}
    container = 0
    for size, times, uses in patterns:
        for n, k in uses.items():
            made.setdefault(n, []).append((taken.get(n, 0), k, container, size))
            taken[n] = taken.get(n, 0) + k * times
        container += times
    return {n: tuple(np.array(c, dtype=np.int64) for c in zip(*rows)) for n, rows in made.items()}


def packing_check(packed: DataFrame, tokens: DataFrame, key: str = "doc_id", cap: int = 2048) -> DataFrame:
    """One row of counts that say whether a packing is whole.

    ``n_documents``; ``n_lost`` and ``n_doubled``, documents with fewer or more
    packed tokens than they have or with pieces that do not meet end to end;
    ``n_split``, documents in pieces though they would fit; ``n_over``,
    containers that hold more than their size; ``well_filled``, whether all
    containers together are filled to 98 % or there are fewer than 50 of them.
    """
    pieces = packed.groupBy(key).agg(F.sum("n_tokens").alias("got"), F.count(F.lit(1)).alias("pieces"), F.max(F.col("start_token") + F.col("n_tokens")).alias("reach"))
    whole = tokens.groupBy(key).agg(F.sum("n_tokens").alias("n"), F.count(F.lit(1)).alias("rows"))  # keys should be unique
    both = whole.join(pieces, key, "left")
    docs = both.agg(
        F.count(F.lit(1)).alias("n_documents"), F.count_if(F.col("got").isNull() | (F.col("got") < F.col("n")) | ((F.col("rows") == 1) & (F.col("reach") < F.col("n")))).alias("n_lost"),
        F.count_if(F.col("got") > F.col("n")).alias("n_doubled"), F.count_if((F.col("rows") == 1) & (F.col("n") <= cap) & (F.col("pieces") > 1)).alias("n_split"),
    )
    filled = packed.filter(F.col("container_id").isNotNull()).groupBy("container_id", "container_size").agg(F.sum("n_tokens").alias("load"))
    bins = filled.agg(F.count_if(F.col("load") > F.col("container_size")).alias("n_over"), F.coalesce((F.sum("load") >= F.sum("container_size") * 0.98) | (F.count(F.lit(1)) < 50), F.lit(True)).alias("well_filled"))
    return docs.crossJoin(bins)  # one row each


def size_report(packed: DataFrame) -> DataFrame:
    """``container_size, n_containers, n_tokens, unused_share`` of each size in use."""
    filled = packed.filter(F.col("container_id").isNotNull()).groupBy("container_id", "container_size").agg(F.sum("n_tokens").alias("load"))
    out = filled.groupBy("container_size").agg(F.count(F.lit(1)).alias("n_containers"), F.sum("load").alias("n_tokens"))
    return out.withColumn("unused_share", 1 - F.col("n_tokens") / (F.col("n_containers") * F.col("container_size")))
