"""Records that differ in layout only, collapsed and counted.

Each record becomes canonical bytes: letters and digits in lower case, blocks,
``name=value`` lines and JSON fields sorted, arrays as they are.  The bytes are
partitioned by radix: a bucket with too many keys is split by the byte after
the longest prefix its keys share, again and again, until every bucket fits;
small neighbours are joined.  A bucket then fits one task, where a trie with a
counter at each end collapses its keys.

Before that, equal keys are collapsed inside each input partition, so a group
that owns a third of all rows sends one key a partition.  The way back to the
rows goes through those partial groups, of which each is smaller than a
partition: no task ever gets a whole group.  Where the buckets that the driver
can name are still too large, tasks go on splitting them in byte order, so a
trie never holds more than its share of keys.
"""

from __future__ import annotations

import json
import re
from bisect import bisect_right
from collections.abc import Iterator
from functools import reduce
from operator import or_

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgate.session import discard, durable

_JUNK = re.compile(r"[\W_]+")
_BLOCK = re.compile(r"<(\w+)>(.*?)</\1>", re.S)
_PAIR = re.compile(r"^[ \t]*(\w[\w \t-]*?)[ \t]*=", re.M)
#: Keys of a partition held at a time, in bytes; beyond, partial groups are closed early.
PARTIAL_BYTES = 32 << 20


def _plain(text: str) -> str:
    return _JUNK.sub("", text)


def _value(v) -> str:
    if isinstance(v, str):
        return _JUNK.sub("", v)
    if isinstance(v, _Fields):
        return "{" + ",".join(sorted([f"{_JUNK.sub('', k)}:{_value(x)}" for k, x in v])) + "}"
    if isinstance(v, list):
        return "[" + ",".join([_value(x) for x in v]) + "]"
    return {True: "true", False: "false", None: "null"}[v]


class _Fields(list):
    """Fields of a JSON object, repeated names included."""


_DECODE = json.JSONDecoder(object_pairs_hook=_Fields, parse_int=str, parse_float=str, parse_constant=str, strict=False).decode


def canonical_json(text: str) -> str:
    """Canonical form of lower-case JSON text; text that is no JSON counts as plain text."""
    head = text.lstrip()[:1]
    if head and head in "{[":
        try:
            return _value(_DECODE(text))
        except (ValueError, RecursionError):
            pass
    return _plain(text)


def canonical_block(body: str) -> str:
    """A block of ``name=value`` lines with the lines sorted, or the block's letters and digits."""
    first = _PAIR.match(body.lstrip("\r\n \t"))
    if not first:
        return _plain(body)
    marks = list(_PAIR.finditer(body))
    lines = []
    for m, after in zip(marks, [*marks[1:], None]):
        value = body[m.end() : after.start() if after else len(body)]
        lines.append(f"{_plain(m.group(1))}={canonical_json(value)}")
    return "(" + ";".join(sorted(lines)) + ")"


def canonical(prompt: str | None, arguments: str | None) -> bytes:
    """Canonical bytes of a record; the parts that tell records apart come first.

    A missing text differs from an empty one.
    """
    args = "~" if arguments is None else canonical_json(arguments.lower())
    if prompt is None:
        return f"{args}|~".encode()
    low = prompt.lower()
    blocks, loose, at = [], [], 0
    for m in _BLOCK.finditer(low):
        loose.append(low[at : m.start()])
        at = m.end()
        blocks.append((m.group(1), canonical_block(m.group(2))))
    loose.append(low[at:])
    # long fixed blocks last: sorting by name backwards puts <policy> behind <user_intent> and <state_summary>
    parts = [f"{_plain(name)}<{body}>" for name, body in sorted(blocks, reverse=True)]
    return f"{args}|{'|'.join(parts)}|{_plain(' '.join(loose))}".encode()


def _partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Partial groups of one partition: rows (gid, id) and, once a group, (gid, bytes, smallest id)."""
    from pyspark import TaskContext

    base, made = TaskContext.get().partitionId() << 32, 0
    groups: dict[bytes, list] = {}
    held = 0

    def closed():
        return pd.DataFrame({"gid": [g[0] for g in groups.values()], "id": None, "canon": list(groups), "least": [g[1] for g in groups.values()]})

    for pdf in batches:
        gids = []
        for key, prompt, args in zip(pdf["id"], pdf["prompt"], pdf["args"]):
            c = canonical(prompt, args)
            g = groups.get(c)
            if g is None:
                g = groups[c] = [base + made, key]
                made += 1
                held += len(c)
            elif key < g[1]:
                g[1] = key
            gids.append(g[0])
        yield pd.DataFrame({"gid": gids, "id": pdf["id"], "canon": None, "least": None})
        if held > PARTIAL_BYTES:
            yield closed()
            groups.clear()
            held = 0
    if groups:
        yield closed()


def _shared(a: bytes, b: bytes) -> int:
    n = min(len(a), len(b))
    for i in range(n):
        if a[i] != b[i]:
            return i
    return n


def radix_bounds(keys: DataFrame, column: str = "canon", fit: int = 16_000, most: int = 1 << 15) -> list[bytes]:
    """Lower bounds of buckets of at most about ``fit`` keys, in byte order.

    Every round counts the keys of the oversized buckets by the byte after
    their shared prefix, with smallest and largest key; equal keys can't be
    split and end their bucket.  Only keys between the smallest and the largest
    of an oversized bucket are read again.  The driver holds at most about
    ``most`` bounds; where that is too coarse for ``fit``, the splitting goes on
    inside the tasks (``_tries``), by the order of the remaining bytes.
    """

    def level(open_: list[tuple[bytes, int]], ends: list[tuple[bytes, bytes]]):
        starts = [p for p, _ in open_]

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            seen: dict[tuple[int, int], list] = {}
            for pdf in batches:
                for c in pdf[column]:
                    c = bytes(c)
                    i = bisect_right(starts, c) - 1
                    if i < 0 or not c.startswith(starts[i]):
                        continue
                    d = len(starts[i])
                    k = (i, c[d] if len(c) > d else -1)
                    s = seen.get(k)
                    if s is None:
                        seen[k] = [1, c, c]
                    else:
                        s[0] += 1
                        if c < s[1]:
                            s[1] = c
                        elif c > s[2]:
                            s[2] = c
            yield pd.DataFrame([(i, b, n, lo, hi) for (i, b), (n, lo, hi) in seen.items()], columns=["i", "b", "n", "lo", "hi"])

        # neighbouring ranges become one until there are few enough for a filter; whatever else it lets through is left out above
        ranges = sorted(ends)
        while len(ranges) > 64:
            ranges = [(a[0], b[1]) for a, b in zip(ranges[::2], ranges[1::2])] + ranges[len(ranges) // 2 * 2 :]
        between = [F.col(column).between(F.lit(bytearray(lo)), F.lit(bytearray(hi))) for lo, hi in ranges]
        counted = keys.select(column).filter(reduce(or_, between)).mapInPandas(run, "i int, b int, n bigint, lo binary, hi binary")
        return counted.groupBy("i", "b").agg(F.sum("n").alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi")).collect()

    whole = keys.agg(F.count(F.lit(1)).alias("n"), F.min(column).alias("lo"), F.max(column).alias("hi")).first()
    if not whole["n"]:
        return []
    fit = max(fit, whole["n"] // most + 1)
    lo, hi = bytes(whole["lo"]), bytes(whole["hi"])
    done: list[tuple[bytes, int]] = []
    open_, ends = ([(lo[: _shared(lo, hi)], whole["n"])] if whole["n"] > fit and lo != hi else []), [(lo, hi)]
    if not open_:
        return [b""]
    while open_:
        rows = level(open_, ends)
        nxt, ends = [], []
        for r in rows:
            lo, hi = bytes(r["lo"]), bytes(r["hi"])
            if r["n"] > fit and lo != hi:
                nxt.append((lo[: _shared(lo, hi)], r["n"]))
                ends.append((lo, hi))
            else:
                done.append((lo, r["n"]))
        open_ = sorted(nxt)
    bounds, size = [b""], 0
    for lo, n in sorted(done):
        if size and size + n > fit:
            bounds.append(lo)
            size = 0
        size += n
    return bounds


class Trie:
    """Trie over byte strings in pieces; a leaf keeps the rest of its only key."""

    PIECE = 24

    def __init__(self) -> None:
        self.root: dict = {}

    def add(self, key: bytes, least: str, gid: int) -> None:
        node, at, p = self.root, 0, self.PIECE
        while True:
            piece = key[at : at + p]
            got = node.get(piece)
            if got is None:
                node[piece] = [key[at + p :], least, [gid]]
                return
            if isinstance(got, dict):
                node, at = got, at + p
                continue
            rest = key[at + p :]
            if got[0] == rest:  # the terminal counter of this key
                if least < got[1]:
                    got[1] = least
                got[2].append(gid)
                return
            deeper = {got[0][:p]: [got[0][p:], got[1], got[2]]}
            node[piece] = deeper
            node, at = deeper, at + p

    def ends(self):
        stack = [self.root]
        while stack:
            for got in stack.pop().values():
                if isinstance(got, dict):
                    stack.append(got)
                else:
                    yield got


def _tries(fit: int | None):
    """Partial groups -> smallest id of the whole group.

    With ``fit`` the rows come in the order of bucket and bytes, and a bucket of
    more keys is split at the next other key whenever its trie holds ``fit``.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tries: dict[int, Trie] = {}
        held, last = 0, None

        def drained() -> pd.DataFrame:
            out = [(gid, end[1]) for trie in tries.values() for end in trie.ends() for gid in end[2]]
            tries.clear()
            return pd.DataFrame(out, columns=["gid", "keep"])

        for pdf in batches:
            for bucket, canon, least, gid in zip(pdf["bucket"], pdf["canon"], pdf["least"], pdf["gid"]):
                key = bytes(canon)
                if fit is not None and held >= fit and (bucket, key) != last:
                    yield drained()
                    held = 0
                tries.setdefault(bucket, Trie()).add(key, least, gid)
                held, last = held + 1, (bucket, key)
        yield drained()

    return run


def layout_copies(df: DataFrame, key: str = "event_id", prompt: str = "rendered_prompt", arguments: str = "tool_arguments", fit: int = 16_000, most: int = 1 << 15) -> DataFrame:
    """``keep, member`` for every distinct ``key``: the smallest key of its set of equal records, as a table.

    A record without copies keeps itself.  Rows with a null key are left out;
    a key with several rows is a member of the set of each of them.  Null
    texts equal only null texts.  Other columns are ignored.
    """
    rows = df.filter(F.col(key).isNotNull()).select(F.col(key).cast("string").alias("id"), F.col(prompt).alias("prompt"), F.col(arguments).alias("args"))
    partial = durable(rows.mapInPandas(_partial, "gid bigint, id string, canon binary, least string"), "partial")
    entries = partial.filter(F.col("canon").isNotNull()).select("gid", "canon", "least")
    bounds = radix_bounds(entries, fit=fit, most=most)
    shared = df.sparkSession.sparkContext.broadcast(bounds)  # at most about 2 ** 16 keys

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pdf.assign(bucket=[bisect_right(shared.value, bytes(c)) - 1 for c in pdf["canon"]])

    tasks = max(len(bounds), int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    placed = entries.mapInPandas(place, "gid bigint, canon binary, least string, bucket int").repartition(tasks, "bucket")
    coarse = entries.count() // most + 1 > fit  # the bounds could not be made fine enough
    if coarse:
        placed = placed.sortWithinPartitions("bucket", "canon")
    kept = placed.mapInPandas(_tries(fit if coarse else None), "gid bigint, keep string")
    members = partial.filter(F.col("id").isNotNull()).select("gid", "id")
    out = durable(members.join(kept, "gid").select("keep", F.col("id").alias("member")).distinct(), "copies")
    discard(partial)
    return out
