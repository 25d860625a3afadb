"""Held-out texts that occur, fully or partly, in a corpus.

The unit is a passage: a window of successive words of a held-out item.  With
an error budget of e word edits a window is cut into e + 1 pieces; whatever
matches it within the budget holds one of the pieces unchanged.  Items shorter
than a window are looked for whole and word for word.

The hashes of all pieces are a table; a Bloom filter of them, whose size has a
bound, goes to the scan of the corpus.  The scan cuts a document down to the
stretches around its possible pieces, the pieces are joined by hash, and the
pairs of a stretch and an item that share one are verified with Myers'
bit-parallel edit distance over words.  Neither texts nor items pass through the
driver, and one scan of the corpus serves any number of items.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgate.operators.keyed import salted_join
from loomgate.session import discard, durable

WORD = re.compile(r"[^\W_]+")
#: Bits of the Bloom filter for each piece, and at most. A fuller filter lets more pieces through to the join; the result is the same.
BITS_A_PIECE = 32
MOST_BITS = 1 << 29
#: Words whose hashes a scan keeps.
KEPT_WORDS = 500_000
#: Items and stretches that a verifying task keeps prepared.
KEPT_ITEMS = 1_000
KEPT_RUNS = 4_000
_BASE = np.uint64(0x9E3779B97F4A7C15)


def myers_best(masks: dict[int, int], m: int, text: list[int]) -> int:
    """Least edit distance between a pattern of m words and any stretch of ``text``.

    ``masks[w]`` has bit i set where word i of the pattern is w.
    """
    full = (1 << m) - 1
    top = 1 << (m - 1)
    pv, mv, score, best = full, 0, m, m
    for w in text:
        eq = masks.get(w, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | ~(xh | pv) & full
        mh = pv & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
        ph = ph << 1 & full
        mh = mh << 1 & full
        pv = mh | ~(xv | ph) & full
        mv = ph & xv
        if score < best:
            best = score
    return best


def rolling(ids: np.ndarray, k: int) -> np.ndarray:
    """Hash of each k successive numbers."""
    n = len(ids) - k + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    x = ids.astype(np.uint64) + np.uint64(1)
    h = np.zeros(n, dtype=np.uint64)
    for i in range(k):
        h = h * _BASE + x[i : i + n]
        h ^= h >> np.uint64(29)
    return h


class _Hashes(dict):
    """64-bit hash of each word, remembered."""

    def __missing__(self, word: str) -> int:
        if len(self) > KEPT_WORDS:
            self.clear()
        got = self[word] = xxhash.xxh64_intdigest(word.encode())
        return got

    def of(self, words: list[str]) -> np.ndarray:
        return np.array(list(map(self.__getitem__, words)), dtype=np.uint64)


def rolling(ids: np.ndarray, k: int) -> np.ndarray:
    """Hash of each k successive numbers; other k, other hashes."""
    n = len(ids) - k + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    h = np.full(n, k, dtype=np.uint64)
    for i in range(k):
        h = h * _BASE + ids[i : i + n]
        h ^= h >> np.uint64(29)
    return h


def _probe(h: np.ndarray) -> np.ndarray:
    """The four bits that a hash has in its word of the filter."""
    one = np.uint64(1)
    bits = one << (h & np.uint64(63))
    for s in (6, 12, 18):
        bits |= one << ((h >> np.uint64(s)) & np.uint64(63))
    return bits


def _place(h: np.ndarray, words: int) -> np.ndarray:
    return (h >> np.uint64(64 - words.bit_length() + 1)) if words > 1 else np.zeros(len(h), dtype=np.uint64)


def bloom_filter(hashes: DataFrame, column: str = "h") -> np.ndarray:
    """Words of a blocked Bloom filter of a column of 64-bit hashes; a power of two of them, at most MOST_BITS / 64."""
    n = hashes.count()
    words = 1 << min(max(n * BITS_A_PIECE // 64, 1).bit_length(), (MOST_BITS // 64).bit_length() - 1)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            h = pdf[column].to_numpy().astype(np.uint64)
            yield pd.DataFrame({"at": _place(h, words).astype(np.int64), "bits": _probe(h).astype(np.int64)})

    rows = hashes.select(column).mapInPandas(run, "at bigint, bits bigint").groupBy("at").agg(F.bit_or("bits").alias("bits")).toPandas()
    out = np.zeros(words, dtype=np.uint64)
    out[rows["at"].to_numpy()] = rows["bits"].to_numpy().astype(np.uint64)
    return out


def in_filter(words: np.ndarray, h: np.ndarray) -> np.ndarray:
    bits = _probe(h)
    return (words[_place(h, len(words))] & bits) == bits


def stretches(hits: list[int], before: int, after: int, n: int) -> list[tuple[int, int]]:
    """(first, end) of the stretches of n words that hold every hit with ``before`` words before and ``after`` words from it on."""
    out: list[list[int]] = []
    for p in sorted(hits):
        lo, hi = max(0, p - before), min(n, p + after)
        if out and lo <= out[-1][1]:
            out[-1][1] = max(out[-1][1], hi)
        else:
            out.append([lo, hi])
    return [(a, b) for a, b in out]


class Stretch:
    """A stretch of a document, with the places of its pieces."""

    def __init__(self, words: list[str], piece: int) -> None:
        self.words = words
        self.places: dict[tuple, list[int]] = {}
        for p in range(len(words) - piece + 1):
            self.places.setdefault(tuple(words[p : p + piece]), []).append(p)


class Item:
    """A held-out item prepared for verification."""

    def __init__(self, words: list[str], window: int, errors: int) -> None:
        self.words, self.window, self.errors = words, window, errors
        self.piece = window // (errors + 1)
        self.number = {w: i for i, w in enumerate(dict.fromkeys(words))}
        self.offsets: dict[tuple, list[int]] = {}
        for o in range(len(words) - self.piece + 1):
            self.offsets.setdefault(tuple(words[o : o + self.piece]), []).append(o)
        self.windows = {tuple(words[o : o + window]) for o in range(len(words) - window + 1)}
        self._masks: dict[int, dict[int, int]] = {}

    def masks(self, start: int) -> dict[int, int]:
        got = self._masks.get(start)
        if got is None:
            got = self._masks[start] = {}
            for i, w in enumerate(self.words[start : start + self.window]):
                got[self.number[w]] = got.get(self.number[w], 0) | 1 << i
        return got

    def least_edits(self, stretch: Stretch) -> int:
        """Least edits, up to errors + 1, of any window against any part of a stretch; short items count whole."""
        n, window, piece, worst, words = len(self.words), self.window, self.piece, self.errors + 1, stretch.words
        if n < window:
            return 0 if any(words[i : i + n] == self.words for i in range(len(words) - n + 1)) else worst
        shared = self.offsets.keys() & stretch.places.keys()
        hits = [(p, self.offsets[x]) for x in shared for p in stretch.places[x]]
        if any(tuple(words[p : p + window]) in self.windows for p, _ in hits):
            return 0
        best, ids, tried = worst, [self.number.get(w, -1) for w in words] if hits else [], set()
        for p, at in hits:
            for o in at:
                for j in range(self.errors + 1):
                    start, lo = o - j * piece, max(0, p - j * piece - self.errors)
                    if 0 <= start <= n - window and (start, lo) not in tried:
                        tried.add((start, lo))
                        best = min(best, myers_best(self.masks(start), window, ids[lo : p - j * piece + window + self.errors]))
                        if best <= 1:  # no window is there unchanged
                            return best
        return best


def leaked_items(documents: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "item_text", window: int = 12, errors: int = 1) -> DataFrame:
    """``<key>, <item_key>, edits, n_words``: items of which a window occurs in a document.

    ``edits`` is the least number of word edits of any window of ``window``
    words of the item against any stretch of the document, at most ``errors``;
    0 means that ``window`` or more successive words are the same.  An item of
    fewer words than a window is found where all its words stand in a row, with
    0 edits; ``n_words`` is its number of words, else ``window``.  Null and
    empty texts hold nothing, null and empty items are in nothing; repeated
    keys are scanned each for itself and reported once with their least edits.
    """
    piece = window // (errors + 1)
    if window > 62 or piece < 1:
        raise ValueError("a window has at most 62 words and at least one a piece")
    spark = documents.sparkSession
    kind, item_kind = dict(documents.dtypes)[key], dict(items.dtypes)[item_key]

    def pieces_of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes = _Hashes()
        for pdf in batches:
            out = []
            for no, t in zip(pdf["no"], pdf["text"]):
                ids = hashes.of(WORD.findall(t.lower()))
                k = piece if len(ids) >= piece else len(ids)
                h = rolling(ids, k)[: None if len(ids) >= window else 1] if k else ()
                out += [(no, k, int(x)) for x in np.unique(np.asarray(h, dtype=np.uint64)).astype(np.int64)]
            yield pd.DataFrame(out, columns=["no", "k", "h"])

    # an item row is told by its number, so repeated keys stay apart
    held = durable(items.select(F.col(item_key).alias("item"), F.col(item_text).alias("text")).filter(F.length(item_text) > 0).distinct().withColumn("no", F.monotonically_increasing_id()), "items")
    pieces = durable(held.select("no", "text").mapInPandas(pieces_of, "no bigint, k int, h bigint"), "pieces")
    lengths = sorted(r[0] for r in pieces.select("k").distinct().collect())  # 1 .. piece
    shared = spark.sparkContext.broadcast((bloom_filter(pieces), lengths))

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        filter_, ks = shared.value
        hashes = _Hashes()
        for pdf in batches:
            out = []
            for doc, t in zip(pdf["doc"], pdf["text"]):
                words = WORD.findall(t.lower())
                ids = hashes.of(words)
                hits = []
                for k in ks:
                    h = rolling(ids, k)
                    at = np.nonzero(in_filter(filter_, h))[0]
                    hits += zip(at.tolist(), h[at].astype(np.int64).tolist())
                if not hits:
                    continue
                cuts = stretches([p for p, _ in hits], window - piece + errors, window + errors, len(words))
                firsts = np.array([a for a, _ in cuts])
                groups: list[set[int]] = [set() for _ in cuts]
                for p, h in hits:
                    groups[int(np.searchsorted(firsts, p, side="right")) - 1].add(h)
                out += [(doc, " ".join(words[a:b]), list(g)) for (a, b), g in zip(cuts, groups)]
            yield pd.DataFrame(out, columns=["doc", "words", "hs"])

    corpus = documents.select(F.col(key).alias("doc"), F.col(text).alias("text")).filter(F.length("text") > 0)
    found = durable(corpus.mapInPandas(scan, f"doc {kind}, words string, hs array<bigint>").withColumn("run", F.monotonically_increasing_id()), "stretches")
    probes = durable(found.select("run", F.explode("hs").alias("h")), "probes")
    pairs = durable(salted_join(probes, pieces.select("h", "no"), ["h"]).select("run", "no").distinct(), "pairs")
    discard(probes)
    discard(pieces)
    both = salted_join(pairs, found.select("run", "doc", "words"), ["run"])
    both = salted_join(both, held, ["no"])

    def verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ready: dict[int, Item] = {}
        runs: dict[int, Stretch] = {}
        for pdf in batches:
            out = []
            for doc, run, words, no, item, t in zip(pdf["doc"], pdf["run"], pdf["words"], pdf["no"], pdf["item"], pdf["text"]):
                it = ready.get(no)
                if it is None:
                    if len(ready) > KEPT_ITEMS:
                        ready.clear()
                    it = ready[no] = Item(WORD.findall(t.lower()), window, errors)
                stretch = runs.get(run)
                if stretch is None:
                    if len(runs) > KEPT_RUNS:
                        runs.clear()
                    stretch = runs[run] = Stretch(words.split(" "), piece)
                d = it.least_edits(stretch)
                if d <= errors:
                    out.append((doc, item, d, min(len(it.words), window)))
            yield pd.DataFrame(out, columns=[key, item_key, "edits", "n_words"])

    out = both.select("doc", "run", "words", "no", "item", "text").mapInPandas(verify, f"`{key}` {kind}, `{item_key}` {item_kind}, edits int, n_words int")
    return out.groupBy(key, item_key).agg(F.min("edits").alias("edits"), F.max("n_words").alias("n_words"))
