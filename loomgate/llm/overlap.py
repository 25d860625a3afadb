"""Records that occur, exactly or almost, on both sides of a split.

A record is the multiset of its words.  Two records overlap when the words of
the longer one that lack a counterpart are at most one in ``1 / difference``.
Exact copies are folded into classes first.  The words of a class are ordered
from rare to common; only a short prefix can be free of shared words, so the
evaluation prefixes are indexed and probed with the training prefixes (equal
prefix word and length band, then length filter, position filter and a 128-bit
bound on the overlap); a word that many records share is dealt over tasks.
What is left is verified exactly.  Links are between classes; copies are
members of classes and are not expanded inside the join.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgate.functions.text import words
from loomgate.operators.keyed import lookup_join, salted_join
from loomgate.session import durable

#: Buckets of the word-frequency table: 65,536 counts, whatever the vocabulary.
FREQ_BITS = 16
#: A prefix word of one length band with more training rows than this is dealt over several tasks.
HOT_WORD_ROWS = 20_000


def word_classes(df: DataFrame, key: str, text: list[str]) -> tuple[DataFrame, DataFrame]:
    """(members: key, class; classes: class, words) of the word multisets of ``text``.

    Re-delivered rows (same key) belong to the class of their texts once.
    """
    sorted_words = F.array_sort(words(F.concat_ws(" ", *[F.coalesce(F.col(t), F.lit("")) for t in text])))
    joined = df.select(F.col(key), F.concat_ws(" ", sorted_words).alias("words")).withColumn("class", F.unhex(F.md5("words")))
    classes = joined.groupBy("class").agg(F.first("words").alias("words"))
    return joined.select(key, "class").distinct(), classes


def _frequencies(classes: DataFrame) -> np.ndarray:
    bucket = F.xxhash64("w").bitwiseAND(F.lit((1 << FREQ_BITS) - 1))
    counted = classes.select(F.explode(F.split("words", " ")).alias("w")).groupBy(bucket.cast("int").alias("b")).count()
    out = np.zeros(1 << FREQ_BITS, dtype=np.int64)
    for b, n in counted.collect():  # at most 2 ** FREQ_BITS rows
        out[b] = n
    return out


def _prefixes(freq, num: int, den: int):
    mask = (1 << FREQ_BITS) - 1

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts = freq.value
        hashed: dict[str, int] = {}
        for pdf in batches:
            out = []
            for cls, text, in_eval, in_train in zip(pdf["class"], pdf["words"], pdf["in_eval"], pdf["in_train"]):
                ws = text.split(" ") if text else []
                n = len(ws)
                order, last, k, sig = [], None, 0, 0
                for w in ws:
                    k = k + 1 if w == last else 0
                    last = w
                    h = hashed.get(w)
                    if h is None:
                        if len(hashed) > 200_000:
                            hashed.clear()
                        h = hashed[w] = xxhash.xxh64_intdigest(w.encode(), seed=42)
                    e = h if k == 0 else xxhash.xxh64_intdigest(h.to_bytes(8, "little"), seed=k)
                    sig ^= 1 << (e & 127)
                    order.append((int(counts[h & mask]), e))
                order.sort()
                keep = n - -(-n * num // den) + 1
                lo, hi = sig & 0xFFFFFFFFFFFFFFFF, sig >> 64
                for i, (_, e) in enumerate(order[:keep]):
                    out.append((e - (1 << 63), cls, n, i, lo - (1 << 63), hi - (1 << 63), in_eval, in_train))
            yield pd.DataFrame(out, columns=["e", "class", "n", "i", "s0", "s1", "in_eval", "in_train"])

    return run


def split_overlaps(members: DataFrame, classes: DataFrame, difference: tuple[int, int] = (1, 8)) -> DataFrame:
    """Links ``eval_class, train_class, n_common, n_longer`` between word classes.

    ``members``: key, class, ``in_eval``, ``in_train``.  A class with members
    on both sides is linked to itself.  ``difference`` is the largest share of
    the longer record's words without counterpart, as a fraction.  Records
    without words are only linked to each other.
    """
    spark = members.sparkSession
    num, den = difference[1] - difference[0], difference[1]
    sides = members.groupBy("class").agg(F.max("in_eval").alias("in_eval"), F.max("in_train").alias("in_train"))
    sided = durable(classes.join(sides, "class"), "classes")
    freq = spark.sparkContext.broadcast(_frequencies(sided))
    schema = "e bigint, class binary, n int, i int, s0 bigint, s1 bigint, in_eval boolean, in_train boolean"
    prefixes = durable(sided.select("class", "words", "in_eval", "in_train").mapInPandas(_prefixes(freq, num, den), schema), "prefixes")
    # lengths that differ by more than the allowed share lie in other bands; a probe looks into the two or three it can match
    band = lambda n: F.floor(F.log(n.cast("double")) / math.log(den / num) + 1e-9).cast("int")
    y = prefixes.filter("in_train").select("e", band(F.col("n")).alias("band"), *[F.col(c).alias("y_" + c) for c in ("class", "n", "i", "s0", "s1")])
    own = F.explode(F.sequence(band(F.ceil(F.col("n") * num / den)), band(F.floor(F.col("n") * den / num)))).alias("band")
    x = prefixes.filter("in_eval").select("e", own, *[F.col(c).alias("x_" + c) for c in ("class", "n", "i", "s0", "s1")])
    longer = F.greatest("x_n", "y_n")
    need = F.ceil(longer * num / den)
    at_position = F.least("x_i", "y_i") + F.least(F.col("x_n") - F.col("x_i"), F.col("y_n") - F.col("y_i"))
    differ = F.bit_count(F.col("x_s0").bitwiseXOR(F.col("y_s0"))) + F.bit_count(F.col("x_s1").bitwiseXOR(F.col("y_s1")))
    candidates = (
        salted_join(y, x, ["e", "band"], rows=HOT_WORD_ROWS)
        .filter((F.col("x_class") != F.col("y_class")) & (F.least("x_n", "y_n") >= need) & (at_position >= need))
        .filter(F.col("x_n") + F.col("y_n") - differ >= 2 * need)
        .select("x_class", "y_class")
        .distinct()
    )
    candidates = durable(candidates, "candidates")
    texts = sided.select("class", "words")
    both = lookup_join(candidates, texts.select(F.col("class").alias("x_class"), F.col("words").alias("xw")), "x_class")
    both = lookup_join(both, texts.select(F.col("class").alias("y_class"), F.col("words").alias("yw")), "y_class")

    def common(xs: pd.Series, ys: pd.Series) -> pd.Series:
        from collections import Counter

        return pd.Series([sum((Counter(a.split(" ")) & Counter(b.split(" "))).values()) for a, b in zip(xs, ys)], dtype="int64")

    counted = both.select(
        "x_class", "y_class", F.pandas_udf(common, "bigint")("xw", "yw").alias("n_common"), F.greatest(F.size(F.split("xw", " ")), F.size(F.split("yw", " "))).cast("bigint").alias("n_longer")
    )
    near = counted.filter(F.col("n_common") * den >= F.col("n_longer") * num).select(F.col("x_class").alias("eval_class"), F.col("y_class").alias("train_class"), "n_common", "n_longer")
    n = F.when(F.col("words") == "", 0).otherwise(F.size(F.split("words", " "))).cast("bigint")
    same = sided.filter(F.col("in_eval") & F.col("in_train")).select(F.col("class").alias("eval_class"), F.col("class").alias("train_class"), n.alias("n_common"), n.alias("n_longer"))
    return near.unionByName(same)


def split_members(manifest: DataFrame, records: DataFrame, train: str = "calibration", evaluation: str = "evaluation") -> tuple[DataFrame, DataFrame]:
    """Members and classes of all actions that have a split and a record.

    Nulls: actions without a split are left out, null texts count as empty.
    Extra columns of either table are ignored.
    """
    split = manifest.filter(F.col("split").isin(train, evaluation)).select("event_id", (F.col("split") == evaluation).alias("in_eval"), (F.col("split") == train).alias("in_train")).distinct()
    keyed, classes = word_classes(records, "event_id", ["user_intent", "tool_arguments"])
    return durable(keyed.join(split, "event_id"), "members"), classes


def linked_members(members: DataFrame, links: DataFrame) -> DataFrame:
    """``event_id, in_eval, class, n_links``: each action with its class and the number of classes of the other split it overlaps with.

    The result whose size does not depend on the copies: pairs are the links of
    a class times its members.
    """
    kept = durable(links.select("eval_class", "train_class"), "links")
    by_eval = kept.groupBy(F.col("eval_class").alias("class")).agg(F.count(F.lit(1)).alias("n")).select(F.lit(True).alias("in_eval"), "class", "n")
    by_train = kept.groupBy(F.col("train_class").alias("class")).agg(F.count(F.lit(1)).alias("n")).select(F.lit(False).alias("in_eval"), "class", "n")
    out = salted_join(members.select("event_id", "in_eval", "class"), by_eval.unionByName(by_train), ["in_eval", "class"], "left")
    return out.select("event_id", "in_eval", F.lower(F.hex("class")).alias("class"), F.coalesce("n", F.lit(0).cast("bigint")).alias("n_links"))


def overlap_pairs(members: DataFrame, links: DataFrame) -> DataFrame:
    """Links expanded to pairs of actions, the smaller id first; a class with many members is dealt over tasks."""
    by_eval = members.filter("in_eval").select(F.col("class").alias("eval_class"), F.col("event_id").alias("a"))
    by_train = members.filter("in_train").select(F.col("class").alias("train_class"), F.col("event_id").alias("b"))
    pairs = salted_join(by_train, salted_join(by_eval, links.select("eval_class", "train_class"), ["eval_class"]), ["train_class"])
    return pairs.select(F.least("a", "b").alias("event_id_a"), F.greatest("a", "b").alias("event_id_b")).distinct()
