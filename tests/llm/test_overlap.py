"""Overlaps against all pairs on a small table."""

import random
import re
from collections import Counter

import pytest

from loomgate.llm import overlap
from loomgate.llm.overlap import overlap_pairs, split_members, split_overlaps

MANIFEST = "event_id string, split string, class string"
RECORDS = "event_id string, user_intent string, tool_arguments string, words string, ingested_at timestamp"


def run(spark, manifest, records):
    m, c = split_members(spark.createDataFrame(manifest, MANIFEST), spark.createDataFrame(records, RECORDS))
    return {tuple(r) for r in overlap_pairs(m, split_overlaps(m, c)).collect()}


def brute(manifest, records):
    words = lambda t: Counter(re.findall(r"[^\W_]+", t.lower()))
    text = {r[0]: words(f"{r[1] or ''} {r[2] or ''}") for r in records}
    split = {e: s for e, s, _ in manifest if s}
    out = set()
    for a in split:
        for b in split:
            if split[a] == "evaluation" and split[b] == "calibration" and a in text and b in text:
                x, y = text[a], text[b]
                longer = max(sum(x.values()), sum(y.values()))
                if 8 * (longer - sum((x & y).values())) <= longer:
                    out.add((min(a, b), max(a, b)))
    return out


@pytest.mark.parametrize("hot", [20_000, 5])
def test_same_as_all_pairs(spark, monkeypatch, hot):
    """Also where most prefix words are hot."""
    monkeypatch.setattr(overlap, "HOT_WORD_ROWS", hot)
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(40)] + ["rare%d" % i for i in range(400)]
    manifest, records, bases = [], [], []
    for i in range(240):
        if bases and rng.random() < 0.6:
            ws = list(rng.choice(bases))
            for _ in range(rng.choice([0, 1, 2, 3, 4, 6])):
                k = rng.randrange(3)
                if k == 0 and len(ws) > 1:
                    ws.pop(rng.randrange(len(ws)))
                elif k == 1:
                    ws.insert(rng.randrange(len(ws) + 1), rng.choice(vocabulary))
                elif ws:
                    ws[rng.randrange(len(ws))] = rng.choice(vocabulary)
            rng.shuffle(ws)
        else:
            ws = [rng.choice(vocabulary) for _ in range(rng.choice([1, 2, 7, 8, 9, 16, 40]))]
            bases.append(ws)
        cut = rng.randrange(len(ws) + 1)
        manifest.append((f"e{i}", rng.choice(["evaluation", "calibration", "calibration", None]), None))
        records.append((f"e{i}", " ".join(ws[:cut]).upper(), ", ".join(ws[cut:]) or None, "clash", None))
    records += records[:30]
    records.append(("nobody", "x", "y", None, None))
    got = run(spark, manifest, records)
    assert got == brute(manifest, records) and len(got) > 20


def test_hot_class_and_odd_texts(spark):
    """A third of the rows share one text; empty and very long texts; repeated words."""
    manifest = [(f"e{i}", "evaluation" if i % 2 else "calibration", None) for i in range(60)]
    records = [(f"e{i}", "same words here again again" if i < 20 else "" if i < 24 else f"long {i // 2} " * 4000 if i < 28 else f"only {i}", None, None, None) for i in range(60)]
    assert run(spark, manifest, records) == brute(manifest, records) | {(min(f"e{i}", f"e{j}"), max(f"e{i}", f"e{j}")) for i in (21, 23) for j in (20, 22)}


def test_empty_tables(spark):
    assert run(spark, [], []) == set()
