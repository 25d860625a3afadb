"""Layout copies, leaks and personal identifiers on small fixtures."""

import json
import random

from loomgate.llm.collapse import Trie, canonical, layout_copies, radix_bounds
from loomgate.llm.leaks import Item, Stretch, bloom_filter, in_filter, leaked_items, myers_best, stretches
from loomgate.llm.pii import find_pii, keyword_automaton, redact, scan

RECORD = "event_id string, rendered_prompt string, tool_arguments string, gid string, canon string"


def prompt(intent, args, order=("policy", "user_intent", "proposed_action"), lines=("source=x", "tool_name=y")):
    body = {"policy": "Be kind.", "user_intent": intent, "proposed_action": "\n".join([*lines, f"tool_arguments={args}"])}
    return "Judge it.\n\n" + "".join(f"<{b}>\n{body[b]}\n</{b}>\n" for b in order)


def shuffled(value, rng):
    if isinstance(value, dict):
        items = list(value.items())
        rng.shuffle(items)
        return {k.replace("_", "-").upper(): shuffled(v, rng) for k, v in items}
    return [shuffled(v, rng) for v in value] if isinstance(value, list) else value


def test_canonical_form():
    args = {"a_b": 1.50, "c": {"d": [1, {"e": None, "f": True}]}, "g": "x, Y"}
    rng = random.Random(1)
    base = canonical(prompt("Do it now.", json.dumps(args)), json.dumps(args))
    for indent in (None, 3):
        other = json.dumps(shuffled(args, rng), indent=indent)
        p = prompt("do  it\r\nNOW", other, ("proposed_action", "user_intent", "policy"), ("tool-name = y.", "source=X"))
        assert canonical(p, other) == base
    assert canonical(prompt("Do it now.", json.dumps(args)), json.dumps({**args, "c": {"d": [{"e": None, "f": True}, 1]}})) != base
    assert canonical(prompt("Do it new.", json.dumps(args)), json.dumps(args)) != base
    assert canonical(None, None) != canonical("", "") and canonical("x", "{broken") == canonical("X!", "broken")
    assert canonical(prompt("a", '["ab"]'), "[]") != canonical(prompt("a", '["a", "b"]'), "[]")


def test_copies_with_a_hot_group(spark):
    rng = random.Random(2)
    rows = [(f"e{i:03d}", prompt("hot", "{}") if i % 3 == 0 else prompt(f"text {i % 50}", '{"k": %d}' % (i % 2)), "{}", "x", None) for i in range(300)]
    rows += [("n1", None, None, None, None), ("n2", None, None, None, None), (None, "x", "{}", None, None), ("z1", "", "", None, None), ("long", "w " * 50000, "{}", None, None), ("long2", "W\n" * 50000, "{ }", None, None)]
    rng.shuffle(rows)
    want = {}
    for e, p, a, _, _ in rows:
        if e:
            want.setdefault(canonical(p, a), set()).add(e)
    for fit, most in ((7, 1 << 15), (10_000, 1 << 15), (5, 3)):  # the last: more keys than the named buckets may hold
        got = {tuple(r) for r in layout_copies(spark.createDataFrame(rows + rows[:40], RECORD).repartition(5), fit=fit, most=most).collect()}
        assert got == {(min(g), e) for g in want.values() for e in g}
    assert layout_copies(spark.createDataFrame([], RECORD)).collect() == []


def test_radix_bounds_split_shared_prefixes(spark):
    keys = [b"same-long-prefix/" + bytes([65 + i % 26, 97 + i % 7]) + str(i).encode() for i in range(500)] + [b"one"] * 200
    bounds = radix_bounds(spark.createDataFrame([(bytearray(k),) for k in keys], "canon binary"), fit=60)
    from bisect import bisect_right
    from collections import Counter

    sizes = Counter(bisect_right(bounds, k) - 1 for k in keys if k != b"one")
    assert bounds == sorted(bounds) and max(sizes.values()) <= 120 and len(bounds) > 5


def test_trie():
    t = Trie()
    keys = [b"", b"a" * 100, b"a" * 100, b"a" * 99, b"a" * 124, b"b"]
    for i, k in enumerate(keys):
        t.add(k, f"e{9 - i}", i)
    assert sorted((e[1], sorted(e[2])) for e in t.ends()) == sorted([("e9", [0]), ("e7", [1, 2]), ("e6", [3]), ("e5", [4]), ("e4", [5])])


def edit(a, b):
    """Least distance of a to any stretch of b."""
    row = [0] * (len(b) + 1)
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return min(row)


def test_myers_is_edit_distance():
    rng = random.Random(3)
    for _ in range(300):
        a = [rng.randrange(5) for _ in range(12)]
        b = [rng.randrange(5) for _ in range(rng.randrange(20))]
        masks = {}
        for i, w in enumerate(a):
            masks[w] = masks.get(w, 0) | 1 << i
        assert myers_best(masks, 12, b) == edit(a, b)


def test_leaks_are_all_found(spark):
    rng = random.Random(4)
    word = lambda: f"w{rng.randrange(60)}"
    items = [(i, [word() for _ in range(rng.choice([2, 5, 12, 30]))]) for i in range(12)]
    docs = []
    for d in range(80):
        ws = [word() for _ in range(rng.randrange(60))]
        if d % 3 == 0:
            piece = list(rng.choice(items)[1])
            for _ in range(rng.randrange(3)):
                piece[rng.randrange(len(piece))] = word()
            k = rng.randrange(len(ws) + 1)
            ws[k:k] = piece[rng.randrange(4) :]
        docs.append((d, " ".join(w.upper() if rng.random() < 0.3 else w + "," for w in ws)))
    docs += [(900, None), (901, ""), (902, " ".join(["x"] * 20000))]
    got = {(r["doc_id"], r["item_id"]): r["edits"] for r in leaked_items(spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame([(i, " ".join(w)) for i, w in items] + [(99, None), (98, "")], "item_id bigint, item_text string")).collect()}
    want = {}
    for d, t in docs[:-3]:
        ws = [w.strip(",").lower() for w in t.split()]
        for i, item in items:
            whole = any(ws[s : s + len(item)] == item for s in range(len(ws)))
            best = min((edit(item[s : s + 12], ws) for s in range(len(item) - 11)), default=0 if whole else 99)
            if best <= 1:
                want[(d, i)] = best
    assert got == want and 0 in want.values() and 1 in want.values()


def test_least_edits_is_the_best_window():
    rng = random.Random(12)
    for _ in range(400):
        item, words = ([str(rng.randrange(4)) for _ in range(n)] for n in (rng.choice([12, 14, 20]), rng.randrange(40)))
        want = min(2, min(edit(item[s : s + 12], words) for s in range(len(item) - 11)))
        assert Item(item, 12, 1).least_edits(Stretch(words, 6)) == want
    assert Item(["a", "b"], 12, 1).least_edits(Stretch(["x", "a", "b"], 6)) == 0 and Item(["a", "b"], 12, 1).least_edits(Stretch(["a", "x", "b"], 6)) == 2


def test_short_items_and_shared_pieces(spark):
    """Items of fewer words than a window are found whole; a passage that many items and documents share is found in all."""
    same = "one two three four five six seven eight nine ten eleven twelve"
    items = [(i, f"{same} tail{i}") for i in range(30)] + [(40, "Short one!"), (41, "a b c d e f g h"), (42, "w"), (42, "also w")]
    docs = [(i, f"start{i} {same}. end") for i in range(30)] + [(50, "a SHORT, one."), (51, "short a one"), (52, "x a b c d e f g h"), (53, "a b c d e f g x h"), (54, "w")]
    schema = "item_id bigint, item_text string", "doc_id bigint, text string"
    got = {tuple(r) for r in leaked_items(spark.createDataFrame(docs, schema[1]), spark.createDataFrame(items, schema[0])).collect()}
    assert {r for r in got if r[0] < 30} == {(d, i, 0, 12) for d in range(30) for i in range(30)}
    assert {r for r in got if r[0] >= 30} == {(50, 40, 0, 2), (52, 41, 0, 8), (54, 42, 0, 1)}
    none = spark.createDataFrame([], schema[0])
    assert leaked_items(spark.createDataFrame(docs, schema[1]), none).collect() == []
    assert leaked_items(spark.createDataFrame([], schema[1]), spark.createDataFrame(items, schema[0])).collect() == []


def test_filter_has_no_false_negatives(spark):
    import numpy as np

    h = [hash(str(i)) for i in range(5000)]
    words = bloom_filter(spark.createDataFrame([(x,) for x in h], "h bigint"))
    assert in_filter(words, np.array(h, dtype=np.int64).astype(np.uint64)).all()
    other = np.random.default_rng(1).integers(0, 1 << 63, 20000, dtype=np.int64).astype(np.uint64)
    assert in_filter(words, other).mean() < 0.01
    assert stretches([5, 7, 40], 3, 6, 44) == [(2, 13), (37, 44)]


ROSTER = [("Amina", "Okonwe"), ("Ivo", "O'Tarrin"), ("Edda", "Ferrante-Lyle")]
TEXT = (
    "Please reach Amina Okonwe at ivo.o_x+a@mail.example.org before noon. Ring +44 7700 900981 and ask for O'TARRIN, Ivo. "
    "Both e. ferrante-lyle and Ivo K. O'Tarrin disagreed. Left at Apt 3, 12B Thimble Row, Quarrow. Ship it to Heronweg 7, 00123 Orsund. "
    "mail amina dot okonwe at lab dot test or x.y [at] retail.test. Send to 213, rue Salter, 00336 Orsund or calle Pinnace 79. "
    "Rule 20 Street Quota. Mill Lane and Harbor Street are names. Package verifier@2.8.4, user@{domain}, @retry(4). On 2026-05-02 at 08:29:33."
)


def test_scan_positions():
    auto = keyword_automaton([f.lower() for _, f in ROSTER])
    got = {(k, TEXT[s:e]) for k, s, e, *_ in scan(TEXT, frozenset(g.lower() for g, _ in ROSTER), auto) if k in ("email", "street_address", "phone", "name")}
    assert {x for x in got if x[0] != "street_address"} == {
        ("name", "Amina Okonwe"), ("email", "ivo.o_x+a@mail.example.org"), ("phone", "+44 7700 900981"), ("name", "O'TARRIN, Ivo"), ("name", "e. ferrante-lyle"),
        ("name", "Ivo K. O'Tarrin"), ("email", "amina dot okonwe at lab dot test"), ("email", "x.y [at] retail.test"),
    }
    starts = sorted(t.split(" ")[0] for k, t in got if k == "street_address")
    assert starts == ["213,", "Apt", "Heronweg", "calle"]


def test_long_tokens_are_found_whole():
    """A local part or street name of any length is one span from its first character on."""
    auto = keyword_automaton(["okonwe"])
    local, street = "a.b" * 300, "Long" * 60
    text = f"mail {local}@mail.example.org now. Lives at Apt 7, 12 {street} Road, there."
    got = {k: text[s:e] for k, s, e, *_ in scan(text, frozenset(), auto)}
    assert got["email"] == f"{local}@mail.example.org" and got["street_address"].startswith(f"Apt 7, 12 {street} Road")


def corpus():
    rng = random.Random(5)
    rows = []
    for i in range(60):
        a, b = rng.randrange(100, 999), rng.randrange(1000, 9999)
        phone = rng.choice([f"+1 ({a}) 555-{b}", f"{a}-555-{b}", f"{a}555{b}"])
        number = rng.choice([f"{a}-12-{b}", f"AB{a}{b}", f"{a} 12 {b}"])
        name = rng.choice(["Amina Okonwe", "Ivo O'Tarrin", "Wilma Nimmermehr" if i % 2 else "Edda Ferrante-Lyle"])
        rows.append((i, f"Run key {a}-12-{b} maps. mobile {phone}, leave it. Serial {b}{a}555 is old. The passport no. {number} was shown. reviewer {name} left the row.\nGrand Tessel met."))
    return rows + [(100, None), (101, ""), (102, "word " * 30000)]


def test_shapes_that_no_list_has(spark):
    """Numbers of unseen shapes and streets of unseen words are found by the contexts of known ones, and only there."""
    rng, rows, want = random.Random(8), [], set()
    digits = lambda n: "".join(str(rng.randrange(10)) for _ in range(n))
    for i in range(300):
        known, odd = i % 3, rng.random()
        phone = f"+44 7700 {digits(6)}" if known else (f"020 {digits(4)} {digits(4)}" if odd < 0.5 else f"07700 {digits(6)}")
        number = f"AB{digits(7)}" if known else (f"X{digits(7)}" if odd < 0.5 else f"AB{digits(6)}C")
        street = f"{rng.randrange(1, 99)} {rng.choice(['Thimble', 'Elm'])} {'Row' if known else rng.choice(['Boulevard', 'Mews'])}"
        text = f"Ticket {digits(7)} was closed. You may dial {phone} today. Her passport number {number} has lapsed. They moved to {street}, last year. Batch X{digits(7)} left, pallet 020 {digits(4)} {digits(4)} too. We saw 12 Blue Whales."
        rows.append((i, text))
        want |= {(i, "phone", text.index(phone) + 1), (i, "identity_number", text.index(number) + 1), (i, "street_address", text.index(street) + 1)}
    roster = spark.createDataFrame([(1, "Amina", "Okonwe")], "reviewer_id bigint, given_name string, family_name string")
    got = {tuple(r)[:3] for r in find_pii(spark.createDataFrame(rows, "doc_id bigint, text string"), roster).collect()}
    assert len(got & want) >= 0.95 * len(want) and len(got - want) <= 0.02 * len(want)


def test_bootstrapped_patterns(spark):
    docs = spark.createDataFrame(corpus(), "doc_id bigint, text string")
    roster = spark.createDataFrame([(1, *r) for r in ROSTER], "reviewer_id bigint, given_name string, family_name string")
    spans = find_pii(docs, roster)
    text = dict(corpus())
    got = {(r["doc_id"], r["pii_type"], text[r["doc_id"]][r["start_pos"] - 1 : r["end_pos"]]) for r in spans.collect()}
    for i in range(60):
        t = text[i]
        assert (i, "phone", t[t.index("mobile ") + 7 : t.index(", leave")]) in got
        assert (i, "identity_number", t[t.index("no. ") + 4 : t.index(" was shown")]) in got
        assert (i, "name", t[t.index("reviewer ") + 9 : t.index(" left")]) in got
    assert len(got) == 180
    out = {r["doc_id"]: (r["text"], r["n_replaced"]) for r in redact(docs, spans).collect()}
    assert out[100] == (None, 0) and out[101] == ("", 0) and out[0][1] == 3
    assert "mobile <PHONE>, leave it." in out[0][0] and "no. <IDENTITY_NUMBER> was" in out[0][0] and "reviewer <NAME> left" in out[0][0]
    assert find_pii(docs.filter("doc_id < 0"), roster).collect() == []
    assert not [r for r in find_pii(docs, roster.filter("reviewer_id < 0")).collect() if r["pii_type"] == "name"]
