"""Personal identifiers in free text: found, located, replaced.

One scan lists what could be an identifier together with the words around it.
Shapes that leave no doubt (email addresses, house numbers with a street) are
taken as they are.  All others are decided by bootstrapping: seed entities
(persons of a roster; numbers whose shape is only used for phones or for
identity numbers; house numbers with a known street word) induce lexical patterns, the words before or after a
mention.  Spark scores the graph of patterns and instances: a pattern is worth
the share of seeds among its mentions, an unseen instance the worth of its
patterns, and instances that score high are seeds of the next round.  Patterns
of high confidence then decide the mentions whose shape is ambiguous, such as
ten plain digits, and find names the roster does not have, numbers of shapes and
streets of words that no list names.

The scan is per document; pattern and word statistics are aggregations over
all candidates of the corpus.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgate.session import durable

#: Different given or family names sent to the scan; rosters with more are refused.
MAX_ROSTER_WORDS = 1_000_000

# Words that end or begin a postal street line.
STREET_ENDS = ("street", "st", "lane", "road", "rd", "close", "hill", "avenue", "ave", "court", "row", "quay", "drive", "way", "place", "terrace", "square", "crescent", "gardens")
STREET_TAILS = ("weg", "straße", "strasse", "straãÿe", "straã\x9fe", "gasse", "allee", "platz")
STREET_HEADS = ("rue", "calle", "avenida", "via")
FLATS = ("apt", "apartment", "flat", "unit", "suite", "wohnung", "piso")

# Words before a number that say what it is, in the languages of the corpus.
LABELS = {
    "phone": ("phone", "mobile", "tel", "telefon", "teléfono", "téléphone", "ring", "call", "fax", "appeler le", "appelez le", "llame al"),
    "identity": ("passport", "pasaporte", "passeport", "reisepass", "ausweisnummer", "personalausweis", "identité", "identidad", "licence", "license", "national id", "id card", "id", "id_number", "tax number", "tax id", "steuernummer", "security number", "dni"),
}

_L = r"[^\W\d_]"
_FLAT = rf"(?:(?:{'|'.join(FLATS)})\.? \d{{1,4}}\w?, )?"
_BEFORE_END = re.compile(rf"(?<![\w#.,/-]){_FLAT}\d{{1,4}}[a-z]? {_L}[\w'-]*(?: {_L}[\w'-]*)?$")
_BEFORE_TAIL = re.compile(rf"(?<!\w){_FLAT}{_L}[\w'-]*$")
_BEFORE_HEAD = re.compile(rf"(?<![\w#.,/-]){_FLAT}\d{{1,4}}[a-z]?,? $")
_STREET = re.compile(rf" {_L}[\w'-]+(,? \d{{1,4}}\b)?")
_HOUSE = re.compile(r" \d{1,4}[a-z]?\b")
_TOWN = re.compile(r"\.?(?:, (?:flat|apt) \d+\w?)?(?:,? ?\n?\d{4,5} [^\W\d_]+|, [A-Z][^\W\d_]+(?=[.\n\"',]|$))?", re.I)
_DOMAIN = re.compile(r"\s?(?:@|\[at\]|\(at\))\s?((?:[\w-]+\.)+[a-z]{2,24})\b(?![.@]\w)")
_SPELLED = re.compile(r" at ([\w-]+(?: dot [\w-]+)* dot [a-z]{2,24})\b(?! at [\w-]+ dot )")
_LOCAL = re.compile(r"[\w+%'-]+(?:(?:\.| dot )[\w+%'-]+)*$")

_EDGE, _STOP = r"(?<![\w.,#/@+-])", r"(?!\w|[-/.]\d)"
_NUMBER = re.compile(
    rf"(?P<phone>\+\d[\d ().-]{{7,18}}\d|{_EDGE}(?:\(\d{{2,5}}\) ?\d{{3,4}}[- .]?\d{{4}}|00\d{{2}} ?\d{{2,5}} \d{{3,8}}|0\d{{3,4}} \d{{3}} \d{{3,4}}|0\d{{2,4}}/\d{{5,9}}|1-\d{{3}}-\d{{3}}-\d{{4}}|\d{{3}}\.\d{{3}}\.\d{{4}})){_STOP}"
    rf"|(?P<phone_like>{_EDGE}(?:\d{{3}}-\d{{3}}-\d{{4}}|\d{{3}} \d{{3}} \d{{4}}|\d{{10}})){_STOP}"
    rf"|(?P<identity>{_EDGE}(?:\d{{2}} \d{{3}} \d{{3}} \d|[A-Za-z]{{2}}\d{{7}}|[A-Za-z]\d{{8}}[A-Za-z]|\d{{3}} \d{{2}} \d{{4}}|\d{{9}})){_STOP}"
    rf"|(?P<identity_like>{_EDGE}(?:\d{{3}}-\d{{2}}-\d{{4}}|\d{{4}}-\d{{4}}-\d{{2}}|\d{{6}}/\d{{4}}|[A-Za-z]\d{{8}})){_STOP}"
)
#: Runs of six or more digits, where a number is looked for.
_DIGITS = re.compile(r"\d(?:[ ().\-/]{0,2}\d){5,}")
#: A number with a few letters before or after it, of whatever shape.
_OPEN_NUMBER = re.compile(r"(?<![\w.,#/@+-])(?:\+|\()?[A-Za-z]{0,3}\d(?:[ ().\-/]{0,2}\d){5,17}[A-Za-z]?(?![\w@]|[-/.:,]\d)")
#: A house number before one to three capitalised words.
_OPEN_STREET = re.compile(r"(?<![\w#.,/@+-])\d{1,4}[a-z]?,? (?:[A-Z][^\W\d_]+ ){0,2}([A-Z][^\W\d_]+)(?![\w@-])")
_BLANKS = str.maketrans({c: " " for c in ";\"'="})
_TRIM = "._,:()[]{}<>#*-–!?…"
_CAPITAL = r"[A-Z](?:['’][A-Z])?[^\W\d_A-Z]+(?:['’-][A-Z]?[^\W\d_]+)*"
_PAIR = re.compile(rf"({_CAPITAL}|[A-Z]\.)(,?)(?:\s+[A-Z]\.)?\s+(?=({_CAPITAL})(?![\w@+-]))")
_GIVEN_BEFORE = re.compile(r"(?<![\w@.+-])(?<!\w')([^\W\d_]+|[a-z]\.)(?:\s+([a-z]\.))?\s+$")
_GIVEN_AFTER = re.compile(r",\s+([^\W\d_]+|[a-z]\.)(?![\w@])")

SCHEMA = "key string, kind string, start bigint, stop bigint, w1 string, w2 string, l1 string, l2 string, r1 string, r2 string"


def lower_same_length(text: str) -> str:
    low = text.lower()
    return low if len(low) == len(text) else "".join(c.lower() if len(c.lower()) == 1 else c for c in text)


def _shape(number: str) -> str:
    """Digits as 9, letters as a; what is between them stays."""
    return re.sub(r"[^\W\d_]", "a", re.sub(r"\d", "9", number))


def keyword_automaton(families: list[str]):
    """Finds in one pass all places where an address, an email or a known name may be."""
    import ahocorasick

    found = ahocorasick.Automaton()
    words = [("family", w) for w in families]
    words += [("end", " " + w) for w in STREET_ENDS] + [("tail", w + " ") for w in STREET_TAILS] + [("head", w + " ") for w in STREET_HEADS]
    words += [("at", w) for w in ("@", "[at]", "(at)", " at ")]
    for kind, w in words:
        found.add_word(w, (kind, len(w)))
    found.make_automaton()
    return found


def _back(low: str, end: int, blanks: int) -> int:
    """Start of the stretch before ``end`` that holds so many blanks; words are never cut."""
    at = end
    for _ in range(blanks):
        at = low.rfind(" ", 0, at)
        if at < 0:
            return 0
    return at


def _local_part(low: str, floor: int, end: int) -> re.Match | None:
    """The local part of an address that ends at ``end``, whole however long it is."""
    width = 80
    while True:
        lo = max(floor, end - width)
        m = _LOCAL.search(low, lo, end)
        if not m or m.start() > lo + 5 or lo == floor:  # a dot, also as a word, may have been cut
            return m
        width *= 4


def _email(low: str, at: int, stop: int, taken: int) -> tuple[int, int] | None:
    """Address around the sign or word for @ at ``at``; also with blanks round it, or "at" and "dot" as words."""
    if low[at] == " ":
        after = _SPELLED.match(low, at)
    else:
        after = _DOMAIN.match(low, at - 1 if at and low[at - 1] == " " else at)
    if not after:
        return None
    local = _local_part(low, taken, after.start())
    if not local:
        return None
    start = local.start()
    while low[start] in "'-%":
        start += 1
    return (start, after.end()) if start < after.start() else None


def _address(low: str, kind: str, start: int, stop: int) -> tuple[int, int] | None:
    """Street line around a street word, from flat, house number or street on."""
    if kind == "end":
        if stop < len(low) and (low[stop].isalnum() or low[stop] == "_"):
            return None
        before = _BEFORE_END.search(low, _back(low, start, 7), start)
        return (before.start(), stop) if before else None
    if kind == "tail":
        after, before = _HOUSE.match(low, stop - 1), _BEFORE_TAIL.search(low, _back(low, start, 5), start)
        return (before.start(), after.end()) if after and before else None
    if start and low[start - 1].isalnum():
        return None
    after, before = _STREET.match(low, stop - 1), _BEFORE_HEAD.search(low, _back(low, start, 5), start)
    if not after or not (before or after.group(1)):
        return None
    return (before.start() if before else start, after.end())


def _words(stretch: str, backwards: bool) -> list[str]:
    """Up to two words nearest to a mention; a sentence end between words stops."""
    out: list[str] = []
    tokens = stretch.translate(_BLANKS).split()
    if backwards:
        tokens.reverse()
    for t in tokens[:4]:
        if (out or not backwards) and (t[-1] if backwards else t[0]) in ".!?…>":
            break
        w = t.strip(_TRIM)
        if w and not w.isdigit():
            out.append(w)
            if len(out) == 2:
                break
        if not backwards and t[-1] in ".!?…":
            break
    return out


def _context(low: str, start: int, stop: int) -> tuple[str, str, str, str]:
    """Last one and two words before a mention and first ones after it, inside its sentence."""
    left = low[max(0, start - 36) : start]
    left = _words(left[left.rfind("\n") + 1 :], True)
    right = low[stop : stop + 36]
    cut = right.find("\n")
    right = _words(right if cut < 0 else right[:cut], False)
    return left[0] if left else "^", " ".join(reversed(left)) or "^", right[0] if right else "$", " ".join(right) or "$"


def scan(text: str, given: frozenset, automaton) -> list[tuple]:
    """Candidates of a text: (kind, start, stop, w1, w2, l1, l2, r1, r2), positions from 0.

    ``given`` are lower-case given names, ``automaton`` is a
    ``keyword_automaton`` over the lower-case family names.
    """
    low = lower_same_length(text).replace("’", "'")
    out: list[tuple] = []
    masked, taken, families, streets = low, 0, [], []
    for end, (kind, size) in automaton.iter(low):
        start = end + 1 - size
        if kind == "family":
            families.append((start, end + 1))
        elif kind == "at":
            span = _email(low, start, end + 1, taken)
            if span and span[0] >= taken:
                s, taken = span
                masked = f"{masked[:s]}{'email'.center(taken - s, '_')}{masked[taken:]}"
                out.append(("email", s, taken, None, None, None, None, None, None))
        else:
            span = _address(low, kind, start, end + 1)
            if span:
                end = _TOWN.match(text, span[1]).end()
                streets.append((span[0], end))
                out.append(("street_address", span[0], end, None, None, *_context(low, span[0], end)))
    for run in _DIGITS.finditer(text):
        known = False
        for m in _NUMBER.finditer(text, max(0, run.start() - 2), run.end() + 3):
            known = True
            if masked[m.start()] != "_":
                out.append((m.lastgroup, m.start(), m.end(), None, None, *_context(masked, m.start(), m.end())))
        m = None if known else _OPEN_NUMBER.search(text, max(0, run.start() - 4), run.end() + 2)
        if m and m.end() > run.start() and masked[m.start()] != "_":
            out.append(("number_like", m.start(), m.end(), _shape(m.group()), None, *_context(masked, m.start(), m.end())))
    for m in _OPEN_STREET.finditer(text):
        if not any(a < m.end() and m.start() < b for a, b in streets):
            out.append(("street_like", m.start(), m.end(), m.group(1).lower(), None, *_context(masked, m.start(), m.end())))
    known = set()
    for start, stop in families:
        before, after = masked[start - 1 : start], masked[stop : stop + 1]
        if before == "'" and start > 1 and masked[start - 2].isalnum() or before.isalnum() or before in ("_", "@", "+", "-", ".") or after.isalnum() or after in ("_", "@", "+", "-"):
            continue
        m = _GIVEN_BEFORE.search(masked, min(max(0, start - 40), _back(masked, start, 4)), start)
        word = m.group(1) if m else ""
        if word in given or word.endswith("."):
            first, last = m.start(1), stop
        elif m and m.group(2):
            first, last, word = m.start(2), stop, "."
        else:
            m = _GIVEN_AFTER.match(masked, stop)
            word = m.group(1) if m else ""
            if not (word in given or word.endswith(".")):
                continue
            first, last = start, m.end()
        known.add(first)
        w1 = "." if word.endswith(".") else word
        out.append(("name", first, last, w1, masked[start:stop], *_context(masked, first, last)))
    for m in _PAIR.finditer(text):
        s, e = m.start(), m.end(3)
        if s in known or masked[s] == "_" or (s and (text[s - 1].isalnum() or text[s - 1] in "_@.'’+-")):
            continue
        a, b = low[s : m.end(1)], low[m.start(3) : e]
        w1, w2 = (b, a) if m.group(2) else ("." if a[-1] == "." else a, b)
        out.append(("name_like", s, e, w1, w2, *_context(masked, s, e)))
    return out


def roster_words(roster: DataFrame) -> tuple[frozenset, list[str]]:
    """Lower-case given names and family names of the seed persons; the size that counts is that of distinct names, not of persons."""
    out = []
    for c in ("given_name", "family_name"):
        names = roster.select(F.lower(F.trim(c)).alias("w")).filter(F.length("w") > 0).distinct()
        rows = names.limit(MAX_ROSTER_WORDS + 1).collect()
        if len(rows) > MAX_ROSTER_WORDS:
            raise ValueError("the roster has too many different names to be sent to the scan")
        out.append([r[0] for r in rows])
    return frozenset(out[0]), sorted({f.replace("’", "'") for f in out[1]})


def candidates(documents: DataFrame, roster: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Everything in the texts that could be an identifier, as a table; positions count from 0."""
    shared = documents.sparkSession.sparkContext.broadcast(roster_words(roster))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        given, families = shared.value
        automaton = keyword_automaton(families)
        for pdf in batches:
            rows = [(k, *c) for k, t in zip(pdf["key"], pdf["text"]) for c in scan(t, given, automaton)]
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in SCHEMA.split(", ")])

    texts = documents.select(F.col(key).cast("string").alias("key"), F.col(text).alias("text")).filter(F.length("text") > 0)
    return durable(texts.mapInPandas(run, SCHEMA), "candidates")


SIDES = ("l1", "l2", "r1", "r2")


def _pattern_worth(mentions: DataFrame, seed, support: int, wanted: tuple[str, ...] = SIDES) -> DataFrame:
    """``side, words, worth``: share of seeds among the mentions of each pattern with enough mentions."""
    sides = F.explode(F.array(*[F.struct(F.lit(c).alias("side"), F.col(c).alias("words")) for c in wanted])).alias("p")
    counted = mentions.select(seed.cast("double").alias("seed"), sides).groupBy("p.side", "p.words").agg(F.count(F.lit(1)).alias("n"), F.avg("seed").alias("worth"))
    return counted.filter((F.col("n") >= support) & ~F.col("words").isin("^", "$"))


def _with_worth(mentions: DataFrame, worth: DataFrame, wanted: tuple[str, ...] = SIDES) -> DataFrame:
    """Adds ``left`` and ``right``: worth of the longer pattern on each side, else of the shorter, else 0."""
    out = mentions
    for side in wanted:
        mine = worth.filter(F.col("side") == side).select(F.col("words").alias(side), F.col("worth").alias("w_" + side))
        out = out.join(mine, side, "left")
    of = lambda *cs: F.coalesce(*[F.col(f"w_{c}") for c in cs if c in wanted], F.lit(0.0))
    return out.withColumn("left", of("l2", "l1")).withColumn("right", of("r2", "r1")).drop(*[f"w_{c}" for c in wanted])


def number_mentions(found: DataFrame, kind: str, trust: float = 0.2) -> DataFrame:
    """Accepted mentions of one kind of number, of the shapes it is known to have.

    Seeds are the numbers whose shape only this kind has and those that follow
    one of its labels.  A pattern counts where at least ``trust`` of its
    mentions are seeds.  A number is accepted that has such a pattern on one
    side or follows a label; a phone number of a shape of its own is accepted
    anywhere.
    """
    own, like = kind, f"{kind}_like"
    mentions = found.filter(F.col("kind").isin(own, like))
    labelled = F.col("l1").isin(*LABELS[kind]) | F.col("l2").isin(*LABELS[kind])
    worth = _pattern_worth(mentions, (F.col("kind") == own) | labelled, 2)
    scored = _with_worth(mentions, worth)
    believed = F.greatest("left", "right") >= trust
    doubtless = labelled | (F.col("kind") == own if kind == "phone" else F.lit(False))
    return scored.filter(believed | doubtless).select(*found.columns)


def open_mentions(accepted: DataFrame, open_: DataFrame, trust: float = 0.6, support: int = 3, rounds: int = 8) -> DataFrame:
    """Mentions of ``open_`` that contexts of ``accepted`` ones bring in, whatever their shape.

    Each round scores the patterns before a mention by the share of accepted
    ones among all their mentions, then each instance (the shape of a number,
    the last word of a street; ``w1``) by the share of its mentions in trusted
    patterns.  Mentions in trusted patterns are accepted where a tenth of their
    instance's mentions, and at least two, are in such patterns; they are seeds
    of the next round.  Rounds end when nothing is added.
    """
    columns, known, fresh, before = open_.columns, accepted, None, SIDES[:2]
    for _ in range(rounds):
        every = known.withColumn("seed", F.lit(True)).unionByName(open_.withColumn("seed", F.lit(False)))
        scored = _with_worth(open_, _pattern_worth(every, F.col("seed"), support, before), before).filter(F.col("w1").isNotNull())
        good = scored.groupBy("w1").agg(F.count(F.lit(1)).alias("n"), F.avg((F.col("left") >= trust).cast("double")).alias("share")).filter("n >= 2 and share >= 0.1")
        more = durable(scored.filter(F.col("left") >= trust).join(good.select("w1"), "w1", "left_semi").select(*columns), "open")
        if not more.limit(1).count():
            break
        fresh = more if fresh is None else fresh.unionByName(more)
        known = known.unionByName(more)
        open_ = open_.join(more.select("key", "start"), ["key", "start"], "left_anti").select(*columns)
    return accepted.limit(0).select(*columns) if fresh is None else fresh


def name_mentions(found: DataFrame, rounds: int = 2, trust: float = 0.8, support: int = 3) -> DataFrame:
    """Accepted names: persons of roster words, and unseen ones found by patterns.

    Each round scores the patterns by their share of known names among all
    capitalised pairs, and takes over words whose mentions average at least
    ``trust`` on both sides, in at least ``support`` mentions.
    """
    known = found.filter(F.col("kind") == "name")
    open_ = found.filter(F.col("kind") == "name_like")
    accepted = known
    for _ in range(rounds):
        every = accepted.withColumn("seed", F.lit(True)).unionByName(open_.withColumn("seed", F.lit(False)))
        scored = _with_worth(open_, _pattern_worth(every, F.col("seed"), support))
        good = durable(scored.groupBy("w1", "w2").agg(F.count(F.lit(1)).alias("n"), F.avg("left").alias("l"), F.avg("right").alias("r")).filter((F.col("n") >= support) & (F.least("l", "r") >= trust)).select("w1", "w2"), "names")
        if not good.limit(1).count():
            break
        fresh = open_.join(good, ["w1", "w2"], "left_semi").select(*found.columns)
        accepted = durable(accepted.unionByName(fresh), "accepted")
        open_ = open_.join(good, ["w1", "w2"], "left_anti").select(*found.columns)
    return accepted.select("key", F.lit("name").alias("pii_type"), "start", "stop")


def find_pii(documents: DataFrame, roster: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``<key>, pii_type, start_pos, end_pos``: one row an occurrence, positions from 1, the end included.

    Null and empty texts hold none.  A key with several rows gets the
    occurrences of each.  Other columns are ignored; an empty roster leaves
    no seed persons, and then no names are found.
    """
    found = candidates(documents, roster, key, text)
    named = lambda rows, name: rows.select("key", F.lit(name).alias("pii_type"), "start", "stop")
    of = lambda *kinds: found.filter(F.col("kind").isin(*kinds))
    every = named(of("email"), "email").unionByName(name_mentions(found))
    for kind_, name in (("phone", "phone"), ("identity", "identity_number")):
        mine = durable(number_mentions(found, kind_), kind_)
        every = every.unionByName(named(mine, name)).unionByName(named(open_mentions(mine, of("number_like")), name))
    every = every.unionByName(named(of("street_address"), "street_address")).unionByName(named(open_mentions(of("street_address"), of("street_like")), "street_address"))
    kind = dict(documents.dtypes)[key]
    return every.select(F.col("key").cast(kind).alias(key), "pii_type", (F.col("start") + 1).alias("start_pos"), F.col("stop").alias("end_pos")).distinct()


def redact(documents: DataFrame, spans: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``<key>, text, n_replaced``: the texts with each occurrence replaced by ``<TYPE>``.

    Of overlapping occurrences the one that begins first (then the longest) is
    replaced.  The spans of one document go to one row; there are never more
    than the document has words.  Texts without occurrences stay as they are.
    """
    per = spans.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("start_pos", (-F.col("end_pos")).alias("e"), "pii_type"))).alias("spans"))

    def replaced(texts: pd.Series, spans: pd.Series) -> pd.DataFrame:
        out, counts = [], []
        for t, ss in zip(texts, spans):
            parts, at, n = [], 0, 0
            for s in ss if ss is not None and t is not None else ():
                if s["start_pos"] - 1 >= at:
                    parts += [t[at : s["start_pos"] - 1], f"<{s['pii_type'].upper()}>"]
                    at, n = -s["e"], n + 1
            out.append(None if t is None else "".join(parts) + t[at:])
            counts.append(n)
        return pd.DataFrame({"text": out, "n_replaced": counts})

    both = documents.select(key, text).join(per, key, "left")
    return both.select(key, F.pandas_udf(replaced, "text string, n_replaced bigint")(F.col(text), F.col("spans")).alias("x")).select(key, "x.text", "x.n_replaced")
