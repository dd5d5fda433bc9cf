"""Operator 13 against a plain version on odd rows, groups of items, ties and wide sums."""

import math
import re
from collections import Counter

import pytest

from attestra.llm import lexical

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def plain(docs, items, top=20):
    held = [(d, Counter(t), len(t)) for d, x in docs for t in [terms(x)] if t]
    n, all_terms = len(held), sum(x[2] for x in held)
    df = Counter(t for _, c, _ in held for t in c)
    asked: dict = {}
    for i, x in items:
        asked.setdefault(i, Counter()).update(terms(x))
    out = []
    for i, own in asked.items():
        scored = []
        for d, c, length in held:
            m = 100 - 25 + (25 * length * n) // all_terms
            score = sum(times * math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((1000000000 * c[t]) // (1000 * c[t] + 12 * m)) for t, times in own.items() if c[t])
            if score > 0:
                scored.append((-score, d is None, d or 0))
        out += [(i, rank, None if u else d, -s) for rank, (s, u, d) in enumerate(sorted(scored)[:top], 1)]
    return Counter(out)


@pytest.fixture(scope="module")
def items(spark):
    rows = [(1, "the QUICK brown fox shared3 shared4"), (2, None), (3, "same text here, for all; same"), (4, "NAÏVE naïve café 你好 Café"), (5, "nowhere to be found zzz"), (6, "word1 word2 filler3"), (1, "lazy dog"), (None, "second line tail"), (7, "?!"), (8, "Ünï-code_x a")]
    return spark.createDataFrame([(*r, 0) for r in rows], "item_id int, text string, doc_id int")


def check(docs, items, **kw):
    got = Counter(map(tuple, lexical.search(docs, items, **kw).collect()))
    assert got == plain([(r["doc_id"], r["text"]) for r in docs.collect()], [(r["item_id"], r["text"]) for r in items.collect()], **kw)
    return got


def test_search(docs, items, none):
    assert len(check(docs, items)) == 20
    check(docs, items, top=1)
    assert lexical.search(none, items).count() == 0
    empty = lexical.search(docs, items.limit(0))
    assert empty.count() == 0 and empty.columns == ["item_id", "rank", "doc_id", "score"]


def test_groups_blocks_and_wide_sums(docs, items, monkeypatch):
    monkeypatch.setattr(lexical, "SCAN_ITEMS", 2)
    check(docs, items)
    monkeypatch.setattr(lexical, "SCAN_ITEMS", 20_000)
    monkeypatch.setattr(lexical, "SCAN_TERMS", 3)
    check(docs, items)


def test_many_ties_and_repeats(spark):
    docs = spark.createDataFrame([(k % 37, ["alpha beta", "alpha", "alpha beta gamma", "delta " * 30][k % 4]) for k in range(300)] + [(None, "alpha"), (99, None)], "doc_id bigint, text string").repartition(5)
    items = spark.createDataFrame([("a", "alpha"), ("b", "alpha beta beta delta"), ("c", "")], "item_id string, text string")
    check(docs, items)
    check(docs, spark.createDataFrame([("w", "delta " * 3_000_000)], "item_id string, text string"), top=3)


def test_whole_terms_only():
    found = lexical.automaton(lexical.terms_of("art a é"))
    text = lexical.bare("Art, artful cart a ART é\té naé").decode("latin-1")
    assert Counter(k for _, k in found.iter(text)) == {0: 2, 1: 1, 2: 2}
