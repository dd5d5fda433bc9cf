"""The pipeline's near copies against all pairs."""

import random

import pytest

from attestra.llm import near_copies


def shingles(text):
    words = (text or "").lower().split()
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} or ({tuple(words)} if words else set())


def similar(a, b):
    return a == b or 5 * len(a & b) >= 4 * len(a | b)


@pytest.mark.parametrize("common", [1, 50])
def test_near_copies_equal_all_pairs(spark, common):
    random.seed(11)
    licence = [f"licence{k}" for k in range(12)]
    rows = [(900, None), (901, ""), (902, "two words"), (903, "Two  words"), (904, "one two three four five"), (None, "no id at all here"), (905, "one two three four five")]
    for g in range(12):
        base = [f"w{random.randrange(400)}" for _ in range(random.choice([12, 40, 120]))]
        for _ in range(random.choice([2, 6, 12])):
            words = list(base)
            for _ in range(random.choice([0, 1, 1, 2, 3])):
                words[random.randrange(len(words))] = f"edit{random.randrange(10**6)}"
            rows.append((len(rows) * 7 % 800, " ".join(words + licence * (g % 2))))
    ids = [d for d, _ in rows if d is not None]
    assert len(ids) == len(set(ids))
    sets = {d: shingles(t) for d, t in rows if d is not None}
    want = {}
    for d in sorted(sets):
        if d not in want:
            todo = [d]
            while todo:
                x = todo.pop()
                want[x] = d
                todo += [y for y in sets if y not in want and y not in todo and similar(sets[x], sets[y])]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    assert {r["doc_id"]: r["component_id"] for r in near_copies.components(docs, common=common).collect()} == want
    assert sorted(r["doc_id"] for r in near_copies.keep_one(docs, common=common).collect() if r["doc_id"] is not None) == sorted(set(want.values()))


def test_the_stage_drops_near_copies_of_many_bits(spark, small):
    import corpus_pipeline

    words = [f"word{k}" for k in range(60)]
    edited = [*words[:30], "edit", *words[31:]]
    docs = spark.createDataFrame([(1, " ".join(words)), (2, " ".join(edited)), (3, " ".join(words[::-1]))], "doc_id bigint, text string")
    assert similar(shingles(" ".join(words)), shingles(" ".join(edited)))
    assert {r["doc_id"] for r in dict(corpus_pipeline.STAGES)["simhash_near_dedup"](spark, docs, small).collect()} == {1, 3}


def test_near_copies_of_nothing(none):
    assert near_copies.keep_one(none).count() == 0


def test_the_stage_searches_by_simhash_and_compares_a_set_once_first(spark, small, monkeypatch):
    import corpus_pipeline
    from attestra.llm import simhash

    searched, asked, links, similar_pairs = [], [], simhash.links, near_copies._similar
    monkeypatch.setattr(simhash, "links", lambda fps, *a, **k: searched.append(fps.count()) or links(fps, *a, **k))
    monkeypatch.setattr(near_copies, "_similar", lambda docs, rows, pairs, *a: asked.append(pairs.count()) or similar_pairs(docs, rows, pairs, *a))
    base = [f"word{k}" for k in range(200)]
    docs = spark.createDataFrame([(g, " ".join([*base[:g], f"edit{g}", *base[g + 1 :]])) for g in range(40)], "doc_id bigint, text string")
    assert [r["doc_id"] for r in dict(corpus_pipeline.STAGES)["simhash_near_dedup"](spark, docs, small).collect()] == [0]
    assert searched and sum(asked[1:]) <= 40  # all but the fingerprints' own: a pair a set, then only sets still apart


def test_sets_that_only_share_early_shingles_are_not_made(spark, monkeypatch):
    made, sets_of = [], near_copies._sets
    monkeypatch.setattr(near_copies, "_sets", lambda held, words: made.append(held.count()) or sets_of(held, words))
    licence = [f"licence{k}" for k in range(60)]
    docs = spark.createDataFrame([(g, " ".join(licence + [f"own{g}x{k}" for k in range(150)])) for g in range(30)], "doc_id bigint, text string")
    assert near_copies.keep_one(docs).count() == 30
    assert sum(made) == 0  # any two share 56 of 336 shingles, some of them early; their sketches say that this is too few


def test_sketches_of_unlike_lengths_lose_no_pair(spark):
    base = [f"word{k}" for k in range(300)]
    rows = [(n, " ".join(base[:n])) for n in (*range(56, 82, 2), *range(118, 148, 3), *range(236, 300, 4))]  # sketches of 64 to 512 bits, doubled at 68, 132 and 260 words
    sets = {d: shingles(t) for d, t in rows}
    want = {d: min(x for x in sets if x <= d and all(similar(sets[y], sets[z]) for y, z in zip(sorted(k for k in sets if x <= k <= d), sorted(k for k in sets if x <= k <= d)[1:]))) for d in sets}
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    assert {r["doc_id"]: r["component_id"] for r in near_copies.components(docs).collect()} == want
    assert set(want.values()) == {56, 118, 236}


def test_sketches_differ_in_no_more_bits_than_sets_in_shingles(spark):
    import numpy as np

    draw, rows, want = np.random.default_rng(3), [], []
    for n, both in ((0, 0), (1, 1), (64, 60), (65, 3), (400, 390), (5000, 4900)):
        x = np.unique(draw.integers(-(2**63), 2**63 - 1, n))
        y = np.unique(np.concatenate([x[:both], draw.integers(-(2**63), 2**63 - 1, 7)]))
        rows.append((near_copies.sketch(x).tolist(), near_copies.sketch(y).tolist()))
        want.append(len(set(x.tolist()) ^ set(y.tolist())))
    found = [r["c"] for r in spark.createDataFrame(rows, "x array<bigint>, y array<bigint>").coalesce(1).select(near_copies._differing("x", "y").alias("c")).collect()]
    assert all(c <= w and (w - c) % 2 == 0 and (c > w // 3) for c, w in zip(found, want, strict=True))
