"""Merging by components: order-free, chains of any length, groups of any size; and the keyword search."""

import random

from pyspark.sql import functions as F

from attestra.operators import components, evidence, extraction


def test_components_against_union_find(spark):
    rnd = random.Random(4)
    rows = [(m, rnd.choice("ab") + str(rnd.randint(0, 60))) for m in range(80) for _ in range(rnd.randint(1, 2))]
    parent = {m: m for m, _ in rows}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for m, k in rows:
        for o, j in rows:
            if j == k:
                a, b = root(m), root(o)
                parent[max(a, b)] = min(a, b)
    got = {r["member"]: r["label"] for r in components.of_shared_keys(spark.createDataFrame(rows, "member long, key string")).collect()}
    assert got == {m: root(m) for m in parent}
    assert components.of_shared_keys(spark.createDataFrame([], "member long, key string")).count() == 0


def test_a_chain_and_a_hub_of_many(spark):
    chain = spark.range(5_000).select(F.col("id").alias("member"), F.explode(F.array("id", F.col("id") + 1)).alias("key"))
    hub = spark.range(100_000).select((F.col("id") + 1_000_000).alias("member"), F.lit(-1).cast("long").alias("key"))
    found = components.of_shared_keys(chain.unionByName(hub)).groupBy("label").count().collect()
    assert {(r["label"], r["count"]) for r in found} == {(0, 5_000), (1_000_000, 100_000)}


ROWS = [
    (1, 0, "Warranty Years", "2 years", False, "short", ["a"]), (1, 1, "warranty_years", "2-years", True, "the longest text", ["c"]), (1, 2, "warranty years", "2_years", False, "another long txt", ["a", "b"]), (1, 3, "warranty_years", "2 years", False, "x", ["b", "c"]),
    (1, 4, "warranty_years", "3 years", False, "alone", ["a"]), (2, 0, "f", "v", False, "one", ["p"]), (2, 1, "f", "v", False, "two", ["q"]), (2, 2, "f", "v", False, "three", None), (3, 0, "f", "v", False, None, ["p"]), (3, 1, "f", "v", False, "d", ["q"]),
]
SCHEMA = "doc_id int, place int, field string, value string, mandatory boolean, description string, blocks array<string>"


def merged(df):
    return sorted((r["doc_id"], r["value_key"], r["field"], r["value"], r["n"], r["mandatory"], r["description"], r["blocks"]) for r in extraction.merged(df, ["place"]).collect())


def test_merging_does_not_hang_on_order(spark):
    want = sorted([
        (1, "2years", "Warranty Years", "2 years", 4, True, "the longest text", ["a", "b", "c"]), (1, "3years", "warranty_years", "3 years", 1, False, "alone", ["a"]),
        (2, "v", "f", "v", 3, False, "three", ["p", "q"]), (3, "v", "f", "v", 1, False, "d", ["q"]), (3, "v", "f", "v", 1, False, None, ["p"]),
    ], key=str)
    rows = list(ROWS)
    for seed in (0, 1):
        random.Random(seed).shuffle(rows)
        got = sorted(extraction.merged(spark.createDataFrame(rows, SCHEMA).repartition(seed + 1), ["place"]).select("doc_id", "value_key", "field", "value", "n", "mandatory", "description", "blocks").collect(), key=lambda r: str(tuple(r)))
        assert [tuple(r) for r in got] == sorted(want, key=str)
    assert extraction.merged(spark.createDataFrame([], SCHEMA), ["place"]).count() == 0


def test_keyword_search(spark):
    blocks = spark.createDataFrame([(1, 1, 0, "a", "Nothing here"), (1, 2, 1, "b", " The LICENSE text "), (1, 1, 9, "c", "sublicensed"), (2, 1, 0, "d", None), (2, 1, 1, "e", "déjà VU 42 days"), (3, 1, 0, "f", "")], "doc_id int, page_number int, position int, block_id string, text string")
    asked = spark.createDataFrame([("k", "license", False), ("again", "LICENSE", None), ("phrase", "Déjà vu", False), ("re", r"\d+ DAYS", True), ("bad", "[unclosed", True), ("empty", "", False), ("none", None, False), (None, "text", False)], "keyword_id string, pattern string, is_regex boolean")
    got = {(r["doc_id"], r["keyword_id"], r["block_id"], r["snippet"]) for r in evidence.first_blocks(blocks, asked).collect()}
    assert got == {(1, "k", "c", "sublicensed"), (1, "again", "c", "sublicensed"), (2, "phrase", "e", "déjà VU 42 days"), (2, "re", "e", "déjà VU 42 days")}
    assert evidence.first_blocks(blocks, asked.limit(0)).count() == 0 and evidence.first_blocks(blocks.limit(0), asked).count() == 0


def test_keyword_search_in_several_scans(spark, monkeypatch):
    monkeypatch.setattr(evidence, "SCAN_KEYWORDS", 2)
    blocks = spark.createDataFrame([(1, 1, 0, "a", "one two three four five")], "doc_id int, page_number int, position int, block_id string, text string")
    asked = spark.createDataFrame([(k, w, False) for k, w in enumerate("one two three four five six".split())], "keyword_id int, pattern string, is_regex boolean")
    assert {r["keyword_id"] for r in evidence.first_blocks(blocks, asked).collect()} == {0, 1, 2, 3, 4}


def test_groups_whose_candidates_have_the_same_blocks_need_no_components(spark, monkeypatch):
    from attestra.operators import components

    looked, of = [], components.of_shared_keys
    monkeypatch.setattr(extraction.components, "of_shared_keys", lambda df: looked.append(df.count()) or of(df))
    rows = [(1, k, "f", str(k // 2), k % 2 == 0, "x" * k, ["a", "b"][:: 1 if k % 2 else -1]) for k in range(6)] + [(None, 7, "f", "z", False, "p", ["a"]), (None, 8, "f", "z", False, "qq", ["a"])]
    rows += [(1, 20, "f", "far", False, "s", ["a"]), (1, 21, "f", "far", False, "t", ["c"])]
    got = {(r["doc_id"], r["value_key"], r["n"], r["mandatory"], r["description"], tuple(r["blocks"])) for r in extraction.merged(spark.createDataFrame(rows, SCHEMA), ["place"]).collect()}
    assert looked == [2]  # the ends of the two that are apart
    assert got == {(1, str(k), 2, True, "x" * (2 * k + 1), ("a", "b")) for k in range(3)} | {(None, "z", 2, False, "qq", ("a",)), (1, "far", 1, False, "s", ("a",)), (1, "far", 1, False, "t", ("c",))}


def test_what_is_found_is_made_once_for_gold_matches(spark):
    gold = spark.createDataFrame([("g", "d", "C", "f", "F", "1", ["a"])], "gold_id string, doc_id string, category string, field string, canonical string, normalised string, blocks array<string>")
    found = spark.range(1).selectExpr("'e' AS found_id", "'d' AS doc_id", "'f' AS field", "'F' AS canonical", "cast(id + 1 AS string) AS normalised", "array('a') AS blocks")
    out = extraction.gold_matches(gold, found)
    assert out._jdf.queryExecution().optimizedPlan().toString().count("Range (0, 1") == 1
    assert [(r["match"], r["shared"], r["found_id"]) for r in out.collect()] == [("EXACT", 1, "e")]
