"""Operator 11 against the same permutation written out in plain Python."""

import hashlib
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from attestra.llm import sharding, storage


def plain_place(x, n, seed=sharding.SEED):
    bits = max(n - 1, 0).bit_length()
    a, b = bits // 2, bits - bits // 2

    def once(x):
        left, right = x >> b, x & ((1 << b) - 1)
        for k in range(sharding.ROUNDS):
            w = hashlib.sha256(f"{seed}/{k}".encode()).digest()
            f = [int.from_bytes(w[8 * j : 8 * j + 8], "big") % (2**31 - 2) + 1 for j in range(4)]
            t = (right * f[0] + f[1]) % (2**31 - 1)
            t = ((t ^ t >> 15) * f[2] + f[3]) % (2**31 - 1)
            left, right = right, left ^ ((t ^ t >> 13) & ((1 << (b if k % 2 else a)) - 1))
        return left << b | right

    x = once(x)
    while x >= n:
        x = once(x)
    return x


def test_shards(spark, docs, none):
    rows = [(r["doc_id"], (r["text"] or "").encode()) for r in docs.collect()]
    order = sorted(((d is not None, d or 0, len(t) + 1, zlib.crc32(t)) for d, t in rows))
    n, got = len(rows), sharding.assigned(docs).collect()
    by_row = {r["row_no"]: r for r in got}
    assert sorted(by_row) == list(range(n))
    assert [(r["doc_id"] is not None, r["doc_id"] or 0, r["size"], r["text_crc32"]) for _, r in sorted(by_row.items())] == order
    for i, r in by_row.items():
        p = plain_place(i, n)
        assert (r["place"], r["shard"], r["slot"]) == (p, p % 8, p // 8)
    sizes = Counter(r["shard"] for r in got)
    assert max(sizes.values()) - min(sizes[s] for s in range(8)) <= 1
    assert sharding.assigned(none).count() == 0
    shown = ["doc_id", "size", "text_crc32", "shard", "slot"]
    assert Counter(map(tuple, sharding.assigned(docs.repartition(7)).select(shown).collect())) == Counter(tuple(r[c] for c in shown) for r in got)


@pytest.mark.parametrize("n", [1, 2, 3, 5, 8, 100, 1025])
def test_permutation_and_its_inverse(spark, n):
    there = sharding.place_of(spark.range(n).withColumnRenamed("id", "row_no"), n)
    assert sorted(r["place"] for r in there.collect()) == list(range(n))
    assert all(r["place"] == plain_place(r["row_no"], n) for r in there.limit(40).collect())
    assert sharding.row_at(there.select("place", F.col("row_no").alias("was")), n).filter("row_no <> was").count() == 0


def test_walks_longer_than_one_expression(spark, monkeypatch):
    monkeypatch.setattr(sharding, "STEPS", 1)
    places = [r["place"] for r in sharding.place_of(spark.range(65).withColumnRenamed("id", "row_no"), 65).collect()]
    assert sorted(places) == list(range(65))


def test_equal_rows_and_seeds(spark):
    same = spark.range(500).select(F.lit(7).alias("doc_id"), F.lit("copy").alias("text")).repartition(6)
    got = sharding.assigned(same).collect()
    assert sorted((r["shard"], r["slot"]) for r in got) == sorted((p % 8, p // 8) for p in range(500))
    other = [r["place"] for r in sharding.place_of(spark.range(500).withColumnRenamed("id", "row_no"), 500, seed=12).orderBy("row_no").collect()]
    assert sorted(other) == list(range(500)) and other != [plain_place(i, 500) for i in range(500)]
    with pytest.raises(ValueError):
        sharding.assigned(same, 0)


def test_written_shards(spark, docs):
    clashing = docs.withColumnsRenamed({"lang": "shard", "source": "slot"})
    path = storage.new_path(spark, "shards")
    sharding.write_shards(clashing, path, 3)
    want = {(r["shard"], r["slot"]): (r["doc_id"], r["size"]) for r in sharding.assigned(clashing, 3).collect()}
    got = {(s, r["slot"]): (r["row"]["doc_id"], r["size"]) for s in range(3) for r in sharding.read_shard(spark, path, s).collect()}
    assert got == want
    assert [r["slot"] for r in sharding.read_shard(spark, path, 1, first=1, last=3).orderBy("slot").collect()] == [1, 2]
