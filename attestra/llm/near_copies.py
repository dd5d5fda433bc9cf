"""Near copies for the pipeline: documents whose sets of word shingles have a Jaccard similarity of 0.8 or more.

The first candidates are found by SimHash: fingerprints of operator 7 within two bits, by its
multi-index tables; an exact check on complete sets follows.  At 0.8 fingerprints differ in
about ten bits of 64, more than any tables can reach, so what fingerprints cannot link is
searched for besides, and the result is exact.  For that all shingles have one order: those that many documents have come last,
the rest by hash.  Two sets with that similarity share a shingle among the first of each, and
the first they share lies early enough in both to leave room for the overlap they need; only
such pairs are compared, on their complete sets.  Sets that are equal are one row throughout.
First each set is compared with the least
of one shingle, then with those of its other shingles that it is not yet connected with; then, where a shingle's sets
are not yet one component, those outside its largest component with all of other components.
So a large group of near copies costs a row a member, and no link between components is missed.
Most pairs that share an early shingle are not similar.  So each set has a sketch of one to two bits
a shingle (``sketch``), from which follows how many shingles two sets must differ in at least; complete sets
are made and compared only for pairs that this bound leaves possible.

Defined results: a null text counts as empty, and a text with fewer words than a shingle is
one shingle; rows without an id link like others, but stay only where no row of their group
has one; rows that repeat an id are rows of their own; an empty table gives an empty result.
Shingles are told apart by 64-bit hashes, sets and rows by 128 bits in all.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import simhash, storage, survivors, workers
from .components import labels
from .simhash import SEED

SHINGLE_WORDS = 5
SIMILARITY = 0.8
#: Shingles that more documents have among their first come last; how many such are told to workers.  Neither changes the result.
COMMON, MOST_COMMON = 50, 1 << 19


def shingle_set(text: bytes, shingle_words: int = SHINGLE_WORDS) -> np.ndarray:
    """The distinct shingles' XXH64 in ascending order."""
    from xxhash import xxh64_intdigest

    words = text.lower().split()  # as in operator 7
    if not words:
        return np.empty(0, np.int64)
    n = shingle_words
    shingles = zip(*[words[k:] for k in range(n)]) if len(words) >= n else [words]
    return np.unique(np.fromiter((xxh64_intdigest(b" ".join(s), SEED) for s in shingles), np.uint64).view(np.int64))


def _prefix(n: int, t: Fraction) -> int:
    """How many of a set's n shingles one of them must be among that a similar set has too."""
    return n - -(-t.numerator * n // t.denominator) + 1


def sketch(s: np.ndarray) -> np.ndarray:
    """The parity of the shingles at each of so many bits, a power of two, as the set has shingles or more; as longs.

    Two sets differ in at least as many shingles as their sketches differ in bits, as a shingle
    that both have is in both; a sketch is halved by the exclusive or of its halves.
    """
    bits = max(64, 1 << max(len(s) - 1, 0).bit_length())
    odd = np.bincount((s.view(np.uint64) & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view("<i8")


def _differing(x: str, y: str) -> Column:
    """In how many bits the sketches ``x`` and ``y`` differ, the longer folded to the length of the other."""
    k = f"least(size({x}), size({y}))"
    folded = lambda c: f"aggregate(sequence(0L, size({c}) div {k} - 1), array_repeat(0L, {k}), (s, i) -> zip_with(s, slice({c}, int(i * {k} + 1), {k}), (p, q) -> p ^ q))"
    return F.expr(f"aggregate(zip_with({folded(x)}, {folded(y)}, (p, q) -> bit_count(p ^ q)), 0L, (s, c) -> s + c)")


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(*survivors.row_key(docs), F.col("text").cast("string").cast("binary").alias("text"))


def _prepare(spark) -> None:
    storage.prepare_python(spark)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(4 << 20))


def _first_shingles(docs: DataFrame, words: int, t: Fraction) -> DataFrame:
    """(token): each document's first shingles by hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        workers.begin("near_copies")
        for batch in batches:
            sets = [shingle_set(x or b"", words) for x in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([s[: _prefix(len(s), t)] for s in sets] or [np.empty(0, np.int64)]))], ["token"])

    return _texts(docs).select("text").mapInArrow(run, "token bigint")


def _prefixes(docs: DataFrame, words: int, t: Fraction, common: np.ndarray) -> DataFrame:
    """(d, k, q, node, n, fp, sketch, tokens): the row, a number for its set, its size, its SimHash by operator 7, its sketch, and its first shingles."""
    told = docs.sparkSession.sparkContext.broadcast(common)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh64_intdigest

        workers.begin("near_copies")
        late = told.value
        for batch in batches:
            nodes, sizes, prints, sketches, tokens = [], [], [], [], []
            for x in batch.column("text").to_pylist():
                s = shingle_set(x or b"", words)
                prints.append(simhash.fingerprint(x or b""))
                nodes.append(xxh64_intdigest(s.tobytes(), SEED))
                sizes.append(len(s))
                sketches.append(sketch(s))
                if len(late) and len(s):
                    is_late = late[np.minimum(np.searchsorted(late, s), len(late) - 1)] == s
                    s = np.concatenate([s[~is_late], s[is_late]])
                tokens.append(s[: _prefix(len(s), t)])
            lists = []
            for some in (sketches, tokens):
                offsets = np.concatenate([[0], np.cumsum([len(x) for x in some])]).astype(np.int32)
                lists.append(pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(some or [np.empty(0, np.int64)]))))
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in survivors.KEY], pa.array(np.array(nodes, np.uint64).view(np.int64)), pa.array(sizes, pa.int64()), pa.array(np.array(prints, np.uint64).view(np.int64)), *lists], [*survivors.KEY, "node", "n", "fp", "sketch", "tokens"])

    return _texts(docs).mapInArrow(run, "d bigint, k bigint, q bigint, node bigint, n bigint, fp bigint, sketch array<bigint>, tokens array<bigint>")


def _sets(docs: DataFrame, words: int) -> DataFrame:
    """(node, tokens): complete sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh64_intdigest

        workers.begin("near_copies")
        for batch in batches:
            sets = [shingle_set(x or b"", words) for x in batch.column("text").to_pylist()]
            nodes = np.array([xxh64_intdigest(s.tobytes(), SEED) for s in sets], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array([s.tolist() for s in sets], pa.list_(pa.int64()))], ["node", "tokens"])

    return _texts(docs).select("text").mapInArrow(run, "node bigint, tokens array<bigint>")


def _need(t: Fraction):
    """The overlap that sets of sizes n and m need, as SQL."""
    return f"(({t.numerator} * (n + m) + {t.numerator + t.denominator - 1}) div {t.numerator + t.denominator})"


def _room(t: Fraction) -> str:
    """Whether a shingle at places i and j can be the first that two similar sets share."""
    return f"i + {_need(t)} <= n AND j + {_need(t)} <= m"


def _possible(once: DataFrame, sketches: DataFrame, t: Fraction) -> DataFrame:
    """The pairs (a, b, both) that can be similar by their sketches; all similar pairs are among them."""
    of = lambda c, name: sketches.select(F.col("node").alias(c), F.col("sketch").alias(name))
    most = F.col("both") - _differing("x", "y")  # twice what they can share
    return once.join(of("a", "x"), "a").join(of("b", "y"), "b").filter(most * (t.numerator + t.denominator) >= 2 * t.numerator * F.col("both")).select("a", "b", "both")


def _similar(docs: DataFrame, rows: DataFrame, pairs: DataFrame, sketches: DataFrame, words: int, t: Fraction) -> DataFrame:
    """(a, b): the pairs (a, b, n, m) whose complete sets are similar; only the texts of pairs that can be are read for them."""
    once = pairs.filter(f"{_need(t)} <= least(n, m)").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), (F.col("n") + F.col("m")).alias("both")).groupBy("a", "b").agg(F.first("both").alias("both"))
    once, _ = storage.written(_possible(once, sketches, t), "near-pairs")
    asked = once.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    holder = rows.join(asked, "node").groupBy("node").agg(F.min(F.struct("d", "k", "q")).alias("x")).select("x.*")
    holder, _ = storage.written(holder, "near-holders")  # few rows as a rule: texts are then not dealt out to meet them
    keyed = docs.select(*survivors.row_key(docs), "text")
    same = keyed["d"].eqNullSafe(holder["d"]) & (keyed["k"] == holder["k"]) & (keyed["q"] == holder["q"])
    held = keyed.join(holder, same, "left_semi").select(F.col("d").alias("doc_id"), "text")
    sets, path = storage.written(_sets(held, words).dropDuplicates(["node"]), "near-sets")
    full = once.join(sets.select(F.col("node").alias("a"), F.col("tokens").alias("x")), "a").join(sets.select(F.col("node").alias("b"), F.col("tokens").alias("y")), "b")
    shared = F.size(F.array_intersect("x", "y"))
    links, _ = storage.written(full.filter(shared * (t.numerator + t.denominator) >= F.col("both") * t.numerator).select("a", "b").distinct(), "near-links")
    storage.drop(docs.sparkSession, path)
    return links


def _near_fingerprints(rows: DataFrame) -> DataFrame:
    """(a, b, n, m): candidates by SimHash: each set with the least of its fingerprint, and the least of fingerprints within two bits with each other."""
    named, _ = storage.written(rows.groupBy("fp").agg(F.min(F.struct("node", "n")).alias("x")).select("fp", "x.*"), "near-fingerprints")
    least = lambda fp, node, n: named.select(F.col("fp").alias(fp), F.col("node").alias(node), F.col("n").alias(n))
    alike = rows.select("fp", F.col("node").alias("a"), "n").distinct().join(least("fp", "b", "m"), "fp").filter("a <> b")
    close = simhash.links(named.select("fp")).select(F.col("a").alias("fa"), F.col("b").alias("fb")).join(least("fa", "a", "n"), "fa").join(least("fb", "b", "m"), "fb").filter("a <> b")
    return alike.select("a", "b", "n", "m").unionByName(close.select("a", "b", "n", "m"))


def _apart(pairs: DataFrame, links: DataFrame) -> DataFrame:
    """Those of ``pairs`` that ``links`` do not connect yet."""
    known = labels(links)
    of = lambda c: known.select(F.col("node").alias(c), F.col("label").alias(f"l{c}"))
    return pairs.join(of("a"), "a", "left").join(of("b"), "b", "left").filter(F.coalesce("la", "a") != F.coalesce("lb", "b")).drop("la", "lb")


def _grouped(docs: DataFrame, shingle_words: int, similarity: float, common: int) -> DataFrame:
    """(d, k, q, root) of every row; root stands for all that similar pairs connect."""
    spark, t = docs.sparkSession, Fraction(str(similarity))
    _prepare(spark)
    often = _first_shingles(docs, shingle_words, t).groupBy("token").agg(F.count("*").alias("c")).filter(F.col("c") > common)
    late = often.orderBy(F.desc("c"), "token").limit(MOST_COMMON).select("token").toArrow()
    late = np.sort(late.column("token").to_numpy().astype(np.int64))
    found, found_path = storage.written(_prefixes(docs, shingle_words, t, late), "near-prefixes")
    storage.tidy(spark)
    rows, _ = storage.written(found.select(*survivors.KEY, "node", "n", "fp"), "near-rows")
    sketches, _ = storage.written(found.groupBy("node").agg(F.first("sketch").alias("sketch")), "near-sketches")
    links = _similar(docs, rows, _near_fingerprints(rows), sketches, shingle_words, t)
    tokens = found.groupBy("node").agg(F.first("n").alias("n"), F.first("tokens").alias("tokens")).select("node", "n", F.posexplode("tokens").alias("i", "token"))
    tokens, tokens_path = storage.written(tokens, "near-tokens")
    storage.drop(spark, found_path)
    storage.tidy(spark)
    heads, _ = storage.written(tokens.groupBy("token").agg(F.min(F.struct("node", "n", "i")).alias("head"), F.count("*").alias("c")).filter("c > 1").drop("c"), "near-heads")
    storage.tidy(spark)
    shared, shared_path = storage.written(tokens.join(heads, "token"), "near-shared")
    storage.drop(spark, tokens_path)
    storage.tidy(spark)
    stars = shared.select(F.col("node").alias("a"), "n", "i", F.col("head.node").alias("b"), F.col("head.n").alias("m"), F.col("head.i").alias("j")).filter(f"a <> b AND {_room(t)}")
    stars, stars_path = storage.written(stars.select("a", "b", "n", "m").distinct(), "near-stars")
    one = _apart(stars, links).groupBy("a").agg(F.min(F.struct("b", "n", "m")).alias("x")).select("a", "x.*")
    links, _ = storage.written(links.unionByName(_similar(docs, rows, one, sketches, shingle_words, t)), "near-found")
    storage.tidy(spark)
    links, _ = storage.written(links.unionByName(_similar(docs, rows, _apart(stars, links), sketches, shingle_words, t)), "near-found")
    storage.drop(spark, stars_path)
    storage.tidy(spark)
    known = shared.select("token", "node", "n", "i").join(labels(links), "node", "left").withColumn("label", F.coalesce("label", "node"))
    known, known_path = storage.written(known, "near-known")
    storage.drop(spark, shared_path)
    parts, _ = storage.written(known.groupBy("token", "label").agg(F.count("*").alias("c")).groupBy("token").agg(F.max(F.struct("c", "label")).alias("main"), F.count("*").alias("parts")).filter("parts > 1").select("token", F.col("main.label").alias("main")), "near-parts")
    mixed, _ = storage.written(known.join(parts, "token"), "near-mixed")
    storage.drop(spark, known_path)
    storage.tidy(spark)
    minor = mixed.filter("label <> main").select("token", F.col("node").alias("a"), "n", "i", F.col("label").alias("la"))
    others = mixed.select("token", F.col("node").alias("b"), F.col("n").alias("m"), F.col("i").alias("j"), F.col("label").alias("lb"), "main")
    across = minor.join(others, "token").filter(f"la <> lb AND (lb = main OR a < b) AND {_room(t)}")
    more = _similar(docs, rows, across, sketches, shingle_words, t)
    roots, _ = storage.written(labels(links.unionByName(more)), "near-labels")
    return rows.join(roots, "node", "left").select(*survivors.KEY, F.coalesce("label", "node").alias("root"))


def components(docs: DataFrame, *, shingle_words: int = SHINGLE_WORDS, similarity: float = SIMILARITY, common: int = COMMON) -> DataFrame:
    """(doc_id, component_id): the least id among all rows that similar pairs reach; rows without an id are left out."""
    grouped, _ = storage.written(_grouped(docs, shingle_words, similarity, common), "near-grouped")
    least, _ = storage.written(grouped.groupBy("root").agg(F.min("d").alias("component_id")), "near-least")
    return grouped.filter("d is not null").join(least, "root").select(F.col("d").alias("doc_id"), "component_id")


def keep_one(docs: DataFrame, *, shingle_words: int = SHINGLE_WORDS, similarity: float = SIMILARITY, common: int = COMMON) -> DataFrame:
    """One document of each group: the one with the least id (``survivors.keep_one``)."""
    return survivors.keep_one(docs, _grouped(docs, shingle_words, similarity, common))
