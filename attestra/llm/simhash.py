"""Operator 7: SimHash near-duplicates by multi-index hashing.

A fingerprint is cut into segments.  Of two fingerprints within ``max_distance`` bits, at
least one pair of like segments is within ``max_distance // segments`` bits.  So each segment
has a table of fingerprints keyed (segment number, segment value); each fingerprint probes,
for every segment, all keys in the small Hamming ball around its own value, and what the
tables hold there is verified on the complete fingerprints.  By default there are two
segments of 32 bits and balls of radius one (33 probes a segment) for two bits.

A table entry with more than ``HOT`` fingerprints is split by the other bits: there both the
members and the probes also enumerate the ball of half the distance around the rest of their
bits, and meet at values between them.  So no key gathers more than a ball holds, however
many fingerprints share a segment.  Equal fingerprints are one row throughout.

Defined results: a null text counts as empty; a text without words has fingerprint zero,
linked like any other; repeated ids each get a row; rows without an id get a fingerprint and
their component, but are never its name (null if no member has an id); an empty table gives
an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import storage, survivors, workers
from .components import labels

SEED = 42  # fixed value: the hash seed of the contract
BITS = 64
#: Fingerprints that one table entry holds before it is split.
HOT = 64


def fingerprint(text: bytes, shingle_words: int = 3) -> int:
    """The SimHash of a UTF-8 text: a bit is set if over half of the shingles' XXH64 have it."""
    from xxhash import xxh64_intdigest

    words = text.lower().split()  # bytes: A-Z and ASCII white space only
    if not words:
        return 0
    n = shingle_words
    shingles = zip(*[words[k:] for k in range(n)]) if len(words) >= n else [words]
    hashes = np.array([xxh64_intdigest(b" ".join(s), SEED) for s in shingles], "<u8")
    votes = np.zeros(BITS, np.int64)
    for k in range(0, len(hashes), 1 << 16):
        block = np.ascontiguousarray(hashes[k : k + (1 << 16)])
        votes += np.unpackbits(block.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * votes > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle_words: int = 3) -> DataFrame:
    """(d, k, q, fp): the key of each row, and its fingerprint as a signed 64-bit integer."""
    storage.prepare_python(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        workers.begin("simhash")
        for batch in batches:
            found = np.array([fingerprint(x or b"", shingle_words) for x in batch.column("text").to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in survivors.KEY], pa.array(found.view(np.int64))], [*survivors.KEY, "fp"])

    rows = docs.select(*survivors.row_key(docs), F.col("text").cast("string").cast("binary").alias("text"))
    return rows.mapInArrow(run, "d bigint, k bigint, q bigint, fp bigint")


def _ball(bits: int, radius: int) -> list[int]:
    """The masks of up to ``radius`` of ``bits`` bits."""
    return [sum(1 << k for k in some) for n in range(radius + 1) for some in combinations(range(bits), n)]


def _masks(masks: list[int], shift: int = 0):
    """Masks as an array of longs."""
    signed = [(m << shift) - (1 << BITS) * (m << shift >> (BITS - 1)) for m in masks]
    return F.array(*[F.lit(m).cast("long") for m in signed])


def links(fps: DataFrame, max_distance: int = 2, segments: int = 2) -> DataFrame:
    """(a, b): all pairs of distinct fingerprints (``fp``) within ``max_distance`` bits, a < b.

    ``segments`` has to divide 64; balls have the radius ``max_distance // segments``.
    """
    if max_distance < 1:
        return fps.select(F.col("fp").alias("a"), F.col("fp").alias("b")).filter("a <> b")
    if BITS % segments:
        raise ValueError("segments: a divisor of 64")
    width, near, far = BITS // segments, max_distance // segments, -(-max_distance // 2)
    one = (1 << width) - 1
    rest_ball = _ball(BITS - width, far) if segments > 1 else [0]
    all_segments = [F.struct(F.lit(k).alias("seg"), _masks([one], k * width)[0].alias("mask"), _masks(_ball(width, near), k * width).alias("near")) for k in range(segments)]
    parts, _ = storage.written(fps.select("fp", F.explode(F.array(*all_segments)).alias("s")).select("fp", "s.seg", "s.mask", F.col("fp").bitwiseAND(F.col("s.mask")).alias("value")), "segments")
    hot, _ = storage.written(parts.groupBy("seg", "value").agg(F.count("*").alias("members")).filter(f"members > {HOT}").select("seg", "value"), "hot-segments")
    ball_of = F.get(F.array(*[x["near"] for x in all_segments]), F.col("seg"))
    probes = parts.select("seg", F.col("fp").alias("a"), F.explode(F.transform(ball_of, lambda m: F.col("value").bitwiseXOR(m))).alias("value"))
    tables = parts.select("seg", "value", F.col("fp").alias("b"))
    close = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= max_distance
    key = ["seg", "value"]
    if hot.isEmpty():
        return probes.join(tables, key).filter(F.col("a") < F.col("b")).filter(close).select("a", "b").distinct()
    cold = probes.join(hot, key, "left_anti").join(tables.join(hot, key, "left_anti"), key).filter(F.col("a") < F.col("b")).filter(close)
    # The masks of the rest lie around the segment: bits below it stay, those above move up by its width.
    around = [F.array(*[F.lit(m - (1 << BITS) * (m >> (BITS - 1))).cast("long") for m in [(r & ((1 << k * width) - 1)) | (r >> (k * width) << ((k + 1) * width)) for r in rest_ball]]) for k in range(segments)]
    rest_of = F.get(F.array(*around), F.col("seg"))
    mask_of = F.get(F.array(*[x["mask"] for x in all_segments]), F.col("seg"))
    met = lambda df, c: df.join(hot, key, "left_semi").select("*", F.explode(F.transform(rest_of, lambda m: F.col(c).bitwiseAND(F.bitwise_not(mask_of)).bitwiseXOR(m))).alias("rest"))
    split = met(probes, "a").join(met(tables, "b"), [*key, "rest"]).filter(F.col("a") < F.col("b")).filter(close)
    return cold.select("a", "b").unionByName(split.select("a", "b")).distinct()


def _grouped(docs: DataFrame, shingle_words: int, max_distance: int) -> tuple[DataFrame, DataFrame]:
    """(d, k, q, fp) of every row; (fp, root) of every fingerprint."""
    found, _ = storage.written(fingerprints(docs, shingle_words), "fingerprints")
    distinct, _ = storage.written(found.select("fp").distinct(), "distinct-fingerprints")
    roots = distinct.join(labels(links(distinct, max_distance)).withColumnRenamed("node", "fp"), "fp", "left").select("fp", F.coalesce("label", "fp").alias("root"))
    return found, storage.written(roots, "fingerprint-roots")[0]


def components(docs: DataFrame, *, shingle_words: int = 3, max_distance: int = 2) -> DataFrame:
    """(doc_id, fp, component_id): the least id among all documents that links reach."""
    found, roots = _grouped(docs, shingle_words, max_distance)
    least, _ = storage.written(found.groupBy("fp").agg(F.min("d").alias("least")).join(roots, "fp").groupBy("root").agg(F.min("least").alias("component_id")), "component-ids")
    named, _ = storage.written(roots.join(least, "root").select("fp", "component_id"), "component-names")
    return found.join(named, "fp").select(F.col("d").alias("doc_id"), "fp", "component_id")


def hexed(fp: str = "fp"):
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def keep_one(docs: DataFrame, *, shingle_words: int = 3, max_distance: int = 2) -> DataFrame:
    """One document of each component: the one with the least id (``survivors.keep_one``)."""
    found, roots = _grouped(docs, shingle_words, max_distance)
    return survivors.keep_one(docs, found.join(roots, "fp").select(*survivors.KEY, "root"))
