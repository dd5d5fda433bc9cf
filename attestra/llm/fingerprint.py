"""Operator 2: quartile bucket digests of documents.

Byte triplets inside a sliding window of five bytes are hashed into buckets and counted.
The quartiles of the counts give each bucket a code from 0 to 3; the digest is the length on
a logarithmic scale, how the quartiles stand to each other, and the codes.  Two digests are
compared by a difference score: the codes' distances, plus those of length and quartiles.
It is bounded, so that ``1 - difference / bound`` is a likeness from 0 to 1.

Defined results: a null text counts as empty (length 0, all codes 0); equal texts have equal
digests; repeated ids are put in the order of their texts; a single document is its own
successor; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from . import storage, workers

BUCKETS = 256
#: Positions in the window, beside the first byte, that make up a triplet.
TRIPLETS = ((1, 2), (1, 3), (2, 3), (2, 4))
LENGTH_BASE = 1.3  # one step of the length code
_LENGTH_CODES, _RATIO_CODES = 64, 16
#: Weights of the parts of the difference score; its bound is their sum.
CODE_WEIGHT, LENGTH_WEIGHT, RATIO_WEIGHT = 0.9, 0.07, 0.03


def counts(text: bytes) -> np.ndarray:
    """How often triplets fall into each bucket."""
    found = np.zeros(BUCKETS, np.int64)
    for at in range(0, len(text), 1 << 20):  # blocks that overlap by a window
        b = np.frombuffer(text[at : at + (1 << 20) + 4], np.uint8).astype(np.uint32)
        if at and len(b) <= 4:
            break
        for salt, (j, k) in enumerate(TRIPLETS):
            n = len(b) - 4 if len(b) > 4 else len(b) - k
            if n > 0:
                h = (b[:n] * np.uint32(0x9E3779B1) ^ b[j : j + n] * np.uint32(0x85EBCA77) ^ b[k : k + n] * np.uint32(0xC2B2AE3D)) + np.uint32(0x27D4EB2F * (salt + 1) & 0xFFFFFFFF)
                h ^= h >> np.uint32(15)
                h *= np.uint32(0x2C1B3C6D)
                found += np.bincount(h >> np.uint32(24), minlength=BUCKETS)
    return found


def digest(text: bytes) -> bytes:
    """Length code, two quartile ratios in one byte, and two bits a bucket."""
    found = counts(text)
    q1, q2, q3 = np.sort(found)[[BUCKETS // 4 - 1, BUCKETS // 2 - 1, 3 * BUCKETS // 4 - 1]]
    codes = ((found > q1).astype(np.uint8) + (found > q2) + (found > q3)).astype(np.uint8)
    length = min(_LENGTH_CODES - 1, round(np.log1p(len(text)) / np.log(LENGTH_BASE)))
    ratios = [min(_RATIO_CODES - 1, int(_RATIO_CODES * q / q3)) if q3 else 0 for q in (q1, q2)]
    return bytes([length, ratios[0] << 4 | ratios[1]]) + (codes[0::4] | codes[1::4] << 2 | codes[2::4] << 4 | codes[3::4] << 6).tobytes()


def _codes(d: bytes) -> np.ndarray:
    packed = np.frombuffer(d, np.uint8)[2:]
    return np.stack([packed >> s & 3 for s in (0, 2, 4, 6)]).astype(np.int8)


def difference(a: bytes, b: bytes) -> float:
    """From 0 (equal digests) to 1."""
    apart = np.abs(_codes(a) - _codes(b))
    codes = float(apart.sum()) / (3 * BUCKETS)
    length = min(1.0, abs(a[0] - b[0]) / 8)
    ratios = (abs((a[1] >> 4) - (b[1] >> 4)) + abs((a[1] & 15) - (b[1] & 15))) / (2 * (_RATIO_CODES - 1))
    return CODE_WEIGHT * codes + LENGTH_WEIGHT * length + RATIO_WEIGHT * ratios


def likeness(a: bytes, b: bytes) -> float:
    """From 0 to 1, 1 for equal digests."""
    return 1.0 - difference(a, b)


def digests(docs: DataFrame, *, text_col: str = "text", out_col: str = "fingerprint") -> DataFrame:
    """``docs`` with the hexadecimal digest of ``text_col``; an existing ``out_col`` is replaced."""
    storage.prepare_python(docs.sparkSession)
    rest = docs.drop(out_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        workers.begin("fingerprint")
        for batch in batches:
            found = [digest((x or "").encode()).hex() for x in batch.column(text_col).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.string())], [*batch.schema.names, out_col])

    return rest.mapInArrow(run, StructType([*rest.schema.fields, StructField(out_col, StringType())]))


_OUT = "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
_NAMES = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
_KINDS = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
#: Characters of a text that, after its id, decide which range it goes to: rows that share an id are spread too.
_RANGE_CHARS = 64


def _compared(doc_id: int | None, text: str, own: bytes, following: str, following_own: bytes) -> tuple:
    """A row of the result, from a document's text and digest and those of the next."""
    k = len(text) // 4
    edited = (text[: len(text) - k] + following[:k]).encode()
    e = digest(edited)
    return doc_id, len(text), sha256(edited).hexdigest(), own.hex(), e.hex(), likeness(own, e), likeness(own, following_own)


def edited_neighbours(docs: DataFrame) -> DataFrame:
    """Per document: its digest, that of its text with the last quarter taken from the next document, and likenesses.

    Texts are dealt out by ranges of ids, each is moved once.  A task compares all neighbours
    within its range, and gives the first and the last document of it as they are; the last of
    each range is then compared with the first of the next that has any, and that of the last
    range with the first of all.
    """
    storage.prepare_python(docs.sparkSession)

    def within(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        workers.begin("fingerprint")
        part, first, held = TaskContext.get().partitionId(), None, None  # documents: id, text, digest

        def rows(done: list[tuple], edges: list[tuple]) -> pa.RecordBatch:
            columns = list(zip(*done)) if done else [()] * len(_NAMES)
            full = [pa.array([*c, *[None] * len(edges)], t) for c, t in zip(columns, _KINDS, strict=True)]
            own = [pa.array([None] * len(done) + [e[k] for e in edges], t) for k, t in enumerate((pa.string(), pa.int64(), pa.string()))]
            return pa.RecordBatch.from_arrays([pa.array([part] * (len(done) + len(edges)), pa.int32()), *own, *full], ["part", "edge", "id", "text", *_NAMES])

        for batch in batches:
            done = []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                text = text or ""
                now = doc_id, text, digest(text.encode())
                if held is None:
                    first = now
                else:
                    done.append(_compared(*held, *now[1:]))
                held = now
            yield rows(done, [])
        if held is not None:
            yield rows([], [("first", *first[:2]), ("last", *held[:2])])

    def across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        workers.begin("fingerprint")
        for batch in batches:
            done = [_compared(i, t, digest(t.encode()), n, digest(n.encode())) for i, t, n in zip(*[batch.column(c).to_pylist() for c in ("doc_id", "text", "following")], strict=True)]
            columns = list(zip(*done)) if done else [()] * len(_NAMES)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _KINDS, strict=True)], _NAMES)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    ordered = rows.repartitionByRange("doc_id", F.substring("text", 1, _RANGE_CHARS)).sortWithinPartitions("doc_id", "text")
    ranges, _ = storage.written(ordered.mapInArrow(within, "part int, edge string, id bigint, text string, " + _OUT), "neighbours")
    edges = ranges.filter("edge is not null").select("part", "edge", "id", "text")
    parts = edges.filter("edge = 'first'").select("part")  # one row a range
    following = F.coalesce(F.lead("part").over(Window.orderBy("part")), F.min("part").over(Window.partitionBy()))
    pairs = parts.select("part", following.alias("to"))
    lasts = edges.filter("edge = 'last'").select("part", F.col("id").alias("doc_id"), "text")
    firsts = edges.filter("edge = 'first'").select(F.col("part").alias("to"), F.col("text").alias("following"))
    met = lasts.join(pairs, "part").join(firsts, "to").select("doc_id", "text", "following").mapInArrow(across, _OUT)
    return ranges.filter("edge is null").select(*_NAMES).unionByName(met)
