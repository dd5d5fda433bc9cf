"""Operator 1: token ids in ORC, with row indexes and Bloom filters on document ids.

Layout of a store: one row a document in ascending ``doc_id`` order, the ids as a list of
integers (ORC run-length encodes them), plus where the document starts inside its file
(``part``, ``part_start``).  The sort makes each stripe's and row group's ``doc_id`` range
narrow, so min/max statistics prune range reads and the Bloom filters prune point reads;
stripes are read in parallel, as Spark splits ORC files at stripes.

Defined results: a null text counts as empty and holds the end id alone; rows with equal
ids all stay, in order of their texts; null ids come first; an empty table gives an empty
store; other columns of the input are ignored whatever their names.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import storage, workers
from .pieces import interned

STORE_SCHEMA = "doc_id bigint, part int, part_start bigint, n_tokens bigint, ids array<int>"
_ARROW = pa.schema([("doc_id", pa.int64()), ("part", pa.int32()), ("part_start", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.list_(pa.int32()))])
#: Distinct pieces a worker remembers before it starts anew; bounds memory, never results.
MEMO = 600_000
#: One word, a space before it at most: no other white space of any library's kind.
_ONE_WORD = r"^ ?[^\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+$"
#: An offset table of up to so many rows, one for each file of a store, goes to every executor (16 MB); a larger one is joined by a shuffle.
MOST_OFFSETS = 1 << 20
#: Characters of a text that, after its id, decide which range of a store it goes to: rows that share an id are spread too.
_RANGE_CHARS = 64


class _Encoder:
    """Token ids of texts as little-endian 32-bit integers, by the tokenizers library.

    Distinct pieces are encoded once; their ids lie one after the other in ``ids``, and a text's
    ids are gathered from there.
    """

    def __init__(self, vocabulary: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core; the library would start a thread for each of the machine's
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(vocabulary)
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        self.line_end = self.tokenizer.encode("\n", add_special_tokens=False).ids
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.ids = np.zeros(1 << 20, "<u4")
        self.begin, self.size = np.zeros(1 << 18, np.int64), np.zeros(1 << 18, np.int32)
        self.used = 0

    def _encoded(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of some texts, one after the other, and how many each has."""
        got = [x.ids for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        sizes = np.fromiter(map(len, got), np.int64, len(got))
        return np.fromiter(chain.from_iterable(got), "<u4", int(sizes.sum())), sizes

    def _keep(self, names: list[str], ids: np.ndarray, begin: np.ndarray, size: np.ndarray) -> None:
        """Add ids, and where in them the ids of each piece are."""
        n = len(self.known)
        while self.used + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        while n + len(names) > len(self.begin):
            self.begin, self.size = np.concatenate([self.begin, np.zeros_like(self.begin)]), np.concatenate([self.size, np.zeros_like(self.size)])
        self.ids[self.used : self.used + len(ids)] = ids
        self.begin[n : n + len(names)], self.size[n : n + len(names)] = begin + self.used, size
        self.known.update(zip(names, range(n, n + len(names)), strict=True))
        self.used += len(ids)

    def _learn(self, new: list[str]) -> None:
        """Encode pieces.

        Single words are encoded as lines of one text, since a line end between them is a word of
        its own; its id tells their ids apart.  All other pieces are encoded alone, and so are
        words where a vocabulary joins line ends to them.
        """
        words = pa.array(new, pa.string())
        opened = pc.starts_with(words, "\n")
        inner = pc.if_else(opened, pc.utf8_slice_codeunits(words, 1), words)
        alone = ~pc.match_substring_regex(inner, _ONE_WORD).to_numpy(zero_copy_only=False)
        if len(self.line_end) != 1:
            alone[:] = True
        lines = inner.filter(pa.array(~alone)).to_numpy(zero_copy_only=False).tolist()
        if lines:
            ids, _ = self._encoded(["\n" + "\n".join(lines[k : k + 64]) for k in range(0, len(lines), 64)])
            ends = np.flatnonzero(ids == self.line_end[0])
            if len(ends) == len(lines):
                begin = ends + ~opened.to_numpy(zero_copy_only=False)[~alone]  # a piece that opens with a line end keeps the id of it
                self._keep([new[k] for k in np.flatnonzero(~alone).tolist()], ids, begin, np.append(ends[1:], len(ids)) - begin)
            else:
                alone[:] = True
        rest = [new[k] for k in np.flatnonzero(alone).tolist()]
        if rest:
            ids, sizes = self._encoded(rest)
            self._keep(rest, ids, np.cumsum(sizes) - sizes, sizes)

    def encode(self, texts: pa.Array, end: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """All ids of ``texts``, ``end`` after each unless None, and where each text begins."""
        if len(self.known) > MEMO:
            self.forget()
        distinct, codes, starts = interned(texts)
        if new := [p for p in distinct if p not in self.known]:
            self._learn(new)
        at = np.fromiter(map(self.known.__getitem__, distinct), np.int64, len(distinct))
        begin, size = self.begin[at], self.size[at]
        if end is not None:  # one more piece for each text, one place before the kept ids
            begin, size, codes = np.append(begin, -1), np.append(size, 1), np.insert(codes, starts[1:], len(distinct))
            starts = starts + np.arange(len(starts))
        own = size[codes]
        before = np.concatenate([[0], np.cumsum(own, dtype=np.int64)])
        narrow = np.int32 if max(self.used, int(before[-1])) < 1 << 31 else np.int64
        place = np.repeat((begin[codes] - before[:-1]).astype(narrow), own)
        place += np.arange(before[-1], dtype=narrow)
        out = self.ids[place]  # place -1 is the last of the array, which is put right below
        if end is not None:
            out[before[starts[1:]] - 1] = end
        return out, before[starts]


_ENCODERS: dict[int, _Encoder] = {}
workers.remembers("token_store", _ENCODERS.clear)


def _encoder(vocabulary: str) -> _Encoder:
    workers.begin("token_store")
    key = hash(vocabulary)
    if key not in _ENCODERS:
        _ENCODERS[key] = _Encoder(vocabulary)
    return _ENCODERS[key]


def write_store(docs: DataFrame, vocabulary_path: str, path: str, *, end_id: int | None = 0, row_index_stride: int = 10_000, stripe_bytes: int = 64 << 20, bloom_fpp: float = 0.01) -> None:
    """Encode ``text`` and write the ids to an ORC store at ``path``.

    ``end_id`` is appended to every document unless None.  The texts are dealt out by ranges
    of ``doc_id``, and of the texts' beginnings where an id repeats, before they are encoded,
    so nothing is encoded twice and no task holds more than its range.
    """
    spark = docs.sparkSession
    storage.prepare_python(spark)
    with open(vocabulary_path, encoding="utf-8") as f:
        vocabulary = spark.sparkContext.broadcast(f.read())  # one vocabulary file: a few MB
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, at, encoder = TaskContext.get().partitionId(), 0, _encoder(vocabulary.value)
        for batch in batches:
            ids, offsets = encoder.encode(batch.column("text"), end_id)
            flat = pa.Array.from_buffers(pa.int32(), len(ids), [None, pa.py_buffer(ids)])
            lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), flat)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([part] * batch.num_rows, pa.int32()), pa.array(at + offsets[:-1]), pa.array(np.diff(offsets)), lists], schema=_ARROW)
            at += int(offsets[-1])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    ordered = rows.repartitionByRange("doc_id", F.substring("text", 1, _RANGE_CHARS)).sortWithinPartitions("doc_id", "text")
    (
        ordered.mapInArrow(encode, STORE_SCHEMA)
        .write.option("orc.compress", "ZSTD")
        .option("orc.row.index.stride", row_index_stride)
        .option("orc.stripe.size", stripe_bytes)
        .option("orc.bloom.filter.columns", "doc_id")
        .option("orc.bloom.filter.fpp", bloom_fpp)
        .orc(path)
    )


def read_store(spark: SparkSession, path: str) -> DataFrame:
    """Rows of a store with ``start``, the number of ids in all documents before each.

    The offset of each file is summed over one row per file, and these offsets go to where
    the documents are, which are not moved as long as there are no more than ``MOST_OFFSETS`` files.
    """
    store = spark.read.schema(STORE_SCHEMA).orc(path)
    parts, _ = storage.written(store.groupBy("part").agg(F.sum("n_tokens").alias("n")), "store-parts")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = parts.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    if parts.count() <= MOST_OFFSETS:
        offsets = F.broadcast(offsets)
    return store.join(offsets, "part").select("doc_id", (F.col("offset") + F.col("part_start")).alias("start"), "n_tokens", "ids")


def lookup(spark: SparkSession, path: str, doc_ids: list[int]) -> DataFrame:
    """The ids of a few documents; statistics and Bloom filters skip other row groups."""
    return spark.read.schema(STORE_SCHEMA).orc(path).filter(F.col("doc_id").isin([int(x) for x in doc_ids])).select("doc_id", "n_tokens", "ids")


def with_crc(rows: DataFrame) -> DataFrame:
    """Replace ``ids`` by ``ids_crc32``, the crc32 of the ids as little-endian unsigned 32-bit integers."""

    def crc(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        workers.begin("token_store")
        for batch in batches:
            ids = batch.column("ids")
            raw = memoryview(ids.values.buffers()[1] or b"")
            base, ends = ids.values.offset, ids.offsets.to_pylist()
            sums = [zlib.crc32(raw[4 * (base + a) : 4 * (base + b)]) for a, b in zip(ends, ends[1:])]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("start"), batch.column("n_tokens"), pa.array(sums, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return rows.mapInArrow(crc, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")
