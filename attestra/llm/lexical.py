"""Operator 13: ranked lexical search by an Aho-Corasick scan of the documents.

The distinct terms of the items make one automaton, whose words carry a boundary on both
sides, so that it finds whole terms only; its outputs are numbers of terms, which map to the
items that hold them.  There is no index of the documents.  A first scan counts, from the texts
alone, the documents, their terms, and how many documents hold each item term; weights follow.
A second scan counts each document's occurrences again and scores it for all items at once.
Each task keeps the best ``top`` documents of each item that it has seen, so what is shuffled
is tasks x items x ``top`` rows at most; they are ranked in parts and the best of the parts again.

Items are taken in groups of ``SCAN_ITEMS`` items or ``SCAN_TERMS`` distinct terms, whichever is
reached first; each group takes two scans of its own, which bounds what the driver holds, what
is broadcast and what a task keeps, however many items there are.  Scores are sums of whole
numbers; they are added as doubles where they must lie below 2^53, else as 64-bit integers.

Defined results: a null text has no terms; an item without terms has no rows; rows that repeat
an item_id are one item with the terms of all (a null id is an item like any other); rows that
repeat a doc_id are documents of their own; documents without an id come last among equal
scores; empty tables give an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
import uuid
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import storage, workers

TOP = 20
#: A group of items is closed at so many distinct terms (about 100 bytes each in the automaton) or items (``top`` x 17 bytes each in a task).
SCAN_TERMS = 200_000
SCAN_ITEMS = 20_000
#: Cells of the table documents x items that one block of documents fills.
BLOCK_CELLS = 1 << 19
#: Bytes of text that are scanned before the matches are counted.
BLOCK_BYTES = 4 << 20

_INSIDE = np.array([b > 127 or chr(b).isalnum() for b in range(256)])
_BARE = bytes((b + 32 if 65 <= b <= 90 else b) if _INSIDE[b] else 32 for b in range(256))


def bare(text: str | None) -> bytes:
    """UTF-8 of the text, A-Z lower-cased, each byte between terms a space, and a space at both ends."""
    return b" " + (text or "").encode("utf-8", "replace").translate(_BARE) + b" "


def terms_of(text: str | None) -> list[str]:
    """The terms, each with one character a byte, as the automaton holds them."""
    return [t.decode("latin-1") for t in bare(text).split()]


def automaton(terms: list[str]):
    """Finds each of ``terms`` between two boundaries; its output is the term's place in the list."""
    import ahocorasick

    found = ahocorasick.Automaton(ahocorasick.STORE_INTS)
    for k, term in enumerate(terms):
        found.add_word(f" {term} ", k)
    found.make_automaton()
    return found


_BUILT: dict[str, object] = {}
workers.remembers("lexical", _BUILT.clear)


def _worker(shared):
    """The automaton of a task, built once a process; ``shared`` holds a name that no other group has, and the terms."""
    workers.begin("lexical")
    name, terms = shared.value
    if name not in _BUILT:
        _BUILT.clear()
        _BUILT[name] = automaton(terms)
    return _BUILT[name]


def _scanned(found, texts: list[str | None]) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """By blocks of texts: first text, number of texts, terms of each, and of each (text, term): text * terms + term, tf."""
    width, first = len(found), 0
    while first < len(texts):
        last, held, counts, cells = first, 0, [], []
        while last < len(texts) and (last == first or held < BLOCK_BYTES):
            text = bare(texts[last])
            inside = _INSIDE[np.frombuffer(text, np.uint8)]
            counts.append(int(np.count_nonzero(inside[1:] & ~inside[:-1])))
            cells.append(np.fromiter((k for _, k in found.iter(text.decode("latin-1"))), np.int64) + (last - first) * width)
            held += len(text)
            last += 1
        keys, tf = np.unique(np.concatenate(cells), return_counts=True)
        yield first, last - first, np.array(counts, np.int64), keys, tf.astype(np.int64)
        first = last


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def _groups(items: DataFrame) -> Iterator[list[tuple[object, Counter]]]:
    """The items with their terms and how often each occurs, in groups that one automaton serves; items without terms are left out."""
    group: list[tuple[object, Counter]] = []
    distinct: set[str] = set()
    for row in items.select("item_id", F.col("text").cast("string").alias("text")).orderBy("item_id").toLocalIterator():
        own = Counter(terms_of(row[1]))
        if group and group[-1][0] == row[0]:
            group[-1][1].update(own)
        elif own:
            if len(group) >= SCAN_ITEMS or len(distinct) >= SCAN_TERMS:
                yield group
                group, distinct = [], set()
            group.append((row[0], own))
        distinct.update(own)
    if group:
        yield group


def frequencies(docs: DataFrame, shared) -> tuple[int, int, np.ndarray]:
    """Documents with a term at least, all their terms, and in how many documents each of the shared terms occurs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, nonempty, total = _worker(shared), 0, 0
        held = np.zeros(len(found), np.int64)
        for batch in batches:
            for _, _, counts, keys, _ in _scanned(found, batch.column(0).to_pylist()):
                held += np.bincount(keys % len(found), minlength=len(found))
                nonempty, total = nonempty + int(np.count_nonzero(counts)), total + int(counts.sum())
        some = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([[-2, -1], some]), pa.int64()), pa.array(np.concatenate([[nonempty, total], held[some]]), pa.int64())], ["term", "count"])

    counted = _texts(docs).select("text").mapInArrow(run, "term bigint, count bigint").groupBy("term").agg(F.sum("count").alias("count"))
    found = dict(map(tuple, counted.collect()))  # a row a term of the automaton
    return found.pop(-2, 0), found.pop(-1, 0), np.array([found.get(k, 0) for k in range(len(shared.value[1]))], np.int64)


class _Best:
    """The best ``top`` documents of each item that a task has seen."""

    def __init__(self, items: int, top: int) -> None:
        self.top = top
        self.score = np.zeros((items, top), np.int64)
        self.doc = np.zeros((items, top), np.int64)
        self.unknown = np.zeros((items, top), bool)

    def add(self, scores: np.ndarray, doc: np.ndarray, unknown: np.ndarray) -> None:
        """``scores``: documents x items."""
        floor = np.maximum(self.score[:, -1], 1)
        for k in np.flatnonzero(scores.max(axis=0) >= floor):
            new = np.flatnonzero(scores[:, k] >= floor[k])
            s, d, u = np.concatenate([self.score[k], scores[new, k]]), np.concatenate([self.doc[k], doc[new]]), np.concatenate([self.unknown[k], unknown[new]])
            order = np.lexsort((d, u, -s))[: self.top]
            self.score[k], self.doc[k], self.unknown[k] = s[order], d[order], u[order]

    def rows(self) -> pa.RecordBatch:
        item, place = np.nonzero(self.score > 0)
        docs = pa.array(self.doc[item, place], pa.int64(), mask=self.unknown[item, place])
        return pa.RecordBatch.from_arrays([pa.array(item, pa.int32()), docs, pa.array(self.score[item, place], pa.int64())], ["item", "doc_id", "score"])


def _best_of(docs: DataFrame, group: list[Counter], top: int) -> DataFrame:
    """(item, doc_id, score): candidates of the best documents for the items of one group, by their place in it."""
    spark = docs.sparkSession
    terms = sorted(set().union(*group))
    shared = spark.sparkContext.broadcast((uuid.uuid4().hex, terms))  # one group's terms
    n_docs, n_terms, df = frequencies(docs, shared)
    weights = [math.floor(1000 * math.log((2 * n_docs + 2) / (2 * f + 1))) for f in df.tolist()]
    place = {t: k for k, t in enumerate(terms)}
    pairs = sorted((place[t], k, times) for k, item in enumerate(group) for t, times in item.items())
    of_term, of_item, repeats = (np.array(x, np.int64) for x in zip(*pairs))
    exact = max(sum(weights[place[t]] * times * 10**6 for t, times in item.items()) for item in group) < 1 << 53
    outputs = spark.sparkContext.broadcast((of_item, repeats, np.searchsorted(of_term, np.arange(len(terms) + 1)), np.array(weights, np.int64)))  # a row a term of an item
    width = len(group)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, best, (of_item, repeats, starts, w) = _worker(shared), _Best(width, top), outputs.value
        each = max(1, BLOCK_CELLS // width)
        for batch in batches:
            ids, unknown = batch.column(0).fill_null(0).to_numpy(), np.asarray(batch.column(0).is_null())
            for first, many, counts, keys, tf in _scanned(found, batch.column(1).to_pylist()):
                m = 100 - 25 + 25 * counts * n_docs // max(n_terms, 1)
                row, term = np.divmod(keys, len(w))
                worth = w[term] * (1_000_000_000 * tf // (1000 * tf + 12 * m[row]))
                cut = np.searchsorted(row, np.arange(0, many + each, each))
                for b in range(len(cut) - 1):
                    lo, hi, base = cut[b], cut[b + 1], b * each
                    size = min(each, many - base)
                    if lo == hi:
                        continue
                    own = starts[term[lo:hi] + 1] - starts[term[lo:hi]]
                    at = np.repeat(starts[term[lo:hi]] - np.concatenate([[0], np.cumsum(own)[:-1]]), own) + np.arange(own.sum())
                    cell, value = np.repeat((row[lo:hi] - base) * width, own) + of_item[at], np.repeat(worth[lo:hi], own) * repeats[at]
                    if exact:
                        scores = np.bincount(cell, weights=value, minlength=size * width).astype(np.int64)
                    else:
                        scores = np.zeros(size * width, np.int64)
                        np.add.at(scores, cell, value)
                    docs_here = slice(first + base, first + base + size)
                    best.add(scores.reshape(size, width), ids[docs_here], unknown[docs_here])
        yield best.rows()

    return _texts(docs).mapInArrow(run, "item int, doc_id bigint, score bigint")


def _ranked(found: DataFrame, top: int, *by: str) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last()))
    return found.withColumn("rank", rank).filter(F.col("rank") <= top)


def search(docs: DataFrame, items: DataFrame, *, top: int = TOP) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``top`` highest scores above 0 of each id of ``items``."""
    spark: SparkSession = docs.sparkSession
    storage.prepare_python(spark)
    schema = f"item_id {items.schema['item_id'].dataType.simpleString()}, rank int, doc_id bigint, score bigint"
    found = None
    for group in _groups(items):
        best = _best_of(docs, [terms for _, terms in group], top).withColumn("part", F.pmod(F.xxhash64("doc_id"), F.lit(64)))
        ranked = _ranked(_ranked(best, top, "item", "part").drop("rank"), top, "item")
        names = spark.createDataFrame(list(enumerate(k for k, _ in group)), f"item int, {schema.split(',')[0]}")
        named = ranked.join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score")  # SCAN_ITEMS ids at most
        found = named if found is None else found.unionByName(named)
    return spark.createDataFrame([], schema) if found is None else found


SQL = r"""
WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'), lambda x: x <> '') AS t FROM documents),
i AS (SELECT item_id, unnest(list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'), lambda x: x <> '')) AS term FROM benchmark),
q AS (SELECT item_id, term, count(*) AS times FROM i GROUP BY ALL),
c AS (SELECT count(*) AS n, sum(len(t)) AS l FROM w WHERE len(t) > 0),
tf AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(t) AS term FROM w) WHERE term IN (SELECT term FROM q) GROUP BY ALL),
df AS (SELECT term, CAST(floor(1000 * ln((2 * any_value(n) + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM tf, c GROUP BY term),
m AS (SELECT doc_id, 75 + (25 * len(t) * n) // l AS m FROM w, c WHERE len(t) > 0),
s AS (SELECT item_id, doc_id, CAST(sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * m))) AS BIGINT) AS score FROM tf JOIN m USING (doc_id) JOIN df USING (term) JOIN q USING (term) GROUP BY item_id, doc_id)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM s WHERE score > 0 QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) <= 20
"""
