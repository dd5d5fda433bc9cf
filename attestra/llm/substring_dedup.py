"""Operator 4: removal of repeated byte strings, by suffix arrays of what repeats.

A byte goes if a string of ``length`` bytes that covers it also starts anywhere else, in the
same document or another.  Equal strings have equal anchors (module ``anchors``), so:

1.  Each text gives its anchors with a hash of the bytes of all windows anchored there, the
    anchor's context.  Anchors seen once are dropped.
2.  Contexts seen more than once repeat whole.  They are counted, not moved.
3.  The distinct contexts of one anchor differ somewhere.  A window of them has i bytes before
    the anchor and the rest behind it; contexts are grouped by what all windows with i in a
    range have in common: the anchor's bytes, the bytes before it that the least i takes, and
    those behind it that the largest i leaves.  The first range is all of i.  What all contexts
    of a group have in common around the anchor becomes one symbol, what none shares with
    another is cut off, and a suffix array over all of them (module ``suffix_array``) with the
    common prefixes of neighbours shows the window starts that repeat.
4.  A group of more than ``LIMIT`` contexts is halved: each half of its range of i takes the
    contexts that have windows there, cut to the bytes that those can have, and groups them by
    more bytes.  Contexts that are equal when cut repeat all over the half; one of them stands
    for them from there on.  A group for a single i has one and the same window, which repeats.
    So no task gathers an unbounded group, and how many contexts an anchor has decides how
    often its range is halved and nothing else.

Rows are told apart by their id and 128 bits of their text, contexts by their anchor's hash
and their own, 128 bits together; contexts that meet in a group are compared by their bytes.

Defined results: a null text counts as empty; shorter texts than ``length`` lose nothing;
repeated rows are copies of each other, so both lose what they share; an empty table gives an
empty result; other columns are ignored or, in ``dedup``, stay as they are, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import storage, workers
from .anchors import GRAM, LENGTH, anchors
from .suffix_array import common_prefixes, suffix_array

#: Contexts that a task solves together: a few MB, and seconds of work.
LIMIT = 4000
#: The bytes of a window beside its anchor.
AROUND = LENGTH - GRAM
ROW = ("r", "q")


def _row_key(docs: DataFrame) -> list[Column]:
    text, doc_id = F.coalesce(F.col("text").cast("string"), F.lit("")), F.col("doc_id").cast("long")
    return [F.xxhash64(doc_id, text).alias("r"), F.xxhash64(F.lit("second"), doc_id, text).alias("q")]


def _bytes() -> Column:
    return F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary").alias("text")


def anchor_table(docs: DataFrame) -> DataFrame:
    """(r, q, place, first, last, a, c): the anchors of every text; r and q stand for the row."""
    storage.prepare_python(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        workers.begin("substring_dedup")
        for batch in batches:
            found = [anchors(x or b"") for x in batch.column("text").to_pylist()]
            times = [len(x[0]) for x in found]
            rows = [pa.array(np.repeat(batch.column(x).to_numpy(), times)) for x in ROW]
            place, a, first, last, c = (np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, np.int64),) * 5
            yield pa.RecordBatch.from_arrays([*rows, *[pa.array(x.astype(np.int32)) for x in (place, first, last)], pa.array(a.view(np.int64)), pa.array(c.view(np.int64))], [*ROW, "place", "first", "last", "a", "c"])

    return docs.select(*_row_key(docs), _bytes()).mapInArrow(run, "r bigint, q bigint, place int, first int, last int, a bigint, c bigint")


def _contexts(docs: DataFrame, distinct: DataFrame) -> DataFrame:
    """(a, c, gram, left, right): the anchor's bytes and those around it of each distinct context, cut from one text that has it."""
    per_row, path = storage.written(distinct.select("a", "c", "at.*").groupBy(*ROW).agg(F.collect_list(F.struct("a", "c", "place", "first", "last")).alias("cuts")), "context-places")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        workers.begin("substring_dedup")
        for batch in batches:
            out = []
            for text, cuts in zip(batch.column("text").to_pylist(), batch.column("cuts").to_pylist(), strict=True):
                out += [(x["a"], x["c"], text[x["place"] : x["place"] + GRAM], text[x["first"] : x["place"]], text[x["place"] + GRAM : x["last"] + LENGTH]) for x in cuts]
            columns = list(zip(*out)) if out else [()] * 5
            kinds = [pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, kinds, strict=True)], ["a", "c", "gram", "left", "right"])

    cut = docs.select(*_row_key(docs), _bytes()).join(per_row, list(ROW)).select("text", "cuts").mapInArrow(run, "a bigint, c bigint, gram binary, left binary, right binary")
    found, _ = storage.written(cut.dropDuplicates(["a", "c"]), "contexts")
    storage.drop(docs.sparkSession, path)
    return found


def _common(parts: list[bytes]) -> int:
    """The length of what all parts begin with."""
    low, high, k = min(parts), max(parts), 0
    while k < min(len(low), len(high)) and low[k] == high[k]:
        k += 1
    return k


def _needed(parts: list[bytes]) -> list[int]:
    """For each part, what it has in common with the part most like it, beginning at the front."""
    order = sorted(range(len(parts)), key=parts.__getitem__)
    out = [0] * len(parts)
    for i, j in zip(order, order[1:]):
        k = _common([parts[i], parts[j]])
        out[i], out[j] = max(out[i], k), max(out[j], k)
    return out


def repeated_starts(contexts: list[tuple[bytes, bytes]], length: int = LENGTH, gram: int = GRAM) -> list[list[tuple[int, int]]]:
    """For each (left, right) around one anchor: ranges lo..hi of window starts, from the context's begin, that repeat in another."""
    lefts, rights = [x[::-1] for x, _ in contexts], [y for _, y in contexts]
    before, after = _common(lefts), _common(rights)
    core = before + gram + after
    left_needed, right_needed = _needed(lefts), _needed(rights)
    text: list[int] = []
    owner: list[tuple[int, int]] = []  # context, window start of the symbol
    for k, (left, right) in enumerate(zip(lefts, rights, strict=True)):
        if left_needed[k] + gram + right_needed[k] < length:
            continue
        own = left[before : left_needed[k]][::-1]
        begin = len(left) - before - len(own)
        symbols = [*own, 256, *right[after : right_needed[k]], 257 + k]
        text += symbols
        owner += [(k, begin + p) if p <= len(own) else (k, -1) for p in range(len(symbols))]
    found: list[list[tuple[int, int]]] = [[] for _ in contexts]
    if not text:
        return found
    order = suffix_array(text)
    shared = [*common_prefixes(text, order), 0]
    for at, s in enumerate(order):
        k, start = owner[s]
        if start < 0:
            continue
        n = max(shared[at], shared[at + 1])
        if text[s] == 256:
            if n and (spare := core + n - 1 - length) >= 0:
                found[k].append((start, start + spare))
        else:
            here = len(lefts[k]) - before - start  # symbols up to the core
            if n > here and core + n - 1 >= length:
                found[k].append((start, start))
    return found


_GROUP = ("gram", "low", "high", "near")


def _solved(contexts: DataFrame) -> DataFrame:
    """(a, c, lo, hi) over contexts (.., low, high, near) of the groups, cut by ``skip`` bytes in front; a group is held at a time."""

    def solve(key: tuple | None, group: list[tuple]) -> list[tuple]:
        if len(group) < 2:
            return []
        out = []
        for (a, c, skip, left, _), some in zip(group, repeated_starts([x[3:] for x in group]), strict=True):
            first, last = len(left) - key[2], len(left) - key[1]  # the starts of windows with high and with low bytes before the anchor
            out += [(a, c, skip + max(lo, first), skip + min(hi, last)) for lo, hi in some if lo <= last and hi >= first]
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        workers.begin("substring_dedup")
        key, group = None, []
        for batch in batches:
            out = []
            columns = [batch.column(x).to_pylist() for x in _GROUP]
            for own, *row in zip(zip(*columns, strict=True), *[batch.column(x).to_pylist() for x in ("a", "c", "skip", "left", "right")], strict=True):
                if own != key:
                    out += solve(key, group)
                    key, group = own, []
                group.append(tuple(row))
            yield _ranges(out)
        yield _ranges(solve(key, group))

    dealt = contexts.select(*_GROUP, "a", "c", "skip", "left", "right").repartition(*_GROUP).sortWithinPartitions(*_GROUP)
    return dealt.mapInArrow(run, "a bigint, c bigint, lo int, hi int")


def _ranges(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [()] * 4
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, (pa.int64(), pa.int64(), pa.int32(), pa.int32()), strict=True)], ["a", "c", "lo", "hi"])


def _grouped(contexts: DataFrame) -> DataFrame:
    """Contexts (.., low, high) that have windows in their range, with the bytes that those share beside the anchor."""
    near = F.concat(F.expr("substring(left, length(left) - low + 1, low)"), F.expr(f"substring(right, 1, {AROUND} - high)"))
    return contexts.filter(f"length(left) >= low and length(right) >= {AROUND} - high").withColumn("near", near)


def _halved(contexts: DataFrame) -> DataFrame:
    """Contexts for each half of their range in which they have windows, cut to the bytes of those windows."""
    middle = ((F.col("low") + F.col("high")) / 2).cast("int")
    halves = F.array(F.struct(F.col("low"), middle.alias("high")), F.struct((middle + 1).alias("low"), F.col("high")))
    each = contexts.withColumn("half", F.explode(halves)).select("a", "c", "gram", "left", "right", "skip", "half.*")
    most = F.least(F.col("high"), F.length("left"))
    cut = each.withColumns({"skip": (F.col("skip") + F.length("left") - most).cast("int"), "left": F.expr("substring(left, length(left) - least(high, length(left)) + 1, least(high, length(left)))"), "right": F.expr(f"substring(right, 1, {AROUND} - low)")})
    return cut.filter(f"length(left) >= low and length(right) >= {AROUND} - high")


def _partial(contexts: DataFrame, limit: int) -> DataFrame:
    """(a, c, lo, hi): window starts that repeat in another context of the same anchor."""
    left, found = _grouped(contexts.withColumns({"low": F.lit(0), "high": F.lit(AROUND), "skip": F.lit(0)})), []
    while True:  # a range is halved eight times at most
        hot, _ = storage.written(left.groupBy(*_GROUP).agg(F.count("*").alias("members")).filter(f"members > {limit}").select(*_GROUP), "hot-groups")
        if hot.isEmpty():
            found.append(_solved(left))
            break
        found.append(_solved(left.join(hot, list(_GROUP), "left_anti")))
        large, _ = storage.written(left.join(hot, list(_GROUP), "left_semi").drop("near"), "hot-contexts")
        start = (F.col("skip") + F.length("left") - F.col("low")).cast("int")
        found.append(large.filter("low = high").select("a", "c", start.alias("lo"), start.alias("hi")))
        cut, _ = storage.written(_halved(large.filter("low < high")), "halved-contexts")
        like = ["gram", "low", "high", "left", "right"]
        classes, _ = storage.written(cut.groupBy(*like).agg(F.min(F.struct("a", "c", "skip")).alias("one"), F.count("*").alias("n")), "like-contexts")
        first, last = F.length("left") - F.least(F.col("high"), F.length("left")), F.length("left") - F.greatest(F.col("low"), F.lit(AROUND) - F.length("right"))
        alike = cut.join(classes.filter("n > 1").select(*like), like, "left_semi")
        found.append(alike.select("a", "c", (F.col("skip") + first).cast("int").alias("lo"), (F.col("skip") + last).cast("int").alias("hi")))
        left = _grouped(classes.select("one.a", "one.c", "one.skip", *like))
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def removed_ranges(docs: DataFrame, limit: int = LIMIT) -> DataFrame:
    """(r, q, ranges): for each row that loses anything, the maximal runs of bytes (start, end).

    What is counted by key is written before it is joined, so that Spark can split the rows of
    an anchor or context that very many places share.
    """
    spark = docs.sparkSession
    all_anchors, all_path = storage.written(anchor_table(docs), "anchors")
    again, again_path = storage.written(all_anchors.groupBy("a").agg(F.count("*").alias("times")).filter("times > 1").select("a"), "anchors-again")
    known, known_path = storage.written(all_anchors.join(again, "a"), "repeated-anchors")
    storage.drop(spark, all_path, again_path)
    distinct, distinct_path = storage.written(known.groupBy("a", "c").agg(F.count("*").alias("n"), F.min(F.struct(*ROW, "place", "first", "last")).alias("at")), "distinct-contexts")
    several, _ = storage.written(distinct.groupBy("a").agg(F.count("*").alias("kinds")).filter("kinds > 1").select("a"), "anchors-of-several")
    contexts = _contexts(docs, distinct.join(several, "a", "left_semi"))
    part = _partial(contexts, limit).groupBy("a", "c").agg(F.array_distinct(F.collect_list(F.struct("lo", "hi"))).alias("starts"))
    marks, marks_path = storage.written(distinct.select("a", "c", "n").join(part, ["a", "c"], "left").filter("n > 1 or starts is not null"), "marked-contexts")
    whole = F.array(F.struct(F.lit(0).alias("lo"), (F.col("last") - F.col("first")).alias("hi")))
    of_rows = known.join(marks, ["a", "c"]).select(*ROW, "first", F.explode(F.when(F.col("n") > 1, whole).otherwise(F.col("starts"))).alias("s"))
    spans = of_rows.select(*ROW, (F.col("first") + F.col("s.lo")).alias("start"), (F.col("first") + F.col("s.hi") + LENGTH).alias("end"))
    w = Window.partitionBy(*ROW).orderBy("start", "end")
    gap = F.col("start") > F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    runs = spans.withColumn("new", F.coalesce(gap.cast("int"), F.lit(1))).withColumn("run", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    merged = runs.groupBy(*ROW, "run").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    ranges, _ = storage.written(merged.groupBy(*ROW).agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("ranges")), "removed-ranges")
    storage.drop(spark, known_path, distinct_path, marks_path)
    return ranges


def digests(docs: DataFrame, limit: int = LIMIT) -> DataFrame:
    """Per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    from hashlib import sha256

    ranges = removed_ranges(docs, limit)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        workers.begin("substring_dedup")
        for batch in batches:
            out = []
            for doc_id, text, gone in zip(*[batch.column(x).to_pylist() for x in ("doc_id", "text", "ranges")], strict=True):
                left = kept(text, [(x["start"], x["end"]) for x in gone or ()])
                out.append((doc_id, len(text), len(text) - len(left), len(gone or ()), sha256(left).hexdigest()))
            columns = list(zip(*out)) if out else [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, [pa.int64()] * 4 + [pa.string()], strict=True)], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    rows = docs.select(*_row_key(docs), F.col("doc_id").cast("long").alias("doc_id"), _bytes())
    return rows.join(ranges, list(ROW), "left").select("doc_id", "text", "ranges").mapInArrow(run, "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string")


def kept(text: bytes, gone: list[tuple[int, int]]) -> bytes:
    """``text`` without ascending, disjoint ranges."""
    out, at = [], 0
    for start, end in gone:
        out.append(text[at:start])
        at = end
    out.append(text[at:])
    return b"".join(out)


def dedup(docs: DataFrame, limit: int = LIMIT) -> DataFrame:
    """``docs`` with ``text`` as what is left of it; bytes that no longer form a character become replacement characters."""
    ranges = removed_ranges(docs, limit)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        workers.begin("substring_dedup")
        for batch in batches:
            row, gone = batch.column("row"), batch.column("ranges").to_pylist()
            texts = [x if not g else kept(x.encode(), [(y["start"], y["end"]) for y in g]).decode("utf-8", "replace") for x, g in zip(row.field("text").to_pylist(), gone, strict=True)]
            columns = [pa.array(texts, pa.string()) if name == "text" else row.field(k) for k, name in enumerate(names)]
            yield pa.RecordBatch.from_arrays(columns, names)

    as_text = docs.withColumn("text", F.col("text").cast("string"))
    names = as_text.columns
    rows = as_text.select(*_row_key(as_text), F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"))
    return rows.join(ranges, list(ROW), "left").select("row", "ranges").mapInArrow(run, as_text.schema)
