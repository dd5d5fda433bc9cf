"""Operator 5: benchmark decontamination by a distributed positional inverted index.

The index holds the postings (term, document, position) of all terms that the test items have,
made in one pass over the documents.  Of every window of an item the rarest terms, by their
counts in the index, are its anchors.  Their lists are shifted by the anchors' offsets and
intersected: only where all anchors of a window agree on a place does it remain a candidate.
The lists of the window's other terms are then looked up at the candidate's places, and a
window occurs where all of its terms have a posting at their offset.  Proximity search
intersects the same lists with a tolerance.  Only DataFrame functions are used.

Defined results: a null or wordless text has no words, windows or hits; rows that repeat an
id are matched each by its own text, and identical rows get identical results; empty tables
give empty results or no hits; other columns are ignored, or kept as they are by ``clean``,
whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import storage

WINDOW = 10
ANCHORS = 2
#: Item-side tables go to every executor up to this size; larger ones are joined by a shuffle, whose large partitions Spark splits.
BROADCAST_BYTES = 64 << 20
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_NO_ID = -(1 << 63)


def words(text: Column) -> Column:
    """The words of a text: runs of digits, letters and characters beyond ASCII, A-Z lower-cased."""
    return F.array_remove(F.split(F.translate(F.coalesce(text.cast("string"), F.lit("")), _UPPER, _LOWER), _BETWEEN), "")


def _key(docs: DataFrame) -> list[Column]:
    return [F.coalesce(F.col("doc_id").cast("long"), F.lit(_NO_ID)).alias("d"), F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("h")]


def _sized(df: DataFrame, label: str) -> DataFrame:
    """``df`` as a written table, marked for broadcast if its bytes allow; every row counts with its strings and 64 bytes more."""
    table, _ = storage.written(df, label)
    strings = [F.coalesce(F.octet_length(c), F.lit(0)) for c, kind in df.dtypes if kind == "string"]
    size = table.agg(F.sum(sum(strings, F.lit(64)))).first()[0] or 0
    return F.broadcast(table) if size <= BROADCAST_BYTES else table


def items_of(benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """(item, ids, iw, n): distinct word sequences with the ids that have them and their window length."""
    own = benchmark.select(F.col("item_id").cast("string").alias("item_id"), words(F.col("text")).alias("iw")).filter(F.size("iw") > 0)
    same = own.groupBy("iw").agg(F.collect_set("item_id").alias("item_ids"))
    return same.select(F.xxhash64("iw").alias("item"), "item_ids", "iw", F.least(F.size("iw"), F.lit(window)).alias("n"))


def build_index(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """(d, h, n_words, pos, term): the postings of ``terms`` (term), and for each document a row at its first place whether or not that has one."""
    flat = docs.select(*_key(docs), words(F.col("text")).alias("w")).select("d", "h", F.size("w").alias("n_words"), F.posexplode_outer("w").alias("pos", "word"))
    found = flat.join(terms, F.col("word") == F.col("term"), "left")
    return found.filter("term is not null or coalesce(pos, 0) = 0").select("d", "h", "n_words", "pos", "term")


def anchored(places: DataFrame, counts: DataFrame, anchors: int = ANCHORS) -> DataFrame:
    """(item, s, p, term, rank): for the window that begins at place s of an item, the places p of its rarest terms, the rarest first."""
    known = places.join(counts, "term", "left").select("item", "p", "n", "size", "term", F.coalesce("tf", F.lit(0)).alias("tf"))
    begins = F.sequence(F.greatest(F.lit(0), F.col("p") - F.col("n") + 1), F.least(F.col("p"), F.col("size") - F.col("n")))
    rank = F.row_number().over(Window.partitionBy("item", "s").orderBy("tf", "p"))
    return known.withColumn("s", F.explode(begins)).withColumn("rank", rank).filter(F.col("rank") <= anchors).select("item", "s", "p", "term", "rank")


def occurrences(index: DataFrame, items: DataFrame, places: DataFrame) -> DataFrame:
    """(d, h, item, lo, hi): where in documents windows of items occur; all three are written tables."""
    postings = index.filter("term is not null").select("d", "h", "pos", "term")
    counts, _ = storage.written(postings.groupBy("term").agg(F.count("*").alias("tf")), "term-counts")
    chosen, _ = storage.written(anchored(places, counts), "anchors")
    lists = _sized(chosen.select("item", "p", "term").distinct(), "anchor-lists")
    shifted = postings.join(lists, "term").groupBy("d", "h", "item", (F.col("pos") - F.col("p")).alias("delta")).agg(F.collect_set("p").alias("seen"))
    windows = _sized(chosen.groupBy("item", "s").agg(F.collect_set("p").alias("asked"), F.min_by("p", "rank").alias("lead")).join(items.select("item", "n"), "item"), "windows")
    agree = shifted.select("*", F.explode("seen").alias("lead")).join(windows, ["item", "lead"]).filter(F.size(F.array_except("asked", "seen")) == 0).select("d", "h", "item", "delta", "s", "n")
    candidates, _ = storage.written(agree, "candidates")
    needed = candidates.select("d", "h", "item", "delta", F.explode(F.sequence(F.col("s"), F.col("s") + F.col("n") - 1)).alias("p")).distinct()
    asked = needed.join(_sized(places.select("item", "p", "term"), "item-places"), ["item", "p"]).withColumn("pos", F.col("delta") + F.col("p"))
    held, _ = storage.written(postings.join(_sized(asked, "asked-places"), ["d", "h", "pos", "term"]).select("d", "h", "item", "delta", "p"), "held-places")
    places_held = held.groupBy("d", "h", "item", "delta").agg(F.collect_set("p").alias("held"))
    full = candidates.join(places_held, ["d", "h", "item", "delta"]).filter(F.size(F.array_intersect(F.sequence(F.col("s"), F.col("s") + F.col("n") - 1), "held")) == F.col("n"))
    return full.select("d", "h", "item", (F.col("delta") + F.col("s")).alias("lo"), (F.col("delta") + F.col("s") + F.col("n") - 1).alias("hi"))


def _searched(docs: DataFrame, benchmark: DataFrame, window: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The index, the items, and the occurrences."""
    items, _ = storage.written(items_of(benchmark, window), "items")
    places, _ = storage.written(items.select("item", "n", F.size("iw").alias("size"), F.posexplode("iw").alias("p", "term")), "places")
    index, _ = storage.written(build_index(docs, _sized(places.select("term").distinct(), "terms")), "postings")
    return index, items, storage.written(occurrences(index, items, places), "occurrences")[0]


def _per_document(found: DataFrame, items: DataFrame) -> DataFrame:
    """(d, h, n_hit, ids): words in any window, and the items found."""
    before = Window.partitionBy("d", "h").orderBy("lo", "hi").rowsBetween(Window.unboundedPreceding, -1)
    new = F.greatest(F.lit(0), F.col("hi") - F.greatest(F.col("lo") - 1, F.coalesce(F.max("hi").over(before), F.lit(-1))))
    stretches = found.select("d", "h", "lo", "hi").distinct().withColumn("new", new).groupBy("d", "h").agg(F.sum("new").alias("n_hit"))
    named = found.select("d", "h", "item").distinct().join(items.select("item", F.explode("item_ids").alias("id")), "item")
    ids = named.groupBy("d", "h").agg(F.sort_array(F.collect_set("id")).alias("ids"))
    return stretches.join(ids, ["d", "h"])


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """Per document: doc_id, n_words, n_hit, n_items, item_ids, contaminated."""
    index, items, hits = _searched(docs, benchmark, window)
    found, _ = storage.written(_per_document(hits, items), "contaminated")
    all_docs = index.filter("coalesce(pos, 0) = 0").select("d", "h", F.col("n_words").cast("long").alias("n_words"))
    ids = F.coalesce("ids", F.array().cast("array<string>"))
    hit = F.coalesce("n_hit", F.lit(0)).cast("long")
    return all_docs.join(found, ["d", "h"], "left").select(F.when(F.col("d") != _NO_ID, F.col("d")).alias("doc_id"), "n_words", hit.alias("n_hit"), F.size(ids).cast("long").alias("n_items"), ids.alias("item_ids"), (hit > 0).alias("contaminated"))


def clean(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """The documents without an occurrence of any window."""
    _, _, hits = _searched(docs, benchmark, window)
    found, _ = storage.written(hits.select("d", "h").distinct(), "contaminated")
    keyed = docs.select(*_key(docs), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    return keyed.join(found, ["d", "h"], "left_anti").select([F.col(f"row.`{c}`").alias(c) for c in docs.columns])


def proximity(docs: DataFrame, phrases: DataFrame, within: int) -> DataFrame:
    """(query_id, doc_id, pos): places from which all distinct words of ``phrases`` (query_id, text) occur within so many words.

    ``pos`` is the first word of such a place; each word of the phrase occurs at or after it.
    """
    asked, _ = storage.written(phrases.select("query_id", F.explode(F.array_distinct(words(F.col("text")))).alias("term")), "queries")
    index = build_index(docs, _sized(asked.select("term").distinct(), "terms")).filter("term is not null")
    hits = index.join(_sized(asked, "asked"), "term").select("query_id", "d", "h", "pos", "term").distinct()
    ahead = Window.partitionBy("query_id", "d", "h").orderBy("pos").rangeBetween(0, within - 1)
    needed = asked.groupBy("query_id").agg(F.count("*").alias("needed"))
    full = hits.withColumn("seen", F.size(F.collect_set("term").over(ahead))).join(_sized(needed, "needed"), "query_id").filter("seen = needed")
    return full.select("query_id", F.when(F.col("d") != _NO_ID, F.col("d")).alias("doc_id"), "pos").distinct()
