"""Evidence search: where the keywords and patterns of a table first stand in each document."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attestra.sources import files

#: Keywords that one scan of the blocks looks for; more take more scans, which bounds what is broadcast.
SCAN_KEYWORDS = 100_000


def _automaton(words: list[str]):
    """Finds every one of some lower-case words; its outputs are the places of those that are equal."""
    import ahocorasick

    places: dict[str, list[int]] = {}
    for k, word in enumerate(words):
        places.setdefault(word, []).append(k)
    found = ahocorasick.Automaton()
    for word, own in places.items():
        found.add_word(word, own)
    found.make_automaton()
    return found


def _compiled(pattern: str) -> re.Pattern | None:
    try:
        return re.compile(pattern, re.IGNORECASE)
    except re.error:
        return None


def first_blocks(blocks: DataFrame, keywords: DataFrame) -> DataFrame:
    """(doc_id, keyword_id, block_id, page_number, snippet): for each document and keyword the first block, by page and position, that contains it.

    ``keywords`` (keyword_id, pattern, is_regex): text is looked for in any case and anywhere,
    inside words too; a pattern is searched for in any case.  All texts are found in one pass by
    an automaton; each block gives a row for each keyword in it, of which the first is kept
    partly before the shuffle.  Null or empty keywords and patterns that do not compile find
    nothing; keywords that repeat each have rows; blocks without text have none.
    """
    spark = blocks.sparkSession
    files.ship(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    id_type = keywords.schema["keyword_id"].dataType.simpleString()
    schema = f"doc_id {blocks.schema['doc_id'].dataType.simpleString()}, keyword_id {id_type}, block_id string, page_number int, snippet string"
    asked = keywords.filter("keyword_id is not null and pattern <> ''").select("keyword_id", "pattern", F.coalesce("is_regex", F.lit(False)))
    out, group = None, []

    def scanned(some: list[tuple]) -> DataFrame:
        shared = spark.sparkContext.broadcast(some)  # SCAN_KEYWORDS rows at most

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            words = [(k, w.lower()) for k, (_, w, is_regex) in enumerate(shared.value) if not is_regex]
            patterns = [(k, p) for k, (_, w, is_regex) in enumerate(shared.value) if is_regex and (p := _compiled(w))]
            automaton = _automaton([w for _, w in words]) if words else None
            for batch in batches:
                rows, hits = [], []
                for row, text in enumerate(batch.column("text").to_pylist()):
                    if text:
                        own = {words[k][0] for _, some in automaton.iter(text.lower()) for k in some} if automaton else set()
                        own |= {k for k, p in patterns if p.search(text)}
                        rows += [row] * len(own)
                        hits += own
                kept = batch.take(pa.array(rows, pa.int64()))
                yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(hits, pa.int32())], [*kept.schema.names, "k"])

        source = blocks.select("doc_id", F.col("block_id").cast("string").alias("block_id"), F.col("page_number").cast("int").alias("page_number"), F.col("position").cast("long").alias("position"), F.col("text").cast("string").alias("text"))
        hits = source.mapInArrow(run, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in source.schema.fields) + ", k int")
        best = hits.groupBy("doc_id", "k").agg(F.min(F.struct("page_number", "position", "block_id", "text")).alias("x"))
        names = spark.createDataFrame([(k, row[0]) for k, row in enumerate(some)], f"k int, keyword_id {id_type}")
        return best.join(F.broadcast(names), "k").select("doc_id", "keyword_id", "x.block_id", "x.page_number", F.trim("x.text").alias("snippet"))  # SCAN_KEYWORDS rows at most

    def both(a: DataFrame | None, b: DataFrame) -> DataFrame:
        return b if a is None else a.unionByName(b)

    for row in asked.toLocalIterator():
        group.append(tuple(row))
        if len(group) >= SCAN_KEYWORDS:
            out, group = both(out, scanned(group)), []
    if group:
        out = both(out, scanned(group))
    return spark.createDataFrame([], schema) if out is None else out
