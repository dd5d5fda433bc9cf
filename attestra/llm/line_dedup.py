"""Operator 10: repeated runs of lines, by a suffix array over line ids.

Lines become ids; prefix doubling then ranks every place by its next 2, 4, 8, ... lines: the
rank of 2^(k+1) lines at a place is that of the pair (rank here, rank 2^k lines on) among all
distinct pairs in sorted order.  Places that share a rank form a longest-common-prefix
interval of at least that depth.  A place whose pair is unique is settled and leaves; only
shared ranks are sorted and carried on.  A repeated run counts from ``min_chars`` characters.
From each line the least run that reaches that size, and to each line the least such run that
ends there, are looked up as two overlapping power-of-two ranks; together they cover all
lines of a maximal repeated run and no others.  Where the same run begins earlier (by document
id, then line), its lines are deleted, so of each maximal run the first copy alone is left;
short common lines stay.  Only DataFrame functions are used; each round is a written table,
and ranks come from a range sort without any global window.  Counts are combined before they
are shuffled and written before they are joined, so that Spark splits the rows of a line or
run that very many places share.

Defined results: a null text has no lines and stays null; identical rows (same id and text)
count as one document; of rows that share an id but not a text the order is by text hash; a
row without an id counts as last; an empty table gives an empty result; columns of the input
stay as they are except ``text`` and, where present, ``n_chars``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import storage

MIN_CHARS = 200
_LAST = (1 << 63) - 1
KEY = ["d", "h"]


def _keys(docs: DataFrame) -> DataFrame:
    return docs.withColumn("d", F.coalesce(F.col("doc_id").cast("long"), F.lit(_LAST))).withColumn("h", F.xxhash64("text"))


def line_table(docs: DataFrame) -> DataFrame:
    """(d, h, no, size, a, b): each line's place, length, and 128-bit hash as two numbers."""
    flat = _keys(docs.select("doc_id", F.col("text").cast("string").alias("text"))).filter("text is not null").select("d", "h", F.posexplode(F.split("text", "\n", -1)).alias("no", "line"))
    return flat.select("d", "h", "no", F.length("line").cast("long").alias("size"), F.xxhash64("line").alias("a"), F.xxhash64(F.lit("second"), F.col("line")).alias("b"))


def _windows(lines: DataFrame, min_chars: int) -> DataFrame:
    """(d, h, no, span): the least runs that reach ``min_chars``, from each line on and up to each line.

    Those inside a longer run cover all of it.
    """
    up_to = _from_each(lines.withColumn("no", -F.col("no")), min_chars).select(*KEY, (-F.col("no") - F.col("span") + 1).alias("no"), "span")
    return _from_each(lines, min_chars).unionByName(up_to).distinct()


def _from_each(lines: DataFrame, min_chars: int) -> DataFrame:
    """(d, h, no, span): the number of lines from a line that first reach ``min_chars``; lines that never do are left out."""
    w = Window.partitionBy(*KEY).orderBy("no")
    summed = lines.withColumn("upto", F.sum("size").over(w))
    ends = F.struct(F.col("upto").alias("v"), F.lit(0).alias("asks"))
    asks = F.struct((F.col("upto") - F.col("size") + min_chars).alias("v"), F.lit(1).alias("asks"))
    events = summed.select(*KEY, "no", F.explode(F.array(ends, asks)).alias("e")).select(*KEY, "no", "e.*")
    down = Window.partitionBy(*KEY).orderBy(F.desc("v"), "asks").rowsBetween(Window.unboundedPreceding, 0)
    end = F.min(F.when(F.col("asks") == 0, F.col("no"))).over(down)
    return events.withColumn("end", end).filter("asks = 1 and end is not null").select(*KEY, "no", (F.col("end") - F.col("no") + 1).alias("span"))


def _ranked(places: DataFrame, by: list[str], label: str) -> tuple[DataFrame, str]:
    """(d, h, no, rank), and where it is written, of the places whose ``by`` occurs more than once; ranks follow the order of ``by``."""
    shared = places.groupBy(*by).agg(F.count("*").alias("n")).filter("n > 1").drop("n")
    ordered, ranks_path = storage.written(shared.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("place_rank", F.monotonically_increasing_id()), f"{label}-ranks")
    ranked, path = storage.written(places.join(ordered, by).select(*KEY, "no", F.col("place_rank").alias("rank")), label)
    storage.drop(places.sparkSession, ranks_path)
    return ranked, path


def _later_copies(lines: DataFrame, min_chars: int) -> DataFrame:
    """(d, h, lo, hi): windows of lines that begin earlier elsewhere."""
    spark = lines.sparkSession
    windows, _ = storage.written(_windows(lines, min_chars), "line-windows")
    storage.tidy(spark)
    longest = windows.agg(F.max("span")).first()[0] or 0
    level, found, ranks, path = 0, [], None, None
    while longest >> level:
        before = path
        if ranks is None:
            ranks, path = _ranked(lines.select(*KEY, "no", "a", "b"), ["a", "b"], "lines-1")
        else:
            step = 1 << (level - 1)
            on = ranks.select(*KEY, (F.col("no") - step).alias("no"), F.col("rank").alias("then"))
            ranks, path = _ranked(ranks.join(on, [*KEY, "no"]), ["rank", "then"], f"lines-{1 << level}")
        own = windows.filter((F.col("span") >= 1 << level) & (F.col("span") < 2 << level))
        first = own.join(ranks, [*KEY, "no"]).withColumnRenamed("rank", "r1").withColumn("tail", F.col("no") + F.col("span") - (1 << level))
        tails = ranks.select(*KEY, F.col("no").alias("tail"), F.col("rank").alias("r2"))
        both = first.join(tails, [*KEY, "tail"]) if level else first.withColumn("r2", F.col("r1"))
        found.append(storage.written(both.select(*KEY, "no", "span", F.lit(level).alias("level"), "r1", "r2"), "line-runs")[0])
        if before:
            storage.drop(spark, before)
        on = own = first = tails = both = None
        storage.tidy(spark)
        level += 1
        if level > 1 and ranks.isEmpty():
            break
    if not found:
        return windows.select(*KEY, F.col("no").alias("lo"), F.col("no").alias("hi")).limit(0)
    runs = found[0]
    for more in found[1:]:
        runs = runs.unionByName(more)
    same = ["level", "span", "r1", "r2"]
    firsts, _ = storage.written(runs.groupBy(*same).agg(F.min(F.struct(*KEY, "no")).alias("first"), F.count("*").alias("n")).filter("n > 1").drop("n"), "first-runs")
    later = runs.join(firsts, same).filter(F.struct(*KEY, "no") > F.col("first"))
    return later.select(*KEY, F.col("no").alias("lo"), (F.col("no") + F.col("span") - 1).alias("hi"))


def removed_runs(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """(d, h, runs): per document the maximal runs of lines to delete, as an array of (lo, hi)."""
    once = line_table(docs).repartition(*KEY).dropDuplicates([*KEY, "no"])
    lines, _ = storage.written(once, "lines")
    later = _later_copies(lines, min_chars)
    w = Window.partitionBy(*KEY).orderBy("lo", "hi")
    before = F.max("hi").over(w.rowsBetween(Window.unboundedPreceding, -1))
    begun = later.withColumn("new", F.coalesce((F.col("lo") > before + 1).cast("int"), F.lit(1))).withColumn("run", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    runs = begun.groupBy(*KEY, "run").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    return runs.groupBy(*KEY).agg(F.sort_array(F.collect_list(F.struct("lo", "hi"))).alias("runs"))


def dedup(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """``docs`` without the later copies of repeated runs of lines."""
    return _cut(docs, min_chars).select([f"new.`{c}`" for c in docs.columns])


def counted(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """Per document: doc_id, text without later copies, n_lines, n_removed, n_runs."""
    return _cut(docs.select("doc_id", "text"), min_chars).select("new.doc_id", "new.text", "n_lines", "n_removed", "n_runs")


def _cut(docs: DataFrame, min_chars: int) -> DataFrame:
    """(new, n_lines, n_removed, n_runs): the rows of ``docs`` with their texts cut, as structs, so that no names clash."""
    keyed = _keys(docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), "doc_id", F.col("text").cast("string").alias("text")))
    runs = removed_runs(docs, min_chars)
    joined = keyed.join(runs, KEY, "left").withColumn("lines", F.split("text", "\n", -1))
    kept = F.filter("lines", lambda x, k: ~F.exists("runs", lambda r: (k >= r["lo"]) & (k <= r["hi"])))
    out = joined.withColumn("kept", F.when(F.col("runs").isNull(), F.col("lines")).otherwise(kept))
    text = F.when(F.col("runs").isNull(), F.col("text")).otherwise(F.array_join("kept", "\n"))
    new = {"text": text}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(F.col("runs").isNull(), F.col("row.n_chars")).otherwise(F.length(text).cast(docs.schema["n_chars"].dataType))
    row = F.struct(*[new[c].alias(c) if c in new else F.col(f"row.`{c}`").alias(c) for c in docs.columns]).alias("new")
    n = lambda c: F.coalesce(F.when(F.col("text").isNull(), 0).otherwise(F.size(c)), F.lit(0)).cast("long")
    return out.select(row, n("lines").alias("n_lines"), (n("lines") - n("kept")).alias("n_removed"), F.coalesce(F.size("runs"), F.lit(0)).cast("long").alias("n_runs"))


def without_emptied(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """``dedup``, without the documents of which it leaves nothing but blank lines."""
    blank = F.coalesce(F.col("new.text"), F.lit("")).rlike(r"^\s*$")
    return _cut(docs, min_chars).filter((F.col("n_removed") == 0) | ~blank).select([f"new.`{c}`" for c in docs.columns])
