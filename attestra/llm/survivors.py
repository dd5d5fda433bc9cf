"""Keeping one document of each group of copies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KEY = ("d", "k", "q")


def row_key(docs: DataFrame) -> list[Column]:
    """(d, k, q): a row by its id and 128 bits of its text, so that rows that repeat an id stay apart."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return [F.col("doc_id").cast("long").alias("d"), F.xxhash64(text).alias("k"), F.xxhash64(F.lit("second"), text).alias("q")]


def keep_one(docs: DataFrame, grouped: DataFrame) -> DataFrame:
    """One row of ``docs`` for each group of ``grouped`` (d, k, q, root), which has a row for each of ``docs``.

    The row with the least id stays, a row without an id only where no member has one; of rows
    that share the least id the one with the least hash, and of rows that are equal one.
    """
    order = F.struct(F.col("d").isNull().alias("unknown"), *KEY)
    exact = ["unknown", F.coalesce("d", F.lit(0)).alias("d"), "k", "q"]  # the key without nulls, for the join and the window alike
    kept = grouped.groupBy("root").agg(F.min(order).alias("x")).select("x.*").select(*exact).distinct()
    rows = docs.select(*row_key(docs), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")).withColumn("unknown", F.col("d").isNull()).select(*exact, "row")
    names = ["unknown", *KEY]
    first = F.row_number().over(Window.partitionBy(*names).orderBy(F.xxhash64("row")))
    one = rows.join(kept, names, "left_semi").withColumn("place", first).filter("place = 1")
    return one.select([F.col(f"row.`{c}`").alias(c) for c in docs.columns])
