"""Name similarity."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

LEAST = 0.60


def matched_ratio(a: Column, b: Column) -> Column:
    """The share of characters in matching blocks of two names; no built-in function has it, so it runs in Arrow batches."""

    def ratio(x: pd.Series, y: pd.Series) -> pd.Series:
        from difflib import SequenceMatcher

        return pd.Series([SequenceMatcher(None, one or "", other or "").ratio() for one, other in zip(x, y, strict=True)])

    return F.pandas_udf(ratio, DoubleType())(a, b)


def alike(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """``pairs`` with ``alike``: names that are equal, of which one holds the other, or whose matched ratio is ``LEAST`` or more.

    Names are compared upper-cased without outer white space; the ratio is worked out for
    distinct pairs that the cheaper tests leave open.
    """
    x, y = F.upper(F.trim(F.coalesce(a, F.lit("")))), F.upper(F.trim(F.coalesce(b, F.lit(""))))
    keyed = pairs.withColumns({"_x": x, "_y": y})
    held = F.contains("_x", F.col("_y")) | F.contains("_y", F.col("_x"))
    open_pairs = keyed.filter(~held).select("_x", "_y").distinct()
    ratios = open_pairs.withColumn("_ratio", matched_ratio(F.col("_x"), F.col("_y")))
    return keyed.join(ratios, ["_x", "_y"], "left").withColumn("alike", F.coalesce(F.col("_ratio") >= LEAST, held)).drop("_x", "_y", "_ratio")


def edit_ratio(a: str, b: str) -> Column:
    """The native relative: one minus edit distance over the longer length."""
    return F.round(1 - F.levenshtein(a, b) / F.greatest(F.length(a), F.length(b), F.lit(1)), 6)
