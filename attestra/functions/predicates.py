"""The fifteen typed comparison operators.

``judge`` decides distinct (operator, actual, expected) and so reads each value once, however
many bids state it.  Operators are dealt to a few families, each a stage of its own, so that
every one stays small enough to be compiled.  A missing value never passes.
"""

from __future__ import annotations

import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from attestra.sources import files

from .normalize import Readings, with_readings


def _choice(holds: Column) -> Column:
    return F.when(holds, "PASS").otherwise("FAIL")


def _both(a: Readings, e: Readings, part: str) -> Column:
    return a[part].isNotNull() & e[part].isNotNull()


def _says(c: Readings, *words: str) -> Column:
    low = F.lower(c["raw"])
    return F.coalesce(F.greatest(*[F.contains(low, F.lit(w)) for w in words]) if len(words) > 1 else F.contains(low, F.lit(words[0])), F.lit(False))


def ordered(a: Readings, e: Readings, compare: Callable[[Column, Column], Column], *, ladder: bool) -> Column:
    """Durations if a unit is named, then amounts, then dates; without the ladder amounts alone."""
    out = F.when(_both(a, e, "num"), _choice(compare(a["num"], e["num"])))
    if ladder:
        named = _says(a, "year", "month", "day") | _says(e, "year", "month")
        out = F.when(_both(a, e, "months") & named, _choice(compare(a["months"], e["months"]))).otherwise(out)
        out = F.coalesce(out, F.when(_both(a, e, "day"), _choice(compare(a["day"], e["day"]))))
    return F.coalesce(out, F.lit("REVIEW"))


def equal(a: Readings, e: Readings) -> Column:
    words = ("yes", "no", "true", "false", "y", "n")
    as_words = F.coalesce(F.lower(a["raw"]).isin(*words), F.lit(False)) | F.coalesce(F.lower(e["raw"]).isin(*words), F.lit(False))
    named = _says(a, "year", "month", "day") | _says(e, "year", "month", "day")
    return (
        F.when(_both(a, e, "flag") & as_words, _choice(a["flag"] == e["flag"]))
        .when(_both(a, e, "months") & named, _choice(a["months"] == e["months"]))
        .when(_both(a, e, "num"), _choice(a["num"] == e["num"]))
        .otherwise(_choice(F.coalesce(a["cat"] == e["cat"], F.lit(False))))
    )


def _inverted(a: Readings, status: Column) -> Column:
    return F.when(~a["present"], "MISSING").when(status == "PASS", "FAIL").when(status == "FAIL", "PASS").otherwise(status)


def member(a: Readings, e: Readings) -> Column:
    return _choice(F.coalesce(F.array_contains(e["members"], a["cat"]), F.lit(False)))


def contains(a: Readings, e: Readings) -> Column:
    return _choice(F.coalesce(F.contains(F.lower(a["raw"]), F.lower(e["raw"])), F.lit(False)))


def matches(a: Readings, e: Readings) -> Column:
    """PASS, FAIL, or REVIEW for a pattern that does not compile; Spark's own pattern functions would fail the job.

    Runs on distinct values and patterns only, in Arrow batches.
    """

    def found(values: pd.Series, patterns: pd.Series) -> pd.Series:
        def one(value: str | None, pattern: str | None) -> str:
            if value is None or pattern is None:
                return "FAIL"
            try:
                return "PASS" if re.search(pattern, value, re.IGNORECASE) else "FAIL"
            except re.error:
                return "REVIEW"

        return pd.Series([one(v, p) for v, p in zip(values, patterns, strict=True)], dtype=object)

    return F.pandas_udf(found, StringType())(a["raw"], e["raw"])


def valid_on(a: Readings, reference: Column) -> Column:
    """A record of dates holds from its issue to its expiry unless marked void; any other value is read as an expiry date."""
    inside = (reference <= a["expires"]) & F.coalesce(a["issued"] <= reference, F.lit(True))
    return F.when(reference.isNull(), "REVIEW").when(a["void"], "FAIL").when(a["expires"].isNotNull(), _choice(inside)).when(a["raw"].startswith("{") | a["day"].isNull(), "REVIEW").otherwise(_choice(reference <= a["day"]))


def on_dates(a: Readings, e: Readings, compare: Callable[[Column, Column], Column]) -> Column:
    return F.when(_both(a, e, "day"), _choice(compare(a["day"], e["day"]))).otherwise("REVIEW")


def between(a: Readings, e: Readings) -> Column:
    return (
        F.when(a["num"].isNotNull() & e["low_num"].isNotNull() & e["high_num"].isNotNull(), _choice(a["num"].between(e["low_num"], e["high_num"])))
        .when(a["day"].isNotNull() & e["low_day"].isNotNull() & e["high_day"].isNotNull(), _choice(a["day"].between(e["low_day"], e["high_day"])))
        .otherwise("REVIEW")
    )


def _families(a: Readings, e: Readings, reference: Column) -> list[dict[str, Column]]:
    """The status of each operator, by families that share readings."""
    return [
        {">=": ordered(a, e, lambda x, y: x >= y, ladder=True), "<=": ordered(a, e, lambda x, y: x <= y, ladder=True), ">": ordered(a, e, lambda x, y: x > y, ladder=False), "<": ordered(a, e, lambda x, y: x < y, ladder=False)},
        {"==": equal(a, e), "!=": _inverted(a, equal(a, e)), "BETWEEN": between(a, e)},
        {"IN": member(a, e), "NOT_IN": _inverted(a, member(a, e)), "CONTAINS": contains(a, e), "EXISTS": F.when(a["present"], "PASS").otherwise("MISSING")},
        {"VALID_ON": valid_on(a, reference), "BEFORE": on_dates(a, e, lambda x, y: x < y), "AFTER": on_dates(a, e, lambda x, y: x > y)},
        {"MATCHES": matches(a, e)},
    ]


def readings(values: DataFrame) -> DataFrame:
    """(value, a_..): the readings of distinct values."""
    return with_readings(values.select("value").filter("value is not null").distinct(), F.col("value"), "a")


def judge(asked: DataFrame, known: DataFrame, reference_date: str) -> DataFrame:
    """(operator, actual, expected, status, asks) for distinct ``asked`` (operator, actual, expected).

    ``known`` has the readings of all actual values.  A missing or blank value is MISSING, and an
    operator that is none of the fifteen is for review; ``asks`` is whether a person must look.
    """
    a, e, reference = Readings("a"), Readings("e"), F.to_date(F.lit(reference_date))
    path = files.scratch(asked.sparkSession, "asked")
    asked.select(F.trim("operator").alias("operator"), "actual", "expected").distinct().write.parquet(path)  # small, and read by each family
    distinct = asked.sparkSession.read.schema("operator string, actual string, expected string").parquet(path)
    wanted = with_readings(distinct.select("expected").distinct(), F.col("expected"), "e", expected=True)
    typed = distinct.join(known, F.col("actual") == F.col("value")).drop("value").join(wanted.withColumnRenamed("expected", "_expected"), F.col("expected").eqNullSafe(F.col("_expected")))
    families = _families(a, e, reference)
    parts, named = [], [op for family in families for op in family]
    for family in families:
        status = F.lit(None).cast("string")
        for op, outcome in family.items():
            status = F.when(F.col("operator") == op, outcome).otherwise(status)
        parts.append(typed.filter(F.col("operator").isin(*family)).select("operator", "actual", "expected", status.alias("status")))
    parts.append(typed.filter(~F.col("operator").isin(*named)).select("operator", "actual", "expected", F.lit("REVIEW").alias("status")))
    out = parts[0]
    for more in parts[1:]:
        out = out.unionByName(more)
    blank = F.trim("actual") == ""
    decided = out.withColumn("status", F.when(blank, "MISSING").otherwise(F.col("status")))
    return decided.withColumn("asks", (F.col("status") == "REVIEW") | ((F.col("status") == "MISSING") & (F.col("operator") != "EXISTS")))


def severity(status: Column, mandatory: Column) -> Column:
    return F.when(status == "PASS", "INFO").when((status == "FAIL") & mandatory, "CRITICAL").when(status.isin("FAIL", "REVIEW", "PARTIAL"), "MAJOR").otherwise("MINOR")
