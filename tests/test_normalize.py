import datetime
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from attestra.functions import identifiers, normalize
from attestra.sources import bridge


def one(spark, value, column):
    return spark.createDataFrame([(value,)], "v string").select(column(F.col("v")).alias("x")).first()["x"]


@pytest.mark.parametrize(("text", "expected"), [("10 crore", 100_000_000), ("31,00,000", 3_100_000), ("ISO 9001:2015", None), ("10 crs", None), ("Rs. 5 lakh", 500_000), ("", None), (None, None), ("3 years", None), ("-2.5", Decimal("-2.5"))])
def test_amount(spark, text, expected):
    assert one(spark, text, normalize.amount) == expected


@pytest.mark.parametrize(("text", "months"), [("3 years", 36), ("two years", 24), ("90 days", 3), ("36", 36), (None, None), ("none", None)])
def test_duration(spark, text, months):
    assert one(spark, text, normalize.duration) == months


@pytest.mark.parametrize(("text", "expected"), [("2026-09-01", (2026, 9, 1)), ("01-09-2026", (2026, 9, 1)), ("01/09/2026", (2026, 9, 1)), ("01-Sep-2026", (2026, 9, 1)), ("due on 01-09-2026 at noon", (2026, 9, 1)), ("NA", None), ("31-04-2026", None), (None, None)])
def test_date(spark, text, expected):
    assert one(spark, text, normalize.date) == (datetime.date(*expected) if expected else None)


@pytest.mark.parametrize(("text", "flag"), [("Yes", True), ("submitted", True), ("exempted", False), ("NA", False), ("maybe", None)])
def test_boolean(spark, text, flag):
    assert one(spark, text, normalize.boolean) is flag


@pytest.mark.parametrize(("text", "there"), [("0", True), ("false", True), ("Not available", False), ("  ", False), (None, False)])
def test_existence(spark, text, there):
    assert one(spark, text, normalize.exists) is there


def test_names_and_keys(spark):
    assert one(spark, "X Pvt. Ltd.", normalize.legal_name) == one(spark, "x private limited", normalize.legal_name)
    assert one(spark, " GST Number ", normalize.field_key) == "gst_number"
    assert one(spark, "01ABCDE0001F1Z1", identifiers.formats) == "GSTIN,DPIIT,SCHEME_CERTIFICATE,PENSION_ORDER"  # the latter may be any letters and digits


def test_requirements_have_one_winner_a_field(spark):
    from attestra.operators import resolve

    rows = resolve.precedence(bridge.requirements(spark)).filter("is_effective").groupBy("tender_id", "field").count().filter("count > 1").count()
    assert rows == 0
