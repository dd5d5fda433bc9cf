"""Cases worked out by hand, from the rules that the operators follow."""

import pytest
from pyspark.sql import functions as F

from attestra.functions import identifiers, predicates, similarity
from attestra.operators import audit, extraction, integrity, resolve, text
from attestra.sources import files


def statuses(spark, rows, date="2026-09-01"):
    asked = spark.createDataFrame(rows, "operator string, actual string, expected string")
    got = predicates.judge(asked, predicates.readings(asked.select(F.col("actual").alias("value"))), date)
    return {(r["operator"], r["actual"], r["expected"]): (r["status"], r["asks"]) for r in got.collect()}


def test_operators(spark):
    cases = {
        (">=", "3 years", "36 months"): "PASS", ("<=", "60 days", "1 month"): "FAIL", (">", "2 crore", "200 lakh"): "FAIL", ("<", "text", "5"): "REVIEW", ("==", "Yes", "true"): "PASS", ("!=", "na", "x"): "MISSING", ("!=", "a", "b"): "PASS",
        ("IN", "yes", "No, YES"): "PASS", ("NOT_IN", "X", "x,y"): "FAIL", ("CONTAINS", "Some Text", "text"): "PASS", ("MATCHES", "abc", "[unclosed"): "REVIEW", ("MATCHES", "ABC", "^a"): "PASS", ("EXISTS", "na", None): "MISSING",
        ("BETWEEN", "3 crore", "2 crore to 4 crore"): "PASS", ("BEFORE", "2026-01-01", "2026-01-01"): "FAIL", ("AFTER", "nothing", "2026-01-01"): "REVIEW", ("~~", "x", "x"): "REVIEW", (">=", " ", "1"): "MISSING",
        ("VALID_ON", '{"issue_date":"2026-10-01","expiry_date":"2027-01-01"}', None): "FAIL", ("VALID_ON", '{"issue_date":"2026-01-01","expiry_date":"2027-01-01"}', None): "PASS", ("VALID_ON", '{"expiry_date":"2027-01-01","valid":false}', None): "FAIL",
        ("VALID_ON", '{"expiry_date":"2026-08-31"}', None): "FAIL", ("VALID_ON", '{"number":"7"}', None): "REVIEW", ("VALID_ON", "31-12-2026", None): "PASS", ("VALID_ON", "soon", None): "REVIEW",
    }
    got = statuses(spark, list(cases))
    assert {k: v[0] for k, v in got.items()} == cases
    assert got[("MATCHES", "abc", "[unclosed")][1] and not got[("EXISTS", "na", None)][1]


def test_fields_resolve(spark):
    names = {"GST Number": "GSTIN", "gstin": "GSTIN", "PAN": "PAN", "experience": None, "turnover_ratio": None, "Warranty-Period": "WARRANTY_DURATION", "nonsense": None, "": None, None: None, "net worth (cr)": "NET_WORTH"}
    got = resolve.resolve_fields(spark.createDataFrame([(n,) for n in names], "raw string"), "raw").collect()
    assert {r["raw"]: r["canonical"] for r in got} == names
    assert {r["raw"]: r["resolution"] for r in got}["experience"] == "AMBIGUOUS"


@pytest.mark.parametrize(
    ("value", "field", "said", "outcome"),
    [
        ("27ABCDE1234F1Z5", "gstin", "GSTIN: 27-ABCDE-1234-F1Z5", "EXACT_IDENTIFIER_MATCH"), ("27ABCDE1234F1Z5", "gstin", "no number", "IDENTIFIER_MISMATCH"), ("3 years", "warranty_years", "a warranty of 36 months", "DURATION_NORMALIZED_MATCH"), ("3 years", "warranty_years", "two years", "DURATION_MISMATCH"),
        ("5 crore", "turnover_cr", "turnover of Rs. 500 lakhs", "CURRENCY_MATCH"), ("5 crore", "turnover_cr", "turnover of 4 crore", "NUMERIC_MISMATCH"), ("Yes", "authorized_distributor", "the bidder is an authorized distributor", "BOOLEAN_AFFIRMED"),
        ("Yes", "authorized_distributor", "is not an authorized distributor", "NEGATED_BOOLEAN"), ("No", "is_startup", "anything", "BOOLEAN_NEGATIVE_ACCEPTED"), ("ISO 9001:2015", "standard", "ISO 14001:2015", "CODE_MISMATCH"), ("Acme Tools", "maker", "made by ACME TOOLS", "EXACT_SUBSTRING_MATCH"), ("", "maker", "x", "EMPTY_VALUE"),
        ("alpha beta gamma delta", "maker", "delta, gamma, beta", "TOKEN_CONTAINMENT_MATCH"), ("alpha beta", "maker", "none", "TEXT_UNSUPPORTED"),
    ],
)
def test_support(spark, value, field, said, outcome):
    row = spark.createDataFrame([(value, field, said)], "v string, f string, t string")
    assert row.select(text.support(F.col("v"), F.col("f"), F.col("t"))).first()[0] == outcome


def test_candidates_merge_in_order(spark):
    rows = [("d", 1, "Warranty Years", "3_years", False, "a", ["b1"]), ("d", 2, "warranty_years", "3 years", True, "longer", ["b1", "b2"]), ("d", 3, "warranty-years", "3years", False, "c", ["b2"]), ("d", 4, "warranty_years", "3 years", False, "d", ["b9"]), ("d", 5, "warranty_years", "4 years", False, "e", ["b1"])]
    got = extraction.merged(spark.createDataFrame(rows, "doc_id string, place int, field string, value string, mandatory boolean, description string, blocks array<string>"), ["place"]).collect()
    assert sorted((r["value_key"], r["n"], r["mandatory"], r["description"], tuple(r["blocks"])) for r in got) == [("3years", 1, False, "d", ("b9",)), ("3years", 3, True, "longer", ("b1", "b2")), ("4years", 1, False, "e", ("b1",))]


def test_cycles_are_found(spark):
    rows = [(1, "a", "b"), (1, "b", "c"), (1, "c", "a"), (2, "a", "b"), (2, "b", "c"), (3, "x", "x")]
    assert {r["bid_id"] for r in audit.cyclic_bids(spark.createDataFrame(rows, "bid_id int, src string, dst string")).collect()} == {1, 3}


def test_names_alike(spark):
    rows = [("Acme Tools", "acme tools ltd"), ("Acme Tools", "Zenith Foods"), ("Anderson Works", "Andersen Works"), (None, "x")]
    got = similarity.alike(spark.createDataFrame(rows, "a string, b string"), "a", "b").collect()
    from difflib import SequenceMatcher

    for r in got:
        x, y = (r["a"] or "").upper(), (r["b"] or "").upper()
        assert r["alike"] == (x in y or y in x or SequenceMatcher(None, x, y).ratio() >= 0.6)


def test_masks_and_details(spark):
    row = spark.createDataFrame([("24AAAAA0000A1Z5", "ABCDE1234F", "UDYAM-MH-01-0008776", "9876543210")], "g string, p string, u string, m string")
    got = row.select(*[identifiers.masked(F.col(c), k) for c, k in zip("gpum", ("GSTIN", "PAN", "UDYAM", "MOBILE"), strict=True)]).first()
    assert tuple(got) == ("24AAAA****0A1Z5", "ABCDE***4F", "UDYAM-MH-01-***8776", "******3210")


def test_findings_across_names_of_a_field(spark):
    rows = [(1, "turnover_cr", "5 crore", "D1", 1, "HIGH", 1), (1, "annual_turnover", "600 lakh", "D2", 2, "HIGH", 2), (1, "gstin", "a", "D1", 1, "HIGH", 1), (1, "gstin", "A ", "D2", 2, "HIGH", 2)]
    facts = spark.createDataFrame(rows, "bid_id int, field string, value string, source_document string, page int, extraction_confidence string, fact_seq int")
    got = integrity.findings(integrity.pairs(facts, predicates.readings(facts))).collect()
    assert [(r["field"], r["raw_field_a"], r["raw_field_b"], r["finding_type"]) for r in got] == [("ANNUAL_TURNOVER", "turnover_cr", "annual_turnover", "TURNOVER_CONTRADICTION")]


def test_scratch_needs_a_shared_folder_on_a_cluster():
    class Conf:
        def get(self, key, default):
            return default

    class Session:
        conf = Conf()
        sparkContext = type("Context", (), {"master": "spark://somewhere"})

    with pytest.raises(RuntimeError):
        files.scratch(Session(), "x")
