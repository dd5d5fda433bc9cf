"""Best text versions of pages, the requirement chain, gold matches and the file manifest."""

import hashlib
import json
import os

from attestra.operators import extraction, text
from attestra.sources import files

GOOD = "Tender clause 4: turnover of 5 crore and delivery in 30 days, as per annexure and schedule, from the company"


def test_best_version(spark):
    junk = "\x01" * 40
    rows = [
        (1, 1, 0, GOOD + " and more", None, True), (1, 1, 1, GOOD, 0.9, True),  # the file's own text is longer
        (1, 2, 0, "", None, True), (1, 2, 1, GOOD, 0.5, True), (1, 2, 2, GOOD, 0.9, True),  # the better score
        (1, 3, 0, "short", None, True), (1, 3, 1, GOOD, 0.7, True), (1, 3, 2, GOOD, 0.7, True),  # equal scores: the earlier pass
        (1, 4, 0, None, None, True), (1, 4, 1, junk, 0.9, True), (1, 4, 2, GOOD, 0.9, False),  # neither is valid
        (2, 1, 1, GOOD, 0.9, True),  # nothing but a pass
    ]
    best = text.best_version(spark.createDataFrame(rows, "doc_id int, page_number int, pass int, text string, sure double, success boolean"))
    got = {(r["doc_id"], r["page_number"]): (r["method"], r["pass"], r["n_chars"]) for r in best.collect()}
    assert got == {(1, 1): ("NATIVE_PDF", 0, len(GOOD) + 9), (1, 2): ("OCR", 2, len(GOOD)), (1, 3): ("OCR", 1, len(GOOD)), (1, 4): ("NATIVE_PDF", 0, 0), (2, 1): ("OCR", 1, len(GOOD))}
    whole = {r["doc_id"]: (r["n_pages"], r["method"], r["confidence"]) for r in text.document_rollup(best).collect()}
    assert whole == {1: (4, "HYBRID", "LOW"), 2: (1, "OCR", "HIGH")}


def test_requirement_chain(spark):
    claim = lambda **k: {"description": "d", "category": "CERTIFICATION", "field": "warranty_years", "operator": ">=", "expected_value": "2 years", "mandatory": True, "evidence_block_ids": ["b1"]} | k
    asked = [claim(), claim(expected_value="24 months"), claim(operator="~"), claim(field="x", category="?", expected_value="9"), claim(field="y", evidence_block_ids=["nowhere"]), claim(field="z", description=None), claim(field="w", mandatory=None), claim(field="border", description="Land border undertaking, registration with the competent authority", expected_value=None)]
    payloads = spark.createDataFrame([("t1", "```json\n" + json.dumps({"requirements": asked}) + "\n```"), ("t2", "no json"), ("t3", None)], "doc_id string, payload string")
    blocks = spark.createDataFrame([("t1", "b1", 1, "warranty of 2 years or 24 months")], "doc_id string, block_id string, page_number int, text string")
    got = sorted((r["field"], r["category"], r["operator"], r["normalised"], r["n"], r["grounding"]) for r in extraction.requirements(payloads, blocks).collect())
    assert got == [
        ("land_border_compliance_undertaking", "LEGAL_UNDERTAKING", "EXISTS", None, 1, "ACCEPTED"), ("land_border_registration", "STATUTORY_ELIGIBILITY", "==", None, 1, "ACCEPTED"),
        ("warranty_years", "CERTIFICATION", ">=", "24", 2, "ACCEPTED"), ("x", "OTHER", ">=", "9", 1, "REVIEW_REQUIRED"),
    ]


def test_gold_matches(spark):
    gold = spark.createDataFrame([("g1", "d", "C", "f", "F", "1", ["a", "b"]), ("g2", "d", "C", "f", "F", "2", ["c"]), ("g3", "d", "C", "other", None, "1", ["a"]), ("g4", "d", "E", "f", "F", "1", ["z"]), ("g5", "x", "E", "f", "F", "1", ["a"])], "gold_id string, doc_id string, category string, field string, canonical string, normalised string, blocks array<string>")
    found = spark.createDataFrame([("e1", "d", "f", "F", "1", ["a"]), ("e2", "d", "f", "F", "1", ["b", "a", "a"]), ("e3", "d", "f2", "F", "7", ["c"])], "found_id string, doc_id string, field string, canonical string, normalised string, blocks array<string>")
    matches = extraction.gold_matches(gold, found)
    assert {r["gold_id"]: (r["match"], r["found_id"], r["shared"]) for r in matches.collect()} == {"g1": ("EXACT", "e2", 2), "g2": ("SEMANTIC", "e3", 1), "g3": ("SEMANTIC", "e2", 1), "g4": ("MISSED", None, 0), "g5": ("MISSED", None, 0)}
    assert {r["category"]: (r["gold"], r["exact"], r["semantic"], r["missed"], r["recall"]) for r in extraction.gold_recall(matches).collect()} == {"C": (3, 1, 2, 0, 1.0), "E": (2, 0, 0, 2, 0.0)}


def test_file_manifest_against_plain_hashes(spark, small):
    found = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").load(small)
    rows = {r["file"]: (r["bytes"], r["sha256"], r["manifest"]) for r in files.manifest(found).collect()}
    want = {}
    for name in os.listdir(small):
        with open(os.path.join(small, name), "rb") as f:
            data = f.read()
        want[name] = (len(data), hashlib.sha256(data).hexdigest())
    whole = hashlib.sha256(";".join(f"{n}:{h}" for n, (_, h) in sorted(want.items())).encode()).hexdigest()
    assert rows == {n: (*x, whole) for n, x in want.items()}
