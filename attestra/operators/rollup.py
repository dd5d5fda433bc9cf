"""Per-bid roll-up: statuses, capped score, risk, pending items, recommendation, review queue."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Weights, multipliers and caps of the score.
BASE_WEIGHT = {True: 10.0, False: 4.0}
SEVERITY_WEIGHT = {"CRITICAL": 1.5, "MAJOR": 1.0, "MINOR": 0.6, "INFO": 0.4}
FAIL_CAP, MISSING_CAP, CONTRADICTION_CAP = 40.0, 55.0, 65.0
# Of each level of risk its least score, the most that factors add and what each adds; and the least score that needs no look.
RISK_BANDS = {"CRITICAL": (0.90, 0.10, 0.02), "HIGH": (0.65, 0.20, 0.03), "MEDIUM": (0.35, 0.25, 0.04), "LOW": (0.05, 0.15, 0.02)}
LEAST_SCORE = 75


FAILS, PASSES, OPEN = ("FAIL", "OVERRIDDEN_FAIL"), ("PASS", "OVERRIDDEN_PASS"), ("REVIEW", "PARTIAL")
BAD_CHECKS = ("IDENTITY_MISMATCH", "SUSPENDED", "INACTIVE")
QUEUED_CHECKS = ("IDENTITY_MISMATCH", "INACTIVE", "SUSPENDED", "REVIEW", "UNVERIFIED", "UNAVAILABLE")
ISSUE_CHECKS = ("IDENTITY_MISMATCH", "INACTIVE", "UNAUTHORIZED", "REVOKED", "REVIEW", "UNAVAILABLE", "ERROR", "UNVERIFIED")


def _weights() -> tuple[Column, Column, Column, Column]:
    """(applies, weight, earned, unsure) of a result; one that does not apply weighs nothing."""
    w = F.when(F.col("mandatory"), BASE_WEIGHT[True]).otherwise(BASE_WEIGHT[False])
    m = F.lit(1.0)
    for k, v in SEVERITY_WEIGHT.items():
        m = F.when(F.col("severity") == k, v).otherwise(m)
    applies = (F.col("applicability") != "NOT_APPLICABLE") & (F.col("status") != "N/A")
    unsure = (F.col("applicability") == "UNKNOWN_REVIEW") & (F.col("status") == "PASS")
    part = F.when(unsure, 0.5).when(F.col("status").isin(*PASSES), 1.0).when(F.col("status") == "PARTIAL", 0.5).when(F.col("status") == "REVIEW", 0.25).otherwise(0.0)
    weight = F.when(applies, w * m).otherwise(0.0)
    return applies, weight, weight * part, unsure


def result_tally(results: DataFrame) -> DataFrame:
    """One row a bid with all that its results add up to, in one pass."""
    s, sev = F.col("status"), F.col("severity")
    fails, live = s.isin(*FAILS), F.col("applicability") != "NOT_APPLICABLE"
    applies, weight, earned, unsure = _weights()
    code = risk_code()
    return results.groupBy("bid_id").agg(
        F.count_if(fails & (sev == "CRITICAL")).alias("critical"), F.count_if(fails & (sev != "CRITICAL")).alias("major"), F.count_if(s == "MISSING").alias("missing"),
        F.count_if(s.isin(*OPEN)).alias("review"), F.count_if(s.isin(*PASSES)).alias("passed"), F.count("*").alias("total"),
        F.count_if(applies).alias("applicable"), F.count_if(applies & s.isin(*PASSES) & ~unsure).alias("live_passed"), F.count_if(live & fails).alias("live_failed"),
        F.count_if(live & (s == "MISSING")).alias("live_missing"), F.count_if(live & (unsure | s.isin(*OPEN))).alias("under_review"), F.sum(weight).alias("possible"), F.sum(earned).alias("earned"),
        F.bool_or(live & fails & F.col("mandatory")).alias("mandatory_fail"), F.bool_or(live & (s == "MISSING") & F.col("mandatory")).alias("mandatory_missing"),
        F.count_if(code == "MANDATORY_CRITICAL_FAILURE").alias("critical_factors"), F.count_if(code.isin("MANDATORY_REQUIREMENT_FAILURE", "MANDATORY_EVIDENCE_MISSING")).alias("high_factors"), F.count_if(code == "UNRESOLVED_COMPLIANCE_REVIEW").alias("medium_factors"),
        F.count_if((s == "FAIL") & sev.isin("CRITICAL", "MAJOR")).alias("fails"), F.count_if(live & F.col("mandatory") & (s == "MISSING")).alias("lacking"), F.count_if(queued_result()).alias("queued_results"),
    )


def _grave() -> Column:
    return F.col("severity").isin("HIGH", "CRITICAL") | F.regexp_like("finding_type", F.lit("NAME|GSTIN|PAN"))


def finding_tally(findings: DataFrame) -> DataFrame:
    """One row a bid that has findings which no officer has dismissed."""
    contradiction = F.col("status") == "CONTRADICTION"
    kept = findings.filter("status not in ('DISMISSED', 'DISMISSED_BY_OFFICER')")
    return kept.groupBy("bid_id").agg(
        F.count_if(contradiction).alias("contradictions"), F.count_if(F.col("status") == "REVIEW").alias("integrity_reviews"), F.count_if(contradiction & F.col("severity").isin("HIGH", "CRITICAL")).alias("high_contradictions"),
        F.count_if(contradiction & _grave()).alias("grave_contradictions"), F.count("*").alias("n_findings"),
    )


def check_tally(checks: DataFrame) -> DataFrame:
    of = lambda names: F.count_if(F.col("status").isin(*names))
    away = F.count_if(F.col("status").isin("UNAVAILABLE", "ERROR") & F.col("registry").isin("PAN", "UDYAM"))
    return checks.groupBy("bid_id").agg(of(BAD_CHECKS).alias("bad_checks"), of(QUEUED_CHECKS).alias("queued_checks"), of(ISSUE_CHECKS).alias("issue_checks"), away.alias("away_checks"))


def warning_tally(warnings: DataFrame) -> DataFrame:
    return warnings.groupBy("bid_id").agg(F.count("*").alias("n_warnings"))


def tally(bids: DataFrame, results: DataFrame, findings: DataFrame, checks: DataFrame, debarment: DataFrame, warnings: DataFrame) -> DataFrame:
    """One row a bid with everything that statuses, score, risk and recommendation are made of.

    Each input is added up by bid on its own, so that what meets in the joins is one row a bid.
    """
    out = bids.select("bid_id").join(debarment, "bid_id", "left")
    for part in (result_tally(results), finding_tally(findings), check_tally(checks), warning_tally(warnings)):
        out = out.join(part, "bid_id", "left")
    flags = ("debarred", "mandatory_fail", "mandatory_missing")
    zero = {c: F.coalesce(F.col(c), F.lit(False) if c in flags else F.lit(0.0) if c in ("possible", "earned") else F.lit(0).cast("long")) for c in out.columns if c != "bid_id"}
    return out.withColumns(zero)


def compliance_status() -> Column:
    return F.when(F.col("total") == 0, "REVIEW").when((F.col("critical") > 0) | (F.col("major") > 0), "FAIL").when(F.col("missing") > 0, "MISSING").when(F.col("review") > 0, "REVIEW").when(F.col("passed") == F.col("total"), "PASS").otherwise("PARTIAL")


def compliance(results: DataFrame) -> DataFrame:
    """Status counts of each bid and the status they lead to."""
    return result_tally(results).select("bid_id", "critical", "major", "missing", "review", "passed", "total", compliance_status().alias("compliance_status"))


def integrity_status() -> Column:
    return F.when(F.col("contradictions") > 0, "CONTRADICTION").when(F.col("integrity_reviews") > 0, "REVIEW").otherwise("CONSISTENT")


def scores(tally: DataFrame) -> DataFrame:
    """Raw and capped score of each bid."""
    raw = F.when(F.col("possible") > 0, F.greatest(F.lit(0.0), F.least(F.lit(100.0), F.col("earned") / F.col("possible") * 100))).otherwise(100.0)
    joined = tally.withColumn("raw_score", raw)
    first = F.when(F.col("debarred"), 0.0).when(F.col("mandatory_fail"), F.least("raw_score", F.lit(FAIL_CAP))).when(F.col("mandatory_missing"), F.least("raw_score", F.lit(MISSING_CAP))).otherwise(F.col("raw_score"))
    contra = (F.col("high_contradictions") > 0) & ~F.col("debarred") & ~F.col("mandatory_fail")
    final = F.when(contra, F.least(first, F.lit(CONTRADICTION_CAP))).otherwise(first)
    reason = F.when(F.col("debarred"), "DEBARMENT").when(contra & (first > CONTRADICTION_CAP), "CONTRADICTION").when(first < F.col("raw_score"), F.when(F.col("mandatory_fail"), "MANDATORY_FAIL").otherwise("MANDATORY_MISSING")).otherwise("NONE")
    return joined.withColumns({"final_score": final, "cap": reason})


def risk_code() -> Column:
    """The risk factor that a result is, null if none."""
    s, sev = F.col("status"), F.col("severity")
    return F.when((s == "FAIL") & (sev == "CRITICAL"), "MANDATORY_CRITICAL_FAILURE").when(s == "FAIL", "MANDATORY_REQUIREMENT_FAILURE").when(s == "MISSING", F.when(sev.isin("CRITICAL", "MAJOR"), "MANDATORY_EVIDENCE_MISSING")).when(s.isin(*OPEN) | F.col("requires_review"), "UNRESOLVED_COMPLIANCE_REVIEW")


def risk_factors(results: DataFrame, findings: DataFrame, checks: DataFrame, debarment: DataFrame, warnings: DataFrame) -> DataFrame:
    """(bid_id, code, severity) of every signal that adds to risk."""
    level = F.when(F.col("code") == "MANDATORY_CRITICAL_FAILURE", "CRITICAL").when(F.col("code") == "UNRESOLVED_COMPLIANCE_REVIEW", "MEDIUM").otherwise("HIGH")
    from_results = results.withColumn("code", risk_code()).filter("code is not null").select("bid_id", "code", level.alias("severity"))
    from_findings = findings.filter("status = 'CONTRADICTION'").select("bid_id", F.when(_grave(), "IDENTITY_OR_CRITICAL_CONTRADICTION").otherwise("CROSS_DOCUMENT_CONTRADICTION").alias("code"), F.when(_grave(), "CRITICAL").otherwise("HIGH").alias("severity"))
    wrong, away = F.col("status").isin(*BAD_CHECKS), F.col("status").isin("UNAVAILABLE", "ERROR") & F.col("registry").isin("PAN", "UDYAM")
    from_checks = checks.filter(wrong | away).select("bid_id", F.when(wrong, "GOVERNMENT_REGISTRY_MISMATCH").otherwise("CRITICAL_GOVERNMENT_UNAVAILABLE").alias("code"), F.lit("HIGH").alias("severity"))
    from_lists = debarment.filter("debarred").select("bid_id", F.lit("DEBARMENT_DETECTED").alias("code"), F.lit("CRITICAL").alias("severity"))
    from_warnings = warnings.select("bid_id", F.lit("EVIDENCE_GROUNDING_WARNING").alias("code"), F.lit("MEDIUM").alias("severity"))
    return from_results.unionByName(from_findings).unionByName(from_checks).unionByName(from_lists).unionByName(from_warnings)


def risk(tally: DataFrame) -> DataFrame:
    """``tally`` with level, risk_score and n_factors: the worst severity sets the band, the number of factors the place in it."""
    c = F.col
    critical = c("critical_factors") + c("grave_contradictions") + c("debarred").cast("long")
    high = c("high_factors") + c("contradictions") - c("grave_contradictions") + c("bad_checks") + c("away_checks")
    medium = c("medium_factors") + c("n_warnings")
    n = critical + high + medium
    band = {name: F.lit(base) + F.least(F.lit(cap), n * step) for name, (base, cap, step) in RISK_BANDS.items()}
    score = F.when(critical > 0, band["CRITICAL"]).when(high > 0, band["HIGH"]).when(medium > 0, band["MEDIUM"]).otherwise(band["LOW"])
    level = F.when(critical > 0, "CRITICAL").when(high > 0, "HIGH").when(medium > 0, "MEDIUM").otherwise("LOW")
    return tally.withColumns({"level": level, "risk_score": F.least(F.lit(1.0), score), "n_factors": n})


def expected_registry() -> Column:
    """The registry that a requirement's field or category asks for."""
    f, category = F.lower(F.coalesce("field", F.lit(""))), F.lower(F.coalesce("category", F.lit("")))
    has = lambda *words: F.regexp_like(f, F.lit("|".join(words)))
    return (
        F.when(has("pan") | F.contains(category, F.lit("pan")), "API_SETU_PAN_VERIFICATION")
        .when(has("udyam", "msme"), "API_SETU_UDYAM_VERIFICATION")
        .when(has("epfo", "uan"), "API_SETU_EPFO_VERIFICATION")
        .when(has("esic", "ip_number"), "API_SETU_ESIC_VERIFICATION")
        .when(has("dpiit", "startup"), "API_SETU_DPIIT_VERIFICATION")
        .when(has("debarment", "blacklist"), "DEBARMENT_REGISTRY_CHECK")
    )


def pending(results: DataFrame, checks: DataFrame, debarment: DataFrame) -> DataFrame:
    """Applicable requirements that have not cleanly passed, with the kind of deficiency, what the registry says, and what the bidder should do."""
    open_items = results.filter("applicability <> 'NOT_APPLICABLE' and not (status = 'PASS' and not requires_review)").withColumn("registry_expected", expected_registry())
    told = checks.select("bid_id", F.concat(F.lit("API_SETU_"), "registry", F.lit("_VERIFICATION")).alias("registry_expected"), F.concat_ws(": ", "registry", "status").alias("registry_result"))
    told = told.unionByName(debarment.select("bid_id", F.lit("DEBARMENT_REGISTRY_CHECK").alias("registry_expected"), F.when(F.col("debarred"), "DEBARMENT: DEBARRED").otherwise("DEBARMENT: CLEAR").alias("registry_result")))
    known = open_items.join(told, ["bid_id", "registry_expected"], "left")
    unverified = F.coalesce(F.regexp_like("registry_result", F.lit("NOT_FOUND|NOT_VERIFIED|UNAVAILABLE")), F.lit(False))
    kind = F.when(F.col("status") == "MISSING", "MISSING_DOCUMENT").when(F.col("status") == "FAIL", "DEFICIENT_VALUE").when(unverified, "UNVERIFIED_GOVERNMENT").otherwise("AMBIGUOUS_EVIDENCE")
    k = F.col("deficiency_type")
    action = F.when(k == "MISSING_DOCUMENT", F.concat(F.lit("Submit a document that proves "), "requirement_id")).when(k == "DEFICIENT_VALUE", F.concat(F.lit("Submit evidence for "), F.coalesce("expected_value", F.lit("")), F.lit(" instead of "), F.coalesce("actual", F.lit("")))).when(k == "UNVERIFIED_GOVERNMENT", F.concat(F.lit("Verify with "), "registry_expected")).otherwise("Officer review")
    return known.withColumn("deficiency_type", kind).select("bid_id", "requirement_id", "mandatory", "applicability", "status", "deficiency_type", "registry_expected", "registry_result", (F.col("requires_review") | (F.col("status") != "PASS")).alias("requires_review"), action.alias("action"))


def overall(tally: DataFrame) -> DataFrame:
    """``tally`` with compliance, integrity and overall status of each bid, and whether a person has to look."""
    items = F.col("queued_results") + F.col("n_findings") + F.col("debarred").cast("long") + F.col("queued_checks") + F.col("n_warnings")
    out = tally.withColumns({"compliance_status": compliance_status(), "integrity_status": integrity_status(), "n_items": items})
    c = F.col("compliance_status")
    status = F.when(F.col("debarred") | (c == "FAIL"), "FAIL").when(c.isin("MISSING", "REVIEW"), "REVIEW").when((c == "PASS") & (F.col("integrity_status") == "CONSISTENT") & (F.col("n_items") == 0), "PASS").otherwise("REVIEW")
    anomalies = F.col("contradictions") + F.col("integrity_reviews") + F.col("debarred").cast("long")
    return out.withColumn("overall_status", status).withColumns({"review_required": (F.col("overall_status") == "REVIEW") | (F.col("n_items") > 0), "anomalies": anomalies})


def recommendation(tally: DataFrame) -> DataFrame:
    """(bid_id, verdict, confidence, n_critical_issues) from a tally with scores and risk."""
    c = F.col
    issues = c("debarred").cast("long") + c("fails") + c("lacking") + c("high_contradictions") + c("issue_checks")
    fail = c("debarred") | (c("fails") > 0)
    look = (issues > 0) | c("level").isin("HIGH", "CRITICAL") | (c("under_review") > 0) | (c("final_score") < LEAST_SCORE)
    sure = fail | ~look | (c("high_contradictions") > 0) | (c("lacking") > 0)
    return risk(scores(tally)).select("bid_id", F.when(fail, "FAIL").when(look, "REVIEW").otherwise("PASS").alias("verdict"), F.when(sure, "HIGH").otherwise("MEDIUM").alias("confidence"), issues.alias("n_critical_issues"))


def queued_result() -> Column:
    return F.col("requires_review") | F.col("status").isin("REVIEW", "PARTIAL", "MISSING")


def review_queue(results: DataFrame, findings: DataFrame, checks: DataFrame, debarment: DataFrame, warnings: DataFrame) -> DataFrame:
    """(bid_id, category, severity, related, source_order): everything a person has to look at."""
    c = F.col
    item = lambda df, order, category, severity, related: df.select("bid_id", category.alias("category"), severity.alias("severity"), related.alias("related"), F.lit(order).alias("source_order"))
    parts = [
        item(results.filter(queued_result()), 1, F.when(c("status") == "MISSING", "MISSING_EVIDENCE").otherwise("AMBIGUOUS_COMPLIANCE"), c("severity"), c("requirement_id")),
        item(findings, 2, F.lit("INTEGRITY_CONTRADICTION"), F.when(c("severity") == "HIGH", "CRITICAL").otherwise("MAJOR"), finding_id()),
        item(debarment.filter("debarred"), 3, F.lit("DEBARMENT_ALERT"), F.lit("CRITICAL"), F.lit("DEBARMENT")),
        item(checks.filter(c("status").isin(*QUEUED_CHECKS)), 4, F.lit("GOVERNMENT_MISMATCH"), F.lit("MAJOR"), c("registry")),
        item(warnings, 5, F.lit("GROUNDING_WARNING"), F.lit("MINOR"), c("related")),
    ]
    out = parts[0]
    for more in parts[1:]:
        out = out.unionByName(more)
    return out


def finding_id() -> Column:
    """What names a finding inside its bid: the field and both facts."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("null"))
    six = lambda c: F.when(F.length(text(c)) < 6, F.lpad(text(c), 6, "0")).otherwise(text(c))
    return F.concat_ws("-", text("field"), text("raw_field_a"), six("seq_a"), text("raw_field_b"), six("seq_b"))  # plain parts: a formatter costs microseconds a row


def numbered(items: DataFrame, prefix: str, order: list[str]) -> DataFrame:
    """``items`` with running ids inside each bid."""
    n = F.row_number().over(Window.partitionBy("bid_id").orderBy(*order))
    return items.withColumn("running_id", F.format_string(f"{prefix}-%d-%03d", "bid_id", n))
