"""Verification of all requirements against all bids."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attestra.functions import predicates

from . import resolve

#: A table of judgements goes to every executor up to so many rows (some 100 bytes each); a larger one is joined by a shuffle.
MOST_JUDGED = 500_000
CLAUSE = ("requirement_id", "category", "field", "operator", "expected_value", "mandatory", "is_effective", "superseded_by", "supersedes", "mse_exemption_allowed", "startup_exemption_allowed", "require_explicit_claim")


def asked(requirements: DataFrame, bids: DataFrame, summary: DataFrame, *more: Column) -> DataFrame:
    """A row for each bid and requirement of its tender, with the bid's profile and applicability; ``more`` as in ``resolve.standing``.

    Requirements are a list of clauses and broadcast; bids keep their partitioning.  What is known
    of bids is never broadcast: its files are small and its rows are not, so that Spark would
    take tables of gigabytes for small ones.
    """
    effective = resolve.clauses(resolve.with_canonical(resolve.precedence(requirements), "field").withColumnRenamed("canonical", "asked_canonical"))
    place, outcomes = resolve.applicability()
    rows = bids.join(resolve.standing(summary, *more).hint("merge"), "bid_id", "left").join(F.broadcast(effective), "tender_id").withColumn("_place", place)
    return rows.withColumn("_outcome", F.get(outcomes, F.col("_place"))).select("*", "_outcome.*").drop("_place", "_outcome")


def _first_answers(requirements: DataFrame, bids: DataFrame) -> tuple[Column, DataFrame]:
    """Of rows that ``resolve.by_bid`` gives: ``_answers``, the facts that answer the fields asked for, a place a field; and ``requirements`` with the place of each in ``_at``.

    So a requirement finds its fact in the bid's own row, by its place.
    """
    clauses = resolve.with_canonical(requirements.select("field").filter("field is not null").distinct(), "field").collect()  # fields asked for
    known = resolve.canonicals(bids.sparkSession, [c for c in bids.columns if c != "bid_id"])
    part = lambda f, c: F.col(f"{f}.first.{c}").alias(c)
    fact = lambda f: F.when(F.col(f).isNotNull(), F.struct(part(f, "fact_seq"), F.lit(f).alias("field"), *[part(f, c) for c in ("value", "source_document", "page", "extraction_confidence")]))
    names, answers = [], []
    for r in clauses:
        own = [fact(f) for f in known if f == r["field"].lower()]
        alike = [fact(f) for f, canonical in known.items() if canonical is not None and canonical == r["canonical"]]
        found = own + [F.least(*alike) if len(alike) > 1 else x for x in alike[:1]]
        if found:
            names.append(r["field"])
            answers.append(F.coalesce(*found))
    at = F.lit(None).cast("int")
    for k, name in enumerate(names):
        at = F.when(F.col("field") == name, k).otherwise(at)
    none = F.lit(None).cast("struct<fact_seq int, field string, value string, source_document string, page int, extraction_confidence string>")
    return F.array(*(answers or [none])).alias("_answers"), requirements.withColumn("_at", at)


def _answers(requirements: DataFrame, summary: DataFrame) -> DataFrame:
    """(bid_id, _answers): a bid's first facts of the fields that requirements ask for, or that stand for the same, in their order; fields asked for bound them.

    So a requirement finds its fact in the bid's own row, and no row of a bid and a requirement is shuffled.
    """
    wanted = resolve.with_canonical(requirements.select("field"), "field")
    fact = F.struct("fact_seq", "field", "canonical", "value", "source_document", "page", "extraction_confidence")
    asked_fields = F.broadcast(wanted.select(F.lower("field").alias("_asked")).distinct())  # a list of clauses
    asked_canonical = F.broadcast(wanted.select(F.col("canonical").alias("_asked")).filter("_asked is not null").distinct())
    first = resolve.first_facts(summary)
    marked = first.join(asked_fields, F.col("field") == F.col("_asked"), "left").withColumnRenamed("_asked", "_own").join(asked_canonical, F.col("canonical") == F.col("_asked"), "left")
    kept = marked.filter("_own is not null or _asked is not null")
    return kept.groupBy("bid_id").agg(F.sort_array(F.collect_list(fact)).alias("_answers"))


def matched(requirements: DataFrame, bids: DataFrame, summary: DataFrame) -> DataFrame:
    """``asked`` with the fact that answers each requirement, and how its exemption stands.

    The first fact of the requirement's own field answers it; where the bid has none, the first
    of any field with the same canonical field does.
    """
    if "field" not in summary.columns:  # a row a bid already
        answers, placed = _first_answers(requirements, summary)
        found = asked(placed, bids, summary, answers).withColumn("fact", F.get("_answers", F.col("_at")))
    else:
        rows = asked(requirements, bids.join(_answers(requirements, summary).hint("merge"), "bid_id", "left"), summary).withColumn("_field", F.lower("field"))
        answer = lambda key, c: F.get(F.filter("_answers", lambda x: x[key] == F.col(c)), F.lit(0))
        found = rows.withColumn("fact", F.coalesce(answer("field", "_field"), answer("canonical", "asked_canonical")))
    mse, startup, certified = F.col("claims_mse"), F.col("claims_startup"), F.col("certified")
    basis = (
        F.when(~F.col("is_effective"), "SUPERSEDED")
        .when(F.col("mse_exemption_allowed") & mse, "EXEMPT")
        .when(F.col("mse_exemption_allowed") & mse.isNull() & F.col("require_explicit_claim"), "UNCLAIMED")
        .when(F.col("startup_exemption_allowed") & startup & certified, "EXEMPT")
        .when(F.col("startup_exemption_allowed") & (startup | (startup.isNull() & F.col("require_explicit_claim"))), "UNCLAIMED")
        .when(F.col("fact").isNull(), "ABSENT")
        .otherwise("EVALUATED")
    )
    return found.select("bid_id", "tender_id", *CLAUSE, "applicability", "applicability_rule", basis.alias("basis"), F.col("asked_canonical").alias("canonical"), F.col("fact.value").alias("actual"), "fact.source_document", "fact.page", "fact.extraction_confidence")


def judged(matched: DataFrame, known: DataFrame, reference_date: str) -> DataFrame:
    """(operator, actual, expected, status, asks) of what ``matched`` asks for, each once; ``known`` has the readings of values."""
    asked_for = matched.filter("basis = 'EVALUATED'").select("operator", "actual", F.col("expected_value").alias("expected"))
    return predicates.judge(asked_for, known, reference_date)


def results(matched: DataFrame, judged: DataFrame) -> DataFrame:
    """One result for each bid and requirement, from written tables of both.

    Superseded clauses and verified exemptions are N/A; an exemption that has to be claimed
    and is not is for review; no fact is MISSING; otherwise the operator has decided.
    """
    outcome = judged.select(F.col("operator").alias("_op"), F.col("actual").alias("_a"), F.col("expected").alias("_e"), F.col("status").alias("found"), "asks")
    if judged.count() <= MOST_JUDGED:
        outcome = F.broadcast(outcome)
    same = (F.trim("operator") == F.col("_op")) & (F.col("actual") == F.col("_a")) & F.col("expected_value").eqNullSafe(F.col("_e")) & (F.col("basis") == "EVALUATED")
    joined = matched.join(outcome, same, "left")
    b = F.col("basis")
    status = F.when(b.isin("SUPERSEDED", "EXEMPT"), "N/A").when(b == "UNCLAIMED", "REVIEW").when(b == "ABSENT", "MISSING").otherwise(F.coalesce("found", F.lit("MISSING")))
    severity = F.when(b.isin("SUPERSEDED", "EXEMPT"), "INFO").when(b == "UNCLAIMED", "MAJOR").when((b == "ABSENT") & F.col("mandatory"), "CRITICAL").when(b == "ABSENT", "MINOR").otherwise(predicates.severity(F.col("status"), F.col("mandatory")))
    review = F.when(b.isin("SUPERSEDED", "EXEMPT"), False).when(b == "UNCLAIMED", True).when(b == "ABSENT", F.col("mandatory")).otherwise(F.coalesce("asks", F.lit(True)) | (F.coalesce("extraction_confidence", F.lit("")) == "LOW"))
    return joined.withColumn("status", status).select("bid_id", "tender_id", "requirement_id", "category", "field", "canonical", "operator", "mandatory", "applicability", "applicability_rule", "basis", "superseded_by", "status", severity.alias("severity"), review.alias("requires_review"), "actual", "expected_value", "source_document", "page")
