"""Layered replay: a snapshot keeps every layer of a verification as items with a digest a bid; a replay is compared with it from the digests down.

A layer is (bid_id, item, value).  Digests add up hashes of items, so neither order nor
partitioning matters and no bid is gathered in one row.  Two digests that differ open that
part of a layer of that bid alone; everything else is never compared item by item.  Items are not
written: digests are added up as they are made, and opened parts are made again.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attestra.functions import predicates
from attestra.sources import files

from . import audit, graph, integrity, resolve, rollup, verify

# What a mismatch in each layer is called, in the order in which they are looked at.
CATEGORIES = {
    "REQUIREMENT": "REQUIREMENT_MISMATCH", "FACT": "FACT_MISMATCH", "CANONICAL": "CANONICALIZATION_MISMATCH", "RESULT": "VERIFICATION_RESULT_MISMATCH", "FINDING": "INTEGRITY_FINDING_MISMATCH",
    "REVIEW": "REVIEW_ITEM_MISMATCH", "AGGREGATION": "AGGREGATION_MISMATCH", "NODE": "PROVENANCE_MISMATCH", "EDGE": "PROVENANCE_MISMATCH",
}
COMPLETE = "COMPLETE_MATCH"


@dataclass
class Inputs:
    """What a snapshot holds of the outside: all that a replay starts from."""

    bids: DataFrame
    requirements: DataFrame
    documents: DataFrame
    facts: DataFrame
    checks: DataFrame
    debarment: DataFrame
    decisions: DataFrame


@dataclass
class Outcome:
    """What a verification makes of its inputs."""

    results: DataFrame
    findings: DataFrame
    queue: DataFrame
    overall: DataFrame
    nodes: DataFrame
    edges: DataFrame


def warnings(summary: DataFrame) -> DataFrame:
    """(bid_id, related): facts of weight that were read with low confidence."""
    weak = resolve.first_facts(summary).filter("extraction_confidence = 'LOW' and field in ('gstin', 'turnover_cr')")
    return weak.select("bid_id", F.concat_ws("-", "field", "page").alias("related"))


def concluded(inputs: Inputs, results: DataFrame, findings: DataFrame, summary: DataFrame) -> Outcome:
    """Queue, roll-up and graph of results and findings."""
    signals = results, findings, inputs.checks, inputs.debarment, warnings(summary)
    queue = rollup.review_queue(*signals)
    overall = rollup.overall(rollup.tally(inputs.bids, *signals))
    edges = audit.edges(results, inputs.facts, findings, queue, inputs.checks, inputs.decisions)
    nodes = graph.nodes(inputs.bids, inputs.requirements, inputs.documents, inputs.facts, results, findings, queue, inputs.decisions, inputs.checks)
    return Outcome(results, findings, queue, overall, nodes, edges)


def run(inputs: Inputs, reference_date: str, written) -> Outcome:
    """Work everything out again from the inputs; ``written(name, df)`` gives back a table that is read more than once."""
    readings = written("readings", predicates.readings(inputs.facts))
    summary = written("summary", resolve.summary(inputs.facts))
    matched = written("matched", verify.matched(inputs.requirements, inputs.bids, summary))
    judged = written("judged", verify.judged(matched, readings, reference_date))
    results = written("results", verify.results(matched, judged))
    findings = written("findings", integrity.findings(integrity.pairs(inputs.facts, readings)))
    return concluded(inputs, results, findings, summary)


def items(inputs: Inputs, out: Outcome) -> DataFrame:
    """(layer, bid_id, item, value) of every layer."""
    joined = lambda *c: F.concat_ws("|", *[F.coalesce(F.col(x).cast("string"), F.lit("")) for x in c])
    layer = lambda name, df, item, value: df.select(F.lit(name).alias("layer"), "bid_id", item.alias("item"), value.alias("value"))
    c = F.col
    asked = inputs.bids.join(F.broadcast(inputs.requirements), "tender_id")  # a list of clauses
    named = resolve.with_canonical(inputs.facts.select("bid_id", "field").distinct(), "field")
    states = F.stack(F.lit(6), *[x for name in ("compliance_status", "integrity_status", "overall_status", "critical", "major", "anomalies") for x in (F.lit(name), c(name).cast("string"))]).alias("item", "value")
    return graph._union([
        layer("REQUIREMENT", asked, c("requirement_id"), joined("operator", "expected_value", "mandatory")),
        layer("FACT", inputs.facts, F.concat_ws("-", "field", "fact_seq"), joined("value", "source_document", "page")),
        layer("CANONICAL", named, c("field"), F.coalesce("canonical", F.lit(""))),
        layer("RESULT", out.results, c("requirement_id"), joined("status", "severity", "requires_review", "actual")),
        layer("FINDING", out.findings, rollup.finding_id(), joined("status", "finding_type", "severity")),
        layer("REVIEW", out.queue, F.concat_ws(":", "source_order", "related"), joined("category", "severity")),
        out.overall.select(F.lit("AGGREGATION").alias("layer"), "bid_id", states),
        layer("NODE", out.nodes, c("id"), c("node_type")),
        layer("EDGE", out.edges, F.concat_ws(">", "src", "kind", "dst"), F.lit("")),
    ])


def part() -> Column:
    """What part of its layer an item belongs to: of edges their kind, of nodes what their id begins with; made of the item alone, so it is the same on both sides."""
    item = F.col("item")
    return F.when(F.col("layer") == "EDGE", F.substring_index(F.substring_index(item, ">", 2), ">", -1)).when(F.col("layer") == "NODE", graph.start("item")).otherwise("")


def digests(items: DataFrame) -> DataFrame:
    """(layer, bid_id, part, n, digest): items and two sums of 64-bit hashes of them, which no order changes; sums are of the halves of hashes, in whole numbers."""
    hashes = [F.xxhash64(*salt, "item", "value") for salt in ((), (F.lit("second"),))]
    halves = [h for x in hashes for h in (F.shiftright(x, 32), x.bitwiseAND(0xFFFFFFFF))]
    counted = items.groupBy("layer", "bid_id", part().alias("part")).agg(F.count("*").alias("n"), *[F.sum(h).alias(f"s{k}") for k, h in enumerate(halves)])
    return counted.select("layer", "bid_id", "part", "n", F.concat_ws("/", *[f"s{k}" for k in range(len(halves))]).alias("digest"))


def differences(stored: DataFrame, stored_digests: DataFrame, replayed: DataFrame, replayed_digests: DataFrame) -> DataFrame:
    """(layer, category, bid_id, item, stored, replayed) of what a replay gives differently, or what one side lacks.

    Which parts of which bids' layers differ is written first, so that layers that agree in all
    bids are not made again, and a short list of parts goes to where the items are.
    """
    spark, key = stored.sparkSession, ["layer", "bid_id", "part"]
    both = stored_digests.select(*key, "n", "digest").join(replayed_digests.select(*key, F.col("n").alias("m"), F.col("digest").alias("other")), key, "full_outer")
    path = files.scratch(spark, "opened")
    both.filter(~(F.col("digest").eqNullSafe(F.col("other")) & F.col("n").eqNullSafe(F.col("m")))).select(*key).write.parquet(path)
    opened = spark.read.parquet(path)
    layers = [r["layer"] for r in opened.select("layer").distinct().collect()]  # nine at most
    if opened.count() <= graph.MOST_SENT:
        opened = F.broadcast(opened)
    side = lambda df, name: df.filter(F.col("layer").isin(layers)).withColumn("part", part()).join(opened, key, "left_semi").groupBy("layer", "bid_id", "item").agg(F.count("*").alias(f"{name}_n"), F.min("value").alias(name))
    met = side(stored, "stored").join(side(replayed, "replayed"), ["layer", "bid_id", "item"], "full_outer")
    same = F.col("stored").eqNullSafe(F.col("replayed")) & F.col("stored_n").eqNullSafe(F.col("replayed_n"))
    return met.filter(~same).select("layer", category(F.col("layer")).alias("category"), "bid_id", "item", "stored", "replayed")


def category(layer: Column) -> Column:
    return F.create_map(*[F.lit(x) for pair in CATEGORIES.items() for x in pair])[layer]


def verdicts(bids: DataFrame, stored_digests: DataFrame, replayed_digests: DataFrame) -> DataFrame:
    """(bid_id, status, mismatched): the category of the first layer whose digests differ, and how many layers differ."""
    key, order = ["layer", "bid_id", "part"], list(CATEGORIES)
    both = stored_digests.select(*key, F.struct("n", "digest").alias("a")).join(replayed_digests.select(*key, F.struct("n", "digest").alias("b")), key, "full_outer")
    unlike = both.filter(~F.col("a").eqNullSafe(F.col("b"))).select("bid_id", "layer").distinct()
    wrong = unlike.groupBy("bid_id").agg(F.min(F.array_position(F.array(*map(F.lit, order)), F.col("layer"))).alias("place"), F.count("*").alias("mismatched"))
    first = category(F.get(F.array(*map(F.lit, order)), (F.col("place") - 1).cast("int")))
    return bids.select("bid_id").join(wrong, "bid_id", "left").select("bid_id", F.coalesce(first, F.lit(COMPLETE)).alias("status"), F.coalesce("mismatched", F.lit(0)).cast("long").alias("mismatched"))


def rates(bids: DataFrame, stored_digests: DataFrame, runs: list[DataFrame]) -> DataFrame:
    """One row: bids, complete matches of the first run with the snapshot and their share, runs, and the share of bids with one hash over all runs, in percent."""
    first = verdicts(bids, stored_digests, runs[0])
    whole = graph._union([r.groupBy("bid_id").agg(F.concat_ws("/", F.count("*"), F.sum(F.xxhash64("layer", "part", "n", "digest").cast("decimal(38,0)")).cast("string")).alias("hash")) for r in runs])
    steady = whole.groupBy("bid_id").agg(F.countDistinct("hash").alias("hashes"), F.count("*").alias("runs"))
    out = first.join(steady, "bid_id", "left").agg(F.count("*").alias("cases"), F.count_if(F.col("status") == COMPLETE).alias("complete_matches"), F.count_if((F.col("hashes") == 1) & (F.col("runs") == len(runs))).alias("steady"))
    share = lambda c: F.round(100.0 * F.col(c) / F.col("cases"), 2)
    return out.select("cases", "complete_matches", share("complete_matches").alias("match_rate"), F.lit(len(runs)).alias("runs"), share("steady").alias("determinism_rate"))
