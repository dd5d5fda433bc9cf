"""Operator 9: document quality by hierarchical empirical Bayes.

A logistic classifier on the form of a text gives each document's own evidence.  Documents
belong to a host and to a path of it.  Expected counts of good documents, summed over all
documents by grouped aggregation, give hosts a beta posterior that shrinks to the corpus, and
paths one that shrinks to their host; the strength of each prior comes from how much hosts,
or paths in hosts, really differ (moments).  A document's own share is taken out of its site.
The odds of both are combined: the classifier's, times those of the site against the corpus.

The classifier is fitted on a bounded sample of labelled documents (``max_docs``); sums over
sites cover every document.

Defined results: a null text counts as empty; null hosts or paths are sites of their own;
without labels, or with one class only, the classifier gives the same to all; equal rows are
kept; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import storage, workers
from .labelled import held_out, logistic, sample

MAX_DOCS = 40_000
THRESHOLD = 0.5
_LOWER, _UPPER, _DIGIT, _SPACE = (np.zeros(256, bool) for _ in range(4))
_LOWER[97:123], _UPPER[65:91], _DIGIT[48:58], _SPACE[[9, 10, 11, 12, 13, 32]] = True, True, True, True
_SYMBOL = np.zeros(256, bool)
_SYMBOL[33:127] = ~(_LOWER | _UPPER | _DIGIT)[33:127]
_COMMON = np.zeros(256, bool)
_COMMON[[ord(c) for c in ".,;:'\"-()?"]] = True


def form(text: str) -> list[float]:
    """Numbers on the form of a text: shares of kinds of characters, word length, repetition."""
    raw = text.encode()
    n = max(1, len(raw))
    seen = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    words, lines = text.split(), text.split("\n")
    letters = max(1, seen[_LOWER].sum() + seen[_UPPER].sum() + seen[128:].sum())
    sentences = text.replace("!!", ".").split(". ")
    return [
        float(np.log1p(len(words))),
        float(seen[_UPPER].sum() / letters),
        float(seen[_DIGIT].sum() / n),
        float((seen[_SYMBOL].sum() - seen[_COMMON].sum()) / n),
        float(seen[_COMMON].sum() / n),
        float(seen[_SPACE].sum() / n),
        len(raw) / max(1, len(words)) / 10,
        len(set(words)) / max(1, len(words)),
        len(set(lines)) / len(lines),
        len(set(sentences)) / len(sentences),
        float(seen.max() / n),
    ]


def fit(docs: DataFrame, labels: DataFrame, *, label: str = "quality", max_docs: int = MAX_DOCS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Means, spreads and weights of the classifier."""
    storage.prepare_python(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        workers.begin("quality")
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("label"), pa.array([form(x or "") for x in batch.column("text").to_pylist()], pa.list_(pa.float64()))], ["label", "form"])

    rows = sample(docs, labels, label, max_docs).mapInArrow(run, "label int, form array<double>").collect()  # max_docs rows of a few numbers
    x = np.array([r["form"] for r in rows]).reshape(len(rows), -1) if rows else np.zeros((1, len(form(""))))
    y = np.array([r["label"] for r in rows] or [1], float)
    mean, spread = x.mean(axis=0), np.maximum(x.std(axis=0), 1e-6)
    if len(set(y)) < 2:
        return mean, spread, np.zeros(x.shape[1] + 1)
    return mean, spread, logistic((x - mean) / spread, y)


def classified(docs: DataFrame, model: tuple, *, host: Column, path: Column) -> DataFrame:
    """(doc_id, host, path, own): the classifier's probability of a good document."""
    storage.prepare_python(docs.sparkSession)
    mean, spread, weights = model

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        workers.begin("quality")
        for batch in batches:
            x = (np.array([form(t or "") for t in batch.column("text").to_pylist()]).reshape(batch.num_rows, -1) - mean) / spread
            own = 1 / (1 + np.exp(-np.clip(weights[0] + x @ weights[1:], -12, 12))) if batch.num_rows else np.zeros(0)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("host"), batch.column("path"), pa.array(own, pa.float64())], ["doc_id", "host", "path", "own"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), host.cast("string").alias("host"), path.cast("string").alias("path"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id bigint, host string, path string, own double")


def _strength(sites: DataFrame, mean: str, n: str, centre: str) -> float:
    """How many documents a prior counts for: by moments, what spread of means remains beyond chance."""
    r = sites.filter(f"{n} > 1").agg(
        F.sum(F.col(n) * (F.col(mean) - F.col(centre)) ** 2).alias("seen"), F.sum(F.col(centre) * (1 - F.col(centre))).alias("chance"), F.sum(F.col(n) * F.col(centre) * (1 - F.col(centre))).alias("scale")
    ).first()
    if not r["scale"]:
        return 100.0
    within = max(1e-6, (r["seen"] - r["chance"]) / r["scale"])  # the share of variance between sites
    return float(min(1e6, max(1.0, 1 / within - 1)))


def posteriors(docs: DataFrame) -> DataFrame:
    """From (doc_id, host, path, own): the same with site and quality."""
    paths, _ = storage.written(docs.groupBy("host", "path").agg(F.sum("own").alias("good"), F.count("*").alias("n")), "paths")
    hosts = paths.groupBy(F.col("host").alias("h")).agg(F.sum("good").alias("host_good"), F.sum("n").alias("host_n"))
    centre = hosts.agg((F.sum("host_good") / F.sum("host_n")).alias("m")).first()["m"]
    centre = min(1 - 1e-6, max(1e-6, centre if centre is not None else 0.5))
    host_means = hosts.withColumn("host_mean", F.col("host_good") / F.col("host_n")).withColumn("centre", F.lit(centre))
    k_host = _strength(host_means, "host_mean", "host_n", "centre")
    both = paths.join(host_means, F.col("host").eqNullSafe(F.col("h"))).select("host", "path", "good", "n", "host_good", "host_n", F.least(F.lit(1 - 1e-6), F.greatest(F.lit(1e-6), F.col("host_mean"))).alias("host_mean"), (F.col("good") / F.col("n")).alias("path_mean"))
    k_path = _strength(both, "path_mean", "n", "host_mean")
    sites = both.select(F.col("host").alias("sh"), F.col("path").alias("sp"), "good", "n", "host_good", "host_n")
    joined = docs.join(sites, F.col("host").eqNullSafe(F.col("sh")) & F.col("path").eqNullSafe(F.col("sp")))
    host_post = (F.col("host_good") - F.col("own") + centre * k_host) / (F.col("host_n") - 1 + k_host)
    site = (F.col("good") - F.col("own") + host_post * k_path) / (F.col("n") - 1 + k_path)
    odds = lambda p: F.log(p / (1 - p))
    bounded = F.least(F.lit(1 - 1e-6), F.greatest(F.lit(1e-6), F.col("site")))
    combined = odds(F.col("own")) + odds(bounded) - float(np.log(centre / (1 - centre)))
    return joined.withColumn("site", site).select("doc_id", "host", "path", "own", "site", (1 / (1 + F.exp(-combined))).alias("quality"))


def scored(docs: DataFrame, labels: DataFrame, *, host: Column, path: Column, max_docs: int = MAX_DOCS, threshold: float = THRESHOLD) -> DataFrame:
    """Per document: doc_id, held_out, host, path, own, site, quality, keep."""
    own, _ = storage.written(classified(docs, fit(docs, labels, max_docs=max_docs), host=host, path=path), "classified")
    return posteriors(own).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "host", "path", "own", "site", "quality", (F.col("quality") >= threshold).alias("keep"))
