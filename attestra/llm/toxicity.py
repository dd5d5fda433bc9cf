"""Operator 8: toxic passages by maximum-scoring segments.

A model holds log-odds of tokens, toxic against clean, with a Dirichlet prior in proportion
to the corpus.  Tokens are words, and word beginnings that stand for words too rare to count;
those whose log-odds are not many standard errors above zero, or too small to outweigh how rare
toxic documents are, share one slightly negative score: what merely goes with a language or a
topic adds up to nothing, however long the text.  A linear scan finds all maximal segments of a document: each segment points to the
last one before it that begins at a lower sum, and a new one follows these pointers.  Segment
scores get expected counts under clean text by the extreme-value law for such maxima, and the
significant ones add up to a document's evidence, which a logistic curve, fitted on the
sample, turns into a probability.

The model is fitted on a bounded sample of labelled documents (``max_docs``); its lexicon is
all that is significant there.  Scoring covers every document and whole texts; its time grows
linearly with a text's length.

Defined results: a null text counts as empty; an empty one has no passages and gets the score
of no evidence; equal rows are kept; without any labels, or with one class only, every score
is 0; an empty table gives an empty result; other columns are ignored, or kept as they are by
``without_toxic``, whatever their names.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import storage, workers
from .labelled import held_out, logistic, sample

MAX_DOCS = 40_000
PRIOR, LEAST_Z, LEAST_DOCS = 50.0, 4.0, 3
BEGINNINGS = (4, 5, 6, 7, 8)
THRESHOLD = 0.3
#: A segment counts if clean text has such a one with a probability under one half.
LEAST_SURPRISE = math.log(2)
_WORD = re.compile(r"\w+")
_MEMO = 300_000


@dataclass
class Model:
    scores: dict[str, float] = field(default_factory=dict)  # word, or beginning with a star after it
    other: float = -0.1  # score of any other token
    rate: float = 1.0  # lambda and K of the extreme-value law
    scale: float = 1.0
    curve: tuple[float, ...] = ()  # weights of the logistic curve
    _memo: dict[str, float] = field(default_factory=dict, repr=False)

    def of(self, word: str) -> float:
        """The score of a token: of the word, else of its longest known beginning; 0 if it has none."""
        known = self._memo.get(word)
        if known is None:
            if len(self._memo) > _MEMO:
                self._memo.clear()
            known = self.scores.get(word, 0.0)
            for n in reversed(BEGINNINGS):
                if known:
                    break
                if len(word) > n:
                    known = self.scores.get(word[:n] + "*", 0.0)
            self._memo[word] = known
        return known

    def segments(self, words: list[str]) -> list[tuple[int, int, float]]:
        """All maximal scoring segments: first token, last token, score."""
        first, last, low, high, link = [], [], [], [], []  # of each segment: its ends, the sums before and with it, and the segment before it that begins lower
        level, at = 0.0, -1
        for k, word in enumerate(words):
            score = self.of(word)
            if not score:
                continue
            level += self.other * (k - at - 1)
            begin, before = k, level
            level += score
            at, j = k, len(low) - 1
            while True:
                while j >= 0 and low[j] >= before:  # all between j and its link begin no lower than j
                    j = link[j]
                if j < 0 or high[j] >= level:
                    break
                begin, before, below = first[j], low[j], link[j]
                for column in (first, last, low, high, link):
                    del column[j:]
                j = below
            first.append(begin)
            last.append(k)
            low.append(before)
            high.append(level)
            link.append(j)
        return [(a, b, x - y) for a, b, x, y in zip(first, last, high, low)]

    def log_expected(self, score: float, n_words: int) -> float:
        """The logarithm of how many segments of this score a clean text of that length is expected to have."""
        return math.log(self.scale * max(n_words, 1)) - self.rate * score

    def expected(self, score: float, n_words: int) -> float:
        return math.exp(self.log_expected(score, n_words))

    def surprise(self, score: float, n_words: int) -> float:
        """-log of the probability that clean text of that length has such a segment."""
        log = self.log_expected(score, n_words)
        if log < -30:  # the probability is the expectation
            return -log
        return 0.0 if log > 5 else -math.log(-math.expm1(-math.exp(log)))

    def evidence(self, scores: list[float], n_words: int) -> tuple[float, float, float]:
        """From the scores of a text's segments: log of one and the sum of the significant ones' surprises, the largest, whether there is any."""
        found = [x for x in (self.surprise(s, n_words) for s in scores) if x > LEAST_SURPRISE]
        return math.log1p(sum(found)), max(found, default=0.0), float(bool(found))

    def probability(self, text: str) -> float:
        if not self.curve:
            return 0.0
        words = _WORD.findall(text.lower())
        total, most, some = self.evidence([s for _, _, s in self.segments(words)], len(words))
        x = self.curve[0] + self.curve[1] * total + self.curve[2] * most + self.curve[3] * some
        return 1 / (1 + math.exp(-min(30.0, max(-30.0, x))))


def _features(text: str) -> set[str]:
    found = set(_WORD.findall(text.lower()))
    return found | {w[:n] + "*" for w in found for n in BEGINNINGS if len(w) > n}


def fit(docs: DataFrame, labels: DataFrame, *, max_docs: int = MAX_DOCS) -> Model:
    """A model from labelled documents that are not held out."""
    storage.prepare_python(docs.sparkSession)
    chosen, chosen_path = storage.written(sample(docs, labels, "toxic", max_docs).select("text", "label"), "toxicity-sample")  # max_docs texts

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        workers.begin("toxicity")
        for batch in batches:
            toxic, clean = Counter(), Counter()
            for text, label in zip(batch.column("text").to_pylist(), batch.column("label").to_pylist(), strict=True):
                into = toxic if label else clean
                into.update(_features(text or ""))
                into["\n"] += 1
                into["\n\n"] += len(_WORD.findall(text or ""))
            names = list(toxic | clean)
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([toxic[x] for x in names], pa.int64()), pa.array([clean[x] for x in names], pa.int64())], ["token", "toxic", "clean"])

    counted, path = storage.written(chosen.mapInArrow(count, "token string, toxic bigint, clean bigint").groupBy("token").agg(F.sum("toxic").alias("t"), F.sum("clean").alias("c")), "token-counts")
    totals = {r["token"]: r for r in counted.filter(F.col("token").isin("\n", "\n\n")).collect()}  # two rows
    if "\n" not in totals or not totals["\n"]["t"] or not totals["\n"]["c"]:
        return Model()
    nt, nc, words = totals["\n"]["t"], totals["\n"]["c"], max(1, totals["\n\n"]["c"])
    prior = (F.col("t") + F.col("c")) * F.lit(PRIOR / (nt + nc))
    t, c = F.col("t") + prior + 0.01, F.col("c") + prior + 0.01
    odds = F.log(t / (nt + PRIOR - t + 0.02)) - F.log(c / (nc + PRIOR - c + 0.02))
    spread = F.sqrt(1 / t + 1 / c)
    # What is surely more frequent in toxic documents, and by so much that a document with it is more likely toxic than not.
    kept = counted.filter(~F.col("token").startswith("\n")).filter(f"t >= {LEAST_DOCS}").withColumns({"score": odds, "spread": spread}).filter((F.col("score") >= LEAST_Z * F.col("spread")) & (F.col("score") - 2 * F.col("spread") >= math.log(nc / nt)))
    rows = sorted(kept.collect(), key=lambda r: r["token"])  # the significant tokens of max_docs documents
    model = Model({r["token"]: r["score"] for r in rows})
    rates = np.array([r["c"] + 0.5 for r in rows if not r["token"].endswith("*")] or [0.5]) / words
    scores = np.array([r["score"] for r in rows if not r["token"].endswith("*")] or [1.0])
    model.other = -max(0.05, 2 * float((rates * scores).sum()))
    low, high = 1e-3, 5.0
    for _ in range(60):  # lambda: where the mean of exp(lambda * score) is one in clean text
        model.rate = (low + high) / 2
        mean = float((rates * np.exp(np.minimum(model.rate * scores, 600))).sum() + (1 - rates.sum()) * np.exp(model.rate * model.other))
        low, high = (model.rate, high) if mean < 1 else (low, model.rate)

    def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        workers.begin("toxicity")
        for batch in batches:
            words = [_WORD.findall((x or "").lower()) for x in batch.column("text").to_pylist()]
            found = [[s for _, _, s in model.segments(w)] for w in words]
            yield pa.RecordBatch.from_arrays([batch.column("label"), pa.array([len(w) for w in words], pa.int64()), pa.array(found, pa.list_(pa.float64()))], ["label", "n", "found"])

    got, got_path = storage.written(chosen.mapInArrow(segments, "label int, n bigint, found array<double>"), "toxicity-segments")
    large = F.size(F.filter("found", lambda s: s >= 1.0))
    clean = got.filter("label = 0").agg(F.sum(large).alias("seen"), (F.sum(F.greatest("n", F.lit(1))) * math.exp(-model.rate)).alias("expected")).first()
    model.scale = max(1e-6, ((clean["seen"] or 0) + 1) / ((clean["expected"] or 0) + 1))

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [model.evidence(s, n) for s, n in zip(batch.column("found").to_pylist(), batch.column("n").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("label"), *[pa.array([r[k] for r in rows], pa.float64()) for k in range(3)]], ["label", "total", "most", "some"])

    rows = got.mapInArrow(features, "label int, total double, most double, some double").collect()  # max_docs rows of four numbers
    model.curve = tuple(map(float, logistic(np.array([(r["total"], r["most"], r["some"]) for r in rows]), np.array([r["label"] for r in rows], float))))
    storage.drop(docs.sparkSession, path, chosen_path, got_path)
    return model


def scored(docs: DataFrame, model: Model, *, threshold: float = THRESHOLD) -> DataFrame:
    """Per document: doc_id, held_out, score, predicted."""
    storage.prepare_python(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        workers.begin("toxicity")
        for batch in batches:
            found = [model.probability(x or "") for x in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(found, pa.float64()), pa.array([int(x >= threshold) for x in found], pa.int32())], ["doc_id", "held_out", "score", "predicted"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id bigint, held_out boolean, score double, predicted int")


def toxic_passages(docs: DataFrame, model: Model, *, most_expected: float = 0.5) -> DataFrame:
    """(doc_id, start, end, score, expected): the significant passages, as code point offsets."""
    storage.prepare_python(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        workers.begin("toxicity")
        for batch in batches:
            out = []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                words = list(_WORD.finditer(text or ""))
                for a, b, s in model.segments([w[0].lower() for w in words]):
                    if (e := model.expected(s, len(words))) <= most_expected:
                        out.append((doc_id, words[a].start(), words[b].end(), s, e))
            columns = list(zip(*out)) if out else [()] * 5
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["doc_id", "start", "end", "score", "expected"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id bigint, start bigint, end bigint, score double, expected double")


def without_toxic(docs: DataFrame, model: Model, *, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` without the documents that score ``threshold`` or more; their texts are not moved."""
    storage.prepare_python(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        workers.begin("toxicity")
        for batch in batches:
            yield batch.filter(pa.array([model.probability(x or "") < threshold for x in batch.column("text").to_pylist()], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
