"""The pipeline against a plain version of every stage, and on a table of odd rows."""

import hashlib
import re

from pyspark.sql import functions as F

import corpus_pipeline
from attestra.llm import toxicity
from attestra.llm.queries import vocabulary_path

ASCII_LOWER = {ord(c): c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}


def plain_toxic(rows, model):
    """By the best segment again and again, instead of a scan with pointers."""

    def segments(scores):
        best = None
        for i in range(len(scores)):
            total = 0.0
            for j in range(i, len(scores)):
                total += scores[j]
                if total > 1e-12 and (best is None or total > best[0] + 1e-9):
                    best = (total, i, j)
        return [] if best is None else segments(scores[: best[1]]) + [best[0]] + segments(scores[best[2] + 1 :])

    out = []
    for d, t in rows:
        words = re.findall(r"\w+", (t or "").lower())
        scores = [model.of(w) or model.other for w in words]
        hot = [k for k, s in enumerate(scores) if s > 0]
        found = segments(scores[hot[0] : hot[-1] + 1]) if hot else []
        total, most, some = model.evidence(found, len(words))
        x = sum(w * v for w, v in zip(model.curve, (1.0, total, most, some)))
        if not model.curve or x < -0.8472978603872037:  # the logit of 0.3
            out.append((d, t))
    return out


def plain_lines(rows, hashed):
    first, gone = set(), set()
    for d, t in sorted({r for r in rows if r[1] is not None}, key=lambda r: (r[0] is None, r[0] or 0, hashed[r[1]])):
        lines = t.split("\n")
        for i in range(len(lines)):
            own = [(tuple(lines[i : j + 1]), j) for j in range(i, len(lines)) if sum(map(len, lines[i : j + 1])) >= 200]
            for run, j in own:
                if run in first:
                    gone.update((d, t, k) for k in range(i, j + 1))
            first.update(run for run, _ in own)
    out = []
    for d, t in rows:
        lines = (t or "").split("\n")
        left = [x for k, x in enumerate(lines) if (d, t, k) not in gone]
        if len(left) == len(lines):
            out.append((d, t))
        elif "".join(left).strip():
            out.append((d, "\n".join(left)))
    return out


def plain_copies(rows):
    """(id of the document that stays, the texts of its group)."""

    def shingles(t):
        words = (t or "").translate(ASCII_LOWER).encode().split()
        return frozenset(tuple(words[i : i + 5]) for i in range(len(words) - 4)) or (frozenset([tuple(words)]) if words else frozenset())

    sets = [shingles(t) for _, t in rows]
    group = list(range(len(rows)))

    def root(k):
        while group[k] != k:
            k = group[k]
        return k

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] == sets[j] or 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]) > 0:
                group[root(i)] = root(j)
    members = {}
    for k, row in enumerate(rows):
        members.setdefault(root(k), []).append(row)
    return [(min((d for d, _ in some if d is not None), default=None), {t or "" for _, t in some}) for some in members.values()]


def plain_windows(rows, items):
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(ASCII_LOWER))
    windows = set()
    for t in items:
        w = split(t)
        n = min(10, len(w))
        windows.update(tuple(w[i : i + n]) for i in range(len(w) - n + 1) if n)
    sizes = {len(w) for w in windows}
    return [(d, t) for d, t in rows if not any(tuple(w[i : i + n]) in windows for w in [split(t)] for n in sizes for i in range(len(w) - n + 1))]


def check(spark, docs, sf_dir):
    from tokenizers import Tokenizer

    stages, before = dict(corpus_pipeline.STAGES), docs
    pairs = lambda df: sorted(((r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()), key=str)
    for name, *_ in corpus_pipeline.STAGES[:-1]:
        rows = [tuple(r) for r in before.select("doc_id", "text").collect()]
        after = stages[name](spark, before, sf_dir)
        assert after.columns == docs.columns
        after = spark.createDataFrame(after.collect(), docs.schema)  # so that nothing is run again
        if name == "toxicity":
            model = toxicity.fit(before, spark.read.parquet(f"{sf_dir}/labels.parquet"))
            want = plain_toxic(rows, model)
        elif name == "line_dedup":
            want = plain_lines(rows, {r["text"]: r["h"] for r in before.select("text", F.xxhash64("text").alias("h")).collect()})
        elif name == "benchmark_decontamination":
            want = plain_windows(rows, [r["text"] for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()])
        else:
            groups, kept = plain_copies(rows), pairs(after)
            assert len(kept) == len(groups)
            for d, texts in groups:
                assert sum(e == d and (t or "") in texts for e, t in kept) >= 1
            before = after
            continue
        assert pairs(after) == sorted(want, key=str), name
        before = after
    tokenizer = Tokenizer.from_file(vocabulary_path())
    out = stages["bpe_encoding"](spark, before, sf_dir).collect()
    ids = {d: [] for d, _ in pairs(before)}
    for d, t in pairs(before):
        ids[d].append(tokenizer.encode(t or "", add_special_tokens=False).ids)
    assert len(out) == before.count()
    for r in out:
        assert list(r["ids"]) in ids[r["doc_id"]] and r["n_tokens"] == len(r["ids"])
        assert r["ids_sha256"] == hashlib.sha256(",".join(map(str, r["ids"])).encode()).hexdigest()
    return before


def test_pipeline_equals_a_plain_version(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    left = check(spark, docs, small)
    out = corpus_pipeline.run(spark, small)
    assert {r["doc_id"] for r in out.select("doc_id").collect()} == {r["doc_id"] for r in left.select("doc_id").collect()}


def test_pipeline_on_odd_rows(spark, docs, small):
    left = check(spark, docs, small)
    assert left.columns == docs.columns


def test_pipeline_on_nothing(spark, none, small):
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, small).count() == 0


def test_stages_keep_columns_whatever_their_names(spark, small):
    names = ["row", "_rank", "d", "h", "k", "q", "place", "unknown", "n_lines", "n_removed", "n_runs", "ranges", "label", "root", "item"]
    docs = spark.createDataFrame([(1, "some text of no weight", *names)], ["doc_id", "text", *names])
    for name, stage in corpus_pipeline.STAGES[1:4]:
        assert [tuple(r) for r in stage(spark, docs, small).collect()] == [(1, "some text of no weight", *names)], name
