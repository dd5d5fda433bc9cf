"""Whole repeated runs of lines against all runs, and documents that they leave nothing of."""

import random

from pyspark.sql import functions as F

from attestra.llm import line_dedup


def test_whole_runs_equal_all_runs(spark):
    random.seed(5)
    kinds = [c * n for c, n in zip("abcdefghij", [0, 3, 5, 9, 12, 20, 7, 1, 15, 4])]
    rows = []
    for d in range(40):
        lines = [random.choice(kinds) + (str(d) if random.random() < 0.2 else "") for _ in range(random.randrange(1, 12))]
        if rows and random.random() < 0.6:
            other = random.choice(rows)[1].split("\n")
            at, n = random.randrange(len(other)), random.randrange(1, 8)
            lines = lines[: random.randrange(3)] + other[at : at + n] + lines[: random.randrange(3)]
        rows.append((d, "\n".join(lines)))
    first, gone = set(), set()
    for d, t in rows:
        lines = t.split("\n")
        for i in range(len(lines)):
            own = [(tuple(lines[i : j + 1]), j) for j in range(i, len(lines)) if sum(map(len, lines[i : j + 1])) >= 30]
            for run, j in own:
                if run in first:
                    gone.update((d, k) for k in range(i, j + 1))
            first.update(run for run, _ in own)
    want = {d: "\n".join(x for k, x in enumerate(t.split("\n")) if (d, k) not in gone) for d, t in rows}
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert {r["doc_id"]: r["text"] for r in line_dedup.dedup(docs, 30).collect()} == want
    assert {r["doc_id"] for r in line_dedup.without_emptied(docs, 30).collect()} == {d for d, t in rows if want[d].strip() or want[d] == t}


def test_no_stub_of_an_exact_copy_stays(spark):
    text = "\n".join(["x" * 150, "y" * 80, "short end", ""])
    rows = [(1, text), (2, text), (3, "head\n" + text), (4, text + "\n\n ")]
    left = line_dedup.without_emptied(spark.createDataFrame(rows, "doc_id bigint, text string")).orderBy("doc_id").select("doc_id", F.col("text"))
    assert [tuple(r) for r in left.collect()] == [(1, text), (3, "head")]
