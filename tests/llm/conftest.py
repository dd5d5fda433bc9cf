import pytest

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, fp string, ids string, d string, ranges string"


@pytest.fixture(scope="session")
def docs(spark):
    """Nulls, empty and long texts, ties, repeats, and columns whose names clash with those of the operators."""
    long = " ".join(f"word{k % 977} filler{k % 31}" for k in range(30_000))
    passage = " ".join(f"shared{k}" for k in range(60))
    texts = ["the quick brown fox jumps over the lazy dog\nsecond line", None, "", "a", passage + " tail one", "head two " + passage, "same text here for all\n" + passage, "same text here for all\n" + passage, long, "naïve café ☕ 你好 " + passage[:250], "  odd \n\n spaces\t here  ", "same text here for all\n" + passage]
    rows = [(k, t, "en", "s", 1, "x", "y", "z", "w") for k, t in enumerate(texts)]
    rows += [rows[6], (None, "no id " + passage, None, None, None, None, None, None, None), (3, "another text of id three", "en", None, 0, None, None, None, None)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)
