from __future__ import annotations

import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def documents(spark, texts, ids=None, sources=None):
    rows = [((i if ids is None else ids[i]), t, "en", (f"s{i % 3}" if sources is None else sources[i]), len(t or "")) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture
def words():
    rnd = random.Random(5)
    vocabulary = ["".join(rnd.choice("abdeghilmnorstu") for _ in range(rnd.randint(2, 8))) for _ in range(400)]
    return lambda n, seed: random.Random(seed).choices(vocabulary, k=n)


@pytest.fixture
def odd_texts(words):
    """Nulls, empty and blank texts, short ones, ties and repeats, a very long one."""
    long = " ".join(words(30_000, 1))
    return [None, "", " \n\t", "one", "one", "two words", "é ß 😀 " * 5, long, long, " ".join(words(60, 2)), " ".join(words(60, 2)), "x" * 3000]


@pytest.fixture
def write(tmp_path):
    def run(**tables):
        for name, df in tables.items():
            df.write.parquet(str(tmp_path / f"{name}.parquet"))
        return str(tmp_path)

    return run
