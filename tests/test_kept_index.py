"""The kept sparse index, vector stores, merging, item checks, resumed runs and loaders."""

from __future__ import annotations

import os
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexifold.functions.loading import Loader, batches_of, checked_vectors
from lexifold.operators import chunk, evaluate, retrieve, sparse_index, stats


def _chunks(spark, n, start=0):
    rnd = random.Random(n + start)
    words = [f"w{i}" for i in range(60)] + ["common"] * 40
    return spark.createDataFrame([(start + i, " ".join(rnd.choices(words, k=rnd.randint(0, 30)))) for i in range(n)], "chunk_id long, text string")


@pytest.fixture
def questions(spark):
    rnd = random.Random(4)
    return spark.createDataFrame([(i, " ".join(rnd.choices([f"w{k}" for k in range(70)] + ["common", "common"], k=5))) for i in range(25)], "query_id long, text string")


def _ranked(df):
    return sorted((r.query_id, r.rank, r.chunk_id, r.score) for r in df.collect())


def test_added_chunks_rank_as_in_a_rebuild(spark, questions, tmp_path):
    old, new = _chunks(spark, 80), _chunks(spark, 50, 1000)
    at, whole = f"{tmp_path}/grown", f"{tmp_path}/whole"
    sparse_index.add_chunks(at, old, "a")
    first = _ranked(retrieve.bm25_topk(questions, sparse_index.open_sparse(spark, at), 10))
    assert first == _ranked(retrieve.bm25_topk(questions, retrieve.build_bm25(old), 10))
    sparse_index.add_chunks(at, new, "b")
    sparse_index.add_chunks(at, new, "b")  # once more: nothing happens
    sparse_index.add_chunks(whole, old.unionByName(new), "a")
    grown = _ranked(retrieve.bm25_topk(questions, sparse_index.open_sparse(spark, at), 10))
    assert grown == _ranked(retrieve.bm25_topk(questions, sparse_index.open_sparse(spark, whole), 10)) == _ranked(retrieve.bm25_topk(questions, retrieve.build_bm25(old.unionByName(new)), 10))
    assert grown != first and sparse_index.batches(spark, at) == ["a", "b"]


def test_a_batch_that_broke_off_does_not_count(spark, questions, tmp_path, monkeypatch):
    at = f"{tmp_path}/ix"
    sparse_index.add_chunks(at, _chunks(spark, 80), "a")
    before = _ranked(retrieve.bm25_topk(questions, sparse_index.open_sparse(spark, at), 10))
    monkeypatch.setattr(sparse_index, "_terms", lambda *a: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        sparse_index.add_chunks(at, _chunks(spark, 50, 1000), "b")
    monkeypatch.undo()
    assert sparse_index.batches(spark, at) == ["a"]
    assert _ranked(retrieve.bm25_topk(questions, sparse_index.open_sparse(spark, at), 10)) == before
    sparse_index.add_chunks(at, _chunks(spark, 50, 1000), "b")
    both = retrieve.build_bm25(_chunks(spark, 80).unionByName(_chunks(spark, 50, 1000)))
    assert _ranked(retrieve.bm25_topk(questions, sparse_index.open_sparse(spark, at), 10)) == _ranked(retrieve.bm25_topk(questions, both, 10))


def test_search_reads_the_postings_of_its_terms_once(spark, tmp_path):
    at = f"{tmp_path}/ix"
    sparse_index.add_chunks(at, _chunks(spark, 80), "a")
    spark.conf.set("spark.sql.maxMetadataStringLength", "4000")
    found = retrieve.bm25_topk(spark.createDataFrame([(1, "w1 w2")], "query_id long, text string"), sparse_index.open_sparse(spark, at), 10)
    plan = found._jdf.queryExecution().executedPlan().toString()
    spark.conf.unset("spark.sql.maxMetadataStringLength")
    scans = [line for line in plan.splitlines() if "FileScan" in line]
    postings = [line for line in scans if "tf#" in line]
    assert len(postings) == 1 and "In(term, [w1,w2])" in postings[0] and re.search(r"PartitionFilters: \[.*bucket#\d+ (IN|=|INSET) ", postings[0]), postings
    assert len(scans) == 2 and "In(term, [w1,w2])" in [x for x in scans if x not in postings][0]


def test_many_query_terms_and_empty_indexes(spark, questions, tmp_path, monkeypatch):
    at = f"{tmp_path}/ix"
    sparse_index.add_chunks(at, _chunks(spark, 80), "a")
    index = sparse_index.open_sparse(spark, at)
    named = _ranked(retrieve.bm25_topk(questions, index, 10))
    monkeypatch.setattr(retrieve, "NAMED", 3)
    assert _ranked(retrieve.bm25_topk(questions, index, 10)) == named
    with pytest.raises(FileNotFoundError):
        sparse_index.open_sparse(spark, f"{tmp_path}/none")
    sparse_index.add_chunks(f"{tmp_path}/empty", _chunks(spark, 0), "a")
    assert retrieve.bm25_topk(questions, sparse_index.open_sparse(spark, f"{tmp_path}/empty"), 10).count() == 0


def _vectors(spark, n, dim, seed):
    rng = np.random.default_rng(seed)
    return spark.createDataFrame([(i, [float(np.float32(x)) for x in rng.normal(size=dim)]) for i in range(n)], "chunk_id long, vector array<float>")


def test_stores_find_what_their_decoded_vectors_find(spark):
    vectors = _vectors(spark, 300, 16, 1)
    flat = vectors.withColumn("vector", F.transform("vector", lambda x, i: F.when(i == 3, 0.25).otherwise(x).cast("float")))  # one dimension is the same everywhere
    queries = _vectors(spark, 12, 16, 2).withColumnRenamed("chunk_id", "query_id")
    half, codes = retrieve.half_store(flat), retrieve.code_store(flat)
    assert {len(r.vector) for r in half.vectors.collect()} == {32} and {len(r.vector) for r in codes.vectors.collect()} == {16}
    decoded = spark.createDataFrame([(r.chunk_id, [float(x) for x in np.frombuffer(r.vector, "<f2")]) for r in half.vectors.collect()], "chunk_id long, vector array<double>")
    assert _ranked(retrieve.dense_topk(queries, half, 10)) == _ranked(retrieve.dense_topk(queries, decoded, 10))
    back = retrieve.quantize(flat).select("chunk_id", "vector")
    got, expect = (_ranked(retrieve.dense_topk(queries, x, 10)) for x in (codes, back))
    assert [r[:3] for r in got] == [r[:3] for r in expect] and all(abs(a[3] - b[3]) <= 1e-6 for a, b in zip(got, expect))
    assert retrieve.dense_topk(queries, retrieve.half_store(flat.limit(0)), 10).count() == 0


def test_keyword_lists(spark):
    q = spark.createDataFrame([(1, "whole", ["one", " ", "two"]), (2, " ", None), (3, "x", [])], "query_id long, text string, keywords array<string>")
    rows = sorted((r.query_id, r.phrasing, r.text) for r in retrieve.keyword_lists(q).collect())
    assert rows == [(1, 0, "whole"), (1, 1, "one"), (1, 3, "two"), (3, 0, "x")]


def plain_merge(rows, target):
    """One chunk after the other into the last merge, as long as it fits."""
    out = []
    for key, point, path, text in rows:
        if out and out[-1][0] == key and len(out[-1][3]) + len(text) + 1 <= target:
            k, p, h, t = out[-1]
            out[-1] = (k, p or point, h, f"{t}\n{text}")
        else:
            out.append((key, point, path, text))
    return out


def test_merging_against_a_plain_fold(spark):
    rnd = random.Random(3)
    docs = {d: [(rnd.choice(["a", "b", None]), rnd.choice([None, "", "1.", "2.3"]), [f"h{i}"], "x" * rnd.randint(1, 60)) for i in range(rnd.choice([1, 5, 60]))] for d in range(25)}
    df = spark.createDataFrame([(d, i, *r) for d, rows in docs.items() for i, r in enumerate(rows)], "doc_id long, ord int, source string, point string, section_path array<string>, text string")
    got = {}
    for r in chunk.merge_siblings(df.repartition(5), 100, run="source", min_chars=0).orderBy("doc_id", "ord").collect():
        got.setdefault(r.doc_id, []).append((r.source, r.point, r.section_path, r.text))
    assert got == {d: plain_merge(rows, 100) for d, rows in docs.items()}


def test_item_checks(spark):
    good = {"id": "1", "question": "q", "answer": "a", "gold_source": "s", "gold_quote": "One  two…THREE", "topic": "t", "difficulty": "easy"}
    cases = [
        ({}, []),
        ({"gold_quote": ""}, []),
        ({"gold_quote": None}, []),
        ({"gold_quote": "… …one two"}, []),
        ({"answer": ""}, ["missing answer"]),
        ({"id": None}, ["missing id"]),
        ({"question": None}, ["missing question"]),
        ({"topic": "x"}, ["bad topic x"]),
        ({"topic": None}, ["missing topic", "bad topic "]),
        ({"difficulty": "hardest"}, ["bad difficulty hardest"]),
        ({"gold_source": "z", "gold_quote": "none"}, ["unknown source z"]),
        ({"gold_source": None}, ["missing gold_source", "unknown source "]),
        ({"gold_quote": "one two…" + "N" * 80}, ["quote not found " + "N" * 60]),
    ]
    rows = [tuple((good | change).values()) + (i,) for i, (change, _) in enumerate(cases)]
    items = spark.createDataFrame(rows, ", ".join(f"{c} string" for c in good) + ", n int")
    docs = spark.createDataFrame([("s", "zero ONE two \n three")], "source string, text string")
    assert [r.errors for r in evaluate.verify_items(items, docs, ["t"]).orderBy("n").collect()] == [e for _, e in cases]


def test_a_run_in_units_is_taken_up_again(spark, tmp_path):
    at, calls = f"{tmp_path}/run", tmp_path / "calls"
    calls.mkdir()

    def work(df):
        def run(frames):
            for f in frames:
                for k in f["id"].tolist():
                    if k == 13 and not (calls / "mended").exists():
                        raise ValueError("the model is gone")
                    (calls / f"{k}-{os.urandom(4).hex()}").touch()
                yield f.assign(answer=f["id"] * 2)[["id", "answer"]]

        return df.mapInPandas(run, "id long, answer long")

    units = spark.range(60).repartition(3)
    with pytest.raises(Exception, match="the model is gone"):
        stats.run_in_units(units, at, "id", work, 10)
    finished = {r.id for p in stats._finished(spark, at) for r in spark.read.parquet(p).collect()}
    assert 0 < len(finished) < 60 and 13 not in finished
    (calls / "mended").touch()
    more = units.unionByName(spark.range(100, 130))
    got = stats.run_in_units(more, at, "id", work, 10).collect()
    assert sorted((r.id, r.answer) for r in got) == sorted((i, 2 * i) for i in [*range(60), *range(100, 130)])
    made = [int(p.name.split("-")[0]) for p in calls.iterdir() if p.name != "mended"]
    assert all(made.count(i) == 1 for i in [*finished, *range(100, 130)]), "what was finished isn't made again"
    again = len(made)
    assert stats.run_in_units(more, at, "id", work, 10).count() == 90 and len([p for p in calls.iterdir() if p.name != "mended"]) == again


def test_models_are_loaded_once_a_worker(spark, tmp_path):
    def make():
        (tmp_path / f"{os.getpid()}-{os.urandom(4).hex()}").touch()
        return lambda texts: np.array([[len(t or ""), 1.0] for t in texts])

    loader = Loader(make, f"lengths-{tmp_path}")
    docs = spark.range(400).select(F.col("id"), F.repeat(F.lit("x"), F.col("id").cast("int")).alias("text")).repartition(16)
    rows = retrieve.embed_column(docs, F.col("text"), loader, batch=7, size=500).collect()
    assert len(rows) == 400 and all(abs(np.hypot(*r.vector) - 1) < 1e-6 for r in rows)
    pids = [p.name.split("-")[0] for p in tmp_path.iterdir()]
    assert 1 <= len(pids) == len(set(pids)) < 16
    with pytest.raises(Exception, match="encoder gave"):
        retrieve.embed_column(docs, F.col("text"), lambda texts: np.zeros((len(texts) + 1, 2))).collect()


def test_batches_and_vector_checks():
    assert list(batches_of(["a", None, "bbb", "cccccc", "d"], 2, 4)) == [["a", None], ["bbb"], ["cccccc"], ["d"]]
    assert checked_vectors([[1, 2]], 1, 2).shape == (1, 2)
    for bad, rows, dim in (([[1, 2]], 2, None), ([[1, 2]], 1, 3), ([1, 2], 2, None)):
        with pytest.raises(ValueError):
            checked_vectors(bad, rows, dim)
