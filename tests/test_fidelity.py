"""Order of similarities in two encodings against a plain computation."""

from __future__ import annotations

import random

import numpy as np
import pytest

from lexifold.operators import evaluate as e
from lexifold.plans.evaluation_queries import ev9_fidelity
from lexifold.plans.registry import SQL

SCHEMA = "chunk_id long, vector array<double>"


def _plain(a, b, asked, top):
    """The mean correlation and share by all pairs, from dicts of vectors."""
    both = sorted(k for k in a if a[k] is not None and b.get(k) is not None)

    def unit(v):
        n = sum(x * x for x in v) ** 0.5
        return [x / n for x in v] if n else v

    def ranks(values):
        return np.array([sum(y < x for y in values) + (sum(y == x for y in values) + 1) / 2 for x in values])

    correlations, shares = [], []
    for q in sorted(set(asked) & set(both)):
        lists, bests = [], []
        for side in (a, b):
            cosines = [float(np.dot(unit(side[q]), unit(side[k]))) for k in both]
            lists.append(ranks([np.floor(x * e.STEPS + 0.5) for x in cosines]))
            bests.append({k for _, k in sorted((-round(x, 6), k) for x, k in zip(cosines, both))[:top]})
        x, y = (r - r.mean() for r in lists)
        length = np.sqrt((x * x).sum() * (y * y).sum())
        correlations.append(round(float((x * y).sum() / length), 4) if length else 0.0)
        shares.append(len(bests[0] & bests[1]) / top)
    return round(sum(correlations) / len(correlations), 4), round(sum(shares) / len(shares), 4)


@pytest.mark.parametrize("block", [3, 512])
def test_order_of_encodings_against_all_pairs(spark, block):
    draw = random.Random(5)
    a = {k: [draw.gauss(0, 1) for _ in range(6)] for k in range(60)}
    a |= {60: a[7], 61: a[7], 62: [0.0] * 6, 63: None, 64: [draw.gauss(0, 1) for _ in range(6)]}
    b = {k: None if v is None else [round(x * 2) / 2 for x in v] for k, v in a.items() if k != 64}
    b[3] = None
    asked = [0, 7, 60, 62, 63, 3, 11, 11, 25, 30, 41, 999]
    frames = [spark.createDataFrame(list(side.items()), SCHEMA).repartition(3) for side in (a, b)]
    found = e.order_fidelity(*frames, spark.createDataFrame([(q,) for q in asked], "query_id long"), 5, block).first()
    correlation, share = _plain(a, b, asked, 5)
    assert found["same_top"] == pytest.approx(share, abs=1e-4)
    assert found["spearman"] == pytest.approx(correlation, abs=2e-4)


def test_equal_encodings_keep_their_order_and_nothing_asked_gives_nulls(spark):
    a = spark.createDataFrame([(k, [float(k % 5), 1.0, float(k)]) for k in range(20)], SCHEMA)
    asked = spark.createDataFrame([(1,), (2,)], "query_id long")
    assert tuple(e.order_fidelity(a, a, asked).first()) == (1.0, 1.0)
    assert tuple(e.order_fidelity(a, a, asked.limit(0)).first()) == (None, None)
    assert tuple(e.order_fidelity(a.limit(0), a, asked).first()) == (None, None)


@pytest.mark.parametrize("held", [1, e.HELD])
def test_cosines_less_than_a_thousandth_apart_are_ranked(spark, monkeypatch, held):
    monkeypatch.setattr(e, "HELD", held)
    near = [[1.0, 0.002 * k] for k in range(15)]
    a = spark.createDataFrame(list(enumerate(near)), SCHEMA)
    b = spark.createDataFrame([(k, near[-k % 15]) for k in range(15)], SCHEMA)
    # from 0 all others stand in reverse
    one, other = (e.order_fidelity(a, b, spark.createDataFrame([(q,)], "query_id long")).first() for q in (0, 14))
    assert tuple(one) == (-0.625, 0.2)
    assert tuple(other) == _plain(*(dict(df.collect()) for df in (a, b)), [14], 5)
    both = e.order_fidelity(a, b, spark.createDataFrame([(0,), (14,)], "query_id long")).first()
    assert both["spearman"] == pytest.approx((one["spearman"] + other["spearman"]) / 2, abs=1e-4)


def test_registered_query_and_sql_rank_near_cosines(spark, tmp_path):
    duckdb = pytest.importorskip("duckdb")
    spark.createDataFrame([(k, [100.0, 0.3 * k]) for k in range(11)], "vec_id long, embedding array<float>").coalesce(1).write.parquet(str(tmp_path / "embeddings.parquet"))
    found = ev9_fidelity(spark, str(tmp_path)).first()
    with duckdb.connect() as c:
        c.execute(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{tmp_path}/embeddings.parquet/*.parquet')")
        assert tuple(found) == c.execute(SQL["ev9_fidelity"]).fetchone()
    assert (found["spearman"], found["same_top"]) == (1.0, 1.0)


@pytest.mark.parametrize("batch", ["7", "25"])
def test_queries_and_texts_over_many_batches(spark, batch):
    draw = random.Random(6)
    a = {k: [draw.gauss(0, 1) for _ in range(4)] for k in range(90)}
    b = {k: [round(x * 4) / 4 for x in v] for k, v in a.items()}
    asked = list(range(0, 90, 4))
    frames = [spark.createDataFrame(list(side.items()), SCHEMA).repartition(3) for side in (a, b)]
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    kept = spark.conf.get(key)
    spark.conf.set(key, batch)
    try:
        found = e.order_fidelity(*frames, spark.createDataFrame([(q,) for q in asked], "query_id long")).first()
    finally:
        spark.conf.set(key, kept)
    assert tuple(found) == pytest.approx(_plain(a, b, asked, 5), abs=1e-4)
