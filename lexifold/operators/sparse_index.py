"""A sparse index kept as tables, which grows by batches of chunks and is opened by many searches.

Under its folder lie, for each batch:

* `postings/batch=./bucket=.`: (term, chunk_id, tf, dl) by hash of the term, in the order of terms, so that a search reads the buckets
  and row groups of its own terms only. Bucket -1 holds a row for each chunk, with its length.
* `terms/batch=.`: (term, df), the batch's document frequencies.
* `summary/batch=.`: one row with the batch's chunks, tokens, the number of buckets, and the mean idf over all batches until then.

The summary is written last and a batch without it doesn't count, so one that broke off is invisible and is written anew. A batch that
is there already isn't added twice.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import tokenize

EPSILON = 0.25
#: Text bytes of the first batch for each bucket, about, and buckets at least and at most.
BUCKET_BYTES, FEWEST, MOST = 32 << 20, 8, 4096
#: Chunks whose counts a worker holds at once.
COUNTED = 512
#: Bucket of the rows that stand for chunks.
HEADS = -1
_SUMMARY = "n long, tokens long, mean double, buckets int, batch string"


class SparseIndex(NamedTuple):
    """postings (term, chunk_id, tf, dl, bucket), terms (term, df, idf) and stats (n, avgdl) as build_bm25 gives them."""

    postings: DataFrame
    terms: DataFrame
    stats: DataFrame
    buckets: int


def bucket_of(term: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(buckets)).cast("int")


def token_counts(chunks: DataFrame, chunk_id: str = "chunk_id") -> DataFrame:
    """(term, chunk_id, tf, dl): for each chunk its distinct tokens and how often they come, and a row without a term. Each chunk is
    counted where it lies, so nothing is exchanged."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for at in range(0, len(f), COUNTED):
                part = f.iloc[at : at + COUNTED]
                counts = [Counter(w.split()) for w in part["words"].tolist()]
                sizes = [len(c) + 1 for c in counts]
                terms = [t for c in counts for t in (None, *c)]
                times = [n for c in counts for n in (0, *c.values())]
                lengths = [c.total() for c in counts]
                yield pd.DataFrame({"term": pd.Series(terms, dtype=object), "chunk_id": np.repeat(part["chunk_id"].to_numpy(), sizes), "tf": times, "dl": np.repeat(lengths, sizes)})

    words = chunks.select(F.col(chunk_id).alias("chunk_id"), F.array_join(tokenize(F.col("text")), " ").alias("words"))
    return words.mapInPandas(run, f"term string, chunk_id {dict(words.dtypes)['chunk_id']}, tf long, dl int")


def raw_idf(n: Column, df: Column) -> Column:
    return F.log((n - df + 0.5) / (df + 0.5))


def _exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def _summaries(spark: SparkSession, path: str) -> DataFrame | None:
    return spark.read.schema(_SUMMARY).parquet(f"{path}/summary") if _exists(spark, f"{path}/summary") else None


def batches(spark: SparkSession, path: str) -> list[str]:
    """Names of the batches that are wholly there, in the order of their names."""
    found = _summaries(spark, path)
    return sorted(r["batch"] for r in found.select("batch").distinct().collect()) if found is not None else []


def _terms(spark: SparkSession, path: str, names: list[str]) -> DataFrame:
    read = spark.read.schema("term string, df long, batch string").parquet(f"{path}/terms").where(F.col("batch").isin(names))
    return read.groupBy("term").agg(F.sum("df").alias("df"))


def add_chunks(path: str, chunks: DataFrame, batch: str, chunk_id: str = "chunk_id") -> None:
    """Add chunks (chunk_id, text) as a named batch; their texts are read and tokenised once. Ids must be new to the index."""
    spark = chunks.sparkSession
    before = _summaries(spark, path)
    known = before.agg(F.max("buckets").alias("buckets"), F.sum("n").alias("n"), F.collect_set("batch").alias("names")).first() if before is not None else None
    if known and batch in known["names"]:
        return
    if known:
        buckets = known["buckets"]
    else:
        size = chunks.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        buckets = min(MOST, max(FEWEST, -(-size // BUCKET_BYTES)))
    bucket = F.when(F.col("term").isNull(), F.lit(HEADS)).otherwise(bucket_of(F.col("term"), buckets))
    rows = token_counts(chunks, chunk_id).withColumn("bucket", bucket)
    # buckets of frequent terms are dealt to several tasks, small ones share one
    at = f"{path}/postings/batch={batch}"
    rows.hint("rebalance", "bucket").sortWithinPartitions("bucket", "term", "chunk_id").write.mode("overwrite").partitionBy("bucket").parquet(at)
    written = spark.read.schema(rows.schema).parquet(at)
    written.where(F.col("bucket") != HEADS).groupBy("term").agg(F.count("*").alias("df")).repartitionByRange("term").sortWithinPartitions("term").write.mode("overwrite").parquet(f"{path}/terms/batch={batch}")
    own = written.where(F.col("bucket") == HEADS).agg(F.count("*").alias("n"), F.coalesce(F.sum("dl"), F.lit(0)).cast("long").alias("tokens")).first()
    n = own["n"] + (known["n"] if known else 0)
    mean = _terms(spark, path, [batch, *(known["names"] if known else [])]).agg(F.avg(raw_idf(F.lit(n), F.col("df")))).first()[0]
    spark.createDataFrame([(own["n"], own["tokens"], mean, buckets)], "n long, tokens long, mean double, buckets int").coalesce(1).write.mode("overwrite").parquet(f"{path}/summary/batch={batch}")


def open_sparse(spark: SparkSession, path: str, chunk_type: str = "bigint") -> SparseIndex:
    """The index of all whole batches. chunk_type: the type of chunk ids. Where there is none the error says so."""
    found = _summaries(spark, path)
    rows = found.collect() if found is not None else []  # one short row for each batch
    if not rows:
        raise FileNotFoundError(f"no sparse index at {path}")
    names, n, tokens = [r["batch"] for r in rows], sum(r["n"] for r in rows), sum(r["tokens"] for r in rows)
    # the batch that came last has counted the terms of all
    mean = rows[0]["mean"] if len(rows) == 1 else _terms(spark, path, names).agg(F.avg(raw_idf(F.lit(n), F.col("df")))).first()[0]
    postings = spark.read.schema(f"term string, chunk_id {chunk_type}, tf long, dl int, batch string, bucket int").parquet(f"{path}/postings").where(F.col("batch").isin(names) & (F.col("bucket") >= 0))
    raw = raw_idf(F.lit(n), F.col("df"))
    terms = _terms(spark, path, names).select("term", "df", F.when(raw < 0, F.lit(EPSILON) * F.lit(mean)).otherwise(raw).alias("idf"))
    stats = spark.createDataFrame([(n, tokens / n if n else None)], "n long, avgdl double")
    return SparseIndex(postings.select("term", "chunk_id", "tf", "dl", "bucket"), terms, stats, rows[0]["buckets"])
