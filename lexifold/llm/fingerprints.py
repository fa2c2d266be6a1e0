"""Operator 2: document fingerprints by winnowing."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import table
from .textkit import mix64

#: Code points in a gram.
GRAM = 16
#: Grams in a window. Two texts that share WINDOW + GRAM - 1 code points in a row share a selected gram.
WINDOW = 40
#: Bytes of text in a range of documents, about, and ranges at most.
PART, MOST_PARTS = 8 << 20, 1 << 15
#: Bits of a gram's hash and of its position while windows are compared, in one 64-bit number.
_POSITION_BITS = 32


def gram_hashes(text: str, gram: int = GRAM) -> np.ndarray:
    """32-bit hashes of all runs of `gram` code points; of the whole text where it is shorter; none of an empty one.

    Rolling: the hash of a run of 2m is made of those of its halves.
    """
    h = mix64(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64) + np.uint64(1))
    if len(h) < gram:
        gram = len(h)
    if not gram:
        return h
    out, done, size, scale = None, 0, 1, 0x9E3779B97F4A7C15
    while True:  # the binary digits of gram, lowest first
        if gram & size:
            out = h if out is None else out[: len(h) - done] * np.uint64(scale) + h[done:]
            done += size
        if done == gram:
            break
        h = h[: len(h) - size] * np.uint64(scale) + h[size:]
        size, scale = size * 2, scale * scale * 3 % (1 << 64)
    return mix64(out) >> np.uint64(32)


def winnow(hashes: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """Positions of the smallest hash of each window, the rightmost of equal ones, once each, in order; with fewer hashes than
    a window, of all of them."""
    n = len(hashes)
    if not n:
        return np.empty(0, np.int64)
    window = min(window, n)
    ranked = (hashes << np.uint64(_POSITION_BITS)) | (np.uint64((1 << _POSITION_BITS) - 1) - np.arange(n, dtype=np.uint64))
    low, size = ranked, 1
    while size * 2 <= window:
        low, size = np.minimum(low[:-size], low[size:]), size * 2
    low = np.minimum(low[: n - window + 1], low[window - size :])
    chosen = low[np.flatnonzero(np.diff(low, prepend=~low[:1]))]
    return (np.uint64((1 << _POSITION_BITS) - 1) - (chosen & np.uint64((1 << _POSITION_BITS) - 1))).astype(np.int64)


def fingerprint(text: str) -> tuple[str, np.ndarray]:
    """The fingerprint of a text as hex digits, for each selected gram its hash (8) and its distance to the one before (4), and
    the sorted distinct hashes."""
    hashes = gram_hashes(text)
    at = winnow(hashes)
    packed = np.empty(len(at), np.dtype([("hash", ">u4"), ("step", ">u2")]))
    packed["hash"], packed["step"] = hashes[at], np.diff(at, prepend=0)
    return packed.tobytes().hex(), np.unique(hashes[at])


def unpack(printed: str) -> list[tuple[int, int]]:
    """(hash, position) of each selected gram of a fingerprint."""
    packed = np.frombuffer(bytes.fromhex(printed), np.dtype([("hash", ">u4"), ("step", ">u2")]))
    return list(zip(packed["hash"].tolist(), np.cumsum(packed["step"].astype(np.int64)).tolist()))


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard similarity of two sets of selected hashes; 1 for two empty ones."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both) if len(a) + len(b) else 1.0


def edit(text: str, other: str) -> str:
    """The text with its last quarter (rounded down) replaced by the first as many code points of another, or all of it."""
    cut = len(text) // 4
    return text[: len(text) - cut] + other[:cut]


PRINTS = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _print_rows(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows sorted by (part, tail, doc_id): each is printed with the row after it; the tail of a part is only a next row."""
    held = None
    for f in frames:
        rows = []
        for doc_id, text, part, tail in zip(f["doc_id"].tolist(), f["text"].tolist(), f["part"].tolist(), f["tail"].tolist()):
            text = text or ""
            now = (*fingerprint(text), text)
            if held and held[1] == part and not held[2]:
                printed, chosen, own = held[3]
                edited = edit(own, text)
                edited_print, edited_chosen = fingerprint(edited)
                sha = hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest()
                rows.append((held[0], len(own), sha, printed, edited_print, likeness(chosen, edited_chosen), likeness(chosen, now[1])))
            held = (doc_id, part, tail, now)
            if len(rows) >= 256:
                yield _frame(rows)
                rows = []
        yield _frame(rows)


def _frame(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=[x.split()[0] for x in PRINTS.split(", ")]).astype({"doc_id": "Int64"})


def _with_next(docs: DataFrame, parts: int) -> DataFrame:
    """Rows dealt by ranges of doc_id, each range ended by a copy of the next range's first row (tail = 1); the last by the
    first of all. Ids of many rows have a range of their own, and these and null ids are dealt further by ranges of the texts'
    hashes. The driver gets one number and one key for each range."""
    spark = docs.sparkSession
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    found = np.array(base.approxQuantile("doc_id", [i / parts for i in range(1, parts)], 1 / (4 * parts)) if parts > 1 else [], np.float64)
    cuts, times = np.unique(found, return_counts=True)
    hot = cuts[times > 1]
    cuts = np.union1d(cuts, hot + 1)

    @F.pandas_udf(T.LongType())
    def part_of(ids: pd.Series, hashes: pd.Series) -> pd.Series:
        known = ids.fillna(0)
        deal = ((hashes.to_numpy() >> 32) + (1 << 31)) * parts >> 32
        return pd.Series(np.where(ids.isna(), len(cuts) + 1, np.searchsorted(cuts, known, "right")) * parts + np.where(ids.isna() | np.isin(known, hot), deal, 0))

    base = base.withColumn("h", F.xxhash64("text")).withColumn("part", part_of("doc_id", "h"))
    heads = base.groupBy("part").agg(F.min(F.struct("doc_id", "h")).alias("head")).orderBy("part").collect()
    before = [(r["part"], r["head"]["doc_id"], r["head"]["h"], heads[i - 1]["part"]) for i, r in enumerate(heads)]
    before = spark.createDataFrame(before, "head_part long, head_id long, head_h long, before long")
    head = (F.col("part") == F.col("head_part")) & F.col("doc_id").eqNullSafe(F.col("head_id")) & (F.col("h") == F.col("head_h"))
    marked = base.join(F.broadcast(before), head, "left")
    own = F.struct(F.col("part"), F.lit(0).alias("tail"))
    copies = F.when(F.col("before").isNull(), F.array(own)).otherwise(F.array(own, F.struct(F.col("before").alias("part"), F.lit(1).alias("tail"))))
    dealt = marked.select("doc_id", "text", "h", F.explode(copies).alias("to")).select("doc_id", "text", "h", "to.part", "to.tail")
    return dealt.repartition(parts, "part").sortWithinPartitions("part", "tail", F.col("doc_id").asc_nulls_last(), "h").select("doc_id", "text", "part", "tail")


def print_documents(docs: DataFrame, parts: int | None = None) -> DataFrame:
    """Fingerprints of every whole text and of its edited text, as PRINTS lists.

    Null texts count as empty, with empty fingerprints, which are alike (1). The next document is by (doc_id, text hash), null
    ids last, and the first follows the last; a single row follows itself. Repeated rows are printed each. Texts are shuffled
    once, by range of doc_id, in ranges of about PART bytes; a partition holds two texts at a time.
    """
    if not parts:
        size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        parts = min(MOST_PARTS, max(docs.sparkSession.sparkContext.defaultParallelism, size // PART))
    return _with_next(docs, parts).mapInPandas(_print_rows, PRINTS)


def op2_winnow_prints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return print_documents(table(spark, sf_dir, "documents"))
