"""Operator 3: benchmark decontamination by size-partitioned MinHash containment search."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stash, table
from .textkit import shingle_sets

#: An item is found in a document that holds at least this part of its distinct shingles.
CONTAINMENT = (75, 100)
#: Sketch values beyond those that a found item can miss; so many must meet before an item is opened.
SPARE = 4
#: Shingles of items broadcast at once (8 bytes each): more items are searched in further blocks.
BLOCK = 1 << 20

FOUND = "doc_id long, item_id long, item_shingles long, doc_shingles long, shared long, containment double"


def _item_sets(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for f in frames:
        sets = list(shingle_sets(f["text"]))
        yield pd.DataFrame({"item_id": f["item_id"].astype("Int64"), "n": [len(s) for s in sets], "hashes": [s.tobytes() for s in sets]})


class SizePartition:
    """The items whose sizes lie within one power of two: their sketches as one sorted array, with the item of each value.

    An item of n shingles may miss `gap` of them; its sketch is the gap + SPARE smallest hashes, of which a document that holds
    the item therefore has at least SPARE (for small items: len - gap). So no item that is to be found is passed over.
    """

    def __init__(self, items: list[tuple[int | None, np.ndarray]], at_least: tuple[int, int]):
        self.items = items
        gap = [len(s) - -(-len(s) * at_least[0] // at_least[1]) for _, s in items]
        sketches = [s[: g + SPARE] for g, (_, s) in zip(gap, items)]
        self.need = np.array([len(k) - g for g, k in zip(gap, sketches)])
        values, owner = np.concatenate(sketches), np.repeat(np.arange(len(items)), [len(k) for k in sketches])
        order = np.argsort(values, kind="stable")
        self.values, self.owner = values[order], owner[order]
        self.least = min(-(-len(s) * at_least[0] // at_least[1]) for _, s in items)

    def candidates(self, found: np.ndarray) -> list[int]:
        """Items that enough of the given values, of one document, belong to."""
        low, high = np.searchsorted(self.values, found, "left"), np.searchsorted(self.values, found, "right")
        hit = np.flatnonzero(high > low)
        if not len(hit):
            return []
        owners = np.concatenate([self.owner[a:b] for a, b in zip(low[hit].tolist(), high[hit].tolist())])
        hits = np.bincount(owners, minlength=len(self.items))
        return np.flatnonzero((hits >= self.need) & (hits > 0)).tolist()


def _search(block, at_least: tuple[int, int]) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        by_size: dict[int, list] = {}
        for item_id, hashes in block.value:
            s = np.frombuffer(hashes, np.uint64)
            by_size.setdefault(len(s).bit_length(), []).append((item_id, s))
        parts = [SizePartition(items, at_least) for _, items in sorted(by_size.items())]
        sketched = np.unique(np.concatenate([p.values for p in parts]))
        for f in frames:
            rows = []
            for doc_id, found in zip(f["doc_id"].tolist(), shingle_sets(f["text"])):
                place = np.minimum(np.searchsorted(sketched, found), len(sketched) - 1)
                few = found[sketched[place] == found]
                if not len(few):
                    continue
                for part in parts:
                    if len(found) < part.least:  # too small for any item of this size
                        continue
                    for i in part.candidates(few):
                        item_id, s = part.items[i]
                        shared = int(np.isin(s, found, assume_unique=True).sum())
                        if shared * at_least[1] >= at_least[0] * len(s):
                            rows.append((doc_id, item_id, len(s), len(found), shared, shared / len(s)))
            yield pd.DataFrame(rows, columns=["doc_id", "item_id", "item_shingles", "doc_shingles", "shared", "containment"]).astype({"doc_id": "Int64", "item_id": "Int64"})

    return run


def find_items(docs: DataFrame, items: DataFrame, at_least: tuple[int, int] = CONTAINMENT) -> DataFrame:
    """(doc_id, item_id, item_shingles, doc_shingles, shared, containment) for each document row that holds at least the given
    part of an item's distinct five-word shingles.

    Items are the queries, in blocks of bounded size; every document is searched whole and nothing is shuffled. Items and
    documents without words are found nowhere; those of one to four words count as one shingle, which is found only in a
    document of just these words. Null ids stay null; repeated rows are found each; empty tables give no rows.
    """
    spark = docs.sparkSession
    sets = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").alias("text")).mapInPandas(_item_sets, "item_id long, n long, hashes binary")
    sets = stash(sets.where("n > 0"), "items")
    total = sets.agg(F.sum("n")).first()[0] or 0
    blocks = -(-total // BLOCK)
    out = spark.createDataFrame([], FOUND)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text"))
    for b in range(blocks):
        part = sets if blocks == 1 else sets.where(F.pmod(F.xxhash64("item_id", "hashes"), F.lit(blocks)) == b)
        block = spark.sparkContext.broadcast([(r["item_id"], bytes(r["hashes"])) for r in part.select("item_id", "hashes").collect()])
        if block.value:
            found = texts.mapInPandas(_search(block, at_least), FOUND)
            out = found if blocks == 1 else out.unionByName(found)
    return out


def drop_contaminated(docs: DataFrame, items: DataFrame, at_least: tuple[int, int] = CONTAINMENT) -> DataFrame:
    """The rows of docs whose doc_id isn't among those that hold an item; a row that shares its doc_id with one goes too."""
    hit = stash(find_items(docs, items, at_least).select(F.col("doc_id").alias("hit")).distinct(), "contaminated")
    rows = docs.select(F.struct("*").alias("row"))
    return rows.join(hit, F.col("row.doc_id").cast("long").eqNullSafe(F.col("hit")), "left_anti").select("row.*")


def op3_benchmark_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


SETS_SQL = r"""
  SELECT DISTINCT {id}, CASE WHEN len(w) >= 5 THEN array_to_string(w[i:i + 4], ' ') ELSE len(w) || ':' || array_to_string(w, ' ') END AS s
  FROM (SELECT {id}, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i
        FROM (SELECT {id}, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM {table})
        WHERE len(w) > 0)
"""
OP3_SQL = f"""
WITH d AS ({SETS_SQL.format(id="doc_id", table="documents")}), b AS ({SETS_SQL.format(id="item_id", table="benchmark")}),
n AS (SELECT doc_id, count(*) AS doc_shingles FROM d GROUP BY doc_id),
q AS (SELECT item_id, count(*) AS item_shingles FROM b GROUP BY item_id)
SELECT doc_id, item_id, item_shingles, doc_shingles, count(*) AS shared, count(*)::DOUBLE / item_shingles AS containment
FROM d JOIN b USING (s) JOIN n USING (doc_id) JOIN q USING (item_id)
GROUP BY doc_id, item_id, item_shingles, doc_shingles HAVING 100 * count(*) >= 75 * item_shingles
"""
