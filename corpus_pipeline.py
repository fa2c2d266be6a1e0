"""The corpus pipeline: five stages from documents to shards, each one operator of lexifold.llm.

Rows go through as they are: columns beyond those of documents stay, and names that clash with an operator's own are kept. Null and
empty texts are clean, link with nothing, hold no item, count no words and have the size of the overhead. Texts of any length are
read whole. An empty table gives an empty one at every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexifold.llm.common import stash, table
from lexifold.llm.decontamination import drop_contaminated
from lexifold.llm.mixing import mix_sources, repeat_rows
from lexifold.llm.ngram_join import keep_representatives
from lexifold.llm.sharding import assign_shards
from lexifold.llm.toxicity import drop_toxic


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the restored text's score doesn't call toxic. Equal texts have equal scores, so repeated rows go or stay
    together. Without labels nothing has evidence, and all stay."""
    return drop_toxic(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that with the smallest doc_id, of each group of documents linked by shingle similarity. Rows that share that
    doc_id all stay, and so do rows without one."""
    return keep_representatives(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item. A row that shares its doc_id with one that does goes too."""
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of sources: documents as often as it takes them, twice at most. A null source is a source; where all texts are without
    words the mix is empty."""
    return repeat_rows(mix_sources(docs))


def sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row with its shard and virtual slot, which replace columns of these names. Rows of one doc_id, or of none, share a slot."""
    return assign_shards(docs.drop("shard", "virtual_slot")).select("row.*", "shard", F.col("vslot").alias("virtual_slot"))


STAGES = [
    ("toxicity", toxicity),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("mixing", mixing),
    ("sharding", sharding),
]

#: The learned score of the first stage can't be had in SQL; tests compare the stages with plain ones.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stash(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
