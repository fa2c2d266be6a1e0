"""Reading the tables, and inputs derived from them by integer arithmetic, alike in Spark and in SQL."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.sparse_index import SparseIndex, add_chunks, open_sparse
from ..session import shared_root


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def version_of(spark: SparkSession, path: str) -> str:
    """A name for a table as it is now: a checksum of its place and of its files' names, sizes and times."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = at.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(at)
    found = sorted((f.getPath().toString(), f.getLen(), f.getModificationTime()) for f in files)
    return hashlib.md5(repr((path, found)).encode()).hexdigest()


def kept_index(spark: SparkSession, sf_dir: str) -> SparseIndex:
    """The sparse index over documents. The first query that needs it builds it in the shared folder, the others open it; documents that
    have changed since have another one."""
    path = f"{shared_root(spark)}/sparse-{version_of(spark, f'{sf_dir}/documents.parquet')}"
    add_chunks(path, table(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), "text"), "documents")
    return open_sparse(spark, path)


def document_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, pos, line): lines of documents given structure. Line 0 is marked as heading; every third line has its number as
    point; lines at 7 mod 11 are in capitals."""
    lines = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("pos", "raw"))
    line = F.when(F.col("pos") == 0, F.concat(F.lit("## "), "raw")).when(F.col("pos") % 11 == 7, F.upper(F.replace("raw", F.lit("ß"), F.lit("ss")))).when(F.col("pos") % 3 == 0, F.concat(F.col("pos").cast("string"), F.lit(". "), "raw")).otherwise(F.col("raw"))
    return lines.select("doc_id", "pos", line.alias("line"))


LINES_SQL = """SELECT doc_id, pos::INT AS pos, CASE WHEN pos = 0 THEN '## ' || raw WHEN pos % 11 = 7 THEN upper(replace(raw, 'ß', 'ss')) WHEN pos % 3 = 0 THEN pos || '. ' || raw ELSE raw END AS line
  FROM (SELECT doc_id, unnest(l) AS raw, unnest(range(len(l))) AS pos FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents))"""


def eval_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, question, answer, gold_source, gold_quote, topic, difficulty): one for each document. Quotes are fragments from a quarter of
    the text on, and for even ids from its middle on too; every 7th has a corrupt quote, every 11th an unknown source, every 13th a
    bad topic, every 17th no answer, every 19th a bad difficulty, every 23rd no quote."""
    d, n = table(spark, sf_dir, "documents"), F.col("doc_id")
    cut = lambda part, length: F.substring("text", F.floor(F.length("text") / part).cast("int") + 1, F.lit(length))
    quote = F.concat(cut(4, 60), F.when(n % 2 == 0, F.concat(F.lit("…"), cut(2, 40))).otherwise(F.lit("")))
    return d.select(
        n.alias("id"), F.col("text").alias("question"), F.when(n % 11 == 0, F.lit("unknown")).otherwise(n.cast("string")).alias("gold_source"),
        F.when(n % 23 == 0, "").when(n % 7 == 0, F.concat(F.lit("zzqx "), quote)).otherwise(quote).alias("gold_quote"), F.when(n % 13 == 0, F.lit("none")).otherwise(F.concat(F.lit("topic"), (n % 12).cast("string"))).alias("topic"),
        F.when(n % 17 != 0, F.substring("text", 1, 40)).alias("answer"), F.when(n % 19 == 0, "hardest").when(n % 3 == 0, "easy").when(n % 3 == 1, "medium").otherwise("hard").alias("difficulty"),
    )


ITEMS_SQL = """SELECT doc_id AS id, text AS question, CASE WHEN doc_id % 11 = 0 THEN 'unknown' ELSE doc_id::VARCHAR END AS gold_source,
  CASE WHEN doc_id % 23 = 0 THEN '' ELSE CASE WHEN doc_id % 7 = 0 THEN 'zzqx ' ELSE '' END || substr(text, length(text) // 4 + 1, 60) || CASE WHEN doc_id % 2 = 0 THEN '…' || substr(text, length(text) // 2 + 1, 40) ELSE '' END END AS gold_quote,
  CASE WHEN doc_id % 17 <> 0 THEN substr(text, 1, 40) END AS answer, CASE WHEN doc_id % 19 = 0 THEN 'hardest' WHEN doc_id % 3 = 0 THEN 'easy' WHEN doc_id % 3 = 1 THEN 'medium' ELSE 'hard' END AS difficulty,
  CASE WHEN doc_id % 13 = 0 THEN 'none' ELSE 'topic' || (doc_id % 12) END AS topic FROM documents"""


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(session, seq, role, text, start_ms, end_ms): conversations as timed turns, 20 ms a character, every third starting 400 ms
    early; assistants are agents, system turns are left out."""
    c = table(spark, sf_dir, "conversations").where("role <> 'system'")
    w = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    n = F.length("text") * 20
    c = c.withColumn("seq", F.row_number().over(w)).withColumn("done", F.coalesce(F.sum(n).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    start = F.greatest(F.lit(0), F.col("done") - F.when(F.col("seq") % 3 == 0, 400).otherwise(0)).cast("long")
    role = F.when(F.col("role") == "assistant", "agent").otherwise(F.col("role"))
    return c.select(F.col("conv_id").alias("session"), "seq", role.alias("role"), "text", start.alias("start_ms"), (start + n).cast("long").alias("end_ms"))


TURNS_SQL = """SELECT session, seq, role, text, start_ms, start_ms + 20 * length(text) AS end_ms FROM (
  SELECT conv_id AS session, seq::INT AS seq, CASE role WHEN 'assistant' THEN 'agent' ELSE role END AS role, text, greatest(0, done - CASE WHEN seq % 3 = 0 THEN 400 ELSE 0 END)::BIGINT AS start_ms FROM (
    SELECT conv_id, role, text, row_number() OVER w AS seq, coalesce(sum(20 * length(text)) OVER (PARTITION BY conv_id ORDER BY turn, role, text ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS done
    FROM conversations WHERE role <> 'system' WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text)))"""


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(session, seq, at_ms, duration_ms, prob, agent): 100 ms frames from the events of a user."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = table(spark, sf_dir, "events").withColumn("seq", F.row_number().over(w) - 1)
    near = F.max(F.when(F.col("event_type") == "purchase", F.col("seq"))).over(w.rowsBetween(-7, 0))
    return e.select(F.col("user_id").alias("session"), "seq", (F.col("seq") * 100).cast("long").alias("at_ms"), F.lit(100).alias("duration_ms"), F.when(F.col("event_id") % 5 < 3, 0.9).otherwise(0.1).alias("prob"), near.isNotNull().alias("agent"))


FRAMES_SQL = """SELECT user_id AS session, seq::INT AS seq, (100 * seq)::BIGINT AS at_ms, 100::INT AS duration_ms, CASE WHEN event_id % 5 < 3 THEN 0.9 ELSE 0.1 END::DOUBLE AS prob,
  max(CASE WHEN event_type = 'purchase' THEN seq END) OVER (PARTITION BY user_id ORDER BY seq ROWS BETWEEN 7 PRECEDING AND CURRENT ROW) IS NOT NULL AS agent
  FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS seq FROM events)"""


def judge_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(backend, top_k, id, topic, chunks_score, answer_score, style_score): 3 backends x 4 top_k for each document; null scores are
    unparsed."""
    cells = F.explode(F.sequence(F.lit(0), F.lit(11)))
    r = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), cells.alias("cell")).withColumn("b", (F.col("cell") / 4).cast("int")).withColumn("k", (F.col("cell") % 4 + 1) * 5)
    score = lambda a: F.when((F.col("id") + F.col("k")) % 31 != 0, ((F.col("id") * 7 + F.col("b") * 13 + F.col("k") * a) % 11) / 10.0)
    topic = F.concat(F.lit("topic"), (F.col("id") % 12).cast("string")).alias("topic")
    return r.select(F.concat(F.lit("b"), F.col("b").cast("string")).alias("backend"), F.col("k").cast("int").alias("top_k"), "id", topic, score(3).alias("chunks_score"), score(5).alias("answer_score"), score(7).alias("style_score"))


_SCORE = "CASE WHEN (id + k) % 31 <> 0 THEN ((id * 7 + b * 13 + k * {}) % 11) / 10.0::DOUBLE END AS {}"
JUDGE_SQL = f"""SELECT 'b' || b AS backend, k::INT AS top_k, id, 'topic' || (id % 12) AS topic, {_SCORE.format(3, "chunks_score")}, {_SCORE.format(5, "answer_score")}, {_SCORE.format(7, "style_score")}
  FROM (SELECT doc_id AS id, c // 4 AS b, (c % 4 + 1) * 5 AS k FROM documents, range(12) r(c))"""
