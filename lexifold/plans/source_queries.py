"""Queries of sources and sinks: files and tables made from the given tables, written where all executors can read, and read back."""

from __future__ import annotations

import io
import wave
import zipfile
from xml.sax.saxutils import escape

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import retrieve as r
from ..session import shared_place
from ..sources import readers as io_
from .retrieval_queries import SQL as RETRIEVAL_SQL
from .tables import table

_NAMESPACE = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"


def _office_file(lines: list[str]) -> bytes:
    """An office document of a heading and paragraphs."""
    style = '<w:pPr><w:pStyle w:val="Heading1"/></w:pPr>'
    body = "".join(f"<w:p>{style if i == 0 else ''}<w:r><w:t>{escape(x)}</w:t></w:r></w:p>" for i, x in enumerate(lines))
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="{_NAMESPACE}"><w:body>{body}</w:body></w:document>')
    return out.getvalue()


def _office_files(spark: SparkSession, d: str) -> DataFrame:
    """A file for each document; every 50th is cut short."""

    @F.pandas_udf("binary")
    def made(texts: pd.Series, broken: pd.Series) -> pd.Series:
        return pd.Series([_office_file((t or "").split("\n"))[: 20 if b else None] for t, b in zip(texts, broken)], dtype=object)

    n = F.col("doc_id")
    day = lambda y: F.format_string("%02d.%02d.%04d", n % 28 + 1, n % 12 + 1, n % 20 + y)
    name = F.concat(F.lit("in/Order "), n.cast("string"), F.lit(" of "), day(2000), F.lit(" and "), day(2001), F.lit(".docx"))
    return table(spark, d, "documents").select(name.alias("path"), made("text", n % 50 == 7).alias("content"))


def io1_extract(spark: SparkSession, d: str) -> DataFrame:
    out = io_.extract_contents(_office_files(spark, d)).where("error is null")
    return out.select("source", F.md5("text").alias("text_md5"), "char_count", "para_count", "table_count", "issued_date", "revision_date")


def io2_failures(spark: SparkSession, d: str) -> DataFrame:
    return io_.failures(io_.extract_contents(_office_files(spark, d))).select("source", F.split_part("error", F.lit(":"), F.lit(1)).alias("kind"))


def io3_corpus(spark: SparkSession, d: str) -> DataFrame:
    """A manifest of which every ninth row names no file, every tenth one that isn't there, and every seventh text is a few words."""
    docs, n = table(spark, d, "documents"), F.col("doc_id")
    txt = F.concat(n.cast("string"), F.lit(".txt"))
    manifest = docs.select(F.concat(F.lit("s"), n.cast("string")).alias("source"), F.when(n % 9 == 0, None).when(n % 10 == 0, "gone.txt").otherwise(txt).alias("txt"))
    body = F.when(n % 7 == 0, "few words").when(n % 2 == 0, F.concat(F.lit("x\n## Title "), n.cast("string"), F.lit("\n"), "text")).otherwise(F.col("text"))
    return io_.load_corpus(manifest, docs.select(txt.alias("name"), body.alias("text"))).select("source", "title", F.md5("text").alias("text_md5"))


def io4_json(spark: SparkSession, d: str) -> DataFrame:
    """Conversations as JSON lines with nested rows, written and read back."""
    at = shared_place(spark, "json")
    turns = table(spark, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("rows"))
    turns.write.json(at)
    return io_.read_json_rows(spark, at, "conv_id long, rows array<struct<turn:long,role:string,text:string>>", rows="rows")


def io5_notes(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("doc_id")
    name = F.when(n % 40 == 3, "INDEX.md").otherwise(F.concat(n.cast("string"), F.lit(".md")))
    front = F.when(n % 3 > 0, F.concat(F.lit('---\nsources: ["order '), n.cast("string"), F.lit('", "b"]\n---')))
    title = F.when(n % 2 == 0, F.concat(F.lit("\n# Note "), n.cast("string"), F.lit("  \n"))).otherwise(F.lit("\n"))
    notes = table(spark, d, "documents").select(name.alias("name"), F.concat(F.coalesce(front, F.lit("")), title, F.replace("text", F.lit("#"), F.lit(""))).alias("text"))
    return io_.parse_notes(notes).select("name", "primary", "title", F.length("text").cast("long").alias("chars"))


def _index(spark: SparkSession, d: str) -> tuple[str, dict[str, DataFrame]]:
    chunks = table(spark, d, "documents").select(F.col("doc_id").alias("chunk_id"), "text")
    postings, terms, stats = r.build_bm25(chunks)
    return shared_place(spark, "index"), {"chunks": chunks, "postings": postings, "terms": terms, "stats": stats}


def io6_index(spark: SparkSession, d: str) -> DataFrame:
    """Questions answered from a sparse index that was written twice and opened."""
    at, parts = _index(spark, d)
    io_.write_index(at, **parts)
    io_.write_index(at, chunks=parts["chunks"])
    opened = io_.open_index(spark, at, tuple(parts))
    questions = table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    return r.bm25_topk(questions, (opened["postings"], opened["terms"], opened["stats"]), 5)


def io6_jsonl(spark: SparkSession, d: str) -> DataFrame:
    """Documents as chunks, exported as JSON lines twice and read back."""
    at = shared_place(spark, "jsonl")
    chunks = table(spark, d, "documents").select(F.col("doc_id").alias("chunk_id"), "text", F.when(F.col("doc_id") % 3 != 0, F.col("source")).alias("point"))
    for _ in range(2):
        io_.export_jsonl(chunks, at)
    return io_.read_json_rows(spark, at, "chunk_id long, text string, point string").select("chunk_id", F.md5("text").alias("text_md5"), "point")


def io7_missing(spark: SparkSession, d: str) -> DataFrame:
    """Parts that an index of chunks alone lacks, with the chunks that it has."""
    at, parts = _index(spark, d)
    io_.write_index(at, chunks=parts["chunks"])
    missing = spark.createDataFrame([(p,) for p in io_.missing_parts(spark, at)], "part string")
    return missing.join(F.broadcast(io_.open_index(spark, at, ("chunks",))["chunks"].agg(F.count("*").alias("chunks"))))


def io8_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Recordings named after documents, of which two thirds have a transcript of the same stem."""
    docs, n = table(spark, d, "documents"), F.col("doc_id").cast("string")
    recordings = docs.select(F.concat(F.lit("rec/"), n, F.lit(".wav")).alias("path"))
    transcripts = docs.where("doc_id % 3 > 0").select(F.concat(F.lit("txt/a/"), n, F.lit(".txt")).alias("path"), "text")
    paired, alone = io_.pair_by_stem(recordings, transcripts)
    return paired.select("path", F.md5("transcript").alias("transcript_md5")).unionByName(alone.select("path", F.lit(None).cast("string").alias("transcript_md5")))


def io10_wav(spark: SparkSession, d: str) -> DataFrame:
    """Sound files of vectors: every second one has two channels, every tenth eight bits, every 25th is no sound file."""

    @F.pandas_udf("binary")
    def made(ids: pd.Series, vectors: pd.Series) -> pd.Series:
        out = []
        for i, v in zip(ids.tolist(), vectors):
            buffer = io.BytesIO()
            with wave.open(buffer, "wb") as w:
                w.setnchannels(2 if i % 2 else 1)
                w.setsampwidth(1 if i % 10 == 4 else 2)
                w.setframerate(16_000)
                w.writeframes(np.floor(np.asarray(v, np.float64) * 1000).astype("<i2").tobytes())
            out.append(b"none" if i % 25 == 3 else buffer.getvalue())
        return pd.Series(out, dtype=object)

    files = table(spark, d, "embeddings").select("vec_id", made("vec_id", "embedding").alias("content"))
    read = files.select("vec_id", io_.decode_wav(F.col("content")).alias("w")).select("vec_id", "w.*")
    total = F.aggregate("samples", F.lit(0).cast("long"), lambda a, x: a + x)
    return read.select("vec_id", "rate", F.size("samples").alias("n"), F.get("samples", F.lit(0)).cast("int").alias("first"), total.alias("total"), F.col("error").isNotNull().alias("failed"))


_LINES = "list_transform(string_split(coalesce(text, ''), chr(10)), lambda x: trim(x, ' ' || chr(9) || chr(13)))"
_OFFICE = f"""o AS (SELECT doc_id, 'Order ' || doc_id || ' of ' || dd || '.' || (doc_id % 20 + 2000) || ' and ' || dd || '.' || (doc_id % 20 + 2001) || '.docx' AS source, dd, {_LINES} AS l
  FROM (SELECT *, lpad((doc_id % 28 + 1)::VARCHAR, 2, '0') || '.' || lpad((doc_id % 12 + 1)::VARCHAR, 2, '0') AS dd FROM documents))"""
SQL = {
    "io6_jsonl": "SELECT doc_id AS chunk_id, md5(text) AS text_md5, CASE WHEN doc_id % 3 <> 0 THEN source END AS point FROM documents",
    "io6_index": RETRIEVAL_SQL["rt2_bm25_topk"],
    "io1_extract": rf"""WITH {_OFFICE}, t AS (SELECT *, trim(regexp_replace(CASE WHEN l[1] <> '' THEN '## ' ELSE '' END || array_to_string(l, chr(10)), '
{{2,}}', chr(10) || chr(10), 'g'), chr(10)) || chr(10) AS t FROM o WHERE doc_id % 50 <> 7)
SELECT source, md5(t) AS text_md5, length(t) AS char_count, len(list_filter(l, lambda x: x <> '')) AS para_count, 0::BIGINT AS table_count, strptime(dd || '.' || (doc_id % 20 + 2000), '%d.%m.%Y')::DATE AS issued_date, strptime(dd || '.' || (doc_id % 20 + 2001), '%d.%m.%Y')::DATE AS revision_date FROM t""",
    "io2_failures": f"WITH {_OFFICE} SELECT source, 'BadZipFile' AS kind FROM o WHERE doc_id % 50 = 7",
    "io3_corpus": r"""WITH b AS (SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN 'few words' WHEN doc_id % 2 = 0 THEN 'x' || chr(10) || '## Title ' || doc_id || chr(10) || text ELSE text END AS text FROM documents WHERE doc_id % 9 <> 0 AND doc_id % 10 <> 0)
SELECT 's' || doc_id AS source, CASE WHEN doc_id % 2 = 0 THEN 'Title ' || doc_id ELSE 's' || doc_id END AS title, md5(text) AS text_md5 FROM b WHERE length(trim(text, ' ' || chr(9) || chr(10) || chr(13))) >= 50""",
    "io4_json": "SELECT turn, role, text FROM conversations",
    "io5_notes": """SELECT doc_id || '.md' AS name, CASE WHEN doc_id % 3 > 0 THEN 'order ' || doc_id END AS primary, CASE WHEN doc_id % 2 = 0 THEN 'Note ' || doc_id ELSE doc_id::VARCHAR END AS title,
  length(CASE WHEN doc_id % 2 = 0 THEN chr(10) || '# Note ' || doc_id || '  ' || chr(10) ELSE chr(10) END || replace(text, '#', '')) AS chars FROM documents WHERE doc_id % 40 <> 3""",
    "io7_missing": "SELECT part, (SELECT count(*) FROM documents) AS chunks FROM (VALUES ('postings'), ('terms'), ('stats'), ('vectors')) x(part)",
    "io8_pairs": "SELECT 'rec/' || doc_id || '.wav' AS path, CASE WHEN doc_id % 3 > 0 THEN md5(text) END AS transcript_md5 FROM documents",
    "io10_wav": """WITH v AS (SELECT vec_id, list_transform(embedding, lambda e: floor(e::DOUBLE * 1000)::BIGINT) AS s, vec_id % 25 = 3 AS none, vec_id % 10 = 4 AS low FROM embeddings),
x AS (SELECT vec_id, none, low, CASE WHEN none OR low THEN NULL WHEN vec_id % 2 = 1 THEN list_transform(range(1, len(s), 2), lambda i: trunc((s[i] + s[i + 1]) / 2.0::DOUBLE)::BIGINT) ELSE s END AS s FROM v)
SELECT vec_id, CASE WHEN NOT none THEN 16000::INT END AS rate, len(s)::INT AS n, s[1]::INT AS first, list_sum(s)::BIGINT AS total, none OR low AS failed FROM x""",
}
QUERIES = {n: f for n, f in list(globals().items()) if n[:2] == "io" and n[2:3].isdigit() and callable(f)}
