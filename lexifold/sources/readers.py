"""Sources and sinks: office documents, notes, JSON, sound, frames, and index tables."""

from __future__ import annotations

import io
import wave
import xml.etree.ElementTree as ET
import zipfile
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import filename_dates, strip

_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
EXTRACTED = "source string, text string, char_count long, para_count long, table_count long, error string"
INDEX_PARTS = ("chunks", "postings", "terms", "stats", "vectors")


def _runs(p: ET.Element) -> str:
    marks = {f"{_W}tab": "\t", f"{_W}br": "\n", f"{_W}cr": "\n"}
    return "".join((n.text or "") if n.tag == f"{_W}t" else marks.get(n.tag, "") for n in p.iter())


def _headed(p: ET.Element) -> bool:
    style = p.find(f"{_W}pPr/{_W}pStyle")
    name = (style.get(f"{_W}val") or "").lower() if style is not None else ""
    return "heading" in name or "заголовок" in name or name.startswith("h")


def _row(tr: ET.Element) -> str:
    cells: list[str] = []
    for tc in tr.findall(f"{_W}tc"):
        cell = " ".join(w for p in tc.findall(f"{_W}p") for w in _runs(p).split())
        if not cells or cells[-1] != cell:
            cells.append(cell)
    return " | ".join(cells)


def office_text(data: bytes) -> tuple[str, int, int]:
    """(text, paragraphs, tables) of an office document in reading order: headings marked with ##, table rows with |, blank
    paragraphs in a row as one."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        body = ET.fromstring(z.read("word/document.xml")).find(f"{_W}body")
    if body is None:
        raise ValueError("no body")
    lines, paragraphs, tables, blank = [], 0, 0, False
    for child in body:
        if child.tag == f"{_W}p":
            text = _runs(child).strip()
            if text:
                lines.append(f"## {text}" if _headed(child) else text)
                paragraphs += 1
            elif not blank:
                lines.append("")
            blank = not text
        elif child.tag == f"{_W}tbl":
            lines += ["", "\n".join(map(_row, child.findall(f"{_W}tr"))), ""]
            tables, blank = tables + 1, False
    return "\n".join(lines).strip() + "\n", paragraphs, tables


def extract_contents(files: DataFrame) -> DataFrame:
    """EXTRACTED of files (path, content), with issued and revision dates from their names. What can't be read is a row with its error."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for path, data in zip(f["path"], f["content"]):
                name = path.rsplit("/", 1)[-1]
                try:
                    text, paragraphs, tables = office_text(data)
                    rows.append((name, text, len(text), paragraphs, tables, None))
                except Exception as e:  # a broken file may fail anywhere
                    rows.append((name, None, None, None, None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in EXTRACTED.split(", ")])

    read = files.select("path", "content").mapInPandas(run, EXTRACTED)
    return read.withColumn("dates", filename_dates(F.col("source"))).select("*", F.col("dates.issued").alias("issued_date"), F.col("dates.revision").alias("revision_date")).drop("dates")


def extract_documents(spark: SparkSession, paths: str) -> DataFrame:
    """extract_contents of all office documents at paths."""
    return extract_contents(spark.read.format("binaryFile").load(paths))


def failures(extracted: DataFrame) -> DataFrame:
    return extracted.where("error is not null").select("source", "error")


def load_corpus(manifest: DataFrame, texts: DataFrame, least: int = 50) -> DataFrame:
    """Texts (name, text) of a manifest (source, txt): those without a file, and with under `least` characters, are left out. title is
    the first ## line, else the source, cut to 200."""
    j = manifest.where("txt is not null").join(texts.withColumnRenamed("name", "txt"), "txt").where(F.length(strip(F.col("text"))) >= least)
    first = F.get(F.filter(F.split("text", "\n"), lambda x: x.startswith("## ")), F.lit(0))
    return j.withColumn("title", F.substring(F.coalesce(strip(F.regexp_replace(first, "^## ", "")), F.col("source")), 1, 200))


def read_texts(spark: SparkSession, paths: str) -> DataFrame:
    """(name, text) of whole text files."""
    return spark.read.text(paths, wholetext=True).select(F.regexp_extract(F.input_file_name(), r"([^/]+)$", 1).alias("name"), F.col("value").alias("text"))


def read_json_rows(spark: SparkSession, paths: str, schema: str, lines: bool = True, rows: str | None = None) -> DataFrame:
    """JSON lines, or arrays or objects over several lines; with rows, the elements of that array field."""
    df = spark.read.schema(schema).json(paths, multiLine=not lines)
    return df.select(F.explode(rows).alias("r")).select("r.*") if rows else df


def parse_notes(texts: DataFrame, skip: tuple[str, ...] = ("00-context.md", "INDEX.md")) -> DataFrame:
    """(name, primary, title, text) of markdown notes (name, text): front matter cut off, primary its first source, title the first #
    line."""
    n = texts.where(~F.col("name").isin(*skip))
    sources = F.nullif(F.trim(F.regexp_replace(F.split_part(F.regexp_extract("text", r"(?m)^sources:\s*\[(.+?)\]", 1), F.lit(","), F.lit(1)), '"', "")), F.lit(""))
    body = F.regexp_replace("text", r"(?s)\A---.*?\n---", "")
    title = F.nullif(F.regexp_extract(body, r"(?m)^# +(.*?)\s*$", 1), F.lit(""))
    return n.select("name", sources.alias("primary"), F.coalesce(title, F.regexp_replace("name", r"\.md$", "")).alias("title"), body.alias("text"))


def read_notes(spark: SparkSession, paths: str, skip: tuple[str, ...] = ("00-context.md", "INDEX.md")) -> DataFrame:
    """parse_notes of all files at paths."""
    return parse_notes(read_texts(spark, paths), skip)


def write_index(path: str, **parts: DataFrame) -> None:
    """Tables of an index under a folder; a rerun replaces them."""
    for name, df in parts.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}")


def export_jsonl(df: DataFrame, path: str) -> None:
    """A table as JSON lines, a file for each partition, nulls written as such; a rerun replaces it."""
    df.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def kept(df: DataFrame, path: str) -> DataFrame:
    """df written once as Parquet and read back, so that what uses it several times doesn't make it again."""
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def missing_parts(spark: SparkSession, path: str, parts: tuple[str, ...] = INDEX_PARTS) -> list[str]:
    """The tables that an index lacks."""
    jvm = spark._jvm
    missing = []
    for name in parts:
        at = jvm.org.apache.hadoop.fs.Path(f"{path}/{name}")
        if not at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
            missing.append(name)
    return missing


def open_index(spark: SparkSession, path: str, parts: tuple[str, ...] = INDEX_PARTS) -> dict[str, DataFrame]:
    """The tables of an index; one error names all that are missing."""
    if missing := missing_parts(spark, path, parts):
        raise FileNotFoundError(f"index {path} has no {', '.join(missing)}")
    return {name: spark.read.parquet(f"{path}/{name}") for name in parts}


def pair_by_stem(recordings: DataFrame, transcripts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(recordings with the transcript of the same stem, recordings without one), by path columns."""
    stem = lambda c: F.regexp_replace(F.regexp_extract(c, r"([^/]+)$", 1), r"\.[^.]*$", "")
    r, t = recordings.withColumn("stem", stem("path")), transcripts.select(stem("path").alias("stem"), F.col("text").alias("transcript"))
    return r.join(t, "stem"), r.join(t, "stem", "left_anti")


def _unsigned(hexed: Column, places: list[int]) -> Column:
    """A whole number from bytes of a hex string, the highest place first."""
    return F.conv(F.concat(*(F.substring(hexed, 2 * p + 1, 2) for p in places)), 16, 10).cast("long")


def decode_frames(frames: DataFrame, rate: int = 16_000) -> DataFrame:
    """frames (frame binary) with offset_ms (four bytes, the lowest first), samples (16-bit, the lowest byte first), duration_ms and
    error for frames under four bytes or with half a sample."""
    hexed = F.hex("frame")
    n = F.octet_length("frame")
    bad = (n < 4) | (n % 2 == 1) | n.isNull()
    count = F.floor((n - 4) / 2).cast("int")
    word = lambda i: F.conv(F.concat(F.substr(hexed, i * 4 + 11, F.lit(2)), F.substr(hexed, i * 4 + 9, F.lit(2))), 16, 10).cast("int")
    samples = F.when(count > 0, F.transform(F.sequence(F.lit(0), count - 1), lambda i: F.when(word(i) > 32767, word(i) - 65536).otherwise(word(i)).cast("smallint"))).otherwise(F.array().cast("array<smallint>"))
    return frames.withColumn("offset_ms", F.when(~bad, _unsigned(hexed, [3, 2, 1, 0]))).withColumn("samples", F.when(~bad, samples)).withColumn("duration_ms", F.when(~bad, F.floor(F.size("samples") * 1000 / rate))).withColumn("error", F.when(bad, "short frame"))


def wav_samples(data: bytes) -> tuple[int | None, list[int] | None, str | None]:
    """(rate, samples, error): 16-bit sound, two channels averaged toward 0."""
    try:
        with wave.open(io.BytesIO(data)) as w:
            channels, width, rate, raw = w.getnchannels(), w.getsampwidth(), w.getframerate(), w.readframes(w.getnframes())
    except (wave.Error, EOFError) as e:
        return None, None, f"not a sound file: {e}"
    if width != 2 or channels not in (1, 2):
        return rate, None, f"{8 * width} bits, {channels} channels"
    x = np.frombuffer(raw[: len(raw) // (2 * channels) * 2 * channels], "<i2").astype(np.int32)
    if channels == 2:
        x = np.trunc((x[0::2] + x[1::2]) / 2).astype(np.int32)
    return rate, x.tolist(), None


def decode_wav(c: Column) -> Column:
    @F.pandas_udf("rate int, samples array<smallint>, error string")
    def run(s: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([wav_samples(x) for x in s], columns=["rate", "samples", "error"])

    return run(c)
