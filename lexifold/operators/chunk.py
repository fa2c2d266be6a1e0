"""Documents to citable chunks."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import classify_line, point_number, strip

MAX_CHARS, OVERLAP, MIN_CHARS, TARGET = 1200, 180, 40, 900


def cut_points(text: str, max_chars: int, overlap: int) -> Iterator[tuple[int, int]]:
    """(start, end) of windows over a text: each ends after the last ". " of its final `overlap` characters, if there is one, and
    the next begins `overlap` before that."""
    start, n = 0, len(text)
    while start < n:
        end = start + max_chars
        if end >= n:
            yield start, n
            return
        stop = text.rfind(". ", end - overlap, end)
        end = stop + 1 if stop >= 0 else end
        yield start, end
        start = max(start + 1, end - overlap)


def split_text(text: str | None, max_chars: int = MAX_CHARS, overlap: int = OVERLAP) -> list[str]:
    text = (text or "").strip()
    parts = (text[a:b].strip() for a, b in cut_points(text, max_chars, overlap))
    return [p for p in parts if p] or [""]


def split_long(c: Column, max_chars: int = MAX_CHARS, overlap: int = OVERLAP) -> Column:
    """Array of parts of a text, one if it is short."""

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def split(s: pd.Series) -> pd.Series:
        return s.map(lambda t: split_text(t, max_chars, overlap))

    return split(c)


def point_groups(lines: DataFrame, by: str = "doc_id") -> DataFrame:
    """(by, grp, point, section_path, text) from (by, pos, line): text from one numbered point to the next; grp 0 is what stands
    before the first point.

    Headings before the first other line are the section path of all groups (of more than four the first three and the last, each
    cut to 120); later ones are text. Blank and noise lines are left out. One exchange, by document.
    """
    w = Window.partitionBy(by).orderBy("pos")
    s = lines.select(by, "pos", strip(F.col("line")).alias("line")).withColumn("kind", classify_line(F.col("line")))
    s = s.where(~F.col("kind").isin("blank", "noise"))
    s = s.withColumn("title", F.when(F.col("line").startswith("## "), strip(F.substring("line", 4, 1 << 30))).otherwise(F.col("line")))
    s = s.withColumn("open", F.max(F.col("kind").isin("point", "body").cast("int")).over(w)).withColumn("grp", F.sum((F.col("kind") == "point").cast("int")).over(w))
    # the first headings are a group of their own, whose titles all groups of the document get
    s = s.withColumn("grp", F.when(F.col("open") == 1, F.col("grp")).otherwise(-1))
    text = F.when((F.col("kind") == "heading") | (F.col("open") == 0), F.col("title")).otherwise(F.col("line"))
    lines_ = F.array_sort(F.collect_list(F.struct("pos", text.alias("line"))))["line"]
    grouped = s.groupBy(by, "grp").agg(F.min(F.when(F.col("kind") == "point", point_number(F.col("line")))).alias("point"), lines_.alias("lines"))
    heads = F.transform(F.coalesce(F.max(F.when(F.col("grp") == -1, F.col("lines"))).over(Window.partitionBy(by)), F.array().cast("array<string>")), lambda t: F.substring(t, 1, 120))
    grouped = grouped.withColumn("heads", heads).where("grp >= 0")
    path = F.when(F.size("heads") > 4, F.concat(F.slice("heads", 1, 3), F.slice("heads", -1, 1))).otherwise(F.col("heads"))
    return grouped.select(by, "grp", "point", path.alias("section_path"), strip(F.array_join("lines", "\n")).alias("text")).where("text <> ''")


def chunk_documents(lines: DataFrame, max_chars: int = MAX_CHARS, overlap: int = OVERLAP, by: str = "doc_id") -> DataFrame:
    """(by, ord, point, section_path, text): groups of points, long ones split; ord counts a document's chunks from 1."""
    parts = point_groups(lines, by).select(by, "grp", "point", "section_path", F.posexplode(split_long(F.col("text"), max_chars, overlap)).alias("part", "text"))
    return parts.withColumn("ord", F.row_number().over(Window.partitionBy(by).orderBy("grp", "part"))).select(by, "ord", "point", "section_path", "text")


def _merge_groups(target: int):
    @F.pandas_udf("array<int>")
    def groups(sizes: pd.Series, keys: pd.Series) -> pd.Series:
        """The number of the merge that each of a document's chunks goes into: one after the other, as long as they fit."""
        out = []
        for row, names in zip(sizes, keys):
            found, number, room, before = [], -1, 0, None
            for size, key in zip(row.tolist(), names.tolist()):
                if number >= 0 and key == before and room + size + 1 <= target:
                    room += size + 1
                else:
                    number, room, before = number + 1, size, key
                found.append(number)
            out.append(found)
        return pd.Series(out, dtype=object)

    return groups


def merge_siblings(chunks: DataFrame, target: int | None = TARGET, by: str = "doc_id", run: str | None = None, min_chars: int = MIN_CHARS) -> DataFrame:
    """Chunks of a document merged up to target characters (0 or None: not at all), after those under min_chars are dropped. With
    run, a merge also ends where that column's value changes. The first point and section path of a merge stay.

    Lengths and values alone decide what goes together, so only these are read in order, once for each document; the grouping by
    document and merge that follows needs no exchange of its own. Time is in proportion to a document's chunks.
    """
    kept = chunks.where(F.length("text") >= min_chars)
    if not target:
        return kept
    fields = F.struct("ord", (F.col(run) if run else F.lit(0)).alias("key"), "point", "section_path", "text")
    rows = kept.groupBy(by).agg(F.array_sort(F.collect_list(fields)).alias("rows"))
    name = lambda x: F.coalesce(F.concat(F.lit("="), x["key"].cast("string")), F.lit(""))
    numbered = rows.withColumn("groups", _merge_groups(target)(F.transform("rows", lambda x: F.length(x["text"])), F.transform("rows", name)))
    each = numbered.select(by, F.posexplode(F.arrays_zip("groups", "rows")).alias("place", "z")).select(by, F.col("z.groups").alias("grp"), F.struct("place", "z.rows").alias("m"))
    merged = each.groupBy(by, "grp").agg(F.array_sort(F.collect_list("m")).alias("ms")).withColumn("c", F.col("ms.rows"))
    points = F.transform("c", lambda x: x["point"])
    point = F.coalesce(F.get(F.filter(points, lambda p: p != ""), F.lit(0)), F.element_at(points, -1))
    first = F.get("c", F.lit(0))
    return merged.select(by, (F.col("grp") + 1).alias("ord"), point.alias("point"), first["section_path"].alias("section_path"), F.array_join(F.transform("c", lambda x: x["text"]), "\n").alias("text"), *([first["key"].alias(run)] if run else []))


def ordinals(ids: DataFrame, by: str, parts: int = 256) -> DataFrame:
    """(by, ordinal) from 1 for distinct ids in their order, nulls left out. A sample gives bounds of about equal ranges; each range is
    numbered by itself, after the counts of those before it. The bounds only balance the work, whatever they are."""
    every = ids.select(by).where(F.col(by).isNotNull()).distinct()
    sample = sorted(r[0] for r in every.sample(min(1.0, 20.0 * parts / max(1, every.count())), 7).collect())
    bounds = list(dict.fromkeys(sample[len(sample) * k // parts] for k in range(1, parts))) if sample else []
    part = F.size(F.filter(F.array(*map(F.lit, bounds)), lambda x: x <= F.col(by))) if bounds else F.lit(0)
    every = every.withColumn("part", part)
    before = F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))  # a row for each range
    starts = every.groupBy("part").agg(F.count("*").alias("n")).select("part", F.coalesce(before, F.lit(0)).alias("start"))
    placed = every.withColumn("place", F.row_number().over(Window.partitionBy("part").orderBy(by)))
    return placed.join(F.broadcast(starts), "part").select(by, (F.col("start") + F.col("place")).alias("ordinal"))


def assign_chunk_ids(chunks: DataFrame, manifest: DataFrame, by: str = "doc_id") -> DataFrame:
    """Ids `document-chunk`: the document's place in the manifest (two digits at least), the chunk's in it (four)."""
    placed = chunks.withColumn("c", F.row_number().over(Window.partitionBy(by).orderBy("ord")))
    return placed.join(ordinals(manifest, by).withColumnRenamed("ordinal", "d"), by).withColumn("id", F.format_string("%02d-%04d", "d", "c")).drop("d", "c")


def citation_units(lines: DataFrame, mark: str = "Источник:", skip: str = "см. также", min_chars: int = 25, by: str = "note") -> DataFrame:
    """(by, unit, head, text) from (by, pos, line) of notes: text up to a line with the mark; headings end units; what stands under
    a heading that begins with skip is left out, and so are short units."""
    w = Window.partitionBy(by).orderBy("pos")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    head = F.col("line").startswith("#")
    s = lines.withColumn("head", F.coalesce(F.last(F.when(head, F.regexp_replace("line", r"^[# ]+|\s+$", "")), True).over(w), F.lit("")))
    s = s.withColumn("unit", F.coalesce(F.sum((head | F.contains("line", F.lit(mark))).cast("int")).over(before), F.lit(0)))
    s = s.where(~head & ~F.lower("head").startswith(skip))
    units = s.groupBy(by, "unit", "head").agg(strip(F.array_join(F.array_sort(F.collect_list(F.struct("pos", "line")))["line"], "\n")).alias("text"))
    return units.where(F.length("text") >= min_chars)


def map_citations(units: DataFrame, patterns: list[tuple[str, str]], mark: str = "Источник:", by: str = "note", primary: str = "primary") -> DataFrame:
    """units with source and point. A citation names the source whose pattern stands leftmost in it (then the first pattern); a
    unit's source is its most common one (then the first seen), else the note's primary, else `unknown`. The pattern list is
    small and becomes one expression per pattern."""
    cites = F.transform(F.regexp_extract_all("text", F.lit(rf"{mark}\s*([^*\n]+)"), F.lit(1)), lambda c: c)
    at = lambda c: F.array_min(F.filter(F.array(*(F.struct(F.regexp_instr(c, F.lit(p)).alias("at"), F.lit(i).alias("rule"), F.lit(s).alias("source")) for i, (p, s) in enumerate(patterns))), lambda x: x["at"] > 0))["source"]
    named = units.withColumn("named", F.filter(F.transform(cites, at), lambda s: s.isNotNull()))
    n = lambda s: F.size(F.filter("named", lambda x: x == s))
    best = F.array_min(F.transform(F.array_distinct("named"), lambda s: F.struct((-n(s)).alias("n"), F.array_position("named", s).alias("at"), s.alias("source"))))["source"]
    point = F.nullif(F.regexp_extract("text", r"п\.\s*([\d.]+(?:[–-]\d[\d.]*)?)", 1), F.lit(""))
    return named.withColumn("source", F.coalesce(best, F.col(primary), F.lit("unknown"))).withColumn("point", point).drop("named")


def note_chunks(units: DataFrame, title: str = "title", target: int = TARGET, max_chars: int = 1100, overlap: int = OVERLAP, by: str = "note") -> DataFrame:
    """Units of one source in a row merged, each with its heading before it, then split."""
    rows = units.select(by, F.col("unit").cast("int").alias("ord"), "point", F.array(title, "head").alias("section_path"), F.when(F.col("head") != "", F.concat("head", F.lit("\n"), "text")).otherwise(F.col("text")).alias("text"), "source")
    merged = merge_siblings(rows, target, by, "source", 0)
    parts = merged.select(by, "ord", "source", "point", "section_path", F.posexplode(split_long(F.col("text"), max_chars, overlap)).alias("part", "text"))
    return parts.withColumn("ord", F.row_number().over(Window.partitionBy(by).orderBy("ord", "part"))).drop("part")


def chunk_stats(chunks: DataFrame, by: str = "doc_id") -> DataFrame:
    """Per document: chunks and their mean length."""
    return chunks.groupBy(by).agg(F.count("*").alias("chunks"), F.avg(F.length("text")).alias("mean_chars")).orderBy(F.desc("chunks"), by)


def sweep_chunking(chunks: DataFrame, targets: tuple[int | None, ...] = (None, 900, 1500, 2500), by: str = "doc_id") -> DataFrame:
    """Chunks merged to each target, in one table with the target as variant (0: not merged)."""
    columns = [by, "ord", "point", "section_path", "text"]
    made = [merge_siblings(chunks, t, by).select(F.lit(t or 0).alias("variant"), *columns) for t in targets]
    out = made[0]
    for m in made[1:]:
        out = out.unionByName(m)
    return out


def swept_places(chunks: DataFrame, targets: tuple[int | None, ...] = (None, 900, 1500, 2500), by: str = "doc_id", min_chars: int = MIN_CHARS) -> DataFrame:
    """(name, texts, places): for each document the texts of its chunks that have min_chars in their order, and for each target the ord
    that each of them has in sweep_chunking, or the merge that it goes into. Merges aren't made, so a text stands here once."""
    kept = chunks.where(F.length("text") >= min_chars)
    rows = kept.groupBy(by).agg(F.array_sort(F.collect_list(F.struct("ord", "text"))).alias("rows"))
    sizes, keys = F.transform("rows", lambda x: F.length(x["text"])), F.transform("rows", lambda x: F.lit(""))
    places = [F.transform(_merge_groups(t)(sizes, keys), lambda g: g + 1) if t else F.col("rows.ord") for t in targets]
    return rows.select(F.col(by).alias("name"), F.col("rows.text").alias("texts"), F.array(*places).alias("places"))
