"""Scalar text and number functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Letters of words for search, heading words, publisher noise, intonation tags, abbreviations of dates.
WORD_LETTERS = "a-zа-яё0-9"
HEADING_WORDS = ["РАЗДЕЛ", "ГЛАВА", "ПРИЛОЖЕНИЕ", "СТАТЬЯ"]
NOISE = r"(?iU)^\(?(?:см\.\s+текст|в ред\.|КонсультантПлюс|Список изменяющих)"
POINT = r"^([0-9]+(?:\.[0-9]+){0,6})[.)](?U:\s)+"
TAGS = r"\[(?:q_strong|q|exc|calm|fast|slow|emp|pause(?::(?U:\w)+)?)\]"
DAY = r"([0-9]{2}[._][0-9]{2}[._][0-9]{4})"


def strip(c: Column) -> Column:
    """Without whitespace of any kind at the ends."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def norm_ws(c: Column) -> Column:
    """Whitespace runs as one space, trimmed, lowered; null as empty."""
    return F.lower(F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"(?U)\s+", " ")))


def tokenize(c: Column) -> Column:
    """Lowered runs of Latin or Cyrillic letters and digits, of two or more, in order with repeats."""
    words = F.split(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), f"[^{WORD_LETTERS}]", " "), " ")
    return F.filter(words, lambda w: F.length(w) >= 2)


def norm_transcript(c: Column) -> Column:
    """Lowered without byte order mark and punctuation, ё as е, whitespace collapsed."""
    low = F.translate(F.lower(F.regexp_replace(F.coalesce(c, F.lit("")), "\ufeff", "")), "ё", "е")
    return F.trim(F.regexp_replace(F.regexp_replace(low, r"(?U)[^\w\s]", ""), r"(?U)\s+", " "))


def is_heading(line: Column) -> Column:
    """Of a stripped line: marked with ##, starting with a heading word or Roman number, or in capitals (lines without letters
    too), at most 160 long and without a date."""
    words = rf"(?iU)^(?:{'|'.join(HEADING_WORDS)})\b"
    capital = (line != "") & (F.upper(line) == line) & (F.length(line) <= 160) & ~line.rlike(r"[0-9]{2}\.[0-9]{2}\.[0-9]{4}")
    return line.startswith("## ") | line.rlike(words) | line.rlike(r"^[IVXLCDM]+\.\s+") | capital


def classify_line(line: Column) -> Column:
    """blank, noise, heading, point or body."""
    s = F.trim(line)
    return F.when(s == "", "blank").when(s.rlike(NOISE), "noise").when(is_heading(s), "heading").when(s.rlike(POINT), "point").otherwise("body")


def point_number(line: Column) -> Column:
    return F.nullif(F.regexp_extract(F.trim(line), POINT, 1), F.lit(""))


def filename_dates(name: Column) -> Column:
    """Struct of issued and revision dates in a file name: the first date; the one after `ред. от`, else the last of several,
    else the first. Impossible dates are null."""
    day = lambda c: F.try_to_date(F.translate(c, "_", "."), "dd.MM.yyyy")
    found = F.regexp_extract_all(name, F.lit(DAY), F.lit(1))
    issued = day(F.get(found, F.lit(0)))
    after = F.nullif(F.regexp_extract(name, rf"(?i)ред[._] от {DAY}", 1), F.lit(""))
    return F.struct(issued.alias("issued"), F.coalesce(day(after), F.when(F.size(found) > 1, day(F.get(found, F.size(found) - 1))), issued).alias("revision"))


def strip_markers(c: Column) -> Column:
    """Text without intonation tags: doubled spaces collapsed, none before punctuation."""
    return strip(F.regexp_replace(F.regexp_replace(F.regexp_replace(c, TAGS, ""), r"(?U)\s{2,}", " "), r"(?U)\s+([,.!?…])", "$1"))


def fmt_ms(ms: Column) -> Column:
    """MM:SS.d, rounded half to even at a tenth of a second."""
    tenths = F.bround(ms / 100, 0).cast("long")
    return F.format_string("%02d:%02d.%d", F.floor(tenths / 600), F.floor(tenths / 10) % 60, tenths % 10)


def extract_question(answer: Column, question: Column) -> Column:
    """The question that a model's answer names: the rest of its ВОПРОС line, else up to the first ?, else its first line; the
    question asked where that is empty."""
    named = F.regexp_extract(answer, r"(?imU)^\s*ВОПРОС\s*[:\-]\s*(\S.*)", 1)
    mark = F.instr(answer, "?")
    plain = F.when(mark > 0, F.substring(answer, 1, mark)).otherwise(F.split_part(strip(answer), F.lit("\n"), F.lit(1)))
    return F.coalesce(F.nullif(strip(named), F.lit("")), F.nullif(strip(plain), F.lit("")), question)


def extract_keywords(c: Column, most: int = 10) -> Column:
    """Parts between ; and , without blanks, the first of them."""
    return F.slice(F.filter(F.transform(F.split(c, "[;,]"), lambda w: strip(w)), lambda w: w != ""), 1, most)


def parse_verdict(c: Column, keys: tuple[str, ...] = ("chunks_score", "answer_score"), note: str = "comment") -> Column:
    """Struct of scores, named by keys, and comment from a judge's text: the first flat object that has the first key, else the widest
    braces; single quotes are tried as double ones. Where no score parses, all are null and comment tells, cut to 200 characters."""
    schema = f"struct<{','.join(f'`{k}`:double' for k in keys)},`{note}`:string>"
    flat = F.nullif(F.regexp_extract(c, rf"""(?s)\{{[^{{}}]*["']{keys[0]}["'][^{{}}]*\}}""", 0), F.lit(""))
    wide = F.nullif(F.regexp_extract(c, r"(?s)\{.*\}", 0), F.lit(""))
    body = F.coalesce(flat, wide)
    read = [F.from_json(x, schema) for x in (body, F.translate(body, "'", '"'))]
    first = F.coalesce(*(r[k] for r in read[:1] for k in keys)).isNotNull()
    any_ = first | F.coalesce(*(read[1][k] for k in keys)).isNotNull()
    value = lambda k: F.when(first, read[0][k]).otherwise(read[1][k])
    comment = F.when(any_, value(note)).otherwise(F.concat(F.lit("[PARSE FAIL] "), F.substring(F.coalesce(c, F.lit("")), 1, 200)))
    return F.struct(*(value(k).alias(k) for k in keys), comment.alias(note))


def strip_think(c: Column) -> Column:
    return strip(F.regexp_replace(c, r"(?is)<think>.*?</think>", ""))


def render_chat(messages: Column) -> Column:
    """Chat markup of an array of (role, content), with the assistant's turn left open."""
    parts = F.transform(messages, lambda m: F.concat(F.lit("<|im_start|>"), m["role"], F.lit("\n"), m["content"], F.lit("<|im_end|>\n")))
    return F.concat(F.array_join(parts, ""), F.lit("<|im_start|>assistant\n"))


def render_template(template: Column, values: dict[str, Column]) -> Column:
    """{name} replaced by its value, missing ones by nothing."""
    for name, value in values.items():
        template = F.replace(template, F.lit("{" + name + "}"), F.coalesce(value.cast("string"), F.lit("")))
    return template


def sigmoid(x: Column) -> Column:
    """1 / (1 + exp(-x)) without overflow; null, a score not given, is 0."""
    return F.coalesce(F.when(x >= 0, 1 / (1 + F.exp(-x))).otherwise(F.exp(x) / (1 + F.exp(x))), F.lit(0.0))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def l2_normalize(v: Column) -> Column:
    """The vector over its length; a zero vector as it is."""
    norm = F.sqrt(dot(v, v))
    return F.when(norm > 0, F.transform(v, lambda x: x.cast("double") / norm)).otherwise(F.transform(v, lambda x: x.cast("double")))


def real_time_factor(infer_s: Column, duration_s: Column) -> Column:
    return F.try_divide(infer_s, F.nullif(duration_s, F.lit(0.0)))


def throughput(tokens: Column, seconds: Column) -> Column:
    """Tokens a second, 0 where no time passed."""
    return F.when(seconds > 0, tokens / seconds).otherwise(F.lit(0.0))
