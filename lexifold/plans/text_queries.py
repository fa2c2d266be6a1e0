"""Queries of the scalar text functions over documents, benchmark, conversations and embeddings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as t
from .tables import LINES_SQL, document_lines, table


def sc1_norm_ws(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", t.norm_ws(F.col("text")).alias("norm"))


def sc2_tokenize(spark: SparkSession, d: str) -> DataFrame:
    tokens = table(spark, d, "documents").select("doc_id", t.tokenize(F.col("text")).alias("w"))
    return tokens.select("doc_id", F.size("w").cast("long").alias("n_tokens"), F.array_join("w", " ").alias("tokens"))


def sc3_norm_transcript(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "conversations").select("conv_id", "turn", t.norm_transcript(F.col("text")).alias("norm"))


def sc4_classify_lines(spark: SparkSession, d: str) -> DataFrame:
    lines = document_lines(spark, d)
    return lines.groupBy("doc_id", t.classify_line(F.col("line")).alias("kind")).agg(F.count("*").alias("n"), F.min(t.point_number(F.col("line"))).alias("first_point"))


def sc5_filename_dates(spark: SparkSession, d: str) -> DataFrame:
    day = lambda a, b, y: F.format_string("%02d_%02d_%04d", (F.col("doc_id") * a) % 28 + 1, (F.col("doc_id") * b) % 12 + 1, F.col("doc_id") % 20 + 2000 + y)
    name = F.when(F.col("doc_id") % 4 == 0, F.col("source")).when(F.col("doc_id") % 4 == 1, F.concat(F.lit("Order "), day(3, 5, 0))).when(F.col("doc_id") % 4 == 2, F.concat(F.lit("Order "), day(3, 5, 0), F.lit(" and "), day(7, 11, 1))).otherwise(F.concat(F.lit("Order "), day(3, 5, 0), F.lit(" (ред. от "), day(7, 11, 1), F.lit(") of "), day(9, 7, 2)))
    named = table(spark, d, "documents").select("doc_id", name.alias("file"))
    return named.select("doc_id", "file", t.filename_dates(F.col("file")).alias("x")).select("doc_id", "file", "x.issued", "x.revision")


def sc7_strip_markers(spark: SparkSession, d: str) -> DataFrame:
    marked = F.concat(F.lit("[q] "), F.replace(F.replace("text", F.lit("the"), F.lit("[emp]the")), F.lit(" of"), F.lit(" [pause:long] of")), F.lit(" [calm] !"))
    return table(spark, d, "conversations").select("conv_id", "turn", t.strip_markers(marked).alias("plain"))


def sc12_format_ms(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", t.fmt_ms(F.col("n_chars") * 37 + F.col("doc_id") * 50).alias("stamp"))


def sc14_extract_question(spark: SparkSession, d: str) -> DataFrame:
    b = table(spark, d, "benchmark")
    n = F.col("item_id")
    answer = F.when(n % 3 == 0, F.concat(F.lit("Thinking\n вопрос: "), "text")).when(n % 3 == 1, F.concat("text", F.lit("? yes"))).when(n % 6 == 2, F.col("text")).otherwise(F.lit("  "))
    return b.select("item_id", t.extract_question(answer, F.col("text")).alias("question"))


def sc15_extract_keywords(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "benchmark").select("item_id", F.array_join(t.extract_keywords(F.replace("text", F.lit(" "), F.lit(" ; "))), "|").alias("keywords"))


def _verdicts(keys: tuple[str, ...]):
    """Judge texts of four kinds: an object among words, single quotes, no object, an object inside another one."""
    number = lambda i: F.concat(((F.col("item_id") + i) % 2).cast("string"), F.lit("."), (F.col("item_id") % 10).cast("string"))
    body = lambda q: F.concat(*(x for i, k in enumerate(keys) for x in (F.lit(f"{q}{k}{q}: "), number(i), F.lit(", "))))
    n = F.col("item_id") % 4
    plain = F.when(n == 0, F.concat(F.lit("Verdict: {"), body('"'), F.lit('"comment": "fine"} done'))).when(n == 1, F.concat(F.lit("{"), body("'"), F.lit("'comment': 'poor'}")))
    return plain.when(n == 2, F.concat(F.lit("no verdict "), F.col("text"))).otherwise(F.concat(F.lit('{"a": {"b": 1}, '), body('"'), F.lit('"comment": "deep"}')))


def sc16_parse_verdict(spark: SparkSession, d: str) -> DataFrame:
    keys = ("chunks_score", "answer_score")
    return table(spark, d, "benchmark").select("item_id", t.parse_verdict(_verdicts(keys), keys).alias("v")).select("item_id", "v.*")


def sc16_three_scores(spark: SparkSession, d: str) -> DataFrame:
    keys = ("chunks_score", "answer_score", "style_score")
    return table(spark, d, "benchmark").select("item_id", t.parse_verdict(_verdicts(keys), keys).alias("v")).select("item_id", "v.*")


def sc17_strip_think(spark: SparkSession, d: str) -> DataFrame:
    raw = F.concat(F.lit("<THINK>"), "text", F.lit("</think>\n"), "text", F.lit(" <think>x</think>"))
    return table(spark, d, "benchmark").select("item_id", t.strip_think(raw).alias("answer"))


def sc18_render_chat(spark: SparkSession, d: str) -> DataFrame:
    turns = table(spark, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", F.col("text").alias("content")))).alias("m"))
    return turns.select("conv_id", t.render_chat(F.col("m")).alias("chat"))


def sc19_render_template(spark: SparkSession, d: str) -> DataFrame:
    values = {"transcript": F.col("text"), "intent.query": F.substring("text", 1, 10), "rag.answer": F.when(F.col("turn") % 2 == 0, F.col("role")), "phone": F.lit(None)}
    return table(spark, d, "conversations").select("conv_id", "turn", t.render_template(F.lit("{transcript} / {intent.query} / {rag.answer} / {phone}."), values).alias("line"))


def sc20_sigmoid(spark: SparkSession, d: str) -> DataFrame:
    logit = F.when(F.col("event_id") % 17 != 0, F.when(F.col("event_id") % 101 == 0, F.lit(-1000.0)).otherwise((F.col("event_id") % 41 - 20) / 4.0))
    return table(spark, d, "events").select("event_id", F.round(t.sigmoid(logit), 12).alias("score"))


def sc21_l2_normalize(spark: SparkSession, d: str) -> DataFrame:
    unit = table(spark, d, "embeddings").select("vec_id", t.l2_normalize(F.col("embedding")).alias("u"))
    return unit.select("vec_id", F.round(F.get("u", F.lit(0)), 9).alias("first"), F.round(t.dot(F.col("u"), F.col("u")), 9).alias("length"))


def sc23_rates(spark: SparkSession, d: str) -> DataFrame:
    seconds = (F.col("event_id") % 7).cast("double")
    return table(spark, d, "events").select("event_id", t.real_time_factor(F.col("value"), seconds).alias("rtf"), t.throughput(F.col("event_id").cast("double"), seconds).alias("tps"))


_A = "lower(trim(regexp_replace(coalesce({c}, ''), '\\s+', ' ', 'g')))"
SQL = {
    "sc1_norm_ws": f"SELECT doc_id, {_A.format(c='text')} AS norm FROM documents",
    "sc2_tokenize": "WITH w AS (SELECT doc_id, list_filter(string_split(regexp_replace(lower(coalesce(text, '')), '[^a-zа-яё0-9]', ' ', 'g'), ' '), lambda x: length(x) >= 2) AS w FROM documents) SELECT doc_id, len(w)::BIGINT AS n_tokens, array_to_string(w, ' ') AS tokens FROM w",
    "sc3_norm_transcript": "SELECT conv_id, turn, trim(regexp_replace(regexp_replace(replace(replace(lower(coalesce(text, '')), chr(65279), ''), 'ё', 'е'), '[^\\p{L}\\p{M}\\p{N}_\\s]', '', 'g'), '\\s+', ' ', 'g')) AS norm FROM conversations",
    "sc5_filename_dates": """
WITH p AS (SELECT doc_id, source, lpad(((doc_id*3)%28+1)::VARCHAR,2,'0')||'_'||lpad(((doc_id*5)%12+1)::VARCHAR,2,'0')||'_'||(doc_id%20+2000) AS a,
  lpad(((doc_id*7)%28+1)::VARCHAR,2,'0')||'_'||lpad(((doc_id*11)%12+1)::VARCHAR,2,'0')||'_'||(doc_id%20+2001) AS b,
  lpad(((doc_id*9)%28+1)::VARCHAR,2,'0')||'_'||lpad(((doc_id*7)%12+1)::VARCHAR,2,'0')||'_'||(doc_id%20+2002) AS c FROM documents)
SELECT doc_id, CASE doc_id%4 WHEN 0 THEN source WHEN 1 THEN 'Order '||a WHEN 2 THEN 'Order '||a||' and '||b ELSE 'Order '||a||' (ред. от '||b||') of '||c END AS file,
  CASE WHEN doc_id%4 > 0 THEN strptime(a,'%d_%m_%Y')::DATE END AS issued,
  CASE doc_id%4 WHEN 1 THEN strptime(a,'%d_%m_%Y')::DATE WHEN 2 THEN strptime(b,'%d_%m_%Y')::DATE WHEN 3 THEN strptime(b,'%d_%m_%Y')::DATE END AS revision FROM p""",
    "sc7_strip_markers": r"""SELECT conv_id, turn, trim(regexp_replace(regexp_replace(regexp_replace('[q] ' || replace(replace(text, 'the', '[emp]the'), ' of', ' [pause:long] of') || ' [calm] !',
  '\[(q_strong|q|exc|calm|fast|slow|emp|pause(:\w+)?)\]', '', 'g'), '\s{2,}', ' ', 'g'), '\s+([,.!?…])', '\1', 'g')) AS plain FROM conversations""",
    "sc12_format_ms": "WITH x AS (SELECT doc_id, round_even((n_chars*37+doc_id*50)/100, 0)::BIGINT AS q FROM documents) SELECT doc_id, lpad((q//600)::VARCHAR, greatest(2, length((q//600)::VARCHAR))::INT, '0')||':'||lpad(((q//10)%60)::VARCHAR,2,'0')||'.'||(q%10) AS stamp FROM x",
    "sc14_extract_question": r"""
SELECT item_id, CASE WHEN item_id%3 = 0 THEN coalesce(nullif(trim(string_split(text, chr(10))[1]), ''), 'Thinking')
  WHEN item_id%3 = 1 THEN trim(CASE WHEN contains(text,'?') THEN split_part(text,'?',1)||'?' ELSE text||'?' END)
  WHEN item_id%6 = 2 THEN CASE WHEN contains(text,'?') THEN trim(split_part(text,'?',1)||'?') ELSE trim(string_split(trim(text), chr(10))[1]) END
  ELSE text END AS question FROM benchmark""",
    "sc15_extract_keywords": "SELECT item_id, array_to_string(list_filter(list_transform(regexp_split_to_array(replace(text, ' ', ' ; '), '[;,]'), lambda x: trim(x, ' ' || chr(10))), lambda x: x <> '')[1:10], '|') AS keywords FROM benchmark",
    **{
        name: "SELECT item_id, " + ", ".join(f"CASE WHEN item_id%4 <> 2 THEN (((item_id+{i})%2)||'.'||(item_id%10))::DOUBLE END AS {k}" for i, k in enumerate(keys))
        + ", CASE item_id%4 WHEN 0 THEN 'fine' WHEN 1 THEN 'poor' WHEN 2 THEN '[PARSE FAIL] '||substr('no verdict '||text, 1, 200) ELSE 'deep' END AS comment FROM benchmark"
        for name, keys in (("sc16_parse_verdict", ("chunks_score", "answer_score")), ("sc16_three_scores", ("chunks_score", "answer_score", "style_score")))
    },
    "sc17_strip_think": "SELECT item_id, trim(trim(text, chr(10)||' ')) AS answer FROM benchmark",
    "sc18_render_chat": "SELECT conv_id, string_agg('<|im_start|>'||role||chr(10)||text||'<|im_end|>'||chr(10), '' ORDER BY turn, role, text)||'<|im_start|>assistant'||chr(10) AS chat FROM conversations GROUP BY conv_id",
    "sc19_render_template": "SELECT conv_id, turn, text||' / '||substr(text,1,10)||' / '||CASE WHEN turn%2=0 THEN role ELSE '' END||' / .' AS line FROM conversations",
    "sc20_sigmoid": "WITH x AS (SELECT event_id, CASE WHEN event_id%17 <> 0 THEN CASE WHEN event_id%101=0 THEN -1000.0::DOUBLE ELSE (event_id%41-20)/4.0::DOUBLE END END AS x FROM events) SELECT event_id, round(coalesce(CASE WHEN x>=0 THEN 1/(1+exp(-x)) ELSE exp(x)/(1+exp(x)) END, 0.0), 12) AS score FROM x",
    "sc21_l2_normalize": "WITH x AS (SELECT vec_id, list_transform(embedding, lambda e: e::DOUBLE) AS e FROM embeddings), y AS (SELECT vec_id, e, sqrt(list_sum(list_transform(e, lambda a: a*a))) AS n FROM x) SELECT vec_id, round(CASE WHEN n>0 THEN e[1]/n ELSE e[1] END, 9) AS first, round(CASE WHEN n>0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END, 9) AS length FROM y",
    "sc23_rates": "SELECT event_id, CASE WHEN event_id%7 <> 0 THEN value/(event_id%7) END AS rtf, CASE WHEN event_id%7>0 THEN event_id::DOUBLE/(event_id%7) ELSE 0.0::DOUBLE END AS tps FROM events",
    "sc4_classify_lines": r"""
WITH s AS ({lines}), x AS (SELECT doc_id, trim(line) AS s FROM s),
k AS (SELECT doc_id, s, CASE WHEN s = '' THEN 'blank' WHEN regexp_matches(s, '(?i)^\(?(см\.\s+текст|в ред\.|КонсультантПлюс|Список изменяющих)') THEN 'noise'
  WHEN starts_with(s, '## ') OR regexp_matches(s, '(?i)^(РАЗДЕЛ|ГЛАВА|ПРИЛОЖЕНИЕ|СТАТЬЯ)([^\p{L}\p{N}_]|$)') OR regexp_matches(s, '^[IVXLCDM]+\.\s+') OR (upper(s) = s AND length(s) <= 160 AND NOT regexp_matches(s, '[0-9]{2}\.[0-9]{2}\.[0-9]{4}')) THEN 'heading'
  WHEN regexp_matches(s, '^([0-9]+(\.[0-9]+){0,6})[.)]\s+') THEN 'point' ELSE 'body' END AS kind FROM x)
SELECT doc_id, kind, count(*) AS n, min(nullif(regexp_extract(s, '^([0-9]+(\.[0-9]+){0,6})[.)]\s+', 1), '')) AS first_point FROM k GROUP BY doc_id, kind""",
}
SQL["sc4_classify_lines"] = SQL["sc4_classify_lines"].replace("{lines}", LINES_SQL)
QUERIES = {n: f for n, f in list(globals().items()) if n.startswith("sc") and callable(f)}
