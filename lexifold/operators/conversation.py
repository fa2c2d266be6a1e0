"""Tables of conversation turns: order, overlaps, history, commits, decisions. Turns are (session, seq, role, text, start_ms, end_ms)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import fmt_ms

HISTORY, TAIL = 10, 5000


def _order() -> Window:
    return Window.partitionBy("session").orderBy("start_ms", "seq")


def order_turns(turns: DataFrame) -> DataFrame:
    """turns with place: by start, equal starts as they came."""
    return turns.withColumn("place", F.row_number().over(_order()))


def flag_overlaps(turns: DataFrame) -> DataFrame:
    """turns with overlaps: whether one starts before the latest end of all earlier ones."""
    before = F.max("end_ms").over(_order().rowsBetween(Window.unboundedPreceding, -1))
    return turns.withColumn("overlaps", F.coalesce(F.col("start_ms") < before, F.lit(False)))


def render_history(turns: DataFrame, last: int = HISTORY) -> DataFrame:
    """(session, history): a line for each of the last turns; overlaps only with kept ones are marked."""
    late = F.row_number().over(Window.partitionBy("session").orderBy(F.desc("start_ms"), F.desc("seq")))
    kept = flag_overlaps(turns.withColumn("late", late).where(F.col("late") <= last))
    line = F.concat(F.lit("["), fmt_ms(F.col("start_ms")), F.lit("–"), fmt_ms(F.col("end_ms")), F.lit("] "), "role", F.lit(": "), F.when(F.col("overlaps"), "(поверх) ").otherwise(""), "text")
    return kept.groupBy("session").agg(F.array_join(F.array_sort(F.collect_list(F.struct("start_ms", "seq", line.alias("line"))))["line"], "\n").alias("history"))


def commit_turns(drafts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(committed, rejected) agent replies of (start_ms, delivered_ms, planned_ms): nothing delivered is rejected; else the voiced
    fraction, the end, and whether the reply is partial."""
    planned = F.greatest("planned_ms", "delivered_ms")
    heard = drafts.where("delivered_ms > 0").withColumn("planned_ms", planned)
    done = heard.withColumn("voiced_fraction", F.least(F.lit(1.0), F.col("delivered_ms") / F.col("planned_ms"))).withColumn("end_ms", F.col("start_ms") + F.col("delivered_ms")).withColumn("is_partial", F.col("delivered_ms") < F.col("planned_ms"))
    return done, drafts.where("delivered_ms is null or delivered_ms <= 0")


def validate_turns(turns: DataFrame) -> DataFrame:
    """turns with errors: unknown roles, ends before starts, and fields of the other role."""
    checks = [
        F.when(~F.col("role").isin("user", "agent") | F.col("role").isNull(), "role"),
        F.when(F.col("end_ms") < F.col("start_ms"), "end before start"),
        F.when((F.col("role") == "user") & F.col("voiced_fraction").isNotNull(), "voiced_fraction of a user"),
        F.when((F.col("role") == "agent") & F.col("stt_confidence").isNotNull(), "stt_confidence of an agent"),
    ]
    return turns.withColumn("errors", F.filter(F.array(*checks), lambda e: e.isNotNull()))


def partial_suffix(partials: DataFrame) -> DataFrame:
    """(session, segment, seq, text) with added: what a growing transcript adds to the one before, after a blank where it doesn't
    go on from it."""
    last = F.lag("text").over(Window.partitionBy("session", "segment").orderBy("seq"))
    grown = F.when(F.startswith("text", last), F.expr("substring(text, length(last_text) + 1)")).otherwise(F.concat(F.lit(" "), "text"))
    return partials.withColumn("last_text", last).withColumn("added", F.when(F.coalesce("last_text", F.lit("")) == "", F.col("text")).otherwise(grown)).drop("last_text")


def last_decision_asof(outcomes: DataFrame, decisions: DataFrame) -> DataFrame:
    """outcomes (session, kind, at_ms, ...) with decision: the latest decision (session, kind, at_ms, result) of the kind up to then.

    One union and one window instead of a range join."""
    held = F.last("d", True).over(Window.partitionBy("session", "kind").orderBy("at_ms", "side").rowsBetween(Window.unboundedPreceding, 0))
    rows = outcomes.select("session", "kind", "at_ms", F.lit(1).alias("side"), F.lit(None).cast("struct<at_ms:bigint,result:string>").alias("d"), F.struct(*outcomes.columns).alias("o"))
    other = decisions.select("session", "kind", "at_ms", F.lit(0).alias("side"), F.struct(F.col("at_ms").cast("long").alias("at_ms"), "result").alias("d"), F.lit(None).cast(rows.schema["o"].dataType).alias("o"))
    return rows.unionByName(other).withColumn("decision", held).where("side = 1").select("o.*", "decision")


def rolling_tail(pieces: DataFrame, most: int = TAIL) -> DataFrame:
    """(session, seq, text) with tail: the last characters of all text so far.

    Pieces that end before the tail begins are left out of the frame, so that work stays linear in the text."""
    w = Window.partitionBy("session").orderBy("seq")
    s = pieces.withColumn("stop", F.sum(F.length("text")).over(w).cast("long"))
    near = Window.partitionBy("session").orderBy("stop").rangeBetween(-most, Window.currentRow)
    s = s.withColumn("near", F.sort_array(F.collect_list(F.struct("seq", "text")).over(near)))
    upto = F.filter("near", lambda x: x["seq"] <= F.col("seq"))
    return s.withColumn("tail", F.right(F.array_join(F.transform(upto, lambda x: x["text"]), ""), F.lit(most))).drop("stop", "near")


def voiced_part(credited: Column, left: Column, synthesised: Column) -> Column:
    """Of audio credited and left to play, what was voiced: from 0 to what was synthesised."""
    return F.least(F.greatest(credited - left, F.lit(0)), synthesised)


def build_prompts(turns: DataFrame) -> DataFrame:
    """(session, seq, prompt) from (context, history, text, voiced_ms, planned_ms): sections that aren't blank; where the agent was
    interrupted, the seconds and share that it had voiced."""
    voiced = F.when(F.col("voiced_ms").isNotNull(), F.format_string("VOICED: %.1f s (%d%%)", F.col("voiced_ms") / 1000, F.floor(F.col("voiced_ms") * 100 / F.col("planned_ms")).cast("int")))
    part = lambda name, c: F.when(F.trim(F.coalesce(c, F.lit(""))) != "", F.concat(F.lit(f"{name}:\n"), c))
    return turns.select("session", "seq", F.concat_ws("\n\n", part("CONTEXT", F.col("context")), part("HISTORY", F.col("history")), voiced, part("NOW", F.col("text"))).alias("prompt"))
