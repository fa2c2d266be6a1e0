"""Queries of conversation tables and of frame streams, from conversations and events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import conversation as c
from ..operators import scenarios as r
from ..operators import stats as s
from ..session import shared_place
from ..streaming import automaton as a
from ..streaming import frames as f
from ..streaming import gate as g
from ..streaming import sink as k
from ..streaming import windows as w
from .evaluation_queries import SQL as EVALUATION_SQL
from .tables import FRAMES_SQL, TURNS_SQL, frames, table, turns


def cv1_order(spark: SparkSession, d: str) -> DataFrame:
    return c.order_turns(turns(spark, d)).select("session", "seq", "place")


def cv2_overlaps(spark: SparkSession, d: str) -> DataFrame:
    return c.flag_overlaps(turns(spark, d)).select("session", "seq", "overlaps")


def cv3_history(spark: SparkSession, d: str) -> DataFrame:
    return c.render_history(turns(spark, d), 4)


def _drafts(spark: SparkSession, d: str) -> DataFrame:
    n = F.length("text") * 20
    return turns(spark, d).where("role = 'agent'").select("session", "seq", "start_ms", F.when(F.col("seq") % 5 == 0, 0).when(F.col("seq") % 2 == 0, n).otherwise((n * 0.6).cast("int")).cast("long").alias("delivered_ms"), (n - F.col("seq") * 7).cast("long").alias("planned_ms"))


def cv4_commit(spark: SparkSession, d: str) -> DataFrame:
    done, rejected = c.commit_turns(_drafts(spark, d))
    none = F.lit(None)
    kept = done.select("session", "seq", "end_ms", F.round("voiced_fraction", 9).alias("voiced_fraction"), "is_partial")
    return kept.unionByName(rejected.select("session", "seq", none.cast("long").alias("end_ms"), none.cast("double").alias("voiced_fraction"), none.cast("boolean").alias("is_partial")))


def cv5_validate(spark: SparkSession, d: str) -> DataFrame:
    raw = table(spark, d, "conversations").select("conv_id", "turn", F.when(F.col("role") == "assistant", "agent").otherwise(F.col("role")).alias("role"), F.lit(1000).alias("start_ms"), (F.col("turn") * 500).alias("end_ms"), F.when(F.col("turn") % 3 == 0, 0.5).alias("voiced_fraction"), F.when(F.col("turn") % 4 == 1, 0.9).alias("stt_confidence"))
    return c.validate_turns(raw).select("conv_id", "turn", F.array_join("errors", "; ").alias("errors"))


def cv6_partials(spark: SparkSession, d: str) -> DataFrame:
    t = turns(spark, d).select("session", F.col("seq").alias("segment"), "text", F.explode(F.sequence(F.lit(1), F.lit(4))).alias("seq"))
    text = F.when((F.col("seq") == 3) & (F.col("segment") % 4 == 0), F.concat(F.lit("so "), F.substring("text", 1, 20))).otherwise(F.expr("substring(text, 1, 10 * seq)"))
    return c.partial_suffix(t.select("session", "segment", "seq", text.alias("text")))


def _decisions(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    e = frames(spark, d).join(table(spark, d, "events").select(F.col("user_id").alias("session")).distinct(), "session")
    kind = F.concat(F.lit("k"), (F.col("seq") % 3).cast("string"))
    decisions = e.where("seq % 4 = 1").select("session", kind.alias("kind"), "at_ms", F.concat(F.lit("r"), F.col("seq").cast("string")).alias("result"))
    return e.where("seq % 5 = 2").select("session", kind.alias("kind"), "at_ms", "seq"), decisions


def cv7_asof(spark: SparkSession, d: str) -> DataFrame:
    return c.last_decision_asof(*_decisions(spark, d)).select("session", "kind", "at_ms", "decision.result")


def cv8_tail(spark: SparkSession, d: str) -> DataFrame:
    return c.rolling_tail(turns(spark, d).select("session", "seq", "text"), 300)


def cv9_voiced(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "events").select("event_id", c.voiced_part(F.col("event_id") % 900, F.col("event_id") % 700, F.col("event_id") % 300).alias("voiced_ms"))
    return x


def cv10_prompts(spark: SparkSession, d: str) -> DataFrame:
    t = turns(spark, d)
    x = t.join(c.render_history(t, 2), "session").select("session", "seq", F.when(F.col("seq") % 2 == 0, F.concat(F.lit("about "), "role")).otherwise("  ").alias("context"), F.when(F.col("seq") > 1, F.col("history")).alias("history"), "text", F.when(F.col("seq") % 3 == 0, F.col("seq") * 1230).alias("voiced_ms"), (F.col("seq") * 4000).alias("planned_ms"))
    return c.build_prompts(x)


def st1_segments(spark: SparkSession, d: str) -> DataFrame:
    return f.speech_segments(frames(spark, d), silence_ms=200)


def st2_overlap(spark: SparkSession, d: str) -> DataFrame:
    return f.overlap_episodes(frames(spark, d), 300, silence_ms=200)


def st3_agent_level(spark: SparkSession, d: str) -> DataFrame:
    fr = frames(spark, d)
    speech = fr.where("seq % 9 = 3").select("session", (F.col("at_ms") + 50).alias("start_ms"), (F.col("at_ms") + 350).alias("end_ms"))
    return f.agent_level(fr, speech, 1000).select("session", "seq", "agent")


def st4_elapsed(spark: SparkSession, d: str) -> DataFrame:
    moved = frames(spark, d).withColumn("at_ms", F.when(F.col("seq") % 6 == 5, F.col("at_ms") - 150).otherwise(F.col("at_ms")))
    return f.elapsed(moved).select("session", "seq", "elapsed_ms")


def st5_windows(spark: SparkSession, d: str) -> DataFrame:
    return frames(spark, d).select("session", "seq", w.stt_window_start(F.lit(700), F.col("at_ms") * 9 + 700).cast("long").alias("window_ms"))


def _speech(spark: SparkSession, d: str) -> DataFrame:
    return f.speech_segments(frames(spark, d), silence_ms=500).where("end_ms is not null")


def st5_turn_windows(spark: SparkSession, d: str) -> DataFrame:
    """Windows of the speech segments, with the frames in each."""
    windows = w.turn_windows(_speech(spark, d).select("session", "segment", "start_ms", "end_ms"), 1000, 300)
    found = w.frames_of_windows(frames(spark, d), windows, ["segment", "window"], 2000)
    return found.select("session", F.col("segment").cast("long").alias("segment"), "window", "from_ms", "to_ms", "frames", F.round("mean_prob", 6).alias("mean_prob"))


def st5_sliding(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return w.sliding_counts(e, ["event_type"], "60 minutes", "20 minutes").withColumn("start", F.col("start").cast("timestamp_ntz"))


def st1_coarse(spark: SparkSession, d: str) -> DataFrame:
    """Sessions of the voiced frames of a user, by the events' own clock."""
    e = _as_frames(table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp")))
    return _local(w.coarse_sessions(e, "6 hours"))


def _local(df: DataFrame) -> DataFrame:
    return df.withColumn("start", F.col("start").cast("timestamp_ntz")).withColumn("end", F.col("end").cast("timestamp_ntz"))


def _run_starts(frames: DataFrame) -> DataFrame:
    """Every voiced frame wants a run, of 100 to 700 ms; every seventh has no sound to read."""
    n = F.col("seq")
    return frames.where("prob > 0.5").select("session", "at_ms", (n % 7 * 100 + 100).cast("long").alias("run_ms"), F.when(n % 7 == 3, 0).otherwise(n % 5 + 1).cast("long").alias("samples"), *(["ts"] if "ts" in frames.columns else []))


def st6_capped(spark: SparkSession, d: str) -> DataFrame:
    return w.cap_runs(_run_starts(frames(spark, d)), 250).select("session", "at_ms")


def _samples(spark: SparkSession, d: str) -> DataFrame:
    """Frames of 100 ms at 80 samples a second, every seventh lost."""
    sound = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda k: ((F.col("seq") * 8 + k) % 1000).cast("smallint"))
    return frames(spark, d).where("seq % 7 <> 6").select("session", "seq", "at_ms", sound.alias("samples"))


def st8_samples(spark: SparkSession, d: str) -> DataFrame:
    """Sound of intervals that begin and end inside frames, cross lost ones, or go up to now."""
    fr = frames(spark, d).where("seq % 10 = 0")
    asked = fr.select("session", F.col("seq").alias("request"), (F.col("at_ms") + 37).alias("from_ms"), F.when(F.col("seq") % 30 != 0, F.col("at_ms") + 37 + F.col("seq") % 9 * 60).alias("to_ms"))
    got = w.slice_samples(_samples(spark, d), asked, 80, 4000, 1000)
    return got.select("session", "request", F.size("samples").alias("n"), F.array_join(F.transform("samples", lambda x: x.cast("string")), ",").alias("samples"))


def st6_thin(spark: SparkSession, d: str) -> DataFrame:
    return f.thin_events(frames(spark, d).where("prob > 0.5").select("session", "at_ms"), 250)


def st7_ring(spark: SparkSession, d: str) -> DataFrame:
    return f.ring(frames(spark, d), 3000).groupBy("session").agg(F.count("*").alias("n"), F.min("at_ms").alias("oldest"))


def st8_slices(spark: SparkSession, d: str) -> DataFrame:
    fr = frames(spark, d)
    asked = fr.where("seq % 10 = 0").select("session", F.col("seq").alias("request"), (F.col("at_ms") + 130).alias("from_ms"), (F.col("at_ms") + 420).alias("to_ms"))
    got = f.slice_frames(fr, asked, 4000, 1000)
    return got.select("session", "request", F.array_join(F.transform("frames", lambda x: x.cast("string")), ",").alias("frames"))


def _ticks(spark: SparkSession, d: str) -> DataFrame:
    t = f.to_ticks(frames(spark, d))
    n = F.col("seq")
    return t.select("session", (n * 2 + F.col("part")).cast("long").alias("seq"), "speaking", F.col("elapsed_ms").alias("elapsed"), (n % 4 == 3).alias("ended"), (n % 5 == 1).alias("ready"), F.lit(2500).alias("answer_ms"), F.lit(900).alias("farewell_ms"), (n % 2 == 0).alias("interject"), (n % 3 == 0).alias("interrupt"))


_LIMITS = a.Limits(turn_ms=300, idle_ms=400, overlap_ms=100, tail_ms=300)


def st9_replay(spark: SparkSession, d: str) -> DataFrame:
    return a.replay_sessions(_ticks(spark, d), _LIMITS, 500)


def st10_ticks(spark: SparkSession, d: str) -> DataFrame:
    return f.to_ticks(frames(spark, d))


def st11_transitions(spark: SparkSession, d: str) -> DataFrame:
    log = st9_replay(spark, d)
    broken = log.withColumn("state", F.when((F.col("session") % 10 == 0) & (F.col("seq") == 20), "closing").otherwise(F.col("state")))
    return a.check_transitions(broken)


def st12_invariants(spark: SparkSession, d: str) -> DataFrame:
    rules = ("dropped_stays_uncommitted", "speaking_has_draft", "barge_in_warranted", "interject_after_limit", "ended_is_final")
    return a.check_invariants(st9_replay(spark, d), _LIMITS).agg(F.count("*").alias("n"), *(F.count_if(~F.coalesce(F.col(x), F.lit(True))).alias(x) for x in rules))


#: The user of the row that ends a stream.
_END = -1


def _streamed(spark: SparkSession, made: DataFrame) -> DataFrame:
    """Run a stream over the files that are there to its end, into the shared folder, and read what it wrote."""
    out = shared_place(spark, "stream")
    made.writeStream.format("parquet").option("checkpointLocation", f"{out}-state").trigger(availableNow=True).start(out).awaitTermination()
    return spark.read.schema(made.schema).parquet(out)


def _event_stream(spark: SparkSession, d: str) -> DataFrame:
    """A stream of the events, ended by a row of a much later time, which moves the watermark past all others."""
    events = table(spark, d, "events")
    end = shared_place(spark, "stream-end")
    last = [F.lit({"user_id": _END, "event_id": _END, "event_type": "end"}.get(f.name)).cast(f.dataType).alias(f.name) for f in events.schema if f.name != "ts"]
    spark.range(1).select(*last, F.lit("2100-01-01").cast("timestamp_ntz").alias("ts")).select(events.columns).write.parquet(end)
    stream = spark.readStream.schema(events.schema).parquet(f"{d}/events.parque[t]")  # a pattern, as a stream reads folders only
    return stream.unionByName(spark.readStream.schema(events.schema).parquet(end)).withColumn("ts", F.col("ts").cast("timestamp"))


def _as_frames(e: DataFrame) -> DataFrame:
    """Frames of events: a user's session, a frame for each event id."""
    return e.select(F.col("user_id").alias("session"), F.col("event_id").alias("seq"), (F.col("event_id") * 100).alias("at_ms"), F.lit(100).alias("duration_ms"), F.when(F.col("event_id") % 5 < 3, 0.9).otherwise(0.1).alias("prob"), "ts")


def _frame_stream(spark: SparkSession, d: str) -> DataFrame:
    return _as_frames(_event_stream(spark, d)).withWatermark("ts", "1 minute")


def _stream_ticks(frames: DataFrame) -> DataFrame:
    n = F.col("seq")
    return frames.select("session", "seq", (F.col("prob") >= 0.5).alias("speaking"), F.lit(100).alias("elapsed"), (n % 4 == 3).alias("ended"), (n % 5 == 1).alias("ready"), F.lit(2500).alias("answer_ms"), F.lit(900).alias("farewell_ms"), (n % 2 == 0).alias("interject"), (n % 3 == 0).alias("interrupt"), "ts")


def st1_segments_stream(spark: SparkSession, d: str) -> DataFrame:
    return _streamed(spark, f.stream_segments(_frame_stream(spark, d), silence_ms=200)).where(F.col("session") != _END)


def st6_thin_stream(spark: SparkSession, d: str) -> DataFrame:
    return _streamed(spark, f.stream_thin(_frame_stream(spark, d).select("session", "at_ms", "ts"), 2500)).where(F.col("session") != _END)


def st6_capped_stream(spark: SparkSession, d: str) -> DataFrame:
    made = w.stream_cap_runs(_run_starts(_frame_stream(spark, d)), 2500)
    return _streamed(spark, made).where(F.col("session") != _END)


def st1_coarse_stream(spark: SparkSession, d: str) -> DataFrame:
    made = w.coarse_sessions(_as_frames(_event_stream(spark, d)), "6 hours")
    return _local(_streamed(spark, made).where(F.col("session") != _END))


def st5_sliding_stream(spark: SparkSession, d: str) -> DataFrame:
    made = w.sliding_counts(_event_stream(spark, d), ["event_type"], "60 minutes", "20 minutes")
    return _streamed(spark, made).where("event_type <> 'end'").withColumn("start", F.col("start").cast("timestamp_ntz"))


def st2_speech_stream(spark: SparkSession, d: str) -> DataFrame:
    """Segments and overlaps of frames with an agent that speaks for a minute from each purchase on."""
    bought = _event_stream(spark, d).where("event_type in ('purchase', 'end')").select(F.col("user_id").alias("session"), (F.col("event_id") * 100).alias("start_ms"), (F.col("event_id") * 100 + 60_000).alias("end_ms"), "ts")
    made = g.stream_speech_events(_frame_stream(spark, d), g.agent_edges(bought).withWatermark("ts", "1 minute"), 200, silence_ms=200)
    return _streamed(spark, made).where(F.col("session") != _END)


def st7_late_stream(spark: SparkSession, d: str) -> DataFrame:
    e = _event_stream(spark, d).withWatermark("ts", "60 seconds").dropDuplicatesWithinWatermark(["event_id"])
    return _streamed(spark, e.select("event_id", "user_id")).where(F.col("user_id") != _END)


def st13_replay_stream(spark: SparkSession, d: str) -> DataFrame:
    return _streamed(spark, a.stream_replay(_stream_ticks(_frame_stream(spark, d)), _LIMITS, 500)).where(F.col("session") != _END)


def st14_minutes(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return f.live_counters(e, ["event_type"]).withColumn("minute", F.col("minute").cast("timestamp_ntz"))


def st14_minutes_stream(spark: SparkSession, d: str) -> DataFrame:
    counted = _streamed(spark, f.live_counters(_event_stream(spark, d), ["event_type"])).where("event_type <> 'end'")
    return counted.withColumn("minute", F.col("minute").cast("timestamp_ntz"))


def io11_exposition_stream(spark: SparkSession, d: str) -> DataFrame:
    """Counters of a stream, kept by batch, as exposition text."""
    at = shared_place(spark, "counters")
    counted = s.session_counters(_event_stream(spark, d).where("event_type <> 'end'"), ["event_type"])
    k.write_counters(counted, at).awaitTermination()
    kept = k.read_counters(spark, at, ["event_type"], "event_type string, count long")
    return s.to_exposition(kept, "events_total", "Events by type.", ["event_type"]).select("line")


_RULES = [
    r.Scenario("goodbye", ("listening", "speaking"), {"all": [{"intent": "bye"}, {"confidence_at_least": 0.7}]}, 5),
    r.Scenario("empty", ("listening",), {"transcript_empty": True}, 3),
    r.Scenario("failed", ("listening", "speaking", "formulating"), {"error_type": "timeout"}, 9),
    r.Scenario("unknown", ("formulating",), {"any": [{"rag_count": 0}, {"rag_max_score_below": 0.3}]}, 4),
    r.Scenario("declined", ("speaking",), {"not": {"bargein_accepted": True}}, 2),
    r.Scenario("off", ("listening",), None, 99, False),
    r.Scenario("default", ("listening", "formulating"), None, 0),
    r.Scenario("late", ("listening",), {"confidence_below": 0.2}, 0),
]


def _contexts(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("event_id")
    state = F.element_at(F.array(*map(F.lit, ("listening", "speaking", "formulating", "closing"))), (n % 4 + 1).cast("int"))
    return table(spark, d, "events").select("event_id", state.alias("state"), F.when(n % 3 == 0, "bye").alias("intent"), F.when(n % 7 != 0, (n % 10) / 10).alias("confidence"), F.when(n % 5 != 0, (n % 6).cast("int")).alias("rag_count"), F.when(n % 5 != 0, (n % 11) / 10).alias("rag_max_score"), F.lit(None).cast("boolean").alias("interject_accepted"), F.when(n % 13 != 0, n % 2 == 0).alias("bargein_accepted"), F.when(n % 8 == 0, " ").otherwise("hi").alias("transcript"), F.when(n % 17 == 0, "timeout").alias("error_type"))


def st15_match(spark: SparkSession, d: str) -> DataFrame:
    return r.match_scenarios(_contexts(spark, d), _RULES).select("event_id", "state", "scenario")


def st16_conditions(spark: SparkSession, d: str) -> DataFrame:
    trees = [{"intent": "bye"}, {"not": {"rag_max_score_below": 0.5}}, {"any": [{"rag_count": 2}, {"not": {"interject_accepted": True}}]}, {"all": [{"confidence_at_least": 0.5}, {"transcript_empty": False}]}]
    return _contexts(spark, d).select("event_id", *(r.compile_condition(t).alias(f"c{i}") for i, t in enumerate(trees)))


def st17_shadowed(spark: SparkSession, d: str) -> DataFrame:
    """Rules that can't win, with the contexts of their state that would reach them."""
    n = _contexts(spark, d).groupBy("state").agg(F.count("*").alias("contexts"))
    return r.shadowed_rules(spark, _RULES).join(n, "state")


_FMT = "lpad((({0})//600)::VARCHAR, greatest(2, length((({0})//600)::VARCHAR))::INT, '0') || ':' || lpad(((({0})//10) % 60)::VARCHAR, 2, '0') || '.' || (({0}) % 10)"
_HIST = f"""h{{n}} AS (SELECT session, string_agg('[' || {_FMT.format('round_even(start_ms / 100, 0)::BIGINT')} || '–' || {_FMT.format('round_even(end_ms / 100, 0)::BIGINT')} || '] ' || role || ': ' || CASE WHEN o THEN '(поверх) ' ELSE '' END || text, chr(10) ORDER BY start_ms, seq) AS history
  FROM (SELECT *, coalesce(start_ms < max(end_ms) OVER (PARTITION BY session ORDER BY start_ms, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS o FROM (SELECT *, row_number() OVER (PARTITION BY session ORDER BY start_ms DESC, seq DESC) AS late FROM t) WHERE late <= {{n}}) GROUP BY session)"""
_STREAM_SQL = "SELECT user_id AS session, event_id AS seq, event_id * 100 AS at_ms, 100::INT AS duration_ms, CASE WHEN event_id % 5 < 3 THEN 0.9 ELSE 0.1 END::DOUBLE AS prob, false AS agent FROM events"
_VOICED = f"""q AS (SELECT *, prob >= 0.5 AS voiced, sum(CASE WHEN prob >= 0.5 THEN 0 ELSE duration_ms END) OVER (PARTITION BY session ORDER BY seq) AS quiet, lead(at_ms) OVER (PARTITION BY session ORDER BY seq) AS next_at FROM ({FRAMES_SQL})),
q2 AS (SELECT *, last_value(CASE WHEN voiced THEN quiet END IGNORE NULLS) OVER (PARTITION BY session ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM q),
q3 AS (SELECT *, voiced AND (b IS NULL OR quiet - b >= 200) AS starts FROM q2), q4 AS (SELECT *, sum(starts::INT) OVER (PARTITION BY session ORDER BY seq)::BIGINT AS segment FROM q3)"""
_TICKS = f"""e AS (SELECT *, prob >= 0.5 AS speaking, coalesce(at_ms - lag(at_ms) OVER (PARTITION BY session ORDER BY seq), duration_ms)::BIGINT AS el, NOT coalesce(lag(prob >= 0.5) OVER (PARTITION BY session ORDER BY seq), false) AND prob >= 0.5 AS edge FROM ({FRAMES_SQL}))"""

#: The replay tick by tick: what fires (rules of a state in their order), then the state after it.
_REPLAY = f"""{_TICKS}, t AS (SELECT session, (seq * 2 + part)::BIGINT AS seq, speaking, elapsed, seq % 4 = 3 AS ended, seq % 5 = 1 AS ready, seq % 2 = 0 AS interject, seq % 3 = 0 AS interrupt
    FROM (SELECT session, seq, 0 AS part, speaking, CASE WHEN edge THEN 0 ELSE el END AS elapsed FROM e UNION ALL SELECT session, seq, 1, speaking, el FROM e WHERE edge)),
n AS (SELECT *, row_number() OVER (PARTITION BY session ORDER BY seq) AS place FROM t),
log AS (SELECT session, 0::BIGINT AS place, NULL::BIGINT AS seq, NULL::VARCHAR AS action, NULL::VARCHAR AS prev, 'greeting' AS state, 'none' AS draft, 0::BIGINT AS turn, 0::BIGINT AS idle, 0::BIGINT AS overlap, 500::BIGINT AS speech_left, false AS spoke FROM (SELECT DISTINCT session FROM n)
  UNION ALL SELECT session, place, seq, action, was,
    CASE action WHEN 'userInterruptsGreeting' THEN 'listening' WHEN 'greetingFinishes' THEN 'listening' WHEN 'userTurnEnds' THEN 'formulating' WHEN 'reachTalkLimit' THEN 'deciding_interject' WHEN 'idleHangup' THEN 'closing'
      WHEN 'interjectDeclined' THEN 'listening' WHEN 'interjectAccepted' THEN 'formulating' WHEN 'draftAbandoned' THEN 'listening' WHEN 'draftReady' THEN 'speaking' WHEN 'overlapTriggersDecision' THEN 'deciding_barge_in'
      WHEN 'speechCompletes' THEN 'listening' WHEN 'bargeInAccepted' THEN 'listening' WHEN 'bargeInDeclined' THEN 'speaking' WHEN 'closingInterrupted' THEN 'listening' WHEN 'closingCompletes' THEN 'ended' ELSE was END,
    CASE WHEN action IN ('userInterruptsGreeting', 'greetingFinishes', 'idleHangup', 'closingInterrupted') THEN 'none' WHEN action IN ('userTurnEnds', 'interjectAccepted') THEN 'building' WHEN action = 'draftAbandoned' THEN 'dropped'
      WHEN action = 'draftReady' THEN 'voicing' WHEN action IN ('speechCompletes', 'bargeInAccepted') THEN 'committed' ELSE draft END,
    CASE WHEN action IN ('userInterruptsGreeting', 'closingInterrupted') THEN elapsed WHEN action IN ('greetingFinishes', 'userTurnEnds', 'idleHangup', 'idleTicks', 'speechCompletes', 'speechPlays', 'closingCompletes') THEN 0 WHEN action = 'userKeepsTalking' THEN turn + elapsed ELSE turn END,
    CASE WHEN action = 'idleTicks' THEN idle + elapsed WHEN action IS NULL OR action IN ('greetingPlays', 'idleHangup', 'closingCompletes', 'closingPlays', 'ended') THEN idle ELSE 0 END,
    CASE WHEN action = 'overlapGrows' THEN overlap + elapsed WHEN action IS NULL OR action IN ('greetingPlays', 'overlapTriggersDecision', 'finishTailThroughOverlap', 'ended') THEN overlap ELSE 0 END,
    CASE WHEN action IN ('greetingPlays', 'finishTailThroughOverlap', 'speechPlays', 'closingPlays') THEN greatest(0, speech_left - elapsed) WHEN action = 'idleHangup' THEN 900 WHEN action = 'draftReady' THEN 2500
      WHEN action IN ('userInterruptsGreeting', 'greetingFinishes', 'userTurnEnds', 'interjectAccepted', 'draftAbandoned', 'speechCompletes', 'bargeInAccepted', 'closingInterrupted', 'closingCompletes') THEN 0 ELSE speech_left END,
    speaking
  FROM (SELECT *, coalesce(CASE was
      WHEN 'greeting' THEN CASE WHEN goes THEN 'userInterruptsGreeting' WHEN speech_left = 0 THEN 'greetingFinishes' WHEN NOT speaking THEN 'greetingPlays' END
      WHEN 'listening' THEN CASE WHEN ended THEN 'userTurnEnds' WHEN goes AND turn >= 300 THEN 'reachTalkLimit' WHEN goes THEN 'userKeepsTalking' WHEN NOT speaking AND idle >= 400 THEN 'idleHangup' WHEN NOT speaking THEN 'idleTicks' END
      WHEN 'deciding_interject' THEN CASE WHEN interject THEN 'interjectAccepted' ELSE 'interjectDeclined' END
      WHEN 'formulating' THEN CASE WHEN draft = 'building' AND goes THEN 'draftAbandoned' WHEN draft = 'building' AND ready THEN 'draftReady' WHEN draft = 'building' THEN 'formulatingWaits' END
      WHEN 'speaking' THEN CASE WHEN goes AND overlap >= 100 AND speech_left > 300 THEN 'overlapTriggersDecision' WHEN goes AND overlap >= 100 AND speech_left > 0 THEN 'finishTailThroughOverlap' WHEN goes AND speech_left > 0 AND overlap < 100 THEN 'overlapGrows'
        WHEN speech_left = 0 THEN 'speechCompletes' WHEN NOT speaking THEN 'speechPlays' END
      WHEN 'deciding_barge_in' THEN CASE WHEN interrupt THEN 'bargeInAccepted' ELSE 'bargeInDeclined' END
      WHEN 'closing' THEN CASE WHEN goes THEN 'closingInterrupted' WHEN speech_left = 0 AND NOT speaking THEN 'closingCompletes' WHEN speech_left > 0 THEN 'closingPlays' END
      ELSE 'ended' END, CASE WHEN speaking AND NOT spoke AND was <> 'ended' THEN 'userStartsSpeaking' END) AS action
    FROM (SELECT n.*, log.state AS was, log.draft, log.turn, log.idle, log.overlap, log.speech_left, log.spoke, n.speaking AND log.spoke AS goes FROM log JOIN n ON n.session = log.session AND n.place = log.place + 1)))"""
_CTX = """x AS (SELECT event_id, ['listening','speaking','formulating','closing'][event_id % 4 + 1] AS state, CASE WHEN event_id % 3 = 0 THEN 'bye' END AS intent, CASE WHEN event_id % 7 <> 0 THEN (event_id % 10) / 10.0::DOUBLE END AS conf, CASE WHEN event_id % 5 <> 0 THEN event_id % 6 END AS rc,
  CASE WHEN event_id % 5 <> 0 THEN (event_id % 11) / 10.0::DOUBLE END AS rs, CASE WHEN event_id % 13 <> 0 THEN event_id % 2 = 0 END AS ba, event_id % 8 = 0 AS te, CASE WHEN event_id % 17 = 0 THEN 'timeout' END AS et FROM events)"""
SQL = {
    "cv1_order": f"SELECT session, seq, row_number() OVER (PARTITION BY session ORDER BY start_ms, seq)::INT AS place FROM ({TURNS_SQL})",
    "cv2_overlaps": f"SELECT session, seq, coalesce(start_ms < max(end_ms) OVER (PARTITION BY session ORDER BY start_ms, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS overlaps FROM ({TURNS_SQL})",
    "cv3_history": f"WITH t AS ({TURNS_SQL}), {_HIST.format(n=4)} SELECT session, history FROM h4",
    "cv4_commit": f"""WITH x AS (SELECT session, seq, start_ms, CASE WHEN seq % 5 = 0 THEN 0 WHEN seq % 2 = 0 THEN 20 * length(text) ELSE floor(20 * length(text) * 0.6::DOUBLE)::BIGINT END AS dl, 20 * length(text) - seq * 7 AS pl FROM ({TURNS_SQL}) WHERE role = 'agent')
SELECT session, seq, CASE WHEN dl > 0 THEN start_ms + dl END AS end_ms, CASE WHEN dl > 0 THEN round(least(1.0::DOUBLE, dl / greatest(pl, dl)), 9) END AS voiced_fraction, CASE WHEN dl > 0 THEN dl < greatest(pl, dl) END AS is_partial FROM x""",
    "cv5_validate": """SELECT conv_id, turn, array_to_string(list_filter([CASE WHEN role NOT IN ('user', 'assistant') THEN 'role' END, CASE WHEN turn * 500 < 1000 THEN 'end before start' END,
  CASE WHEN role = 'user' AND turn % 3 = 0 THEN 'voiced_fraction of a user' END, CASE WHEN role = 'assistant' AND turn % 4 = 1 THEN 'stt_confidence of an agent' END], lambda e: e IS NOT NULL), '; ') AS errors FROM conversations""",
    "cv6_partials": f"""WITH p AS (SELECT session, seq AS segment, n::INT AS seq, CASE WHEN n = 3 AND seq % 4 = 0 THEN 'so ' || substr(text, 1, 20) ELSE substr(text, 1, 10 * n) END AS text FROM ({TURNS_SQL}), range(1, 5) x(n)),
l AS (SELECT *, lag(text) OVER (PARTITION BY session, segment ORDER BY seq) AS b FROM p)
SELECT session, segment, seq, text, CASE WHEN coalesce(b, '') = '' THEN text WHEN starts_with(text, b) THEN substr(text, length(b) + 1) ELSE ' ' || text END AS added FROM l""",
    "cv7_asof": f"""WITH f AS ({FRAMES_SQL}), o AS (SELECT session, 'k' || (seq % 3) AS kind, at_ms FROM f WHERE seq % 5 = 2), d AS (SELECT session, 'k' || (seq % 3) AS kind, at_ms, 'r' || seq AS result FROM f WHERE seq % 4 = 1)
SELECT o.session, o.kind, o.at_ms, d.result FROM o ASOF LEFT JOIN d ON o.session = d.session AND o.kind = d.kind AND o.at_ms >= d.at_ms""",
    "cv8_tail": f"SELECT session, seq, text, right(string_agg(text, '') OVER (PARTITION BY session ORDER BY seq), 300) AS tail FROM ({TURNS_SQL})",
    "cv9_voiced": "SELECT event_id, least(greatest(event_id % 900 - event_id % 700, 0), event_id % 300) AS voiced_ms FROM events",
    "cv10_prompts": f"""WITH t AS ({TURNS_SQL}), {_HIST.format(n=2)}
SELECT session, seq, concat_ws(chr(10) || chr(10), CASE WHEN seq % 2 = 0 THEN 'CONTEXT:' || chr(10) || 'about ' || role END, CASE WHEN seq > 1 AND trim(history) <> '' THEN 'HISTORY:' || chr(10) || history END,
  CASE WHEN seq % 3 = 0 THEN format('VOICED: {{:.1f}} s ({{}}%)', seq * 1230 / 1000, seq * 123000 // (seq * 4000)) END, CASE WHEN trim(text) <> '' THEN 'NOW:' || chr(10) || text END) AS prompt FROM t JOIN h2 USING (session)""",
    "st1_segments": f"""WITH {_VOICED}, g AS (SELECT session, segment, arg_min(at_ms + duration_ms, seq) FILTER (voiced) AS first, arg_max(coalesce(next_at, -1), seq) FILTER (voiced) AS nx, arg_max(quiet, seq) FILTER (voiced) AS lq, max(quiet) AS heard FROM q4 WHERE segment > 0 GROUP BY ALL)
SELECT session, segment, greatest(0, first - 300)::BIGINT AS start_ms, CASE WHEN heard - lq >= 200 THEN nx END AS end_ms FROM g""",
    "st2_overlap": f"""WITH {_VOICED}, r AS (SELECT *, voiced AND agent AS both_, sum((NOT (voiced AND agent))::INT) OVER (PARTITION BY session ORDER BY seq) AS run FROM q4),
s AS (SELECT session, run, seq, at_ms, sum(CASE WHEN starts THEN 0 ELSE duration_ms END) OVER (PARTITION BY session, run ORDER BY seq)::BIGINT AS spent FROM r WHERE both_)
SELECT session, arg_min(at_ms, seq) AS at_ms, arg_min(spent, seq) AS duration_ms FROM s WHERE spent >= 300 GROUP BY session, run""",
    "st3_agent_level": f"WITH f AS ({FRAMES_SQL}) SELECT f.session, f.seq, count(s.seq) > 0 AS agent FROM f LEFT JOIN f s ON s.session = f.session AND s.seq % 9 = 3 AND f.at_ms >= s.at_ms + 50 AND f.at_ms < s.at_ms + 350 GROUP BY f.session, f.seq",
    "st4_elapsed": f"WITH f AS (SELECT session, seq, CASE WHEN seq % 6 = 5 THEN at_ms - 150 ELSE at_ms END AS at_ms FROM ({FRAMES_SQL})), s AS (SELECT *, at_ms - lag(at_ms) OVER (PARTITION BY session ORDER BY seq) AS step FROM f) SELECT session, seq, CASE WHEN step > 0 THEN step ELSE 100 END AS elapsed_ms FROM s",
    "st5_windows": f"SELECT session, seq, (700 + CASE WHEN at_ms * 9 - 8000 > 0 THEN (floor((at_ms * 9 - 8000) / 6000) + 1) * 6000 ELSE 0 END)::BIGINT AS window_ms FROM ({FRAMES_SQL})",
    "st7_ring": f"WITH f AS (SELECT *, max(at_ms) OVER (PARTITION BY session) AS m FROM ({FRAMES_SQL})) SELECT session, count(*) AS n, min(at_ms) AS oldest FROM f WHERE at_ms > m - 3000 GROUP BY session",
    "st8_slices": f"""WITH f AS (SELECT *, max(at_ms) OVER (PARTITION BY session) AS m FROM ({FRAMES_SQL})), a AS (SELECT session, seq AS request, at_ms + 130 AS lo, at_ms + 420 AS hi FROM f WHERE seq % 10 = 0)
SELECT a.session, a.request, coalesce(string_agg(f.seq::VARCHAR, ',' ORDER BY f.seq), '') AS frames FROM a LEFT JOIN f ON f.session = a.session AND f.at_ms > f.m - 4000 AND f.at_ms < hi AND f.at_ms + f.duration_ms > lo GROUP BY a.session, a.request""",
    "st10_ticks": f"WITH {_TICKS} SELECT session, seq, 0::INT AS part, speaking, CASE WHEN edge THEN 0 ELSE el END AS elapsed_ms FROM e UNION ALL SELECT session, seq, 1, speaking, el FROM e WHERE edge",
    "st14_minutes": "SELECT date_trunc('minute', ts) AS minute, event_type, count(*) AS count FROM events GROUP BY ALL",
    "st15_match": f"""WITH {_CTX} SELECT event_id, state, CASE WHEN state <> 'closing' AND et = 'timeout' THEN 'failed' WHEN state IN ('listening', 'speaking') AND intent = 'bye' AND conf >= 0.7 THEN 'goodbye' WHEN state = 'formulating' AND (rc = 0 OR rs < 0.3) THEN 'unknown'
  WHEN state = 'listening' AND te THEN 'empty' WHEN state = 'speaking' AND NOT coalesce(ba, false) THEN 'declined' WHEN state IN ('listening', 'formulating') THEN 'default' END AS scenario FROM x""",
    "st16_conditions": f"WITH {_CTX} SELECT event_id, coalesce(intent = 'bye', false) AS c0, NOT coalesce(rs < 0.5, false) AS c1, coalesce(rc = 2, false) OR true AS c2, coalesce(conf >= 0.5, false) AND NOT te AS c3 FROM x",
    "st17_shadowed": "SELECT 'listening' AS state, 'late' AS name, count(*) AS contexts FROM events WHERE event_id % 4 = 0",
}
SQL["st1_segments_stream"] = SQL["st1_segments"].replace(FRAMES_SQL, _STREAM_SQL)
_THIN = "WITH RECURSIVE e AS ({}), k AS (SELECT session, min(at_ms) AS at_ms FROM e GROUP BY session UNION ALL SELECT k.session, min(e.at_ms) FROM k JOIN e ON e.session = k.session AND e.at_ms >= k.at_ms + {} GROUP BY k.session) SELECT session, at_ms FROM k"
SQL["st6_thin"] = _THIN.format(f"SELECT session, at_ms FROM ({FRAMES_SQL}) WHERE prob > 0.5", 250)
SQL["st6_thin_stream"] = _THIN.format(f"SELECT session, at_ms FROM ({_STREAM_SQL})", 2500)
_SEG500 = SQL["st1_segments"].replace(">= 200", ">= 500")
SQL["st5_turn_windows"] = f"""WITH s AS (SELECT * FROM ({_SEG500}) WHERE end_ms IS NOT NULL), k AS (SELECT session, segment, unnest(range(CASE WHEN end_ms - start_ms > 1000 THEN (end_ms - start_ms - 1000) // 700 + 2 ELSE 1 END)) AS w, start_ms, end_ms FROM s),
x AS (SELECT session, segment, w AS window, start_ms + w * 700 AS from_ms, least(end_ms, start_ms + w * 700 + 1000) AS to_ms FROM k)
SELECT x.session, x.segment, x.window, x.from_ms, x.to_ms, count(f.seq) AS frames, round(avg(f.prob), 6) AS mean_prob FROM x LEFT JOIN ({FRAMES_SQL}) f ON f.session = x.session AND f.at_ms >= x.from_ms AND f.at_ms < x.to_ms GROUP BY ALL"""
SQL["st5_sliding"] = SQL["st5_sliding_stream"] = "SELECT start, event_type, count(*) AS count FROM (SELECT time_bucket(INTERVAL 20 MINUTE, ts) - k * INTERVAL 20 MINUTE AS start, event_type FROM events, range(3) r(k)) GROUP BY ALL"
SQL["st1_coarse"] = SQL["st1_coarse_stream"] = """WITH v AS (SELECT user_id AS session, ts, coalesce(ts - lag(ts) OVER w > INTERVAL 6 HOUR, true)::INT AS new FROM events WHERE event_id % 5 < 3 WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
i AS (SELECT *, sum(new) OVER (PARTITION BY session ORDER BY ts) AS n FROM v) SELECT session, min(ts) AS start, max(ts) + INTERVAL 6 HOUR AS "end", count(*) AS frames FROM i GROUP BY session, n"""
_CAP = """WITH RECURSIVE e AS (SELECT session, at_ms, seq % 7 * 100 + 100 AS run_ms FROM ({0}) WHERE prob > 0.5 AND seq % 7 <> 3),
k AS (SELECT session, min(at_ms) AS at_ms, arg_min(run_ms, at_ms) AS run_ms FROM e GROUP BY session UNION ALL SELECT k.session, min(e.at_ms), arg_min(e.run_ms, e.at_ms) FROM k JOIN e ON e.session = k.session AND e.at_ms >= k.at_ms + {1} AND e.at_ms >= k.at_ms + k.run_ms GROUP BY k.session) SELECT session, at_ms FROM k"""
SQL["st6_capped"], SQL["st6_capped_stream"] = _CAP.format(FRAMES_SQL, 250), _CAP.format(_STREAM_SQL, 2500)
SQL["st8_samples"] = f"""WITH f AS (SELECT session, seq, at_ms FROM ({FRAMES_SQL})), s AS (SELECT session, at_ms * 80 // 1000 + k AS i, (seq * 8 + k) % 1000 AS v FROM f, range(8) r(k) WHERE seq % 7 <> 6),
h AS (SELECT session, max(i) + 1 AS head, min(i) AS first FROM s GROUP BY session),
a AS (SELECT session, seq AS request, greatest((at_ms + 37) * 80 // 1000, first, head - 320) AS lo, least(CASE WHEN seq % 30 <> 0 THEN (at_ms + 37 + seq % 9 * 60) * 80 // 1000 ELSE head END, head) AS hi FROM f JOIN h USING (session) WHERE seq % 10 = 0),
p AS (SELECT session, request, unnest(range(lo, hi)) AS i FROM a)
SELECT a.session, a.request, count(p.i)::INT AS n, coalesce(string_agg(coalesce(v, 0)::VARCHAR, ',' ORDER BY p.i) FILTER (p.i IS NOT NULL), '') AS samples FROM a LEFT JOIN p USING (session, request) LEFT JOIN s ON s.session = p.session AND s.i = p.i GROUP BY ALL"""
_AGENT = f"(SELECT * REPLACE (EXISTS (SELECT 1 FROM events b WHERE b.event_type = 'purchase' AND b.user_id = session AND at_ms >= b.event_id * 100 AND at_ms < b.event_id * 100 + 60000) AS agent) FROM ({_STREAM_SQL}))"
SQL["st2_speech_stream"] = f"""SELECT session, 'segment' AS kind, start_ms AS at_ms, end_ms AS value FROM ({SQL["st1_segments_stream"]}) UNION ALL
SELECT session, 'overlap', at_ms, duration_ms FROM ({SQL["st2_overlap"].replace(FRAMES_SQL, _AGENT[1:-1]).replace("spent >= 300", "spent >= 200")})"""
SQL["st7_late_stream"] = "SELECT event_id, user_id FROM events"
SQL["st14_minutes_stream"] = SQL["st14_minutes"]
SQL["io11_exposition_stream"] = EVALUATION_SQL["io11_exposition"]
_LOG = f"WITH RECURSIVE {_REPLAY} SELECT session, seq, action, prev, state, draft, turn, idle, overlap, speech_left FROM log WHERE place > 0"
_EDGES = ", ".join(f"('{prev}', '{action}', '{state}')" for prev, action, state in a.EDGES)
SQL["st9_replay"] = _LOG
SQL["st11_transitions"] = f"""WITH l AS (SELECT * REPLACE (CASE WHEN session % 10 = 0 AND seq = 20 THEN 'closing' ELSE state END AS state) FROM ({_LOG}))
SELECT session, seq, 'edge' AS fault FROM l WHERE action IS NOT NULL AND (prev, action, state) NOT IN (VALUES {_EDGES})
UNION ALL SELECT session, seq, 'break' FROM (SELECT *, lead(prev) OVER (PARTITION BY session ORDER BY seq) AS after FROM l) WHERE after <> state"""
SQL["st12_invariants"] = f"""WITH l AS (SELECT *, lag(draft) OVER w AS ld, lag(turn) OVER w AS lt, lag(overlap) OVER w AS lo, lag(speech_left) OVER w AS ll FROM ({_LOG}) WINDOW w AS (PARTITION BY session ORDER BY seq))
SELECT count(*) AS n, count(*) FILTER (draft = 'committed' AND ld = 'dropped') AS dropped_stays_uncommitted, count(*) FILTER (state = 'speaking' AND draft <> 'voicing') AS speaking_has_draft,
  count(*) FILTER (state = 'deciding_barge_in' AND prev <> 'deciding_barge_in' AND NOT (lo >= 100 AND ll > 300)) AS barge_in_warranted, count(*) FILTER (action = 'reachTalkLimit' AND lt < 300) AS interject_after_limit,
  count(*) FILTER (prev = 'ended' AND state <> 'ended') AS ended_is_final FROM l"""
QUERIES = {n: fn for n, fn in list(globals().items()) if n[:2] in ("cv", "st", "io") and n[2:3].isdigit() and callable(fn)}
