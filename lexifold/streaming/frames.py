"""Speech frames to segments, overlaps and ticks: batch forms by windows, streaming forms by state per session.

Frames are (session, seq, at_ms, duration_ms, prob, agent)."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

# Fixed values of speech detection and of transcription windows.
THRESHOLD, PREROLL_MS, SILENCE_MS, OVERLAP_MS = 0.5, 300, 500, 1000
RING_MS = 60_000


def _by_time() -> Window:
    return Window.partitionBy("session").orderBy("seq")


def _voiced(frames: DataFrame, threshold: float, silence_ms: int) -> DataFrame:
    """frames with voiced, and for voiced ones segment: its number, which rises after enough silence."""
    quiet = F.sum(F.when(F.col("prob") >= threshold, 0).otherwise(F.col("duration_ms"))).over(_by_time())
    s = frames.withColumn("voiced", F.col("prob") >= threshold).withColumn("quiet", quiet).withColumn("next_at", F.lead("at_ms").over(_by_time()))
    before = F.last(F.when(F.col("voiced"), F.col("quiet")), True).over(_by_time().rowsBetween(Window.unboundedPreceding, -1))
    new = F.col("voiced") & (before.isNull() | (F.col("quiet") - before >= silence_ms))
    return s.withColumn("starts", new).withColumn("segment", F.sum(F.col("starts").cast("int")).over(_by_time()))


def speech_segments(frames: DataFrame, threshold: float = THRESHOLD, preroll_ms: int = PREROLL_MS, silence_ms: int = SILENCE_MS) -> DataFrame:
    """(session, segment, start_ms, end_ms): speech from preroll before its first voiced frame's end; its end is where silence of
    silence_ms or more began, null while there was none."""
    v = _voiced(frames, threshold, silence_ms)
    total = F.max("quiet").over(Window.partitionBy("session", "segment"))
    v = v.withColumn("heard", total).where("voiced")
    g = v.groupBy("session", "segment").agg(F.min_by(F.col("at_ms") + F.col("duration_ms"), "seq").alias("first"), F.max_by(F.struct("next_at", "quiet"), "seq").alias("last"), F.max("heard").alias("heard"))
    ended = F.col("heard") - F.col("last.quiet") >= silence_ms
    return g.select("session", "segment", F.greatest(F.lit(0), F.col("first") - preroll_ms).cast("long").alias("start_ms"), F.when(ended, F.col("last.next_at")).alias("end_ms"))


def overlap_episodes(frames: DataFrame, limit_ms: int = OVERLAP_MS, threshold: float = THRESHOLD, silence_ms: int = SILENCE_MS) -> DataFrame:
    """(session, at_ms, duration_ms): once for each time that agent and user speak together for limit_ms; frames that start a
    segment don't count."""
    v = _voiced(frames, threshold, silence_ms).withColumn("both", F.col("voiced") & F.col("agent"))
    run = F.sum((~F.col("both")).cast("int")).over(_by_time())
    part = Window.partitionBy("session", "run").orderBy("seq")
    v = v.withColumn("run", run).where("both").withColumn("spent", F.sum(F.when(F.col("starts"), 0).otherwise(F.col("duration_ms"))).over(part))
    due = v.where(F.col("spent") >= limit_ms).groupBy("session", "run").agg(F.min_by(F.struct("at_ms", "spent"), "seq").alias("f"))
    return due.select("session", F.col("f.at_ms").alias("at_ms"), F.col("f.spent").cast("long").alias("duration_ms"))


def agent_level(frames: DataFrame, speech: DataFrame, bucket_ms: int = 10_000) -> DataFrame:
    """frames with agent: whether they begin within an interval (session, start_ms, end_ms) of agent speech.

    Intervals are dealt to time buckets, so the join is by equal keys."""
    cut = speech.where("end_ms > start_ms").withColumn("bucket", F.explode(F.sequence(F.floor(F.col("start_ms") / bucket_ms), F.floor((F.col("end_ms") - 1) / bucket_ms)))).select(F.col("session").alias("s"), "bucket", F.col("start_ms").alias("from_ms"), F.col("end_ms").alias("to_ms"))
    keyed = frames.drop("agent").withColumn("b", F.floor(F.col("at_ms") / bucket_ms))
    hit = keyed.join(cut, (F.col("session") == F.col("s")) & (F.col("b") == F.col("bucket")) & (F.col("at_ms") >= F.col("from_ms")) & (F.col("at_ms") < F.col("to_ms")), "left_semi").select("session", "seq", F.lit(True).alias("agent"))
    return keyed.drop("b").join(hit, ["session", "seq"], "left").withColumn("agent", F.coalesce("agent", F.lit(False)))


def elapsed(frames: DataFrame) -> DataFrame:
    """frames with elapsed_ms: the step from the frame before; the frame's own length for the first, or where time didn't advance."""
    step = F.col("at_ms") - F.lag("at_ms").over(_by_time())
    return frames.withColumn("elapsed_ms", F.when(step > 0, step).otherwise(F.col("duration_ms")).cast("long"))


def thin_frame(f: pd.DataFrame, min_gap_ms: int, last: int | None = None) -> tuple[pd.DataFrame, int | None]:
    keep = []
    for at in f["at_ms"].tolist():
        due = last is None or at - last >= min_gap_ms
        last = at if due else last
        keep.append(due)
    return f[keep], last


def thin_events(events: DataFrame, min_gap_ms: int) -> DataFrame:
    """Events (session, at_ms, ...) of which each is at least min_gap_ms after the last one kept."""
    return events.groupBy("session").applyInPandas(lambda f: thin_frame(f.sort_values("at_ms", kind="stable"), min_gap_ms)[0], events.schema)


def stream_thin(events: DataFrame, min_gap_ms: int) -> DataFrame:
    """thin_events of a stream of (session, at_ms, ts) with a watermark on ts: the last kept time is the state, which goes when the
    session has been silent for longer than the gap."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        f = pd.concat(list(frames))
        kept, last = thin_frame(f.sort_values("at_ms", kind="stable"), min_gap_ms, state.get[0] if state.exists else None)
        state.update((int(last),))
        keep_waiting(state, f, min_gap_ms)
        yield kept[["session", "at_ms"]]

    return events.groupBy("session").applyInPandasWithState(step, "session long, at_ms long", "last long", "append", GroupStateTimeout.EventTimeTimeout)


def keep_waiting(state: GroupState, f: pd.DataFrame, ms: int) -> None:
    """Let the state time out when the watermark is ms past the latest of these rows."""
    state.setTimeoutTimestamp(max(int(f["ts"].max().timestamp() * 1000), state.getCurrentWatermarkMs()) + ms + 1)


def ring(frames: DataFrame, keep_ms: int = RING_MS) -> DataFrame:
    """Frames no older than keep_ms before the session's newest: what a ring of that length still holds."""
    return frames.withColumn("newest", F.max("at_ms").over(Window.partitionBy("session"))).where(F.col("at_ms") > F.col("newest") - keep_ms).drop("newest")


def slice_frames(frames: DataFrame, requests: DataFrame, keep_ms: int = RING_MS, bucket_ms: int = 10_000) -> DataFrame:
    """requests (session, request, from_ms, to_ms) with frames: the seqs of frames that overlap [from_ms, to_ms), of those that the
    ring still holds, in order; an empty array where there are none."""
    held = ring(frames, keep_ms).withColumn("b", F.explode(F.sequence(F.floor(F.col("at_ms") / bucket_ms), F.floor((F.col("at_ms") + F.col("duration_ms") - 1) / bucket_ms))))
    asked = requests.withColumn("b", F.explode(F.sequence(F.floor(F.col("from_ms") / bucket_ms), F.floor((F.greatest("to_ms", F.col("from_ms") + 1) - 1) / bucket_ms))))
    hits = asked.join(held.select("session", "b", "seq", "at_ms", "duration_ms"), ["session", "b"]).where("at_ms < to_ms and at_ms + duration_ms > from_ms")
    found = hits.groupBy("session", "request").agg(F.array_sort(F.collect_set("seq")).alias("frames"))
    return requests.join(found, ["session", "request"], "left").withColumn("frames", F.coalesce("frames", F.array().cast("array<int>")))


def to_ticks(frames: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(session, seq, part, speaking, elapsed_ms): a tick for each frame; one that begins speech gives two, the first without time."""
    s = elapsed(frames).withColumn("speaking", F.col("prob") >= threshold)
    edge = F.col("speaking") & ~F.coalesce(F.lag("speaking").over(_by_time()), F.lit(False))
    one = lambda p, ms: F.struct(F.lit(p).alias("part"), ms.cast("long").alias("elapsed_ms"))
    s = s.withColumn("edge", edge)
    parts = F.when(F.col("edge"), F.array(one(0, F.lit(0)), one(1, F.col("elapsed_ms")))).otherwise(F.array(one(0, F.col("elapsed_ms"))))
    return s.select("session", "seq", "speaking", F.explode(parts).alias("t")).select("session", "seq", "t.part", "speaking", "t.elapsed_ms")


SEGMENT_STATE = "speech_start long, quiet_from long, quiet_ms long, number int"


def stream_segments(frames: DataFrame, threshold: float = THRESHOLD, preroll_ms: int = PREROLL_MS, silence_ms: int = SILENCE_MS, gone_ms: int = RING_MS) -> DataFrame:
    """Segments (session, segment, start_ms, end_ms) of a stream of frames with a watermark on ts, one small state for each session.
    A session without frames for gone_ms is over: its state goes, and a segment that is open then is given without an end."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        start, quiet_from, quiet, number = state.get if state.exists else (-1, -1, 0, 0)
        out = []
        if state.hasTimedOut:
            state.remove()
            if start >= 0:
                yield pd.DataFrame({"session": [key[0]], "segment": [number], "start_ms": [start], "end_ms": pd.array([None], "Int64")})
            return
        f = pd.concat(list(batches)).sort_values("seq")
        for at, length, prob in zip(f["at_ms"].tolist(), f["duration_ms"].tolist(), f["prob"].tolist()):
            if prob >= threshold:
                if start < 0:
                    start, number = max(0, at + length - preroll_ms), number + 1
                quiet_from, quiet = -1, 0
            elif start >= 0:
                quiet_from, quiet = (at if quiet_from < 0 else quiet_from), quiet + length
                if quiet >= silence_ms:
                    out.append((key[0], number, start, quiet_from))
                    start, quiet_from, quiet = -1, -1, 0
        state.update((int(start), int(quiet_from), int(quiet), int(number)))
        keep_waiting(state, f, gone_ms)
        yield pd.DataFrame(out, columns=["session", "segment", "start_ms", "end_ms"])

    return frames.groupBy("session").applyInPandasWithState(step, "session long, segment long, start_ms long, end_ms long", SEGMENT_STATE, "append", GroupStateTimeout.EventTimeTimeout)


def live_counters(events: DataFrame, labels: list[str], ts: str = "ts", late: str = "1 minute") -> DataFrame:
    """Counts by labels and minute, of a batch or a stream; events later than `late` are dropped by a stream."""
    timed = events.withWatermark(ts, late) if events.isStreaming else events
    return timed.groupBy(F.window(ts, "1 minute").alias("w"), *labels).agg(F.count("*").alias("count")).select(F.col("w.start").alias("minute"), *labels, "count")
