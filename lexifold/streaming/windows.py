"""Windows of turns, capped runs, and the sound of intervals."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from .frames import RING_MS, THRESHOLD, keep_waiting

# Length and overlap of transcription windows.
WINDOW_MS, OVERLAP_MS = 8000, 2000


def slides(elapsed_ms: Column, window_ms: int = WINDOW_MS, overlap_ms: int = OVERLAP_MS) -> Column:
    """How often the window of a turn has moved on: never while it fits, then once, and again after each further step."""
    step = max(window_ms - overlap_ms, 1)
    return F.when(elapsed_ms > window_ms, F.floor((elapsed_ms - window_ms) / step) + 1).otherwise(0)


def stt_window_start(turn_start: Column, now: Column, window_ms: int = WINDOW_MS, overlap_ms: int = OVERLAP_MS) -> Column:
    """Where the transcription window of a turn begins at some time."""
    return turn_start + slides(now - turn_start, window_ms, overlap_ms) * max(window_ms - overlap_ms, 1)


def turn_windows(turns: DataFrame, window_ms: int = WINDOW_MS, overlap_ms: int = OVERLAP_MS) -> DataFrame:
    """turns (start_ms, end_ms, ...) with a row for each window that they go through: window (from 0), from_ms, to_ms."""
    step = max(window_ms - overlap_ms, 1)
    each = turns.withColumn("window", F.explode(F.sequence(F.lit(0).cast("long"), slides(F.col("end_ms") - F.col("start_ms"), window_ms, overlap_ms).cast("long"))))
    begin = F.col("start_ms") + F.col("window") * step
    return each.withColumn("from_ms", begin).withColumn("to_ms", F.least(F.col("end_ms"), begin + window_ms))


def frames_of_windows(frames: DataFrame, windows: DataFrame, keys: list[str], bucket_ms: int = 10_000) -> DataFrame:
    """For windows (session, *keys, from_ms, to_ms) how many frames begin inside, and their mean prob. Windows are dealt to the time
    buckets that they touch, frames to their own, so the join is by equal keys."""
    dealt = windows.where("to_ms > from_ms").withColumn("b", F.explode(F.sequence(F.floor(F.col("from_ms") / bucket_ms), F.floor((F.col("to_ms") - 1) / bucket_ms))))
    timed = frames.select("session", "at_ms", "prob", F.floor(F.col("at_ms") / bucket_ms).alias("b"))
    hits = dealt.join(timed, ["session", "b"]).where("at_ms >= from_ms and at_ms < to_ms")
    found = hits.groupBy("session", *keys).agg(F.count("*").alias("frames"), F.avg("prob").alias("mean_prob"))
    return windows.join(found, ["session", *keys], "left").withColumn("frames", F.coalesce("frames", F.lit(0).cast("long")))


def sliding_counts(events: DataFrame, labels: list[str], length: str, step: str, ts: str = "ts", late: str = "1 minute") -> DataFrame:
    """Counts by labels and overlapping windows of a fixed clock, of a batch or a stream."""
    timed = events.withWatermark(ts, late) if events.isStreaming else events
    return timed.groupBy(F.window(ts, length, step).alias("w"), *labels).agg(F.count("*").alias("count")).select(F.col("w.start").alias("start"), *labels, "count")


def coarse_sessions(frames: DataFrame, gap: str, threshold: float = THRESHOLD, late: str = "1 minute") -> DataFrame:
    """(session, start, end, frames) of voiced frames (session, ts, prob), of a batch or a stream: frames that begin no more than gap apart
    belong together. Unlike speech_segments there's no preroll, the gap counts from the beginning of a frame, and end is a gap after
    the last one; the state is one window, so no code of ours runs for it."""
    voiced = frames.where(F.col("prob") >= threshold)
    timed = voiced.withWatermark("ts", late) if voiced.isStreaming else voiced
    return timed.groupBy("session", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("frames")).select("session", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "frames")


def capped(f: pd.DataFrame, min_gap_ms: int, last: int | None = None, busy: int | None = None) -> tuple[pd.DataFrame, int | None, int | None]:
    """The rows at which a run starts, by time: not before min_gap_ms since the last start, nor while one is in flight, nor without sound."""
    keep = []
    for at, run, samples in zip(f["at_ms"].tolist(), f["run_ms"].tolist(), f["samples"].tolist()):
        due = samples > 0 and (last is None or at - last >= min_gap_ms) and (busy is None or at >= busy)
        if due:
            last, busy = at, at + run
        keep.append(due)
    return f[keep], last, busy


def cap_runs(events: DataFrame, min_gap_ms: int) -> DataFrame:
    """Of events (session, at_ms, run_ms: how long a run that starts here would take, samples: how many there are to read) those at which
    a run starts."""
    return events.groupBy("session").applyInPandas(lambda f: capped(f.sort_values("at_ms", kind="stable"), min_gap_ms)[0], events.schema)


def stream_cap_runs(events: DataFrame, min_gap_ms: int, gone_ms: int = RING_MS) -> DataFrame:
    """cap_runs of a stream with a watermark on ts; the state is the last start and until when its run takes. A session that has been
    silent for gone_ms and longer than its run starts anew."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        f = pd.concat(list(frames)).sort_values("at_ms", kind="stable")
        kept, last, busy = capped(f, min_gap_ms, *((None if x < 0 else x for x in state.get) if state.exists else (None, None)))
        state.update((-1 if last is None else int(last), -1 if busy is None else int(busy)))
        newest = int(f["at_ms"].max())
        keep_waiting(state, f, max(gone_ms, min_gap_ms, (busy or 0) - newest))
        yield kept[["session", "at_ms"]]

    return events.groupBy("session").applyInPandasWithState(step, "session long, at_ms long", "last long, busy long", "append", GroupStateTimeout.EventTimeTimeout)


def slice_samples(frames: DataFrame, requests: DataFrame, rate: int = 16_000, keep_ms: int = RING_MS, bucket_ms: int = 10_000) -> DataFrame:
    """requests (session, request, from_ms, to_ms) with samples: the sound in [from_ms, to_ms) of frames (session, seq, at_ms, samples),
    cut inside frames. Without to_ms it goes up to the newest sample. What is older than keep_ms before the newest sample, or before the
    first one, isn't there; a request wholly outside, or of an unknown session, gets an empty array.

    Frames stand on the sample clock, at at_ms * rate / 1000 rounded down. Where one begins before the one ahead of it has ended, it
    overwrites the rest of that. Between frames there is silence. Both sides are dealt to buckets of the clock, so the join is by equal
    keys; a request's frames meet in one row of at most keep_ms.
    """
    at = F.floor(F.col("at_ms") * rate / 1000).cast("long")
    by_seq = Window.partitionBy("session").orderBy("seq")
    full = frames.where(F.size("samples") > 0).select("session", "seq", "samples", at.alias("start"))
    full = full.withColumn("stop", F.col("start") + F.size("samples")).withColumn("next", F.lead("start").over(by_seq))
    span = full.groupBy("session").agg(F.max("stop").alias("head"), F.min_by("start", "seq").alias("first"))
    span = span.select("session", "head", F.greatest("first", F.col("head") - F.floor(F.lit(keep_ms * rate / 1000)).cast("long")).alias("oldest"))
    begin = F.greatest(F.floor(F.col("from_ms") * rate / 1000).cast("long"), F.col("oldest"))
    end = F.least(F.coalesce(F.floor(F.col("to_ms") * rate / 1000).cast("long"), F.col("head")), F.col("head"))
    asked = requests.select("session", "request", "from_ms", "to_ms").join(span, "session").select("session", "request", begin.alias("a"), end.alias("z")).where("z > a")
    size = bucket_ms * rate // 1000
    deal = lambda low, high: F.explode(F.sequence(F.floor(F.col(low) / size), F.floor((F.col(high) - 1) / size)))
    held = full.withColumn("until", F.least("stop", F.coalesce("next", "stop"))).where("until > start").withColumn("b", deal("start", "until"))
    hits = asked.withColumn("b", deal("a", "z")).join(held, ["session", "b"]).where("start < z and until > a").dropDuplicates(["session", "request", "seq"])
    cut = hits.select("session", "request", "a", "z", F.greatest("start", "a").alias("p"), F.least("until", "z").alias("q"), "start", "samples")
    cut = cut.withColumn("part", F.slice("samples", (F.col("p") - F.col("start") + 1).cast("int"), (F.col("q") - F.col("p")).cast("int")))
    before = F.coalesce(F.lag("q").over(Window.partitionBy("session", "request").orderBy("p")), F.col("a"))
    zeros = lambda n: F.array_repeat(F.lit(0).cast("smallint"), n.cast("int"))
    filled = cut.withColumn("part", F.concat(zeros(F.col("p") - before), "part"))
    joined = filled.groupBy("session", "request", "z").agg(F.array_sort(F.collect_list(F.struct("p", "part"))).alias("parts"), F.max("q").alias("q"))
    sound = joined.select("session", "request", F.concat(F.flatten("parts.part"), zeros(F.col("z") - F.col("q"))).alias("sound"))
    # a request inside a gap meets no frame: it is silent as a whole
    silent = asked.select("session", "request", zeros(F.col("z") - F.col("a")).alias("silence"))
    out = requests.join(sound, ["session", "request"], "left").join(silent, ["session", "request"], "left")
    return out.withColumn("samples", F.coalesce("sound", "silence", F.array().cast("array<smallint>"))).drop("sound", "silence")
