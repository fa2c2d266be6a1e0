"""Speech and overlaps from one stateful operator, fed by frames and by the agent's intervals."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from .frames import OVERLAP_MS, PREROLL_MS, RING_MS, SILENCE_MS, THRESHOLD, keep_waiting, overlap_episodes, speech_segments

#: speech_start, quiet_from, quiet: as in stream_segments; open: intervals of the agent that are on; both: how long both have spoken;
#: ahead, steps: times and directions of edges that frames haven't come to yet.
GATE_STATE = "speech_start long, quiet_from long, quiet long, open long, both long, fired boolean, ahead array<long>, steps array<long>"
EVENTS = "session long, kind string, at_ms long, value long"


def speech_events(frames: DataFrame, limit_ms: int = OVERLAP_MS, threshold: float = THRESHOLD, preroll_ms: int = PREROLL_MS, silence_ms: int = SILENCE_MS) -> DataFrame:
    """(session, kind, at_ms, value) of frames with agent: a `segment` with its start and end (null while it goes on), an `overlap` with
    the frame at which both had spoken for limit_ms and how long that was."""
    segments = speech_segments(frames, threshold, preroll_ms, silence_ms).select("session", F.lit("segment").alias("kind"), F.col("start_ms").alias("at_ms"), F.col("end_ms").alias("value"))
    return segments.unionByName(overlap_episodes(frames, limit_ms, threshold, silence_ms).select("session", F.lit("overlap").alias("kind"), "at_ms", F.col("duration_ms").alias("value")))


def agent_edges(speech: DataFrame) -> DataFrame:
    """(session, at_ms, step, ts): 1 where an interval (session, start_ms, end_ms, ts) of the agent begins, -1 where it ends."""
    edge = lambda at, step: F.struct(F.col(at).alias("at_ms"), F.lit(step).alias("step"))
    return speech.where("end_ms > start_ms").select("session", "ts", F.explode(F.array(edge("start_ms", 1), edge("end_ms", -1))).alias("e")).select("session", "e.at_ms", "e.step", "ts")


def stream_speech_events(frames: DataFrame, edges: DataFrame, limit_ms: int = OVERLAP_MS, threshold: float = THRESHOLD, preroll_ms: int = PREROLL_MS, silence_ms: int = SILENCE_MS, gone_ms: int = RING_MS) -> DataFrame:
    """speech_events of a stream of frames and one of the agent's edges, both with ts and a watermark on it.

    Both come as one stream with a side, so a session has one state for its speech and its overlaps, and one exchange. Frames of a
    batch are taken by time; an edge waits in the state for the first frame that begins with it or after it, and one that comes late
    counts from then on. Only the level at frames counts: an agent that stops and goes on between two frames goes on. A session without rows for gone_ms is over, and a
    segment that is open then is given without an end.
    """
    none = F.lit(None)
    one = frames.select("session", "at_ms", F.lit(0).alias("step"), F.col("duration_ms").cast("long").alias("duration_ms"), "prob", "ts")
    other = edges.select("session", "at_ms", "step", none.cast("long").alias("duration_ms"), none.cast("double").alias("prob"), "ts")

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        start, quiet_from, quiet, open_, both, fired, ahead, steps = state.get if state.exists else (-1, -1, 0, 0, 0, False, [], [])
        if state.hasTimedOut:
            state.remove()
            if start >= 0:
                yield pd.DataFrame({"session": [key[0]], "kind": ["segment"], "at_ms": [start], "value": pd.array([None], "Int64")})
            return
        f = pd.concat(list(batches))
        turned = f[f["step"] != 0]
        edges = sorted([*zip(ahead, steps), *zip(turned["at_ms"].tolist(), turned["step"].tolist())], key=lambda e: (e[0], -e[1]))
        heard = f[f["step"] == 0].sort_values("at_ms", kind="stable")
        out, passed = [], 0
        for at, length, prob in zip(heard["at_ms"].tolist(), heard["duration_ms"].tolist(), heard["prob"].tolist()):
            while passed < len(edges) and edges[passed][0] <= at:
                open_ = max(0, open_ + edges[passed][1])
                passed += 1
            voiced = prob >= threshold
            begins = voiced and start < 0
            if voiced:
                start = max(0, at + int(length) - preroll_ms) if begins else start
                quiet_from, quiet = -1, 0
            elif start >= 0:
                quiet_from, quiet = (at if quiet_from < 0 else quiet_from), quiet + int(length)
                if quiet >= silence_ms:
                    out.append((key[0], "segment", start, quiet_from))
                    start, quiet_from, quiet = -1, -1, 0
            if not (voiced and open_ > 0):
                both, fired = 0, False
                continue
            both += 0 if begins else int(length)
            if both >= limit_ms and not fired:
                out.append((key[0], "overlap", at, both))
                fired = True
        state.update((int(start), int(quiet_from), int(quiet), int(open_), int(both), bool(fired), [int(a) for a, _ in edges[passed:]], [int(x) for _, x in edges[passed:]]))
        keep_waiting(state, f, gone_ms)
        yield pd.DataFrame(out, columns=["session", "kind", "at_ms", "value"])

    return one.unionByName(other).groupBy("session").applyInPandasWithState(step, EVENTS, GATE_STATE, "append", GroupStateTimeout.EventTimeTimeout)
