"""Replay of the session automaton, and checks of its log."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


@dataclass(frozen=True)
class Limits:
    turn_ms: int = 20_000
    idle_ms: int = 10_000
    overlap_ms: int = 1000
    tail_ms: int = 1500


@dataclass(slots=True)
class Session:
    agent: str = "greeting"
    draft: str = "none"
    turn: int = 0
    idle: int = 0
    overlap: int = 0
    left: int = 0
    spoke: bool = False


@dataclass(slots=True)
class Tick:
    speaking: bool = False
    elapsed: int = 0
    ended: bool = False
    ready: bool = False
    answer_ms: int = 0
    farewell_ms: int = 0
    interject: bool | None = None
    interrupt: bool | None = None


Rule = tuple[str, str, Callable[[Session, Tick, Limits], bool], Callable[[Session, Tick], dict]]


def _played(s: Session, t: Tick) -> int:
    return max(0, s.left - t.elapsed)


def _goes_on(s: Session, t: Tick) -> bool:
    return t.speaking and s.spoke


_CLEAR = {"turn": 0, "idle": 0, "overlap": 0, "left": 0}
_QUIET = {"idle": 0, "overlap": 0}

#: For each state its actions in the order in which they are tried: (action, next state, guard, changes). Fixed by the dialogue's
#: protocol; the start of speech comes last everywhere.
RULES: dict[str, list[Rule]] = {
    "greeting": [
        ("userInterruptsGreeting", "listening", lambda s, t, m: _goes_on(s, t), lambda s, t: {**_CLEAR, "draft": "none", "turn": t.elapsed}),
        ("greetingFinishes", "listening", lambda s, t, m: s.left == 0, lambda s, t: {**_CLEAR, "draft": "none"}),
        ("greetingPlays", "greeting", lambda s, t, m: s.left > 0 and not t.speaking, lambda s, t: {"left": _played(s, t)}),
    ],
    "listening": [
        ("userTurnEnds", "formulating", lambda s, t, m: t.ended, lambda s, t: {**_CLEAR, "draft": "building"}),
        ("reachTalkLimit", "deciding_interject", lambda s, t, m: _goes_on(s, t) and s.turn >= m.turn_ms, lambda s, t: _QUIET),
        ("userKeepsTalking", "listening", lambda s, t, m: _goes_on(s, t) and s.turn < m.turn_ms, lambda s, t: {**_QUIET, "turn": s.turn + t.elapsed}),
        ("idleHangup", "closing", lambda s, t, m: not t.speaking and s.idle >= m.idle_ms, lambda s, t: {"draft": "none", "turn": 0, "overlap": 0, "left": t.farewell_ms}),
        ("idleTicks", "listening", lambda s, t, m: not t.speaking and s.idle < m.idle_ms, lambda s, t: {"idle": s.idle + t.elapsed, "turn": 0, "overlap": 0}),
    ],
    "deciding_interject": [
        ("interjectDeclined", "listening", lambda s, t, m: t.interject is False, lambda s, t: _QUIET),
        ("interjectAccepted", "formulating", lambda s, t, m: t.interject is True, lambda s, t: {**_QUIET, "draft": "building", "left": 0}),
    ],
    "formulating": [
        ("draftAbandoned", "listening", lambda s, t, m: s.draft == "building" and _goes_on(s, t), lambda s, t: {**_QUIET, "draft": "dropped", "left": 0}),
        ("draftReady", "speaking", lambda s, t, m: s.draft == "building" and t.ready, lambda s, t: {**_QUIET, "draft": "voicing", "left": t.answer_ms}),
        ("formulatingWaits", "formulating", lambda s, t, m: s.draft == "building", lambda s, t: _QUIET),
    ],
    "speaking": [
        ("overlapTriggersDecision", "deciding_barge_in", lambda s, t, m: _goes_on(s, t) and s.overlap >= m.overlap_ms and s.left > m.tail_ms, lambda s, t: {"idle": 0}),
        ("finishTailThroughOverlap", "speaking", lambda s, t, m: _goes_on(s, t) and s.overlap >= m.overlap_ms and 0 < s.left <= m.tail_ms, lambda s, t: {"left": _played(s, t), "idle": 0}),
        ("overlapGrows", "speaking", lambda s, t, m: _goes_on(s, t) and s.left > 0 and s.overlap < m.overlap_ms, lambda s, t: {"overlap": s.overlap + t.elapsed, "idle": 0}),
        ("speechCompletes", "listening", lambda s, t, m: s.left == 0, lambda s, t: {**_CLEAR, "draft": "committed"}),
        ("speechPlays", "speaking", lambda s, t, m: s.left > 0 and not t.speaking, lambda s, t: {"left": _played(s, t), "turn": 0, **_QUIET}),
    ],
    "deciding_barge_in": [
        ("bargeInAccepted", "listening", lambda s, t, m: t.interrupt is True, lambda s, t: {**_QUIET, "draft": "committed", "left": 0}),
        ("bargeInDeclined", "speaking", lambda s, t, m: t.interrupt is False, lambda s, t: _QUIET),
    ],
    "closing": [
        ("closingInterrupted", "listening", lambda s, t, m: _goes_on(s, t), lambda s, t: {**_CLEAR, "draft": "none", "turn": t.elapsed}),
        ("closingCompletes", "ended", lambda s, t, m: s.left == 0 and not t.speaking, lambda s, t: {"turn": 0, "overlap": 0, "left": 0}),
        ("closingPlays", "closing", lambda s, t, m: s.left > 0, lambda s, t: {"left": _played(s, t), "overlap": 0}),
    ],
    "ended": [("ended", "ended", lambda s, t, m: True, lambda s, t: {})],
}
EDGES = [(state, action, after) for state, rules in RULES.items() for action, after, _, _ in rules] + [(s, "userStartsSpeaking", s) for s in RULES if s != "ended"]
INPUT = ("speaking", "elapsed", "ended", "ready", "answer_ms", "farewell_ms", "interject", "interrupt")
LOG = "session long, seq long, action string, prev string, state string, draft string, turn long, idle long, overlap long, speech_left long"


def step(s: Session, t: Tick, limits: Limits = Limits()) -> tuple[str | None, Session]:
    """(action, session after it) of one tick; None where no action applies."""
    for action, after, guard, change in RULES[s.agent]:
        if guard(s, t, limits):
            new = change(s, t).get
            return action, Session(after, new("draft", s.draft), new("turn", s.turn), new("idle", s.idle), new("overlap", s.overlap), new("left", s.left), t.speaking)
    if t.speaking and not s.spoke and s.agent != "ended":
        return "userStartsSpeaking", Session(s.agent, s.draft, s.turn, 0, 0, s.left, True)
    return None, Session(s.agent, s.draft, s.turn, s.idle, s.overlap, s.left, t.speaking)


def _rows(f: pd.DataFrame, names: tuple[str, ...]) -> Iterator[tuple]:
    return zip(*(f[k].astype(object).where(f[k].notna(), None).tolist() for k in names))


def fold(ticks: pd.DataFrame, s: Session, limits: Limits) -> tuple[list[tuple], Session]:
    out = []
    for session, seq, *values in _rows(ticks.sort_values("seq"), ("session", "seq", *INPUT)):
        action, after = step(s, Tick(*values), limits)
        out.append((session, seq, action, s.agent, after.agent, after.draft, after.turn, after.idle, after.overlap, after.left))
        s = after
    return out, s


def run_out(session: int, seq: int, s: Session, limits: Limits) -> list[tuple]:
    """The log of a session that stays silent: ticks of the idle limit without speech or decisions, as long as they change anything.
    One that listens hangs up, closes and ends."""
    out, silence = [], Tick(elapsed=limits.idle_ms, interject=False, interrupt=False)
    while s.agent != "ended":
        action, after = step(s, silence, limits)
        if after == s:
            break
        seq += 1
        out.append((session, seq, action, s.agent, after.agent, after.draft, after.turn, after.idle, after.overlap, after.left))
        s = after
    return out


def replay_sessions(ticks: DataFrame, limits: Limits = Limits(), greeting_ms: int = 0) -> DataFrame:
    """The log (LOG) of ticks (session, seq, and INPUT) of each session, in order; ticks without a session are one session.

    Sessions share partitions, sorted by (session, seq): a task reads batch after batch and holds the state of the session it is in,
    so many short sessions take no group each, and a long one is never in memory as a whole.
    """
    names = [c.split()[0] for c in LOG.split(", ")]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, s, begun = None, None, False
        for f in frames:
            out = []
            for session, seq, *values in _rows(f, ("session", "seq", *INPUT)):
                if not begun or session != current:
                    current, s, begun = session, Session(left=greeting_ms), True
                action, after = step(s, Tick(*values), limits)
                out.append((session, seq, action, s.agent, after.agent, after.draft, after.turn, after.idle, after.overlap, after.left))
                s = after
            yield pd.DataFrame(out, columns=names)

    dealt = ticks.select("session", "seq", *INPUT).repartition("session").sortWithinPartitions(F.col("session"), F.col("seq").asc_nulls_last())
    return dealt.mapInPandas(run, LOG)


def stream_replay(ticks: DataFrame, limits: Limits = Limits(), greeting_ms: int = 0) -> DataFrame:
    """replay_sessions of a stream of ticks with a time column ts and a watermark. A session without ticks for the idle limit times
    out: what silence makes of it is logged, for a listening one that it hangs up, closes and ends, and its state goes."""
    names = [c.split()[0] for c in LOG.split(", ")]

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        s, seq = (Session(*state.get[:7]), state.get[7]) if state.exists else (Session(left=greeting_ms), -1)
        if state.hasTimedOut:
            state.remove()
            yield pd.DataFrame(run_out(key[0], seq, s, limits), columns=names)
            return
        f = pd.concat(list(batches))
        out, s = fold(f, s, limits)
        state.update((s.agent, s.draft, int(s.turn), int(s.idle), int(s.overlap), int(s.left), bool(s.spoke), int(f["seq"].max())))
        latest = max(int(f["ts"].max().timestamp() * 1000), state.getCurrentWatermarkMs()) + limits.idle_ms
        state.setTimeoutTimestamp(latest)
        yield pd.DataFrame(out, columns=names)

    return ticks.groupBy("session").applyInPandasWithState(run, LOG, "agent string, draft string, turn long, idle long, overlap long, left long, spoke boolean, seq long", "append", GroupStateTimeout.EventTimeTimeout)


def check_transitions(log: DataFrame) -> DataFrame:
    """Rows of a log whose (state, action, next state) isn't allowed, or whose next row doesn't go on from its state."""
    edges = log.sparkSession.createDataFrame(EDGES, "e_prev string, e_action string, e_state string")
    fired = log.where("action is not null")
    bad = fired.join(F.broadcast(edges), (F.col("prev") == F.col("e_prev")) & (F.col("action") == F.col("e_action")) & (F.col("state") == F.col("e_state")), "left_anti").select("session", "seq", F.lit("edge").alias("fault"))
    after = F.lead("prev").over(Window.partitionBy("session").orderBy("seq"))
    return bad.unionByName(log.withColumn("after", after).where("after <> state").select("session", "seq", F.lit("break").alias("fault")))


def check_invariants(log: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """log with a column for each rule that must hold."""
    w = Window.partitionBy("session").orderBy("seq")
    last_draft, last_turn, last_overlap, last_left = (F.lag(c).over(w) for c in ("draft", "turn", "overlap", "speech_left"))
    return log.select(
        "*",
        (~((F.col("draft") == "committed") & (F.coalesce(last_draft, F.lit("")) == "dropped"))).alias("dropped_stays_uncommitted"),
        ((F.col("state") != "speaking") | (F.col("draft") == "voicing")).alias("speaking_has_draft"),
        ((F.col("state") != "deciding_barge_in") | (F.col("prev") == "deciding_barge_in") | ((last_overlap >= limits.overlap_ms) & (last_left > limits.tail_ms))).alias("barge_in_warranted"),
        ((F.col("action").isNull()) | (F.col("action") != "reachTalkLimit") | (last_turn >= limits.turn_ms)).alias("interject_after_limit"),
        ((F.col("prev") != "ended") | (F.col("state") == "ended")).alias("ended_is_final"),
    )
