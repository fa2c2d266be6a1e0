from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from lexifold.operators import conversation as c
from lexifold.operators import scenarios as r
from lexifold.operators import stats
from lexifold.streaming import automaton as a
from lexifold.streaming import frames as f

TURN = "session int, seq int, role string, text string, start_ms long, end_ms long"


def speech(spark, probs, start=0, agent=None):
    return spark.createDataFrame([(1, i, start + 100 * i, 100, float(p), bool(agent[i]) if agent else False) for i, p in enumerate(probs)], "session int, seq int, at_ms long, duration_ms int, prob double, agent boolean")


@pytest.mark.parametrize(
    ("probs", "start", "expect"),
    [([1, 1, 0, 1, 1], 0, [(0, None)]), ([1, 1, 0, 0, 0, 0, 0], 0, [(0, 200)]), ([1], 1000, [(800, None)]), ([0, 0], 0, []), ([1, 0, 0, 0, 0, 0, 1, 0], 0, [(0, 100), (400, None)])],
)
def test_segments(spark, probs, start, expect):
    assert [(x.start_ms, x.end_ms) for x in f.speech_segments(speech(spark, probs, start)).orderBy("segment").collect()] == expect


def streamed(spark, tmp_path, name, parts, make):
    """What a stream of parts, one after the other, and a last row of a much later time gives."""
    end = parts[0].limit(1).withColumn("session", F.lit(-1).cast(parts[0].schema["session"].dataType)).withColumn("ts", F.lit("2100-01-01").cast("timestamp"))
    for part in [*parts, end]:
        part.coalesce(1).write.mode("append").parquet(str(tmp_path / name))
    stream = spark.readStream.schema(parts[0].schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / name)).withWatermark("ts", "1 second")
    made = make(stream)
    made.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / f"{name}-state")).trigger(availableNow=True).start(str(tmp_path / f"{name}-out")).awaitTermination()
    return spark.read.schema(made.schema).parquet(str(tmp_path / f"{name}-out")).where("session <> -1")


def timed(rows):
    return rows.withColumn("ts", F.timestamp_millis(F.col("at_ms") + 86_400_000))


def test_streams_are_their_batches(spark, tmp_path):
    """Row by row; sessions that end while they speak included."""
    rows = timed(speech(spark, [int(i % 11 < 4) for i in range(60)]).unionByName(speech(spark, [1, 0, 1, 1]).withColumn("session", F.lit(2))))
    parts = [rows.where(f"seq >= {20 * k} and seq < {20 * k + 20}") for k in range(3)]
    got = streamed(spark, tmp_path, "segments", parts, f.stream_segments)
    expect = f.speech_segments(rows).select("session", "segment", "start_ms", "end_ms")
    assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, expect.collect()), key=str) and got.where("end_ms is null").count() == 2
    got = streamed(spark, tmp_path, "thin", parts, lambda x: f.stream_thin(x.select("session", "at_ms", "ts"), 250))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, f.thin_events(rows.select("session", "at_ms"), 250).collect()))


def test_stream_of_ticks_is_the_replay_and_hangs_up(spark, tmp_path):
    limits = a.Limits(turn_ms=300, idle_ms=400, overlap_ms=100, tail_ms=300)
    n = F.col("seq")
    rows = timed(speech(spark, [int(i % 7 < 3) for i in range(40)]).unionByName(speech(spark, [0, 1, 0, 0]).withColumn("session", F.lit(2))))
    ticks = rows.select(
        F.col("session").cast("long").alias("session"), n.cast("long").alias("seq"), (F.col("prob") >= 0.5).alias("speaking"), F.lit(100).alias("elapsed"), (n % 4 == 3).alias("ended"), (n % 5 == 1).alias("ready"), F.lit(2500).alias("answer_ms"),
        F.lit(900).alias("farewell_ms"), F.when(n % 3 > 0, n % 2 == 0).alias("interject"), (n % 3 == 0).alias("interrupt"), "ts",
    )
    got = streamed(spark, tmp_path, "ticks", [ticks.where("seq < 17"), ticks.where("seq >= 17")], lambda x: a.stream_replay(x, limits, 200))
    batch = sorted(map(tuple, a.replay_sessions(ticks, limits, 200).collect()), key=str)
    last = {r[0]: max(x[1] for x in batch if x[0] == r[0]) for r in batch}
    log = got.orderBy("session", "seq").collect()
    assert sorted((tuple(r) for r in log if r.seq <= last[r.session]), key=str) == batch
    after = [r for r in log if r.seq > last[r.session]]
    assert after and a.check_transitions(got).count() == 0
    quiet = a.Session(agent="listening", left=0)
    assert [x[2:5] for x in a.run_out(1, 5, quiet, limits)] == [("idleTicks", "listening", "listening"), ("idleHangup", "listening", "closing"), ("closingCompletes", "closing", "ended")]
    assert a.run_out(1, 5, a.Session(agent="ended"), limits) == []


def test_overlap_fires_once_at_the_fourth_frame(spark):
    got = f.overlap_episodes(speech(spark, [1] * 9, agent=[1] * 9), 300).collect()
    assert [(x.at_ms, x.duration_ms) for x in got] == [(300, 300)]
    again = f.overlap_episodes(speech(spark, [1] * 12, agent=[1] * 5 + [0] * 2 + [1] * 5), 300).collect()
    assert sorted(x.at_ms for x in again) == [300, 900]


def test_ring_slices_thinning_ticks(spark):
    fr = speech(spark, [0, 1, 1, 0, 1, 0, 0, 0, 0, 0])
    asked = spark.createDataFrame([(1, 1, 150, 350), (1, 2, 0, 100), (1, 3, 880, 9000)], "session int, request int, from_ms long, to_ms long")
    assert {x.request: x.frames for x in f.slice_frames(fr, asked, 600, 200).collect()} == {1: [], 2: [], 3: [8, 9]}
    assert {x.request: x.frames for x in f.slice_frames(fr, asked).collect()}[1] == [1, 2, 3]
    assert [x.at_ms for x in f.thin_events(fr.select("session", "at_ms"), 250).orderBy("at_ms").collect()] == [0, 300, 600, 900]
    assert [(x.seq, x.part, x.elapsed_ms) for x in f.to_ticks(fr).where("speaking").orderBy("seq", "part").collect()] == [(1, 0, 0), (1, 1, 100), (2, 0, 100), (4, 0, 0), (4, 1, 100)]


def test_turn_overlaps(spark):
    t = spark.createDataFrame([(1, 1, "agent", "A", 0, 10_000), (1, 2, "user", "B", 1000, 2000), (1, 3, "user", "C", 3000, 4000), (1, 4, "user", "D", 10_000, 11_000)], TURN)
    assert [x.overlaps for x in c.flag_overlaps(t).orderBy("seq").collect()] == [False, True, True, False]
    assert c.render_history(t, 2).first().history == "[00:03.0–00:04.0] user: C\n[00:10.0–00:11.0] user: D"
    assert c.render_history(t, 4).first().history.split("\n")[1] == "[00:01.0–00:02.0] user: (поверх) B"


def test_commits_partials_tails_asof(spark):
    done, rejected = c.commit_turns(spark.createDataFrame([(1, 0, 7500, 7500), (2, 0, 3000, 7500), (3, 0, 0, 100), (4, 0, 200, 100), (5, 0, None, 9)], "seq int, start_ms long, delivered_ms long, planned_ms long"))
    assert [(x.seq, x.voiced_fraction, x.is_partial) for x in done.orderBy("seq").collect()] == [(1, 1.0, False), (2, 0.4, True), (4, 1.0, False)]
    assert [x.seq for x in rejected.orderBy("seq").collect()] == [3, 5]
    p = spark.createDataFrame([(1, 1, 1, "so"), (1, 1, 2, "so it"), (1, 1, 3, "else")], "session int, segment int, seq int, text string")
    assert [x.added for x in c.partial_suffix(p).orderBy("seq").collect()] == ["so", " it", " else"]
    tail = c.rolling_tail(spark.createDataFrame([(1, i, t) for i, t in enumerate(["abc", "", "defgh", "i"])], "session int, seq int, text string"), 5)
    assert [x.tail for x in tail.orderBy("seq").collect()] == ["abc", "abc", "defgh", "efghi"]
    outcomes = spark.createDataFrame([(1, "k", 5), (1, "k", 10), (1, "m", 10)], "session int, kind string, at_ms long")
    decisions = spark.createDataFrame([(1, "k", 5, "a"), (1, "k", 9, "b")], "session int, kind string, at_ms long, result string")
    assert [x.decision and x.decision.result for x in c.last_decision_asof(outcomes, decisions).orderBy("kind", "at_ms").collect()] == ["a", "b", None]


def walk(ticks, s=None, limits=a.Limits()):
    s, out = s or a.Session(), []
    for t in ticks:
        action, s = a.step(s, t, limits)
        out.append(action)
    return out, s


def test_automaton_paths():
    talk, quiet = a.Tick(speaking=True, elapsed=100), a.Tick(elapsed=100)
    out, s = walk([talk, talk], a.Session(left=5000))
    assert out == ["userStartsSpeaking", "userInterruptsGreeting"] and s.agent == "listening" and s.turn == 100
    out, s = walk([a.Tick(speaking=True, elapsed=100, interject=False), talk], a.Session("deciding_interject", turn=20_000, spoke=True))
    assert out == ["interjectDeclined", "reachTalkLimit"] and s.turn == 20_000
    out, s = walk([talk] * 15, a.Session("speaking", "voicing", left=1400, spoke=True))
    assert "overlapTriggersDecision" not in out and "finishTailThroughOverlap" in out
    out, s = walk([talk] * 11 + [a.Tick(True, 100, interrupt=True)], a.Session("speaking", "voicing", left=9000, spoke=True))
    assert out[-2:] == ["overlapTriggersDecision", "bargeInAccepted"] and (s.agent, s.draft) == ("listening", "committed")
    out, s = walk([a.Tick(elapsed=10_000), a.Tick(elapsed=100, farewell_ms=500), quiet, talk, talk], a.Session("listening"))
    assert out == ["idleTicks", "idleHangup", "closingPlays", "closingPlays", "closingInterrupted"] and s.agent == "listening"
    out, s = walk([a.Tick(ready=True, answer_ms=100), quiet, quiet, quiet], a.Session("formulating", "building"))
    assert out == ["draftReady", "speechPlays", "speechCompletes", "idleTicks"]
    assert walk([quiet, talk, talk], a.Session("ended"))[0] == ["ended"] * 3


def test_log_checks(spark):
    row = lambda q, action, prev, state: (1, q, action, prev, state, "none", 0, 0, 0, 0)
    log = spark.createDataFrame([row(1, "greetingFinishes", "greeting", "listening"), row(2, "idleTicks", "listening", "listening"), row(3, "draftReady", "listening", "speaking"), row(4, "ended", "ended", "ended")], a.LOG)
    assert sorted((x.seq, x.fault) for x in a.check_transitions(log).collect()) == [(3, "break"), (3, "edge")]
    assert [x.speaking_has_draft for x in a.check_invariants(log).orderBy("seq").collect()] == [True, True, False, True]


def test_rules(spark):
    schema = "n int, state string, intent string, confidence double, rag_count int, rag_max_score double, interject_accepted boolean, bargein_accepted boolean, transcript string, error_type string"
    x = spark.createDataFrame([(1, "s", "bye", 0.7, None, None, None, None, "t", None), (2, "s", "bye", 0.69, None, None, None, None, " ", None), (3, "s", None, None, 0, 0.1, None, None, "t", "timeout"), (4, "z", "bye", 0.9, None, None, None, None, "t", None)], schema)
    rules = [r.Scenario("first", ("s",), {"all": [{"intent": "bye"}, {"confidence_at_least": 0.7}]}, 1), r.Scenario("tie", ("s",), {"intent": "bye"}, 1), r.Scenario("error", ("s",), {"error_type": "timeout"}, 9), r.Scenario("none", ("s",), {"not": {"rag_max_score_below": 0.5}}, 5)]
    assert [v.scenario for v in r.match_scenarios(x, rules[:3]).orderBy("n").collect()] == ["first", "tie", "error", None]
    assert [v.scenario for v in r.match_scenarios(x, rules).orderBy("n").collect()] == ["none", "none", "error", None]
    assert r.match_scenarios(x, []).where("scenario is null").count() == 4
    shadowed = r.shadowed_rules(spark, [r.Scenario("open", ("s",), None, 3), r.Scenario("low", ("s", "t"), {"intent": "x"}, 1)])
    assert [(v.state, v.name) for v in shadowed.collect()] == [("s", "low")]


def test_statistics_of_small_groups(spark):
    df = spark.createDataFrame([("a", 5, 1, 0.5), ("b", 5, 1, 0.1), ("b", 5, 2, None)], "backend string, top_k int, id int, score double")
    assert {x.backend: (x.n, x.se) for x in stats.mean_se(df, ["backend"], "score").collect()} == {"a": (1, 0.0), "b": (1, 0.0)}
    one = stats.paired_compare(df, stats.comparison_battery(spark, {"backend": ["a", "b"]}), "score").first()
    assert (one.n, one["mean"], one.t, one.significant) == (1, None, None, False)
    ms = spark.createDataFrame([("x", float(i)) for i in range(1, 11)] + [("y", 3.0)], "g string, ms double")
    for rule, expect in (("clamped", {"x": 10.0, "y": 3.0}), ("before", {"x": 9.0, "y": 3.0}), ("plain", {"x": 10.0, "y": 3.0})):
        assert {v.g: v.percentile for v in stats.latency_summary(ms, ["g"], "ms", 0.9, rule).collect()} == expect
