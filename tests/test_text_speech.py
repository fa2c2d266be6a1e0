from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from lexifold.functions import speech, text


def one(spark, value, change, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(change(F.col("x")).alias("y")).first()["y"]


def test_normalising(spark):
    assert one(spark, " A \tB  ", text.norm_ws) == "a b" and one(spark, None, text.norm_ws) == ""
    assert one(spark, "Привет, мир2 a é bc", text.tokenize) == ["привет", "мир2", "bc"]
    assert one(spark, "﻿Ёлка,  да!", text.norm_transcript) == "елка да"


@pytest.mark.parametrize(
    ("line", "kind"),
    [("## x", "heading"), ("глава 1", "heading"), ("IV. part", "heading"), ("12 | 30", "heading"), ("1.2. text", "point"), ("1.2.", "heading"), ("ИТОГО 01.02.2020 ", "body"), ("(см. текст в прошлой", "noise"), ("  ", "blank"), ("plain", "body")],
)
def test_lines(spark, line, kind):
    assert one(spark, line, text.classify_line) == kind


def test_dates_markers_stamps(spark):
    d = one(spark, "Order 01_02_2020 (ред. от 03.04.2021) 05_06_2022.docx", text.filename_dates)
    assert (str(d.issued), str(d.revision)) == ("2020-02-01", "2021-04-03")
    assert one(spark, "none", text.filename_dates).issued is None and one(spark, "31_02_2020", text.filename_dates).issued is None
    assert one(spark, "[q]So  [pause:long] what [emp]?", text.strip_markers) == "So what?"
    assert [one(spark, v, text.fmt_ms, "long") for v in (0, 61_250, 61_350, 3_600_000)] == ["00:00.0", "01:01.2", "01:01.4", "60:00.0"]


def test_model_output(spark):
    v = one(spark, '{"chunks_score": 0.5, "answer_score": 0.9, "comment": "ok"}', text.parse_verdict)
    assert tuple(v) == (0.5, 0.9, "ok")
    v = one(spark, "so: {'chunks_score': 1, 'answer_score': 0.25, 'comment': 'it was {fine}'}", text.parse_verdict)
    assert tuple(v) == (1.0, 0.25, "it was {fine}")
    three = lambda c: text.parse_verdict(c, ("a", "b", "c"), "note")
    assert one(spark, '{"b": 2, "c": 3, "a": 1, "note": null}', three).asDict() == {"a": 1.0, "b": 2.0, "c": 3.0, "note": None}
    assert one(spark, "bad " * 100, text.parse_verdict).comment.startswith("[PARSE FAIL] bad") and one(spark, None, text.parse_verdict).answer_score is None
    assert one(spark, "<think>a\nb</think>\n c ", text.strip_think) == "c"
    assert [one(spark, v, text.sigmoid, "double") for v in (0.0, 1000.0, -1000.0, None)] == [0.5, 1.0, 0.0, 0.0]


@pytest.mark.parametrize(
    ("n", "cardinal", "genitive"),
    [(0, "ноль", "ноля"), (20, "двадцать", "двадцати"), (-5, "минус пять", "минус пяти"), (2011, "две тысячи одиннадцать", "двух тысяч одиннадцати"), (101_001, "сто одна тысяча один", "ста одной тысячи одного"), (2_000_000_021, "два миллиарда двадцать один", "двух миллиардов двадцати одного")],
)
def test_number_words(n, cardinal, genitive):
    assert speech.cardinal(n) == cardinal and speech.genitive_cardinal(n) == genitive


def test_ordinals():
    expect = {25: "двадцать пятого", 2026: "две тысячи двадцать шестого", 2000: "двухтысячного", 1000: "тысячного", 300: "трёхсотого", 1912: "одна тысяча девятьсот двенадцатого", 40: "сорокового", 0: "нулевого", 1900: "одна тысяча девятисотого"}
    assert {n: speech.ordinal_genitive(n) for n in expect} == expect


def test_spoken_text(spark):
    said = one(spark, "в 9:05 25 июля 2026 года не менее 20 баллов, минимум 3,5 и IELTS или XY", speech.normalize_speech)
    assert said == "в девять ноль пять двадцать пятого июля две тысячи двадцать шестого года не менее двадцати баллов, минимум три целых пять и айэлтс или икс-уай"
    assert speech.normalized(said) == said and one(spark, None, speech.normalize_speech) is None


def test_sentences_and_markup(spark):
    assert one(spark, "Дата 31.07 верна. См. стр. 5! Да?\nконец", speech.split_sentences) == ["Дата 31.07 верна.", "См. стр. 5!", "Да?", "конец"]
    assert one(spark, "Нет?!", speech.to_ssml) == '<speak><p><s><prosody pitch="x-high" rate="fast">Нет?!</prosody></s></p><break time="250ms"/></speak>'
    assert speech.marked_up("a [pause]b<[calm] c") == 'a <break time="400ms"/>b&lt;<prosody pitch="low" rate="slow"> c</prosody>'
    assert speech.marked_up("plain?") == "plain?"


def test_clips():
    assert speech.clip_facts([]) == (0.0,) * 5
    peak, clipped, mean, rms, rough = speech.clip_facts([1.0, -1.0] * 10)
    assert (peak, clipped, mean, rms) == (1.0, 100.0, 0.0, 1.0) and rough == pytest.approx(2.0)
    assert speech.clip_facts([0.5] * 10)[4] == 0.0
