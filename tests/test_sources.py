from __future__ import annotations

import io
import struct
import wave
import zipfile

import pytest
from pyspark.sql import functions as F

from lexifold.functions import models
from lexifold.sources import readers

W = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"


def office(paragraphs):
    body = "".join(paragraphs)
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="{W}"><w:body>{body}</w:body></w:document>')
    return out.getvalue()


def p(text, style=None):
    return f"<w:p>{f'<w:pPr><w:pStyle w:val={chr(34)}{style}{chr(34)}/></w:pPr>' if style else ''}<w:r><w:t>{text}</w:t></w:r></w:p>"


def test_office_documents(spark, tmp_path):
    cell = lambda t: f"<w:tc>{p(t)}</w:tc>"
    (tmp_path / "Order 01_02_2020.docx").write_bytes(office([p("Title", "Heading1"), p("a"), p(""), p(" "), p("b"), f"<w:tbl><w:tr>{cell(' x  y ')}{cell('x y')}{cell('z')}</w:tr></w:tbl>"]))
    (tmp_path / "broken.docx").write_bytes(b"not a zip")
    rows = {r.source: r for r in readers.extract_documents(spark, f"{tmp_path}/*.docx").collect()}
    good = rows["Order 01_02_2020.docx"]
    assert good.text == "## Title\na\n\nb\n\nx y | z\n" and (good.para_count, good.table_count, str(good.issued_date)) == (3, 1, "2020-02-01")
    assert rows["broken.docx"].error.startswith("BadZipFile") and readers.failures(readers.extract_documents(spark, f"{tmp_path}/*.docx")).count() == 1


def test_corpus_notes_json(spark, tmp_path):
    (tmp_path / "a.txt").write_text("## Head\n" + "x" * 60)
    (tmp_path / "b.txt").write_text("short")
    texts = readers.read_texts(spark, f"{tmp_path}/*.txt")
    manifest = spark.createDataFrame([("A", "a.txt"), ("B", "b.txt"), ("C", "c.txt"), ("D", None)], "source string, txt string")
    assert [(r.source, r.title) for r in readers.load_corpus(manifest, texts).collect()] == [("A", "Head")]
    (tmp_path / "INDEX.md").write_text("# no")
    (tmp_path / "n.md").write_text('---\nsources: ["N 7", "N 8"]\n---\n# The title\nbody')
    note = readers.read_notes(spark, f"{tmp_path}/*.md").collect()
    assert [(r.name, r.primary, r.title, r.text) for r in note] == [("n.md", "N 7", "The title", "\n# The title\nbody")]
    (tmp_path / "r.json").write_text('{"rows": [{"id": "1"},\n {"id": "2"}]}')
    assert [r.id for r in readers.read_json_rows(spark, f"{tmp_path}/r.json", "rows array<struct<id:string>>", False, "rows").collect()] == ["1", "2"]


def test_index_tables(spark, tmp_path):
    readers.write_index(f"{tmp_path}/ix", chunks=spark.range(3), stats=spark.range(2))
    with pytest.raises(FileNotFoundError, match="postings, terms, vectors"):
        readers.open_index(spark, f"{tmp_path}/ix")
    assert readers.open_index(spark, f"{tmp_path}/ix", ("chunks", "stats"))["chunks"].count() == 3


def test_sound(spark, tmp_path):
    def wav(channels, width, values):
        out = io.BytesIO()
        with wave.open(out, "wb") as w:
            w.setnchannels(channels), w.setsampwidth(width), w.setframerate(8000)
            w.writeframes(struct.pack(f"<{len(values)}{'h' if width == 2 else 'b'}", *values))
        return out.getvalue()

    df = spark.createDataFrame([(1, wav(1, 2, [5, -7])), (2, wav(2, 2, [5, 0, -5, 0])), (3, wav(1, 1, [1, 2])), (4, b"x")], "id int, b binary").select("id", readers.decode_wav(F.col("b")).alias("w"))
    got = {r.id: r.w for r in df.collect()}
    assert got[1].samples == [5, -7] and got[2].samples == [2, -2] and got[1].rate == 8000
    assert got[3].error == "8 bits, 1 channels" and got[4].error.startswith("not a sound file")
    frames = spark.createDataFrame([(struct.pack("<Ihh", 70000, -1, 32767),), (b"abc",), (struct.pack("<I", 4),)], "frame binary")
    rows = readers.decode_frames(frames, 1000).collect()
    assert (rows[0].offset_ms, rows[0].samples, rows[0].duration_ms) == (70000, [-1, 32767], 2) and rows[1].error == "short frame" and rows[2].samples == []
    pairs, alone = readers.pair_by_stem(spark.createDataFrame([("d/a.wav",), ("d/b.wav",)], "path string"), spark.createDataFrame([("t/a.txt", "hi")], "path string, text string"))
    assert [(r.stem, r.transcript) for r in pairs.collect()] == [("a", "hi")] and [r.path for r in alone.collect()] == ["d/b.wav"]


def test_models(spark):
    def model(prompt):
        if "bad" in prompt:
            raise ValueError("no")
        return prompt.upper()

    rows = {r.prompt: r for r in models.complete(spark.createDataFrame([("good",), ("bad",)], "prompt string"), "prompt", model).collect()}
    assert rows["good"].answer == "GOOD" and (rows["bad"].error, rows["bad"].tries, rows["bad"].answer) == ("ValueError: no", 2, None)
    frames = spark.createDataFrame([(1, i, [3000.0 * (i > 1)] * 300) for i in range(4)], "session int, seq int, samples array<double>")
    assert [round(r.prob, 2) for r in models.speech_probability(frames).orderBy("seq").collect()][:2] == [0.0, 0.0]
    models.register_table_functions(spark)
    assert spark.sql("SELECT count(*) AS n FROM split_sentences('One. Two! three')").first().n == 3


def test_json_lines_are_exported_whole(spark, tmp_path):
    rows = [(1, "a \"b\"\nc", ["x"]), (2, None, None), (3, "", [])]
    df = spark.createDataFrame(rows, "chunk_id long, text string, section_path array<string>")
    for _ in range(2):
        readers.export_jsonl(df.repartition(2), f"{tmp_path}/chunks")
    back = readers.read_json_rows(spark, f"{tmp_path}/chunks", "chunk_id long, text string, section_path array<string>")
    assert sorted((tuple(r) for r in back.collect()), key=lambda r: r[0]) == rows
    lines = [r.value for r in spark.read.text(f"{tmp_path}/chunks").collect()]
    assert len(lines) == 3 and any('"text":null' in x for x in lines)
