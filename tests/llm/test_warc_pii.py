from __future__ import annotations

import base64
import hashlib
import random
import re
from collections import Counter

from pyspark.sql import functions as F

from lexifold.llm import pii, warc

from .conftest import documents


def pages(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string")


def test_archive_round_trip(spark, words, monkeypatch):
    monkeypatch.setattr(warc, "FRAME", 2000)
    monkeypatch.setattr(warc, "BUNDLE", 9000)
    html = [" ".join(words(3 + i % 50, i % 17)) + "é😀" * (i % 3) for i in range(120)]
    rows = [(i * 3, f"http://h/{i}\r\n?q=a b", h) for i, h in enumerate(html)] + [(1000, None, None), (1001, "u", ""), (500, "long", "x" * 50_000), (None, "n", html[0]), (None, "m", "only here")]
    archive = warc.write_archive(pages(spark, rows).withColumn("digest", F.lit("clash")))
    got = warc.read_archive(archive).collect()
    first = {}
    for i, _, h in rows:
        if i is not None:
            first[h or ""] = min(i, first.get(h or "", i))
    expect = []
    for i, _, h in rows:
        raw, of = (h or "").encode(), first.get(h or "")
        repeat = of is not None and of != i
        expect.append((i, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "revisit" if repeat else "response", of if repeat else None))
    assert sorted(map(tuple, got), key=str) == sorted(expect, key=str)
    some = warc.read_pages(archive, spark.createDataFrame([(9,), (1000,), (77,)], "page_id long")).collect()
    assert sorted(r.page_id for r in some) == [9, 1000]
    assert warc.read_archive(warc.write_archive(pages(spark, []))).count() == 0


def test_frames_stand_alone():
    import zstandard

    packer = zstandard.ZstdCompressor()
    parts = [b"first" * 50, b"second" * 70]
    packed = [packer.compress(p) for p in parts]
    content = b"".join(packed) + warc.seek_table([(len(c), len(p)) for c, p in zip(packed, parts)])
    found = warc.frames_of(content)
    assert [zstandard.ZstdDecompressor().decompress(content[a : a + n]) for a, n in found] == parts
    # a plain reader passes over the table
    assert zstandard.ZstdDecompressor().decompressobj(read_across_frames=True).decompress(content) == b"".join(parts)


FORMS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def plain_spans(text):
    def luhn(d):
        total = 0
        for i, c in enumerate(reversed(d)):
            x = int(c) * (2 if i % 2 else 1)
            total += x - 9 * (x > 9)
        return total % 10 == 0

    out = []
    for kind, form in FORMS.items():
        for m in re.finditer(form, text or ""):
            d = re.sub("[^0-9]", "", m[0])
            fine = {"email": True, "ip": kind == "ip" and all(int(p) <= 255 for p in m[0].split(".")), "card": 13 <= len(d) <= 19 and luhn(d), "phone": 9 <= len(d) <= 15}[kind]
            out += [f"{kind}:{m.start()}:{m.end()}"] * fine
    return out


def test_forms_against_plain_search(spark, odd_texts, write):
    texts = odd_texts + [
        "a.b+c@x.y.z, q@w é 😀 m@n.o@p.q._x@d.e", "1.2.3.4.5.6.7.8 999.1.1.1 01.002.0003.255 1.2.3", "4111 1111 1111 1111 and 4111-1111-1111-1112 12 34", "+1 (988) 555-2485. +12 +4 9 +1234567890123456",
        "9" * 9000, "1 2" * 4000, "@" * 500 + "a@b.c", "a" * 9000, "+1" * 400, "tel +49.30.1234567, 10.0.0.256 10.0.0.25", "x@a-b.co--uk..x",
    ]
    docs = documents(spark, texts).withColumn("base", F.lit("clash")).withColumn("spans", F.lit("clash"))
    got = {r.doc_id: r for r in pii.op6_personal_data(spark, write(documents=docs)).collect()}
    for i, t in enumerate(texts):
        expect = plain_spans(t)
        assert got[i].base_sha256 == hashlib.sha256(",".join(expect).encode()).hexdigest(), t[:60]
        assert [got[i][f"n_{k}"] for k in FORMS] == [sum(e.startswith(k) for e in expect) for k in FORMS]
        assert set(expect) <= set(filter(None, got[i].spans.split(",")))


def plain_bootstrap(texts):
    """The spans of every text by dictionaries: the definition, once more."""
    kinds = list(FORMS)
    word = lambda w: re.sub("[0-9]", "0", re.sub(r"^[\W_]+|[\W_]+$", "", w.lower())) or None
    digits = lambda v: len(re.sub("[^0-9]", "", v))

    def fits(k, v):
        if kinds[k] == "email":
            return bool(re.fullmatch(r"[^@]+@[^@]+", v))
        if kinds[k] == "ip":
            return bool(re.fullmatch(r"[0-9]+(\.[0-9]+){3}", v))
        low, high = {"card": (11, 21), "phone": (7, 17)}[kinds[k]]
        return bool(re.fullmatch(r"[+(]?[0-9][0-9 ().+-]*", v)) and low <= digits(v) <= high

    rows, base = [], []
    for i, t in enumerate(texts):
        t = t or ""
        spans = [(kinds.index(k), int(a), int(b)) for k, a, b in (x.split(":") for x in plain_spans(t))]
        base.append(spans)
        for run, m in enumerate(re.finditer(r"(?<![^ \t-\r])[^ \t-\r]*[0-9@][^ \t-\r]*(?: [^ \t-\r]*[0-9@][^ \t-\r]*)*", t)):
            left = re.search(r"(?:^|[ \t-\r])([^ \t-\r]{1,64})[ \t-\r]+$", t[max(0, m.start() - 100) : m.start()])
            right = re.match(r"[ \t-\r]+([^ \t-\r]{1,64})(?:[ \t-\r]|$)", t[m.end() : m.end() + 100])
            # a word with digits or @ belongs to another run
            left, right = (word(x[1]) if x and not re.search("[0-9@]", x[1]) else None for x in (left, right))
            whole = m[0]
            parts = [(0, left, right, m.start(), whole)]
            if " " in whole:
                tail = whole.split(" ")[-1]
                parts += [(1, left, None, m.start(), whole.split(" ")[0]), (2, None, right, m.end() - len(tail), tail)]
            for part, before, after, at, v in parts:
                if part == 0 and len(v) > 100:
                    continue
                lead = re.match(r"[^\w+(]*|_*", v)[0]
                kept = re.sub(r"(?:(?!\))[\W_])+$", "", v[len(lead) :])
                if not re.search("[0-9@]", kept) or (before is None and after is None):
                    continue
                at += len(lead)
                over = sorted((s for s in spans if s[1] < at + len(kept) and s[2] > at), key=lambda s: s[1])
                if part and over:
                    continue
                head = over[0] if over and over[0][1] - at <= 1 else None
                last = over[-1] if over and at + len(kept) - over[-1][2] <= 1 else None
                both = head if len(over) == 1 and head and last else None
                for pattern, seed in ((f"<{before}" if before else None, head), (f"{after}>" if after else None, last), (f"<{before} {after}>" if before and after else None, both)):
                    if pattern and (not over or seed):
                        rows.append((i, run, part, at, at + len(kept), pattern, t[seed[1] : seed[2]] if seed else kept, seed[0] if seed else None))
    graph = {(p, v, k) for *_, p, v, k in rows}
    seeds = {(v, k) for _, v, k in graph if k is not None}
    names = {v for v, _ in seeds}
    unfit = Counter()
    for p, v, k in graph:
        if k is None:
            unfit.update((p, x) for x in range(4) if not fits(x, v))
    links = {(p, v) for p, v, _ in graph}
    trust, before = {x: 1.0 for x in seeds}, 0.0
    for _ in range(20):
        votes = Counter()
        for p, v in links:
            for k in range(4):
                votes[p, k] += trust.get((v, k), 0.0)
        sure = {}
        for p, k in votes:
            if votes[p, k]:
                sure[p, k] = votes[p, k] / (sum(votes[p, x] for x in range(4)) + unfit[p, k])
        sure = {x: s for x, s in sure.items() if s >= 0.4}
        trust = {x: 1.0 for x in seeds}
        doubt = {}
        for p, v, k in graph:
            if k is None and v not in names:
                for x in range(4):
                    if fits(x, v) and (p, x) in sure:
                        doubt[v, x] = doubt.get((v, x), 1.0) * (1 - min(sure[p, x], 0.999999))
        trust |= {x: 1 - d for x, d in doubt.items()}
        now = sum(trust.values())
        if abs(now - before) <= 0.001 * now:
            break
        before = now
    marks = {}
    for i, run, part, a, b, p, v, k in rows:
        if k is not None:
            continue
        for x in range(4):
            own = {w for q, w, y in graph if q == p and y == x}
            if sure.get((p, x), 0) >= 0.8 and len(own) >= 3 and fits(x, v) and min(map(digits, own)) - 2 <= digits(v) <= max(map(digits, own)) + 2:
                marks[i, run, part, a, b] = max(marks.get((i, run, part, a, b), (0, 0)), (sure[p, x], -x))
    out = [set(s) for s in base]
    for (i, run, part, a, b), (_, k) in marks.items():
        if part == 0 or not any((i, run, 0) == key[:3] for key in marks):
            out[i].add((-k, a, b))
    return [sorted(s) for s in out]


def test_bootstrapping_against_a_plain_one(spark, words, odd_texts):
    r = random.Random(3)
    number = lambda: f"({r.randint(200, 999)}) 555-{r.randint(1000, 9999)}"
    made = []
    for i in range(260):
        w = words(20, i)
        phones = [f"+1 {number()}", f"+1 {number()}", number(), f"0171 {i:03d} {r.randint(1000, 9999)}"]
        of = {
            "call": phones, "dial": phones, "phone": [*phones, str(i)], "mail:": [f"u{i}@mail.example.com", f"user{'abcdefgh'[i % 8]}@localhost"], "write to": [f"x{i}@y.org", f"q{i}@mx"],
            "the host": [f"10.0.{i % 256}.{i % 200}", f"10.0.{i}.999"], "card no": ["4111 1111 1111 1111", "5500-0000-0000-0004", "340000000000009", f"4111-1111-{1000 + i}-1111"], "from": [*phones, f"u{i}@mail.example.com", str(i)],
        }
        for _ in range(3):
            before = r.choice(list(of))
            w[r.randint(0, 19)] = f"{before} {r.choice(of[before])}{r.choice(['', '.', ', now', ' soon', ' please'])}"
        made.append(" ".join(w))
    texts = odd_texts + made + ["call 12 +1 (988) 555-2485 3 soon", "call " + "9 " * 200 + "soon", "(call) <x@y> mail: x@y, soon"]
    got = {r.doc_id: [(s.kind, s.start, s.end) for s in r.spans] for r in pii.find_personal_data(documents(spark, texts)).collect()}
    expect = plain_bootstrap(texts)
    assert {i: x for i, x in enumerate(expect) if x != got[i]} == {}
    assert sum(map(len, expect)) > sum(len(plain_spans(t)) for t in texts)


def test_three_seeds_are_enough(spark):
    texts = [f"dial +1 (98{i}) 555-248{i} soon" for i in range(3)] + ["dial 988 555 7777 soon", "dial now"]
    texts += [f"contact u{i}@x.org or" for i in range(3)] + ["contact name@localhost or", "contact us@ or"]
    out = {r.doc_id: r for r in pii.find_personal_data(documents(spark, texts)).collect()}
    assert [(s.kind, s.value) for s in out[3].spans] == [(3, "988 555 7777")]
    assert [(s.kind, s.value) for s in out[8].spans] == [(0, "name@localhost")]
    plain = {i: x for i, x in enumerate(plain_bootstrap(texts))}
    assert all([(s.kind, s.start, s.end) for s in out[i].spans] == plain[i] for i in plain)
    # one that can't be a phone number in four is too many, and so are two seeds
    assert pii.find_personal_data(documents(spark, [*texts[:4], "dial 7 soon"])).where("base <> spans").count() == 0
    assert pii.find_personal_data(documents(spark, texts[1:4])).where("base <> spans").count() == 0


def test_many_numbers_take_steady_time(spark):
    import time

    docs = documents(spark, [" ".join(str(i % 977) for i in range(250_000)), "\n".join(f"x {i}" for i in range(60_000))])
    began = time.time()
    assert pii.find_personal_data(docs).selectExpr("sum(size(spans))").first()[0] == 0
    assert time.time() - began < 90


def test_patterns_discover_identifiers(spark):
    texts = [f"please call +1 (9{i:02d}) 555-24{i:02d} now" for i in range(20)] + ["please call 988-555-7777 now", "room 988-555-7777 too", "call 12 now", "we saw 44 and 55"]
    out = {r.doc_id: r for r in pii.find_personal_data(documents(spark, texts)).collect()}
    assert [(s.kind, s.value) for s in out[20].spans] == [(3, "988-555-7777")] and not out[20].base
    assert texts[20][out[20].spans[0].start : out[20].spans[0].end] == "988-555-7777"
    assert not out[22].spans and not out[23].spans and len(out[0].spans) == 1
    assert pii.find_personal_data(documents(spark, ["x"]).limit(0)).count() == 0
