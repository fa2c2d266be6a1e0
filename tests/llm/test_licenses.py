from __future__ import annotations

import random
import re

from pyspark.sql import functions as F

from lexifold.llm import licenses
from lexifold.llm.licenses import TEMPLATES, Templates, differences, plain, scan

from .conftest import documents


def plain_words(text):
    return [w for w in map(plain, re.findall(r"[^\x20\x09-\x0D]+", text or "")) if w]


def plain_statements(text):
    """Licenses of the longest templates that a text has word for word, where none of these lies within a longer one."""
    have, found = plain_words(text), []
    for name, statement in TEMPLATES:
        w = plain_words(statement)
        found += [(i, i + len(w), name) for i in range(len(have) - len(w) + 1) if have[i : i + len(w)] == w]
    return {x[2] for x in found if not any(y[0] <= x[0] and x[1] <= y[1] and y[1] - y[0] > x[1] - x[0] for y in found)}


def test_statements_against_plain_search(spark, words, odd_texts):
    texts = list(odd_texts)
    for i, (_, statement) in enumerate(TEMPLATES):
        texts.append(" ".join(words(9 * i, i)) + " " + statement + " " + " ".join(words(70, i + 99)))
        texts.append(("".join(f" {w.upper()}!!" for w in statement.split()) + " end") * 2)
    texts += ["".join(words(9, 3)) + " license and permission of rights"] + [" ".join(words(200, 7))]
    docs = documents(spark, texts).withColumn("license", F.lit("clash")).withColumn("start", F.lit("clash"))
    got: dict[int, list] = {}
    for r in licenses.find_licenses(docs).collect():
        got.setdefault(r.doc_id, []).append(r)
    for i, t in enumerate(texts):
        assert {r.license for r in got.get(i, [])} == plain_statements(t), (i, (t or "")[:300])
        for r in got.get(i, []):
            assert r.missing == r.added == 0 and plain_words(t[r.start : r.end]) in [plain_words(s) for n, s in TEMPLATES if n == r.license] and 0 < r.saved < 1
    assert licenses.find_licenses(docs.limit(0)).count() == 0
    assert licenses.find_licenses(documents(spark, [TEMPLATES[4][1]] * 2, ids=[None, None])).count() == 2


def test_recall_of_edited_statements(words):
    """Of statements of 20 words or more, one word in twenty changed, dropped or added, nearly all are found under their name."""
    ready, r, found, tried = Templates(TEMPLATES), random.Random(2), 0, 0
    for name, statement in TEMPLATES:
        w = statement.split()
        if len(w) < 20:
            continue
        for seed in range(6):
            out = list(w)
            for _ in range(len(w) // 20):
                at = r.randrange(len(out))
                if any(c.isdigit() for c in out[at]):
                    continue
                out[at : at + 1] = r.choice([[], ["other"], [out[at], "more"]])
            names = [x[0] for x in scan(" ".join([*words(50, seed), *out, *words(50, seed + 1)]), ready)]
            tried, found = tried + 1, found + (names == [name])
    assert found >= 0.95 * tried > 100


def test_wording_tells_licenses_apart():
    ready = Templates(TEMPLATES)
    whole = {n: max((t for m, t in TEMPLATES if m == n), key=len) for n, _ in TEMPLATES}
    for name in ("MIT", "MIT-0", "BSD-2-Clause", "BSD-3-Clause", "BSD-4-Clause", "ISC", "0BSD", "Zlib", "Unlicense", "LGPL-2.1", "LGPL-3.0", "AGPL-3.0", "GPL-2.0", "GPL-3.0"):
        text = f"Copyright (c) 2020 Somebody and others\n\n{whole[name]}\n\nNext part."
        assert [x[0] for x in scan(text, ready)] == [name]
    assert [x[0] for x in scan("Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met.", ready)] == ["BSD family"]


def test_many_cues_take_steady_time():
    import time

    ready = Templates(TEMPLATES)
    began = time.process_time()
    assert scan("license permission rights reserved " * 5000, ready) == []
    assert len(scan("All rights reserved. Under the license. " * 3000, ready)) == 3000
    assert time.process_time() - began < 20


def test_differences_decide():
    ready = Templates(TEMPLATES)
    near = "so this program is free software: you can redistribute it and/or change it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License yes"
    (name, _, _, matched, missing, added, saved), *rest = scan(near, ready)
    assert (name, missing, added, rest) == ("GPL-3.0", 1, 1, []) and saved > 0.3
    assert [x[0] for x in scan("This work is licensed under the GNU General Public License, version 2.", ready)] == ["GPL-2.0"]
    assert scan("This work is licensed under the GNU General Public License, version 9.", ready) == []
    assert differences(["a", "b"], ["c"]) is None
