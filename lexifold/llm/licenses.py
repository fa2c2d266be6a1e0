"""Operator 5: license scans by conditional compression.

Windows of words around cue words are candidate blocks. Each is compressed plainly and with every template as raw dictionary; the
templates that save anything are held against the block word by word, those that save most first, and the one that explains most
words with the fewest differences names the license. Only templates most of whose words the block has at all are tried: others can't
be confirmed.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from difflib import SequenceMatcher
from functools import lru_cache

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .license_texts import TEMPLATES

#: Words that begin a search, in any case.
CUES = r"(?i)licen[cs]e|rights\W{1,4}reserved|permission|redistribut|public\W{1,4}domain|creative\W{1,4}commons"
#: Words of a block on either side of a cue, besides as many as the template has.
AROUND = 4
#: Least part of a template's words that a block must have.
KEPT = 0.9
#: Lower levels miss matches in blocks this short.
LEVEL = 19
FOUND = "doc_id long, license string, start long, end long, matched long, missing long, added long, saved double"

_CUE, _TOKEN = re.compile(CUES), re.compile(r"[^\x20\x09-\x0D]+")
_TRIM = re.compile(r"^[^\w]+|[^\w]+$")


def plain(word: str) -> str:
    return _TRIM.sub("", word).lower()


class Templates:
    """Compressors with each template as dictionary, its words, and how often it has each."""

    def __init__(self, templates: list[tuple[str, str]]):
        self.bare = zstandard.ZstdCompressor(level=LEVEL)
        self.each = []
        self.words: dict[str, int] = {}
        for name, text in templates:
            words = [w for w in map(plain, _TOKEN.findall(text)) if w]
            data = zstandard.ZstdCompressionDict(2 * (" ".join(words).encode() + b" "), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            self.each.append((name, words, Counter(words), zstandard.ZstdCompressor(level=LEVEL, dict_data=data), len(self.bare.compress(" ".join(words).encode()))))
            for w in words:
                self.words.setdefault(w, len(self.words))

    def plausible(self, words: list[str], cues: list[int]) -> list[list[int]]:
        """For each cue's place the templates whose block there has enough words that are any of the template's."""
        codes = np.array([self.words.get(w, -1) for w in words])
        out: list[list[int]] = [[] for _ in cues]
        at = np.array(cues, np.int64)
        for i, (_, template, _, _, _) in enumerate(self.each):
            own = np.zeros(len(self.words) + 1, bool)
            own[[self.words[w] for w in template]] = True
            upto = np.concatenate([[0], np.cumsum(own[codes])])
            reach = len(template) + AROUND
            have = upto[np.minimum(at + reach, len(words))] - upto[np.maximum(at - reach, 0)]
            for k in np.flatnonzero(have >= KEPT * len(template)).tolist():
                out[k].append(i)
        return out

    def ranked(self, words: list[str], at: int, tried: list[int]) -> list[tuple[float, str, list[str], int, int]]:
        """(part of the block saved, name, template, first, end) of the templates that save something of the block around a cue, those
        that save most of their own compressed size first; each template has a block of its own length."""
        found, sizes = [], {}
        for i in tried:
            name, template, counts, packer, own = self.each[i]
            low, high = max(0, at - len(template) - AROUND), min(len(words), at + len(template) + AROUND)
            have = Counter(words[low:high])
            # no alignment matches more words than both have in any order
            if sum(min(n, have[w]) for w, n in counts.items()) < KEPT * len(template):
                continue
            block = " ".join(words[low:high]).encode()
            if (low, high) not in sizes:
                sizes[low, high] = len(self.bare.compress(block))
            saved = sizes[low, high] - len(packer.compress(block))
            if saved > 0:
                found.append((saved / own, saved / sizes[low, high], name, template, low, high))
        return [x[1:] for x in sorted(found, key=lambda x: -x[0])]


@lru_cache(maxsize=2)
def _prepared(templates: tuple[tuple[str, str], ...]) -> Templates:
    return Templates(list(templates))


def differences(template: list[str], block: list[str]) -> tuple[int, int, int, int, int] | None:
    """(first, end, matched, missing, added) of the best stretch of a block for a template: places in the block, template words that
    it has and lacks, and other words within. None where too few match or a number differs.

    The longest run in common is the anchor; what stands before and after is aligned within the template's length of it.
    """
    matcher = SequenceMatcher(None, template, block, autojunk=False)
    a, b, n = matcher.find_longest_match()
    if not n:
        return None
    room = max(2, len(template) // 8)
    low, high = max(0, b - a - room), min(len(block), b + len(template) - a + room)
    runs = [(x, y + low, k) for x, y, k in SequenceMatcher(None, template, block[low:high], autojunk=False).get_matching_blocks() if k]
    matched = sum(k for _, _, k in runs)
    if matched < KEPT * len(template):
        return None
    here = set().union(*(range(x, x + k) for x, _, k in runs))
    if any(any(c.isdigit() for c in w) for i, w in enumerate(template) if i not in here):
        return None
    first, end = runs[0][1], runs[-1][1] + runs[-1][2]
    return first, end, matched, len(template) - matched, end - first - matched


def scan(text: str, templates: Templates) -> list[tuple]:
    """(license, start, end, matched, missing, added, saved) of each statement in a text; where stretches overlap, the one that matches
    most words less its differences, then has the fewest differences, then the greatest saving stays."""
    tokens = [(m.start(), m.end(), plain(m[0])) for m in _TOKEN.finditer(text)]
    tokens = [t for t in tokens if t[2]]
    if not tokens:
        return []
    starts, words = [t[0] for t in tokens], [t[2] for t in tokens]
    cues = list(dict.fromkeys(_place(starts, cue.start()) for cue in _CUE.finditer(text)))
    found: dict[tuple, tuple] = {}
    for at, tried in zip(cues, templates.plausible(words, cues)):
        for saved, name, template, low, high in templates.ranked(words, at, tried):
            while d := differences(template, words[low:high]):
                key = (low + d[0], low + d[1], name)
                row = (d[3] + d[4] - d[2], d[3] + d[4], -saved, *key, *d[2:])
                found[key] = min(row, found.get(key, row))
                if key[0] <= at < key[1]:
                    break
                # another copy of the statement nearby; the cue's own is on this side of it
                low, high = (key[1], high) if key[1] <= at else (low, key[0])
    taken: list[int] = []
    out: dict[int, tuple] = {}
    for row in sorted(found.values()):
        i = bisect_right(taken, row[3])
        if (not i or out[taken[i - 1]][1] <= row[3]) and (i == len(taken) or taken[i] >= row[4]):
            taken.insert(i, row[3])
            out[row[3]] = (row[3], row[4], row[5], *row[6:], -row[2])
    return [(name, tokens[a][0], tokens[b - 1][1], *rest) for a, b, name, *rest in sorted(out.values())]


def _place(starts: list[int], at: int) -> int:
    return max(0, bisect_right(starts, at) - 1)


def find_licenses(docs: DataFrame, templates: list[tuple[str, str]] = TEMPLATES) -> DataFrame:
    """FOUND: a row for each license statement in each row of docs, with its place in code points, the template's words that it has
    and lacks, other words within, and the part of the block's compressed size that the template saves.

    Null and empty texts and texts without cue words have none and don't leave the JVM; nothing is shuffled. Repeated rows are found
    each, null ids stay null, an empty table gives no rows. Every cue of a text of any length has its block.
    """
    fixed = tuple(templates)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ready = _prepared(fixed)
        for f in frames:
            rows = [(doc_id, *x) for doc_id, text in zip(f["doc_id"].astype("Int64"), f["text"]) for x in scan(text, ready)]
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in FOUND.split(", ")]).astype({"doc_id": "Int64"})

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text"))
    return texts.where(F.col("text").rlike(CUES)).mapInPandas(run, FOUND)


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_licenses(table(spark, sf_dir, "documents"))
