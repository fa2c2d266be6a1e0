from __future__ import annotations

import random
from functools import lru_cache

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from lexifold.llm.token_counts import LIMIT, TOKENIZER, PreTokens, _unpack, _unsqueeze, count_tokens, deal_pieces, op11_token_counts, piece_lengths, pre_token_blocks

from .conftest import documents

SPACES = ["", " ", "  ", "\n", "\t ", "\x1c", "\x85", "\xa0 ", " \xa0", " ", "　 ", "᠎ ", "﻿"]
BITS = ["the", "I'll", "don't", "'S", "x1y2", "12", "½²", "٣٤Ⅷ", "é", "ßü", "日本語", "😀👩‍👩‍👧", "!!", "<|endoftext|>", "<|endoftext", "ͅa", "%%%", "ǅ"]


@lru_cache
def library(name):
    return Tokenizer.from_file(public_tokenizers.path(name))


def direct(text, name=TOKENIZER):
    return len(library(name).encode(text or "", add_special_tokens=False).ids)


def random_texts(n):
    rnd = random.Random(3)
    return ["".join(rnd.choice(BITS) + rnd.choice(SPACES) * rnd.randint(1, 3) for _ in range(rnd.randint(0, 40))) for _ in range(n)]


@pytest.mark.parametrize("name", [TOKENIZER, "word_bpe_49k.json"])
def test_counts_are_the_librarys(spark, odd_texts, name):
    texts = odd_texts + random_texts(200) + ["word " * 300_000, "x" * 100_000, " " * 3000 + "a"]
    got = {r.doc_id: (r.n_bytes, r.n_tokens) for r in count_tokens(documents(spark, texts), name).collect()}
    assert got == {i: (len((t or "").encode()), direct(t, name)) for i, t in enumerate(texts)}


def test_blocks_and_stretches_change_nothing(spark, monkeypatch):
    """Blocks and stretches so short that every text has several; run in this process, where the sizes can be set."""
    from lexifold.llm import token_counts

    monkeypatch.setattr(token_counts, "STRETCH", 7)
    reader = PreTokens(TOKENIZER)
    for text in random_texts(150):
        found, special = reader.units(text)
        assert sum(len(reader.model.tokenize(p)) * k for u, k in found.items() for p in reader.pre_tokens(u)) + special == direct(text)


@pytest.mark.parametrize("buckets", [1, 2, 64])
def test_all_of_a_pre_token_meet_in_one_bucket(spark, words, buckets):
    texts = [" ".join(words(80, i)) for i in range(40)]
    blocks = pre_token_blocks(documents(spark, texts).repartition(5))
    dealt = deal_pieces(blocks, buckets)
    of, whole = {}, {}
    for r in dealt.orderBy("block", "bucket").collect():
        whole.setdefault(r.block, []).extend(_unpack(r.pieces))
        for p in _unpack(r.pieces):
            assert of.setdefault(p, r.bucket) == r.bucket
    assert whole == {r.block: _unpack(r.pieces) for r in blocks.collect()} and len(whole) == 5
    sizes = {(r.block, r.bucket): _unsqueeze(r.lengths)[0].tolist() for r in piece_lengths(dealt, buckets).collect()}
    model = PreTokens(TOKENIZER).model
    assert sizes == {(r.block, r.bucket): [len(model.tokenize(p)) for p in _unpack(r.pieces)] for r in dealt.collect()}


def test_repeated_and_null_ids_clashing_names_and_empty_tables(spark):
    docs = documents(spark, ["one two", "three", None, "one two"], ids=[1, 1, None, None])
    docs = docs.selectExpr("*", "1 as block", "'x' as piece", "2 as pos", "3 as n", "4 as n_tokens")
    rows = sorted((r.doc_id or 0, r.n_bytes, r.n_tokens) for r in count_tokens(docs).collect())
    assert rows == sorted([(1, 7, direct("one two")), (1, 5, direct("three")), (0, 0, 0), (0, 7, direct("one two"))])
    assert count_tokens(documents(spark, [])).count() == 0


def test_query(spark, write, words):
    texts = [" ".join(words(600, 4)), "short", None]
    got = {r.doc_id: r for r in op11_token_counts(spark, write(documents=documents(spark, texts))).collect()}
    assert [got[i].n_tokens for i in range(3)] == [direct(t) for t in texts]
    assert [got[i].over_limit for i in range(3)] == [direct(t) > LIMIT for t in texts]
