"""Operator 11: token counts from pre-token frequencies, each distinct pre-token tokenised once."""

from __future__ import annotations

import json
import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .common import lean, stash, table

TOKENIZER = "byte_bpe_50k.json"
LIMIT = 512
#: Code points of text in a block of documents, about; a longer text is a block of its own.
BLOCK = 4 << 20
#: Code points of a text that are taken apart at once, about.
STRETCH = 1 << 20
#: Bytes of the pre-tokens of all blocks that one task counts, about.
BUCKET = 8 << 20

#: White space that every table of characters agrees on, and what only some count as such.
_SURE, _ODD = r"\x20\x09-\x0D", r"\x1C-\x1F\x85\xA0\u1680\u180E\u2000-\u200A\u2028\u2029\u202F\u205F\u3000\uFEFF"
#: Pieces of text that end where a character that is surely no white space meets one that surely is.
_UNIT = re.compile(f"[{_SURE}{_ODD}]*[^{_SURE}{_ODD}]+(?:[{_ODD}][{_SURE}{_ODD}]*[^{_SURE}{_ODD}]*)*|[{_SURE}{_ODD}]+")
_BORDER = re.compile(f"[^{_SURE}{_ODD}](?=[{_SURE}])")

BLOCKS = "block long, doc_ids array<long>, n_bytes array<long>, pieces binary, room long, payload binary"
COUNTS = "doc_id long, n_bytes long, n_tokens long"


def _path(tokenizer: str) -> str:
    """A path as it is; a bare file name in the folder of vocabularies of the machine that asks."""
    if "/" in tokenizer:
        return tokenizer
    import public_tokenizers

    return public_tokenizers.path(tokenizer)


class PreTokens:
    """Takes texts apart as a tokenizers file does: special strings first, then pre-tokens, in the model's own alphabet."""

    def __init__(self, tokenizer: str) -> None:
        path = _path(tokenizer)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        added = spec["added_tokens"]
        if any(t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"] for t in added):
            raise ValueError(f"{path}: added tokens that take white space or stand for whole words aren't known")
        tok = Tokenizer.from_file(path)
        self.model, self._pre, self._norm = tok.model, tok.pre_tokenizer, tok.normalizer
        names = sorted((t["content"] for t in added), key=len, reverse=True)
        self._special = re.compile("|".join(map(re.escape, names))) if names else None
        pre = spec["pre_tokenizer"] or {}
        #: whether white space after another character always begins a new pre-token, so that units can be read one by one
        self._splits = spec["normalizer"] is None and pre.get("type") == "ByteLevel" and pre["use_regex"] and not pre["add_prefix_space"]

    def units(self, text: str) -> tuple[Counter, int]:
        """(frequencies of units, special tokens) of a text; pre-tokens of the text are those of its units."""
        found, special = Counter(), 0
        for i, part in enumerate(self._special.split(text) if self._special else [text]):
            special += i > 0
            if not self._splits:
                found.update([part] if part else [])
                continue
            at = 0
            while at < len(part):
                border = _BORDER.search(part, at + STRETCH) if len(part) - at > STRETCH else None
                end = border.end() if border else len(part)
                found.update(_UNIT.findall(part, at, end))
                at = end
        return found, special

    def pre_tokens(self, unit: str) -> list[str]:
        if self._norm:
            unit = self._norm.normalize_str(unit)
        return [p for p, _ in self._pre.pre_tokenize_str(unit)] if self._pre else [unit] if unit else []


def _squeeze(*arrays: np.ndarray) -> bytes:
    """Arrays of small numbers, each with its length, by byte planes."""
    parts = []
    for a in arrays:
        parts += [np.array([len(a)], "<u4").tobytes(), np.ascontiguousarray(a.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes()]
    return zstandard.compress(b"".join(parts), 3)


def _unsqueeze(data: bytes) -> list[np.ndarray]:
    raw, at, found = np.frombuffer(zstandard.decompress(data), np.uint8), 0, []
    while at < len(raw):
        n = int(raw[at : at + 4].view("<u4")[0])
        found.append(np.ascontiguousarray(raw[at + 4 : at + 4 + 4 * n].reshape(4, n).T).view("<u4").ravel().astype(np.int64))
        at += 4 + 4 * n
    return found


def _pack(pieces: list[str]) -> bytes:
    return zstandard.compress(json.dumps(pieces, ensure_ascii=False).encode("utf-8", "surrogatepass"), 3)


def _unpack(data: bytes) -> list[str]:
    return json.loads(zstandard.decompress(data).decode("utf-8", "surrogatepass"))


def _hashes(pieces: list[str]) -> np.ndarray:
    return pd.util.hash_array(np.array([*pieces, ""], object)[:-1], categorize=False)


class _Block:
    """Documents of one block: frequencies by numbers of units, which become frequencies by numbers of pre-tokens."""

    def __init__(self) -> None:
        self.ids: list[int | None] = []
        self.sizes: list[int] = []
        self.special: list[int] = []
        self.room = 0
        self._units: defaultdict[str, int] = defaultdict()
        self._units.default_factory = self._units.__len__
        self._of: list[np.ndarray] = []
        self._times: list[np.ndarray] = []

    def add(self, reader: PreTokens, doc_id: int | None, text: str) -> None:
        found, special = reader.units(text)
        self.ids.append(doc_id)
        self.sizes.append(len(text.encode("utf-8", "surrogatepass")))
        self.special.append(special)
        self.room += len(text)
        self._of.append(np.fromiter(map(self._units.__getitem__, found), np.int64, len(found)))
        self._times.append(np.fromiter(found.values(), np.int64, len(found)))

    def row(self, reader: PreTokens, block: int) -> tuple:
        pieces: defaultdict[str, int] = defaultdict()
        pieces.default_factory = pieces.__len__
        parts = [[pieces[p] for p in reader.pre_tokens(u)] for u in self._units]
        sizes = np.fromiter(map(len, parts), np.int64, len(parts))
        names = list(pieces)
        # pre-tokens are numbered in the order of their hashes, so those of a bucket stand together
        order = np.argsort(_hashes(names), kind="stable")
        number = np.empty(len(order), np.int64)
        number[order] = np.arange(len(order))
        flat = number[np.fromiter((p for part in parts for p in part), np.int64, int(sizes.sum()))]
        starts = np.cumsum(sizes) - sizes
        units, times = np.concatenate(self._of), np.concatenate(self._times)
        docs = np.repeat(np.arange(len(self.ids)), [len(x) for x in self._of])
        reps = sizes[units]
        at = np.arange(reps.sum()) - np.repeat(np.cumsum(reps) - reps, reps) + np.repeat(starts[units], reps)
        keys, inverse = np.unique(np.repeat(docs, reps) * max(len(pieces), 1) + flat[at], return_inverse=True)
        times = np.bincount(inverse, np.repeat(times, reps), len(keys)).astype(np.int64)
        doc, piece = np.divmod(keys, max(len(pieces), 1))
        steps = np.diff(piece, prepend=0)
        first = np.flatnonzero(np.diff(doc, prepend=-1))
        steps[first] = piece[first]
        payload = _squeeze(np.array(self.special), np.bincount(doc, minlength=len(self.ids)), steps, times)
        return block, self.ids, self.sizes, _pack([names[i] for i in order.tolist()]), sum(map(len, names)) + 8 * len(names), payload


def _frequencies(tokenizer: str):
    @lean
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        reader, block = PreTokens(tokenizer), _Block()
        number = TaskContext.get().partitionId() << 32
        names = [x.split()[0] for x in BLOCKS.split(", ")]
        for f in frames:
            for doc_id, text in zip(f["doc_id"].tolist(), f["text"].tolist()):
                block.add(reader, None if doc_id is None or doc_id != doc_id else int(doc_id), text or "")
                if block.room >= BLOCK:
                    yield pd.DataFrame([block.row(reader, number)], columns=names)
                    block, number = _Block(), number + 1
        if block.ids:
            yield pd.DataFrame([block.row(reader, number)], columns=names)

    return run


def pre_token_blocks(docs: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """Documents in blocks: the distinct pre-tokens of a block, and for each document which of them it has how often. A document's
    frequencies are numbers into its block's list, so no string is written for each document."""
    rows = docs.select(F.col("doc_id").cast("long").cast("string").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return stash(rows.mapInPandas(_frequencies(tokenizer), BLOCKS), "pre-tokens")


def deal_pieces(blocks: DataFrame, buckets: int) -> DataFrame:
    """(block, bucket, pieces): the pre-tokens of blocks by ranges of their hashes, a power of two many. A row holds all of a block's
    in a bucket, so there are never more rows than pre-tokens, and far fewer as long as blocks have many for each bucket."""
    bits = buckets.bit_length() - 1

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for block, data in zip(f["block"].tolist(), f["pieces"].tolist()):
                pieces = _unpack(data)
                of = (_hashes(pieces) >> np.uint64(63 - bits) >> np.uint64(1)).astype(np.int64)
                found, starts = np.unique(of, return_index=True)
                ends = [*starts[1:].tolist(), len(pieces)]
                yield pd.DataFrame({"block": block, "bucket": found, "pieces": [_pack(pieces[a:b]) for a, b in zip(starts.tolist(), ends)]})

    return blocks.select("block", "pieces").mapInPandas(run, "block long, bucket long, pieces binary")


def piece_lengths(dealt: DataFrame, buckets: int, tokenizer: str = TOKENIZER) -> DataFrame:
    """(block, bucket, lengths): how many tokens each pre-token has, counted once for each distinct one. All of a bucket's rows come to
    one task, bucket after bucket; it holds the distinct pre-tokens of one bucket at a time."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model, now, known = PreTokens(tokenizer).model, None, {}
        for f in frames:
            rows = []
            for block, bucket, data in zip(f["block"].tolist(), f["bucket"].tolist(), f["pieces"].tolist()):
                if bucket != now:
                    now, known = bucket, {}
                pieces = _unpack(data)
                for p in pieces:
                    if p not in known:
                        known[p] = len(model.tokenize(p))
                rows.append((block, bucket, _squeeze(np.array([known[p] for p in pieces]))))
            yield pd.DataFrame(rows, columns=["block", "bucket", "lengths"])

    return dealt.repartition(buckets, "bucket").sortWithinPartitions("bucket").mapInPandas(run, "block long, bucket long, lengths binary")


def _sums(lengths: pd.DataFrame, blocks: pd.DataFrame) -> pd.DataFrame:
    """Frequencies of a block times the lengths of its pre-tokens."""
    row = blocks.iloc[0]
    special, rows, steps, times = _unsqueeze(row["payload"])
    by_bucket = lengths.sort_values("bucket")["lengths"].tolist()
    known = np.concatenate([np.empty(0, np.int64), *(_unsqueeze(x)[0] for x in by_bucket)])
    total = np.concatenate([[0], np.cumsum(steps)])
    ends = np.cumsum(rows)
    begins = ends - rows
    # the first step of a document is a number of its own, so what came before it goes off
    tokens = np.concatenate([[0], np.cumsum(known[total[1:] - np.repeat(total[begins], rows)] * times)]).astype(np.int64)
    return pd.DataFrame({"doc_id": pd.array(list(row["doc_ids"]), "Int64"), "n_bytes": list(row["n_bytes"]), "n_tokens": tokens[ends] - tokens[begins] + special})


def count_tokens(docs: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """(doc_id, n_bytes, n_tokens) for every row of docs, as the tokenizers library counts its whole text without added tokens.

    tokenizer: a .json file, or the name of one in the folder of vocabularies. Special strings inside texts count as one token, the
    library's default. Lists of distinct pre-tokens of blocks go to the one task that counts each of them, and their lengths back to
    the block, to be joined with its documents' frequencies. A pre-token that all documents have comes once a block, so no bucket
    holds a share of the rows.

    Null and empty texts have no bytes and no tokens. Texts of any length are read whole, a stretch at a time; ids may be null or
    repeat, each row has its own count; an empty table gives no rows; other columns, whatever their names, aren't read.
    """
    blocks = pre_token_blocks(docs, tokenizer)
    room = blocks.agg(F.sum("room")).first()[0] or 0
    buckets = 1 << max(docs.sparkSession.sparkContext.defaultParallelism, room // BUCKET).bit_length()
    lengths = piece_lengths(deal_pieces(blocks, buckets), buckets, tokenizer)
    packed = blocks.select(F.col("block").alias("of"), "doc_ids", "n_bytes", "payload")
    return lengths.groupBy("block").cogroup(packed.groupBy("of")).applyInPandas(_sums, COUNTS)


def op11_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents")).withColumn("over_limit", F.col("n_tokens") > LIMIT)
