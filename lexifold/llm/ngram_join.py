"""Operator 9: exact n-gram Jaccard join with a token-group matrix.

1. Equal shingle sets become one class each. Shingles are dealt by ranges of their hash, and every class learns how many of its
   shingles any other class has: a first bound, against the union of all other documents. A class that shares under 75% can
   link with nothing and goes no further; only the texts of the rest are fetched.
2. The rest are put into groups of similar documents (stars around leaders that they link with), in blocks of bounded size.
3. The matrix has a row for each shingle and group, from the members' prefixes: of n shingles in a fixed order, common ones
   last, the first n - ceil(0.75 n) + 1. Documents that link have a common shingle in both prefixes, so only groups with a
   common shingle are compared, and of these only pairs that aren't known to be connected.
4. A query document opens a group only if it shares at least 75% of its shingles with the group's token union; then it is
   compared with the members exactly. Links and stars give the components.
5. For the number of links all pairs inside a component that fit in size are compared exactly: its members go in blocks by size,
   each pair of blocks is a group of its own, and common shingles are counted for all pairs of two blocks at once.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import lean, stash, table
from .components import components
from .decontamination import SETS_SQL
from .packing import pack, squeeze, unpack, unsqueeze
from .textkit import mix64, shingle_sets

#: Two documents link when NUMERATOR * union <= DENOMINATOR * intersection.
NUMERATOR, DENOMINATOR = 75, 100
#: Bits of a shingle's hash that the first bound uses (equal bits only weaken it), and that sets keep.
BOUND_BITS, SET_BITS = 40, 48
#: Shingles dealt to one range.
RANGE = 1 << 20
#: A shingle in more than COMMON classes may be ordered last; the STOP most frequent are (2 MB of broadcast at most).
COMMON, STOP = 16, 1 << 18
#: Partitions that ranges are dealt to at most.
MOST_PARTS = 1 << 15
#: Documents in a block of a group, and stars in one key's group before the rest stand alone.
BLOCK, LEADERS = 32, 8
#: Hashes whose smallest values are the keys of groups.
KEYS = (0, 0x2545F4914F6CDD1D, 0x5851F42D4C957F2D)
#: Members of a component in a block when links are counted, beside RANGE shingles; columns of a product of incidence matrices.
MEMBERS, COLUMNS = 512, 2048
#: Documents of one key that are compared in one place, about; more are dealt to several by another hash.
SALT = 512


def links(inter, na, nb):
    return DENOMINATOR * inter >= NUMERATOR * (na + nb - inter)


def prefix_length(n: int) -> int:
    return n - -(-NUMERATOR * n // DENOMINATOR) + 1


def signature(s: np.ndarray) -> tuple[int, int]:
    """Two 64-bit numbers of a set."""
    with np.errstate(over="ignore"):
        return tuple(int(x) for x in np.array([mix64(s ^ np.uint64(c)).sum(dtype=np.uint64) for c in (0x51A7, 0xC0FFEE)]).view(np.int64))


def overlap(a: np.ndarray, b: np.ndarray) -> int:
    """Common values of two sorted sets."""
    if len(a) > len(b):
        a, b = b, a
    if not len(a):
        return 0
    return int((b[np.minimum(np.searchsorted(b, a), len(b) - 1)] == a).sum())


def _prints(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for f in frames:
        rows = [(len(s), *signature(s)) for s in shingle_sets(f["text"])]
        out = pd.DataFrame(rows, columns=["n", "sig_a", "sig_b"])
        out.insert(0, "doc_id", f["doc_id"].astype("Int64").values)
        yield out


def _deal(frames: Iterator[pd.DataFrame], ranges: int) -> Iterator[pd.DataFrame]:
    """Shingles of each class, once for a task, by range: their bits, the class of each (by place), and the classes."""
    seen: set[tuple[int, int]] = set()

    def flush(held):
        classes = np.array([c for c, _ in held], np.int64)
        tokens = np.concatenate([s for _, s in held]) >> np.uint64(64 - BOUND_BITS)
        owner = np.repeat(np.arange(len(held)), [len(s) for _, s in held])
        order = np.argsort(tokens, kind="stable")
        tokens, owner = tokens[order], owner[order]
        cuts = np.searchsorted(tokens, np.array([(r << BOUND_BITS) // ranges for r in range(ranges + 1)], np.uint64))
        rows = []
        for r, (a, b) in enumerate(zip(cuts[:-1].tolist(), cuts[1:].tolist())):
            if b > a:
                used, place = np.unique(owner[a:b], return_inverse=True)
                rows.append((r, squeeze(tokens[a:b], BOUND_BITS // 8), squeeze(place, 3), classes[used].tobytes()))
        return pd.DataFrame(rows, columns=["range", "tokens", "places", "classes"])

    held, size = [], 0
    for f in frames:
        for s in shingle_sets(f["text"]):
            sig = signature(s)
            if not len(s) or sig in seen:
                continue
            seen.add(sig)
            held.append((sig[0], s))
            size += len(s)
            if size >= RANGE:
                yield flush(held)
                held, size = [], 0
    if held:
        yield flush(held)


def _shared(f: pd.DataFrame, ranges: int):
    """Of one range: how many shingles of each class another class has (by bucket of classes), and the common shingles."""
    tokens = np.concatenate([unsqueeze(t, BOUND_BITS // 8) for t in f["tokens"]])
    classes = np.concatenate([np.frombuffer(c, np.int64)[unsqueeze(p, 3).astype(np.int64)] for p, c in zip(f["places"], f["classes"])])
    order = np.argsort(tokens, kind="stable")
    tokens, classes = tokens[order], classes[order]
    start = np.flatnonzero(np.diff(tokens, prepend=~tokens[:1]))
    length = np.diff(start, append=len(tokens))
    several = np.minimum.reduceat(classes, start) != np.maximum.reduceat(classes, start)
    hot = length > COMMON
    rows = [(-1, tokens[start[hot]].astype(np.int64).tolist(), length[hot].tolist(), None, None)]
    keep = np.repeat(several, length)
    tokens, classes = tokens[keep], classes[keep]
    order = np.lexsort((tokens, classes))
    tokens, classes = tokens[order], classes[order]
    new = np.ones(len(tokens), bool)
    new[1:] = (tokens[1:] != tokens[:-1]) | (classes[1:] != classes[:-1])
    found, count = np.unique(classes[new], return_counts=True)
    bucket = (mix64(found.astype(np.uint64)) % np.uint64(ranges)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    found, count, bucket = found[order], count[order], bucket[order]
    cuts = np.searchsorted(bucket, np.arange(ranges + 1))
    rows += [(b, None, None, found[x:y].tobytes(), count[x:y].astype(np.int32).tobytes()) for b, (x, y) in enumerate(zip(cuts[:-1].tolist(), cuts[1:].tolist())) if y > x]
    return pd.DataFrame(rows, columns=["bucket", "tokens", "n", "classes", "counts"])


def _summed(f: pd.DataFrame) -> pd.DataFrame:
    classes = np.frombuffer(b"".join(f["classes"]), np.int64)
    counts = np.frombuffer(b"".join(f["counts"]), np.int32)
    found, place = np.unique(classes, return_inverse=True)
    return pd.DataFrame({"sig": found, "shared": np.bincount(place, counts, len(found)).astype(np.int64)})


def _sets(frames: Iterator[pd.DataFrame], common) -> Iterator[pd.DataFrame]:
    """Sets of texts with the prefix in the order (common, hash), and with three keys, each the smallest of the set under a hash
    of its own, and in how many classes the first one is, as far as it is known."""
    stop, stop_n = common.value
    for f in frames:
        rows = []
        for doc_id, s in zip(f["doc_id"].tolist(), shingle_sets(f["text"])):
            if not len(s):  # a row without words of an id that has others
                continue
            short = s >> np.uint64(64 - BOUND_BITS)
            at = np.minimum(np.searchsorted(stop, short), max(len(stop) - 1, 0))
            last = stop[at] == short if len(stop) else np.zeros(len(s), bool)
            sig, keys = signature(s)[0], []
            for i, seed in enumerate(KEYS):
                first = int(np.argmin(mix64(s ^ np.uint64(seed)))) if i else 0
                keys.append(int(s[first : first + 1].view(np.int64)[0]))
            many = int(stop_n[at[0]]) if last[0] else 0
            ordered = np.concatenate([s[~last], s[last]])
            head = ordered[: prefix_length(len(s))] >> np.uint64(64 - SET_BITS)
            rows.append((doc_id, len(s), sig, many, *keys, pack(s >> np.uint64(64 - SET_BITS), SET_BITS), pack(head, SET_BITS)))
        yield pd.DataFrame(rows, columns=["doc_id", "n", "sig", "many", "key_1", "key_2", "key_3", "tokens", "prefix"])


def _stars(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows sorted by (key, salt, doc_id): each joins the first leader of its key and salt that it links with, or leads."""
    now, leaders = None, []
    for f in frames:
        out = []
        for doc_id, n, key, salt, tokens in zip(f["doc_id"].tolist(), f["n"].tolist(), f["key"].tolist(), f["salt"].tolist(), f["tokens"]):
            if now != (key, salt):
                now, leaders = (key, salt), []
            s = unpack(tokens, SET_BITS)
            for x in leaders:
                if links(overlap(x[1], s), x[2], n):
                    x[3] += 1
                    out.append((x[0], x[3] // BLOCK))
                    break
            else:
                out.append((doc_id, 0))
                if len(leaders) < LEADERS:
                    leaders.append([doc_id, s, n, 0])
        yield f.assign(star=[x[0] for x in out], block=[x[1] for x in out])


def _matrix(frames: Iterator[pd.DataFrame], ranges: int) -> Iterator[pd.DataFrame]:
    """The matrix by range of shingles: for each shingle and group, the group, the size of the smallest and largest member that has
    it, and the most shingles that any of these has from it on in the order."""

    def flush(frame):
        tokens = [unpack(x, SET_BITS) for x in frame["prefix"]]
        lengths = [len(t) for t in tokens]
        groups, group = np.unique(np.stack([frame["component"], frame["star"], frame["block"]], 1), axis=0, return_inverse=True)
        tokens, owner, n = np.concatenate(tokens), np.repeat(group.ravel(), lengths), np.repeat(frame["n"].to_numpy(), lengths)
        rest = n - np.concatenate([np.arange(k) for k in lengths])
        order = np.lexsort((owner, tokens))
        tokens, owner, n, rest = tokens[order], owner[order], n[order], rest[order]
        start = np.flatnonzero((np.diff(tokens, prepend=~tokens[:1]) != 0) | (np.diff(owner, prepend=-1) != 0))
        sizes = np.stack([np.minimum.reduceat(n, start), np.maximum.reduceat(n, start), np.maximum.reduceat(rest, start)], 1).astype(np.int32)
        tokens, owner = tokens[start], owner[start]
        cuts = np.searchsorted(tokens, np.array([(r << SET_BITS) // ranges for r in range(ranges + 1)], np.uint64))
        rows = []
        for r, (a, b) in enumerate(zip(cuts[:-1].tolist(), cuts[1:].tolist())):
            if b > a:
                used, place = np.unique(owner[a:b], return_inverse=True)
                rows.append((r, squeeze(tokens[a:b], SET_BITS // 8), squeeze(place, 3), zstandard.compress(sizes[a:b].tobytes(), 1), groups[used].astype(np.int64).tobytes()))
        return pd.DataFrame(rows, columns=["range", "tokens", "places", "sizes", "groups"])

    held, size = [], 0
    for f in frames:
        held.append(f)
        size += sum(map(len, f["prefix"])) * 8 // SET_BITS
        if size >= RANGE:
            yield flush(pd.concat(held, ignore_index=True))
            held, size = [], 0
    if size:
        yield flush(pd.concat(held, ignore_index=True))


def _meet(f: pd.DataFrame) -> pd.DataFrame:
    """Pairs of groups of different components that have a shingle of one range in common, and members of fitting sizes."""
    tokens = np.concatenate([unsqueeze(t, SET_BITS // 8) for t in f["tokens"]])
    groups = np.concatenate([np.frombuffer(g, np.int64).reshape(-1, 3)[unsqueeze(p, 3).astype(np.int64)] for p, g in zip(f["places"], f["groups"])])
    sizes = np.concatenate([np.frombuffer(zstandard.decompress(x), np.int32).reshape(-1, 3) for x in f["sizes"]]).astype(np.int64)
    order = np.argsort(tokens, kind="stable")
    tokens, groups, (low, high, rest) = tokens[order], groups[order], sizes[order].T
    start = np.flatnonzero(np.diff(tokens, prepend=~tokens[:1]))
    length = np.diff(start, append=len(tokens))
    several = np.minimum.reduceat(groups[:, 0], start) != np.maximum.reduceat(groups[:, 0], start)
    start, length = start[several], length[several]
    found, held = [np.empty((0, 4), np.int64)], 0
    for n in np.unique(length).tolist():
        runs = start[length == n]
        for d in range(1, n):  # entries d apart, of all runs of this length at once
            a = (runs[:, None] + np.arange(n - d)).ravel()
            b = a + d
            # a pair's first common shingle in the order leaves room for all that they need to have in common
            room = (DENOMINATOR + NUMERATOR) * np.minimum(rest[a], rest[b]) >= NUMERATOR * (low[a] + low[b])
            fits = room & (groups[a, 0] != groups[b, 0]) & (DENOMINATOR * high[a] >= NUMERATOR * low[b]) & (DENOMINATOR * high[b] >= NUMERATOR * low[a])
            a, b = groups[a[fits], 1:], groups[b[fits], 1:]
            swap = ((a[:, 0] > b[:, 0]) | ((a[:, 0] == b[:, 0]) & (a[:, 1] > b[:, 1])))[:, None]
            found.append(np.concatenate([np.where(swap, b, a), np.where(swap, a, b)], 1))
            held += len(a)
            if held > RANGE:
                found = [np.unique(np.concatenate(found), axis=0)]
                held = 0
    pairs = np.unique(np.concatenate(found), axis=0)
    return pd.DataFrame(pairs, columns=["star_a", "block_a", "star_b", "block_b"])


def _leaders_link(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for f in frames:
        keep = [links(overlap(unpack(a, SET_BITS), unpack(b, SET_BITS)), na, nb) for a, b, na, nb in zip(f["tokens_a"], f["tokens_b"], f["n_a"], f["n_b"])]
        yield f.loc[np.array(keep, bool), ["a", "b"]]


def _open(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """For each pair of groups: links of queries from one with members of the other, which is opened only by queries that share
    enough with its token union."""
    for f in frames:
        rows = []
        for one, two in zip(f["members_a"], f["members_b"]):
            one, two = ([(m["doc_id"], m["n"], unpack(m["tokens"], SET_BITS)) for m in side] for side in (one, two))
            if len(one) > len(two):
                one, two = two, one
            union = two[0][2] if len(two) == 1 else np.unique(np.concatenate([t for _, _, t in two]))
            for q, nq, tq in one:
                if DENOMINATOR * overlap(tq, union) >= NUMERATOR * nq:
                    rows += [(q, m) for m, nm, tm in two if links(min(nq, nm), nq, nm) and links(overlap(tq, tm), nq, nm)]
        yield pd.DataFrame(rows, columns=["a", "b"], dtype=np.int64)


def common_counts(one: list[np.ndarray], two: list[np.ndarray]) -> np.ndarray:
    """(len(one), len(two)): how many values each set of one shares with each of two."""
    out = np.zeros(len(one) * len(two), np.int64)
    tokens = np.concatenate([*one, *two])
    owner = np.repeat(np.arange(len(one) + len(two)), [len(x) for x in (*one, *two)])
    order = np.argsort(tokens, kind="stable")
    tokens, owner = tokens[order], owner[order]
    start = np.flatnonzero(np.diff(tokens, prepend=~tokens[:1]))
    length = np.diff(start, append=len(tokens))
    left = np.add.reduceat((owner < len(one)).astype(np.int64), start)
    right = length - left
    # values in many sets by products of matrices, others pair by pair
    dense = (left > 0) & (right > 0) & (16 * left * right > len(out))
    column = np.where(dense, np.cumsum(dense) - 1, -1)
    at = np.repeat(column, length)
    for low in range(0, int(dense.sum()), COLUMNS):
        use = (at >= low) & (at < low + COLUMNS)
        a, b = np.zeros((len(one), COLUMNS), np.float32), np.zeros((len(two), COLUMNS), np.float32)
        k, c = owner[use], at[use] - low
        a[k[k < len(one)], c[k < len(one)]] = 1
        b[k[k >= len(one)] - len(one), c[k >= len(one)]] = 1
        out += np.rint(a @ b.T).astype(np.int64).ravel()
    # owners are sorted within a value, so those of one come first
    few = np.flatnonzero((left > 0) & (right > 0) & ~dense)
    size = left[few] * right[few]
    cuts = np.searchsorted(np.cumsum(size), np.arange(RANGE, int(size.sum()) + RANGE, RANGE))
    for part in np.split(few, np.minimum(cuts + 1, len(few))):
        n = left[part] * right[part]
        place = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        first, x, y = (np.repeat(v, n) for v in (start[part], left[part], right[part]))
        i, j = owner[first + place // y], owner[first + x + place % y] - len(one)
        out += np.bincount(i * len(two) + j, minlength=len(out))
    return out.reshape(len(one), len(two))


def _count_links(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows sorted by (component, i, j): for each class of blocks i and j of a component the documents of the classes of the other
    block that it links with (b is null), and each link that has a mixed class, both ways."""

    def flush(held):
        rows = pd.concat(held, ignore_index=True).drop_duplicates("sig")
        sig, n, weight, mixed = (rows[c].to_numpy() for c in ("sig", "n", "weight", "mixed"))
        tokens = [unpack(t, SET_BITS) for t in rows["tokens"]]
        same = rows["i"].iloc[0] == rows["j"].iloc[0]
        one = np.flatnonzero(rows["block"] == rows["i"])
        two = one if same else np.flatnonzero(rows["block"] == rows["j"])
        found = links(common_counts([tokens[k] for k in one], [tokens[k] for k in two]), n[one][:, None], n[two][None, :])
        if same:
            np.fill_diagonal(found, False)
        sums = [(sig[one], found @ weight[two])]
        if not same:
            sums.append((sig[two], found.T @ weight[one]))
        out = [pd.DataFrame({"a": a, "b": pd.array([None] * len(a), "Int64"), "documents": d}) for a, d in sums]
        x, y = np.nonzero(found & (mixed[one][:, None] | mixed[two][None, :]))
        x, y = sig[one][x], sig[two][y]
        for a, b in ((x, y),) if same else ((x, y), (y, x)):
            out.append(pd.DataFrame({"a": a, "b": pd.array(b, "Int64"), "documents": np.zeros(len(a), np.int64)}))
        out = pd.concat(out, ignore_index=True)
        return out[(out["documents"] > 0) | out["b"].notna()]

    now, held = None, []
    for f in frames:
        cuts = np.flatnonzero((f[["component", "i", "j"]] != f[["component", "i", "j"]].shift()).any(axis=1).to_numpy())
        for low, high in zip(cuts.tolist(), [*cuts[1:].tolist(), len(f)]):
            part = f.iloc[low:high]
            key = tuple(part[["component", "i", "j"]].iloc[0])
            if held and key != now:
                yield flush(held)
                held = []
            now = key
            held.append(part)
    if held:
        yield flush(held)


def _grouped(rows: DataFrame, key: str) -> DataFrame:
    """rows with their stars by a key, whose documents are dealt to as many places as their number (many) calls for."""
    salted = rows.withColumn("key", F.col(key)).withColumn("salt", F.pmod("sig", F.floor(F.col("many") / SALT) + 1)).drop("many")
    dealt = salted.repartition(F.col("key"), F.col("salt")).sortWithinPartitions("key", "salt", "doc_id")
    schema = ", ".join(f"{c} {t}" for c, t in salted.dtypes) + ", star long, block int"
    return dealt.mapInPandas(lean(_stars), schema).drop("key", "salt")


def _leaders_meet(stars: DataFrame) -> DataFrame:
    """Links (a, b) of leaders with leaders under the other keys, in rounds of these in turn: each deals the leaders of a key that are
    left to places of about SALT, of which those that link with another lead no more. After a round of each key, rounds go on
    while there are keys with more leaders than a place holds, and while these leaders halve."""
    leading, merged, before, round_ = stars.where("doc_id = star").drop("star", "block"), None, 0, 1
    while True:
        round_ += 1
        key = f"key_{2 + round_ % 2}"
        hot = stash(leading.groupBy(F.col(key).alias("of")).agg(F.count("*").alias("many")).where(F.col("many") > SALT), "hot-keys")
        crowd = hot.agg(F.sum("many")).first()[0] or 0
        if round_ > 3 and (not crowd or crowd > before / 2):
            return merged
        dealt = leading.join(hot, F.col(key) == F.col("of"), "left") if crowd else leading.withColumn("many", F.lit(0))
        dealt = dealt.select("doc_id", "n", "sig", F.coalesce("many", F.lit(0)).alias("many"), "key_2", "key_3", "tokens")
        made = _grouped(dealt, key)
        leading = stash(made.withColumn("tokens", F.when(F.col("doc_id") == F.col("star"), F.col("tokens"))), f"leaders-{round_}")
        found = leading.where("doc_id <> star").select(F.col("doc_id").alias("a"), F.col("star").alias("b"))
        merged = found if merged is None else merged.unionByName(found)
        leading, before = leading.where("doc_id = star").drop("star", "block"), crowd


def link_classes(docs: DataFrame, classes: DataFrame, total: int) -> tuple[DataFrame, DataFrame]:
    """Links (a, b), enough for the components, between the representatives of classes (rep, n, sig_a), and the sets (doc_id, n,
    sig, tokens) of all classes that can link with another."""
    spark = docs.sparkSession
    ranges = max(8, -(-total // (4 * RANGE)))
    texts = docs.select("text")
    dealt = texts.mapInPandas(lean(partial(_deal, ranges=ranges)), "range int, tokens binary, places binary, classes binary")
    bounds = stash(dealt.repartition(min(ranges, MOST_PARTS), "range").groupBy("range").applyInPandas(partial(_shared, ranges=ranges), "bucket int, tokens array<long>, n array<int>, classes binary, counts binary"), "shared-shingles")
    shared = bounds.where("bucket >= 0").select("bucket", "classes", "counts").groupBy("bucket").applyInPandas(_summed, "sig long, shared long")
    rest = classes.join(shared, F.col("sig_a") == F.col("sig")).where(DENOMINATOR * F.col("shared") >= NUMERATOR * F.col("n"))
    rest = stash(rest.select(F.col("rep").alias("id")), "near-candidates")
    # the driver gets the sizes of levels of frequency, then the shingles of the top levels that hold at most STOP
    common = bounds.where("bucket = -1").select(F.explode(F.arrays_zip("tokens", "n")).alias("x")).select("x.tokens", "x.n", F.floor(16 * F.log2("x.n")).alias("level"))
    held, least = 0, 1 << 20
    for level, size in common.groupBy("level").count().orderBy(F.desc("level")).collect():
        held += size
        if held > STOP:
            break
        least = level
    common = common.where(F.col("level") >= least).select("tokens", "n").toPandas().sort_values("tokens")
    stop = spark.sparkContext.broadcast((common["tokens"].to_numpy(np.uint64), common["n"].to_numpy(np.int64)))

    fetched = docs.join(rest, F.col("doc_id") == F.col("id"), "left_semi")
    sets = fetched.mapInPandas(lean(partial(_sets, common=stop)), "doc_id long, n long, sig long, many long, key_1 long, key_2 long, key_3 long, tokens binary, prefix binary")
    stars = stash(_grouped(sets, "key_1"), "stars-of-documents")
    star_links = stars.select(F.col("doc_id").alias("a"), F.col("star").alias("b")).where("a <> b")
    merged = _leaders_meet(stars)
    first = stash(components(merged), "star-components")

    labeled = stars.join(first, F.col("star") == F.col("id"), "left").select(F.coalesce("component", "star").alias("component"), "star", F.col("block").cast("long").alias("block"), "n", "prefix")
    ranges = max(8, -(-(stars.agg(F.sum("n")).first()[0] or 0) // (2 * RANGE)))
    matrix = labeled.mapInPandas(lean(partial(_matrix, ranges=ranges)), "range int, tokens binary, places binary, sizes binary, groups binary")
    met = matrix.repartition(min(ranges, MOST_PARTS), "range").groupBy("range").applyInPandas(_meet, "star_a long, block_a long, star_b long, block_b long")
    met = stash(met.distinct(), "group-pairs")

    leaders = stars.where("doc_id = star").select("doc_id", "n", "tokens")
    pairs = met.where("star_a <> star_b").select("star_a", "star_b").distinct()
    for side in "ab":
        pairs = pairs.join(leaders.select(F.col("doc_id").alias(f"star_{side}"), F.col("n").alias(f"n_{side}"), F.col("tokens").alias(f"tokens_{side}")), f"star_{side}")
    between = pairs.select(F.col("star_a").alias("a"), F.col("star_b").alias("b"), "n_a", "n_b", "tokens_a", "tokens_b").mapInPandas(lean(_leaders_link), "a long, b long")
    between = stash(between.unionByName(merged), "leader-links")

    known = stash(components(between), "leader-components")
    for side in "ab":
        met = met.join(known.select(F.col("id").alias(f"star_{side}"), F.col("component").alias(f"known_{side}")), f"star_{side}", "left")
    apart = stash(met.where(F.coalesce("known_a", "star_a") != F.coalesce("known_b", "star_b")).select("star_a", "block_a", "star_b", "block_b"), "groups-apart")
    wanted = apart.select(F.col("star_a").alias("star"), F.col("block_a").alias("block")).unionByName(apart.select(F.col("star_b").alias("star"), F.col("block_b").alias("block"))).distinct()
    members = stars.withColumn("block", F.col("block").cast("long")).join(wanted, ["star", "block"], "left_semi").groupBy("star", "block").agg(F.collect_list(F.struct("doc_id", "n", "tokens")).alias("members"))
    opened = apart
    for side in "ab":
        opened = opened.join(members.select(F.col("star").alias(f"star_{side}"), F.col("block").alias(f"block_{side}"), F.col("members").alias(f"members_{side}")), [f"star_{side}", f"block_{side}"])
    found = opened.select("members_a", "members_b").mapInPandas(lean(_open), "a long, b long")
    return stash(star_links.unionByName(between).unionByName(found), "links"), stars.select("doc_id", "n", "sig", "tokens")


def _classes(docs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(prints, own, found, sets): each row's prints; the classes of each doc_id, which has one unless its rows differ; components of
    representatives; sets of classes that can link."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text"))
    prints = stash(rows.mapInPandas(lean(_prints), "doc_id long, n long, sig_a long, sig_b long"), "prints")
    linked = prints.where("n > 0 and doc_id is not null")
    classes = stash(linked.groupBy("n", "sig_a", "sig_b").agg(F.min("doc_id").alias("rep")), "classes")
    total = classes.agg(F.sum("n")).first()[0] or 0
    own = linked.join(classes, ["n", "sig_a", "sig_b"]).select("doc_id", "rep", "sig_a")
    edges, sets = link_classes(rows.where("doc_id is not null"), classes, total)
    # a doc_id with rows of several classes ties these together
    several = own.groupBy("doc_id").agg(F.min("rep").alias("b"), F.max("rep").alias("z")).where("b <> z").select("doc_id", "b")
    ties = own.join(several, "doc_id").where("rep <> b").select(F.col("rep").alias("a"), "b")
    found = stash(components(edges.unionByName(ties)), "components")
    return prints, own, found, sets


def _with_components(prints: DataFrame, own: DataFrame, found: DataFrame) -> DataFrame:
    of = own.groupBy("doc_id").agg(F.min("rep").alias("rep")).join(found, F.col("rep") == F.col("id"), "left").select("doc_id", F.coalesce("component", "rep").alias("c"))
    return prints.join(of, "doc_id", "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("c", "doc_id").alias("component_id"))


def jaccard_classes(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id) for each row of docs.

    Sets are of distinct five-word shingles, A to Z as a to z; one to four words are one shingle. Null and empty texts and texts
    of separators have no shingle, and link with nothing: each is its own component. Rows with a null doc_id link with nothing
    either and have a null component. Rows that share a doc_id are one document: links of any of them hold for all. Equal sets
    are one class, compared once. An empty table gives no rows.
    """
    prints, own, found, _ = _classes(docs)
    return _with_components(prints, own, found)


def _link_sums(own: DataFrame, found: DataFrame, sets: DataFrame) -> DataFrame:
    """(doc_id, n_links) of every doc_id with a link."""
    own = stash(own.select("doc_id", "sig_a").distinct(), "own-classes")
    many = stash(own.groupBy("doc_id").count().where("count > 1").select("doc_id"), "documents-of-several-classes")
    single, multi = own.join(many, "doc_id", "left_anti"), own.join(many, "doc_id", "left_semi")
    weights = own.join(many.withColumn("many", F.lit(1)), "doc_id", "left").groupBy("sig_a").agg(F.count(F.when(F.col("many").isNull(), 1)).alias("weight"), (F.count("many") > 0).alias("mixed"))
    weights = stash(weights, "class-weights")

    # sets come by doc_id, so one of several rows may bring a class that has another representative: one row of each is enough
    meta = sets.groupBy("sig").agg(F.min("doc_id").alias("doc_id"), F.first("n").alias("n")).join(found, F.col("doc_id") == F.col("id")).join(weights, F.col("sig") == F.col("sig_a"))
    place = Window.partitionBy("component").orderBy("n", "sig")
    cost = F.col("n") + RANGE // MEMBERS
    meta = meta.withColumn("block", F.floor((F.sum(cost).over(place) - cost) / RANGE)).select("sig", "doc_id", "n", "component", "block", "weight", "mixed")
    meta = stash(meta, "members")
    blocks = meta.groupBy("component", "block").agg(F.min("n").alias("low"), F.max("n").alias("high"), F.count("*").alias("size"))
    later = blocks.select(F.col("component").alias("of"), F.col("block").alias("j"), F.col("low").alias("least"), F.col("size").alias("other"))
    pairs = blocks.join(later, (F.col("component") == F.col("of")) & (F.col("block") <= F.col("j")) & (DENOMINATOR * F.col("high") >= NUMERATOR * F.col("least")))
    pairs = pairs.where("block <> j or size > 1").select("component", F.col("block").alias("i"), "j")
    sides = F.when(F.col("i") == F.col("j"), F.array("i")).otherwise(F.array("i", "j"))
    pairs = pairs.select("component", F.explode(sides).alias("block"), "i", "j").groupBy("component", "block").agg(F.collect_list(F.struct("i", "j")).alias("pairs"))
    rows = sets.select("doc_id", "sig", "tokens").join(meta.join(pairs, ["component", "block"]), ["doc_id", "sig"])
    rows = rows.select("sig", "n", "weight", "mixed", "component", "block", F.explode("pairs").alias("p"), "tokens").select("sig", "n", "weight", "mixed", "component", "block", "p.i", "p.j", "tokens")
    dealt = rows.repartition("component", "i", "j").sortWithinPartitions("component", "i", "j")
    met = stash(dealt.mapInPandas(_count_links, "a long, b long, documents long"), "link-sums")

    sums = met.where("b is null").groupBy("a").agg(F.sum("documents").alias("others"))
    of_class = weights.join(sums, F.col("sig_a") == F.col("a"), "left").select("sig_a", (F.col("weight") - 1 + F.coalesce("others", F.lit(0))).alias("n"))
    if many.isEmpty():
        return single.join(of_class, "sig_a").where("n > 0").select("doc_id", F.col("n").alias("n_links"))
    # documents of several classes count once, however many of their classes link
    near = met.where("b is not null").select("a", "b").unionByName(weights.where("mixed").select(F.col("sig_a").alias("a"), F.col("sig_a").alias("b")))
    near = stash(near.distinct(), "mixed-links")
    reached = near.join(multi.select(F.col("doc_id").alias("other"), F.col("sig_a").alias("b")), "b").select(F.col("a").alias("sig_a"), "other").distinct()
    of_single = single.join(of_class, "sig_a").join(reached.groupBy("sig_a").agg(F.count("*").alias("more")), "sig_a", "left").select("doc_id", (F.col("n") + F.coalesce("more", F.lit(0))).alias("n_links"))
    around = multi.join(near.withColumnRenamed("a", "sig_a"), "sig_a").select("doc_id", F.col("b").alias("sig_a")).distinct().join(weights, "sig_a").groupBy("doc_id").agg(F.sum("weight").alias("n"))
    more = multi.join(reached, "sig_a").where("doc_id <> other").select("doc_id", "other").distinct().groupBy("doc_id").agg(F.count("*").alias("more"))
    of_multi = around.join(more, "doc_id", "left").select("doc_id", (F.col("n") + F.coalesce("more", F.lit(0))).alias("n_links"))
    return of_single.unionByName(of_multi).where("n_links > 0")


def jaccard_links(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id, n_links) for each row of docs: jaccard_classes with the number of other doc_ids that a doc_id
    links with, copies among them. No link is left out; rows that link with nothing have 0."""
    prints, own, found, sets = _classes(docs)
    sums = _link_sums(own, found, sets).withColumnRenamed("doc_id", "of_doc")
    rows = _with_components(prints, own, found)
    return rows.join(sums, F.col("doc_id") == F.col("of_doc"), "left").select(*rows.columns, F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))


def keep_representatives(docs: DataFrame) -> DataFrame:
    """The rows of docs whose doc_id is the smallest of its component; rows with a null doc_id stay."""
    gone = stash(jaccard_classes(docs).where("doc_id <> component_id").select(F.col("doc_id").alias("gone")).distinct(), "near-copies")
    rows = docs.select(F.struct("*").alias("row"))
    return rows.join(gone, F.col("row.doc_id").cast("long") == F.col("gone"), "left_anti").select("row.*")


def op9_jaccard_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_classes(table(spark, sf_dir, "documents"))


def op9_jaccard_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_links(table(spark, sf_dir, "documents"))


_LINKED_SQL = f"""
WITH RECURSIVE d AS ({SETS_SQL.format(id="doc_id", table="documents")}), n AS (SELECT doc_id, count(*) AS n FROM d GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM d a JOIN d b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id),
l AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * c >= 75 * (a.n + b.n - c)),
r(id, seen) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.id, l.y FROM r JOIN l ON l.x = r.seen)
"""
OP9_SQL = _LINKED_SQL + """SELECT r.id AS doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(seen) AS component_id FROM r LEFT JOIN n ON n.doc_id = r.id GROUP BY r.id
"""
OP9_LINKS_SQL = _LINKED_SQL + """SELECT r.id AS doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(seen) AS component_id, coalesce(any_value(k.n), 0) AS n_links
FROM r LEFT JOIN n ON n.doc_id = r.id LEFT JOIN (SELECT x, count(*) AS n FROM l GROUP BY x) k ON k.x = r.id GROUP BY r.id
"""
