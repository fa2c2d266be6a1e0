"""Operator 6: personal data by fixed forms and by bootstrapped contextual extraction (DataFrame functions only).

Seeds are what the fixed forms find. The words on either side of a seed, and both together, are lexical patterns; tokens with digits
or @, and runs of them, are instances. Patterns and instances form a graph: a pattern is as sure of a kind as its instances are of
that kind among all those that are of some kind or can't be of this one; an instance is as sure as its patterns together. This goes
on until trust stops moving; then patterns that are sure and have enough seeds mark the instances beside them that no form knows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import stash, table

KINDS = ("email", "ip", "card", "phone")
#: Different seeds that a pattern needs, and sureness at which it marks.
SUPPORT, SURE = 3, 0.8
#: Part of all trust that still moves when rounds end, and rounds after which they end in any case.
STILL, ROUNDS = 0.001, 20
#: Digits that a marked instance may have more or fewer than the seeds of its pattern (a prefix left out, say).
SLACK = 2
#: Characters of an instance and of a pattern's word at most: longer ones identify nobody.
LONGEST, WORD = 100, 64
#: Matches of a text that are placed together.
CHUNK = 64

# The forms, written so that they match without backtracking over long runs: a match starts at the head of a run or where the
# match before ended, and what can't give back is possessive.
_FORMS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
_MARK = {"email": "@", "ip": ".", "card": None, "phone": "+"}
_SPACE = r"\x20\x09-\x0D"
_MEMBER = rf"[^{_SPACE}0-9@]*+[0-9@][^{_SPACE}]*+"
#: Tokens with a digit or @, one space apart, and what the edges of an instance may be freed from.
_RUN = rf"(?<![^{_SPACE}]){_MEMBER}(?:\x20{_MEMBER})*+"
_LEFT, _RIGHT = r"^[^\p{L}\p{N}+(]*+", r"[^\p{L}\p{N})]++$"
#: Digits that an instance of a kind may have.
_FITTING = {"card": (13 - SLACK, 19 + SLACK), "phone": (9 - SLACK, 15 + SLACK)}


def _digits(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def _luhn(c: Column) -> Column:
    digits = F.transform(F.split(F.reverse(_digits(c)), ""), lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise(F.when(d.cast("int") > 4, 2 * d.cast("int") - 9).otherwise(2 * d.cast("int"))))
    return F.aggregate(digits, F.lit(0), lambda a, d: a + F.coalesce(d, F.lit(0))) % 10 == 0


def _valid(kind: str, c: Column) -> Column:
    n = F.length(_digits(c))
    if kind == "ip":
        return F.forall(F.split(c, r"\."), lambda p: F.length(F.regexp_replace(p, "^0+(?=.)", "")) < 4) & F.forall(F.split(c, r"\."), lambda p: F.substring(F.regexp_replace(p, "^0+(?=.)", ""), 1, 4).cast("int") <= 255)
    if kind == "card":
        return n.between(13, 19) & _luhn(c)
    return n.between(9, 15) if kind == "phone" else F.lit(True)


_MATCH = "struct<before:string,value:string,after:string,start:int>"


def _matches(text: Column, pattern: str) -> Column:
    """Array of (before, value, after, start) of all matches: what stands between matches gives their places.

    Lengths are summed within chunks of matches and over chunks, so that texts of very many matches take steady time.
    """
    found, around = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    pairs = F.zip_with(around, found, lambda b, m: F.struct(b.alias("before"), m.alias("value")))
    every = F.zip_with(pairs, F.slice(around, 2, 1 << 30), lambda x, after: F.struct(x["before"].alias("before"), x["value"].alias("value"), after.alias("after")))
    every = F.filter(every, lambda x: x["value"].isNotNull())
    chunks = lambda a: F.transform(F.sequence(F.lit(0), F.floor((F.size(a) - 1) / CHUNK).cast("int")), lambda k: F.slice(a, k * CHUNK + 1, CHUNK))
    length = lambda x: F.length(x["before"]) + F.length(x["value"])

    def placed(chunk: Column, start: Column) -> Column:
        step = lambda a, x: F.struct(
            (a["at"] + length(x)).alias("at"),
            F.concat(a["out"], F.array(F.struct(x["before"].alias("before"), x["value"].alias("value"), x["after"].alias("after"), (a["at"] + F.length(x["before"])).alias("start")))).alias("out"),
        )
        return F.aggregate(chunk, F.struct(start.alias("at"), F.array().cast(f"array<{_MATCH}>").alias("out")), step, lambda a: a["out"])

    sums = lambda cs: F.transform(cs, lambda c: F.aggregate(c, F.lit(0), lambda a, x: a + length(x)))
    begins = lambda cs: F.aggregate(sums(cs), F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out")), lambda a, n: F.struct((a["at"] + n).alias("at"), F.concat(a["out"], F.array(a["at"])).alias("out")), lambda a: a["out"])
    # a list of one makes each of its values a variable, which is worked out once
    in_parts = F.transform(F.array(every), lambda e: F.transform(F.array(chunks(e)), lambda cs: F.flatten(F.zip_with(cs, begins(cs), placed))))
    return F.when(F.size(found) > 0, F.flatten(F.flatten(in_parts))).otherwise(F.array().cast(f"array<{_MATCH}>"))


_SPAN = "array<struct<kind:int,start:int,end:int,value:string>>"
_CANDIDATE = "array<struct<run:int,part:int,before:string,after:string,start:int,end:int,value:string>>"


def _spans_of(kind: str, matches: Column) -> Column:
    spans = F.transform(matches, lambda m: F.struct(F.lit(KINDS.index(kind)).alias("kind"), m["start"].alias("start"), (m["start"] + F.length(m["value"])).alias("end"), m["value"].alias("value")))
    return F.filter(spans, lambda s: _valid(kind, s["value"]))


def _count_of(kind: str) -> Column:
    return F.size(F.filter("base", lambda s: s["kind"] == KINDS.index(kind))).cast("long").alias(f"n_{kind}")


def _base(text: Column) -> Column:
    """Spans of the fixed forms, by kind and start."""
    found = []
    for kind, pattern in _FORMS.items():
        due = text.contains(_MARK[kind]) if _MARK[kind] else F.lit(True)
        found.append(F.when(due, _spans_of(kind, _matches(text, pattern))).otherwise(F.array().cast(_SPAN)))
    return F.when(text.rlike("[0-9@]"), F.concat(*found)).otherwise(F.array().cast(_SPAN))


def _word(c: Column) -> Column:
    """A pattern's word: in lower case, without marks at its ends, digits as 0; null where nothing is left."""
    return F.nullif(F.regexp_replace(F.regexp_replace(F.lower(c), r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$", ""), "[0-9]", "0"), F.lit(""))


def _candidates(text: Column) -> Column:
    """Runs of tokens with digits or @ (part 0), and of those of several tokens the first (1) and the last (2), freed of marks at
    their edges, each with the words next to it: of the first only the one before, of the last the one after."""

    def freed(run: Column, part: int, before: Column, after: Column, start: Column, value: Column) -> Column:
        left = F.length(F.regexp_extract(value, _LEFT, 0))
        kept = F.regexp_replace(F.regexp_replace(value, _LEFT, ""), _RIGHT, "")
        return F.struct(run.alias("run"), F.lit(part).alias("part"), before.alias("before"), after.alias("after"), (start + left).alias("start"), (start + left + F.length(kept)).alias("end"), kept.alias("value"))

    def parts(m: Column, i: Column) -> Column:
        before = _word(F.regexp_extract(F.substring(m["before"], -LONGEST, LONGEST), rf"(?:^|[{_SPACE}])([^{_SPACE}]{{1,{WORD}}})[{_SPACE}]+$", 1))
        after = _word(F.regexp_extract(F.substring(m["after"], 1, LONGEST), rf"^[{_SPACE}]+([^{_SPACE}]{{1,{WORD}}})(?:[{_SPACE}]|$)", 1))
        none = F.lit(None).cast("string")
        first, last = F.substring_index(m["value"], " ", 1), F.substring_index(m["value"], " ", -1)
        whole = freed(i, 0, before, after, m["start"], m["value"])
        ends = F.array(freed(i, 1, before, none, m["start"], first), freed(i, 2, none, after, m["start"] + F.length(m["value"]) - F.length(last), last))
        named = lambda c: c["value"].rlike("[0-9@]") & F.coalesce(c["before"], c["after"]).isNotNull()
        found = F.when(F.length(m["value"]) > LONGEST, F.filter(ends, lambda c: F.length(c["value"]) <= LONGEST)).when(F.contains(m["value"], F.lit(" ")), F.concat(F.array(whole), ends)).otherwise(F.array(whole))
        return F.filter(found, named)

    return F.when(text.rlike("[0-9@]"), F.flatten(F.transform(_matches(text, _RUN), parts))).otherwise(F.array().cast(_CANDIDATE))


def _fits(kind: int, value: str = "instance") -> Column:
    """Whether an instance may be of a kind by its characters and the number of its digits."""
    c = F.col(value)
    if KINDS[kind] == "email":
        return c.rlike(r"^[^@]+@[^@]+$")
    if KINDS[kind] == "ip":
        return c.rlike(r"^[0-9]+(?:\.[0-9]+){3}$")
    return c.rlike(r"^[+(]?[0-9][0-9 ().+-]*$") & F.length(_digits(c)).between(*_FITTING[KINDS[kind]])


def _instances(found: DataFrame) -> DataFrame:
    """(row_id, run, part, start, end, pattern, instance, kind, digits): a row for each pattern of each candidate. A run that begins
    with a seed gives its left pattern that seed, one that ends with a seed its right pattern; other candidates that overlap a
    fixed form's span are left out, the rest have no kind."""
    each = found.where("size(candidates) > 0").select("row_id", "base", F.explode("candidates").alias("c")).select("row_id", "base", "c.*")
    over = F.array_sort(F.filter("base", lambda s: (s["start"] < F.col("end")) & (s["end"] > F.col("start"))), lambda a, b: a["start"] - b["start"])
    each = each.withColumn("over", over).where("part = 0 or size(over) = 0")
    first, last = F.get("over", F.lit(0)), F.get("over", F.size("over") - 1)
    head = F.when(first["start"] - F.col("start") <= 1, first)
    tail = F.when(F.col("end") - last["end"] <= 1, last)
    one = F.when((F.size("over") == 1) & head.isNotNull() & tail.isNotNull(), first)
    left, right = F.concat(F.lit("<"), "before"), F.concat("after", F.lit(">"))
    sides = F.array(F.struct(left.alias("pattern"), head.alias("seed")), F.struct(right.alias("pattern"), tail.alias("seed")), F.struct(F.concat(left, F.lit(" "), right).alias("pattern"), one.alias("seed")))
    each = each.select("row_id", "run", "part", "start", "end", "value", (F.size("over") > 0).alias("known"), F.explode(sides).alias("p"))
    each = each.where("p.pattern is not null and (not known or p.seed is not null)")
    each = each.select("row_id", "run", "part", "start", "end", "p.pattern", F.coalesce("p.seed.value", "value").alias("instance"), "p.seed.kind")
    return each.withColumn("digits", F.length(_digits(F.col("instance"))))


def trusted_patterns(edges: DataFrame) -> DataFrame:
    """(pattern, kind, sure, seeds, least, most) of the graph (pattern, instance, kind, digits), kind being null but for seeds; least
    and most are the digits of the pattern's seeds of that kind.

    A pattern is sure of a kind by its instances' trust in it over their trust in all kinds and the number of unlabelled ones that
    can't be of it; of unlabelled ones that may be it knows nothing. An instance without a kind is trusted by 1 less the product of
    its patterns' doubts, counting patterns at least half as sure as they need to be.
    """
    seeds = edges.where("kind is not null").select("instance", "kind", F.lit(1.0).alias("trust")).distinct()
    unfit = edges.groupBy("pattern").agg(F.array(*(F.count_if(F.col("kind").isNull() & ~_fits(k)) for k in range(len(KINDS)))).alias("unfit"))
    open_ = edges.where("kind is null").join(seeds.select("instance"), "instance", "left_anti")
    open_ = stash(open_.select("pattern", "instance", F.explode(F.filter(F.array(*(F.when(_fits(k), F.lit(k)) for k in range(len(KINDS)))), lambda k: k.isNotNull())).alias("kind")), "pii-open")
    links, trusted, before = edges.select("pattern", "instance").distinct(), seeds, 0.0
    for _ in range(ROUNDS):
        votes = links.join(trusted, "instance").groupBy("pattern", "kind").agg(F.sum("trust").alias("votes"))
        total = F.sum("votes").over(Window.partitionBy("pattern"))  # a row for each kind
        sure = F.col("votes") / (F.col("total") + F.get("unfit", F.col("kind")))
        patterns = stash(votes.withColumn("total", total).join(unfit, "pattern").select("pattern", "kind", sure.alias("sure")).where(F.col("sure") >= SURE / 2), "pii-patterns")
        doubt = F.sum(F.log1p(-F.least(F.col("sure"), F.lit(0.999999))))
        others = open_.join(patterns, ["pattern", "kind"]).groupBy("instance", "kind").agg((1 - F.exp(doubt)).alias("trust"))
        trusted = stash(seeds.unionByName(others), "pii-trust")
        now = trusted.agg(F.coalesce(F.sum("trust"), F.lit(0.0))).first()[0]
        if abs(now - before) <= STILL * now:
            break
        before = now
    backed = edges.where("kind is not null").groupBy("pattern", "kind").agg(F.count("*").alias("seeds"), F.min("digits").alias("least"), F.max("digits").alias("most"))
    return patterns.join(backed, ["pattern", "kind"])


def _bootstrap(found: DataFrame) -> DataFrame:
    """(row_id, spans): what sure patterns mark, as spans, for rows that have any. Of a run that is marked as a whole its ends aren't
    marked again."""
    each = stash(_instances(found), "pii-instances")
    edges = stash(each.groupBy("pattern", "instance", "kind").agg(F.max("digits").alias("digits")), "pii-graph")
    sure = stash(trusted_patterns(edges).where((F.col("sure") >= SURE) & (F.col("seeds") >= SUPPORT)), "pii-sure")
    new = each.where("kind is null").drop("kind").join(sure, "pattern").where(F.col("digits").between(F.col("least") - SLACK, F.col("most") + SLACK))
    new = new.where(F.coalesce(*(F.when(F.col("kind") == k, _fits(k)) for k in range(len(KINDS)))))
    marks = new.groupBy("row_id", "run", "part", "start", "end").agg(F.max_by(F.struct("kind", "instance"), F.struct("sure", -F.col("kind"))).alias("of"))
    span = F.struct(F.col("of.kind").alias("kind"), "start", "end", F.col("of.instance").alias("value"))
    runs = marks.groupBy("row_id", "run").agg(F.max(F.when(F.col("part") == 0, span)).alias("whole"), F.collect_list(F.when(F.col("part") > 0, span)).alias("ends"))
    spans = runs.select("row_id", F.explode(F.when(F.col("whole").isNotNull(), F.array("whole")).otherwise(F.col("ends"))).alias("span"))
    return spans.groupBy("row_id").agg(F.collect_list("span").alias("extra"))


def find_personal_data(docs: DataFrame) -> DataFrame:
    """(doc_id, base, spans) for each row of docs: arrays of (kind, start, end, value) in code points, by kind and start, kinds by
    their place in KINDS; base those of the fixed forms, spans these and the ones that patterns mark.

    Null and empty texts have none. Repeated rows are searched each, but one instance beside one word counts once in the graph. A
    row's marks are those of its own text. Without seeds, patterns mark nothing. Texts of very many numbers take time in proportion.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    found = docs.select(F.col("doc_id").alias("doc_id"), F.monotonically_increasing_id().alias("row_id"), _base(text).alias("base"), _candidates(text).alias("candidates"))
    found = stash(found, "pii")
    extra = _bootstrap(found).withColumnRenamed("row_id", "of_row")
    spans = F.array_sort(F.concat("base", F.coalesce("extra", F.array().cast(_SPAN))))
    return found.join(extra, F.col("row_id") == F.col("of_row"), "left").select("doc_id", F.array_sort("base").alias("base"), spans.alias("spans"))


def _listed(spans: Column) -> Column:
    kind = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(kind, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def op6_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_personal_data(table(spark, sf_dir, "documents"))
    return found.select("doc_id", *map(_count_of, KINDS), F.sha2(_listed(F.col("base")), 256).alias("base_sha256"), _listed(F.col("spans")).alias("spans"), F.size("spans").cast("long").alias("n_spans"))
