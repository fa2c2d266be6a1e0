"""Summaries of experiments and logs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def judge_summary(df: DataFrame, sets: list[list[str]], scores: list[str]) -> DataFrame:
    """Means of all scores, rows, and rows of which no score was parsed, for each grouping set, in one pass; columns outside a set are
    null, level tells the set."""
    keys = list(dict.fromkeys(c for s in sets for c in s))
    grouped = df.groupingSets([[F.col(c) for c in s] for s in sets], *keys)
    return grouped.agg(F.grouping_id().cast("long").alias("level"), *(F.round(F.avg(s), 3).alias(s) for s in scores), F.count("*").alias("n"), F.count_if(F.coalesce(*scores).isNull()).alias("unparsed"))


def judge_cube(df: DataFrame, keys: list[str], score: str = "answer_score") -> DataFrame:
    return df.cube(*keys).agg(F.grouping_id().cast("long").alias("level"), F.round(F.avg(score), 3).alias("mean"), F.count("*").alias("n"))


def unparsed_by_cell(df: DataFrame, row: str, column: str, values: list[int], score: str = "answer_score") -> DataFrame:
    """Unparsed rows by cell, zeros included."""
    return df.groupBy(row).pivot(column, values).agg(F.count_if(F.col(score).isNull())).na.fill(0)


def mean_se(df: DataFrame, by: list[str], score: str) -> DataFrame:
    """Mean, its standard error (0 for one row) and the half width of its 95% interval."""
    se = F.coalesce(F.stddev_samp(score) / F.sqrt(F.count(score)), F.lit(0.0))
    return df.groupBy(*by).agg(F.count(score).alias("n"), F.avg(score).alias("mean"), se.alias("se")).withColumn("ci", F.col("se") * 1.96)


def paired_compare(df: DataFrame, comparisons: DataFrame, score: str, key: str = "id") -> DataFrame:
    """For each comparison (name, a_column, a_value, b_column, b_value, and optionally within_column, within_value): pairs of each
    item's mean over the rows of A and of B, both present; n, mean difference, its standard error, t, interval and whether t is
    1.96 or more either way. Fewer than two pairs give nulls. Comparisons are few; each is a row, so one pass makes all."""
    columns = [c for c in df.columns if c not in (key, score)]
    value = lambda of: F.coalesce(*(F.when(F.col(of) == c, F.col(c).cast("string")) for c in columns))
    j = df.crossJoin(listed(comparisons))
    inside = F.col("within_column").isNull() | (value("within_column") == F.col("within_value"))
    a, b = (F.avg(F.when(value(f"{s}_column") == F.col(f"{s}_value"), F.col(score))) for s in "ab")
    pairs = j.where(inside).groupBy("name", key).agg(a.alias("a"), b.alias("b")).dropna().withColumn("d", F.col("a") - F.col("b"))
    two = F.count("*") >= 2
    se = F.stddev_samp("d") / F.sqrt(F.count("*"))
    out = pairs.groupBy("name").agg(F.count("*").alias("n"), F.when(two, F.avg("d")).alias("mean"), F.when(two, se).alias("se"))
    t = F.when(F.col("se") > 0, F.col("mean") / F.col("se"))
    return out.withColumn("t", t).withColumn("ci", 1.96 * F.col("se")).withColumn("significant", F.coalesce(F.abs("t") >= 1.96, F.lit(False)))


def comparison_battery(spark, pairs: dict[str, list], within: tuple[str, list] | None = None) -> DataFrame:
    """Comparisons of every two values of each column; with within, also inside each of its values."""
    rows = []
    for column, values in pairs.items():
        for i, a in enumerate(values):
            for b in values[i + 1 :]:
                rows.append((f"{column} {b} vs {a}", column, str(b), column, str(a), None, None))
                if within and within[0] != column:
                    rows += [(f"{column} {b} vs {a} in {w}", column, str(b), column, str(a), within[0], str(w)) for w in within[1]]
    return spark.createDataFrame(rows, "name string, a_column string, a_value string, b_column string, b_value string, within_column string, within_value string")


def latency_summary(df: DataFrame, by: list[str], ms: str, p: float = 0.9, rule: str = "clamped") -> DataFrame:
    """Mean and the p-th value by place in ascending order, without interpolation. Rules: `clamped`, place min(n - 1, floor(n p));
    `before`, floor(n p) - 1, the last one where that is -1; `plain`, floor(n p).

    Approximate percentiles on either side of p, whose error is bounded, leave a twentieth of a group at most to be put in order;
    the rest is only counted.
    """
    places = {"clamped": F.least(F.col("n") - 1, F.floor(F.col("n") * p)), "before": F.when(F.floor(F.col("n") * p) == 0, F.col("n") - 1).otherwise(F.floor(F.col("n") * p) - 1), "plain": F.floor(F.col("n") * p)}
    facts = df.groupBy(*by).agg(F.count("*").alias("n"), F.avg(ms).alias("mean"), F.percentile_approx(ms, [max(0.0, p - 0.02), min(1.0, p + 0.02)], 1000).alias("q"), F.min(ms).alias("least"), F.max(ms).alias("most"))
    # few values have a place next to an end
    low, high = F.when(F.col("n") > 1000, F.get("q", F.lit(0))).otherwise(F.col("least")), F.when(F.col("n") > 1000, F.get("q", F.lit(1))).otherwise(F.col("most"))
    facts = facts.select(*by, "n", "mean", places[rule].alias("at"), low.alias("low"), high.alias("high"))
    keyed = df.select(*by, F.col(ms).alias("value")).join(facts, by).where(F.col("value") <= F.col("high"))
    near = keyed.groupBy(*by, F.when(F.col("value") >= F.col("low"), F.col("value")).alias("value")).agg(F.count("*").alias("k"), F.first("at").alias("at"))
    upto = F.sum("k").over(Window.partitionBy(*by).orderBy(F.col("value").asc_nulls_first()))
    found = near.withColumn("upto", upto).where((F.col("upto") > F.col("at")) & F.col("value").isNotNull()).groupBy(*by).agg(F.min("value").alias("percentile"))
    return facts.select(*by, "n", "mean").join(found, by, "left")


def stage_latency(df: DataFrame, by: str, timings: str = "timings_ms", search: tuple[str, ...] = ("dense", "sparse", "rrf")) -> DataFrame:
    """Mean of every timing, by stage, and of the search stages' sum."""
    whole = F.aggregate(F.array(*(F.coalesce(F.try_element_at(timings, F.lit(s)), F.lit(0.0)) for s in search)), F.lit(0.0), lambda a, x: a + x)
    each = df.select(by, F.explode(F.map_concat(timings, F.create_map(F.lit("search"), whole))).alias("stage", "ms"))
    return each.groupBy(by, "stage").agg(F.avg("ms").alias("ms"))


def listed(df: DataFrame, most: int = 1000) -> DataFrame:
    """A list of configs or comparisons, marked for broadcast; an error where it has more than `most` rows."""
    if df.limit(most + 1).count() > most:
        raise ValueError(f"more than {most} rows in a list that goes to all tasks")
    return F.broadcast(df)


def experiment_grid(questions: DataFrame, configs: DataFrame) -> DataFrame:
    """Every question under every config; configs are a list."""
    return questions.crossJoin(listed(configs))


def prompt_budget(ranked: DataFrame, by: str, ks: list[int], context: int, chars_per_token: float = 2.6, reserve: int = 400) -> DataFrame:
    """Per k the longest prompt in tokens over all questions, and whether it fits, from ranked chunks (by, rank, text). Only lengths of
    the first chunks of each question are gathered."""
    size = F.col("size")
    first = ranked.select(by, "rank", F.length("text").cast("long").alias("size")).withColumn("place", F.row_number().over(Window.partitionBy(by).orderBy("rank", "size"))).where(F.col("place") <= max(ks))
    sums = first.groupBy(by).agg(*(F.sum(F.when(F.col("place") <= k, size)).alias(f"k{k}") for k in ks))
    each = sums.select(F.explode(F.array(*(F.struct(F.lit(k).alias("k"), F.col(f"k{k}").alias("chars")) for k in ks))).alias("x")).select("x.*")
    return each.groupBy("k").agg(F.max("chars").alias("chars")).withColumn("tokens", F.col("chars") / chars_per_token + reserve).withColumn("fits", F.col("tokens") <= context)


def todo(units: DataFrame, done: DataFrame, key: str) -> DataFrame:
    return units.join(done.select(key), key, "left_anti")


def _finished(spark: SparkSession, path: str) -> list[str]:
    """Folders of units that were written to the end."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(at):
        return []
    found = [f.getPath() for f in fs.listStatus(at) if f.isDirectory()]
    return sorted(p.toString() for p in found if fs.exists(spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS")))


def run_in_units(units: DataFrame, path: str, key: str, work: Callable[[DataFrame], DataFrame], rows: int = 10_000, most: int | None = None) -> DataFrame:
    """All rows that work makes of units, kept at path: a long run that can break off anywhere and be taken up again.

    What isn't done yet goes in parts of about so many rows, by hash of the key; each part's result is one folder, whose name follows
    from how many were finished before, so a part that broke off is written over. Keys that finished folders hold are left out when
    the run is taken up, whatever rows were added to units in between. most: parts to do now, if not all. work must keep the key.
    """
    spark = units.sparkSession
    finished = _finished(spark, path)
    left = todo(units, spark.read.parquet(*finished), key) if finished else units
    n = left.count()
    parts = -(-n // rows)
    for k in range(min(parts, parts if most is None else most)):
        part = left.where(F.pmod(F.xxhash64(key), F.lit(parts)) == k)
        work(part).write.mode("overwrite").parquet(f"{path}/part-{len(finished) + k:06d}")
    done = _finished(spark, path)
    return spark.read.parquet(*done) if done else work(units.limit(0))


def cumulative_merge(old: DataFrame, new: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(old rows whose key isn't in new, and all new rows; how many were replaced)."""
    return old.join(new.select(key), key, "left_anti").unionByName(new), old.join(new.select(key).distinct(), key, "left_semi").agg(F.count("*").alias("replaced"))


def joined_comments(df: DataFrame, by: list[str], key: str, line: Column, per_page: int = 100) -> DataFrame:
    """Per run one text of all lines in the order of a whole-number key, in pages of so many keys each, so that no row holds a whole
    run: the pages in order are the text."""
    paged = df.withColumn("page", F.floor(F.col(key) / per_page))
    return paged.groupBy(*by, "page").agg(F.array_join(F.array_sort(F.collect_list(F.struct(key, line.alias("line"))))["line"], "\n").alias("comments"))


def side_by_side(df: DataFrame, keys: list[str], model: str = "model") -> DataFrame:
    """Per question the answers of all models as a map."""
    return df.groupBy(*keys).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(model, "answer")))).alias("answers"))


def errors_by_model(df: DataFrame, model: str = "model") -> DataFrame:
    return df.groupBy(model).agg(F.count("*").alias("n"), F.count_if(F.col("error").isNotNull()).alias("errors"))


def map_distinct(df: DataFrame, column: str, change, out: str) -> DataFrame:
    """df with a costly function of a column, made once for each distinct value and joined back."""
    return df.join(change(df.select(column).distinct(), column, out), column, "left")


def session_counters(df: DataFrame, labels: list[str], value: Column | None = None) -> DataFrame:
    """Counts (or sums) by labels, of a batch or a stream."""
    return df.groupBy(*labels).agg((F.sum(value) if value is not None else F.count("*")).alias("count"))


def to_exposition(counters: DataFrame, name: str, help_text: str, labels: list[str], value: str = "count") -> DataFrame:
    """Lines of the text exposition format in order: HELP, TYPE, then a line for each label set."""
    pairs = [F.concat(F.lit(f'{c}="'), F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit('"')) for c in labels]
    lines = counters.select(F.lit(2).alias("part"), F.concat(F.lit(f"{name}{{"), F.concat_ws(",", *pairs), F.lit("} "), F.col(value).cast("string")).alias("line"))
    head = counters.sparkSession.createDataFrame([(0, f"# HELP {name} {help_text}"), (1, f"# TYPE {name} counter")], "part int, line string")
    return head.unionByName(lines).orderBy("part", "line")
