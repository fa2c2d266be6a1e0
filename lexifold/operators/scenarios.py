"""Matching of rules to contexts: conditions become column expressions."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Scenario:
    name: str
    states: tuple[str, ...]
    condition: dict | None = None
    priority: int = 0
    enabled: bool = True


#: Tests of a leaf, {name: value}, on the columns of a context.
LEAVES = {
    "intent": lambda v: F.col("intent") == v,
    "confidence_below": lambda v: F.col("confidence") < v,
    "confidence_at_least": lambda v: F.col("confidence") >= v,
    "rag_count": lambda v: F.col("rag_count") == v,
    "rag_max_score_below": lambda v: F.col("rag_max_score") < v,
    "interject_accepted": lambda v: F.col("interject_accepted") == v,
    "bargein_accepted": lambda v: F.col("bargein_accepted") == v,
    "transcript_empty": lambda v: (F.trim("transcript") == "") == F.lit(v),
    "error_type": lambda v: F.col("error_type") == v,
}


def compile_condition(tree: dict | None) -> Column:
    """A condition as an expression: leaves on values that aren't set are false, and `not` of them is true; no condition is true."""
    if not tree:
        return F.lit(True)
    (name, value), *rest = tree.items()
    if rest:
        return reduce(lambda a, b: a & b, (compile_condition({k: v}) for k, v in tree.items()))
    if name == "all":
        return reduce(lambda a, b: a & b, map(compile_condition, value), F.lit(True))
    if name == "any":
        return reduce(lambda a, b: a | b, map(compile_condition, value), F.lit(False))
    if name == "not":
        return ~compile_condition(value)
    return F.coalesce(LEAVES[name](value), F.lit(False))


def match_scenarios(contexts: DataFrame, rules: list[Scenario]) -> DataFrame:
    """contexts (state, ...) with scenario: of the enabled rules for the state whose condition holds, the one with the highest
    priority, then the first in the list; null where none does."""
    ordered = sorted((r for r in rules if r.enabled), key=lambda r: -r.priority)
    due = [F.when(F.col("state").isin(*r.states) & compile_condition(r.condition), F.lit(r.name)) for r in ordered]
    return contexts.withColumn("scenario", F.coalesce(*due) if due else F.lit(None).cast("string"))


def shadowed_rules(spark: SparkSession, rules: list[Scenario]) -> DataFrame:
    """(state, name): rules that can never win in a state, standing below one without condition."""
    rows = [(r.name, s, r.priority, i, r.condition is None) for i, r in enumerate(rules) if r.enabled for s in r.states]
    t = spark.createDataFrame(rows, "name string, state string, priority int, place int, open boolean")
    above = F.max("open").over(Window.partitionBy("state").orderBy(F.desc("priority"), "place").rowsBetween(Window.unboundedPreceding, -1))
    return t.withColumn("below", F.coalesce(above, F.lit(False))).where("below").select("state", "name")
