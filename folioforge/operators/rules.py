"""Validation rules and summaries: each rule is rows of issues, a gate is a count of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def issues(df: DataFrame, keys: list[str], rules: dict[str, Column]) -> DataFrame:
    """(keys, code): a row for each rule that holds for a row of df; one pass, no shuffle."""
    codes = F.array_compact(F.array(*(F.when(cond, F.lit(code)) for code, cond in rules.items())))
    return df.select(*keys, F.explode(codes).alias("code"))


def sequence_issues(df: DataFrame, group: str, order: str, number: str) -> DataFrame:
    """(group, order, code): NonNumeric, Duplicate, Gap and Reversal of printed numbers.

    Only ASCII digits within 32 bits are numbers; gaps and reversals are against the numeric row before.
    """
    n = F.when(F.col(number).rlike("^[0-9]+$"), F.expr(f"try_cast({number} as int)"))
    d = df.withColumn("_n", n)
    w = Window.partitionBy(group).orderBy(order)
    num = d.where("_n is not null").withColumn("_was", F.lag("_n").over(w)).withColumn("_same", F.count("*").over(Window.partitionBy(group, "_n")))
    a = issues(d, [group, order], {"NonNumeric": F.col("_n").isNull()})
    b = issues(num, [group, order], {"Duplicate": F.col("_same") > 1, "Gap": F.col("_n") > F.col("_was") + 1, "Reversal": F.col("_n") < F.col("_was")})
    return a.unionByName(b)


def resume_targets(df: DataFrame, status: str, included: Column, mode: str) -> DataFrame:
    """The rows a run takes: all of them, or those included that are not yet done."""
    if mode == "ResumeIncomplete":
        return df.where(included & F.col(status).isin("NotProcessed", "Failed", "Processing"))
    if mode not in ("Selected", "ReprocessAll"):
        raise ValueError(f"unknown mode {mode}")
    return df


def classified(df: DataFrame, cases: dict[str, Column], rest: str) -> DataFrame:
    """(outcome, n): rows counted by the first case that holds."""
    items = list(cases.items())
    pick = F.when(items[0][1], items[0][0])
    for name, cond in items[1:]:
        pick = pick.when(cond, name)
    return df.groupBy(pick.otherwise(rest).alias("outcome")).agg(F.count("*").alias("n"))


def multiple_readings(df: DataFrame, base: str, reading: str) -> DataFrame:
    """(base, readings, listed): bases with more than one distinct reading, listed in order."""
    g = df.groupBy(base).agg(F.array_sort(F.collect_set(reading)).alias("_s"))
    return g.where(F.size("_s") > 1).select(base, F.size("_s").cast("long").alias("readings"), F.array_join("_s", "|").alias("listed"))


def history(batches: DataFrame, annotations: DataFrame, key: str, kind: str, kinds: dict[str, str], group: str, order: list[str]) -> DataFrame:
    """batches with the number of their annotations, in all and by kind, and whether each is its group's newest with any."""
    counts = annotations.groupBy(F.col(key).alias("_k")).agg(F.count("*").alias("total"), *(F.count_if(F.col(kind) == v).alias(n) for n, v in kinds.items()))
    both = batches.join(counts, F.col(key) == F.col("_k"), "left").drop("_k")
    both = both.withColumns({n: F.coalesce(n, F.lit(0)).cast("long") for n in ("total", *kinds)})
    newest = both.where("total > 0").groupBy(F.col(group).alias("_g")).agg(F.max_by(key, F.struct(*order)).alias("_top"))
    return both.join(newest, F.col(group) == F.col("_g"), "left").withColumn("current", F.coalesce(F.col("_top") == F.col(key), F.lit(False))).drop("_g", "_top")
