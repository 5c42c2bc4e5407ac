"""Overlaps of half-open ranges [start, start + length) in groups, in n log n steps and what is really found.

A sweep by start with the running maximum of the ends parts each group's ranges into clusters; a range alone in its cluster
overlaps none and goes no further.  The others are cut into dyadic pieces: a range is at most two pieces on each
level, and a position lies in one piece of each level, of as many levels as the group's longest range asks for.  So a range meets the positions inside it by equality, exactly, and
neither all pairs of a group nor of a cluster are made.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _right(x: Column, bits: Column) -> Column:
    return F.call_function("shiftright", x, bits)


def _levels() -> Column:
    return F.sequence(F.lit(0), F.col("top"))


def _pieces(low: Column, high: Column) -> Column:
    """The pieces (level, piece) that make up [low, high); none if it is empty."""
    none = F.array().cast("array<struct<level:int,piece:bigint>>")

    def at(i: Column) -> Column:
        first, last = _right(low + F.call_function("shiftleft", F.lit(1).cast("long"), i) - 1, i), _right(high, i)
        one = lambda piece, wanted: F.when((first < last) & wanted, F.array(F.struct(i.alias("level"), piece.alias("piece")))).otherwise(none)
        return F.concat(one(first, F.pmod(first, F.lit(2)) == 1), one(last - 1, F.pmod(last, F.lit(2)) == 1))

    return F.flatten(F.transform(_levels(), at))


def _around(position: Column) -> Column:
    """The pieces that a position lies in."""
    return F.transform(_levels(), lambda i: F.struct(i.alias("level"), _right(position, i).alias("piece")))


def _not_alone(rows: DataFrame) -> DataFrame:
    """The rows (group, low, high, ...) that share their cluster with another one, and top, the last level of their group."""
    order = Window.partitionBy("group").orderBy("low", "high")
    reach = F.max("high").over(order.rowsBetween(Window.unboundedPreceding, -1))
    opened = rows.withColumn("_new", F.when(reach.isNull() | (F.col("low") >= reach), 1).otherwise(0)).withColumn("_next", F.lead("_new").over(order))
    # A piece is never longer than the range it is part of.
    longest = F.max(F.col("high") - F.col("low")).over(Window.partitionBy("group"))
    top = F.floor(F.log2(F.greatest(longest, F.lit(1)))).cast("int")
    return opened.withColumn("top", top).where((F.col("_new") == 0) | (F.col("_next") == 0)).drop("_new", "_next")


def _placed(df: DataFrame, group: list[str], start: str, length: str, **more: Column) -> DataFrame:
    low = F.col(start).cast("long")
    return df.select(F.struct(*group).alias("group"), low.alias("low"), (low + F.col(length)).alias("high"), *(c.alias(n) for n, c in more.items())).where("low is not null and high >= low")


def overlaps(df: DataFrame, group: list[str], id_: str, start: str, length: str) -> DataFrame:
    """(group, earlier, later): ranges of a group that overlap, the smaller id first; ranges of one id are one.

    An empty range overlaps those that it lies inside of.  Of two that overlap, one starts inside the other.
    """
    rows = _not_alone(_placed(df, group, start, length, id=F.col(id_)))
    whole = rows.select("group", "low", "id", F.inline(_pieces(F.col("low"), F.col("high"))))
    begin = rows.select(F.col("group").alias("group2"), F.col("low").alias("low2"), F.col("high").alias("high2"), F.col("id").alias("id2"), F.inline(_around(F.col("low")))).withColumnsRenamed({"level": "level2", "piece": "piece2"})
    same = (F.col("group") == F.col("group2")) & (F.col("level") == F.col("level2")) & (F.col("piece") == F.col("piece2"))
    once = (F.col("id") != F.col("id2")) & ((F.col("low") < F.col("low2")) | ((F.col("id") < F.col("id2")) & (F.col("low2") < F.col("high2"))))
    met = whole.join(begin, same & once)
    return met.select(*(F.col(f"group.{g}").alias(g) for g in group), F.least("id", "id2").alias("earlier"), F.greatest("id", "id2").alias("later"))


def best_overlapping(rows: DataFrame, others: DataFrame, group: list[str], key: list[str], start: str, length: str, value: str, best: Callable[[Column], Column] = F.min) -> DataFrame:
    """(key, best): the smallest value, or what best makes of them, of the others that each of rows overlaps; rows without one are out.

    Each piece keeps the best value of the ranges that it is part of, and of those that start in it, so that no pair is made
    however many overlap.  A row that is among the others meets itself.
    """
    asks = _placed(rows, group, start, length, key=F.struct(*key), value=F.lit(None).cast(others.schema[value].dataType))
    gives = _placed(others, group, start, length, key=F.lit(None).cast(asks.schema["key"].dataType), value=F.col(value))
    swept = _not_alone(asks.withColumn("asks", F.lit(True)).unionByName(gives.withColumn("asks", F.lit(False))))
    low, high = F.col("low"), F.col("high")
    kind = lambda k, pieces: F.transform(pieces, lambda p: F.struct(F.lit(k).alias("kind"), p["level"].alias("level"), p["piece"].alias("piece")))
    # What a range covers; what it covers but for its start, which an empty range must lie behind; where it starts.
    given = swept.where("not asks").select("group", "value", F.inline(F.concat(kind(0, _pieces(low, high)), kind(1, _pieces(low + 1, high)), kind(2, _around(low)))))
    known = given.groupBy("group", "kind", "level", "piece").agg(best(F.col("value")).alias("best"))
    wanted = F.when(high > low, F.concat(kind(0, _around(low)), kind(2, _pieces(low + 1, high)))).otherwise(kind(1, _around(low)))
    asked = swept.where("asks").select("group", "key", F.inline(wanted))
    return asked.join(known, ["group", "kind", "level", "piece"]).groupBy("key").agg(best(F.col("best")).alias("best")).select("key.*", "best")
