"""Boxes of a page that meet, by cells of a grid whose levels follow the boxes' sizes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Levels of cells, each twice as large as the one below.
LEVELS = 40


def _sized(boxes: DataFrame, units: DataFrame) -> DataFrame:
    """boxes (page, row, l, t, r, b) with their page's unit and the level whose cells are as large as they are."""
    both = boxes.join(units, "page")
    times = F.greatest((F.col("r") - F.col("l")) / F.col("ux"), (F.col("b") - F.col("t")) / F.col("uy"))
    return both.withColumn("own", F.least(F.greatest(F.ceil(F.log2(F.greatest(times, F.lit(1.0)))), F.lit(0)), F.lit(LEVELS)).cast("int"))


def _cell(value: Column, unit: Column, level: Column) -> Column:
    return F.floor(value / (unit * F.pow(F.lit(2.0), level)))


def _celled(sized: DataFrame, deepest: DataFrame) -> DataFrame:
    """Each box in its cells, four at most on each level from its own to the page's last."""
    levels = F.transform(F.sequence(F.col("own"), F.col("top")), lambda k: k)
    rows = sized.join(deepest, "page").select("page", "row", "l", "t", "r", "b", "ux", "uy", "own", F.explode(levels).alias("level"))
    span = lambda low, high, unit: F.sequence(_cell(F.col(low), F.col(unit), F.col("level")), _cell(F.col(high), F.col(unit), F.col("level")))
    return rows.withColumn("cx", F.explode(span("l", "r", "ux"))).withColumn("cy", F.explode(span("t", "b", "uy")))


def meeting(a: DataFrame, b: DataFrame, condition: Column) -> DataFrame:
    """(page, a, b): the rows of boxes (page, row, l, t, r, b) of a and b that touch and fulfil a condition on a and b, each pair once.

    A page's cells are as large as its boxes on average; a larger box stands in cells of a level of its size, and all others
    stand there, too.  A pair meets on the level of the larger one, in the cell of the upper left corner of what they share.
    Null boxes meet none.  So a page costs its boxes, the levels they are on and the pairs that are near each other.
    """
    whole = lambda df: df.where("l <= r and t <= b")
    a, b = whole(a), whole(b)
    sides = a.select("page", "l", "t", "r", "b").unionByName(b.select("page", "l", "t", "r", "b"))
    mean = lambda low, high: F.greatest(F.avg(F.col(high) - F.col(low)), F.lit(1e-6))
    units = sides.groupBy("page").agg(mean("l", "r").alias("ux"), mean("t", "b").alias("uy"))
    sa, sb = _sized(a, units), _sized(b, units)
    deepest = sa.select("page", "own").unionByName(sb.select("page", "own")).groupBy("page").agg(F.max("own").alias("top"))
    ca = _celled(sa, deepest).select("page", "level", "cx", "cy", "ux", "uy", F.col("own").alias("own_a"), F.col("row").alias("a"), *(F.col(c).alias(f"{c}a") for c in "ltrb"))
    cb = _celled(sb, deepest).select("page", "level", "cx", "cy", F.col("own").alias("own_b"), F.col("row").alias("b"), *(F.col(c).alias(f"{c}b") for c in "ltrb"))
    here = (F.col("level") == F.greatest("own_a", "own_b")) & (F.col("cx") == _cell(F.greatest("la", "lb"), F.col("ux"), F.col("level"))) & (F.col("cy") == _cell(F.greatest("ta", "tb"), F.col("uy"), F.col("level")))
    touch = (F.col("la") <= F.col("rb")) & (F.col("lb") <= F.col("ra")) & (F.col("ta") <= F.col("bb")) & (F.col("tb") <= F.col("ba"))
    return ca.join(cb, ["page", "level", "cx", "cy"]).where(here & touch & condition).select("page", "a", "b")
