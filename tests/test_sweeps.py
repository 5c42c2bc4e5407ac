"""Overlaps by sweep and pieces, boxes by grid, against all pairs."""

import random

import pytest
from pyspark.sql import functions as F

from folioforge.operators import grid, layout, ranges


def spans(seed, n, reach, longest):
    rng = random.Random(seed)
    return [(rng.choice(["x", "y", None]), i, rng.randint(0, reach), rng.choice([0, 0, 1, 1, 2, 3, longest])) for i in range(n)]


def meet(a, b):
    return a[0] == b[0] and a[2] < b[2] + b[3] and b[2] < a[2] + a[3]


@pytest.mark.parametrize(("seed", "reach", "longest"), [(1, 200, 5), (2, 30, 9), (3, 2**31 - 50, 40), (4, 300, 250)])
def test_overlaps(spark, seed, reach, longest):
    rows = spans(seed, 150, reach, longest) + [("x", 900, 2**31 - 9, 8), ("x", 901, 2**31 - 9, 8), ("x", 902, 0, 2**31 - 2)]
    d = spark.createDataFrame(rows, "g string, id long, start int, length int").repartition(3)
    got = [(r.g, r.earlier, r.later) for r in ranges.overlaps(d, ["g"], "id", "start", "length").collect()]
    want = {(a[0], a[1], b[1]) for a in rows for b in rows if a[1] < b[1] and meet(a, b)}
    assert len(got) == len(set(got)) and set(got) == want


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_best_overlapping(spark, seed):
    rows, others = spans(seed, 120, 150, 20), [(g, i + 60, s, n) for g, i, s, n in spans(seed + 10, 120, 150, 20)]
    a, b = (spark.createDataFrame(r, "g string, id long, start int, length int") for r in (rows, others))
    for best, pick in ((F.min, min), (F.max, max)):
        got = {r.id: r.best for r in ranges.best_overlapping(a, b, ["g"], ["id"], "start", "length", "id", best).collect()}
        assert got == {x[1]: pick(m) for x in rows if (m := [y[1] for y in others if meet(x, y)])}


def test_ranges_of_nothing(spark):
    none = spark.createDataFrame([], "g string, id long, start int, length int")
    assert ranges.overlaps(none, ["g"], "id", "start", "length").count() == 0
    assert ranges.best_overlapping(none, none, ["g"], ["id"], "start", "length", "id").count() == 0
    one = spark.createDataFrame([("x", 1, None, 3), ("x", 2, 1, None), (None, 3, 1, 1)], none.schema)
    assert ranges.overlaps(one, ["g"], "id", "start", "length").count() == 0


def test_many_ranges_of_one_paragraph(spark):
    """200,000 ranges that do not meet, and one that covers a thousand of them: no pairs are made but real ones."""
    d = spark.range(200_000).select(F.lit("p").alias("g"), "id", (F.col("id") * 3).alias("start"), F.lit(3).alias("length"))
    assert ranges._not_alone(ranges._placed(d, ["g"], "start", "length")).count() == 0
    assert ranges.overlaps(d, ["g"], "id", "start", "length").count() == 0
    over = d.union(spark.sql("SELECT 'p', 200000L, 300L, 3000"))
    found = ranges.overlaps(over, ["g"], "id", "start", "length")
    assert found.count() == 1000 and found.agg(F.min("earlier"), F.max("earlier")).first() == (100, 1099)


def boxes(seed, pages, most, size):
    rng, out = random.Random(seed), []
    for p in range(pages):
        for i in range(rng.randint(0, most)):
            left, top = rng.uniform(0, size), rng.uniform(0, size)
            w, h = rng.choice([(0, 5), (4, 4), (10, 12), (9, 40), (30, 90), (size * 2, 3), (5, size)])
            out.append((p, i, rng.choice(["字", "、", "よみ", ""]), left, top, left + w, top + h))
    return out


SCHEMA = "page int, id long, text string, left double, top double, right double, bottom double"


@pytest.mark.parametrize("seed", [1, 2])
def test_boxes_meet_once(spark, seed):
    rows = boxes(seed, 3, 90, 150)
    d = spark.createDataFrame([*rows, (0, 999, "null", None, 1.0, 2.0, 3.0)], SCHEMA)
    side = layout._grown(d, "page", F.lit(0.0), ["id", "left", "top", "right", "bottom"])
    got = [(r.page, r.a.id, r.b.id) for r in grid.meeting(side, side, F.lit(True)).collect()]
    want = {(a[0], a[1], b[1]) for a in rows for b in rows if a[0] == b[0] and a[3] <= b[5] and b[3] <= a[5] and a[4] <= b[6] and b[4] <= a[6]}
    assert len(got) == len(set(got)) and set(got) == want


@pytest.mark.parametrize("seed", [3, 4])
def test_a_grid_finds_what_all_pairs_find(spark, monkeypatch, seed):
    d = spark.createDataFrame(boxes(seed, 4, 120, 200), SCHEMA).repartition(3)
    aids, bodies = d.where("id % 3 = 0"), d.where("id % 3 <> 0")

    def found():
        return {tuple(r) for r in layout.thin_boxes(d, "page").collect()}, {(r.page, r.id, r.body, round(r.confidence, 9)) for r in layout.nearest_links(aids, bodies, "page").collect()}

    few = found()
    monkeypatch.setattr(layout, "CROWDED", 0)
    many = found()
    assert few == many
    assert len(few[0]) < d.count() and few[1]


def test_a_page_of_very_many_boxes(spark):
    """One page of 100,000 boxes: near pairs are looked at, not ten thousand million."""
    d = spark.range(100_000).select(F.lit(1).alias("page"), "id", F.when(F.col("id") % 10 == 9, "よみ").otherwise("字").alias("text"), ((F.col("id") % 300) * 40.0).alias("left"), (F.floor(F.col("id") / 300) * 30.0).alias("top"))
    d = d.withColumns({"right": F.col("left") + F.when(F.col("id") % 10 == 9, 8.0).otherwise(20.0), "bottom": F.col("top") + 25.0}).repartition(4)
    kept = layout.thin_boxes(d, "page")
    assert kept.where("id % 10 = 9").count() == 0 and kept.count() == 90_000
    links = layout.nearest_links(d.where("id % 10 = 9"), kept, "page")
    assert links.agg(F.count("*"), F.count_if(F.col("body") == F.col("id") - 1)).first() == (9_000 + links.count() - 9_000, links.count())
    assert links.count() > 9_000
