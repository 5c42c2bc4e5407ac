"""Boxes of words to reading order.  All conditions on pairs keep the page as an equality, and on crowded pages a cell of it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import grid

#: A box of these characters alone is never taken for a reading aid.
PUNCTUATION = "、。！？…・「」『』（）()［］[]"
NARROW, SCORE_MARGIN, WEIGHT, REACH = 0.85, 0.1, 0.25, 3
#: Boxes of a page up to which all of its pairs are looked at.
CROWDED = 2000


def upper_median(values: Column) -> Column:
    """The element at half the count of the ascending list."""
    return F.element_at(F.array_sort(values), F.floor(F.size(values) / 2).cast("int") + 1)


def _crowded(boxes: DataFrame, page: str) -> bool:
    """Whether some page has so many boxes that not all of its pairs are looked at."""
    most = boxes.groupBy(page).count().agg(F.max("count")).first()[0]
    return (most or 0) > CROWDED


def _grown(boxes: DataFrame, page: str, by: Column, fields: list[str]) -> DataFrame:
    """boxes as rows of a grid join, made wider on both sides."""
    return boxes.select(F.col(page).alias("page"), F.struct(*fields).alias("row"), (F.col("left") - by).alias("l"), F.col("top").alias("t"), (F.col("right") + by).alias("r"), F.col("bottom").alias("b"))


def thin_boxes(boxes: DataFrame, page: str) -> DataFrame:
    """boxes (page, id, text, left, top, right, bottom) without those that look like reading aids.

    Out goes a box narrower than 0.85 of the page's upper median width that has a wider box beside it: overlapping in height,
    no farther off than the median width.  Punctuation stays.  The median is aggregated by page.  On pages of few boxes the
    pairs are a left anti join on the page; where one has more than CROWDED, boxes meet in the cells of a grid.
    """
    width = F.col("right") - F.col("left")
    median = boxes.groupBy(F.col(page).alias("m_page")).agg(upper_median(F.collect_list(width)).alias("median"))
    sized = boxes.join(median, F.col(page) == F.col("m_page")).drop("m_page")
    w = lambda s: F.col(f"{s}.right") - F.col(f"{s}.left")
    gap = F.greatest(F.lit(0.0), F.col("b.left") - F.col("a.right"), F.col("a.left") - F.col("b.right"))
    plain = "[^" + "".join("\\" + c for c in PUNCTUATION) + "]"
    beside = (w("a") < F.col("a.median") * NARROW) & (w("b") > w("a")) & (F.col("a.bottom") > F.col("b.top")) & (F.col("a.top") < F.col("b.bottom")) & (gap <= F.col("a.median"))
    if not _crowded(boxes, page):
        return sized.alias("a").join(boxes.alias("b"), (F.col(f"a.{page}") == F.col(f"b.{page}")) & F.col("a.text").rlike(plain) & beside, "left_anti").drop("median")
    fields = ["id", "left", "top", "right", "bottom", "median"]
    narrow = sized.where((width < F.col("median") * NARROW) & F.col("text").rlike(plain))
    met = grid.meeting(_grown(narrow, page, F.col("median"), fields), _grown(sized, page, F.lit(0.0), fields[1:5]), beside)
    aids = met.select(F.col("page").alias("_p"), *(F.col(f"a.{c}").alias(f"_{c}") for c in fields[:5])).distinct()
    same = (F.col(page) == F.col("_p")) & F.col("id").eqNullSafe(F.col("_id")) & F.col("text").rlike(plain)
    for c in fields[1:5]:
        same = same & (F.col(c) == F.col(f"_{c}"))
    return boxes.join(aids, same, "left_anti")


def link_score(r: str, b: str) -> Column:
    """How far box b is from being the base of box r: null if they share no height or are over three widths apart."""
    c = lambda s, k: F.col(f"{s}.{k}")
    height = lambda s: F.greatest(F.lit(0.0), c(s, "bottom") - c(s, "top"))
    overlap = F.least(c(r, "bottom"), c(b, "bottom")) - F.greatest(c(r, "top"), c(b, "top"))
    gap = F.greatest(F.lit(0.0), c(r, "left") - c(b, "right"), c(b, "left") - c(r, "right"))
    scale = F.greatest(F.lit(1.0), c(r, "right") - c(r, "left"), c(b, "right") - c(b, "left"))
    each = lambda s: height(s) / F.greatest(F.lit(1), F.length(c(s, "text")))
    uneven = F.abs(each(r) - each(b)) / F.greatest(F.lit(1.0), each(r), each(b))
    score = gap / scale + (1 - F.least(F.lit(1.0), overlap / F.least(height(r), height(b)))) * WEIGHT + uneven * WEIGHT
    return F.when((overlap > 0) & (height(r) > 0) & (height(b) > 0) & (gap <= scale * REACH), score)


def nearest_links(aids: DataFrame, bodies: DataFrame, page: str) -> DataFrame:
    """(page, id, body, confidence) for each of aids that one of bodies fits clearly best; others have no row.

    Pairs of a page are scored where they are few, else those that meet in a grid of boxes made wider by as much as a link may
    reach.  The two smallest scores of an aid are kept before and after the shuffle, so that no group of pairs is collected.
    """
    fits = (F.length("b.text") > 0) & link_score("a", "b").isNotNull()
    if _crowded(aids.select(page).unionByName(bodies.select(page)), page):
        fields = ["id", "text", "left", "top", "right", "bottom"]
        reach = F.greatest(F.lit(1.0), F.col("right") - F.col("left")) * REACH
        met = grid.meeting(_grown(aids, page, reach, fields), _grown(bodies, page, reach, fields), fits).withColumnRenamed("page", page)
    else:
        a, b = aids.select(F.col(page).alias("_p"), F.struct(*aids.columns).alias("a")), bodies.select(F.col(page).alias("_q"), F.struct(*bodies.columns).alias("b"))
        met = a.join(b, (F.col("_p") == F.col("_q")) & fits).withColumnRenamed("_p", page)
    pairs = met.select(page, F.col("a.id").alias("id"), F.col("b.id").alias("body"), link_score("a", "b").alias("score"))
    place = F.row_number().over(Window.partitionBy(page, "id").orderBy("score", "body"))
    two = pairs.withColumn("_k", place).where("_k <= 2").groupBy(page, "id").agg(F.min(F.struct("score", "body")).alias("best"), F.max(F.when(F.col("_k") == 2, F.col("score"))).alias("second"))
    out = two.where(f"second is null or abs(second - best.score) >= {SCORE_MARGIN}")
    return out.select(page, "id", F.col("best.body").alias("body"), (1 / (1 + F.col("best.score"))).alias("confidence"))


def reading_order(boxes: DataFrame, page: str, tolerance: float) -> DataFrame:
    """(page, id, column, place): columns from right to left, each read downwards.

    Boxes are taken from the right; one within tolerance of its column's first box joins it, else it opens a column.  Columns
    go by their mean x, members by y.  boxes: (page, id, x, y).
    """
    far = lambda a, nx: (F.size(a) == 0) | (F.abs(F.element_at(a, -1) - nx) > tolerance)
    typed = boxes.select(page, F.col("id").cast("long").alias("id"), F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"), F.col("id").cast("long").alias("ord"))
    # Only the columns' first boxes are kept while going through a page; a box's column is the last one begun at or right of it.
    anchors = F.aggregate(F.array_sort(F.collect_set(-F.col("x"))), F.array().cast("array<double>"), lambda a, nx: F.when(F.size(a) == 0, F.array(nx)).when(far(a, nx), F.concat(a, F.array(nx))).otherwise(a))
    grouped = typed.groupBy(page).agg(anchors.alias("anchors"), F.collect_list(F.struct("x", "y", "ord", "id")).alias("rows"))
    column = lambda r: (F.size(F.filter("anchors", lambda a: a <= -r["x"])) - 1).alias("n")
    each = grouped.select(page, F.inline(F.transform("rows", lambda r: F.struct(column(r), r["x"].alias("x"), r["y"].alias("y"), r["ord"].alias("ord"), r["id"].alias("id")))))
    means = each.groupBy(page, "n").agg(F.avg("x").alias("mean"))
    from pyspark.sql import Window

    ranked = means.withColumn("column", F.row_number().over(Window.partitionBy(page).orderBy(F.desc("mean"), "n")) - 1).drop("mean")
    placed = each.join(ranked, [page, "n"])
    place = F.row_number().over(Window.partitionBy(page, "column").orderBy("y", "ord")) - 1
    return placed.select(page, "id", "column", place.alias("place"))


def page_texts(words: DataFrame, page: str, tolerance: float = 20.0, filtered: bool = True) -> DataFrame:
    """(page, text): the words (page, id, text, left, top, right, bottom) of each page in reading order.

    A column whose first word is lower than that of the column before it, by 8 or by 0.6 of the upper median width, begins a
    paragraph.  filtered takes out thin boxes first; words that were reviewed come without.
    """
    kept = thin_boxes(words, page) if filtered else words
    placed = reading_order(kept.select(page, "id", ((F.col("left") + F.col("right")) / 2).alias("x"), F.col("top").alias("y")), page, tolerance)
    w = kept.select(F.col(page).alias("_p"), F.col("id").cast("long").alias("_id"), "text", "top", (F.col("right") - F.col("left")).alias("width"))
    both = placed.join(w, (F.col(page) == F.col("_p")) & (F.col("id") == F.col("_id")))
    columns = both.groupBy(page, "column").agg(F.array_sort(F.collect_list(F.struct("place", "text", "top", "width"))).alias("ws"))
    rows = columns.groupBy(page).agg(F.array_sort(F.collect_list(F.struct("column", "ws"))).alias("cs"))
    least = F.greatest(F.lit(8.0), upper_median(F.flatten(F.transform("cs", lambda c: F.transform(c["ws"], lambda x: x["width"])))) * 0.6)
    first = lambda i: F.get(F.get(F.col("cs"), i)["ws"], F.lit(0))["top"]
    piece = lambda c, i: F.concat(F.when((i > 0) & (first(i) - first(i - 1) >= least), "\n").otherwise(""), F.array_join(F.transform(c["ws"], lambda x: x["text"]), ""))
    return rows.select(page, F.array_join(F.transform("cs", piece), "").alias("text"))


def low_confidence(words: DataFrame, threshold: float = 0.75) -> DataFrame:
    """The words that need a review."""
    return words.where(F.col("confidence") < threshold)


def reading_aids(words: DataFrame, kept: DataFrame, page: str) -> DataFrame:
    """The distinct words that thin_boxes left out, by value: a word equal to a kept one is none, nulls being equal."""
    value = [page, "text", "confidence", "left", "top", "right", "bottom"]
    return words.select(*value).subtract(kept.select(*value))
