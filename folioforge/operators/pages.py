"""Pages: order, edits, crops, and the tables that follow them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from .state import numbered

#: Roles without body text, statuses that a new recognition makes stale.
PICTURES = ("Illustration", "Blank")
TOUCHED = ("ManuallyEdited", "ExportedForProofreading", "Confirmed", "Stale")


def ordered(pages: DataFrame, name: str, times: list[str], tie: str) -> DataFrame:
    """pages numbered from 0 in column position: by the time in the file name, else the first of times that is there, else first of all; then by name in natural order."""
    key = pages.withColumn("_at", F.coalesce(tx.filename_time(F.col(name)), *times)).withColumn("_name", tx.natural_key(F.col(name)))
    return numbered(key, ["_at", "_name", tie], "position").drop("_at", "_name")


def body(pages: DataFrame) -> DataFrame:
    return pages.where(F.col("included") & ~F.col("role").isin(*PICTURES))


def in_document(role: Column, text: Column) -> Column:
    """Whether a page gives the document text."""
    return ~role.isin(*PICTURES) & ~tx.is_blank(text)


def swapped(pages: DataFrame, moves: DataFrame, book: str, position: str) -> DataFrame:
    """pages after a move (book, source, target) at most one a book: the page at source and the one at target, held within the book, change places."""
    size = pages.groupBy(F.col(book).alias("_b")).agg(F.count("*").alias("_n"))
    m = moves.select(F.col(book).alias("_m"), F.col("source").alias("_from"), F.col("target").alias("_to")).join(size, F.col("_m") == F.col("_b"))
    m = m.withColumn("_to", F.greatest(F.lit(0), F.least(F.col("_to"), F.col("_n") - 1))).where((F.col("_from") >= 0) & (F.col("_from") < F.col("_n"))).drop("_b", "_n")
    at = F.col(position)
    new = F.when(at == F.col("_from"), F.col("_to")).when(at == F.col("_to"), F.col("_from")).otherwise(at)
    return pages.join(m, F.col(book) == F.col("_m"), "left").withColumn(position, new).drop("_m", "_from", "_to")


def rotated(rotation: Column, degrees: int) -> Column:
    if degrees % 90:
        raise ValueError("pages turn by quarters")
    return F.pmod(rotation + degrees, F.lit(360))


def crop_of(left: Column, top: Column, right: Column, bottom: Column) -> Column:
    """struct<left, top, right, bottom> between 0 and 1 from four margins in per cent; null if a margin is negative or two opposite ones reach 100."""
    good = (F.least(left, top, right, bottom) >= 0) & (left + right < 100) & (top + bottom < 100)
    return F.when(good, F.struct((left / 100).alias("left"), (top / 100).alias("top"), (1 - right / 100).alias("right"), (1 - bottom / 100).alias("bottom")))


def crop_box(crop: Column, width: Column, height: Column) -> Column:
    """struct<x, y, w, h> in pixels: the origin rounded down, the far side up, within the image, at least one pixel; null without a crop."""
    def side(low, high, size):
        first = F.greatest(F.lit(0), F.least(F.floor(crop[low] * size), size - 1))
        return first, F.greatest(F.lit(1), F.least(F.ceil(crop[high] * size), size) - first)

    (x, w), (y, h) = side("left", "right", width), side("top", "bottom", height)
    return F.when(crop.isNotNull(), F.struct(x.cast("long").alias("x"), y.cast("long").alias("y"), w.cast("long").alias("w"), h.cast("long").alias("h")))


def upserted(old: DataFrame, new: DataFrame, key: str, insert_only: list[str]) -> DataFrame:
    """old with new's rows put in: a known key takes new's values, nulls too, but for the insert_only columns, which keep what they had."""
    o, n = old.withColumn("_o", F.lit(True)).alias("o"), new.withColumn("_n", F.lit(True)).alias("n")
    pick = lambda c: F.when(F.col("n._n").isNull() | (F.col("o._o").isNotNull() & F.lit(c in insert_only)), F.col(f"o.{c}")).otherwise(F.col(f"n.{c}"))
    both = o.join(n, F.col(f"o.{key}") == F.col(f"n.{key}"), "full")
    return both.select(*(F.coalesce(f"n.{c}", f"o.{c}").alias(c) if c == key else pick(c).alias(c) for c in old.columns))


def replaced(old: DataFrame, new: DataFrame, part: str, parts: DataFrame) -> DataFrame:
    """old without the rows of parts (part), and new's."""
    return old.join(parts.select(F.col(part).alias("_p")).distinct(), F.col(part) == F.col("_p"), "left_anti").unionByName(new)


def with_overrides(words: DataFrame, overrides: DataFrame, page: str) -> DataFrame:
    """words (page, word_key, role, included, ...) with what was set by hand for the same word (page, word_key, role, included); automatic_role keeps the found one."""
    o = overrides.select(F.col(page).alias("_p"), F.col("word_key").alias("_k"), F.col("role").alias("_role"), F.col("included").alias("_in"))
    both = words.join(o, (F.col(page) == F.col("_p")) & (F.col("word_key") == F.col("_k")), "left")
    return both.withColumns({"automatic_role": F.col("role"), "manual_override": F.col("_k").isNotNull(), "role": F.coalesce("_role", "role"), "included": F.coalesce("_in", "included")}).drop("_p", "_k", "_role", "_in")


def status_after_recognition(status: Column, reviews: Column) -> Column:
    return F.when(status.isin(*TOUCHED), "Stale").when(reviews > 0, "ReviewRequired").otherwise("Draft")


def range_of(pages: DataFrame, book: str, position: str, included: Column, start: int, n: int) -> DataFrame:
    """n of each book's included pages from the start-th, counted from 1."""
    w = Window.partitionBy(book).orderBy(position)
    return pages.where(included).withColumn("_i", F.row_number().over(w)).where(F.col("_i").between(start, start + n - 1)).drop("_i")


def image_key(source_hash: Column, crop: Column, rotation: Column) -> Column:
    """The name under which a page's prepared picture is kept: a hash of its source, crop and rotation; null for a rotation that is no quarter."""
    parts = F.concat_ws("|", source_hash, *(_shortest(crop[c]) for c in ("left", "top", "right", "bottom")), rotation.cast("string"))
    return F.when(rotation.isin(0, 90, 180, 270), tx.text_hash(parts))


def _shortest(number: Column) -> Column:
    """A number in as few digits as tell it, whole ones without a fraction."""
    return F.regexp_replace(number.cast("double").cast("string"), r"\.0$", "")
