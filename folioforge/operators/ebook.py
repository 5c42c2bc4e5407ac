"""E-books: a prepared document and its pictures as blocks, chapters and the files of an upload folder, with what stands against it as rows."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..sources import archives
from . import assemble, loads, render

#: What the settings of a book are where its row leaves them out.
DEFAULTS = {
    "language": "ja", "vertical": True, "title_page": True, "contents": True, "contents_depth": 2, "auto_upright": True, "upright_digits": 2,
    "skip_cover": True, "landmarks": False, "list_pictures": False, "split": True,
}
#: The bounds of the settings, and of the distance of readings from their text in a word-processor document.
DEPTHS, LEAST_DIGITS, OFFSETS = (1, 6), 2, (0, 20)
MOVED = "PlacementAdjusted"


class Book(NamedTuple):
    """blocks (book, place, kind, block, picture), issues (book, code, message), counts (book, paragraphs, pictures)."""

    blocks: DataFrame
    issues: DataFrame
    counts: DataFrame


def settings(metadata: DataFrame) -> DataFrame:
    """metadata (book, title, creator, any of DEFAULTS) with all of DEFAULTS; null and missing ones are filled in."""
    for name, value in DEFAULTS.items():
        given = F.col(name) if name in metadata.columns else F.lit(None).cast("string" if isinstance(value, str) else "boolean" if isinstance(value, bool) else "int")
        metadata = metadata.withColumn(name, F.coalesce(given, F.lit(value)))
    return metadata.withColumn("language", F.when(tx.is_blank(F.col("language")), DEFAULTS["language"]).otherwise(tx.strip(F.col("language"))))


def metadata_issues(metadata: DataFrame, offset: Column | None = None) -> DataFrame:
    """(book, code): what is wrong with each book's settings; offset: a text that must be a whole number of points, if it is given."""
    m = settings(metadata)
    number = F.when(offset.rlike(r"^[ \t\r\n]*[+-]?[0-9]+[ \t\r\n]*$"), F.try_to_number(F.regexp_replace(tx.strip(offset), r"^\+", ""), F.lit("S999999999999999999"))) if offset is not None else None
    rules = {"Title": tx.is_blank(F.col("title")), "Creator": tx.is_blank(F.col("creator")), "ContentsDepth": ~F.col("contents_depth").between(*DEPTHS), "UprightDigits": F.col("upright_digits") < LEAST_DIGITS}
    if number is not None:
        rules["ReadingOffset"] = ~F.coalesce(number.between(*OFFSETS), F.lit(False))
    found = F.array_compact(F.array(*(F.when(wrong, F.lit(code)) for code, wrong in rules.items())))
    return m.select("book", F.explode(found).alias("code"))


def assembled(document: loads.Prepared, pictures: DataFrame, book: str, order: Column) -> Book:
    """A prepared document and its pictures (book, page, number, alt) as blocks in their order.

    order gives the place of a page in its book from its name in the spans, and the same of a picture from its page.  A
    picture goes before the first paragraph that ends on a later page, or after it where that has begun by then, which is an
    issue; with none it goes to the end.
    """
    spans = document.spans.select(F.col(book).alias("book"), "ordinal", order.alias("at"))
    reach = spans.groupBy("book", "ordinal").agg(F.min("at").alias("first"), F.max("at").alias("last"))
    paragraphs = document.paragraphs.select(F.col(book).alias("book"), F.col("ordinal").alias("block"))
    blocks = paragraphs.join(reach.withColumnRenamed("ordinal", "block"), ["book", "block"])
    seen = pictures.select(F.col(book).alias("book"), F.col("number").alias("picture"), order.alias("at"))
    placed = assemble.interleave(blocks, seen, "book")
    none = F.lit(None)
    text = paragraphs.select("book", F.struct(F.lit(0).alias("end"), "block", F.lit(1).alias("side"), F.lit(0).alias("n")).alias("k"), F.lit("paragraph").alias("kind"), "block", none.cast("int").alias("picture"))
    side = F.when(F.col("place") == "before", 0).otherwise(2)
    drawn = placed.select("book", F.struct(F.when(F.col("place") == "end", 1).otherwise(0).alias("end"), F.coalesce("block", F.lit(0)).alias("block"), side.alias("side"), F.col("picture").cast("int").alias("n")).alias("k"), F.lit("picture").alias("kind"), none.cast("int").alias("block"), F.col("picture").cast("int").alias("picture"))
    every = text.unionByName(drawn).withColumn("place", F.row_number().over(Window.partitionBy("book").orderBy("k")) - 1).drop("k")
    moved = placed.where("adjusted").select("book", F.lit(MOVED).alias("code"), F.col("picture").cast("string").alias("message"))
    counts = every.groupBy("book").agg(F.count_if(F.col("kind") == "paragraph").alias("paragraphs"), F.count_if(F.col("kind") == "picture").alias("pictures"))
    return Book(every.select("book", "place", "kind", "block", "picture"), moved, counts)


def chapters(blocks: DataFrame, roles: DataFrame) -> DataFrame:
    """blocks with chapter, from 0: each chapter's title opens one but the first of its book; roles: (book, block, role)."""
    named = blocks.join(roles, ["book", "block"], "left")
    return assemble.chapters(named, "book", "place", F.coalesce(F.col("role") == "ChapterTitle", F.lit(False)))


def settings_file(m: DataFrame) -> DataFrame:
    """(book, path, content) of the converter's settings of each book."""
    line = lambda name, value: F.concat(F.lit(name), value)
    on = lambda c: F.when(F.col(c), "true").otherwise("false")
    quoted = lambda c: tx.yaml_quote(tx.strip(F.col(c)))
    rows = [
        F.lit("ddconvVersion: 1.0"), F.lit("titles:"), line("  - content: ", quoted("title")), F.lit("creators:"), line("  - content: ", quoted("creator")), F.lit("    role: aut"), line("language: ", tx.yaml_quote(F.col("language"))),
        line("pageDirection: ", F.when(F.col("vertical"), "rtl").otherwise("ltr")), F.lit("options:"), line("  skipCover: ", on("skip_cover")), line("  titlepage: ", on("title_page")), line("  tocInSpine: ", on("contents")),
        line("  tocDisplayDepth: ", F.col("contents_depth").cast("string")), line("  displayLandmarksNav: ", on("landmarks")), line("  displayLoiNav: ", on("list_pictures")), line("  autoTcy: ", on("auto_upright")), line("  tcyDigit: ", F.col("upright_digits").cast("string")),
    ]
    return m.select("book", F.lit("ddconv.yml").alias("path"), F.concat_ws("\n", *rows).alias("content"))


def style_file(m: DataFrame) -> DataFrame:
    mode = F.when(F.col("vertical"), "vertical-rl").otherwise("horizontal-tb")
    return m.select("book", F.lit("default.css").alias("path"), F.concat(F.lit('@charset "UTF-8";\nbody { writing-mode: '), mode, F.lit("; }\nruby rt { font-size: 0.5em; }")).alias("content"))


def files(made: Book, paragraphs: DataFrame, pictures: DataFrame, metadata: DataFrame, approved: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(files (book, path, content), issues (book, code, message)) of the upload folder of each book.

    paragraphs: (book, block, role, inlines), as render.compose gives them; pictures: (book, picture, file_name, alt, caption);
    metadata as for settings(); approved: (book, base, reading) for the whole book.  One file for each chapter, or one for the
    book; the settings, the style, and the approved readings where there are any.  A book with an issue other than a moved
    picture has no files: settings that are wrong, nothing to write, readings that the text contradicts, too many files.
    """
    m = settings(metadata)
    roles = paragraphs.select("book", "block", "role")
    rows = chapters(made.blocks, roles).drop("role").join(m.select("book", "split", "list_pictures"), "book")
    rows = rows.join(paragraphs, ["book", "block"], "left").join(pictures, ["book", "picture"], "left")
    drawn = F.when(F.col("list_pictures"), render.picture_markdown(F.col("file_name"), F.col("alt"), F.col("caption"), True)).otherwise(render.picture_markdown(F.col("file_name"), F.col("alt"), F.col("caption"), False))
    text = F.when(F.col("kind") == "picture", drawn).otherwise(render.paragraph_markdown(F.col("role"), F.col("inlines")))
    path = F.when(F.col("split"), render.chapter_name(F.col("chapter"))).otherwise(F.lit("book.md"))
    body = render.books(rows.select("book", path.alias("path"), "place", tx.newlines(text).alias("md")), ["book", "path"], "place", "md")
    readings = render.dictionary(approved, "book").select("book", F.lit("ruby.csv").alias("path"), "content")
    every = body.unionByName(settings_file(m)).unionByName(style_file(m)).unionByName(readings)

    own = paragraphs.select("book", F.inline("inlines")).where("reading is not null").select("book", F.col("text").alias("base"), "reading")
    images = made.counts.select("book", "pictures")
    counted = every.groupBy("book").agg(F.count("*").alias("n")).join(images, "book", "left").select("book", (F.col("n") + F.coalesce("pictures", F.lit(0))).alias("n"))
    wrong = metadata_issues(metadata).withColumn("message", F.lit(None).cast("string"))
    wrong = wrong.unionByName(m.join(made.counts, "book", "left_anti").select("book", F.lit("NoContent").alias("code"), F.lit(None).cast("string").alias("message")))
    wrong = wrong.unionByName(render.reading_conflicts(own, approved, "book").select("book", F.lit("ReadingConflict").alias("code"), F.col("base").alias("message")))
    wrong = wrong.unionByName(counted.where(F.col("n") > archives.MOST_FILES).select("book", F.lit("TooManyFiles").alias("code"), F.col("n").cast("string").alias("message")))
    return every.join(wrong.select("book").distinct(), "book", "left_anti"), wrong.unionByName(made.issues)


def export(written: DataFrame, folder: str) -> None:
    """Writes each book's files below folder, a URI, as book/upload/path; a book that is there already is an error, and nothing is written."""
    archives.write(written.select(F.col("book").cast("string").alias("package"), F.concat(F.lit("upload/"), F.col("path")).alias("path"), "content"), folder, "folder", maxfiles=str(archives.MOST_FILES), maximagebytes=str(archives.MOST_IMAGE))
