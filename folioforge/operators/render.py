"""Paragraphs with confirmed readings to book markdown and the small files beside it."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx

#: What stands before a paragraph of a role.
PREFIX = {"ChapterTitle": "# ", "SectionTitle": "## ", "SectionNumber": "## "}


def compose(paragraphs: DataFrame, annotations: DataFrame, keys: list[str]) -> DataFrame:
    """paragraphs (keys, plain_text, ...) with inlines, array<struct<text, reading>>, reading null for plain text.

    annotations: (keys, start, length, base_text, reading, status); only Confirmed ones count.  They must not overlap and must
    repeat the text at their place, else the query fails.  A paragraph's annotations are as few as its characters, so that
    they are collected in one row.
    """
    one = F.struct("start", "length", "base_text", F.col("reading").alias("r"))
    marks = annotations.where(F.col("status") == "Confirmed").groupBy(*(F.col(k).alias(f"_{k}") for k in keys)).agg(F.array_sort(F.collect_list(one)).alias("_marks"))
    same = [F.col(k) == F.col(f"_{k}") for k in keys]
    on = same[0]
    for s in same[1:]:
        on = on & s
    t = F.col("plain_text")
    both = paragraphs.join(marks, on, "left").drop(*(f"_{k}" for k in keys)).withColumn("_marks", F.coalesce("_marks", F.array().cast("array<struct<start:int,length:int,base_text:string,r:string>>")))
    m = F.col("_marks")
    end = lambda i: F.when(i == 0, 0).otherwise(F.get(m, i - 1)["start"] + F.get(m, i - 1)["length"])
    good = F.forall(F.transform(m, lambda r, i: (r["start"] >= end(i)) & tx.unit_slice(t, r["start"], r["length"]).eqNullSafe(r["base_text"])), lambda ok: ok)
    plain = lambda a, b: F.struct(tx.unit_slice(t, a, b - a).alias("text"), F.lit(None).cast("string").alias("reading"))
    pairs = F.transform(m, lambda r, i: F.array(plain(end(i), r["start"]), F.struct(r["base_text"].alias("text"), r["r"].alias("reading"))))
    runs = F.filter(F.concat(F.flatten(pairs), F.array(plain(end(F.size(m)), tx.units(t)))), lambda x: (x["text"] != "") | x["reading"].isNotNull())
    return both.withColumn("inlines", F.when(good, runs).otherwise(F.raise_error(F.lit("confirmed readings must not overlap and must match the text")))).drop("_marks")


def paragraph_markdown(role: Column, inlines: Column) -> Column:
    """A paragraph and the blank line after it."""
    run = lambda x: F.when(x["reading"].isNull(), tx.markdown_escape(x["text"])).otherwise(F.concat(F.lit("{"), tx.ruby_escape(x["text"]), F.lit("|"), tx.ruby_escape(x["reading"]), F.lit("}")))
    prefix = F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for kv in PREFIX.items() for x in kv)), role), F.lit(""))
    return F.when(role == "SceneBreak", "***\n\n").otherwise(F.concat(prefix, F.array_join(F.transform(inlines, run), ""), F.lit("\n\n")))


def picture_markdown(file_name: Column, alt: Column, caption: Column, listed: bool) -> Column:
    """A picture and the blank line after it; as a figure with a caption if pictures are listed."""
    if not listed:
        return F.concat(F.lit("!["), tx.alt_escape(alt), F.lit("]("), file_name, F.lit(")\n"), F.when(tx.is_blank(caption), "").otherwise(F.concat(tx.markdown_escape(caption), F.lit("\n"))), F.lit("\n"))
    words = F.when(tx.is_blank(caption), alt).otherwise(caption)
    return F.concat(
        F.lit('<figure class="illustration">\n  <img src="'), tx.html_escape(file_name), F.lit('" alt="'), tx.html_escape(alt), F.lit('">\n  <figcaption>'),
        tx.html_escape(words), F.lit("</figcaption>\n</figure>\n\n"),
    )


def books(blocks: DataFrame, keys: list[str], order: str, markdown: str) -> DataFrame:
    """(keys, content): blocks put together in order; keys are the book, or the book and its chapter."""
    rows = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(markdown).alias("m"))))
    return blocks.groupBy(*keys).agg(F.array_join(F.transform(rows, lambda r: r["m"]), "").alias("content"))


def chapter_name(chapter: Column) -> Column:
    """chapter-001.md for chapter 0; longer numbers keep all digits."""
    n = (chapter + 1).cast("string")
    return F.concat(F.lit("chapter-"), F.when(F.length(n) < 3, F.lpad(n, 3, "0")).otherwise(n), F.lit(".md"))


def reading_conflicts(inlines: DataFrame, approved: DataFrame, book: str) -> DataFrame:
    """(book, base, readings): approved readings (book, base, reading) that a book's own (book, base, reading) contradict."""
    own = inlines.groupBy(F.col(book).alias("_b"), F.col("base").alias("_base")).agg(F.count_distinct("reading").alias("readings"), F.min("reading").alias("_one"))
    both = approved.join(own, (F.col(book) == F.col("_b")) & (F.col("base") == F.col("_base")))
    return both.where((F.col("readings") != 1) | (F.col("_one") != F.col("reading"))).select(book, "base", "readings")


def dictionary(approved: DataFrame, book: str) -> DataFrame:
    """(book, content): the approved readings as CSV lines, ordered by base text."""
    line = F.concat(tx.csv_field(F.col("base")), F.lit(","), tx.csv_field(F.col("reading")), F.lit("\n"))
    rows = F.array_sort(F.collect_list(F.struct(F.col("base").alias("b"), line.alias("l"))))
    return approved.groupBy(book).agg(F.array_join(F.transform(rows, lambda r: r["l"]), "").alias("content"))


@dataclass(frozen=True)
class BookOptions:
    title: str
    creator: str
    language: str = "ja"
    vertical: bool = True
    title_page: bool = True
    contents: bool = True
    contents_depth: int = 2
    auto_upright: bool = True
    upright_digits: int = 2
    skip_cover: bool = True
    landmarks: bool = False
    list_pictures: bool = False

    def __post_init__(self):
        if not self.title.strip() or not self.creator.strip():
            raise ValueError("a book has a title and a creator")
        if not 1 <= self.contents_depth <= 6 or self.upright_digits < 2:
            raise ValueError("the contents go 1 to 6 deep, upright digits are two or more")

    def yaml(self, quoted) -> str:
        """The converter's settings; quoted makes a YAML scalar of a text."""
        on = lambda b: str(b).lower()
        return "\n".join([
            "ddconvVersion: 1.0", "titles:", f"  - content: {quoted(self.title.strip())}", "creators:", f"  - content: {quoted(self.creator.strip())}", "    role: aut",
            f"language: {quoted(self.language.strip() or 'ja')}", f"pageDirection: {'rtl' if self.vertical else 'ltr'}", "options:", f"  skipCover: {on(self.skip_cover)}", f"  titlepage: {on(self.title_page)}",
            f"  tocInSpine: {on(self.contents)}", f"  tocDisplayDepth: {self.contents_depth}", f"  displayLandmarksNav: {on(self.landmarks)}", f"  displayLoiNav: {on(self.list_pictures)}",
            f"  autoTcy: {on(self.auto_upright)}", f"  tcyDigit: {self.upright_digits}",
        ])

    def css(self) -> str:
        return f'@charset "UTF-8";\nbody {{ writing-mode: {"vertical-rl" if self.vertical else "horizontal-tb"}; }}\nruby rt {{ font-size: 0.5em; }}'


def yaml_scalar(text: str) -> str:
    """The same as functions.text.yaml_quote, for a parameter."""
    named = {"\\": "\\\\", '"': '\\"', "\r": "\\r", "\n": "\\n", "\t": "\\t"}
    return '"' + "".join(named.get(c) or (f"\\u{ord(c):04X}" if ord(c) < 32 or 127 <= ord(c) < 160 else c) for c in text) + '"'
