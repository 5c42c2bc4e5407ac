"""Pages to running text, paragraphs and their sources."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..sources.tables import written
from . import state

LINE_END = "\r\n|\r|\n"
#: Lines of a book that are counted together, and pages above which a book is dealt to ranges.
LINES, PAGES = 1 << 16, 1 << 16


def _parted(text: Column, join: Column, last: Column, heading_next: Column, break_next: Column) -> Column:
    """A page's text and what parts it from the next."""
    alone = tx.strip(text).rlike(f"^{tx.HEADINGS}$")
    body = F.when(alone, F.concat(text, F.lit("\n"))).otherwise(text)
    space = F.when(body.rlike(f"[{tx.BLANKS}]$"), "").otherwise(" ")
    between = (
        F.when(last | F.endswith(body, F.lit("\n")) | break_next, "")
        .when(heading_next, "\n")
        .when(join == "SpaceJoin", space)
        .when(join == "ParagraphBreak", "\n")
        .when(join == "SceneBreak", "\n※\n")
        .otherwise("")
    )
    return F.concat(body, between)


def _opens(text: Column) -> tuple[Column, Column]:
    """Whether a page begins with a heading, and with a line feed."""
    return tx.strip(F.regexp_extract(text, r"^([^\r\n]*)", 1)).rlike(f"^{tx.HEADINGS}$"), F.startswith(text, F.lit("\n"))


def _pieces(pages: DataFrame, book: str, order: str, text: str, join: str) -> DataFrame:
    """(book, order, piece): a page's text and what parts it from the next; empty pages are out."""
    w = Window.partitionBy(book).orderBy(order)
    p = pages.where(F.length(text) > 0).withColumn("_next", F.lead(text).over(w))
    piece = _parted(F.col(text), F.col(join), F.col("_next").isNull(), *_opens(F.col("_next")))
    return p.select(F.col(book).alias("book"), F.col(order).alias("ord"), piece.alias("piece"))


def _ordered(column: str) -> Column:
    rows = F.array_sort(F.collect_list(F.struct("ord", column)))
    return F.array_join(F.transform(rows, lambda r: r[column]), "")


def join_pages(pages: DataFrame, book: str, order: str, text: str, join: str) -> DataFrame:
    """(book, text): the pages of each book in order, parted by their boundary rules.

    join is DirectJoin, SpaceJoin, ParagraphBreak, SceneBreak or Uncertain.  One shuffle by book serves the window and the
    aggregation.  Books whose pages are all empty or null have no row.
    """
    return _pieces(pages, book, order, text, join).groupBy("book").agg(_ordered("piece").alias("text")).withColumnRenamed("book", book)


def _heading(line: Column) -> tuple[Column, Column, Column]:
    """(role, content, units before the content) of a line; headings lose their brackets."""
    m = tx.strip(line)
    kind = F.regexp_extract(m, r"^\[\[(CHAPTER|TITLE|SECTION_TITLE|SECTION):.*\]\]$", 1)
    content = F.when(kind != "", F.regexp_extract(m, r"^\[\[[A-Z_]+:(.*)\]\]$", 1)).otherwise(line)
    lead = F.when(kind != "", F.instr(line, "[[") + F.length(kind) + 2).otherwise(0)
    role = (
        F.when(kind.isin("CHAPTER", "TITLE"), "ChapterTitle").when(kind == "SECTION_TITLE", "SectionTitle").when(kind == "SECTION", "SectionNumber")
        .when(m.isin(*tx.SCENE_BREAKS), "SceneBreak").otherwise("BodyParagraph")
    )
    return role, content, lead


def _is_page_mark(line: Column) -> Column:
    return tx.strip(line).rlike(r"^\[\[PAGE:.*\]\]$")


def paragraphs(books: DataFrame, book: str, text: str = "text") -> DataFrame:
    """(book, ordinal, role, plain_text, start, length): lines as paragraphs, with UTF-16 offsets in the book's text.

    Headings lose their brackets, page markers are out, an empty last line is none.  For books that are one text already;
    paragraphs_of_pages() gives the same of pages, whatever the length of a book.
    """
    lines = F.split(text, LINE_END, -1)
    ends = F.regexp_extract_all(text, F.lit(f"({LINE_END})"), F.lit(1))
    rows = F.transform(F.arrays_zip(lines.alias("line"), ends.alias("brk")), lambda r, i: F.struct(i.alias("i"), r["line"].alias("line"), F.coalesce(F.length(r["brk"]), F.lit(0)).alias("gap"), (i + 1 == F.size(lines)).alias("last")))
    each = books.select(F.col(book).alias("book"), F.inline(rows))
    w = Window.partitionBy("book").orderBy("i").rowsBetween(Window.unboundedPreceding, -1)
    each = each.withColumn("at", F.coalesce(F.sum(tx.units(F.col("line")) + F.col("gap")).over(w), F.lit(0)).cast("int"))
    role, content, lead = _heading(F.col("line"))
    kept = each.where(~(F.col("last") & (F.col("line") == "")) & ~_is_page_mark(F.col("line")))
    out = kept.select("book", "i", role.alias("role"), content.alias("plain_text"), (F.col("at") + lead).cast("int").alias("start"), tx.units(content).alias("length"))
    w2 = Window.partitionBy("book").orderBy("i")
    return out.withColumn("ordinal", F.row_number().over(w2) - 1).select(F.col("book").alias(book), "ordinal", "role", "plain_text", "start", "length")


def _carried(rows: DataFrame, sums: dict[str, Column], firsts: dict[str, Column], lasts: dict[str, Column]) -> DataFrame:
    """(book, _part, a column for each): what stands before and after each range of a book, one row a range.

    sums: added up over the ranges before; and over all, as all_<name>.  firsts: of the next range's first row (by ord); lasts:
    of the last row of the range before.
    """
    each = rows.groupBy("book", "_part").agg(*(F.sum(c).alias(n) for n, c in sums.items()), *(F.min_by(c, "ord").alias(n) for n, c in firsts.items()), *(F.max_by(c, "ord").alias(n) for n, c in lasts.items()))
    w = Window.partitionBy("book")
    in_order = w.orderBy("_part")
    before = [(F.sum(n).over(in_order) - F.col(n)).alias(n) for n in sums] + [F.sum(n).over(w).alias(f"all_{n}") for n in sums]
    return each.select("book", "_part", *before, *(F.lead(n).over(in_order).alias(n) for n in firsts), *(F.lag(n).over(in_order).alias(n) for n in lasts))


def _are_long(pages: DataFrame, book: str, text: str) -> bool:
    most = pages.where(F.length(text) > 0).groupBy(book).count().agg(F.max("count")).first()[0]
    return (most or 0) > PAGES


def _lines(pages: DataFrame, book: str, order: str, text: str, join: str, long: bool) -> DataFrame:
    """(book, line, start, text, last, parts): the lines of each book from 0 with their UTF-16 offsets; parts (ord, j, at, n) are their pieces by page.

    A prefix scan in ranges of (book, page): each range counts its own units and line ends in order, the ranges' sums, one
    row each, are added up before them, and what a page must know of its neighbours is carried over the ranges' ends.  So
    neither a book nor its list of pages is ever one row or one task; what a task holds is a range, and a row is a line.
    Where no book is long, a book is one range, and there is nothing to carry.
    """
    heading, feed = _opens(F.col("text"))
    # A carriage return at the end of a piece and a line feed at the beginning of the next are one line end, of both.
    p = pages.where(F.length(text) > 0).select(F.col(book).alias("book"), F.col(order).alias("ord"), F.col(text).alias("text"), F.col(join).alias("join"))
    p = (state.dealt(p, ["book", "ord"]) if long else p.withColumn("_part", F.lit(0))).withColumns({"feed": feed, "opens": F.struct(heading.alias("heading"), feed.alias("feed")), "back": F.endswith("text", F.lit("\r")) & ~tx.strip(F.col("text")).rlike(f"^{tx.HEADINGS}$")})
    w = Window.partitionBy("book", "_part").orderBy("ord")
    both = p.withColumns({"_next": F.lead("opens").over(w), "_was": F.lag("back").over(w)})
    if long:
        near = _carried(p, {}, {"_opens": F.col("opens")}, {"_back": F.col("back")})
        both = both.join(near, ["book", "_part"]).withColumns({"_next": F.coalesce("_next", "_opens"), "_was": F.coalesce("_was", "_back")})
    both = both.withColumn("_was", F.coalesce("_was", F.lit(False)))
    piece = _parted(F.col("text"), F.col("join"), F.col("_next").isNull(), F.col("_next.heading"), F.col("_next.feed"))
    skip = F.when(F.col("_was") & F.col("feed"), 1).otherwise(0)
    cut = both.select("book", "_part", "ord", skip.alias("skip"), (F.col("back") & F.coalesce("_next.feed", F.lit(False))).alias("open"), F.substring(piece, skip + 1, F.length(piece)).alias("piece"))
    cut = cut.withColumns({"_size": (tx.units(F.col("piece")) + F.col("skip")).cast("long"), "_ends": F.regexp_count("piece", F.lit(LINE_END)).cast("long")})
    cut = written(cut, "book-pieces") if long else cut

    up_to, whole = w.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy("book", "_part")
    so_far = cut.withColumns({"at": F.coalesce(F.sum("_size").over(up_to), F.lit(0)), "line": F.coalesce(F.sum("_ends").over(up_to), F.lit(0))})
    if long:
        sums = _carried(cut, {"_size": F.col("_size"), "_ends": F.col("_ends")}, {}, {})
        so_far = so_far.drop("_size", "_ends").join(sums, ["book", "_part"])
    else:
        so_far = so_far.withColumns({"all__ends": F.sum("_ends").over(whole), "_size": F.lit(0), "_ends": F.lit(0)})
    placed = so_far.select("book", "ord", "skip", "open", "piece", (F.col("at") + F.col("_size")).alias("at"), (F.col("line") + F.col("_ends")).alias("line"), "all__ends")
    ends = F.regexp_extract_all("piece", F.lit(f"({LINE_END})"), F.lit(1))
    rows = F.transform(F.split("piece", LINE_END, -1), lambda x, j: F.struct(j.alias("j"), x.alias("text"), tx.units(x).alias("n")))
    each = placed.select(*(c for c in placed.columns if c != "piece"), ends.alias("es"), F.posexplode(rows).alias("_j", "r"))
    # Within a page, what stands before a line is added up in order of the lines.
    inner = Window.partitionBy("book", "ord").orderBy("_j").rowsBetween(Window.unboundedPreceding, -1)
    gap = F.coalesce(F.length(F.get("es", F.col("_j"))), F.lit(0))
    at = F.col("at") + F.col("skip") + F.coalesce(F.sum(F.col("r.n") + gap).over(inner), F.lit(0))
    parts = each.withColumn("_from", at).where(~(F.col("open") & (F.col("_j") == F.size("es"))))
    parts = parts.select("book", (F.col("line") + F.col("_j")).alias("line"), "all__ends", F.struct("ord", F.col("_j").alias("j"), F.col("_from").alias("at"), F.col("r.n").alias("n"), F.col("r.text").alias("text")).alias("part"))
    whole = parts.groupBy("book", "line").agg(F.array_sort(F.collect_list("part")).alias("parts"), F.max(F.col("line") == F.col("all__ends")).alias("last"))
    return whole.select("book", "line", F.col("parts")[0]["at"].alias("start"), F.array_join(F.transform("parts", lambda x: x["text"]), "").alias("text"), "last", F.transform("parts", lambda x: F.struct(x["ord"].alias("ord"), x["at"].alias("at"), x["n"].alias("n"))).alias("parts"))


def _paragraphs_of(lines: DataFrame, long: bool) -> DataFrame:
    """(book, ordinal, role, plain_text, start, length, parts) of lines; the ordinal is counted in blocks of lines and over the blocks."""
    role, content, lead = _heading(F.col("text"))
    kept = lines.where(~(F.col("last") & (F.col("text") == "")) & ~_is_page_mark(F.col("text")))
    p = kept.select("book", "line", F.floor(F.col("line") / LINES).alias("_part"), role.alias("role"), content.alias("plain_text"), (F.col("start") + lead).cast("int").alias("start"), tx.units(content).alias("length"), "parts")
    if not long:
        place = F.row_number().over(Window.partitionBy("book").orderBy("line"))
        return p.withColumn("ordinal", place - 1).drop("_part", "line")
    p = written(p, "book-lines")
    sizes = _carried(p.select("book", "_part", F.col("line").alias("ord")), {"_n": F.lit(1)}, {}, {})
    place = F.row_number().over(Window.partitionBy("book", "_part").orderBy("line"))
    return p.withColumn("_i", place).join(sizes, ["book", "_part"]).withColumn("ordinal", (F.col("_i") + F.col("_n") - 1).cast("int")).drop("_part", "_i", "_n", "all__n", "line")


def paragraphs_of_pages(pages: DataFrame, book: str, order: str, text: str, join: str) -> DataFrame:
    """paragraphs() of what join_pages() gives, without a row or a task that holds a whole book."""
    long = _are_long(pages, book, text)
    out = _paragraphs_of(_lines(pages, book, order, text, join, long), long)
    return out.select(F.col("book").alias(book), "ordinal", "role", "plain_text", "start", "length")


def source_spans(pages: DataFrame, book: str, order: str, text: str, join: str) -> DataFrame:
    """(book, ordinal, page, start, length): which pages each paragraph comes from, as ranges of the paragraph.

    What parts two pages belongs to the first.  An empty paragraph has one empty range, on the page before it.  Each line knows
    its pieces by page, so that paragraphs and pages are not joined.
    """
    long = _are_long(pages, book, text)
    para = _paragraphs_of(_lines(pages, book, order, text, join, long), long)
    end = F.col("start") + F.col("length")
    met = F.filter("parts", lambda x: (x["at"] < end) & (x["at"] + x["n"] > F.col("start")))
    inside = F.transform(met, lambda x: F.struct(x["ord"].alias("page"), (F.greatest(x["at"], F.col("start")) - F.col("start")).cast("int").alias("begin"), (F.least(x["at"] + x["n"], end) - F.greatest(x["at"], F.col("start"))).cast("int").alias("size")))
    # The page before an empty one: that of its line's end before, which its first piece is on, or inside its brackets.
    here = F.filter("parts", lambda x: (x["at"] < F.col("start")) & (x["at"] + x["n"] >= F.col("start")))
    first = F.coalesce(F.get(here, F.lit(0)), F.col("parts")[0])
    empty = F.array(F.struct(first["ord"].alias("page"), F.lit(0).alias("begin"), F.lit(0).alias("size")))
    out = para.select(F.col("book").alias(book), "ordinal", F.inline(F.when(F.col("length") > 0, inside).otherwise(empty)))
    return out.select(book, "ordinal", "page", F.col("begin").alias("start"), F.col("size").alias("length"))


def chapters(blocks: DataFrame, book: str, order: str, opens: Column) -> DataFrame:
    """blocks with chapter, from 0: each block that opens starts a new one, except the first of its book."""
    w = Window.partitionBy(book).orderBy(order)
    first = F.row_number().over(w) == 1
    return blocks.withColumn("_new", F.when(opens & ~first, 1).otherwise(0)).withColumn("chapter", F.sum("_new").over(w)).drop("_new")


def logical_keys(paras: DataFrame, book: str, order: str, page: Column, role: Column) -> DataFrame:
    """paras with logical_key, page:ordinal:role; the ordinal counts the paragraphs of a page, those without one under document."""
    p = paras.withColumn("_page", F.coalesce(page.cast("string"), F.lit("document")))
    w = Window.partitionBy(book, "_page").orderBy(order)
    return p.withColumn("logical_key", F.concat_ws(":", "_page", F.row_number().over(w) - 1, role)).drop("_page")


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The hash of the rows of each book, which come together and in order, parted by line feeds."""
    book, digest = None, None

    def done() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([book, pa.array([digest.hexdigest().upper()])], ["book", "hash"])

    for batch in batches:
        for at, row in enumerate(batch["row"]):
            own = batch["book"].slice(at, 1)
            if digest is None or own != book:
                if digest is not None:
                    yield done()
                book, digest = own, hashlib.sha256()
            else:
                digest.update(b"\n")
            digest.update((row.as_py() or "").encode())
    if digest is not None:
        yield done()


def hashed(rows: DataFrame, book: str, order: str, row: Column) -> DataFrame:
    """(book, hash): upper-case SHA-256 of a text for each row of a book, in order, parted by line feeds.

    A hash goes from one row to the next: a book is one task's work, but its rows are sorted outside of memory and read one
    after the other, so that no book is one row.
    """
    sorted_ = rows.select(F.col(book).alias("book"), F.col(order).alias("ord"), row.alias("row")).repartition("book").sortWithinPartitions("book", "ord").select("book", "row")
    return sorted_.mapInArrow(_hashed, f"book {rows.schema[book].dataType.simpleString()}, hash string").withColumnRenamed("book", book)


def document_hash(paras: DataFrame, book: str, order: str, fields: list[Column]) -> DataFrame:
    """(book, hash): upper-case SHA-256 of the rows in order, fields parted by U+001F and rows by line feeds."""
    return hashed(paras, book, order, F.concat_ws("\u001f", *[F.coalesce(f.cast("string"), F.lit("")) for f in fields]))


def interleave(blocks: DataFrame, pictures: DataFrame, book: str) -> DataFrame:
    """(book, picture, block, place, adjusted): where each picture goes among blocks (book, block, first, last).

    It belongs to the first block whose last page is beyond its own, and goes before it, or after it if the block has begun by
    then; with none it goes to the end.  pictures: (book, picture, at).  adjusted marks a picture inside a block.
    """
    none = F.lit(None)
    b = blocks.select(F.col(book).alias("book"), F.col("last").alias("pos"), F.lit(1).alias("k"), none.cast(pictures.schema["picture"].dataType).alias("picture"), F.struct("block", "first").alias("own"))
    p = pictures.select(F.col(book).alias("book"), F.col("at").alias("pos"), F.lit(0).alias("k"), "picture", none.cast(b.schema["own"].dataType).alias("own"))
    # From the last page back, the blocks that end behind a picture come before it; the least of them is its own.
    back = Window.partitionBy("book").orderBy(F.desc("pos"), "k").rowsBetween(Window.unboundedPreceding, 0)
    own = b.unionByName(p).withColumn("own", F.when(F.col("pos").isNotNull(), F.min("own").over(back))).where("k = 0").select(F.col("book").alias(book), "picture", F.col("pos").alias("at"), "own")
    place = F.when(F.col("own.block").isNull(), "end").when(F.col("at") < F.col("own.first"), "before").otherwise("after")
    return own.select(book, "picture", F.col("own.block").alias("block"), place.alias("place"), F.coalesce(F.col("at") > F.col("own.first"), F.lit(False)).alias("adjusted"))
