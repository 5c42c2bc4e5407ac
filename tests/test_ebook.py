"""E-books from prepared documents: blocks, chapters, files, and what stands against them."""

import pytest
from pyspark.sql import functions as F

from folioforge.functions import text as tx
from folioforge.operators import ebook, loads, render


@pytest.fixture(scope="module")
def made(spark):
    pages = [(1, 0, "[[CHAPTER:一]]\n本文", "DirectJoin"), (1, 2, "続き\n", "DirectJoin"), (1, 4, "[[CHAPTER:二]]\n末尾", "DirectJoin"), (2, 0, "一行", "DirectJoin")]
    p = spark.createDataFrame(pages, "book long, page int, text string, join string")
    known = spark.createDataFrame([], "book long, logical_key string, id string, created long, seq long"), spark.createDataFrame([], "book long, hash string, snapshot string, created long")
    document = loads.prepared(p, "book", "page", "text", "join", *known, F.lit("new"))
    every = p.select("book", "page", F.lit("Body").alias("role"), F.lit(True).alias("included")).union(spark.createDataFrame([(1, 1, "Illustration", True), (1, 3, "Illustration", True), (1, 9, "Illustration", True), (1, 5, "Illustration", False)], "book long, page int, role string, included boolean"))
    pictures = loads.illustrations(every, "book", "page")
    return document, pictures, ebook.assembled(document, pictures, "book", F.col("page"))


def test_blocks_in_order(made):
    got = [(r.book, r.kind, r.block, r.picture) for r in made[2].blocks.orderBy("book", "place").collect()]
    assert got == [
        (1, "paragraph", 0, None), (1, "paragraph", 1, None), (1, "picture", None, 1), (1, "picture", None, 2), (1, "paragraph", 2, None), (1, "paragraph", 3, None), (1, "picture", None, 3), (2, "paragraph", 0, None),
    ]
    assert [(r.book, r.code, r.message) for r in made[2].issues.collect()] == [(1, "PlacementAdjusted", "1")]
    assert sorted(map(tuple, made[2].counts.collect())) == [(1, 4, 3), (2, 1, 0)]


def composed(spark, document):
    text = document.paragraphs.select("book", F.col("ordinal").alias("block"), "role", "plain_text")
    marks = spark.createDataFrame([(1, 1, 0, 2, "本文", "ほんぶん", "Confirmed")], "book long, block int, start int, length int, base_text string, reading string, status string")
    return render.compose(text, marks, ["book", "block"]).select("book", "block", "role", "inlines")


def test_files_of_an_upload_folder(spark, made, tmp_path):
    document, pictures, book = made
    drawn = pictures.select("book", F.col("number").alias("picture"), F.format_string("p%d.png", "number").alias("file_name"), "alt", F.lit(None).cast("string").alias("caption"))
    meta = spark.createDataFrame([(1, " 書名 ", "著者", None, True), (2, "二", "著者", 3, False), (3, "none", "x", 1, True), (4, "", None, 7, True)], "book long, title string, creator string, contents_depth int, split boolean")
    approved = spark.createDataFrame([(1, "本文", "ほんぶん")], "book long, base string, reading string")
    files, issues = ebook.files(book, composed(spark, document), drawn, meta, approved)
    got = {(r.book, r.path): r.content for r in files.collect()}
    assert sorted(got) == [(1, "chapter-001.md"), (1, "chapter-002.md"), (1, "ddconv.yml"), (1, "default.css"), (1, "ruby.csv"), (2, "book.md"), (2, "ddconv.yml"), (2, "default.css")]
    assert got[1, "chapter-001.md"].startswith("# 一\n\n{本文|ほんぶん}続き\n\n![")
    assert got[1, "chapter-001.md"].index("p1.png") < got[1, "chapter-001.md"].index("p2.png")
    assert got[1, "chapter-002.md"].startswith("# 二\n\n末尾\n\n![")
    options = render.BookOptions(" 書名 ", "著者")
    quoted = lambda t: '"' + t + '"'
    assert got[1, "ddconv.yml"] == options.yaml(quoted)
    assert got[1, "default.css"] == options.css()
    assert {(r.book, r.code) for r in issues.collect()} == {(1, "PlacementAdjusted"), (3, "NoContent"), (4, "Title"), (4, "Creator"), (4, "ContentsDepth"), (4, "NoContent")}
    ebook.export(files, f"file://{tmp_path}/out")
    assert (tmp_path / "out/1/upload/chapter-002.md").read_text() == got[1, "chapter-002.md"]
    with pytest.raises(Exception, match="FileExists"):
        ebook.export(files, f"file://{tmp_path}/out")


def test_a_book_that_contradicts_its_approved_readings(spark, made):
    document, pictures, book = made
    drawn = pictures.select("book", F.col("number").alias("picture"), F.lit("p.png").alias("file_name"), "alt", F.lit("c").alias("caption"))
    meta = spark.createDataFrame([(1, "t", "c")], "book long, title string, creator string")
    files, issues = ebook.files(book, composed(spark, document), drawn, meta, spark.createDataFrame([(1, "本文", "other")], "book long, base string, reading string"))
    assert files.count() == 0
    assert {(r.code, r.message) for r in issues.collect()} == {("PlacementAdjusted", "1"), ("ReadingConflict", "本文")}


@pytest.mark.parametrize(("value", "good"), [("0", True), ("20", True), (" 7 ", True), ("+7", True), ("21", False), ("-1", False), ("1.5", False), ("x", False), ("", False), (None, False), ("99999999999999999999", False)])
def test_offsets_of_readings(spark, value, good):
    meta = spark.createDataFrame([(1, "t", "c", value)], "book long, title string, creator string, o string")
    assert (ebook.metadata_issues(meta, F.col("o")).count() == 0) == good


def test_settings_that_are_left_out(spark):
    meta = spark.createDataFrame([(1, "t", "c", "  ", 1)], "book long, title string, creator string, language string, upright_digits int")
    row = ebook.settings(meta).first()
    assert (row.language, row.contents_depth, row.split) == ("ja", 2, True)
    assert [r.code for r in ebook.metadata_issues(meta).collect()] == ["UprightDigits"]
    assert meta.select(tx.yaml_quote(F.lit("a\"b"))).first()[0] == '"a\\"b"'
