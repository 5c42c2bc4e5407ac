"""Books of many pages: paragraphs, their sources and hashes by ranges of pages, against whole texts."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from folioforge.functions import text as tx
from folioforge.operators import assemble

JOINS = ["DirectJoin", "SpaceJoin", "ParagraphBreak", "SceneBreak", "Uncertain", None]
PIECES = ["\n", "\r", "\r\n", "", " ", "a", "字", "𠮷", "※", "[[CHAPTER:x]]", "[[TITLE:]]", "[[SECTION:二]] ", "[[PAGE:0001]]", "text ", "　"]


def pages(spark, seed, books, most):
    rng, rows = random.Random(seed), []
    for b in range(books):
        for k in range(rng.randint(0, most)):
            text = None if rng.random() < 0.05 else "".join(rng.choice(PIECES) for _ in range(rng.randint(0, 6)))
            rows.append((b, k * 3, text, rng.choice(JOINS)))
    return spark.createDataFrame(rows, "book long, ord int, text string, join string").repartition(3)


def spans_brute(p):
    """Spans from the whole texts: every paragraph against every page of its book."""
    pieces, out = {}, set()
    for r in assemble._pieces(p, "book", "ord", "text", "join").orderBy("book", "ord").collect():
        own = pieces.setdefault(r.book, [])
        low = own[-1][2] if own else 0
        own.append((r.ord, low, low + len(r.piece.encode("utf-16-le")) // 2))
    for r in assemble.paragraphs(assemble.join_pages(p, "book", "ord", "text", "join"), "book").collect():
        end, before = r.start + r.length, max(r.start - 1, 0)
        for page, low, high in pieces[r.book]:
            if r.length and low < end and high > r.start:
                out.add((r.book, r.ordinal, page, max(low, r.start) - r.start, min(high, end) - max(low, r.start)))
            elif not r.length and low <= before < high:
                out.add((r.book, r.ordinal, page, 0, 0))
    return out


@pytest.mark.parametrize(("seed", "most"), [(1, 0), (2, 0), (1, assemble.PAGES)])
def test_ranges_of_pages_give_what_whole_texts_give(spark, monkeypatch, seed, most):
    """With books of any length taken for long, and with all taken for short."""
    monkeypatch.setattr(assemble, "PAGES", most)
    p = pages(spark, seed, 3, 300)
    want = {tuple(r) for r in assemble.paragraphs(assemble.join_pages(p, "book", "ord", "text", "join"), "book").collect()}
    got = [tuple(r) for r in assemble.paragraphs_of_pages(p, "book", "ord", "text", "join").collect()]
    assert len(got) == len(set(got)) and set(got) == want
    spans = [tuple(r) for r in assemble.source_spans(p, "book", "ord", "text", "join").collect()]
    assert len(spans) == len(set(spans)) and set(spans) == spans_brute(p)


def test_ordinals_over_blocks_of_lines(spark, monkeypatch):
    monkeypatch.setattr(assemble, "LINES", 3)
    monkeypatch.setattr(assemble, "PAGES", 0)
    p = pages(spark, 9, 2, 60)
    want = {tuple(r) for r in assemble.paragraphs(assemble.join_pages(p, "book", "ord", "text", "join"), "book").collect()}
    assert {tuple(r) for r in assemble.paragraphs_of_pages(p, "book", "ord", "text", "join").collect()} == want


def test_a_long_book_is_no_single_row_or_task(spark):
    """One book of 300,000 pages: every task of the plan holds a part of it, and offsets run on over the parts."""
    n = 300_000
    p = spark.range(n).select(F.lit(1).alias("book"), F.col("id").alias("ord"), F.format_string("page %06d。\nit goes", "id").alias("text"), F.lit("DirectJoin").alias("join"))
    out = assemble.paragraphs_of_pages(p, "book", "ord", "text", "join")
    row = out.agg(F.count("*").alias("n"), F.max("ordinal").alias("last"), F.max(F.col("start") + F.col("length")).alias("end"), F.max("length").alias("long"), F.count_distinct("ordinal").alias("d")).first()
    assert (row.n, row.last, row.end, row.long, row.d) == (n + 1, n, n * 20, 19, n + 1)
    spans = assemble.source_spans(p, "book", "ord", "text", "join")
    assert spans.count() == 2 * n
    assert sorted(tuple(r) for r in spans.where("ordinal = 150000").select("page", "start", "length").collect()) == [(149_999, 0, 7), (150_000, 7, 12)]


def test_hashes_of_rows_in_order(spark):
    rows = [(b, i, f"line {i} 字") for b in (1, 2, 3) for i in range(200 * b)]
    d = spark.createDataFrame(rows, "book int, i int, t string").repartition(7)
    want = {b: hashlib.sha256("\n".join(t for k, _, t in rows if k == b).encode()).hexdigest().upper() for b in (1, 2, 3)}
    assert {r.book: r.hash for r in assemble.hashed(d, "book", "i", F.col("t")).collect()} == want
    assert assemble.hashed(d.limit(0), "book", "i", F.col("t")).count() == 0
    one = d.where("book = 1").withColumn("t", F.lit(None).cast("string")).limit(1)
    assert assemble.hashed(one, "book", "i", F.col("t")).first().hash == one.select(tx.text_hash(F.lit(""))).first()[0]
