"""Queries of runs, stores, packages and e-books, over events, orders, documents and conversations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import assemble, ebook, loads
from ..sources import archives, store
from ..sources.tables import scratch, table
from ..streaming import loop
from .books import SQL as _BOOKS
from .books import _pages

WAIT = 60


def run_ends(spark, d):
    """Five events a page: its start, an answer of each engine, a cancel for one in seven, the first engine's answer again; some answers are late."""
    e = table(spark, d, "events").select(F.floor(F.col("event_id") / 5).alias("n"), (F.col("event_id") % 5).alias("k"))
    kind = F.when(F.col("k") == 0, "start").when(F.col("k") == 3, F.when(F.col("n") % 7 == 0, "cancel")).otherwise("answer")
    first = F.col("n") * 13 % 80
    after = F.when(F.col("k") == 0, 0).when(F.col("k") == 1, first).when(F.col("k") == 2, first + F.col("n") * 29 % 90).when(F.col("k") == 3, F.col("n") % 100).otherwise(first + 10)
    ok = (F.col("n") + F.col("k")) % 4 != 0
    rows = e.withColumns({"kind": kind, "ok": ok}).where("kind is not null")
    none = F.lit(None).cast("string")
    rows = rows.select(
        F.lit("r").alias("run"), F.col("n").cast("string").alias("page"), "kind", F.when(F.col("k") == 2, loop.SECOND).otherwise(loop.FIRST).alias("engine"), "ok", F.when(F.col("ok"), F.concat(F.lit("w"), "k")).alias("words"), F.when(F.col("ok"), F.concat(F.lit("t"), "n")).alias("text"),
        F.when(~F.col("ok"), "broken").alias("error"), F.when(~F.col("ok"), F.col("n") % 3 == 0).alias("retryable"), F.when(~F.col("ok"), F.when(F.col("n") % 2 == 0, "PaddleOCR").otherwise("Other")).alias("stage"), none.alias("exception"), F.when(F.col("n") % 2 == 0, "Completed").alias("before"),
        F.timestamp_seconds(F.lit(1_700_000_000) + F.col("n") * 1000 + after).alias("at"),
    )
    out = loop.replayed(rows, WAIT)
    return out.select(F.col("page").cast("long").alias("page"), "kind", "words", "text", "error", "retryable", "stage", "cancelled", "status", (F.unix_timestamp("at") - 1_700_000_000 - F.col("page").cast("long") * 1000).alias("took"))


def store_merge(spark, d):
    """Orders in a store: one in ten changes its status, one in a hundred comes again under another key, one in seven goes."""
    s = store.Store(spark, scratch(spark, "store"))
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status"))
    s.commit({"orders": store.Put(o, ["id"]), "log": store.Whole(o.limit(0))})
    s.act(lambda v: {"orders": store.Put(v.read("orders").where("id % 10 = 0").withColumn("status", F.lit("X")), ["id"]), "log": store.Append(v.read("orders").where("id % 10 = 0"))})
    s.commit({"orders": store.Append(o.where("id % 100 = 0").withColumn("id", -F.col("id")))})
    s.commit({"orders": store.Put(o.limit(0), ["id"], o.where("id % 7 = 0").select("id"))})
    return s.read("orders").withColumn("tab", F.lit("orders")).unionByName(s.read("log").withColumn("tab", F.lit("log")))


def package_entries(spark, d):
    """Documents as text files in an archive for each language and source, written and read back."""
    folder = scratch(spark, "packages")
    docs = table(spark, d, "documents").select(F.concat_ws("-", F.lit("p"), "lang", "source").alias("package"), F.format_string("texts/%d.txt", "doc_id").alias("path"), F.col("text").alias("content"))
    archives.write(docs, folder, "zip")
    return archives.read(spark, folder).select("package", "path", F.md5("content").alias("content_md5"))


def ebook_blocks(spark, d):
    """Conversations as books with pictures at pages 1, 4 and 1000: paragraphs and pictures in their order."""
    args = _pages(spark, d), "conv_id", "turn", "text", "join"
    document = loads.Prepared(assemble.paragraphs_of_pages(*args), assemble.source_spans(*args).withColumnRenamed("page", "turn"), None, None)
    pictures = table(spark, d, "conversations").select("conv_id").distinct().select("conv_id", F.posexplode(F.array(*(F.lit(x).cast("long") for x in (1, 4, 1000))))).toDF("conv_id", "number", "turn")
    made = ebook.assembled(document, pictures, "conv_id", F.col("turn"))
    moved = made.issues.select("book", F.col("message").cast("int").alias("picture"), F.lit(True).alias("moved"))
    return made.blocks.join(moved, ["book", "picture"], "left").select(F.col("book").alias("conv_id"), "place", "kind", "block", "picture", F.coalesce("moved", F.lit(False)).alias("moved"))


def book_settings(spark, d):
    """Customers as books with settings, some of them wrong or left out."""
    c = table(spark, d, "customer")
    k = F.col("c_custkey")
    m = c.select(k.alias("book"), F.when(k % 11 == 0, " ").otherwise(F.col("c_name")).alias("title"), F.when(k % 13 != 0, F.col("c_mktsegment")).alias("creator"), F.when(k % 5 != 0, (k % 9).cast("int")).alias("contents_depth"), (k % 4).cast("int").alias("upright_digits"), (k % 40 - 10).cast("string").alias("offset"))
    return ebook.metadata_issues(m, F.col("offset"))


QUERIES = {f.__name__: f for f in (run_ends, store_merge, package_entries, ebook_blocks, book_settings)}

_SPANS = _BOOKS["paragraph_spans"]

SQL = {
    "run_ends": f"""
WITH e AS (SELECT event_id // 5 AS n, event_id % 5 AS k FROM events),
b AS (SELECT b.n, (b.n * 13 % 80) AS p, (b.n + 1) % 4 <> 0 AS pok, (b.n * 13 % 80) + b.n * 29 % 90 AS t, (b.n + 2) % 4 <> 0 AS tok, CASE WHEN b.n % 7 = 0 THEN c.n % 100 END AS stop,
    p.n IS NOT NULL AS hasp, t.n IS NOT NULL AS hast
  FROM e b LEFT JOIN e p ON p.n = b.n AND p.k = 1 LEFT JOIN e t ON t.n = b.n AND t.k = 2 LEFT JOIN e c ON c.n = b.n AND c.k = 3 WHERE b.k = 0),
h AS (SELECT *, hasp AND p <= {WAIT} AND (stop IS NULL OR p <= stop) AS heard FROM b),
a AS (SELECT *, CASE WHEN heard AND pok THEN p END AS asked FROM h),
s AS (SELECT *, coalesce(hast AND asked IS NOT NULL AND t >= asked AND t <= asked + {WAIT} AND (stop IS NULL OR t <= stop), false) AS second FROM a),
o AS (SELECT *, CASE WHEN second THEN t WHEN heard AND NOT pok THEN p END AS over FROM s),
c AS (SELECT *, over IS NULL AND stop IS NOT NULL AND stop <= coalesce(asked, 0) + {WAIT} AS cancelled FROM o),
f AS (SELECT *, CASE WHEN cancelled OR asked IS NULL THEN 'Failed' WHEN second AND tok THEN 'Completed' ELSE 'ReviewRequired' END AS kind, (heard AND NOT pok) OR (second AND NOT tok) AS told FROM c)
SELECT n AS page, kind, CASE WHEN NOT cancelled AND asked IS NOT NULL THEN 'w1' END AS words, CASE WHEN kind = 'Completed' THEN 't' || n END AS text,
  CASE WHEN cancelled THEN 'The operation was canceled.' WHEN kind <> 'Completed' THEN CASE WHEN told THEN 'broken' ELSE 'OCR worker returned no matching response.' END END AS error,
  CASE WHEN kind <> 'Completed' THEN CASE WHEN told THEN n % 3 = 0 ELSE true END END AS retryable, CASE WHEN kind <> 'Completed' THEN CASE WHEN asked IS NOT NULL THEN 'Tesseract' ELSE 'PaddleOCR' END END AS stage,
  cancelled, CASE WHEN cancelled THEN CASE WHEN n % 2 = 0 THEN 'Completed' END ELSE kind END AS status, coalesce(over, CASE WHEN cancelled THEN stop END, coalesce(asked, 0) + {WAIT})::BIGINT AS took FROM f
""",
    "store_merge": """
SELECT o_orderkey AS id, CASE WHEN o_orderkey % 10 = 0 THEN 'X' ELSE o_orderstatus END AS status, 'orders' AS tab FROM orders WHERE o_orderkey % 7 <> 0
UNION ALL SELECT -o_orderkey, o_orderstatus, 'orders' FROM orders WHERE o_orderkey % 100 = 0 AND o_orderkey <> 0
UNION ALL SELECT o_orderkey, o_orderstatus, 'log' FROM orders WHERE o_orderkey % 10 = 0
""",
    "package_entries": "SELECT concat_ws('-', 'p', lang, source) || '.zip' AS package, 'texts/' || doc_id || '.txt' AS path, md5(coalesce(text, '')) AS content_md5 FROM documents",
    "ebook_blocks": f"""
WITH spans AS ({_SPANS}),
reach AS (SELECT conv_id, ordinal AS block, min(page) AS first, max(page) AS last FROM spans GROUP BY 1, 2),
p AS (SELECT DISTINCT conv_id, picture::INTEGER AS picture, pos FROM conversations, (VALUES (0, 1), (1, 4), (2, 1000)) AS t(picture, pos)),
m AS (SELECT p.conv_id, picture, pos, min(block) AS own FROM p LEFT JOIN reach b ON b.conv_id = p.conv_id AND last > pos GROUP BY 1, 2, 3),
w AS (SELECT m.conv_id, picture, own, CASE WHEN own IS NULL THEN 1 ELSE 0 END AS e, CASE WHEN own IS NOT NULL AND pos < first THEN 0 ELSE 2 END AS side, coalesce(pos > first, false) AS moved FROM m LEFT JOIN reach b ON b.conv_id = m.conv_id AND b.block = m.own),
u AS (SELECT conv_id, 0 AS e, block AS b, 1 AS side, 0 AS n, 'paragraph' AS kind, block, NULL::INTEGER AS picture, false AS moved FROM reach
  UNION ALL SELECT conv_id, e, coalesce(own, 0), side, picture, 'picture', NULL, picture, moved FROM w)
SELECT conv_id, (row_number() OVER (PARTITION BY conv_id ORDER BY e, b, side, n) - 1)::INTEGER AS place, kind, block, picture, moved FROM u
""",
    "book_settings": """
WITH m AS (SELECT c_custkey AS book, c_custkey AS k FROM customer)
SELECT book, 'Title' AS code FROM m WHERE k % 11 = 0 UNION ALL SELECT book, 'Creator' FROM m WHERE k % 13 = 0 UNION ALL SELECT book, 'ContentsDepth' FROM m WHERE k % 5 <> 0 AND k % 9 NOT BETWEEN 1 AND 6
UNION ALL SELECT book, 'UprightDigits' FROM m WHERE k % 4 < 2 UNION ALL SELECT book, 'ReadingOffset' FROM m WHERE k % 40 - 10 NOT BETWEEN 0 AND 20
""",
}
