"""Queries of views that put several tables together."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions import word
from ..operators import loads, pages, writers
from ..sources import migrations, worker
from ..sources.tables import table
from .books import _LINES, _PIECES, _pages
from .desk import _PROPOSALS, _proposals, _rendered
from .flows import ANNOTATIONS, _rows, annotations, mapped
from .ledger import _BOXES, _boxes


def _readings(spark, d):
    """Events as readings of the first 200 paragraphs, in batches by user; every range of two characters begins at a multiple of three."""
    e, k = table(spark, d, "events"), F.col("event_id")
    status = mapped({"purchase": "Confirmed", "view": "Proposed", "click": "Stale"}, F.col("event_type"))
    rows = e.select(k.alias("id"), F.col("user_id").alias("batch"), (k % 200).alias("paragraph"), (k % 5 * 3).cast("int").alias("start"), F.lit(2).alias("length"), F.concat(F.lit("r"), F.floor("value") % 3).alias("reading"), F.coalesce(status, F.lit("Rejected")).alias("status"), F.col("ts").alias("updated"))
    batches = e.select(F.col("user_id").alias("batch")).distinct().select("batch", (F.col("batch") % 2).alias("snapshot"), F.lit("x").alias("exported"))
    return rows, batches


def structured_load(spark, d):
    """Documents as paragraphs of two snapshots with the readings that hold; texts of under fourteen characters have none."""
    rows, batches = _readings(spark, d)
    docs = table(spark, d, "documents").select((F.col("doc_id") % 2).alias("snapshot"), F.col("doc_id").alias("paragraph"), F.col("doc_id").alias("ordinal"), F.coalesce("text", F.lit("")).alias("plain_text"))
    long = docs.where("length(plain_text) >= 14").select("paragraph")
    spans = docs.select("snapshot", "paragraph", F.explode(F.array(F.lit(1), F.lit(0))).alias("ordinal"), (F.col("paragraph") * 2).alias("page"), F.lit(0).alias("start"), F.length("plain_text").alias("length"))
    out = loads.structured(docs, spans, rows.join(long, "paragraph", "left_semi"), batches)
    runs = F.concat_ws("|", F.transform("inlines", lambda x: F.concat_ws("/", x["text"], x["reading"])))
    return out.select("snapshot", "paragraph", F.md5(runs).alias("inlines_md5"), F.size("spans").alias("spans"))


def reading_conflicts_by_snapshot(spark, d):
    return loads.effective_readings(*_readings(spark, d))[1]


def batch_load(spark, d):
    """Every third supplier is a batch; lines are its candidates, some with a reading, orders its pages; some batches have neither."""
    a = annotations(spark, d)
    s = table(spark, d, "supplier").where("s_suppkey % 3 = 0").select(F.col("s_suppkey").alias("batch"), (F.col("s_acctbal") < 0).alias("text_stale"))
    some = a.where("id % 100 = 1 and batch % 2 = 0")
    found = some.select("batch", F.col("page").cast("string").alias("marker"), F.col("id").alias("place"), F.when(F.col("id") % 3 == 0, F.concat(F.lit("r"), "paragraph")).alias("reading_candidate"), F.concat(F.lit("t"), "paragraph").alias("ocr_text"), F.lit("b").alias("base"))
    out = loads.batch(s, some.select("batch", F.col("page").cast("string").alias("marker"), "page").distinct(), found)
    keys = F.array_sort(F.map_keys("pages"))
    return out.select("batch", "text_stale", F.concat_ws(" ", keys).alias("markers"), F.concat_ws(" ", F.transform("candidates", lambda c: F.concat_ws(":", c["marker"], c["reading"]))).alias("readings"))


def page_states(spark, d):
    """Orders as pages, lines as words of which some are an older program's; texts of users' events go to the first pages."""
    a, e = annotations(spark, d), table(spark, d, "events")
    words = a.select("page", "id", F.col("paragraph").cast("string").alias("text"), F.when(F.col("id") % 7 == 0, "legacy-merged").otherwise("paddle").alias("engine"), (F.col("id") % 5 != 0).alias("known"))
    last = e.where("event_type = 'view'").groupBy(F.col("user_id").alias("page")).agg(F.max_by(F.col("value").cast("string"), F.struct("ts", "event_id")).alias("text"), F.max("ts").alias("at"))
    versions = e.where("event_type in ('purchase', 'click')").select(F.col("user_id").alias("page"), F.when(F.col("event_type") == "purchase", "Confirmed").otherwise("Manual").alias("kind"), F.col("value").cast("string").alias("text"), F.col("ts").alias("at"), F.col("event_id").alias("seq"))
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("page"), F.col("o_orderpriority").alias("text"))
    out = loads.page_states(o, words, last.select("page", "text", "at"), o.where("page % 3 = 0"), o.where("page % 4 = 0"), versions)
    return out.select("page", "manual", "auxiliary", "suggested", "confirmed", "merged", "n_words", "known")


def preflight(spark, d):
    """Customers as books and their orders as pages, by priority and status."""
    k, o = F.col("o_orderkey"), table(spark, d, "orders")
    roles = mapped({"1-URGENT": "Body", "2-HIGH": "Other", "3-MEDIUM": "Illustration", "4-NOT SPECIFIED": "Blank", "5-LOW": "ChapterTitle"}, F.col("o_orderpriority"))
    pages = o.select(F.col("o_custkey").alias("book"), k.alias("page"), roles.alias("role"), (F.col("o_orderstatus") != "P").alias("included"), F.when(k % 3 != 0, F.when(k % 5 == 0, " ").otherwise("x")).alias("text"), F.when(k % 2 == 0, "x").alias("confirmed"))
    a = annotations(spark, d).join(o.select(k.alias("page"), F.col("o_custkey").alias("book")), "page")
    out = loads.preflight(pages, "book", a.select("book", "status"), a.where("status = 'Rejected' and id % 20 = 1").select("book"), pages.where("role = 'Illustration' and page % 10 = 0"), pages.where("page % 50 = 0").select("book", (F.col("page") % 100 == 0).alias("fatal")))
    return out.withColumn("others", F.concat_ws(" ", "others"))


def evidence_lines(spark, d):
    """Lines as annotations that cite two pages, events as candidates there."""
    a = annotations(spark, d).where("source = 'ImageConfirmed'").select("id", F.array((F.col("paragraph") % 100).cast("string"), (F.col("batch") % 100).cast("string")).alias("markers"), F.concat(F.lit("よ"), F.col("start")).alias("reading"), F.concat(F.lit("b"), F.col("length")).alias("base"))
    e, k = table(spark, d, "events"), F.col("event_id")
    found = e.where("event_id % 3 = 0").select((k % 100).cast("string").alias("marker"), F.concat(F.lit("ヨ"), F.floor(F.col("value") / 2) % 50 + 1).alias("ocr_reading"), F.when(k % 2 == 0, F.concat(F.lit("b"), k % 4 + 1)).alias("candidate_base"), k.cast("double").alias("left"), F.lit(1.0).alias("top"), F.lit(2.0).alias("right"), F.lit(3.0).alias("bottom"), F.lit(0.5).alias("confidence"), F.when(k % 5 != 0, (k % 8) / 8).alias("link"))
    return loads.evidence_lines(a, found)


def reading_candidates(spark, d):
    """Lines as words: first ones are aids, every fifth second word was one until it was put back."""
    b, first, second = _boxes(spark, d), F.col("id") == 1, (F.col("id") == 2) & (F.col("page") % 5 == 0)
    words = b.withColumns({"role": F.when(first, "RubyCandidate").otherwise("Body"), "automatic_role": F.when(first | second, "RubyCandidate").otherwise("Body"), "manual_override": second, "included": ~first})
    return loads.reading_candidates(words, "page").select("page", "id", "returned", "included", "body", F.round("link", 6).alias("link"))


def raw_ordinals(spark, d):
    return loads.raw_ordinals(_boxes(spark, d), "page")


def illustrations(spark, d):
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("book"), F.col("o_orderkey").alias("page"), F.when(F.col("o_orderpriority") == "3-MEDIUM", "Illustration").otherwise("Body").alias("role"), (F.col("o_orderstatus") != "P").alias("included"))
    return loads.illustrations(o, "book", "page").select("book", "page", "alt")


def prepared_document(spark, d):
    """Conversations as books; a third of their paragraphs, and half of the books, are known from before."""
    p = _pages(spark, d).select("conv_id", "turn", "text", "join")
    first = loads.prepared(p, "conv_id", "turn", "text", "join", spark.createDataFrame([], "conv_id long, logical_key string, id string, created long, seq long"), spark.createDataFrame([], "conv_id long, hash string, snapshot string, created long"), F.lit("new"))
    known = first.paragraphs.where("ordinal % 3 = 0").select("conv_id", "logical_key", F.concat(F.lit("p"), "ordinal").alias("id"), F.lit(1).cast("long").alias("created"), F.lit(1).cast("long").alias("seq"))
    documents = first.documents.where("conv_id % 2 = 0").select("conv_id", "hash", F.concat(F.lit("s"), "conv_id").alias("snapshot"), F.lit(1).cast("long").alias("created"))
    out = loads.prepared(p, "conv_id", "turn", "text", "join", known, documents, F.concat(F.lit("new "), "logical_key"))
    value = F.concat_ws(" ", "conv_id", "id")
    return _rows(paragraphs=(out.paragraphs, "logical_key", value), documents=(out.documents, "conv_id", F.concat_ws(" ", "hash", "snapshot")), diverged=(out.diverged, "conv_id", "ordinal"))


def latest_review(spark, d):
    """Customers as projects, orders as batches, lines as annotations."""
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("project"), F.col("o_orderkey").alias("batch"), F.col("o_orderdate").alias("exported"))
    return loads.latest_review(o, annotations(spark, d).select("id", F.col("page").alias("batch")), "project")


def revalidated_import(spark, d):
    rows, paragraphs, batch_pages, candidates = _proposals(spark, d)
    return loads.revalidated(rows, paragraphs, batch_pages, candidates, F.lit("OriginalAndTextConfirmed"), writers.content_id(F.col("batch"), F.col("pos")))


def message_parts(spark, d):
    """Numbers, shares, sets and ids as messages show or files carry them."""
    e, k = table(spark, d, "events"), F.col("event_id")
    json = F.when(k % 3 == 0, F.concat(F.lit('{"batchId": "'), F.concat_ws("-", F.lpad(k.cast("string"), 8, "0"), F.lit("00AA"), F.lit("0000"), F.lit("0000"), F.lit("000000000001")), F.lit('"}'))).when(k % 3 == 1, '{"batchId": "x"}').otherwise("{")
    reasons = F.map_from_arrays(F.array(F.lit("b"), F.lit("a")), F.array(k % 4, k % 6))
    return e.select(
        "event_id", loads.batch_id(json).alias("batch_id"), loads.percent(F.floor("value").cast("long") % 200 / 200).alias("share"), F.concat_ws(";", loads.reason_lines(reasons)).alias("reasons"),
        loads.raise_half_points((k % 30).cast("int"), F.when(k % 10 == 0, 2147483647).otherwise((k % 7 - 3).cast("int"))).alias("raise"), loads.same_set(F.array(k % 3, k % 4), F.array(k % 4, k % 3, k % 5)).alias("same"),
    )


def project_ids(spark, d):
    s = table(spark, d, "supplier")
    return writers.project_ids(s.select(F.col("s_name").alias("book")), s.where("s_suppkey % 4 = 0").select(F.col("s_name").alias("book"), F.concat(F.lit("known-"), "s_suppkey").alias("project")), "book")


QUERIES = {f.__name__: f for f in (structured_load, reading_conflicts_by_snapshot, batch_load, page_states, preflight, evidence_lines, reading_candidates, raw_ordinals, illustrations, prepared_document, latest_review, revalidated_import, message_parts, project_ids)}

_READINGS = """
WITH a AS (SELECT event_id AS id, user_id % 2 AS snapshot, event_id % 200 AS paragraph, event_id % 5 * 3 AS s, 'r' || floor(value)::BIGINT % 3 AS reading, CASE event_type WHEN 'purchase' THEN 1 WHEN 'view' THEN 2 WHEN 'click' THEN 3 END AS rank, ts FROM events),
t AS (SELECT *, min(rank) OVER (PARTITION BY snapshot, paragraph, s) AS best FROM a QUALIFY rank = best),
n AS (SELECT snapshot, paragraph, s, count(DISTINCT reading) AS readings FROM t WHERE rank < 3 GROUP BY 1, 2, 3 HAVING count(DISTINCT reading) > 1),
h AS (SELECT * FROM t WHERE (snapshot, paragraph, s) NOT IN (SELECT (snapshot, paragraph, s) FROM n) QUALIFY row_number() OVER (PARTITION BY snapshot, paragraph, s ORDER BY ts DESC, id DESC) = 1)
"""
#: The columns of boxes, first to last: each box from the right joins the column begun last or begins one.
_COLUMNS = """
o AS (SELECT page, id, x, y, row_number() OVER (PARTITION BY page ORDER BY x DESC, id) AS r FROM pts),
rec AS (SELECT page, id, x, y, r, x AS anchor, 0 AS n FROM o WHERE r = 1
  UNION ALL SELECT o.page, o.id, o.x, o.y, o.r, CASE WHEN abs(rec.anchor - o.x) > 20 THEN o.x ELSE rec.anchor END, rec.n + CASE WHEN abs(rec.anchor - o.x) > 20 THEN 1 ELSE 0 END FROM rec JOIN o ON o.page = rec.page AND o.r = rec.r + 1),
cols AS (SELECT page, n, row_number() OVER (PARTITION BY page ORDER BY avg(x) DESC, n) - 1 AS col FROM rec GROUP BY page, n),
placed AS (SELECT page, id, col, row_number() OVER (PARTITION BY page, col ORDER BY y, id) - 1 AS place FROM rec JOIN cols USING (page, n))
"""
READING_COLUMNS = _BOXES.replace("WITH g", "WITH RECURSIVE g") + ", pts AS (SELECT page, id, (\"left\" + \"right\") / 2 AS x, top AS y FROM x)," + _COLUMNS + 'SELECT page, id, col::INTEGER AS "column", place::INTEGER AS place FROM placed'
_UNTHIN = """
md AS (SELECT page, list_sort(list("right" - "left")) AS w FROM x GROUP BY page),
th AS (SELECT x.*, w[len(w) // 2 + 1] AS median FROM x JOIN md USING (page)),
kp AS (SELECT a.* FROM th a WHERE text = '、' OR NOT ("right" - "left" < median * 0.85 AND EXISTS (
  SELECT 1 FROM x b WHERE b.page = a.page AND b."right" - b."left" > a."right" - a."left" AND a.bottom > b.top AND a.top < b.bottom AND greatest(0, b."left" - a."right", a."left" - b."right") <= a.median))),
pts AS (SELECT page, id, ("left" + "right") / 2 AS x, top AS y FROM kp),"""
WORD_PAGE_TEXTS = _BOXES.replace("WITH g", "WITH RECURSIVE g") + "," + _UNTHIN + _COLUMNS + """,
cw AS (SELECT p.page, col, string_agg(text, '' ORDER BY place) AS t, arg_min(top, place) AS first FROM placed p JOIN kp ON kp.page = p.page AND kp.id = p.id GROUP BY 1, 2),
wd AS (SELECT page, list_sort(list("right" - "left")) AS w FROM kp GROUP BY page),
br AS (SELECT cw.page, col, t, col > 0 AND first - lag(first) OVER (PARTITION BY cw.page ORDER BY col) >= greatest(8, w[len(w) // 2 + 1] * 0.6) AS brk FROM cw JOIN wd USING (page))
SELECT page, string_agg(CASE WHEN brk THEN chr(10) ELSE '' END || t, '' ORDER BY col) AS text FROM br GROUP BY page
"""

SQL = {
    "reading_columns": READING_COLUMNS,
    "word_page_texts": WORD_PAGE_TEXTS,
    "structured_load": _READINGS + """,
p AS (SELECT doc_id % 2 AS snapshot, doc_id AS paragraph, coalesce(text, '') AS t FROM documents),
m AS (SELECT p.*, h.s, reading FROM p JOIN h ON h.snapshot = p.snapshot AND h.paragraph = p.paragraph AND rank = 1 WHERE length(t) >= 14),
q AS (SELECT *, coalesce(lag(s + 2) OVER w, 0) AS was, lead(s) OVER w IS NULL AS last FROM m WINDOW w AS (PARTITION BY paragraph ORDER BY s)),
u AS (SELECT paragraph, string_agg(CASE WHEN s > was THEN substr(t, (was + 1)::INTEGER, (s - was)::INTEGER) || '|' ELSE '' END || substr(t, (s + 1)::INTEGER, 2) || '/' || reading || CASE WHEN last AND length(t) > s + 2 THEN '|' || substr(t, (s + 3)::INTEGER) ELSE '' END, '|' ORDER BY s) AS runs FROM q GROUP BY paragraph)
SELECT snapshot, p.paragraph, md5(coalesce(runs, t)) AS inlines_md5, 2 AS spans FROM p LEFT JOIN u ON u.paragraph = p.paragraph
""",
    "reading_conflicts_by_snapshot": _READINGS + "SELECT snapshot, paragraph, s::INTEGER AS start, 2 AS length, readings FROM n",
    "batch_load": ANNOTATIONS + """,
m AS (SELECT * FROM g WHERE id % 100 = 1 AND batch % 2 = 0),
p AS (SELECT batch, string_agg(DISTINCT page::VARCHAR, ' ' ORDER BY page::VARCHAR) AS markers, string_agg(page || ':' || CASE WHEN id % 3 = 0 THEN 'r' ELSE 't' END || paragraph, ' ' ORDER BY page::VARCHAR, id) AS readings FROM m GROUP BY batch)
SELECT b.id AS batch, stale AS text_stale, coalesce(markers, '') AS markers, coalesce(readings, '') AS readings FROM b LEFT JOIN p ON p.batch = b.id WHERE b.id % 3 = 0
""",
    "page_states": ANNOTATIONS + """,
w AS (SELECT page, arg_min(paragraph, id) FILTER (id % 7 = 0) AS merged, count(*) FILTER (id % 7 <> 0) AS n, bool_and(id % 7 <> 0 AND id % 5 <> 0) AS known FROM g GROUP BY page),
m AS (SELECT user_id AS page, arg_max(value, (ts, event_id)) AS text, max(ts) AS at FROM events WHERE event_type = 'view' GROUP BY 1),
v AS (SELECT user_id AS page, arg_max(value, event_id) AS text FROM events e WHERE event_type = 'purchase' AND NOT EXISTS (SELECT 1 FROM m WHERE m.page = e.user_id AND m.at > e.ts) GROUP BY 1)
SELECT o_orderkey AS page, m.text::VARCHAR AS manual, CASE WHEN o_orderkey % 3 = 0 THEN o_orderpriority END AS auxiliary, CASE WHEN o_orderkey % 4 = 0 THEN o_orderpriority END AS suggested, v.text::VARCHAR AS confirmed, merged::VARCHAR AS merged, coalesce(n, 0) AS n_words, coalesce(known, true) AS known
FROM orders LEFT JOIN w ON w.page = o_orderkey LEFT JOIN m ON m.page = o_orderkey LEFT JOIN v ON v.page = o_orderkey
""",
    "preflight": ANNOTATIONS + """,
p AS (SELECT o_custkey AS book, o_orderkey AS page, CASE o_orderpriority WHEN '1-URGENT' THEN 'Body' WHEN '2-HIGH' THEN 'Other' WHEN '3-MEDIUM' THEN 'Illustration' WHEN '4-NOT SPECIFIED' THEN 'Blank' ELSE 'ChapterTitle' END AS role, o_orderstatus <> 'P' AS inc, o_orderkey % 3 = 0 OR o_orderkey % 5 = 0 AS blank, o_orderkey % 2 <> 0 AS raw FROM orders),
c AS (SELECT book, count(*) FILTER (NOT blank) AS a, count(*) FILTER (blank) AS e, count(*) FILTER (raw) AS u, string_agg(page::VARCHAR, ' ' ORDER BY page) FILTER (NOT blank AND role = 'Other') AS o FROM p WHERE inc AND role NOT IN ('Illustration', 'Blank') GROUP BY book),
r AS (SELECT o_custkey AS book, count(*) FILTER (status = 'Confirmed') AS cf, count(*) FILTER (status = 'Proposed') AS pr, count(*) FILTER (status = 'Rejected' AND id % 20 = 1) AS un FROM g JOIN orders ON o_orderkey = page GROUP BY 1),
i AS (SELECT book, count(*) FILTER (role = 'Illustration' AND page % 10 = 0) AS pic, count(*) FILTER (page % 50 = 0) AS iss, coalesce(bool_or(page % 100 = 0), false) AS fatal FROM p GROUP BY book),
z AS (SELECT i.book, coalesce(a, 0) AS included_pages, coalesce(e, 0) AS empty_pages, coalesce(u, 0) AS unproofread, coalesce(o, '') AS others, coalesce(cf, 0) AS confirmed, coalesce(pr, 0) AS proposed, 0::BIGINT AS stale, coalesce(un, 0) AS unresolved, pic AS illustrations, iss AS issues, fatal
  FROM i LEFT JOIN c USING (book) LEFT JOIN r USING (book))
SELECT *, others <> '' OR empty_pages > 0 OR unproofread > 0 OR proposed > 0 OR stale > 0 OR unresolved > 0 OR illustrations > 0 OR issues > 0 AS requires_confirmation FROM z
""",
    "evidence_lines": ANNOTATIONS + """,
a AS (SELECT DISTINCT id, s, n, unnest([paragraph % 100, batch % 100]) AS m FROM g WHERE source = 'ImageConfirmed'),
c AS (SELECT event_id AS k, event_id % 100 AS m, floor(value / 2)::BIGINT % 50 + 1 AS s, CASE WHEN event_id % 2 = 0 THEN event_id % 4 + 1 END AS base, CASE WHEN event_id % 5 <> 0 THEN event_id % 8 / 8 END AS link FROM events WHERE event_id % 3 = 0)
SELECT id, a.m::VARCHAR AS marker, a.m || ' ' || printf('%.2f', k::DOUBLE) || ' 1.00 2.00 3.00 0.50 ' || CASE WHEN link IS NULL THEN '-' ELSE printf('%.2f', floor(link * 100 + 0.5) / 100) END AS line,
  (row_number() OVER (PARTITION BY id ORDER BY coalesce(link, 0) DESC, a.m::VARCHAR, k) - 1)::INTEGER AS place FROM a JOIN c ON c.m = a.m AND c.s = a.s WHERE base IS NULL OR base = n
""",
    "reading_candidates": _BOXES + """,
ch AS (SELECT *, id = 2 AS back FROM x WHERE id = 1 OR (id = 2 AND page % 5 = 0)),
bd AS (SELECT * FROM x WHERE id > 1 AND NOT (id = 2 AND page % 5 = 0)),
p AS (SELECT r.page, r.id, b.id AS body, least(r.bottom, b.bottom) - greatest(r.top, b.top) AS o, greatest(0, r."left" - b."right", b."left" - r."right") AS gap,
    greatest(1, r."right" - r."left", b."right" - b."left") AS scale, r.bottom - r.top AS h1, b.bottom - b.top AS h2, (r.bottom - r.top) / length(r.text) AS e1, (b.bottom - b.top) / length(b.text) AS e2 FROM ch r JOIN bd b ON r.page = b.page),
s AS (SELECT page, id, body, gap / scale + (1 - least(1, o / least(h1, h2))) * 0.25 + abs(e1 - e2) / greatest(1, e1, e2) * 0.25 AS score FROM p WHERE o > 0 AND gap <= scale * 3),
k AS (SELECT *, row_number() OVER w AS r, lead(score) OVER w AS second FROM s WINDOW w AS (PARTITION BY page, id ORDER BY score, body)),
l AS (SELECT page, id, body, round(1 / (1 + score), 6) AS link FROM k WHERE r = 1 AND (second IS NULL OR abs(second - score) >= 0.1))
SELECT ch.page, ch.id, back AS returned, back AS included, body, link FROM ch LEFT JOIN l ON l.page = ch.page AND l.id = ch.id
""",
    "raw_ordinals": _BOXES.replace("WITH g", "WITH RECURSIVE g") + """,
md AS (SELECT page, list_sort(list("right" - "left")) AS w FROM x GROUP BY page),
th AS (SELECT x.*, w[len(w) // 2 + 1] AS median FROM x JOIN md USING (page)),
pts AS (SELECT page, id, ("left" + "right") / 2 AS x, top AS y FROM th a WHERE text = '、' OR NOT ("right" - "left" < median * 0.85 AND EXISTS (
  SELECT 1 FROM x b WHERE b.page = a.page AND b."right" - b."left" > a."right" - a."left" AND a.bottom > b.top AND a.top < b.bottom AND greatest(0, b."left" - a."right", a."left" - b."right") <= a.median))),""" + _COLUMNS + """
SELECT page, (row_number() OVER (PARTITION BY page ORDER BY col, place) - 1)::INTEGER AS place, id FROM placed
""",
    "illustrations": "SELECT o_custkey AS book, o_orderkey AS page, '挿絵 ' || row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS alt FROM orders WHERE o_orderpriority = '3-MEDIUM' AND o_orderstatus <> 'P'",
    "prepared_document": _LINES + """,
seg AS (SELECT conv_id, turn AS page, sum(length(piece)) OVER w AS hi, sum(length(piece)) OVER w - length(piece) AS lo FROM pieces WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
fp AS (SELECT p.conv_id, ordinal, min(role) AS role, min(page) AS page FROM paras p JOIN seg s ON p.conv_id = s.conv_id AND CASE WHEN length > 0 THEN lo < start + length AND hi > start ELSE lo <= greatest(start - 1, 0) AND greatest(start - 1, 0) < hi END GROUP BY 1, 2),
k AS (SELECT *, page || ':' || (row_number() OVER (PARTITION BY conv_id, page ORDER BY ordinal) - 1) || ':' || role AS key FROM fp),
d AS (SELECT conv_id, upper(sha256(string_agg(role || chr(31) || plain_text, chr(10) ORDER BY ordinal))) AS hash FROM paras GROUP BY conv_id)
SELECT 'paragraphs' AS part, key AS id, conv_id || ' ' || CASE WHEN ordinal % 3 = 0 THEN 'p' || ordinal ELSE 'new ' || key END AS value FROM k
UNION ALL SELECT 'documents', conv_id::VARCHAR, hash || CASE WHEN conv_id % 2 = 0 THEN ' s' || conv_id ELSE '' END FROM d
""",
    "latest_review": ANNOTATIONS + """,
t AS (SELECT o_custkey, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS k FROM orders WHERE o_orderkey IN (SELECT page FROM g) GROUP BY 1)
SELECT id, page AS batch FROM g WHERE page IN (SELECT k FROM t)
""",
    "revalidated_import": _PROPOSALS + "SELECT batch, pos, code, substr(sha256(batch || chr(31) || pos), 1, 32) AS id FROM x",
    "message_parts": """
SELECT event_id, CASE WHEN event_id % 3 = 0 THEN lpad(event_id::VARCHAR, 8, '0') || '-00aa-0000-0000-000000000001' END AS batch_id, round(floor(value)::BIGINT % 200 / 200 * 100)::BIGINT || '%' AS share,
  '- a: ' || event_id % 6 || ' 件;- b: ' || event_id % 4 || ' 件' AS reasons, CASE WHEN event_id % 10 <> 0 THEN (event_id % 30 + 2 * (event_id % 7 - 3))::INTEGER END AS raise, event_id % 5 IN (event_id % 3, event_id % 4) AS same FROM events
""",
    "project_ids": "SELECT s_name AS book, CASE WHEN s_suppkey % 4 = 0 THEN 'known-' || s_suppkey ELSE substr(sha256('project' || chr(31) || s_name), 1, 32) END AS project FROM supplier",
}


def _worker(spark, d):
    """Events as lines of a worker's output and as requests: some lines are noise, some answers of another version, some come twice, some requests get none."""
    e, k = table(spark, d, "events"), F.col("event_id")
    words = F.array(F.struct(F.col("event_type").alias("text"), (F.col("user_id") / 100).alias("confidence"), *(F.lit(x).alias(c) for c, x in (("left", 1.0), ("top", 2.0), ("right", 3.0), ("bottom", 4.0)))))
    good = F.to_json(F.struct(F.when(k % 13 == 0, 2).otherwise(1).alias("protocolVersion"), F.concat(F.lit("r"), F.floor(k / 2)).alias("requestId"), F.lit("ok").alias("status"), F.when(k % 3 == 0, "paddle").alias("engine"), F.when(k % 4 == 0, "m").alias("modelVersion"), F.when(k % 5 != 0, words).alias("words")))
    bad = F.to_json(F.struct(F.lit(1).alias("protocolVersion"), F.concat(F.lit("r"), F.floor(k / 2)).alias("requestId"), F.lit("error").alias("status"), F.when(k % 3 == 0, "no image").alias("error"), F.when(k % 4 == 0, False).alias("retryable"), F.lit("Merge").alias("stage"), F.when(k % 9 == 0, "ValueError").alias("exceptionType")))
    lines = e.select(k.alias("place"), F.when(k % 11 == 0, "loading model").when(k % 7 == 0, bad).otherwise(good).alias("value"))
    return lines, e.select(F.concat(F.lit("r"), "event_id").alias("request_id"), F.lit("mock").alias("engine"))


def worker_lines(spark, d):
    out = worker.responses(*_worker(spark, d))
    return out.withColumn("words", F.concat_ws(" ", F.transform("words", lambda w: F.concat_ws(":", w["text"], w["left"].cast("int")))))


def worker_requests(spark, d):
    e = table(spark, d, "events")
    return worker.requests(e.select("event_id"), F.concat(F.lit("r"), "event_id"), F.when(F.col("event_id") % 2 == 0, "paddle").otherwise("tesseract"), F.concat(F.lit("p/"), "event_id")).select("event_id", "line")


def worker_dispatch(spark, d):
    """Events as requests to engines, with what these gave: arrays of boxes, or a turn's text."""
    e, k = table(spark, d, "events"), F.col("event_id")
    asked = e.select(k.alias("request_id"), F.when(k % 17 != 0, 1).alias("version"), F.get(F.array(*(F.lit(x) for x in ("mock", "paddle", "tesseract", "other", "paddle"))), (k % 5).cast("int")).alias("engine"))
    box = F.array(*(F.lit(x) for x in (1, 2, 3, 4)))
    given = e.where("event_id % 19 <> 0").select(k.alias("request_id"), F.array(box, box).alias("boxes"), F.when(k % 3 == 0, F.array("event_type")).otherwise(F.array("event_type", "event_type")).alias("texts"), F.array(F.lit(0.5), F.lit(0.25), F.lit(1.0)).alias("scores"), F.when(k % 4 == 0, " \n \n").otherwise(F.concat("event_type", F.lit("\r\n\r\n \n"), "event_type")).alias("text"), F.when(k % 6 == 0, "broken").alias("failure"), F.lit(None).cast("string").alias("exception"))
    out = worker.answers(asked, given)
    r = F.from_json("answer", worker.RESPONSE)
    line = F.concat_ws(" ", F.transform(r["words"], lambda w: F.concat_ws(":", w["text"], (w["confidence"] * 100).cast("int"), w["left"].cast("int"), w["bottom"].cast("int"))))
    return out.select("request_id", r["status"].alias("status"), r["engine"].alias("engine"), r["modelVersion"].alias("model"), r["error"].alias("error"), r["stage"].alias("stage"), line.alias("words"))


QUERIES |= {f.__name__: f for f in (worker_lines, worker_requests, worker_dispatch)}

SQL |= {
    "worker_lines": """
WITH l AS (SELECT event_id AS k, 'r' || event_id // 2 AS id, event_id % 7 <> 0 AS ok, event_type, CASE WHEN event_id % 3 = 0 THEN 'paddle' END AS engine FROM events WHERE event_id % 11 <> 0 AND NOT (event_id % 13 = 0 AND event_id % 7 <> 0)),
f AS (SELECT * FROM l QUALIFY row_number() OVER (PARTITION BY id ORDER BY k) = 1)
SELECT 'r' || e.event_id AS request_id, coalesce(ok, false) AS ok, CASE WHEN ok THEN coalesce(f.engine, 'mock') ELSE 'mock' END AS engine, CASE WHEN ok THEN CASE WHEN k % 4 = 0 THEN 'm' ELSE 'unknown' END END AS model_version,
  CASE WHEN ok AND k % 5 <> 0 THEN f.event_type || ':1' ELSE '' END AS words, CASE WHEN id IS NULL THEN 'OCR worker returned no matching response.' WHEN NOT ok THEN CASE WHEN k % 3 = 0 THEN 'no image' ELSE 'OCR worker failed.' END END AS error,
  CASE WHEN id IS NULL THEN true WHEN NOT ok THEN k % 4 <> 0 END AS retryable, CASE WHEN id IS NULL THEN 'mock' WHEN NOT ok THEN 'Merge' END AS stage, CASE WHEN NOT ok AND k % 9 = 0 THEN 'ValueError' END AS exception
FROM events e LEFT JOIN f ON f.id = 'r' || e.event_id
""",
    "worker_requests": """SELECT event_id, '{"protocolVersion":1,"requestId":"r' || event_id || '","engine":"' || CASE WHEN event_id % 2 = 0 THEN 'paddle' ELSE 'tesseract' END || '","imagePath":"p/' || event_id || '"}' AS line FROM events""",
    "worker_dispatch": """
WITH r AS (SELECT event_id AS k, ['mock', 'paddle', 'tesseract', 'other', 'paddle'][event_id % 5 + 1] AS en, event_type AS t FROM events),
s AS (SELECT *, CASE WHEN k % 17 = 0 THEN 1 WHEN en = 'mock' THEN 2 WHEN en = 'other' OR k % 19 = 0 THEN 3 WHEN k % 6 = 0 THEN 4 WHEN en = 'paddle' THEN 5 ELSE 6 END AS c FROM r)
SELECT k AS request_id, CASE WHEN c IN (2, 5, 6) THEN 'ok' ELSE 'error' END AS status, CASE WHEN c IN (2, 5, 6) THEN en END AS engine, CASE c WHEN 2 THEN 'none' WHEN 5 THEN 'PP-OCRv6-medium' WHEN 6 THEN 'jpn_vert' END AS model,
  CASE c WHEN 1 THEN 'Unsupported protocol version' WHEN 3 THEN 'OCR engine is not configured with a local model' WHEN 4 THEN 'broken' END AS error, CASE WHEN c = 4 THEN CASE WHEN en = 'paddle' THEN 'PaddleOCR' ELSE 'Tesseract' END END AS stage,
  CASE WHEN c = 5 THEN t || ':50:1:4' || CASE WHEN k % 3 <> 0 THEN ' ' || t || ':25:1:4' ELSE '' END WHEN c = 6 THEN CASE WHEN k % 4 <> 0 THEN t || chr(10) || t ELSE '' END || ':80:0:1' ELSE '' END AS words FROM s
""",
}


def word_documents(spark, d):
    """Documents as paragraphs of books of twelve: the length and hash of each book's main part, and what is wrong with its archive."""
    options = word.WordOptions("Font & \"Co\"", True, 2)
    files = word.parts(_rendered(spark, d).withColumn("book", F.floor(F.col("doc_id") / 12)), "book", "doc_id", options)
    return files.where("path = 'word/document.xml'").select(F.col("batch").alias("book"), F.md5("content").alias("content_md5"))


def image_keys(spark, d):
    k = F.col("p_partkey")
    crop = F.struct((k % 10 / 20).alias("left"), F.lit(0.0).alias("top"), F.lit(1.0).alias("right"), (1 - k % 4 / 8).alias("bottom"))
    p = table(spark, d, "part").select("p_partkey", F.col("p_name").alias("hash"), crop.alias("crop"), (k % 5 * 90).cast("int").alias("rotation"))
    return p.select("p_partkey", pages.image_key(F.col("hash"), F.col("crop"), F.col("rotation")).alias("key"))


def table_migration(spark, d):
    """Orders as the pages of an old version, some with a count of review items, lines as the words of its runs."""
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), (F.col("o_orderkey") % 3).cast("int").alias("review_item_count"), F.col("o_orderpriority").alias("page_role"))
    reviews = o.where("id % 2 = 0").select(F.col("id").alias("page_id"), F.lit("x").alias("code"), F.lit("OCR").alias("source"), F.lit("t").alias("text"))
    words = _boxes(spark, d).withColumn("confidence", F.lit(0.5)).withColumnsRenamed({"page": "run_id", "id": "ordinal"})
    out = migrations.migrated({"pages": o, "review_items": reviews, "ocr_run_words": words}, 0)
    out = migrations.migrated(out, migrations.VERSION)
    page = F.concat_ws(" ", "page_role", "review_item_count", "crop_right", "proofreading_status", "ocr_status", "boundary_join_type")
    roles = out["ocr_run_words"].groupBy("run_id", "automatic_role", "manual_override").agg(F.count("*").alias("n"))
    return _rows(pages=(out["pages"], "id", page), reviews=(out["review_items"], "page_id", F.concat_ws(" ", "code", "source", "text")), words=(roles, "run_id", F.concat_ws(" ", "automatic_role", F.col("manual_override").cast("string"), "n")))


QUERIES |= {f.__name__: f for f in (word_documents, image_keys, table_migration)}

_X = "replace(replace(replace(regexp_replace({}, '[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F]', '', 'g'), '&', '&amp;'), '<', '&lt;'), '>', '&gt;')"
_T = "'<w:t xml:space=\"preserve\">' || " + _X + " || '</w:t>'"
_P = "'<w:rPr><w:rFonts w:ascii=\"' || f || '\" w:hAnsi=\"' || f || '\" w:eastAsia=\"' || f || '\"/><w:sz w:val=\"' || {0} || '\"/><w:szCs w:val=\"' || {0} || '\"/></w:rPr>'"
_RUN = "'<w:r>' || " + _T + " || '</w:r>'"


def _read(base: str, reading: str) -> str:
    return (
        "'<w:r><w:ruby><w:rubyPr><w:rubyAlign w:val=\"center\"/><w:hps w:val=\"10\"/><w:hpsRaise w:val=\"14\"/><w:hpsBaseText w:val=\"' || size || '\"/><w:lid w:val=\"ja-JP\"/></w:rubyPr><w:rt><w:r>' || " + _P.format("10") + " || " + _T.format(reading)
        + " || '</w:r></w:rt><w:rubyBase><w:r>' || " + _P.format("size") + " || " + _T.format(base) + " || '</w:r></w:rubyBase></w:ruby></w:r>'"
    )


SQL |= {
    "word_documents": f"""
WITH p AS (SELECT doc_id, coalesce(text, '') AS text, ['Heading1', 'Heading2', 'Normal', 'SceneBreak', 'Normal'][doc_id % 5 + 1] AS style, [32, 28, 21, 21, 21][doc_id % 5 + 1] AS size, 'Font &amp; &quot;Co&quot;' AS f FROM documents),
q AS (SELECT doc_id, '<w:p><w:pPr><w:pStyle w:val="' || style || '"/>' || CASE WHEN doc_id % 5 = 0 THEN '<w:pageBreakBefore/>' ELSE '' END || '</w:pPr>' || CASE WHEN doc_id % 2 = 0 AND length(text) >= 12
    THEN {_RUN.format("substr(text, 1, 1)")} || {_read("substr(text, 2, 3)", "'よみ'")} || {_RUN.format("substr(text, 5, 3)")} || {_read("substr(text, 8, 2)", "'a|b'")} || {_RUN.format("substr(text, 10)")}
    WHEN text = '' THEN '' ELSE {_RUN.format("text")} END || '</w:p>' AS x FROM p)
SELECT doc_id // 12 AS book, md5('<?xml version="1.0" encoding="UTF-8" standalone="yes"?><w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body>' || string_agg(x, '' ORDER BY doc_id)
  || '<w:sectPr><w:pgSz w:w="11906" w:h="16838"/><w:pgMar w:top="1134" w:right="1134" w:bottom="1134" w:left="1134" w:header="708" w:footer="708" w:gutter="0"/></w:sectPr></w:body></w:document>') AS content_md5 FROM q GROUP BY 1
""",
    "image_keys": r"""
SELECT p_partkey, CASE WHEN p_partkey % 5 < 4 THEN upper(sha256(p_name || '|' || regexp_replace((p_partkey % 10 / 20)::VARCHAR, '\.0$', '') || '|0|1|' || regexp_replace((1 - p_partkey % 4 / 8)::VARCHAR, '\.0$', '') || '|' || p_partkey % 5 * 90)) END AS key FROM part
""",
    "table_migration": _BOXES + """,
m AS (SELECT page, list_sort(list("right" - "left")) AS w FROM x GROUP BY page),
a AS (SELECT x.*, w[len(w) // 2 + 1] AS median FROM x JOIN m USING (page)),
t AS (SELECT a.*, text <> '、' AND "right" - "left" < median * 0.85 AND EXISTS (
  SELECT 1 FROM x b WHERE b.page = a.page AND b."right" - b."left" > a."right" - a."left" AND a.bottom > b.top AND a.top < b.bottom AND greatest(0, b."left" - a."right", a."left" - b."right") <= a.median) AS thin FROM a),
u AS (SELECT t.page, thin AND NOT EXISTS (SELECT 1 FROM t k WHERE NOT k.thin AND k.page = t.page AND k.text = t.text AND k."left" = t."left" AND k.top = t.top AND k."right" = t."right" AND k.bottom = t.bottom) AS aid FROM t)
SELECT 'pages' AS part, o_orderkey::VARCHAR AS id, o_orderpriority || ' ' || o_orderkey % 3 || ' 1.0 NotOcrProcessed NotProcessed DirectJoin' AS value FROM orders
UNION ALL SELECT 'reviews', o_orderkey::VARCHAR, CASE WHEN o_orderkey % 2 = 0 THEN 'x OCR t' ELSE 'LegacyReviewCount Migration' END FROM orders WHERE o_orderkey % 2 = 0 OR o_orderkey % 3 > 0
UNION ALL SELECT 'words', page::VARCHAR, CASE WHEN aid THEN 'RubyCandidate' ELSE 'Body' END || ' false ' || count(*) FROM u GROUP BY page, aid
""",
}
