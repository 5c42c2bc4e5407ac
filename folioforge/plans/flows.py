"""Queries of transitions over several tables: lines stand for annotations, suppliers for batches, parts for paragraphs, orders for pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import loads, state, transitions
from ..sources.tables import table

#: The flags of lines as statuses and sources.
STATUS = {"A": "Confirmed", "N": "Proposed", "R": "Rejected"}


def mapped(values: dict[str, str], c):
    return F.try_element_at(F.create_map(*(F.lit(x) for kv in values.items() for x in kv)), c)


def annotations(spark, d):
    """A row for each order and line number: id, page, batch, paragraph, start, length, status, source."""
    low = table(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(*(F.min(c).alias(c) for c in ("l_suppkey", "l_partkey", "l_quantity", "l_returnflag", "l_linestatus")))
    return low.select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), F.col("l_orderkey").alias("page"), F.col("l_suppkey").alias("batch"), F.col("l_partkey").alias("paragraph"), F.col("l_quantity").cast("int").alias("start"),
        (F.col("l_linenumber") % 4 + 1).alias("length"), mapped(STATUS, F.col("l_returnflag")).alias("status"), F.when(F.col("l_linestatus") == "O", "ImageConfirmed").otherwise("TextConfirmed").alias("source"),
    )


def _batches(spark, d):
    return table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), (F.col("s_acctbal") < 0).alias("text_stale"))


def snapshots(spark, d):
    return table(spark, d, "supplier").select(F.col("s_suppkey").alias("batch"), (F.col("s_suppkey") % 3).alias("snapshot"))


def _rows(**parts):
    """(part, id, value) of several tables: name, key and value column."""
    out = None
    for part, (df, key, value) in parts.items():
        one = df.select(F.lit(part).alias("part"), F.col(key).cast("string").alias("id"), (F.col(value) if isinstance(value, str) else value).cast("string").alias("value"))
        out = one if out is None else out.unionByName(one)
    return out


ANNOTATIONS = """
WITH g AS (SELECT l_orderkey * 10 + l_linenumber AS id, l_orderkey AS page, min(l_suppkey) AS batch, min(l_partkey) AS paragraph, min(l_quantity)::INTEGER AS s, l_linenumber % 4 + 1 AS n,
    CASE min(l_returnflag) WHEN 'A' THEN 'Confirmed' WHEN 'N' THEN 'Proposed' ELSE 'Rejected' END AS status, CASE min(l_linestatus) WHEN 'O' THEN 'ImageConfirmed' ELSE 'TextConfirmed' END AS source FROM lineitem GROUP BY l_orderkey, l_linenumber),
b AS (SELECT s_suppkey AS id, s_acctbal < 0 AS stale, s_suppkey % 3 AS snapshot FROM supplier)
"""
#: What a change leaves: h names the ids that it hits, f the batches that it flags.
_STALED = """
SELECT 'annotations' AS part, id::VARCHAR AS id, CASE WHEN id IN (SELECT id FROM h) AND status <> 'Rejected' THEN 'Stale' ELSE status END AS value FROM g
UNION ALL SELECT 'history', id::VARCHAR, status FROM g WHERE id IN (SELECT id FROM h) AND status <> 'Rejected'
UNION ALL SELECT 'batches', id::VARCHAR, (stale OR id IN (SELECT id FROM f))::VARCHAR FROM b
"""


def _staled(out):
    return _rows(annotations=(out.annotations, "id", "status"), history=(out.history, "id", "status"), batches=(out.batches, "id", "text_stale"))


def structure_stale(spark, d):
    """Every 701st page changed its place."""
    a = annotations(spark, d)
    changed = table(spark, d, "orders").where("o_orderkey % 701 = 0").select(F.col("o_orderkey").alias("page"))
    return _staled(transitions.structure_changed(a, _batches(spark, d), a.select("batch", "page").distinct(), changed))


def pages_removed(spark, d):
    return _staled(transitions.all_changed(annotations(spark, d), _batches(spark, d)))


def _saved_pages(spark, d):
    """Pages as they were and as they are saved: every 701st moved, every 50th has another picture, those after the last tenth are new."""
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("page"), F.col("o_custkey").alias("sort_order"), F.col("o_orderpriority").alias("role"), F.col("o_orderstatus").alias("source_hash"))
    k = F.col("page")
    new = o.select("page", F.when(k % 701 == 0, F.col("sort_order") + 1).otherwise(F.col("sort_order")).alias("sort_order"), "role", F.when(k % 50 == 0, "X").otherwise(F.col("source_hash")).alias("source_hash"))
    counts = ~F.col("role").isin("4-NOT SPECIFIED", "5-LOW")
    return transitions.impact_of(o.where("page % 1000 <> 999"), new, "page", ["sort_order", "role"], ["source_hash"], counts)


def page_impacts(spark, d):
    return _saved_pages(spark, d)


def pages_saved(spark, d):
    """Impacts of saved pages; an annotation cites its page if its id is odd."""
    a = annotations(spark, d)
    evidence = a.where("id % 2 = 1").select(F.col("id").alias("annotation"), "page")
    return _staled(transitions.pages_saved(a, _batches(spark, d), a.select("batch", "page").distinct(), evidence, _saved_pages(spark, d)))


def body_stale(spark, d):
    """Every 60th page has another text, some of them none before or after."""
    a, o = annotations(spark, d), table(spark, d, "orders")
    k = F.col("o_orderkey")
    texts = o.select(k.alias("page"), F.when(k % 120 != 0, F.col("o_orderpriority")).alias("before"), F.when(k % 180 == 0, F.lit(None)).when(k % 60 == 0, "x").when(k % 120 != 0, F.col("o_orderpriority")).alias("after"))
    return _staled(transitions.body_changed(a, _batches(spark, d), a.select("paragraph", "page").distinct(), a.select("batch", "page").distinct(), texts))


def confirmation_order(spark, d):
    """Every third annotation is confirmed, the largest id first."""
    a = annotations(spark, d)
    out, history = transitions.confirmed_in_order(a, a.where("id % 3 = 0").select("id", (-F.col("id")).alias("place")), snapshots(spark, d))
    return _rows(annotations=(out, "id", "status"), history=(history, "id", "status"))


def review_save(spark, d):
    """Every fifth annotation is saved: half of them confirmed, some with another source, some as they were; a few ids are of none."""
    a = annotations(spark, d)
    saved = a.where("id % 5 = 0").select("id", F.col("id").alias("place"), F.when(F.col("id") % 2 == 0, "Confirmed").otherwise(F.col("status")).alias("status"), F.when(F.col("id") % 15 == 0, "UserConfirmed").otherwise(F.col("source")).alias("source"))
    saved = saved.unionByName(saved.where("id % 1000 = 5").withColumn("id", -F.col("id")))
    out, history, unknown = transitions.reviewed(a, saved, snapshots(spark, d), ["status", "source"])
    both = F.concat_ws(" ", "status", "source")
    return _rows(annotations=(out, "id", both), history=(history, "id", both), unknown=(unknown, "id", F.lit(None)))


def _versions(spark, d):
    kind = mapped({"purchase": "Manual", "view": "Confirmed"}, F.col("event_type"))
    return table(spark, d, "events").select(F.col("user_id").alias("page"), F.coalesce(kind, F.lit("Draft")).alias("kind"), (F.floor("value") % 5).cast("string").alias("text"), F.col("event_id").alias("seq"))


def version_restore(spark, d):
    """Each user's first event is taken up again; the text selected until now is that of the last one."""
    v = _versions(spark, d)
    first, last = state.first_per_key(v, ["page"], ["seq"]), state.latest(v, ["page"], ["seq"])
    out = transitions.restored_versions(first.select("page", "kind", "text"), v, last.select("page", "text"), F.lit("2024-01-01"))
    return _rows(manual=(out.manual, "page", "text"), versions=(out.versions, "page", F.concat_ws(" ", "kind", "text", "source", "at")), statuses=(out.statuses, "page", "status"), changed=(out.changed, "page", F.lit(None)), refused=(out.refused, "page", "kind"))


def stable_ids(spark, d):
    """Lines as paragraphs known from before, by supplier and part; parts are met again, and some that are not."""
    known = table(spark, d, "lineitem").select((F.col("l_suppkey") % 10).alias("project"), F.col("l_partkey").alias("key"), F.concat_ws("-", "l_orderkey", "l_linenumber", "l_quantity").alias("id"), F.col("l_shipdate").alias("created"), F.concat_ws("-", "l_orderkey", "l_linenumber", "l_quantity").alias("seq"))
    parts = table(spark, d, "part").select((F.col("p_partkey") % 10).alias("project"), F.col("p_partkey").alias("key"))
    out = transitions.stable_ids(parts.union(parts.select("project", F.col("key") + 1_000_000)), known, "project", "key", F.concat(F.lit("new-"), "key"))
    return out.select("project", "key", "id")


def word_override_flow(spark, d):
    """Words of pages by line number; every third page has its first word set by hand, in some to a role there is not, in some a word there is not."""
    a = annotations(spark, d)
    words = a.select("page", (F.col("id") % 10).alias("ordinal"), F.concat(F.lit("k"), F.col("paragraph") % 50).alias("word_key"), F.when(F.col("status") == "Rejected", "RubyCandidate").otherwise("Body").alias("role"), (F.col("status") != "Rejected").alias("included"), F.lit(False).alias("manual"), F.col("paragraph").cast("string").alias("text"))
    k = F.col("o_orderkey")
    o = table(spark, d, "orders")
    edits = o.where("o_orderkey % 3 = 0").select(k.alias("page"), F.when(k % 50 == 0, 99).otherwise(1).cast("long").alias("ordinal"), F.when(k % 9 == 0, "Odd").when(k % 2 == 0, "RubyCandidate").otherwise("Body").alias("role"), (k % 2 == 1).alias("included"))
    kept = o.where("o_orderkey % 4 = 0").select(k.alias("page"), F.lit("k7").alias("word_key"), F.lit("Body").alias("role"), F.lit(True).alias("included"))
    reviews = a.where("source = 'ImageConfirmed'").select("page", F.lit("x").alias("code"), F.when(F.col("id") % 2 == 0, "Ruby").when(F.col("id") % 3 == 0, "OCR").otherwise("Note").alias("source"), F.col("paragraph").cast("string").alias("text"))
    out = transitions.overridden(words, kept, reviews, o.select(k.alias("page"), F.lit("Draft").alias("status"), F.lit(0).cast("long").alias("reviews")), edits)
    words_ = out.words.where("manual").select((F.col("page") * 100 + F.col("ordinal")).alias("id"), F.concat_ws(" ", "role", F.col("included").cast("string")).alias("value"))
    over = out.overrides.groupBy("page").agg(F.concat_ws(" ", F.array_sort(F.collect_list(F.concat_ws(":", "word_key", "role", F.col("included").cast("string"))))).alias("value"))
    items = out.reviews.groupBy("page").agg(F.concat_ws(" ", F.array_sort(F.collect_list(F.concat_ws(":", "code", "source", "text")))).alias("value"))
    return _rows(words=(words_, "id", "value"), overrides=(over, "page", "value"), reviews=(items, "page", "value"), pages=(out.pages, "page", F.concat_ws(" ", "status", "reviews")), refused=(out.refused, "page", "ordinal"))


def _failures(spark, d):
    e = table(spark, d, "events").where("event_type in ('error', 'click')")
    return e.select(F.col("user_id").alias("page"), (F.col("event_type") == "click").alias("cancelled"), F.when(F.col("event_id") % 3 == 0, "Draft").alias("before"), F.col("ts").alias("at"), F.col("event_id").alias("seq"))


def failure_log(spark, d):
    """Customers as pages, errors as failures, clicks as cancelled runs; even pages have words, every third review items."""
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("page"))
    reviews = c.where("page % 3 = 0").select("page", F.when(F.col("page") % 2 == 0, "OCR").otherwise("Note").alias("source"))
    return transitions.failed(c.withColumn("status", F.lit("Processing")), _failures(spark, d), c.where("page % 2 = 0"), reviews)


def newest_failures(spark, d):
    return transitions.newest_failures(_failures(spark, d)).select("page", "seq", "position")


def run_outcomes(spark, d):
    """Events as the results of a run, by their number."""
    k = F.col("event_id")
    pick = lambda values, c: F.get(F.array(*(F.lit(v) for v in values)), c.cast("int"))
    r = table(spark, d, "events").select(
        k.alias("page"), pick(("Preprocess", "PaddleOCR", "Tesseract", "Merge", "DatabaseSave"), k % 5).alias("stage"), F.when(k % 7 < 4, F.col("event_type")).alias("error"), pick((None, "PaddleOCR", "Tesseract", "Other"), k % 4).alias("worker_stage"),
        F.when(k % 3 == 0, "WorkerError").alias("worker_type"), pick((None, True, False), k % 3).alias("worker_retry"), (k % 2 == 0).alias("io"), (k % 11 == 0).alias("cancelled"),
    )
    out = loads.outcomes(r)
    return out.groupBy("kind", "stage", "exception", "retryable", "cancelled").agg(F.count("*").alias("n"), F.min("page").alias("first"))


QUERIES = {f.__name__: f for f in (structure_stale, pages_removed, page_impacts, pages_saved, body_stale, confirmation_order, review_save, version_restore, stable_ids, word_override_flow, failure_log, newest_failures, run_outcomes)}

_IMPACTS = """,
i AS (SELECT o_orderkey AS page, CASE WHEN o_orderkey % 1000 = 999 THEN CASE WHEN o_orderpriority NOT IN ('4-NOT SPECIFIED', '5-LOW') THEN 'structure' ELSE 'none' END
    WHEN o_orderkey % 701 = 0 THEN 'structure' WHEN o_orderkey % 50 = 0 AND o_orderstatus <> 'X' THEN 'image' ELSE 'none' END AS impact FROM orders)
"""
_FAILURES = "WITH f AS (SELECT user_id AS page, event_type = 'click' AS cancelled, CASE WHEN event_id % 3 = 0 THEN 'Draft' END AS was, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r, event_id FROM events WHERE event_type IN ('error', 'click'))"

SQL = {
    "structure_stale": ANNOTATIONS + ", f AS (SELECT DISTINCT batch AS id FROM g WHERE page % 701 = 0 AND page IN (SELECT o_orderkey FROM orders)), h AS (SELECT id FROM g WHERE batch IN (SELECT id FROM f))" + _STALED,
    "pages_removed": ANNOTATIONS + ", f AS (SELECT id FROM b), h AS (SELECT id FROM g)" + _STALED,
    "page_impacts": ANNOTATIONS + _IMPACTS + "SELECT page, impact FROM i",
    "pages_saved": ANNOTATIONS + _IMPACTS + """,
f AS (SELECT DISTINCT batch AS id FROM g WHERE page IN (SELECT page FROM i WHERE impact = 'structure')),
h AS (SELECT id FROM g WHERE batch IN (SELECT id FROM f) OR (source = 'ImageConfirmed' AND id % 2 = 1 AND page IN (SELECT page FROM i WHERE impact = 'image')))""" + _STALED,
    "body_stale": ANNOTATIONS + """,
t AS (SELECT o_orderkey AS page, CASE WHEN o_orderkey % 120 <> 0 THEN o_orderpriority END AS x, CASE WHEN o_orderkey % 180 = 0 THEN NULL WHEN o_orderkey % 60 = 0 THEN 'x' WHEN o_orderkey % 120 <> 0 THEN o_orderpriority END AS y FROM orders),
c AS (SELECT page FROM t WHERE x IS DISTINCT FROM y),
f AS (SELECT DISTINCT batch AS id FROM g WHERE page IN (SELECT page FROM c)),
h AS (SELECT id FROM g WHERE paragraph IN (SELECT paragraph FROM g WHERE page IN (SELECT page FROM c)))""" + _STALED,
    "confirmation_order": ANNOTATIONS + """,
c AS (SELECT g.*, snapshot, CASE WHEN g.id % 3 = 0 THEN -g.id END AS place, CASE WHEN g.id % 3 = 0 THEN 'Confirmed' ELSE status END AS now FROM g LEFT JOIN b ON b.id = batch),
h AS (SELECT DISTINCT x.id FROM c x JOIN c y ON x.paragraph = y.paragraph AND x.snapshot IS NOT DISTINCT FROM y.snapshot AND x.id <> y.id AND x.s < y.s + y.n AND y.s < x.s + x.n
  WHERE x.now = 'Confirmed' AND y.place IS NOT NULL AND (x.place IS NULL OR x.place < y.place))
SELECT 'annotations' AS part, id::VARCHAR AS id, CASE WHEN id IN (SELECT id FROM h) THEN 'Stale' ELSE now END AS value FROM c UNION ALL SELECT 'history', id::VARCHAR, now FROM c WHERE id IN (SELECT id FROM h)
""",
    "review_save": ANNOTATIONS + """,
c AS (SELECT g.*, snapshot, g.id % 5 = 0 AS saved, CASE WHEN g.id % 10 = 0 THEN 'Confirmed' ELSE status END AS now, CASE WHEN g.id % 15 = 0 THEN 'UserConfirmed' ELSE source END AS src FROM g LEFT JOIN b ON b.id = batch),
h AS (SELECT DISTINCT x.id FROM c x JOIN c y ON x.paragraph = y.paragraph AND x.snapshot IS NOT DISTINCT FROM y.snapshot AND x.id <> y.id AND x.s < y.s + y.n AND y.s < x.s + x.n
  WHERE x.now = 'Confirmed' AND y.saved AND y.now = 'Confirmed' AND (NOT x.saved OR x.id < y.id))
SELECT 'annotations' AS part, id::VARCHAR AS id, CASE WHEN id IN (SELECT id FROM h) THEN 'Stale' ELSE now END || ' ' || src AS value FROM c
UNION ALL SELECT 'history', id::VARCHAR, status || ' ' || source FROM c WHERE now <> status OR src <> source
UNION ALL SELECT 'history', id::VARCHAR, now || ' ' || src FROM c WHERE id IN (SELECT id FROM h)
UNION ALL SELECT 'unknown', (-id)::VARCHAR, NULL FROM c WHERE saved AND id % 1000 = 5
""",
    "version_restore": """
WITH v AS (SELECT user_id AS page, CASE event_type WHEN 'purchase' THEN 'Manual' WHEN 'view' THEN 'Confirmed' ELSE 'Draft' END AS kind, (floor(value)::BIGINT % 5)::VARCHAR AS text, event_id FROM events),
w AS (SELECT page, arg_min(kind, event_id) AS kind, arg_min(text, event_id) AS text, arg_max(text, event_id) AS now FROM v GROUP BY page),
k AS (SELECT page, kind, arg_max(text, event_id) AS text FROM v GROUP BY page, kind),
o AS (SELECT w.*, k.text AS last FROM w LEFT JOIN k ON k.page = w.page AND k.kind = w.kind WHERE w.kind <> 'Draft')
SELECT 'manual' AS part, page::VARCHAR AS id, text AS value FROM o WHERE kind = 'Manual'
UNION ALL SELECT 'versions', page::VARCHAR, kind || ' ' || text || ' HistoryRestore 2024-01-01' FROM o WHERE last IS DISTINCT FROM text
UNION ALL SELECT 'statuses', page::VARCHAR, CASE kind WHEN 'Manual' THEN 'ManuallyEdited' ELSE 'Confirmed' END FROM o
UNION ALL SELECT 'changed', page::VARCHAR, NULL FROM o WHERE now <> text UNION ALL SELECT 'refused', page::VARCHAR, kind FROM w WHERE kind = 'Draft'
""",
    "stable_ids": """
WITH k AS (SELECT l_suppkey % 10 AS project, l_partkey AS key, l_orderkey || '-' || l_linenumber || '-' || l_quantity AS id, l_shipdate FROM lineitem),
t AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY project, key ORDER BY l_shipdate DESC, id DESC) AS r FROM k) WHERE r = 1),
p AS (SELECT p_partkey % 10 AS project, p_partkey AS key FROM part UNION ALL SELECT p_partkey % 10, p_partkey + 1000000 FROM part)
SELECT p.project, p.key, coalesce(t.id, 'new-' || p.key) AS id FROM p LEFT JOIN t ON t.project = p.project AND t.key = p.key
""",
    "word_override_flow": ANNOTATIONS + """,
w AS (SELECT page, id % 10 AS ordinal, 'k' || paragraph % 50 AS k, CASE WHEN status = 'Rejected' THEN 'RubyCandidate' ELSE 'Body' END AS role, status <> 'Rejected' AS inc, paragraph::VARCHAR AS text FROM g),
e AS (SELECT o_orderkey AS page, CASE WHEN o_orderkey % 50 = 0 THEN 99 ELSE 1 END AS ordinal, CASE WHEN o_orderkey % 9 = 0 THEN 'Odd' WHEN o_orderkey % 2 = 0 THEN 'RubyCandidate' ELSE 'Body' END AS role, o_orderkey % 2 = 1 AS inc FROM orders WHERE o_orderkey % 3 = 0),
f AS (SELECT e.*, w.k FROM e JOIN w ON w.page = e.page AND w.ordinal = e.ordinal WHERE e.role <> 'Odd'),
n AS (SELECT w.page, w.ordinal, w.text, coalesce(f.role, w.role) AS role, coalesce(f.inc, w.inc) AS inc, f.page IS NOT NULL AS manual FROM w LEFT JOIN f ON f.page = w.page AND f.ordinal = w.ordinal),
v AS (SELECT page, k, role, inc FROM f UNION ALL SELECT o_orderkey, 'k7', 'Body', true FROM orders WHERE o_orderkey % 4 = 0 AND NOT EXISTS (SELECT 1 FROM f WHERE f.page = o_orderkey AND f.k = 'k7')),
r AS (SELECT page, 'x' AS code, CASE WHEN id % 2 = 0 THEN 'Ruby' WHEN id % 3 = 0 THEN 'OCR' ELSE 'Note' END AS source, paragraph::VARCHAR AS text FROM g WHERE source = 'ImageConfirmed'),
m AS (SELECT * FROM r WHERE NOT (source = 'Ruby' AND page IN (SELECT page FROM f)) UNION ALL SELECT page, 'RubyCandidate', 'Ruby', text FROM n WHERE role = 'RubyCandidate' AND page IN (SELECT page FROM f)),
c AS (SELECT page, count(*) AS n, count(*) FILTER (source IN ('OCR', 'Ruby')) AS open FROM m GROUP BY page)
SELECT 'words' AS part, (page * 100 + ordinal)::VARCHAR AS id, role || ' ' || inc::VARCHAR AS value FROM n WHERE manual
UNION ALL SELECT 'overrides', page::VARCHAR, string_agg(k || ':' || role || ':' || inc::VARCHAR, ' ' ORDER BY k || ':' || role || ':' || inc::VARCHAR) FROM v GROUP BY page
UNION ALL SELECT 'reviews', page::VARCHAR, string_agg(code || ':' || source || ':' || text, ' ' ORDER BY code || ':' || source || ':' || text) FROM m GROUP BY page
UNION ALL SELECT 'pages', o_orderkey::VARCHAR, CASE WHEN f.page IS NULL THEN 'Draft 0' ELSE CASE WHEN coalesce(open, 0) > 0 THEN 'ReviewRequired ' ELSE 'Completed ' END || coalesce(c.n, 0) END FROM orders LEFT JOIN f ON f.page = o_orderkey LEFT JOIN c ON c.page = o_orderkey
UNION ALL SELECT 'refused', page::VARCHAR, ordinal::VARCHAR FROM e WHERE NOT EXISTS (SELECT 1 FROM f WHERE f.page = e.page AND f.ordinal = e.ordinal)
""",
    "failure_log": _FAILURES + """
SELECT c_custkey AS page, CASE WHEN f.page IS NULL THEN 'Processing' WHEN NOT cancelled THEN 'Failed' WHEN was IS NOT NULL THEN was WHEN c_custkey % 2 <> 0 THEN 'NotProcessed' WHEN c_custkey % 3 = 0 THEN 'ReviewRequired' ELSE 'Completed' END AS status
FROM customer LEFT JOIN f ON f.page = c_custkey AND r = 1
""",
    "newest_failures": _FAILURES + "SELECT page, event_id AS seq, (r - 1)::INTEGER AS position FROM f",
    "run_outcomes": """
WITH r AS (SELECT event_id AS k, ['Preprocess', 'PaddleOCR', 'Tesseract', 'Merge', 'DatabaseSave'][event_id % 5 + 1] AS stage, CASE WHEN event_id % 7 < 4 THEN event_type END AS error, [NULL, 'PaddleOCR', 'Tesseract', 'Other'][event_id % 4 + 1] AS ws,
    CASE WHEN event_id % 3 = 0 THEN 'WorkerError' END AS wt, [NULL, true, false][event_id % 3 + 1] AS wr, event_id % 2 = 0 AS io, event_id % 11 = 0 AS c FROM events),
o AS (SELECT k, CASE WHEN error IS NULL THEN 'Completed' WHEN stage = 'Tesseract' AND NOT c THEN 'ReviewRequired' ELSE 'Failed' END AS kind,
    CASE WHEN error IS NOT NULL THEN CASE WHEN NOT c AND stage <> 'Tesseract' AND ws IN ('PaddleOCR', 'Tesseract') THEN ws ELSE stage END END AS stage, CASE WHEN error IS NOT NULL THEN coalesce(wt, error) END AS exception,
    CASE WHEN error IS NOT NULL THEN CASE WHEN c THEN true WHEN stage = 'Tesseract' THEN io OR coalesce(wr, false) ELSE coalesce(wr, io) END END AS retryable, CASE WHEN error IS NOT NULL THEN c END AS cancelled FROM r)
SELECT kind, stage, exception, retryable, cancelled, count(*) AS n, min(k) AS first FROM o GROUP BY ALL
""",
}
