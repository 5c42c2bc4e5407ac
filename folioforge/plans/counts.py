"""Queries of summaries and unions, and of the packages that go out."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import annotations as an
from ..operators import layout, packages, rules, summaries
from ..sources.tables import table
from .books import _LINES, _pages, paragraph_spans
from .desk import _PROPOSALS, _proposals
from .flows import ANNOTATIONS, _failures, annotations, run_outcomes
from .ledger import _BOXES, RUN_STATES, _boxes


def history_of_batches(spark, d):
    """Orders as batches of customers' documents, lines as annotations and events as unresolved items."""
    o, k = table(spark, d, "orders"), F.col("o_orderkey")
    batches = o.select(k.alias("id"), F.col("o_custkey").alias("project"), (F.col("o_custkey") * 10 + k % 3).alias("snapshot"), F.col("o_orderdate").alias("exported"), (k % 11 == 0).alias("text_stale"))
    snapshots = o.select((F.col("o_custkey") * 10 + k % 3).alias("id"), F.col("o_custkey").alias("project"), F.col("o_orderdate").alias("created"), k.alias("seq"))
    a = annotations(spark, d).select(F.col("page").alias("batch"), "status")
    out = summaries.batch_history(batches, a, table(spark, d, "events").select((F.col("event_id") % 2000).alias("batch")), snapshots)
    return out.drop("exported", "project", "snapshot", "text_stale")


def _confirmation(spark, d, aborted):
    rows, paragraphs, batch_pages, candidates = _proposals(spark, d)
    rows = rows.withColumn("status", F.when(F.col("pos") % 4 == 1, "Confirmed").otherwise(F.col("status")))
    # Without the codes that depend on other rows, those rows alone are judged whose issues matter; all are counted.
    matters = summaries.passed_over("TextConfirmed").isNull()
    found = an.judged(rows.where(matters), paragraphs, batch_pages, candidates, F.lit("OriginalAndTextConfirmed"), an.OF_OTHERS)
    rest = rows.where(~matters).withColumn("codes", F.lit(None).cast("array<string>"))
    out = summaries.confirmation_counts(found.unionByName(rest), "TextConfirmed", aborted)
    return out.withColumn("reasons", F.concat_ws(" ", F.transform(F.array_sort(F.map_entries("reasons")), lambda e: F.concat_ws(":", e["key"], e["value"].cast("string")))))


def confirmation_summary(spark, d):
    return _confirmation(spark, d, False)


def confirmation_aborted(spark, d):
    return _confirmation(spark, d, True)


def status_change(spark, d):
    return summaries.status_change(annotations(spark, d), ["batch"], "status", "Confirmed")


def run_plan(spark, d):
    """Customers' orders as pages: what going on with each would take."""
    o = table(spark, d, "orders").withColumn("status", F.get(F.array(*map(F.lit, RUN_STATES)), (F.col("o_orderkey") % 5).cast("int")))
    return summaries.run_plan(o, "o_custkey", "status", F.col("o_orderpriority") != "1-URGENT", "ResumeIncomplete")


def outcome_counts(spark, d):
    out = run_outcomes(spark, d)
    each = out.select("kind", "stage", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))).alias("_"))
    return summaries.outcome_counts(each, ["kind"])


def rows_of_pages(spark, d):
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("page"))
    return summaries.counted(o, table(spark, d, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("page")), "page")


def page_validation(spark, d):
    """Orders as pages of customers: what the printed numbers are wrong about becomes review items."""
    o = table(spark, d, "orders").withColumn("printed", F.when(F.col("o_orderkey") % 11 == 0, F.lit("x")).otherwise((F.col("o_orderkey") % 50).cast("string")))
    found = rules.sequence_issues(o, "o_custkey", "o_orderkey", "printed").select(F.col("o_orderkey").alias("page"), "code")
    items = o.select(F.col("o_orderkey").alias("page"), F.lit("old").alias("code"), F.when(F.col("o_orderkey") % 2 == 0, "PageValidation").when(F.col("o_orderkey") % 3 == 0, "OCR").alias("source"), F.lit("t").alias("text"))
    _, pages = summaries.revalidated_reviews(o.select(F.col("o_orderkey").alias("page")), items, found)
    return pages


def status_events(spark, d):
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("page"), F.lit("Draft").alias("status"))
    return summaries.current_status(_failures(spark, d).select("page", F.when(F.col("cancelled"), "Draft").otherwise("Failed").alias("status"), "at", "seq"), c)


def package_reviews(spark, d):
    w = _boxes(spark, d).withColumn("confidence", F.col("left") / 97)
    kept = layout.thin_boxes(w, "page").select(F.col("page").alias("_p"), F.col("id").alias("_i"))
    words = w.join(kept, (F.col("page") == F.col("_p")) & (F.col("id") == F.col("_i")), "left").select("page", F.when(F.col("_p").isNull(), "RubyCandidate").otherwise("Body").alias("role"), "text")
    stored = table(spark, d, "orders").where("o_orderkey % 4 = 0").select(F.col("o_orderkey").alias("page"), F.lit("x").alias("code"), F.when(F.col("o_orderkey") % 8 == 0, "t").alias("text"))
    return summaries.package_reviews(layout.low_confidence(w), stored, words)


def all_issues(spark, d):
    o, k = table(spark, d, "orders"), F.col("o_orderkey")
    part = lambda n: o.where(k % n == 0).select(F.col("o_custkey").alias("book"), F.concat(F.lit("C"), k % 3).alias("code"), F.col("o_orderpriority").alias("message"))
    return summaries.all_issues(structured=part(7), converter=part(11), output=part(13)).groupBy("book", "code", "origin").agg(F.count("*").alias("n"), F.min("message").alias("first"))


def spanned_hash(spark, d):
    """Conversations as books: the hash of their paragraphs with their sources."""
    spans = paragraph_spans(spark, d).select("conv_id", "ordinal", F.col("page").alias("place"), "page", tx.marker(F.col("page") + 1).alias("marker"), "start", "length")
    from ..operators import assemble

    paras = assemble.paragraphs_of_pages(_pages(spark, d), "conv_id", "turn", "text", "join").withColumn("logical_key", F.concat(F.lit("k"), "ordinal"))
    return summaries.document_hash(paras, spans, "conv_id")


def reading_package(spark, d):
    """Conversations as batches: the files of each package by name, and how many entries their lists have."""
    t = table(spark, d, "conversations").select(F.col("conv_id").alias("batch"), "turn", "role", "text")
    spans = F.array(F.struct(tx.marker(F.col("turn") + 1).alias("page_marker"), F.lit(0).alias("start"), F.length("text").alias("length")))
    paragraphs = t.select("batch", F.col("turn").alias("ordinal"), F.concat(F.lit("P"), "turn").alias("paragraph_id"), "role", F.col("text").alias("plain_text"), spans.alias("spans"), F.lit("h").alias("document_hash"))
    pages = t.select("batch", tx.marker(F.col("turn") + 1).alias("page_marker"), F.col("turn").alias("page_id"))
    found = t.where("turn % 3 = 1").select("batch", tx.marker(F.col("turn") + 1).alias("page_marker"), F.col("turn").alias("ordinal"), F.col("role").alias("reading"))
    files = packages.reading_files(paragraphs, pages, found, "p", "PreserveOriginalOnly", "{}", "read this")
    n = F.coalesce(F.json_array_length(F.get_json_object("content", "$.paragraphs")), F.json_array_length(F.get_json_object("content", "$.pages")), F.json_array_length("content"), F.lit(0))
    return files.select("batch", "path", n.cast("long").alias("n"), F.get_json_object("content", "$.documentTextHash").alias("hash"))


QUERIES = {f.__name__: f for f in (history_of_batches, confirmation_summary, confirmation_aborted, status_change, run_plan, outcome_counts, rows_of_pages, page_validation, status_events, package_reviews, all_issues, spanned_hash, reading_package)}

_CONFIRMATION = _PROPOSALS + """,
s AS (SELECT *, CASE WHEN pos % 4 = 1 THEN 'Confirmed' ELSE status END AS st FROM r),
c AS (SELECT pos, code FROM x WHERE code NOT IN ('Overlap', 'MultipleReadings', 'Duplicate')
  UNION SELECT pos, 'LOW_ANNOTATION_CONFIDENCE' FROM r WHERE c < 0.7 UNION SELECT pos, 'STATUS_NOT_ELIGIBLE' FROM s WHERE st IN ('Stale', 'Rejected') UNION SELECT pos, 'MISSING_EVIDENCE_PAGE' FROM r WHERE m IS NULL UNION SELECT pos, 'MISSING_EVIDENCE' FROM r WHERE NOT evidence),
o AS (SELECT pos, CASE WHEN source <> 'TextConfirmed' THEN 'wrong_source' WHEN st = 'Confirmed' THEN 'already' WHEN {} OR pos IN (SELECT pos FROM c) THEN 'excluded' ELSE 'newly' END AS o FROM s),
w AS (SELECT {} AS code, count(*) AS n FROM o {} WHERE o = 'excluded' GROUP BY 1)
SELECT count(*) AS examined, count(*) FILTER (o = 'newly') AS newly, count(*) FILTER (o = 'already') AS already, count(*) FILTER (o = 'wrong_source') AS wrong_source, count(*) FILTER (o = 'excluded') AS excluded,
  (SELECT string_agg(code || ':' || n, ' ' ORDER BY code) FROM w) AS reasons FROM o
"""

SQL = {
    "history_of_batches": ANNOTATIONS + """,
n AS (SELECT o_custkey AS project, arg_max(o_orderkey % 3, (o_orderdate, o_orderkey)) AS s FROM orders GROUP BY 1),
a AS (SELECT page, count(*) AS t, count(*) FILTER (status = 'Confirmed') AS c, count(*) FILTER (status = 'Proposed') AS p FROM g GROUP BY page),
u AS (SELECT event_id % 2000 AS k, count(*) AS n FROM events GROUP BY 1)
SELECT o_orderkey AS id, coalesce(t, 0) AS annotations, coalesce(c, 0) AS confirmed, coalesce(p, 0) AS proposed, 0::BIGINT AS stale, coalesce(u.n, 0) AS unresolved, o_orderkey % 11 <> 0 AND o_orderkey % 3 = s AS current
FROM orders JOIN n ON n.project = o_custkey LEFT JOIN a ON a.page = o_orderkey LEFT JOIN u ON u.k = o_orderkey
""",
    "confirmation_summary": _CONFIRMATION.format("false", "code", "JOIN c USING (pos)"),
    "confirmation_aborted": _CONFIRMATION.format("true", "'VALIDATION_ABORTED'", ""),
    "status_change": ANNOTATIONS + "SELECT batch, count(*) AS selected, count(*) FILTER (status <> 'Confirmed') AS changed, count(*) FILTER (status = 'Confirmed') AS already FROM g GROUP BY batch",
    "run_plan": """
WITH s AS (SELECT o_custkey, o_orderkey % 5 AS s, o_orderpriority <> '1-URGENT' AS inc FROM orders)
SELECT o_custkey, count(*) FILTER (inc AND s IN (0, 1, 3)) AS targets, count(*) FILTER (inc AND s = 2) AS completed, count(*) FILTER (inc AND s = 4) AS review_required, count(*) FILTER (NOT inc) AS excluded,
  count(*) FILTER (inc AND s = 3) AS failed, count(*) FILTER (inc AND s = 1) AS processing, count(*) FILTER (inc AND s = 0) AS notprocessed FROM s GROUP BY 1
""",
    "outcome_counts": """
WITH r AS (SELECT event_id % 7 < 4 AS bad, event_id % 5 = 2 AS second, event_id % 11 = 0 AS c FROM events),
k AS (SELECT *, CASE WHEN NOT bad THEN 'Completed' WHEN second AND NOT c THEN 'ReviewRequired' ELSE 'Failed' END AS kind FROM r)
SELECT kind, count(*) AS pages, count(*) FILTER (kind <> 'Failed') AS succeeded, count(*) FILTER (bad) AS failures FROM k GROUP BY kind
""",
    "rows_of_pages": "SELECT o_orderkey AS page, count(l_orderkey) AS n, count(l_orderkey) > 0 AS there FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey AND l_returnflag = 'R' GROUP BY 1",
    "page_validation": """
WITH p AS (SELECT o_custkey, o_orderkey AS k, CASE WHEN o_orderkey % 11 <> 0 THEN o_orderkey % 50 END AS n FROM orders),
m AS (SELECT *, lag(n) OVER (PARTITION BY o_custkey ORDER BY k) AS was, count(*) OVER (PARTITION BY o_custkey, n) AS same FROM p WHERE n IS NOT NULL),
i AS (SELECT k FROM p WHERE n IS NULL UNION ALL SELECT k FROM m WHERE same > 1 UNION ALL SELECT k FROM m WHERE n > was + 1 UNION ALL SELECT k FROM m WHERE n < was UNION ALL SELECT k FROM p WHERE k % 2 <> 0)
SELECT p.k AS page, count(i.k) AS reviews FROM p LEFT JOIN i ON i.k = p.k GROUP BY 1
""",
    "status_events": """
SELECT c_custkey AS page, coalesce(s, 'Draft') AS status FROM customer LEFT JOIN (SELECT user_id, arg_max(CASE WHEN event_type = 'click' THEN 'Draft' ELSE 'Failed' END, (ts, event_id)) AS s FROM events WHERE event_type IN ('error', 'click') GROUP BY 1) ON user_id = c_custkey
""",
    "package_reviews": _BOXES + """,
m AS (SELECT page, list_sort(list("right" - "left")) AS w FROM x GROUP BY page),
a AS (SELECT x.*, w[len(w) // 2 + 1] AS median FROM x JOIN m USING (page))
SELECT page, 'LowConfidence' AS code, text FROM x WHERE "left" / 97 < 0.75 UNION SELECT o_orderkey, 'x', CASE WHEN o_orderkey % 8 = 0 THEN 't' ELSE '' END FROM orders WHERE o_orderkey % 4 = 0
UNION SELECT page, 'RubyCandidate', text FROM a WHERE text <> '、' AND "right" - "left" < median * 0.85 AND EXISTS (
  SELECT 1 FROM x b WHERE b.page = a.page AND b."right" - b."left" > a."right" - a."left" AND a.bottom > b.top AND a.top < b.bottom AND greatest(0, b."left" - a."right", a."left" - b."right") <= a.median)
""",
    "all_issues": """
WITH o AS (SELECT o_custkey AS book, 'C' || o_orderkey % 3 AS code, o_orderpriority AS message, o_orderkey AS k FROM orders),
u AS (SELECT *, 'structured' AS origin FROM o WHERE k % 7 = 0 UNION ALL SELECT *, 'converter' FROM o WHERE k % 11 = 0 UNION ALL SELECT *, 'output' FROM o WHERE k % 13 = 0)
SELECT book, code, origin, count(*) AS n, min(message) AS first FROM u GROUP BY 1, 2, 3
""",
    "spanned_hash": _LINES + """,
seg AS (SELECT conv_id, turn AS page, sum(length(piece)) OVER w AS hi, sum(length(piece)) OVER w - length(piece) AS lo FROM pieces WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
sp AS (SELECT p.conv_id, ordinal, page, CASE WHEN length > 0 THEN greatest(lo, start) - start ELSE 0 END::INTEGER AS s, CASE WHEN length > 0 THEN least(hi, start + length) - greatest(lo, start) ELSE 0 END::INTEGER AS n
  FROM paras p JOIN seg s ON p.conv_id = s.conv_id AND CASE WHEN length > 0 THEN lo < start + length AND hi > start ELSE lo <= greatest(start - 1, 0) AND greatest(start - 1, 0) < hi END),
j AS (SELECT conv_id, ordinal, string_agg(page || ':' || lpad((page + 1)::VARCHAR, 4, '0') || ':' || s || ':' || n, chr(30) ORDER BY page) AS spans FROM sp GROUP BY 1, 2)
SELECT p.conv_id, upper(sha256(string_agg(role || chr(31) || plain_text || chr(31) || 'k' || p.ordinal || chr(31) || coalesce(spans, ''), chr(10) ORDER BY p.ordinal))) AS hash FROM paras p LEFT JOIN j ON j.conv_id = p.conv_id AND j.ordinal = p.ordinal GROUP BY 1
""",
    "reading_package": """
WITH g AS (SELECT conv_id, count(*) AS n, count(*) FILTER (turn % 3 = 1) AS c FROM conversations GROUP BY 1)
SELECT conv_id AS batch, path, CASE path WHEN 'ruby-candidates.json' THEN c WHEN 'manifest.json' THEN n WHEN 'confirmed-document.json' THEN n ELSE 0 END AS n, CASE WHEN path IN ('manifest.json', 'confirmed-document.json') THEN 'h' END AS hash
FROM g, (VALUES ('manifest.json'), ('confirmed-document.json'), ('ruby-candidates.json'), ('output-schema.json'), ('instructions.md')) AS t(path)
""",
}
