"""Queries of state, rules and layout, over the order and event tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import layout, ranges, rules, state
from ..sources.tables import table

#: The order flags as run states, the events as annotation states.
RUN_STATES = ("NotProcessed", "Processing", "Completed", "Failed", "ReviewRequired")
EVENT_STATUS = {"purchase": "Confirmed", "view": "Proposed", "click": "Stale", "error": "Rejected", "signup": "Rejected"}


def resume_plan(spark, d):
    o = table(spark, d, "orders").withColumn("status", F.get(F.array(*map(F.lit, RUN_STATES)), (F.col("o_orderkey") % 5).cast("int")))
    taken = rules.resume_targets(o, "status", F.col("o_orderpriority") != "1-URGENT", "ResumeIncomplete")
    return taken.groupBy("status").agg(F.count("*").alias("n"), F.min("o_orderkey").alias("first"))


def sequence_issues(spark, d):
    o = table(spark, d, "orders").withColumn("printed", F.when(F.col("o_orderkey") % 11 == 0, F.lit("x")).otherwise((F.col("o_orderkey") % 50).cast("string")))
    return rules.sequence_issues(o, "o_custkey", "o_orderkey", "printed")


def natural_order(spark, d):
    """Names in natural order: customers are zero-padded, so the number alone is taken for every second one."""
    name = F.when(F.col("c_custkey") % 2 == 0, F.concat(F.lit("page-"), "c_custkey", F.lit(".png"))).otherwise(F.col("c_name"))
    c = table(spark, d, "customer").select("c_custkey", tx.natural_key(name).alias("sort_key"))
    return state.numbered(c, ["sort_key", "c_custkey"], "position")


def latest_per_key(spark, d):
    return state.latest(table(spark, d, "events").select("user_id", "event_id", "ts", "event_type"), ["user_id"], ["ts", "event_id"])


def append_if_changed(spark, d):
    return state.append_if_changed(table(spark, d, "events").select("user_id", "event_id", "ts", "event_type"), ["user_id"], ["ts", "event_id"], ["event_type"])


def active_text(spark, d):
    e = table(spark, d, "events").select("user_id", "event_id", "ts", "event_type")
    return state.active_text(e.where("event_type = 'purchase'"), e.where("event_type = 'view'"), "user_id", "ts", ["ts", "event_id"])


def _annotations(spark, d):
    pick = F.create_map(*(F.lit(x) for kv in EVENT_STATUS.items() for x in kv))
    e = table(spark, d, "events")
    return e.select("user_id", (F.get_json_object("props", "$.k").cast("long") % 10).alias("slot"), pick[F.col("event_type")].alias("status"), F.floor("value").alias("reading"), "ts", "event_id")


_ANNOTATIONS = """
WITH a AS (SELECT user_id, (props->>'$.k')::BIGINT % 10 AS slot, CASE event_type WHEN 'purchase' THEN 1 WHEN 'view' THEN 2 WHEN 'click' THEN 3 END AS rank,
    CASE event_type WHEN 'purchase' THEN 'Confirmed' WHEN 'view' THEN 'Proposed' WHEN 'click' THEN 'Stale' ELSE 'Rejected' END AS status, floor(value)::BIGINT AS reading, ts, event_id FROM events),
b AS (SELECT *, min(rank) OVER (PARTITION BY user_id, slot) AS best FROM a),
t AS (SELECT * FROM b WHERE rank = best),
n AS (SELECT user_id, slot, count(DISTINCT reading) AS readings FROM t WHERE rank < 3 GROUP BY 1, 2 HAVING count(DISTINCT reading) > 1)
"""


def effective_selection(spark, d):
    held, _ = state.effective(_annotations(spark, d), ["user_id", "slot"], "status", "reading", ["ts", "event_id"])
    return held.select("user_id", "slot", "status", "reading", "event_id")


def selection_conflicts(spark, d):
    return state.effective(_annotations(spark, d), ["user_id", "slot"], "status", "reading", ["ts", "event_id"])[1]


def unresolved_minus_annotated(spark, d):
    a = _annotations(spark, d)
    held, _ = state.effective(a, ["user_id", "slot"], "status", "reading", ["ts", "event_id"])
    return a.where("status = 'Rejected'").select("user_id", "slot").distinct().join(held, ["user_id", "slot"], "left_anti")


def batch_history(spark, d):
    o, a = table(spark, d, "orders"), table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_returnflag")
    rows = rules.history(o.select("o_orderkey", "o_custkey", "o_orderdate"), a, "o_orderkey", "l_returnflag", {"confirmed": "A", "proposed": "N", "stale": "R"}, "o_custkey", ["o_orderdate", "o_orderkey"])
    return rows.drop("o_orderdate")


def latest_annotated_batch(spark, d):
    o = table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_orderdate")
    some = o.join(table(spark, d, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey"), "left_semi")
    return state.latest(some, ["o_custkey"], ["o_orderdate", "o_orderkey"]).select("o_custkey", "o_orderkey")


def overlap_conflicts(spark, d):
    """Confirmed lines of a part and flag as day ranges; the id is the order and line."""
    line = table(spark, d, "lineitem").where("l_returnflag = 'A'").groupBy("l_partkey", "l_orderkey", "l_linenumber").agg(F.min(F.datediff("l_shipdate", F.lit("1990-01-01"))).alias("start"), F.max(F.col("l_quantity").cast("int")).alias("length"))
    ids = line.withColumn("id", F.col("l_orderkey") * 100 + F.col("l_linenumber"))
    return ranges.overlaps(ids, ["l_partkey"], "id", "start", "length")


def stale_propagation(spark, d):
    """A customer whose balance is negative makes the open orders' unreturned lines stale."""
    c = table(spark, d, "customer").where("c_acctbal < 0").select(F.col("c_custkey").alias("o_custkey"))
    o = table(spark, d, "orders").join(c, "o_custkey", "left_semi").where("o_orderstatus <> 'F'").select(F.col("o_orderkey").alias("l_orderkey"))
    hit = table(spark, d, "lineitem").where("l_returnflag <> 'R'").join(o, "l_orderkey", "left_semi")
    return hit.groupBy("l_orderkey").agg(F.count("*").alias("stale"))


def _orders(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority")
    new = o.select("o_orderkey", F.when(F.col("o_orderkey") % 9 == 0, F.lit(None)).otherwise(F.col("o_custkey")).alias("o_custkey"), F.when(F.col("o_orderkey") % 4 == 0, "F").otherwise(F.col("o_orderstatus")).alias("o_orderstatus"), F.when(F.col("o_orderkey") % 6 == 0, "5-LOW").otherwise(F.col("o_orderpriority")).alias("o_orderpriority"))
    return o, new


_ORDERS = """
WITH n AS (SELECT o_orderkey, CASE WHEN o_orderkey % 9 <> 0 THEN o_custkey END AS o_custkey, CASE WHEN o_orderkey % 4 = 0 THEN 'F' ELSE o_orderstatus END AS o_orderstatus,
    CASE WHEN o_orderkey % 6 = 0 THEN '5-LOW' ELSE o_orderpriority END AS o_orderpriority FROM orders),
c AS (SELECT o.o_orderkey, o.o_custkey IS DISTINCT FROM n.o_custkey OR o.o_orderstatus IS DISTINCT FROM n.o_orderstatus AS structure, o.o_orderpriority IS DISTINCT FROM n.o_orderpriority AS image, o.o_orderstatus AS old_status
    FROM orders o JOIN n USING (o_orderkey))
"""


def change_impact(spark, d):
    return state.changes(*_orders(spark, d), "o_orderkey", {"structure": ["o_custkey", "o_orderstatus"], "image": ["o_orderpriority"]})


def guarded_history(spark, d):
    old, new = _orders(spark, d)
    changed = state.changes(old, new, "o_orderkey", {"any": ["o_custkey", "o_orderstatus", "o_orderpriority"]}).where("any").select("o_orderkey")
    return old.join(changed, "o_orderkey", "left_semi").select("o_orderkey", F.col("o_orderstatus").alias("old_status"))


def marker_reconcile(spark, d):
    o = table(spark, d, "orders").select("o_orderkey")
    given = o.where("o_orderkey % 3 <> 0").union(o.where("o_orderkey % 10 = 0").select(-F.col("o_orderkey") - 1))
    return state.reconcile(o, given, "o_orderkey")


def status_restore(spark, d):
    o = table(spark, d, "orders").select("o_orderkey")
    words = table(spark, d, "lineitem").where("l_linenumber = 1").select(F.col("l_orderkey").alias("o_orderkey"))
    reviews = table(spark, d, "events").where("event_type = 'error'").select(F.col("event_id").alias("o_orderkey"))
    return state.restored_status(o, "o_orderkey", words, reviews)


def child_recount(spark, d):
    return state.recount(table(spark, d, "customer").select("c_custkey"), table(spark, d, "orders"), "c_custkey", "o_custkey", "n_orders")


def bulk_summary(spark, d):
    """Events as annotations: errors are issues of their user; the value, over 100, stands for the confidence."""
    e = table(spark, d, "events")
    bad = e.where("event_type = 'error'").groupBy(F.col("user_id").alias("b_id")).agg(F.count("*").alias("issues"))
    rows = e.where("event_type <> 'error'").join(bad, F.col("user_id") == F.col("b_id"), "left")
    return rules.classified(
        rows, {"wrong_source": F.col("event_type") == "signup", "already": F.col("event_type") == "purchase", "low_confidence": F.col("value") < 70, "issue": F.col("issues") > 3}, "confirmed",
    )


def multi_readings(spark, d):
    return rules.multiple_readings(table(spark, d, "part"), "p_brand", "p_type")


def _boxes(spark, d):
    """Lines as boxes: a row a key, whole numbers, so that both engines compute the same."""
    l = table(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_partkey").alias("pk"), F.min("l_quantity").alias("q"), F.min("l_suppkey").alias("sk"))
    left, top = (F.col("pk") % 97).cast("double"), (F.col("sk") % 53).cast("double")
    return l.select(F.col("l_orderkey").alias("page"), F.col("l_linenumber").cast("long").alias("id"), F.when(F.col("pk") % 13 == 0, "、").otherwise("本文").alias("text"), left.alias("left"), top.alias("top"), (left + F.col("q") % 8 + 1).alias("right"), (top + F.col("q") + 1).alias("bottom"))


_BOXES = """
WITH g AS (SELECT l_orderkey AS page, l_linenumber::BIGINT AS id, min(l_partkey) AS pk, min(l_quantity) AS q, min(l_suppkey) AS sk FROM lineitem GROUP BY 1, 2),
x AS (SELECT page, id, CASE WHEN pk % 13 = 0 THEN '、' ELSE '本文' END AS text, (pk % 97)::DOUBLE AS "left", (sk % 53)::DOUBLE AS top, pk % 97 + q % 8 + 1 AS "right", sk % 53 + q + 1 AS bottom FROM g)
"""


def thin_box_filter(spark, d):
    return layout.thin_boxes(_boxes(spark, d), "page").select("page", "id")


def nearest_link(spark, d):
    b = _boxes(spark, d)
    return layout.nearest_links(b.where("id = 1"), b.where("id > 1"), "page").select("page", "id", "body", F.round("confidence", 6).alias("confidence"))


def reading_columns(spark, d):
    b = _boxes(spark, d).select("page", "id", ((F.col("left") + F.col("right")) / 2).alias("x"), F.col("top").alias("y"))
    return layout.reading_order(b, "page", 20.0)


def evidence_match(spark, d):
    """Lines are annotations and events candidates, by part and user: the first reason that one is not matched."""
    a = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("id"), "l_linenumber", "l_partkey", F.floor("l_quantity").alias("reading"))
    c = table(spark, d, "events").select(F.col("user_id").alias("l_partkey"), F.floor(F.col("value") / 2).alias("reading"), (F.col("value") >= 50).alias("sure"))
    by_page = c.groupBy(F.col("l_partkey").alias("p1")).agg(F.count("*").alias("n"))
    same = c.groupBy(F.col("l_partkey").alias("p2"), F.col("reading").alias("r2")).agg(F.bool_or("sure").alias("sure"))
    j = a.join(by_page, F.col("l_partkey") == F.col("p1"), "left").join(same, (F.col("l_partkey") == F.col("p2")) & (F.col("reading") == F.col("r2")), "left")
    reason = F.when(F.col("n").isNull(), "NoCandidate").when(F.col("r2").isNull(), "ImageCandidateMismatch").when(~F.col("sure"), "LowOcrCandidateConfidence").otherwise("Matched")
    return j.groupBy(reason.alias("reason")).agg(F.count("*").alias("n"), F.sum("id").alias("ids"))


QUERIES = {f.__name__: f for f in (resume_plan, sequence_issues, natural_order, latest_per_key, append_if_changed, active_text, effective_selection, selection_conflicts, unresolved_minus_annotated, batch_history, latest_annotated_batch, overlap_conflicts, stale_propagation, change_impact, guarded_history, marker_reconcile, status_restore, child_recount, bulk_summary, multi_readings, thin_box_filter, nearest_link, reading_columns, evidence_match)}

SQL = {
    "resume_plan": """
WITH s AS (SELECT *, ['NotProcessed', 'Processing', 'Completed', 'Failed', 'ReviewRequired'][(o_orderkey % 5 + 1)::INTEGER] AS status FROM orders)
SELECT status, count(*) AS n, min(o_orderkey) AS first FROM s WHERE o_orderpriority <> '1-URGENT' AND status IN ('NotProcessed', 'Failed', 'Processing') GROUP BY status
""",
    "sequence_issues": """
WITH p AS (SELECT o_custkey, o_orderkey, CASE WHEN o_orderkey % 11 <> 0 THEN o_orderkey % 50 END AS n FROM orders),
m AS (SELECT *, lag(n) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS was, count(*) OVER (PARTITION BY o_custkey, n) AS same FROM p WHERE n IS NOT NULL)
SELECT o_custkey, o_orderkey, 'NonNumeric' AS code FROM p WHERE n IS NULL UNION ALL SELECT o_custkey, o_orderkey, 'Duplicate' FROM m WHERE same > 1
UNION ALL SELECT o_custkey, o_orderkey, 'Gap' FROM m WHERE n > was + 1 UNION ALL SELECT o_custkey, o_orderkey, 'Reversal' FROM m WHERE n < was
""",
    "natural_order": r"""
WITH k AS (SELECT c_custkey, array_to_string(list_transform(regexp_extract_all(CASE WHEN c_custkey % 2 = 0 THEN 'page-' || c_custkey || '.png' ELSE c_name END, '([0-9]+|[^0-9]+)'),
    lambda p: CASE WHEN regexp_matches(p, '^[0-9]') THEN lpad(p::BIGINT::VARCHAR, 19, '0') ELSE upper(p) END), '') AS sort_key FROM customer)
SELECT c_custkey, sort_key, row_number() OVER (ORDER BY sort_key, c_custkey) - 1 AS position FROM k
""",
    "latest_per_key": "SELECT user_id, event_id, ts, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1",
    "append_if_changed": "SELECT user_id, event_id, ts, event_type FROM (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS was FROM events) WHERE was IS DISTINCT FROM event_type",
    "active_text": """
SELECT user_id, event_id, ts, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events e
  WHERE event_type = 'purchase' AND NOT EXISTS (SELECT 1 FROM events m WHERE m.event_type = 'view' AND m.user_id = e.user_id AND m.ts > e.ts)) WHERE r = 1
""",
    "effective_selection": _ANNOTATIONS + """
SELECT user_id, slot, status, reading, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id, slot ORDER BY ts DESC, event_id DESC) AS r FROM t
  WHERE NOT EXISTS (SELECT 1 FROM n WHERE n.user_id = t.user_id AND n.slot = t.slot)) WHERE r = 1
""",
    "selection_conflicts": _ANNOTATIONS + "SELECT user_id, slot, readings FROM n",
    "unresolved_minus_annotated": _ANNOTATIONS + """
SELECT DISTINCT user_id, slot FROM a WHERE status = 'Rejected' AND NOT EXISTS (
  SELECT 1 FROM t WHERE t.user_id = a.user_id AND t.slot = a.slot AND NOT EXISTS (SELECT 1 FROM n WHERE n.user_id = t.user_id AND n.slot = t.slot))
""",
    "batch_history": """
WITH h AS (SELECT o_orderkey, o_custkey, o_orderdate, count(l_orderkey) AS total, count(*) FILTER (l_returnflag = 'A') AS confirmed, count(*) FILTER (l_returnflag = 'N') AS proposed, count(*) FILTER (l_returnflag = 'R') AS stale
  FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1, 2, 3)
SELECT o_orderkey, o_custkey, total, confirmed, proposed, stale,
  total > 0 AND row_number() OVER (PARTITION BY o_custkey ORDER BY total > 0 DESC, o_orderdate DESC, o_orderkey DESC) = 1 AS current FROM h
""",
    "latest_annotated_batch": "SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS r FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem)) WHERE r = 1",
    "overlap_conflicts": """
WITH g AS (SELECT l_partkey, l_orderkey * 100 + l_linenumber AS id, min(date_diff('day', DATE '1990-01-01', l_shipdate::DATE)) AS s, max(l_quantity)::INTEGER AS n FROM lineitem WHERE l_returnflag = 'A' GROUP BY 1, 2)
SELECT a.l_partkey, a.id AS earlier, b.id AS later FROM g a JOIN g b ON a.l_partkey = b.l_partkey AND a.id < b.id AND a.s < b.s + b.n AND b.s < a.s + a.n
""",
    "stale_propagation": """
SELECT l_orderkey, count(*) AS stale FROM lineitem WHERE l_returnflag <> 'R' AND l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'F' AND o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)) GROUP BY 1
""",
    "change_impact": _ORDERS + "SELECT o_orderkey, structure, image FROM c",
    "guarded_history": _ORDERS + "SELECT o_orderkey, old_status FROM c WHERE structure OR image",
    "marker_reconcile": """
WITH g AS (SELECT o_orderkey AS k FROM orders WHERE o_orderkey % 3 <> 0 UNION SELECT -o_orderkey - 1 FROM orders WHERE o_orderkey % 10 = 0)
SELECT coalesce(o_orderkey, k) AS o_orderkey, CASE WHEN k IS NULL THEN 'missing' WHEN o_orderkey IS NULL THEN 'unknown' ELSE 'matched' END AS state FROM orders FULL JOIN g ON k = o_orderkey
""",
    "status_restore": """
SELECT o_orderkey, CASE WHEN o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_linenumber = 1) THEN 'NotProcessed'
  WHEN o_orderkey IN (SELECT event_id FROM events WHERE event_type = 'error') THEN 'ReviewRequired' ELSE 'Completed' END AS status FROM orders
""",
    "child_recount": "SELECT c_custkey, count(o_orderkey) AS n_orders FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1",
    "bulk_summary": """
WITH b AS (SELECT user_id, count(*) AS issues FROM events WHERE event_type = 'error' GROUP BY 1)
SELECT CASE WHEN event_type = 'signup' THEN 'wrong_source' WHEN event_type = 'purchase' THEN 'already' WHEN value < 70 THEN 'low_confidence' WHEN issues > 3 THEN 'issue' ELSE 'confirmed' END AS outcome, count(*) AS n
FROM events e LEFT JOIN b ON b.user_id = e.user_id WHERE event_type <> 'error' GROUP BY 1
""",
    "multi_readings": "SELECT p_brand, count(DISTINCT p_type) AS readings, string_agg(DISTINCT p_type, '|' ORDER BY p_type) AS listed FROM part GROUP BY 1 HAVING count(DISTINCT p_type) > 1",
    "thin_box_filter": _BOXES + """,
m AS (SELECT page, list_sort(list("right" - "left")) AS w FROM x GROUP BY page),
a AS (SELECT x.*, w[len(w) // 2 + 1] AS median FROM x JOIN m USING (page))
SELECT page, id FROM a WHERE text = '、' OR NOT ("right" - "left" < median * 0.85 AND EXISTS (
  SELECT 1 FROM x b WHERE b.page = a.page AND b."right" - b."left" > a."right" - a."left" AND a.bottom > b.top AND a.top < b.bottom AND greatest(0, b."left" - a."right", a."left" - b."right") <= a.median))
""",
    "nearest_link": _BOXES + """,
p AS (SELECT r.page, r.id, b.id AS body, least(r.bottom, b.bottom) - greatest(r.top, b.top) AS o, greatest(0, r."left" - b."right", b."left" - r."right") AS gap,
    greatest(1, r."right" - r."left", b."right" - b."left") AS scale, r.bottom - r.top AS h1, b.bottom - b.top AS h2, (r.bottom - r.top) / length(r.text) AS e1, (b.bottom - b.top) / length(b.text) AS e2
  FROM x r JOIN x b ON r.page = b.page AND r.id = 1 AND b.id > 1),
s AS (SELECT page, id, body, gap / scale + (1 - least(1, o / least(h1, h2))) * 0.25 + abs(e1 - e2) / greatest(1, e1, e2) * 0.25 AS score FROM p WHERE o > 0 AND gap <= scale * 3),
k AS (SELECT *, row_number() OVER w AS r, lead(score) OVER w AS second FROM s WINDOW w AS (PARTITION BY page, id ORDER BY score, body))
SELECT page, id, body, round(1 / (1 + score), 6) AS confidence FROM k WHERE r = 1 AND (second IS NULL OR abs(second - score) >= 0.1)
""",
    "evidence_match": """
WITH c AS (SELECT user_id AS p, floor(value / 2)::BIGINT AS reading, value >= 50 AS sure FROM events), g AS (SELECT DISTINCT p FROM c), s AS (SELECT p, reading, bool_or(sure) AS sure FROM c GROUP BY 1, 2)
SELECT CASE WHEN g.p IS NULL THEN 'NoCandidate' WHEN s.p IS NULL THEN 'ImageCandidateMismatch' WHEN NOT sure THEN 'LowOcrCandidateConfidence' ELSE 'Matched' END AS reason, count(*) AS n, sum(l_orderkey)::BIGINT AS ids
FROM lineitem LEFT JOIN g ON g.p = l_partkey LEFT JOIN s ON s.p = l_partkey AND s.reading = floor(l_quantity)::BIGINT GROUP BY 1
""",
}
