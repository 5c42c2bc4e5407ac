"""URL filters: dated list entries become validity intervals, captures meet those active when they were fetched."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored, table

#: Rows of intervals that may be broadcast, after they have been counted.
BROADCAST_ROWS = 100_000


def host_of(url: Column) -> Column:
    """The lower-case host of a URL, without port, user and dots at its end; empty where there is none.  IPv6 hosts keep their brackets."""
    found = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?(\[[^\]/?#]*\]|[^/:?#]+)", 1)
    return F.lower(F.regexp_replace(found, r"\.+$", ""))


def keys_of(host: Column) -> Column:
    """The host and its parent domains of two labels or more; an address has no parents."""
    labels = F.split(host, r"\.")
    last = F.when(host.rlike(r"^(\[.*|[0-9.]+)$"), 1).otherwise(F.greatest(F.size(labels) - 1, F.lit(1)))
    return F.when(host == "", F.array().cast("array<string>")).otherwise(F.transform(F.sequence(F.lit(1), last), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), ".")))


def intervals(entries: DataFrame) -> DataFrame:
    """entries: (key, at, action), action add or remove.  (key, since, until) while a key is listed; until is null if it still is.

    Repeated adds or removes change nothing; of entries with the same key and time a removal counts.  Entries with a null in any
    of the three columns are ignored.
    """
    clean = entries.where("key is not null and at is not null and action in ('add', 'remove')").groupBy("key", "at").agg(F.max("action").alias("action"))
    by_key = Window.partitionBy("key").orderBy("at")
    turns = clean.withColumn("was", F.lag("action").over(by_key)).where("was is null or was <> action")
    return turns.withColumn("until", F.lead("at").over(by_key)).where("action = 'add'").select("key", F.col("at").alias("since"), "until")


def evaluate(captures: DataFrame, entries: DataFrame, url: str = "url", at: str = "at") -> DataFrame:
    """captures (id, url, at) with host, n_active, blocked and matched (the smallest active key, or null).

    One row a capture, none lost: a null or odd URL, or a null time, matches nothing; captures that share an id are judged each
    by its own host and time, and equal rows alike.  The as-of condition is an equality on
    the key and a residual range, so a hot host is split by the adaptive skew join or needs no shuffle at all where the
    intervals are few.
    """
    spans = stored(intervals(entries), "url-intervals")
    if spans.count() <= BROADCAST_ROWS:
        spans = F.broadcast(spans)
    c = captures.select("id", host_of(F.coalesce(F.col(url), F.lit(""))).alias("host"), F.col(at).alias("at"))
    each = c.distinct().select("id", "host", "at", F.explode(keys_of(F.col("host"))).alias("key"))
    active = each.join(spans, "key").where((F.col("since") <= F.col("at")) & (F.col("until").isNull() | (F.col("at") < F.col("until"))))
    found = active.groupBy(F.col("id").alias("f_id"), F.col("host").alias("f_host"), F.col("at").alias("f_at")).agg(F.count_distinct("key").alias("n_active"), F.min("key").alias("matched"))
    same = F.col("id").eqNullSafe(F.col("f_id")) & (F.col("host") == F.col("f_host")) & (F.col("at") == F.col("f_at"))
    return c.join(found, same, "left").select("id", "host", "at", F.coalesce("n_active", F.lit(0)).cast("long").alias("n_active"), F.col("n_active").isNotNull().alias("blocked"), "matched")


def dated_entries(pages: DataFrame) -> DataFrame:
    """A dated list for the test tables, which have none: hosts and domains of the pages, added and removed on days their hash names."""
    keys = pages.select(F.explode(keys_of(host_of(F.coalesce(F.col("url"), F.lit(""))))).alias("key")).distinct()
    c = keys.select("key", F.conv(F.substring(F.md5("key"), 1, 6), 16, 10).cast("long").alias("c")).where("c % 3 = 0")
    event = lambda action, day, cond: F.when(cond, F.struct(day.cast("long").alias("at"), F.lit(action).alias("action")))
    day = F.col("c") % 300
    rows = F.array(event("add", day, F.lit(True)), event("remove", day + 30, F.col("c") % 2 == 0), event("add", day + 60, F.col("c") % 5 == 0))
    return c.select("key", F.inline(F.array_compact(rows)))


def op2_urlfilter(spark, sf_dir: str) -> DataFrame:
    """Every capture with its host, its day, and what was listed then; the fetch day, which pages lacks, is page_id modulo 365."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    found = evaluate(pages.select(F.col("page_id").alias("id"), "url", (F.col("page_id") % 365).alias("at")), dated_entries(pages))
    return found.withColumnsRenamed({"id": "page_id", "at": "fetched"})


SQL = r"""
WITH c AS (
  SELECT page_id, lower(regexp_replace(regexp_extract(coalesce(url, ''), '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?(\[[^\]/?#]*\]|[^/:?#]+)', 1), '\.+$', '')) AS host, page_id % 365 AS fetched FROM pages),
l AS (SELECT *, string_split(host, '.') AS labels FROM c WHERE host <> ''),
k AS (SELECT page_id, fetched, unnest(list_transform(range(1, CASE WHEN regexp_matches(host, '^(\[.*|[0-9.]+)$') THEN 1 ELSE greatest(len(labels) - 1, 1) END + 1), lambda i: array_to_string(labels[i:], '.'))) AS key FROM l),
h AS (SELECT DISTINCT key, ('0x' || substr(md5(key), 1, 6))::BIGINT AS c FROM k),
e AS (
  SELECT key, c % 300 AS at, 'add' AS action FROM h WHERE c % 3 = 0
  UNION ALL SELECT key, c % 300 + 30, 'remove' FROM h WHERE c % 3 = 0 AND c % 2 = 0
  UNION ALL SELECT key, c % 300 + 60, 'add' FROM h WHERE c % 3 = 0 AND c % 5 = 0),
asof_ AS (
  SELECT k.page_id, k.key, arg_max(e.action, e.at) AS action FROM k JOIN e ON k.key = e.key AND e.at <= k.fetched GROUP BY 1, 2),
a AS (SELECT page_id, count(*) AS n_active, min(key) AS matched FROM asof_ WHERE action = 'add' GROUP BY 1)
SELECT c.page_id, c.host, c.fetched, coalesce(a.n_active, 0) AS n_active, a.page_id IS NOT NULL AS blocked, a.matched FROM c LEFT JOIN a USING (page_id)
"""
