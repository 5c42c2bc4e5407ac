"""Benchmark decontamination by winnowing: only built-in functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, let, sha256_hex, stored, table, without_rows

#: Words of a window, words of a k-gram, and so many k-grams compete for one fingerprint: any shared span of WINDOW words has one.
WINDOW, KGRAM = 13, 7
CHOICE = WINDOW - KGRAM + 1
#: Everything but ASCII letters, digits and non-ASCII parts words; capitals are lower-cased before.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: A document is contaminated if it has a hit and at least one word in so many is hit.
SHARE = 20
#: Rows that may be broadcast, after they have been counted; more go through a shuffled join.
BROADCAST_ROWS = 200_000


def words(text: Column) -> Column:
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), SEPARATORS), "")


def _positions(n: Column, length: int) -> Column:
    return F.when(n >= length, F.sequence(F.lit(0), n - length)).otherwise(F.array().cast("array<int>"))


def _grams(hashes: Column, length: int) -> Column:
    """A hash for each run of length words."""
    return F.transform(_positions(F.size(hashes), length), lambda i: F.xxhash64(F.lit(length), *(F.get(hashes, i + j) for j in range(length))))


def fingerprints(hashes: Column, length: int) -> Column:
    """A fingerprint for each window: winnowed for whole windows, the window's own hash for an item's shorter one."""
    if length < WINDOW:
        return _grams(hashes, length)
    least = lambda k: F.transform(_positions(F.size(hashes), WINDOW), lambda i: F.least(*(F.get(k, i + j) for j in range(CHOICE))))
    return let(_grams(hashes, KGRAM), least)


def _hashes(ws: Column) -> Column:
    return F.transform(ws, lambda w: F.xxhash64(w))


def _small(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def contaminated(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """(doc_id, n_words, n_hit, items): one row per row of docs; items are the ids, as sorted strings, that occur in the text.

    A window is WINDOW consecutive words of an item, a shorter item is one window.  Both sides keep the least k-gram hash of
    each window and meet on those; where they meet, the window's words themselves are compared, so a hash never decides.
    Null and empty texts have no words and no hits; items without words are ignored; repeated rows, of either side, give the
    same results for each; other columns are ignored.  A passage that very many documents hold costs each one row.
    """
    return _contaminated(docs, items, doc_id, text, item_id, item_text).drop("th")


def _contaminated(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """contaminated() with th, the text's hash, which with doc_id names a row."""
    d = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    windows = _windows(items.select(F.col(item_id).cast("string").alias("item_id"), F.col(item_text).alias("text")))
    lengths = sorted(r.length for r in windows.select("length").distinct().collect())  # 1 to WINDOW at most
    keys = stored(windows.select("fp").distinct(), "decontamination-fps")
    key_rows = keys.count()
    # A null fingerprint stands for the row itself and brings its number of words along; in the join each has a place of its own.
    ids = F.xxhash64("text").alias("th")
    of = let(words(F.col("text")), lambda ws: F.struct(F.size(ws).alias("n_words"), let(_hashes(ws), lambda h: F.array_distinct(F.concat(F.array(F.lit(None).cast("long")), *(fingerprints(h, n) for n in lengths)))).alias("fps")))
    seen = d.select("doc_id", ids, F.explode(F.array(of)).alias("r")).select("doc_id", "th", F.col("r.n_words").alias("n_words"), F.explode("r.fps").alias("fp"))
    marked = seen.withColumn("at", F.coalesce("fp", F.xxhash64("doc_id", "th"))).join(_small(keys.select(F.col("fp").alias("key"), F.lit(True).alias("known")), key_rows), F.col("at") == F.col("key"), "left")
    met = marked.where(F.col("fp").isNull() | F.col("known"))
    base = stored(met.groupBy("doc_id", "th").agg(F.max("n_words").alias("n_words"), F.collect_set("fp").alias("fps"), F.count_if(F.col("fp").isNull()).alias("copies")), "decontamination-met")
    hit = base.where(F.size("fps") > 0).select(F.col("doc_id").alias("hit_id"), F.col("th").alias("hit_th"), "fps")
    n_hit = hit.count()
    found = _extended(d, ids, _small(hit, n_hit), windows, lengths) if n_hit else None
    out = base
    if found is not None:
        out = base.join(found, base.doc_id.eqNullSafe(found.f_id) & (base.th == found.f_th), "left")
    else:
        out = base.withColumns({"n_hit": F.lit(0).cast("long"), "items": F.array().cast("array<string>")})
    each = F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))
    return out.select("doc_id", "th", F.col("n_words").cast("long").alias("n_words"), F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.coalesce("items", F.array().cast("array<string>")).alias("items"), each.alias("_c")).drop("_c")


def _windows(items: DataFrame) -> DataFrame:
    """(item_id, length, fp, window) of all items' windows."""
    w = items.select("item_id", F.explode(F.array(words(F.col("text")))).alias("ws")).where(F.size("ws") > 0)
    w = w.withColumn("length", F.least(F.size("ws"), F.lit(WINDOW)))
    parts = []
    for n in range(1, WINDOW + 1):
        parts.append(F.when(F.col("length") == n, _window_rows(F.col("ws"), n)))
    return stored(w.select("item_id", "length", F.inline(F.coalesce(*parts))).select("item_id", "length", "fp", "window").distinct(), "decontamination-windows")


def _window_rows(ws: Column, n: int, wanted: Column | None = None) -> Column:
    """array<struct<start, len, fp, window>>; only the wanted fingerprints' windows are spelled out."""

    def rows(fps: Column) -> Column:
        at = F.sequence(F.lit(0), F.size(fps) - 1)
        chosen = at if wanted is None else F.filter(at, lambda i: F.array_contains(wanted, F.get(fps, i)))
        out = F.transform(chosen, lambda i: F.struct(i.alias("start"), F.lit(n).alias("len"), F.get(fps, i).alias("fp"), F.array_join(F.slice(ws, i + 1, F.lit(n)), " ").alias("window")))
        return F.when(F.size(fps) > 0, out).otherwise(F.array().cast("array<struct<start:int,len:int,fp:bigint,window:string>>"))

    return let(let(_hashes(ws), _fingerprints_of(n)), rows)


def _fingerprints_of(n: int):
    return lambda h: fingerprints(h, n)


def _extended(d: DataFrame, ids: Column, hit: DataFrame, windows: DataFrame, lengths: list[int]) -> DataFrame:
    """(f_id, f_th, n_hit, items): the windows at fingerprints that met, compared word for word, and the words they cover.

    Only texts with such a fingerprint are read on; rows that repeat give their spans again, which count once.
    """
    cand = d.select("doc_id", ids, "text").join(hit, F.col("doc_id").eqNullSafe(F.col("hit_id")) & (F.col("th") == F.col("hit_th")))
    cand = cand.select("hit_id", "hit_th", "fps", F.explode(F.array(words(F.col("text")))).alias("ws"))
    at = cand.select(F.col("hit_id").alias("f_id"), F.col("hit_th").alias("f_th"), F.inline(F.concat(*(_window_rows(F.col("ws"), n, F.col("fps")) for n in lengths)))).drop("fp")
    named = windows.groupBy("window").agg(F.collect_set("item_id").alias("ids"))
    same = at.join(_small(named, windows.count()), "window")
    spans = same.groupBy("f_id", "f_th").agg(F.array_sort(F.collect_set(F.struct("start", "len"))).alias("spans"), F.collect_set("ids").alias("ids"))
    zero = F.struct(F.lit(0).alias("end"), F.lit(0).alias("n"))
    covered = F.aggregate("spans", zero, lambda a, s: F.struct(F.greatest(a["end"], s["start"] + s["len"]).alias("end"), (a["n"] + F.greatest(F.lit(0), s["start"] + s["len"] - F.greatest(a["end"], s["start"]))).alias("n")))
    return spans.select("f_id", "f_th", covered["n"].alias("n_hit"), F.array_sort(F.array_distinct(F.flatten("ids"))).alias("items"))


def is_contaminated() -> Column:
    return (F.col("n_hit") > 0) & (F.col("n_hit") * SHARE >= F.col("n_words"))


def op7_decontamination(spark, sf_dir: str) -> DataFrame:
    """contaminated() of documents and benchmark: a row for each document, null texts and ids included."""
    found = contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), sha256_hex(F.concat_ws(",", "items")).alias("items_sha256"), is_contaminated().alias("contaminated"))


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops contaminated rows: a null doc_id is an id like any other, and of several texts of one doc_id only contaminated ones go."""
    bad = _contaminated(docs, table(spark, sf_dir, "benchmark")).where(is_contaminated()).select("doc_id", "th").distinct()
    return without_rows(docs, stored(bad, "decontamination-bad"), BROADCAST_ROWS)


SQL = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
b AS (SELECT item_id::VARCHAR AS item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
i AS (SELECT DISTINCT item_id, least(len(ws), {WINDOW}) AS n, array_to_string(ws[s:s + least(len(ws), {WINDOW}) - 1], ' ') AS k FROM b, unnest(range(1, greatest(len(ws) - {WINDOW - 1}, 1) + 1)) AS t(s) WHERE len(ws) > 0),
m AS (SELECT doc_id, s, l.n, array_to_string(ws[s:s + l.n - 1], ' ') AS k FROM d, (SELECT DISTINCT n FROM i) AS l, unnest(range(1, len(ws) - l.n + 2)) AS t(s)),
h AS (SELECT doc_id, s, m.n, item_id FROM m JOIN i ON i.n = m.n AND i.k = m.k),
c AS (SELECT doc_id, count(DISTINCT s + j) AS n_hit FROM h, unnest(range(0, n)) AS t(j) GROUP BY 1),
x AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id, ',' ORDER BY item_id) AS ids FROM h GROUP BY 1)
SELECT d.doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND {SHARE} * coalesce(n_hit, 0) >= len(ws) AS contaminated
FROM d LEFT JOIN c ON c.doc_id = d.doc_id LEFT JOIN x ON x.doc_id = d.doc_id
"""
