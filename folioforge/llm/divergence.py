"""Audit of sources: how far the words of each source of a language are from those of its other sources and of the language.

Counts of terms are dealt into tiles, blocks of terms by blocks of sources.  Each tile is a dense matrix of whole numbers in which
all pairs of sources are compared by broadcasting; the partial pair matrices are added up, the best terms of each tile are merged.
"""

from __future__ import annotations

import collections
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import parts, stored, table

#: A term is kept by a language that has it in so many documents.
SUPPORT = 3
#: Shares are whole numbers of this unit, plus one.
UNIT = 1_000_000_000
#: Terms reported for a source.
TOP = 200
#: Terms and sources of a tile, about; cells of a comparison held at once.
TERMS, GROUPS, CELLS = 4096, 64, 1 << 21
#: Distinct terms a task holds before it hands its counts on.
HELD = 400_000
#: Parts in which the terms of one source are ranked before the last ranking.
SALTS = 16
_BYTES = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
_COUNTS = "lang string, source string, term string, n long, docs long"
_TILE = "lang string, source string, part string, item string, value long, cols long, rest long, v long"


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of one task: a row for each language, source and term met, more than one where too many terms are held."""
    held: dict = {}
    size = 0

    def flush() -> Iterator[pa.RecordBatch]:
        for (lang, source), (counts, seen) in held.items():
            terms = list(counts)
            for at in range(0, len(terms), 50_000):
                some = terms[at : at + 50_000]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(some), pa.string()), pa.array([source] * len(some), pa.string()), pa.array(some, pa.binary()).view(pa.string()), pa.array([counts[t] for t in some], pa.int64()), pa.array([seen[t] for t in some], pa.int64())],
                    ["lang", "source", "term", "n", "docs"],
                )
        held.clear()

    for batch in batches:
        texts = batch["text"].cast(pa.binary())
        for lang, source, text in zip(batch["lang"], batch["source"], texts, strict=True):
            counts, seen = held.setdefault((lang.as_py(), source.as_py()), (collections.Counter(), collections.Counter()))
            size -= len(counts)
            own: set = set()
            for part in parts(text.as_py().translate(_BYTES)):
                words = part.split()
                counts.update(words)
                own.update(words)
            seen.update(own)
            size += len(counts)
            if size >= HELD:
                yield from flush()
                size = 0
    yield from flush()


def smoothed(counts: np.ndarray, total: np.ndarray) -> np.ndarray:
    """1 + floor(UNIT * (count + 1) / total) without rounding: long division in steps of a thousand, so that nothing passes 64 bits."""
    if total.size and total.max() >= 1 << 53:
        raise OverflowError("more than 2**53 occurrences of terms")
    whole, rest = np.divmod(counts + 1, total)
    for _ in range(3):
        more, rest = np.divmod(rest * 1000, total)
        whole = whole * 1000 + more
    return whole + 1


def _far(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) ** 2 // q


def _pairs(p: np.ndarray) -> np.ndarray:
    """Sums over the columns of floor((p - q)^2 / q) for all pairs of rows, as many columns at once as CELLS allow."""
    out = np.zeros((len(p), len(p)), np.int64)
    step = max(1, CELLS // max(1, len(p) ** 2))
    for at in range(0, p.shape[1], step):
        block = p[:, at : at + step]
        out += _far(block[:, None, :], block[None, :, :]).sum(axis=2)
    return out


def _tile(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
    """One tile: rows without a term name its sources, the others have the counts that are not 0."""
    lang, _, left, right = (k.as_py() for k in key)
    marks = rows.filter(pc.is_null(rows["term"]))
    cells = rows.filter(pc.is_valid(rows["term"]))
    names = marks["source"].combine_chunks()
    own, block = marks["n"].to_numpy(), marks["block"].to_numpy()
    v, every = int(marks["v"][0].as_py()), int(marks["total"][0].as_py())
    term = cells["term"].combine_chunks().dictionary_encode()
    at, terms = term.indices.to_numpy(zero_copy_only=False), term.dictionary
    counts = np.zeros((len(names), len(terms)), np.int64)
    counts[pc.index_in(cells["source"], value_set=names).to_numpy(), at] = cells["n"].to_numpy()
    total = np.zeros(len(terms), np.int64)
    total[at] = cells["total"].to_numpy()
    p = smoothed(counts, (own + v)[:, None])
    none = smoothed(np.zeros_like(own), own + v) if v else np.ones_like(own)
    u, w = np.nonzero((block[:, None] != block[None, :]) if left != right else ~np.eye(len(names), dtype=bool))
    found = [(u, np.full(len(u), "pair"), names.take(pa.array(w)), _pairs(p)[u, w], len(terms), _far(none[u], none[w]))]
    if left == right and len(terms):
        q = smoothed(total, np.array([every + v]))
        order = np.empty(len(terms), np.int64)
        order[pc.sort_indices(terms).to_numpy()] = np.arange(len(terms))
        for g in range(len(names)):
            over = np.flatnonzero((counts[g] > 0) & (p[g] > q))
            value = _far(p[g][over], q[over])
            best = np.lexsort((order[over], -value))[:TOP]
            found.append((np.full(len(best), g), np.full(len(best), "term"), terms.take(pa.array(over[best])), value[best], 0, np.zeros(len(best), np.int64)))
    out = [pa.table([pa.array([lang] * len(g), pa.string()), names.take(pa.array(g)), pa.array(part.astype(object), pa.string()), item, pa.array(value), pa.array(np.full(len(g), cols)), pa.array(rest), pa.array(np.full(len(g), v))], names=["lang", "source", "part", "item", "value", "cols", "rest", "v"]) for g, part, item, value, cols, rest in found]
    return pa.concat_tables(out)


def audit(df: DataFrame, lang: str = "lang", source: str = "source", text: str = "text", terms: int = TERMS, groups: int = GROUPS, top: int = TOP) -> DataFrame:
    """(lang, source, part, item, value, rank): how far each source of a language is from its others, and by which terms from the language.

    Terms are runs of ASCII letters, A-Z lower-cased, and of characters beyond ASCII.  A language keeps the terms that SUPPORT of
    its rows have.  Null texts, languages and sources count as ''; each row is a document, repeated ones too; other columns are
    ignored; no rows give no rows.  A language that keeps no term has pairs of value 0; a source without terms has pairs, too.

    Only sums are shuffled: counts by term, tiles of about `terms` terms by `groups` sources (a source meets the others of its
    language in tiles of two blocks, so that no task holds all sources of a language), and what is best in each tile.  Values
    are exact up to 2**53 occurrences and 2,000,000,000 terms of a language; beyond that an error is raised.
    """
    every = df.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(n) for c, n in ((lang, "lang"), (source, "source"), (text, "text"))))
    met = every.mapInArrow(_counted, _COUNTS).repartition("lang", "term").groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    same = Window.partitionBy("lang", "term")
    kept = met.withColumns({"total": F.sum("n").over(same), "first": F.col("source") == F.min("source").over(same), "in": F.sum("docs").over(same)}).where(F.col("in") >= SUPPORT)
    counts = stored(kept.select("lang", "source", "term", "n", "total", "first"), "audit-counts")

    own = counts.groupBy("lang", "source").agg(F.sum("n").alias("n"), F.count_if("first").alias("firsts"))
    sources = every.select("lang", "source").distinct().join(own, ["lang", "source"], "left").fillna(0, ["n", "firsts"])
    langs = sources.groupBy("lang").agg(F.sum("n").alias("total"), F.sum("firsts").alias("v"), F.count("*").alias("size"))
    langs = langs.select("lang", "total", "v", F.greatest(F.lit(1), F.ceil(F.col("v") / terms)).alias("rows"), F.ceil(F.col("size") / groups).alias("blocks"))
    shape = stored(sources.join(langs, "lang"), "audit-shape")
    langs = shape.select("lang", "rows", "blocks").distinct()
    place = lambda column, n: F.pmod(F.xxhash64(column), F.col(n)).alias({"rows": "row", "blocks": "block"}[n])
    none = F.lit(None)
    cells = counts.join(langs, "lang").select("lang", "source", "term", "n", "total", none.cast("long").alias("v"), place("term", "rows"), place("source", "blocks"), "blocks")
    marks = shape.select("lang", "source", none.cast("string").alias("term"), "n", "total", "v", F.explode(F.sequence(F.lit(0).cast("long"), F.col("rows") - 1)).alias("row"), place("source", "blocks"), "blocks")
    beside = F.transform(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1), lambda j: F.struct(F.least("block", j).alias("left"), F.greatest("block", j).alias("right")))
    dealt = cells.union(marks).select("lang", "source", "term", "n", "total", "v", "row", "block", F.inline(beside))
    tiles = stored(dealt.groupBy("lang", "row", "left", "right").applyInArrow(_tile, _TILE), "audit-tiles")

    pairs = tiles.where("part = 'pair'").groupBy("lang", "source", "part", "item").agg((F.sum("value") + (F.max("v") - F.sum("cols")) * F.max("rest")).alias("value"))
    best = lambda *by: F.row_number().over(Window.partitionBy("lang", "source", "part", *by).orderBy(F.desc("value"), "item"))
    heaps = tiles.where("part = 'term'").withColumn("salt", F.pmod(F.xxhash64("item"), F.lit(SALTS))).withColumn("rank", best("salt")).where(F.col("rank") <= top)
    heaps = heaps.withColumn("rank", best()).where(F.col("rank") <= top)
    ranked = pairs.withColumn("rank", best())
    return ranked.select("lang", "source", "part", "item", "value", "rank").union(heaps.select("lang", "source", "part", "item", "value", "rank"))


def op11_divergence(spark, sf_dir: str) -> DataFrame:
    """audit() of documents."""
    return audit(table(spark, sf_dir, "documents"))


SQL = rf"""
WITH d AS (SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source, row_number() OVER () AS i,
  regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS ws FROM documents),
t AS (SELECT lang, source, i, w, count(*) AS c FROM (SELECT lang, source, i, unnest(ws) AS w FROM d) GROUP BY ALL),
k AS (SELECT lang, w, sum(c)::HUGEINT AS total FROM t GROUP BY lang, w HAVING count(*) >= {SUPPORT}),
v AS (SELECT lang, count(*) AS v, sum(total)::HUGEINT AS n FROM k GROUP BY lang),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT t.lang, t.source, t.w, sum(t.c)::HUGEINT AS c FROM t JOIN k ON k.lang = t.lang AND k.w = t.w GROUP BY ALL),
n AS (SELECT g.lang, g.source, coalesce(sum(c.c), 0)::HUGEINT AS n FROM g LEFT JOIN c ON c.lang = g.lang AND c.source = g.source GROUP BY ALL),
p AS (SELECT n.lang, n.source, k.w, coalesce(c.c, 0) AS c, 1 + {UNIT}::HUGEINT * (coalesce(c.c, 0) + 1) // (n.n + v.v) AS p, 1 + {UNIT}::HUGEINT * (k.total + 1) // (v.n + v.v) AS q
  FROM n JOIN v ON v.lang = n.lang JOIN k ON k.lang = n.lang LEFT JOIN c ON c.lang = n.lang AND c.source = n.source AND c.w = k.w),
s AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value FROM p a JOIN p b ON b.lang = a.lang AND b.w = a.w AND b.source <> a.source GROUP BY ALL),
e AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(s.value, 0)::BIGINT AS value FROM g a JOIN g b ON b.lang = a.lang AND b.source <> a.source LEFT JOIN s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
  UNION ALL SELECT lang, source, 'term', w, ((p - q) * (p - q) // q)::BIGINT FROM p WHERE c > 0 AND p > q),
r AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INTEGER AS rank FROM e)
SELECT lang, source, part, item, value, rank FROM r WHERE part = 'pair' OR rank <= {TOP}
"""
