"""Exact top-k inner products by sorted lists read in order, with lower and upper bounds and no random access."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stored, table

SCALE = 64
K = 20
#: Candidates of a block and queries handled at once; values of the queries that one pass broadcasts, at most.
BLOCK, QUERIES, QUERY_VALUES = 4096, 256, 4_000_000


def _best(rows: np.ndarray, scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best of each row, larger scores and then smaller ids first."""
    order = np.lexsort((ids, -scores, rows))
    rows, scores, ids = rows[order], scores[order], ids[order]
    starts = np.flatnonzero(np.concatenate(([True], rows[1:] != rows[:-1]))) if len(rows) else np.empty(0, np.int64)
    rank = np.arange(len(rows)) - np.repeat(starts, np.diff(np.append(starts, len(rows))))
    keep = rank < k
    return rows[keep], scores[keep], ids[keep]


def block_top(weights: np.ndarray, own: np.ndarray, ids: np.ndarray, x: np.ndarray, floor: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs (query row, score, candidate id) of one block that may be among a query's k best; all that are.

    Each dimension is a list of the block's values in order, read from its high end for positive weights and from its low end
    for negative ones.  After t entries of every list, what was read counts in full; an unread value is no better than the
    last one read (upper bound) and no worse than the list's other end (lower bound).  Candidates whose upper bound is under
    the k-th lower bound, or under floor, a bound from earlier blocks, are out for that query, and those that are out for
    all are read no further.  Each time half of what is left of the lists is read, until few are left; these are summed up.
    Nothing is ruled out before about half of the lists, since a bound adds up the best unread value of every dimension.
    Matrix products do this for all queries of a block at once.
    """
    m = len(x)
    lists = np.sort(x, axis=0)
    plus, minus = np.maximum(weights, 0), np.minimum(weights, 0)
    cols, depth, lowest = np.arange(m), max(1, m // 2), _lowest(x.dtype)
    alive = own[:, None] != ids[None, :]
    while True:
        high, low, rest = lists[m - depth], lists[depth - 1], x[cols]
        upper = plus @ np.maximum(rest, high).T + minus @ np.minimum(rest, low).T
        least = floor
        if len(cols) > k and (floor == lowest).any():
            lower = plus @ np.where(rest >= high, rest, lists[0]).T + minus @ np.where(rest <= low, rest, lists[-1]).T
            lower[~alive] = lowest
            least = np.maximum(floor, np.partition(lower, len(cols) - k, axis=1)[:, len(cols) - k])
        alive &= upper >= least[:, None]
        some = alive.any(axis=0)
        cols, alive = cols[some], alive[:, some]
        if depth == m or alive.sum() <= 8 * k * len(weights):
            break
        depth = min(m, depth + max(1, (m - depth) // 2))
    rows, at = np.nonzero(alive)
    cols = cols[at]
    scores = np.einsum("ij,ij->i", weights[rows], x[cols])
    return _best(rows, scores, ids[cols], k)


def _dense(lists: pa.Array, width: int) -> np.ndarray:
    """Rows of whole numbers; missing components are zero."""
    sizes = lists.value_lengths().to_numpy(zero_copy_only=False)
    flat = lists.flatten().to_numpy(zero_copy_only=False)
    if len(sizes) and (sizes == width).all():
        return flat.reshape(-1, width)
    out = np.zeros((len(sizes), width), np.int64)
    out[np.arange(width)[None, :] < sizes[:, None]] = flat
    return out


def _exact_type(a: int, b: int, width: int):
    """The narrowest floating type in which all sums of products are exact; whole numbers beyond that, and an error where these could overflow."""
    most = a * b * max(1, width)
    if most >= 1 << 63:
        raise OverflowError(f"components of up to {a} give scores beyond 64 bits")
    return np.float32 if most < 1 << 24 else np.float64 if most < 1 << 53 else np.int64


def _lowest(kind):
    """What is less than any score, in the matrices' own type."""
    return np.iinfo(kind).min if np.issubdtype(kind, np.integer) else -np.inf


def whole_vectors(df: DataFrame, vec_id: str, vector: str) -> DataFrame:
    """(vec_id, v): floor(SCALE * component) of the vectors that take part."""
    fine = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    ok = df.where(F.col(vec_id).isNotNull() & F.col(vector).isNotNull() & F.forall(vector, fine))
    return ok.select(F.col(vec_id).cast("long").alias("vec_id"), F.transform(vector, lambda x: F.floor(x.cast("double") * SCALE)).alias("v"))


def search(df: DataFrame, is_query, k: int = K, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): for each row that is_query selects, the k rows with the highest inner products.

    Scores are exact, and where components are so large that one could pass 64 bits an error is raised; ties go to the smaller vec_id; fewer than k others give fewer rows.  Vectors that are null or hold null
    or non-finite components, and rows without a vec_id, take no part.  Shorter vectors count as padded with zeros.  A query
    never meets rows of its own vec_id; other repeated rows are candidates of their own.  The queries, not the candidates,
    are broadcast, in passes of at most QUERY_VALUES values; each pass reads all candidates once, and only each task's
    k best per query are shuffled.
    """
    spark = df.sparkSession
    vectors = whole_vectors(df, vec_id, vector)
    shape = vectors.agg(F.max(F.size("v")).alias("width"), F.max(F.array_max(F.transform("v", lambda x: F.abs(x.cast("double"))))).alias("most"), F.count_if(is_query).alias("n")).first()
    width, most, n = shape.width or 0, int(shape.most or 0), shape.n
    schema = "query_id long, vec_id long, score long"
    if not n or not width:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    passes = -(-n * width // QUERY_VALUES)
    kind = _exact_type(most, most, width)
    parts = []
    for p in range(passes):
        got = vectors.where(is_query & (F.pmod(F.xxhash64("vec_id"), F.lit(passes)) == p)).toArrow()
        if not got.num_rows:
            continue
        got = got.combine_chunks()
        ids = got["vec_id"].to_numpy()
        shared = spark.sparkContext.broadcast((ids, _dense(got["v"].combine_chunks(), width).astype(kind)))
        found = vectors.mapInArrow(_local(shared, width, k, kind), schema)
        if passes > 1:  # one pass after the other, so that the queries of one alone are held
            found = stored(found, "topk-pass")
            shared.destroy()
        parts.append(found)
    every = parts[0]
    for part in parts[1:]:
        every = every.union(part)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return every.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _local(shared, width: int, k: int, kind):
    """The k best of one task's candidates for every query, block by block."""

    def run(batches):
        qids, q = shared.value
        rows, scores, ids = (np.empty(0, np.int64) for _ in range(3))
        floor = np.full(len(qids), _lowest(kind), kind)

        def take(cids, x):
            nonlocal rows, scores, ids
            found = [(rows, scores, ids)]
            for at in range(0, len(q), QUERIES):
                part = slice(at, at + QUERIES)
                r, s, i = block_top(q[part], qids[part], cids, x, floor[part], k)
                found.append((r + at, s.astype(np.int64), i))
            rows, scores, ids = _best(*(np.concatenate(c) for c in zip(*found, strict=True)), k)
            counts = np.bincount(rows, minlength=len(q))
            full = counts >= k
            ends = np.cumsum(counts)
            floor[full] = scores[ends[full] - 1]

        held_ids, held, size = [], [], 0
        for batch in batches:
            if not batch.num_rows:
                continue
            cids, x = batch["vec_id"].to_numpy(zero_copy_only=False), _dense(batch["v"], width).astype(kind)
            for at in range(0, len(cids), BLOCK):
                held_ids.append(cids[at : at + BLOCK])
                held.append(x[at : at + BLOCK])
                size += len(held[-1])
                if size >= BLOCK:
                    take(np.concatenate(held_ids), np.concatenate(held))
                    held_ids, held, size = [], [], 0
        if size:
            take(np.concatenate(held_ids), np.concatenate(held))
        for at in range(0, len(rows), 50_000):
            part = slice(at, at + 50_000)
            yield pa.RecordBatch.from_arrays([pa.array(qids[rows[part]]), pa.array(ids[part]), pa.array(scores[part])], ["query_id", "vec_id", "score"])

    return run


def op4_topk(spark, sf_dir: str) -> DataFrame:
    """search() of embeddings for the rows whose vec_id is divisible by 20; rows that repeat a vec_id are candidates of their own."""
    return search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


SQL = f"""
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2]))::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= {K}
"""
