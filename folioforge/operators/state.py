"""State as append-only logs and views of them."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx


def latest(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of each key by order, whose end must break ties.  Combined before the shuffle, not sorted."""
    rest = [c for c in df.columns if c not in keys]
    top = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_r"))
    return top.select(*keys, *(F.col(f"_r.{c}").alias(c) for c in rest)).select(*df.columns)


def first_per_key(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    rest = [c for c in df.columns if c not in keys]
    top = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_r"))
    return top.select(*keys, *(F.col(f"_r.{c}").alias(c) for c in rest)).select(*df.columns)


def append_if_changed(log: DataFrame, keys: list[str], order: list[str], fields: list[str]) -> DataFrame:
    """The rows of a log that differ in a field from the row before them: what guarded appends would have kept."""
    w = Window.partitionBy(*keys).orderBy(*order)
    was = log.withColumn("_was", F.lag(F.struct(*fields)).over(w))
    return was.where(~F.col("_was").eqNullSafe(F.struct(*fields))).drop("_was")


def active_text(confirmed: DataFrame, manual: DataFrame, key: str, at: str, order: list[str]) -> DataFrame:
    """The newest confirmed row of each key that no manual row is newer than; the confirmed one wins a tie."""
    m = manual.groupBy(F.col(key).alias("_k")).agg(F.max(at).alias("_m"))
    ok = confirmed.join(m, (F.col(key) == F.col("_k")) & (F.col("_m") > F.col(at)), "left_anti")
    return latest(ok, [key], order)


def effective(df: DataFrame, keys: list[str], status: str, reading: str, order: list[str]) -> tuple[DataFrame, DataFrame]:
    """(rows that hold, conflicts): per key, Confirmed before Proposed before Stale; Rejected alone gives none.

    The latest row of the best status holds; Confirmed or Proposed with more than one reading is a conflict (keys, readings).
    """
    rank = F.when(F.col(status) == "Confirmed", 1).when(F.col(status) == "Proposed", 2).when(F.col(status) == "Stale", 3)
    ranked = df.withColumn("_rank", rank).where(F.col("_rank").isNotNull())
    best = ranked.groupBy(*keys).agg(F.min("_rank").alias("_best"))
    top = ranked.join(best, keys).where(F.col("_rank") == F.col("_best"))
    n = top.where("_rank < 3").groupBy(*keys).agg(F.count_distinct(reading).alias("readings")).where("readings > 1")
    held = top.join(n.select(*keys), keys, "left_anti").drop("_rank", "_best")
    return latest(held.select(*df.columns), keys, order), n


def import_new(old: DataFrame, new: DataFrame, hash_: str, order: str) -> DataFrame:
    """old, then the rows of new whose hash is not there yet, the first of each; renumbered from 0 in column position."""
    fresh = first_per_key(new, [hash_], [order]).join(old.select(hash_).distinct(), hash_, "left_anti").select(*old.columns)
    both = old.withColumn("_new", F.lit(0)).unionByName(fresh.withColumn("_new", F.lit(1)))
    return numbered(both, ["_new", order], "position").drop("_new")


#: Rows that are looked at to find the end of a range.
LOOKED_AT = 20


def dealt(df: DataFrame, order: list[str], out: str = "_part") -> DataFrame:
    """df with the number of the range of one global order that each row is in, as many ranges as there are shuffle partitions.

    A row looks for its range among every some ends first, and then among those between two of these.  The ranges' ends come
    from the keys of smallest hash, a bounded number, so that they are a function of the rows alone: a range partitioning
    samples anew each time it runs, and rows dealt under one sample would be looked for under another.
    """
    n = max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    key = F.struct(*order)
    picked = df.select(key.alias("k")).orderBy(F.xxhash64("k"), "k").limit(LOOKED_AT * n)
    ends = picked.agg(F.filter(F.array_sort(F.collect_list("k")), lambda _, i: (i + 1) % LOOKED_AT == 0).alias("e")).scalar()
    step = max(1, math.isqrt(n))
    some = df.withColumn("_ends", ends).withColumn("_coarse", F.filter("_ends", lambda _, i: i % step == 0)).withColumn("_block", F.greatest(F.size(F.filter("_coarse", lambda e: e < key)) - 1, F.lit(0)) * step)
    return some.withColumn(out, F.col("_block") + F.size(F.filter(F.slice("_ends", F.col("_block") + 1, F.lit(step)), lambda e: e < key))).drop("_ends", "_coarse", "_block")


def numbered(df: DataFrame, order: list[str], out: str) -> DataFrame:
    """df numbered from 0 in one global order, whose end must break ties, without drawing all rows into one task.

    Each range of the order is numbered on its own, and the ranges' sizes, one row for each, are added up before them.
    """
    parts = dealt(df, order)
    sizes = parts.groupBy("_part").agg(F.count("*").alias("_n"))
    before = sizes.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"))
    local = parts.withColumn("_i", F.row_number().over(Window.partitionBy("_part").orderBy(*order)) - 1)
    return local.join(F.broadcast(before), "_part").withColumn(out, F.col("_i") + F.col("_before")).drop("_part", "_i", "_before")


def duplicate_neighbours(df: DataFrame, hash_: str, order: str) -> DataFrame:
    """(hash, first, second): consecutive rows of the same hash."""
    w = Window.partitionBy(hash_).orderBy(order)
    return df.select(F.col(hash_).alias("hash"), F.col(order).alias("first"), F.lead(order).over(w).alias("second")).where("second is not null")


def changes(old: DataFrame, new: DataFrame, key: str, groups: dict[str, list[str]]) -> DataFrame:
    """(key, one boolean a group): whether any of the group's columns differs between old and new, nulls compared as values."""
    o, n = old.alias("o"), new.alias("n")
    flag = lambda cols: ~F.struct(*(F.col(f"o.{c}") for c in cols)).eqNullSafe(F.struct(*(F.col(f"n.{c}") for c in cols)))
    both = o.join(n, F.col(f"o.{key}") == F.col(f"n.{key}"))
    return both.select(F.col(f"o.{key}").alias(key), *(flag(cols).alias(name) for name, cols in groups.items()))


def reconcile(known: DataFrame, given: DataFrame, key: str) -> DataFrame:
    """(key, state): matched, missing (known only), unknown (given only), once a key."""
    k, g = known.select(F.col(key).alias("k")).distinct(), given.select(F.col(key).alias("g")).distinct()
    both = k.join(g, F.col("k") == F.col("g"), "full")
    return both.select(F.coalesce("k", "g").alias(key), F.when(F.col("g").isNull(), "missing").when(F.col("k").isNull(), "unknown").otherwise("matched").alias("state"))


def restored_status(parents: DataFrame, key: str, words: DataFrame, reviews: DataFrame) -> DataFrame:
    """parents with status: NotProcessed without words, ReviewRequired with reviews, else Completed."""
    w = words.select(F.col(key).alias("_w")).distinct()
    r = reviews.select(F.col(key).alias("_r")).distinct()
    both = parents.join(w, F.col(key) == F.col("_w"), "left").join(r, F.col(key) == F.col("_r"), "left")
    return both.withColumn("status", F.when(F.col("_w").isNull(), "NotProcessed").when(F.col("_r").isNotNull(), "ReviewRequired").otherwise("Completed")).drop("_w", "_r")


def recount(parents: DataFrame, children: DataFrame, key: str, child_key: str, out: str) -> DataFrame:
    """parents with the number of their children, 0 where there are none; counted before the join."""
    n = children.groupBy(F.col(child_key).alias("_k")).agg(F.count("*").alias(out))
    return parents.join(n, F.col(key) == F.col("_k"), "left").drop("_k").withColumn(out, F.coalesce(out, F.lit(0)).cast("long"))


def layers(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """df with text and layer: the first of the named layers that is not null; an empty text counts as present."""
    names = list(columns)
    pick = F.when(columns[names[0]].isNotNull(), names[0])
    for n in names[1:]:
        pick = pick.when(columns[n].isNotNull(), n)
    return df.withColumn("text", F.coalesce(*columns.values())).withColumn("layer", pick)


def page_hash(df: DataFrame, text: str = "text") -> DataFrame:
    return df.withColumn("hash", tx.text_hash(F.col(text)))
