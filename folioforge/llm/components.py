"""Connected components by minimum labels and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import remove, scratch


#: Copies of a label's row for the nodes that share it.
SALTS = 32
#: Links, each way, up to which labels are broadcast: there are no more of them than links.
BROADCAST_ROWS = 200_000


def components(edges: DataFrame, src: str = "u", dst: str = "v") -> DataFrame:
    """(node, label) for every node of edges; label is the smallest node reachable.

    Each round takes the smallest label of a node's neighbours (one partial aggregation, so that hubs are combined
    before the shuffle) and then the label's own label, so that the rounds grow with the logarithm of the longest path.
    Each round is a written table in the shared folder; nothing but a count comes to the driver.
    Few links, once counted, are joined by broadcast.  Null nodes and loops are ignored; no edges give no rows.
    """
    spark = edges.sparkSession
    paths = [scratch(spark, "cc-edges")]
    pairs = edges.select(F.col(src).alias("u"), F.col(dst).alias("v")).where("u is not null and v is not null and u <> v")
    both = pairs.union(pairs.select("v", "u").toDF("u", "v")).distinct()
    both.write.parquet(paths[0])
    both = spark.read.schema(both.schema).parquet(paths[0])
    small = F.broadcast if both.count() <= BROADCAST_ROWS else lambda df: df
    labels = both.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("m")).select("node", F.least("node", "m").alias("label"))
    while True:
        near = both.join(small(labels), both.v == labels.node).groupBy("u").agg(F.min("label").alias("near"))
        step = labels.join(small(near), labels.node == near.u).select("node", F.least("label", "near").alias("label"), F.col("label").alias("was"))
        # A component shares its label, which may be half of all rows: the label's own label is looked up once for each label,
        # and goes back to the nodes in SALTS copies, each for a share of them.
        up = step.where("label <> node").select(F.col("node").alias("n2"), F.col("label").alias("up"))
        heads = step.groupBy("label").agg(F.lit(1).alias("one")).join(small(up), F.col("label") == up.n2).select("n2", "up", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
        salted = step.withColumn("own", F.pmod(F.xxhash64("node"), F.lit(SALTS)).cast("int"))
        jumped = salted.join(small(heads), (salted.label == heads.n2) & (salted.own == heads.salt), "left").select("node", F.least("label", F.coalesce("up", "label")).alias("label"), "was")
        path = scratch(spark, "cc-labels")
        jumped.write.parquet(path)
        done = spark.read.schema(jumped.schema).parquet(path)
        moved = done.where("label <> was").limit(1).count()
        if len(paths) > 1:
            remove(spark, paths.pop())
        paths.append(path)
        labels = done.select("node", "label")
        if not moved:
            return labels
