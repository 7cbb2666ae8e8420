"""Connected components in DataFrame steps, each written to the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vocalis.llm.common import discard, written


def components(edges: DataFrame) -> DataFrame:
    """edges (a, b) long -> (v, label): label is the least vertex of v's component. Vertices without edges are absent.

    Least labels spread along edges and to each vertex that was the label so far (hooking, so whole trees merge), then
    each label takes its own label (pointer jumping), until nothing changes. Labels only fall, so this ends; on paths
    the steps grow with the logarithm of the length. Sums are partial, and joins are plain equi-joins that adaptive
    execution may split, so a hub does no harm.
    """
    both = written(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct(), "edges")
    labels = written(both.groupBy(F.col("a").alias("v")).agg(F.least(F.col("a"), F.min("b")).alias("label")), "labels")
    while True:
        near = both.join(labels, both.b == labels.v).groupBy("a").agg(F.min("label").alias("near"))
        spread = labels.join(near, labels.v == near.a).select("v", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        hook = spread.groupBy(F.col("old").alias("root")).agg(F.min("label").alias("low"))
        spread = spread.join(hook, F.col("v") == F.col("root"), "left").select("v", "old", F.least("label", F.coalesce("low", "label")).alias("label"))
        up = labels.select(F.col("v").alias("u"), F.col("label").alias("up"))
        jumped = spread.join(up, F.col("label") == F.col("u"), "left").select("v", "old", F.least("label", F.coalesce("up", "label")).alias("label"))
        done = written(jumped, "labels")
        changed = done.where("label <> old").limit(1).count()
        discard(labels)
        labels = done.drop("old")
        labels._scratch = done._scratch
        if not changed:
            return labels
