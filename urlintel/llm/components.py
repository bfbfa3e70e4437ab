"""Connected components of an edge table, by label passing with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .stash import drop, selected, stash


def components(edges: DataFrame) -> DataFrame:
    """id, component: the least id reachable, for every id that has an edge. ``edges`` has a and b (long).

    Each round a node takes the least label among its own, its neighbours' and its label's label. The aggregates combine
    before the shuffle, so a node with very many edges is no hot spot; what goes to the driver is a count of changes.
    """
    both = stash(edges.select("a", "b").union(edges.select(F.col("b"), F.col("a"))).distinct())
    labels = stash(both.groupBy("a").agg(F.min("b").alias("least")).select(F.col("a").alias("id"), F.least("a", "least").alias("component")))
    while True:
        near = both.join(labels.withColumnRenamed("id", "b"), "b").groupBy(F.col("a").alias("id")).agg(F.min("component").alias("near"))
        hooked = labels.join(near, "id").select("id", F.col("component").alias("was"), F.least("component", "near").alias("now"))
        hooked = stash(hooked)
        parents = hooked.select(F.col("id").alias("now"), F.col("now").alias("above"))
        jumped = stash(hooked.join(parents, "now").select("id", "was", F.least("now", "above").alias("component")))
        drop(hooked)
        changed = jumped.filter("was <> component").limit(1).count()
        drop(labels)
        labels = jumped
        if not changed:
            drop(both)
            return selected(labels, "id", "component")
