"""Connected components of an edge table, in the cluster.

Labels fall to the smallest label among neighbours, then jump to their label's label, until nothing
changes. Every round is one written table, so lineage stays short and lost executors cost one round.
Only counts reach the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyframe.llm.common import Cut


def components(edges: DataFrame, cut: Cut) -> DataFrame:
    """(id, component) of every node of edges (a, b): the smallest id that links reach. No edges, no rows."""
    both = cut(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct())
    labels = cut(both.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("low")).select("id", F.least("id", "low").alias("component")))
    while True:
        near = both.join(labels.select(F.col("id").alias("b"), "component"), "b").groupBy(F.col("a").alias("id")).agg(F.min("component").alias("low"))
        fell = labels.join(near, "id").select("id", F.col("component").alias("old"), F.least("component", "low").alias("mid"))
        jump = labels.select(F.col("id").alias("mid"), F.col("component").alias("end"))
        end = F.least("mid", "end")
        new = cut(fell.join(jump, "mid").select("id", end.alias("component"), (end != F.col("old")).alias("moved")))
        moved = new.where("moved").limit(1).count()
        cut.drop(labels)
        labels = new
        if not moved:
            cut.drop(both)
            out = labels.select("id", "component")
            out._cut_path = labels._cut_path
            return out
