"""Connected components of an edge table, by minimum labels and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from acervo.llm._text import kept


def components(edges: DataFrame) -> DataFrame:
    """edges (a long, b long) -> one row (v, c) for each end of an edge; c is the smallest v that v reaches.

    Each round takes the smallest label of the neighbours and then the label's label, so that long chains take
    few rounds. Labels are written to the shared folder after each round. Nulls and loops make no edges.
    """
    both = kept(edges.where("a <> b").select("a", "b").union(edges.where("a <> b").select("b", "a")).distinct())
    labels = kept(both.groupBy(F.col("a").alias("v")).agg(F.least(F.min("b"), F.col("v")).alias("c")))
    while True:
        near = both.join(labels, both.b == labels.v).groupBy(F.col("a").alias("v")).agg(F.min("c").alias("m"))
        lower = labels.join(near, "v").select("v", F.col("c").alias("old"), F.least("c", "m").alias("c"))
        top = labels.select(F.col("v").alias("c"), F.col("c").alias("up"))
        new = kept(lower.join(top, "c", "left").select("v", F.least("c", "up").alias("c"), "old"))
        labels, changed = new.select("v", "c"), new.where("c <> old").limit(1).count()
        if not changed:
            return labels
