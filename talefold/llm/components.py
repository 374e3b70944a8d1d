"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import cut


def components(links: DataFrame) -> DataFrame:
    """id, component (smallest id reachable) for every id in links(a, b).

    Each round takes the least label among a node's neighbours, then the label
    of that label, so long chains shrink by halves. Labels only fall; when their
    sum stays the same, none has changed. Rounds are written tables.
    """
    edges = cut(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    total = F.sum(F.col("component").cast("decimal(38,0)"))
    labels = cut(edges.groupBy("a").agg(F.min("b").alias("low")).select(F.col("a").alias("id"), F.least("a", "low").alias("component")))
    before = labels.agg(total).first()[0]
    while before is not None:
        near = edges.join(labels, edges["b"] == labels["id"]).groupBy("a").agg(F.min("component").alias("low"))
        lower = labels.join(near, labels["id"] == near["a"]).select("id", F.least("component", "low").alias("component"))
        up = labels.select(F.col("id").alias("component"), F.col("component").alias("above"))
        labels = cut(lower.join(up, "component", "left").select("id", F.least("component", F.coalesce("above", "component")).alias("component")))
        after = labels.agg(total).first()[0]
        if after == before:
            break
        before = after
    return labels
