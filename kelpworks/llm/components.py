"""Connected components of a link table: hash-min with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kelpworks.llm.shared import stored


def components(links: DataFrame, name: str = "components") -> DataFrame:
    """node and label (the smallest node it reaches) for every node of links (a, b: of any orderable type).

    Each round takes the smallest label of a node's neighbours, then the label of its label, and is stored, so that
    lineage stays short; a long chain halves each round. Self-links keep a node in the result; null ends are ignored.
    """
    links = links.select("a", "b").where(F.col("a").isNotNull() & F.col("b").isNotNull())
    both = stored(links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), f"{name}-links")
    labels = stored(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("label")).select(F.col("a").alias("node"), "label"), name)
    while not labels.isEmpty():
        near = both.join(labels, F.col("b") == F.col("node")).groupBy("a").agg(F.min("label").alias("near"))
        lower = stored(labels.join(near, F.col("node") == F.col("a"), "left").select("node", F.least("label", F.coalesce("near", "label")).alias("label"), F.col("label").alias("was")), name)
        of = lower.select(F.col("node").alias("at"), F.col("label").alias("further"))
        after = stored(lower.join(of, F.col("label") == F.col("at"), "left").select("node", F.least("label", F.coalesce("further", "label")).alias("label"), "was"), name)
        labels = after.select("node", "label")
        if after.where(F.col("label") != F.col("was")).isEmpty():
            break
    return labels
