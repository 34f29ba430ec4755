"""Connected components of links, as rounds of joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from typelore.session import cut_lineage


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, label) for each node of ``links``: the smallest node that can be reached.

    A round takes the smallest label among the neighbours and then the label of that label, so paths shorten by more
    than half; rounds end when no label changes. Each round is written to the shared folder and read back. Labels meet
    edges in joins of two plain shuffles, which adaptive execution splits where a node has very many links.
    """
    one_way = links.select(F.col(a).alias("a"), F.col(b).alias("b")).filter("a <> b")
    edges = cut_lineage(one_way.union(one_way.select("b", "a")).distinct(), "edges")
    labels = cut_lineage(
        edges.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("label")), "labels"
    )
    while True:
        near = (
            edges.join(labels, F.col("b") == F.col("node"))
            .groupBy(F.col("a").alias("near_node"))
            .agg(F.min("label").alias("near"))
        )
        hooked = labels.join(near, F.col("node") == F.col("near_node")).select(
            "node", F.col("label").alias("old"), F.least("label", "near").alias("label")
        )
        parents = labels.select(F.col("node").alias("parent"), F.col("label").alias("top"))
        jumped = hooked.join(parents, F.col("label") == F.col("parent")).select(
            "node", F.least("label", "top").alias("label"), (F.least("label", "top") < F.col("old")).alias("moved")
        )
        written = cut_lineage(jumped, "labels")
        labels = written.select("node", "label")
        if written.filter("moved").isEmpty():
            return labels
