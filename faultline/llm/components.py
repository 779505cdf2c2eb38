"""Connected components of an edge table, by joins and map-side minima only."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from faultline.operators.shared import written


def components(edges: DataFrame) -> DataFrame:
    """(node, label) for every node of ``edges`` (a, b): label is the smallest node of its component.

    Every round each label moves to its smallest neighbouring label, then follows that label's own
    move; edges inside one label are dropped. No group is ever gathered: a hot node costs one
    map-side minimum. Nodes and edges stay connected
    through labels, which only fall, so they end at each component's smallest node. Rounds are written to the
    shared folder. Edges with a null end are ignored.
    """
    edges = written(edges.where("a <> b").select("a", "b").distinct(), "edges")
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    labels = written(
        both.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("node"), F.least("a", "b").alias("label")),
        "labels",
    )
    while True:
        of = labels.select(F.col("node").alias("a"), F.col("label").alias("la"))
        to = labels.select(F.col("node").alias("b"), F.col("label").alias("lb"))
        between = edges.join(of, "a").join(to, "b").where("la <> lb")
        edges = written(between.select(F.col("la").alias("a"), F.col("lb").alias("b")).distinct(), "edges")
        if edges.isEmpty():
            break
        labels = written(_jump(_moves(edges, labels)), "labels")
    # Labels now lead to their component's smallest node, maybe by way of other labels: follow them to the end.
    while not _up(labels).where("label <> up").isEmpty():
        labels = written(_jump(labels), "labels")
    return labels


def _moves(edges: DataFrame, labels: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("to")).withColumnRenamed("a", "label")
    return labels.join(least, "label", "left").select("node", F.least("label", "to").alias("label"))


def _up(labels: DataFrame) -> DataFrame:
    """Labels (node, label) with ``up``, the label of the label."""
    return labels.join(labels.select(F.col("node").alias("label"), F.col("label").alias("up")), "label")


def _jump(labels: DataFrame) -> DataFrame:
    return _up(labels).select("node", F.least("label", "up").alias("label"))
