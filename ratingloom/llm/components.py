"""Connected components of a link table by alternating star contraction."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ratingloom.session import StagedTable, stage

#: Links that a task holds at most while it contracts its own ones; those before are passed on.
FOREST_LINKS = 1 << 20


def contracted(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links of the same components that hang every node on the least one of its component."""
    nodes, places = np.unique(np.concatenate([a, b]), return_inverse=True)
    left, right = places[: len(a)], places[len(a):]
    root = np.arange(len(nodes))
    while True:
        ends = root[left], root[right]
        apart = ends[0] != ends[1]
        if not apart.any():
            hung = root != np.arange(len(nodes))
            return nodes[hung], nodes[root[hung]]
        left, right = left[apart], right[apart]
        np.minimum.at(root, np.maximum(*ends)[apart], np.minimum(*ends)[apart])
        while (root != (above := root[root])).any():
            root = above


def _stars(links: DataFrame) -> DataFrame:
    """The links of each task contracted by themselves, which needs no shuffle and loses no connection."""
    def run(batches: Iterator[pa.RecordBatch]):
        held = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for batch in batches:
            held = contracted(*(np.concatenate([side, batch.column(name).to_numpy()])
                                for side, name in zip(held, ("a", "b"))))
            if len(held[0]) > FOREST_LINKS:
                yield pa.record_batch({"a": held[0], "b": held[1]})
                held = np.zeros(0, np.int64), np.zeros(0, np.int64)
        yield pa.record_batch({"a": held[0], "b": held[1]})

    return links.mapInArrow(run, "a long, b long")


def _contract(edges: DataFrame, larger: bool) -> StagedTable:
    """One star step: hang the larger (or the smaller) neighbours of a node on its least one.

    Nodes of any degree are fine: minima are aggregated before they are shuffled, and
    the join has a table on either side, so Spark splits the rows of a frequent node.
    """
    low = edges.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("low")).withColumn("low", F.least("node", "low"))
    joined = edges.join(low, edges["u"] == low["node"])
    if larger:
        hung = joined.where("v > u").select(F.col("v").alias("a"), F.col("low").alias("b")).where("a <> b")
        return stage(_stars(hung), "stars")
    # The least neighbour hangs nowhere: the node itself hangs on it.
    hung = joined.where("v < u").select(F.when(F.col("v") == F.col("low"), F.col("u")).otherwise(F.col("v")).alias("a"),
                                        F.col("low").alias("b")).where("a <> b")
    return stage(_stars(hung).distinct(), "stars")


def _both_ways(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(
        edges.select(F.col("b").alias("u"), F.col("a").alias("v")))


def components(edges: DataFrame) -> StagedTable:
    """``(node, component)`` for every node of ``edges(a, b)``; the component is its least node.

    Large stars and small stars alternate until nothing changes, which takes a number of
    rounds that grows with the logarithm of the component size; each task contracts what lies
    in it first. Self links and repeated links change nothing; nodes without links do not appear.
    """
    def state(table: DataFrame):
        return tuple(table.agg(F.count("*"), F.sum(F.hash("a", "b").cast("long"))).first())

    current = stage(_stars(edges.where("a <> b")).distinct(), "edges")
    before = state(current.df)
    while before[0]:
        large = _contract(_both_ways(current.df), larger=True)
        current.drop()
        current = _contract(_both_ways(large.df), larger=False)
        large.drop()
        after = state(current.df)
        if after == before:
            break
        before = after
    roots = current.df.select(F.col("b").alias("node")).distinct()
    labelled = current.df.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
        roots.select("node", F.col("node").alias("component")))
    return StagedTable(labelled, current.path)
