"""Connected components of a table of links, and of links held in arrays."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored


def local_roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest member of the component of each of ``n`` nodes linked by ``a[i]``-``b[i]``."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[a], root[b])
        before = root.copy()
        np.minimum.at(root, root[a], low)
        np.minimum.at(root, root[b], low)
        while not np.array_equal(jumped := root[root], root):
            root = jumped
        if np.array_equal(root, before):
            return root


def components(links: DataFrame, name: str = "links") -> DataFrame:
    """node, root: the smallest node that each linked node reaches.

    ``links`` has two columns a, b of one type without nulls. Large-star and
    small-star steps alternate until the links no longer change; each is a
    minimum by key and a join back, so a node with any number of neighbours is
    summed before the shuffle and its join may be split. A self-link makes a
    lone node known. No links give no rows.
    """
    edges = stored(
        links.select("a", "b").where("a <> b").select(
            F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")
        ).distinct(),
        name
    )
    before = None
    while True:
        # a > b in every row. Large star: larger neighbours of a node move to its smallest one.
        low = edges.groupBy("a").agg(F.min("b").alias("low")).withColumnRenamed("a", "at")
        up = edges.join(low, edges["b"] == low["at"], "left").select("a", F.coalesce("low", "b").alias("b"))
        edges = stored(up.distinct(), name)
        # Small star: a node's smaller neighbours, and itself, move to the smallest of them.
        low = edges.groupBy("a").agg(F.min("b").alias("low"))
        moved = edges.join(low, "a")
        edges = stored(
            moved.select(
                F.col("b").alias("a"), F.col("low").alias("b")
            ).where("a <> b").unionByName(low.select("a", F.col("low").alias("b"))).distinct(),
            name
        )
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    roots = edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
