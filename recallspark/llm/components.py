"""Connected components of links between numbers, as rounds of joins."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recallspark.llm.common import materialize

#: Links that a single table write of one round may hold before the next round starts; only a guard against endless loops.
MAX_ROUNDS = 60


def components(links: DataFrame) -> DataFrame:
    """node, component (the smallest node reachable) of every node that occurs in links (columns a, b).

    Alternates large-star and small-star: each node links its larger neighbours, then its smaller ones, to the smallest
    neighbour known. Stars shrink to depth one in about log(n) rounds. Each round is written to the shared folder.
    """
    edges = materialize(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    before = None
    for _ in range(MAX_ROUNDS):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").unionByName(least.select("u", F.col("m").alias("v"))).distinct()
        edges = materialize(small)
        now = edges.agg(F.count("*"), F.countDistinct("u"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before or not now[0]:
            break
        before = now
    else:
        raise RuntimeError("components did not settle")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component"))).distinct()


def local_components(left: np.ndarray, right: np.ndarray, n: int) -> np.ndarray:
    """The smallest index reachable from each of n indices over the given links."""
    label = np.arange(n)
    while len(left):
        low = np.minimum(label[left], label[right])
        new = label.copy()
        np.minimum.at(new, label[left], low)
        np.minimum.at(new, label[right], low)
        new = new[new]
        if (new == label).all():
            break
        label = new[new]
    return label


def spanning_forest(left: np.ndarray, right: np.ndarray, n: int) -> np.ndarray:
    """Which links, earlier ones first, are enough to connect all that the links connect (fewer than n)."""
    label, keep = np.arange(n), np.zeros(len(left), bool)
    while True:
        a, b = label[left], label[right]
        across = np.flatnonzero(a != b)
        if not len(across):
            return keep
        first = np.full(n, len(left))
        np.minimum.at(first, a[across], across)
        np.minimum.at(first, b[across], across)
        own = np.unique(first[first < len(left)])
        keep[own] = True
        label = local_components(a[own], b[own], n)[label]
