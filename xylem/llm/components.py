"""Connected components of a distributed list of links, without collecting it."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from xylem.llm.common import cut, discard

#: Links that one task joins by itself, about 50 MB; more are joined by rounds over the cluster.
ONE_TASK = 1_000_000


def least_reachable(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes of links, and the least node that each reaches: labels fall along links and are followed to their own labels."""
    nodes, ends = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = ends[: len(u)], ends[len(u) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        # the labels of labels fall too, so long chains shrink by halves
        for x in (a, b, label[a], label[b]):
            np.minimum.at(new, x, low)
        while (new[new] != new).any():
            new = new[new]
        if (new == label).all():
            return nodes, nodes[label]
        label = new


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """A large-star or small-star step: neighbours of u (larger ones, or smaller ones and u) are tied to the least of u and its neighbours."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    if not large:
        both = both.where("v < u")
    least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
    tied = both.join(least, "u")
    if large:
        return tied.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return tied.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))


def connected_components(links: DataFrame) -> DataFrame:
    """(u, root) for every u of links (u, v) that isn't its component's least; root is that.

    Alternating large and small stars (Kiveris et al., 2014): a number of
    rounds that grows with the logarithm of the longest path. Every step keeps
    at most one row for each link, so a hub of any degree stays rows, never a
    list; each round is written down, and the last two are compared. Up to
    ONE_TASK links are joined in one task instead, which saves the rounds.
    """
    edges = cut(links.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())

    def join(batches):
        parts = [(x.column(0).to_numpy(), x.column(1).to_numpy()) for x in batches]
        if parts:
            nodes, roots = least_reachable(*(np.concatenate(x) for x in zip(*parts, strict=True)))
            own = nodes != roots
            yield pa.RecordBatch.from_arrays([pa.array(nodes[own]), pa.array(roots[own])], ["u", "root"])

    if edges.count() <= ONE_TASK:
        return edges.coalesce(1).mapInArrow(join, "u long, root long")
    state = None
    while True:
        seen = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if seen == state or not seen[0]:
            return edges.select("u", F.col("v").alias("root"))
        state = seen
        wide = _stars(edges, True).where("u <> v").distinct()
        new = cut(_stars(wide, False).where("u <> v").distinct())
        discard(edges)
        edges = new
