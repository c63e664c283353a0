"""Connected components: small local ones in NumPy, corpus-wide ones as DataFrame rounds."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from regressa.llm.common import keep


def local_labels(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest index reachable from each of ``n`` local nodes over the links ``a``-``b``."""
    labels = np.arange(n)
    while len(a):
        la, lb = labels[a], labels[b]
        open_ = la != lb
        if not open_.any():
            break
        a, b, la, lb = a[open_], b[open_], la[open_], lb[open_]
        np.minimum.at(labels, np.maximum(la, lb), np.minimum(la, lb))
        while (labels[labels] != labels).any():
            labels = labels[labels]
    return labels


def components(edges: DataFrame) -> DataFrame:
    """``(node, root)`` for every node of ``edges (a, b)`` (longs); nodes of one component share
    a root, which is one of them.

    Contraction: in each round every node moves to the neighbour (or itself) with the smallest
    hashed priority, edges are renamed and loops and repeats dropped. Priorities are salted by
    the round, so sorted chains shrink as fast as anything else. Minima combine map-side; a hub
    with a third of all edges is one row of the minimum table, and its join is an equi-join that
    adaptive execution splits. Each round is checkpointed; only a row count reaches the driver.
    Null ends and loops are ignored.
    """
    edges = keep(edges.where("a IS NOT NULL AND b IS NOT NULL AND a != b")
                 .select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    moves: list[DataFrame] = []
    while not edges.isEmpty():
        salt = F.lit(len(moves))

        def ranked(c, salt=salt):
            return F.struct(F.xxhash64(c, salt).alias("h"), F.col(c).alias("v"))

        both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"),
                                                               F.col("a").alias("b")))
        move = keep(both.groupBy("a").agg(F.min(ranked("b")).alias("m"))
                    .select("a", F.least("m", ranked("a")).getField("v").alias("to")))
        moves.append(move)
        left = move.select("a", F.col("to").alias("a2"))
        right = move.select(F.col("a").alias("b"), F.col("to").alias("b2"))
        edges = keep(edges.join(left, "a").join(right, "b").where("a2 != b2")
                     .select(F.least("a2", "b2").alias("a"), F.greatest("a2", "b2").alias("b"))
                     .distinct())
    if not moves:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    root = moves[-1].select(F.col("a").alias("node"), F.col("to").alias("root"))
    for move in reversed(moves[:-1]):
        # A node that was contracted away follows its move; one that stayed keeps its own root.
        root = keep(move.join(root.withColumnsRenamed({"node": "to", "root": "r"}), "to", "left")
                    .select(F.col("a").alias("node"), F.coalesce("r", "to").alias("root")))
    return root
