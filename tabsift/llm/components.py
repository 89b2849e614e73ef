"""Connected components of a link table, without gathering links anywhere.

Alternating large-star and small-star steps hang every vertex on the least one it can see until
nothing changes; each step is a grouped minimum and a join, written to the shared folder so that a
lost executor costs one step. The grouped minimum combines on the map side and the join back is one
that adaptive execution may split, so a vertex with very many links is no bottleneck.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop, materialize


def _least(both: DataFrame) -> DataFrame:
    """Each (u, v) with the least of u and of all its v."""
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return both.join(least, "u")


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select("b", "a"))
    return _least(both).where("v > u").select(F.col("v").alias("b"), F.col("m").alias("a"))


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    found = _least(down)
    return found.select(F.col("v").alias("b"), F.col("m").alias("a")).union(found.select("u", "m"))


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def components(links: DataFrame) -> DataFrame:
    """(id, component): for each id of the links (a, b) the least id that links reach. Nulls and loops link nothing."""
    edges = links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct()
    edges = materialize(edges, "links")
    mark = _mark(edges)
    while mark[0]:
        step = _small_star(_large_star(edges).where("a <> b").distinct()).where("a <> b").distinct()
        new = materialize(step.select("a", "b"), "links")
        drop(edges)
        edges, (last, mark) = new, (mark, _mark(new))
        if mark == last:
            break
    return edges.select(F.col("b").alias("id"), F.col("a").alias("component")).union(edges.select("a", "a").distinct())


def forest(i: np.ndarray, j: np.ndarray, n: int) -> list[tuple[int, int]]:
    """Pairs that hold together what all pairs (i, j) of n vertices do."""
    parent = list(range(n))

    def top(v: int) -> int:
        while parent[v] != v:
            parent[v] = parent[parent[v]]
            v = parent[v]
        return v

    out = []
    for a, b in zip(i.tolist(), j.tolist(), strict=True):
        a, b = top(a), top(b)
        if a != b:
            parent[max(a, b)] = min(a, b)
            out.append((a, b))
    return out
