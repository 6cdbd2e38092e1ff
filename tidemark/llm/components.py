"""Connected components of a link table, and all-against-all work over posting lists."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialise

# Members of one posting list that are compared in one go; longer lists are cut into chunks
# and every pair of chunks becomes a block of its own.
BLOCK_ROWS = 4096


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node of ``links``; the component is its smallest node.

    Alternates large-star and small-star steps: each sends the neighbours of a node to the
    smallest of them. The minima are aggregated before they are shuffled and joined back, so
    a node with very many neighbours is never gathered. Every round is written to the shared
    folder, which cuts the lineage. Nulls and self links are ignored.
    """
    x, y = F.col(a).cast("bigint"), F.col(b).cast("bigint")
    edges = links.where(x.isNotNull() & y.isNotNull() & (x != y))
    edges = edges.select(F.greatest(x, y).alias("u"), F.least(x, y).alias("v")).distinct()
    edges = materialise(edges, "links")
    state = None
    while (now := _fingerprint(edges)) != state:
        state = now
        edges = materialise(_small_star(_large_star(edges)), "links")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
        edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )


def _fingerprint(edges: DataFrame) -> tuple:
    total = F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))
    return tuple(edges.agg(F.count(F.lit(1)), total).first())


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    sent = both.join(least, "u").where("v > u")
    return sent.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    sent = edges.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return sent.union(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()


def blocks(postings: DataFrame, keys: Sequence[str], spread: Column, member: Column, limit: int = BLOCK_ROWS) -> DataFrame:
    """Posting lists of at least two members as arrays ``members`` of bounded length.

    ``postings`` has one row per (key, member); ``spread`` is a hash that deals members into
    chunks. A list longer than ``limit`` is cut into chunks and each pair of chunks (a chunk
    with itself too) is a row, so any two members of a list meet in at least one row, and no
    row holds more than about twice ``limit``. Columns: keys, ``left``, ``right``, ``members``.
    """
    sizes = postings.groupBy(*keys).agg(F.count(F.lit(1)).alias("list_rows")).where("list_rows > 1")
    chunks = F.ceil(F.col("list_rows") / limit).cast("int")
    met = postings.join(sizes, list(keys)).withColumn("chunk", F.pmod(spread, chunks).cast("int"))
    met = met.withColumn("other", F.explode(F.sequence(F.lit(0), chunks - 1)))
    return met.groupBy(
        *keys, F.least("chunk", "other").alias("left"), F.greatest("chunk", "other").alias("right")
    ).agg(F.collect_list(member).alias("members"))


class Forest:
    """Union-find over 0..n-1 that keeps the smallest member as root."""

    def __init__(self, n: int):
        self.parent = list(range(n))

    def find(self, i: int) -> int:
        parent = self.parent
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    def join(self, i: int, j: int) -> None:
        a, b = self.find(i), self.find(j)
        if a != b:
            self.parent[max(a, b)] = min(a, b)

    def edges(self) -> tuple[np.ndarray, np.ndarray]:
        """(member, root) of every member that is not a root."""
        roots = np.array([self.find(i) for i in range(len(self.parent))], dtype=np.int64)
        members = np.nonzero(roots != np.arange(len(roots)))[0]
        return members, roots[members]
