"""Connected components of an edge table by repeated contraction.

Every vertex hooks to its smallest neighbour, chains are halved by joins, and the edges are rewritten between what is
left. Stars vanish in one round, long chains in a logarithmic number. Nothing reaches the driver but the number
of edges left; each round is cut by tables in the shared folder, of which only the result stays.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from fluxloom.session import durable, scratch


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(vertex, component): the smallest vertex reachable, for every vertex that has an edge.

    Self-loops, repeated edges and rows with a null end are ignored; an empty edge table gives an empty result.
    """
    with scratch() as cuts:
        left = cuts.cut(
            edges.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b"))
            .where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col("a") < F.col("b")))
            .distinct()
        )
        labels = left.select(F.col("a").alias("vertex")).union(left.select(F.col("b").alias("vertex"))).distinct().withColumn("component", F.col("vertex"))
        while not left.isEmpty():
            both = left.select(F.col("a").alias("v"), F.col("b").alias("n")).unionByName(left.select(F.col("b").alias("v"), F.col("a").alias("n")))
            hook = both.groupBy("v").agg(F.least("v", F.min("n")).alias("p"))
            for _ in range(2):
                hook = cuts.cut(hook)
                up = hook.select(F.col("v").alias("p"), F.col("p").alias("q"))
                hook = hook.join(up, "p", "left").select("v", F.coalesce("q", "p").alias("p"))
            hook = cuts.cut(hook)
            ends = [hook.select(F.col("v").alias(c), F.col("p").alias(f"_{c}")) for c in ("a", "b")]
            left = cuts.cut(
                left.join(ends[0], "a").join(ends[1], "b")
                .select(F.least("_a", "_b").alias("a"), F.greatest("_a", "_b").alias("b"))
                .where(F.col("a") < F.col("b"))
                .distinct()
            )
            moved = hook.select(F.col("v").alias("component"), "p")
            labels = cuts.cut(labels.join(moved, "component", "left").select("vertex", F.coalesce("p", "component").alias("component")))
        return durable(labels)


class Forest:
    """Union-find over the positions of one task's rows; keeps only edges that joined two trees."""

    def __init__(self, n: int):
        self.parent = list(range(n))

    def find(self, x: int) -> int:
        parent = self.parent
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    def join(self, x: int, y: int) -> bool:
        x, y = self.find(x), self.find(y)
        if x == y:
            return False
        self.parent[max(x, y)] = min(x, y)
        return True
