"""Connected components of a distributed edge table.

Alternates the large-star and small-star steps: neighbours are re-linked to the
smallest vertex seen until every edge points at its component's smallest one.
Minima come from partial aggregation and a join, so a vertex with many
neighbours never gathers them in one task.  The driver sees two sums a round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from larkspur.llm.scratch import Scratch


def components(edges: DataFrame, scratch: Scratch, name: str = "components") -> DataFrame:
    """(v, root) for every vertex that is not itself the smallest of its component.

    edges: two long columns; direction, repeats and loops do not matter.
    """
    a, b = edges.columns
    step = 0
    e = scratch.save(edges.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("v"), F.least(a, b).alias("u")).distinct(), f"{name}-0")
    while True:
        # large star: every larger neighbour of x goes to the smallest vertex around x
        both = e.unionByName(e.select(F.col("u").alias("v"), F.col("v").alias("u")))
        least = both.groupBy("v").agg(F.min("u").alias("m")).select("v", F.least("v", "m").alias("m"))
        large = both.where("u > v").join(least, "v").select(F.col("u").alias("v"), F.col("m").alias("u")).distinct()
        # small star: every smaller neighbour of x, and x, go to the smallest of them
        low = large.groupBy("v").agg(F.min("u").alias("m"))
        joined = large.join(low, "v")
        small = joined.where("u <> m").select(F.col("u").alias("v"), F.col("m").alias("u")).unionByName(low.select("v", F.col("m").alias("u"))).distinct()
        step += 1
        after = scratch.save(small, f"{name}-{step}")
        mark = lambda d: d.agg(F.count(F.lit(1)), F.sum(F.xxhash64("v", "u").cast("decimal(38,0)"))).first()
        same = mark(after) == mark(e)
        scratch.drop(f"{name}-{step - 1}")
        e = after
        if same:
            return e.select("v", F.col("u").alias("root"))
