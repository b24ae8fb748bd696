"""Connected components of an edge table, by repeated contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bedside.llm.common import Scratch

MAX_ROUNDS = 80


def components(edges: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """``v, label``: every vertex of ``edges`` (columns ``a, b``) with a label shared by its component only.

    Each round every vertex picks the first of itself and its neighbours, and edges are rewritten to the picked vertices. Two rounds
    of three go by the vertices' own order, which takes a star to its smallest vertex; the third by a random order (a hash), which
    shortens any path by a constant factor on average. Picks and edges are written to the shared folder, where a lost executor
    does not matter; at the end the picks of all rounds are applied in turn. Only one row at a time comes to the driver.
    """
    edges = scratch.keep(edges.select("a", "b").filter("a <> b").distinct(), f"{name}_edges_0")
    labels = edges.select(F.explode(F.array("a", "b")).alias("v")).distinct().withColumn("label", F.col("v"))
    for step in range(MAX_ROUNDS):
        if edges.isEmpty():
            return scratch.keep(labels, f"{name}_labels")
        random = step % 3 == 2
        both = edges.select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("e")).select("e.a", "e.b")

        def order(c):
            return F.struct((F.xxhash64(c, F.lit(step)) if random else F.lit(0)).alias("h"), c.alias("x"))

        first = both.groupBy("a").agg(F.min(order(F.col("b"))).alias("m"))
        picks = scratch.keep(first.select("a", F.least(order(F.col("a")), F.col("m"))["x"].alias("to")), f"{name}_picks_{step}")
        labels = labels.join(picks.withColumnRenamed("a", "label"), "label", "left").select("v", F.coalesce("to", "label").alias("label"))
        moved = edges.join(picks.select("a", F.col("to").alias("a2")), "a").join(picks.select(F.col("a").alias("b"), F.col("to").alias("b2")), "b")
        moved = moved.filter("a2 <> b2").select(F.least("a2", "b2").alias("a"), F.greatest("a2", "b2").alias("b")).distinct()
        edges = scratch.keep(moved, f"{name}_edges_{step + 1}")
        if step % 6 == 5:  # not too many picks in one plan
            labels = scratch.keep(labels, f"{name}_labels_{step}")
    raise RuntimeError("components did not contract")
