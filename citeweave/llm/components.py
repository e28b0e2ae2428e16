"""Connected components by alternating large-star and small-star steps (Kiveris et al., 2014).

Every step is a map-side-combined minimum and one salted join, so a hub with a third of all
edges is dealt over many tasks; nothing is gathered on the driver but a count and a checksum.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citeweave.llm.common import materialise, salted_join


def _star(edges: DataFrame, large: bool) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    near = down.unionByName(down.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else down
    least = near.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
    met = salted_join(near, least, ["u"], F.col("v"))
    if large:
        out = met.where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    else:
        out = met.select(F.explode(F.array(F.struct(F.col("v").alias("a"), F.col("m").alias("b")), F.struct(F.col("u").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.a", "e.b")
    return out.where("a <> b").distinct()


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, root) for every node on an edge (a, b) of longs; root is the component's least node.

    Edges with a null end or with equal ends say nothing.  Empty input gives an empty result.
    """
    edges = materialise(edges.where("a <> b").distinct())
    mark = None
    for _ in range(most_rounds):
        edges = materialise(_star(_star(edges, True), False))
        now = edges.agg(F.count("*").alias("n"), F.expr("bit_xor(xxhash64(a, b))").alias("x")).first()
        if (now["n"], now["x"]) == mark or not now["n"]:
            break
        mark = (now["n"], now["x"])
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    # Settled edges are stars: (leaf, root).
    leaves = edges.select(F.greatest("a", "b").alias("node"), F.least("a", "b").alias("root"))
    return leaves.unionByName(leaves.select(F.col("root").alias("node"), "root").distinct())
