"""Connected components of a distributed edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paragram.llm import storage


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node, root for every end of an edge; root is one of the component's nodes, the same for all.

    Each round sends every node to the least of its neighbours' least and puts the images in place of the ends; images of
    neighbours stay neighbours, so rounds go on until no edge joins two nodes.  Rounds grow with the logarithm of the
    longest path.  All tables stay distributed; each round's are written to the shared folder.  A null end, or an edge from
    a node to itself, is no edge.
    """
    e = storage.written(edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a <> b").distinct(), "edges")
    roots, edges_before = None, e
    while True:
        both = e.select("a", "b").unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        parent = both.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("node"), F.least("a", "b").alias("p"))
        over = parent.select(F.col("node").alias("p"), F.col("p").alias("pp"))
        jump = storage.written(parent.join(over, "p").select("node", F.col("pp").alias("root")), "jumps")
        if roots is None:
            roots = jump
        else:
            step = jump.select(F.col("node").alias("root"), F.col("root").alias("next"))
            before = roots
            roots = storage.written(roots.join(step, "root", "left").select("node", F.coalesce("next", "root").alias("root")), "roots")
            storage.release(before)
        left = jump.select(F.col("node").alias("a"), F.col("root").alias("ra"))
        right = jump.select(F.col("node").alias("b"), F.col("root").alias("rb"))
        e = e.join(left, "a").join(right, "b").where("ra <> rb").select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct()
        before, e = edges_before, storage.written(e, "edges")
        storage.release(before, *([] if jump is roots else [jump]))
        edges_before = e
        if e.isEmpty():
            return roots
