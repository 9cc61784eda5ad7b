"""Connected components of a link table, without bringing links to the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from lapak.llm.batches import written


def components(links: DataFrame) -> DataFrame:
    """node and root (the least node of its component) for every node of ``links(a, b)``.

    Each round takes the least root among the neighbours and then the root of that root, so long chains shrink fast.
    The roots of a round are written, so lineage stays short and nothing is lost with an executor.
    """
    edges = links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    both = written(edges.select(F.inline(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b"))))),
                   "links")
    roots = written(both.groupBy(F.col("a").alias("node")).agg(F.least(F.first("a"), F.min("b")).alias("root")), "roots")
    while True:
        near = both.join(roots, both["b"] == roots["node"]).groupBy("a").agg(F.min("root").alias("near"))
        stepped = written(roots.join(near, roots["node"] == near["a"]).select(
            "node", F.least("root", "near").alias("root"), (F.col("near") < F.col("root")).alias("moved")), "steps")
        if stepped.filter("moved").isEmpty():
            return roots
        above = stepped.select(F.col("node").alias("up"), F.col("root").alias("top"))
        roots = written(stepped.join(above, stepped["root"] == above["up"]).select("node", F.col("top").alias("root")), "roots")
