"""Connected components of a table of edges, in rounds that each shrink the graph.

In a round every node is mapped to the smallest neighbour of its smallest neighbour (itself included), and
the edges are drawn between the images.  Joined nodes stay joined, as the edges that lead to an image are
mapped with it, and nodes never leave their component, so the components of the images are those of the
nodes.  A star is gone after one round, and long chains fold up in a number of rounds that grows with the
logarithm of their length.

Each round is a few jobs over tables in the shared folder, and nothing but the question whether edges are
left reaches the driver.  The joins are on written tables, so Spark can split the partition of a hot node.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sylvatica.llm.storage import discard, settle


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node of ``edges`` (a, b: longs), the component being one of its nodes."""
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    live = settle(both.where("a <> b").distinct(), "edges")
    found = None
    while not live.isEmpty():
        least = settle(live.groupBy(F.col("a").alias("node")).agg(F.least(F.min("a"), F.min("b")).alias("to")), "least")
        far = least.select(F.col("node").alias("to"), F.col("to").alias("image"))
        image = settle(least.join(far, "to").select("node", "image"), "images")
        of = lambda end: image.select(F.col("node").alias(end), F.col("image").alias(f"{end}_to"))
        mapped = live.join(of("a"), "a").join(of("b"), "b").select(F.col("a_to").alias("a"), F.col("b_to").alias("b"))
        done = [least, live]
        live = settle(mapped.where("a <> b").distinct(), "edges")
        if found is None:
            found = image.withColumnRenamed("image", "component")
        else:  # a node whose image has no edge left is at its end
            step = image.select(F.col("node").alias("component"), "image")
            done += [found, image]
            found = settle(found.join(step, "component", "left").select("node", F.coalesce("image", "component").alias("component")), "nodes")
        for table in done:
            discard(table)
    discard(live)
    return edges.sparkSession.createDataFrame([], "node long, component long") if found is None else found
