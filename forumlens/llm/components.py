"""Connected components of a graph whose edges no task could hold."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from forumlens.llm.shared import scratch, written


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, label) for every node of the edge list (a, b), label being the component's smallest node.

    Each round hangs every node below its smallest neighbour, and below what that hangs below in turn, and then
    contracts the graph: edges are carried over to where their ends hang, and those within one node go. So distances
    halve and edges fade from round to round, until none is left. Where nodes hang is a table a round, and labels follow these at
    the end, so that a round writes two tables. Edges and labels stay in the shared folder; the
    driver sees whether there are edges. An empty edge list gives an empty result; loops and repeated edges do no harm.
    """
    with scratch(edges.sparkSession) as keep:
        known = written(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a is not null and b is not null").distinct())
        hung, rest = [], known.filter("a < b")
        while not rest.isEmpty():
            least = rest.select("a", "b").union(rest.select(F.col("b"), F.col("a"))).groupBy("a").agg(F.min("b").alias("m"))
            up = least.select(F.col("a").alias("x"), F.least("a", "m").alias("y"))
            # The smallest node of a component hangs below itself.
            far = written(up.join(up.toDF("y", "z"), "y").select("x", F.col("z").alias("y")))
            hung.append(far)
            moved = rest.join(far.toDF("a", "p"), "a").join(far.toDF("b", "q"), "b")
            rest = written(moved.select(F.least("p", "q").alias("a"), F.greatest("p", "q").alias("b")).filter("a < b").distinct())
        labels = known.select(F.col("a").alias("node")).union(known.select("b")).distinct().withColumn("label", F.col("node"))
        for far in hung:
            labels = labels.join(far.toDF("label", "to"), "label", "left").select("node", F.coalesce("to", "label").alias("label"))
        return keep(labels)
