"""Connected components of an edge table, by joins and grouped minima."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lithoframe.llm.common import Scratch


def connected_components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(a, b) links -> (id, component), component = the smallest id that can be reached.

    Each round takes the minimum over the neighbours and then follows the label's own label, so labels travel
    twice as far in every round; a round is staged, so that the plan stays short. Ids without a link don't
    appear. Self links and repeated links do no harm; null ends are dropped. An empty table gives no rows.
    """
    scratch = Scratch(edges.sparkSession)
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    both = scratch.stage(both.dropna().distinct(), "edges")
    label = scratch.stage(both.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.first("a")).alias("c")), "labels")
    for _ in range(rounds):
        near = both.join(label, both.b == label.id).groupBy(F.col("a").alias("id")).agg(F.min("c").alias("m"))
        step = label.select("id", "c").join(near, "id", "left").select("id", F.least("c", "m").alias("n"), "c")
        up = label.select(F.col("id").alias("n"), F.col("c").alias("u"))
        nxt = scratch.stage(step.join(up, "n", "left").select("id", F.least("n", "u").alias("c"), (F.least("n", "u") < F.col("c")).alias("moved")), "labels")
        scratch.drop(label)
        label = nxt
        if not label.filter("moved").limit(1).count():
            scratch.drop(both)
            return label.select("id", F.col("c").alias("component"))
    raise RuntimeError(f"components have not settled after {rounds} rounds")
