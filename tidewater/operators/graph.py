"""Connected components of small pieces, by joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .stats import written


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, component) of every node of the edges (a, b): component is the least node that it is connected with.

    Each round gives a node the least component of its neighbours and then that component's own, so paths halve; a minimum by
    key and joins on keys, nothing is gathered.  Rounds are written, until nothing changes.
    """
    both = written(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    now = written(both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("component")).withColumnRenamed("a", "node"), "components")
    for _ in range(rounds):
        of = now.select(F.col("node").alias("b"), F.col("component").alias("near"))
        least = both.join(of, "b").groupBy("a").agg(F.min("near").alias("near")).withColumnRenamed("a", "node")
        hooked = now.join(least, "node").select("node", "component", F.least("component", "near").alias("to"))
        # the node that it was tied to hears of the smaller one as well
        told = hooked.groupBy("component").agg(F.min("to").alias("least")).withColumnRenamed("component", "node")
        made = hooked.join(told, "node", "left").select("node", F.col("component").alias("was"), F.least("to", F.coalesce("least", "to")).alias("to"))
        up = made.select(F.col("node").alias("to"), F.col("to").alias("next"))
        then = written(made.join(up, "to").select("node", "was", F.least("to", "next").alias("component")), "components")
        if then.where("was != component").isEmpty():
            return then.select("node", "component")
        now = then.select("node", "component")
    raise RuntimeError("components did not settle")
