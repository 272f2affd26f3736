"""Connected components of a graph in tables: hooking and shortcutting of parent pointers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmere.session import settle


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(u, v) -> (node, component), where a component is named by its smallest node.

    Every node points to a parent.  In a round the roots at the ends of each edge are hooked, the larger to the
    smallest root it meets, and pointers are shortcut to the parent's parent until all point to roots.  Edges within
    one tree are dropped.  Each round is written to the shared folder, so lineage stays short and a lost executor
    costs at most one round.  Only counts reach the driver.  The joins are merge joins by hint, as neither side has a bound.
    """
    edges = settle(edges.where("u is not null and v is not null").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct(), "edges")
    parents = settle(edges.select(F.col("u").alias("node")).unionAll(edges.select(F.col("v").alias("node"))).distinct().select("node", F.col("node").alias("parent")), "parents")
    live = edges.where("u <> v")
    for _ in range(most_rounds):
        roots = parents.select("node", "parent")
        ends = live.join(roots.select(F.col("node").alias("u"), F.col("parent").alias("pu")).hint("merge"), "u").join(roots.select(F.col("node").alias("v"), F.col("parent").alias("pv")).hint("merge"), "v")
        live = settle(ends.where("pu <> pv").select(F.least("pu", "pv").alias("u"), F.greatest("pu", "pv").alias("v")).distinct(), "live")
        if live.isEmpty():
            return parents.select("node", F.col("parent").alias("component"))
        hooks = live.groupBy("v").agg(F.min("u").alias("to"))
        parents = settle(parents.join(hooks.withColumnRenamed("v", "parent").hint("merge"), "parent", "left").select("node", F.coalesce("to", "parent").alias("parent")), "hooked")
        while True:  # shortcut until every parent is a root
            up = parents.select(F.col("node").alias("parent"), F.col("parent").alias("above"))
            moved = settle(parents.join(up.hint("merge"), "parent").select("node", F.col("above").alias("parent"), (F.col("above") != F.col("parent")).alias("moved")), "shortcut")
            parents = moved.select("node", "parent")
            if moved.where("moved").isEmpty():
                break
    raise RuntimeError(f"components didn't settle within {most_rounds} rounds")
