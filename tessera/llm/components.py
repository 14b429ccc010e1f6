"""Connected components of a graph whose nodes are longs, by hooking and contraction.

In each round every node hooks to its least neighbour, chains of hooks are shortened, and the edges are
rewritten to the ends of the chains; edges inside a component vanish. A component at least halves in each
round. Rounds are written to the shared folder, so plans stay short and nothing reaches the
driver but a count.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import discard, materialise


def components(edges: DataFrame, name: str) -> DataFrame:
    """(node, label) of every node of ``edges`` (a, b); the label is the least node of the component.

    Loops and repeated edges are harmless; without edges the result is empty.
    """
    live = edges.where("a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    live = materialise(live, f"{name}-edges")
    labels = None
    while live.limit(1).count():
        both = live.unionByName(live.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hooks = both.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("node"), F.least("a", "b").alias("label"))
        hooks = materialise(hooks, f"{name}-hooks")
        for _ in range(2):  # each jump doubles the reach; what is left of a chain goes on in the next round
            to = hooks.select(F.col("node").alias("label"), F.col("label").alias("next"))
            jumped = materialise(hooks.join(to, "label").select("node", F.col("next").alias("label")), f"{name}-hooks")
            discard(hooks)
            hooks = jumped
        if labels is None:
            labels = hooks
        else:
            step = hooks.select(F.col("node").alias("label"), F.col("label").alias("next"))
            moved = materialise(labels.join(step, "label", "left").select("node", F.coalesce("next", "label").alias("label")), f"{name}-labels")
            discard(labels)
            labels = moved
        a = hooks.select(F.col("node").alias("a"), F.col("label").alias("a2"))
        b = hooks.select(F.col("node").alias("b"), F.col("label").alias("b2"))
        rest = live.join(a, "a").join(b, "b").where("a2 != b2").select(F.least("a2", "b2").alias("a"), F.greatest("a2", "b2").alias("b")).distinct()
        rest = materialise(rest, f"{name}-edges")
        discard(live, *(() if hooks is labels else (hooks,)))
        live = rest
    if labels is None:
        return live.select(F.col("a").alias("node"), F.col("b").alias("label"))
    return labels
