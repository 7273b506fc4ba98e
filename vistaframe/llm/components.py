"""Connected components of a graph in DataFrames: least label, with pointer jumps.

Nothing but the number of edges and one count a round reach the driver. A round's tables are
written to the shared folder, so a lost executor costs a task, not a round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import discard, written

#: Bytes of a long.
LONG = 8


def components(edges: DataFrame, most_rounds: int = 200, n: int | None = None) -> DataFrame:
    """(node, label) for every node of ``edges`` (u, v): the least node it reaches.
    ``n``: how many edges there are at most, if known."""
    both = edges.select("u", "v").where("u <> v")
    both = written(both.unionByName(both.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct(), "edges", None if n is None else 2 * n * LONG * 2)
    size = both.count() * LONG * 3  # of a round's table, at most
    labels = written(both.groupBy("u").agg(F.min("v").alias("v")).select(F.col("u").alias("node"), F.least("u", "v").alias("label")), "labels", size)
    held = labels
    for _ in range(most_rounds):
        near = both.join(labels, both["v"] == labels["node"]).groupBy("u").agg(F.min("label").alias("near"))
        new = labels.join(near, labels["node"] == near["u"]).select("node", "label", F.least("label", "near").alias("to"))
        ahead = labels.select(F.col("node").alias("at"), F.col("label").alias("ahead"))
        step = written(new.join(ahead, new["to"] == ahead["at"]).select("node", F.least("to", "ahead").alias("new"), F.col("label").alias("old")), "labels", size)
        discard(held)  # nothing reads the round before
        held, labels = step, step.select("node", F.col("new").alias("label"))
        if not step.where("new <> old").limit(1).count():
            discard(both)
            return labels
    raise RuntimeError("components did not settle")
