"""Connected components of links between keys, as joins and aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chatlake.session import cut_lineage


def components(links: DataFrame) -> DataFrame:
    """node, root: the smallest key reachable over ``links`` (columns a, b), for every linked key.

    Labels start at each key itself. In a round every key takes the smallest label next to it, and then the
    label of that label, so long chains shrink by jumps. Both steps aggregate before they shuffle or join on
    a unique side, so a hub with many links is spread and combined like any hot key. The loop ends when a
    round changes nothing; each round's labels are written, so a lost executor costs no recomputation.
    """
    both = cut_lineage(
        links.select("a", "b").union(links.select(F.col("b"), F.col("a"))).where("a != b").distinct()
    )
    labels = cut_lineage(both.groupBy("a").agg(F.min("b").alias("m")).select(
        F.col("a").alias("node"), F.least("a", "m").alias("root")
    ))
    while True:
        near = (
            both.join(labels.select(F.col("node").alias("b"), "root"), "b")
            .groupBy("a")
            .agg(F.min("root").alias("near"))
        )
        # the smallest label found next to a key also goes to the key that was its label so far
        taken = labels.join(near, labels["node"] == near["a"]).select(
            "node", "root", F.least("root", "near").alias("low")
        )
        hooked = (
            taken.select("node", "low")
            .union(taken.where("low < root").select(F.col("root").alias("node"), "low"))
            .groupBy("node")
            .agg(F.min("low").alias("low"))
        )
        step = cut_lineage(hooked)
        jump = step.select(F.col("node").alias("low"), F.col("low").alias("next"))
        jumped = step.join(jump, "low", "left").select(
            "node", F.least("low", F.coalesce("next", "low")).alias("new")
        )
        fresh = cut_lineage(jumped.join(labels, "node").select("node", F.col("new"), "root"))
        changed = fresh.where("new != root").limit(1).count()
        labels = fresh.select("node", F.col("new").alias("root"))
        if not changed:
            return labels
