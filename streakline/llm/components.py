"""Connected components of an edge table by minimum labels with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from streakline.llm.shared import Scratch


def components(edges: DataFrame, run: Scratch, name: str) -> DataFrame:
    """(node, label) for every node of ``edges`` (a, b); label: the smallest node of its component.

    Each round a node takes the smallest label among its neighbours (combined
    before the shuffle, so hubs cost no more than their degree) and then the
    label of its label, which halves the remaining distance. Rounds are written
    to the shared folder; the loop ends when a round changes nothing.
    """
    both = run.keep(edges.select("a", "b").union(edges.select("b", "a")).distinct(), f"{name}-edges")
    lab = run.keep(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("label")),
                   f"{name}-0")
    step = 0
    while True:
        step += 1
        seen = (both.join(lab, both["b"] == lab["node"]).groupBy(F.col("a").alias("node"))
                .agg(F.min("label").alias("seen")))
        low = lab.join(seen, "node").select("node", F.col("label").alias("old"),
                                            F.least("label", "seen").alias("label"))
        up = lab.select(F.col("node").alias("label"), F.col("label").alias("up"))
        new = run.keep(low.join(up, "label", "left").select(
            "node", "old", F.least("label", F.coalesce("up", "label")).alias("label")), f"{name}-{step}")
        if new.where("old <> label").isEmpty():
            return new.select("node", "label")
        lab = new.select("node", "label")
