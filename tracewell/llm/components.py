"""Connected components by minimum labels with pointer jumping; every step is a written table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Workspace


def components(ws: Workspace, edges: DataFrame, name: str = "cc") -> DataFrame:
    """(id, component) of every end of ``edges`` (a, b); component is the smallest reachable id.

    A round takes the minimum over the neighbours (combined before the shuffle, so a hub costs one row
    for each task) and then the label of the label.  Rounds grow with the logarithm of the diameter.
    """
    both = ws.table(edges.select("a", "b").unionByName(edges.selectExpr("b AS a", "a AS b")).where("a <> b"), f"{name}-edges")
    labels = ws.table(
        both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("id"), F.least("a", "m").alias("component")),
        f"{name}-0",
    )
    step = 0
    while True:
        step += 1
        near = both.join(labels, both.b == labels.id).groupBy("a").agg(F.min("component").alias("m"))
        lower = labels.join(near, labels.id == near.a).select(
            "id", F.col("component").alias("old"), F.least("component", "m").alias("low")
        )
        top = labels.select(F.col("id").alias("low"), F.col("component").alias("top"))
        jumped = lower.join(top, "low", "left").select(
            "id", "old", F.least("low", F.coalesce("top", "low")).alias("component")
        )
        new = ws.table(jumped, f"{name}-{step}")
        changed = not new.where("component <> old").isEmpty()
        ws.drop(f"{name}-{step - 1}")
        labels = new.select("id", "component")
        if not changed:
            ws.drop(f"{name}-edges")
            return labels
