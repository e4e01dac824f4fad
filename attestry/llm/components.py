"""Connected components of an edge table by minimum labels and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import spool


def components(edges: DataFrame) -> DataFrame:
    """(v, label) of every end of the edges (a, b): label is the smallest v that it reaches.

    Each round takes the smallest label among a vertex's neighbours and then the label's own label, so paths shorten
    by half; labels are written between rounds. Minima combine before the shuffle, so hubs do not gather in a task.
    """
    both = spool(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).filter("a != b").distinct(), "edges")
    labels = spool(both.groupBy(F.col("a").alias("v")).agg(F.min("b").alias("b")).select("v", F.least("v", "b").alias("label")), "labels")
    while True:
        seen = both.join(labels.withColumnRenamed("v", "b"), "b").groupBy(F.col("a").alias("v")).agg(F.min("label").alias("near"))
        nearer = spool(labels.join(seen, "v").select("v", F.least("label", "near").alias("label"), (F.col("near") < F.col("label")).alias("moved")), "labels")
        if not nearer.filter("moved").limit(1).count():
            return nearer.select("v", "label")
        up = nearer.select(F.col("v").alias("label"), F.col("label").alias("top"))
        labels = spool(nearer.select("v", "label").join(up, "label", "left").select("v", F.coalesce("top", "label").alias("label")), "labels")
