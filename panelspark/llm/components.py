"""Connected components as DataFrame steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelspark.session import materialize


def components(edges: DataFrame) -> DataFrame:
    """(v, label) for every vertex of ``edges`` (a, b): the smallest vertex it is connected with.

    Every step takes the smallest label among a vertex and its neighbours and then the label
    of that label, so the number of steps grows with the logarithm of a chain's length. Each
    step is written to the shared folder; one count reaches the driver.
    """
    both = materialize(edges.select("a", "b").union(edges.select("b", "a")).distinct(), "edges")
    labels = materialize(both.groupBy(F.col("a").alias("v")).agg(F.min("b").alias("m"))
                         .select("v", F.least("v", "m").alias("label")), "labels")
    while True:
        near = (both.join(labels.withColumnRenamed("v", "b"), "b").groupBy(F.col("a").alias("v"))
                .agg(F.min("label").alias("near")))
        told = labels.join(near, "v").select("v", "label", F.least("label", "near").alias("to"))
        of = labels.select(F.col("v").alias("to"), F.col("label").alias("jump"))
        moved = materialize(told.join(of, "to", "left").select(
            "v", F.least("to", F.coalesce("jump", "to")).alias("label"),
            (F.col("label") > F.least("to", F.coalesce("jump", "to"))).alias("moved")), "labels")
        labels = moved.select("v", "label")
        if not moved.where("moved").limit(1).count():
            return labels
