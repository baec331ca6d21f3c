"""Connected components by label propagation with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import drop_stored, stored


def connected_components(links: DataFrame) -> DataFrame:
    """(id, component) for every id in links (a, b): the smallest id reachable.

    Each round every id takes the least label among its neighbours' and its own,
    then its label's label; the rounds grow with the logarithm of the longest path.
    Labels are stored between rounds, and only a count comes to the driver.
    """
    both = stored(links.select("a", "b").union(links.select(F.col("b"), F.col("a"))).where("a <> b").distinct(), "components-links")
    labels = stored(both.groupBy(F.col("a").alias("id")).agg(F.min(F.least("a", "b")).alias("component")), "components-labels")
    while True:
        near = both.join(labels, both["b"] == labels["id"]).groupBy("a").agg(F.min("component").alias("least"))
        new = labels.join(near, labels["id"] == near["a"]).select("id", F.col("component").alias("old"), F.least("component", "least").alias("component"))
        jump = labels.select(F.col("id").alias("via"), F.col("component").alias("beyond"))
        new = new.join(jump, new["component"] == jump["via"], "left").select("id", "old", F.least("component", "beyond").alias("component"))
        new = stored(new, "components-labels")
        done = new.where("old <> component").isEmpty()
        drop_stored(labels)
        labels = new.select("id", "component")
        labels.stored_at = new.stored_at
        if done:
            drop_stored(both)
            return labels
