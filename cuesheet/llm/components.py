"""Connected components of links, in combining aggregates over narrow rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def components(links: DataFrame, rounds: int | None = None) -> DataFrame:
    """``node, root`` for every node of ``links`` (``a, b``): the smallest node of its component.

    Every round each node takes the smallest label among its own and its neighbours', hands
    it to the node that was its label before, and then takes its label's label. Labels are
    written to the shared folder each round. It ends when no label changes; with ``rounds``
    it may end earlier: equal roots are then connected, but a component may have several.
    """
    edges = links.select("a", "b").where("a <> b")
    edges = written(edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links")
    labels = edges.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("root")).select(
        "node", F.least("node", "root").alias("root")
    )
    labels = written(labels, "labels")
    done = 0
    while rounds is None or done < rounds:
        of_b = labels.select(F.col("node").alias("b"), F.col("root").alias("near"))
        of_a = labels.withColumnRenamed("node", "a")
        near = edges.join(of_b, "b").groupBy("a").agg(F.min("near").alias("near"))
        best = of_a.join(near, "a").select(
            "a", F.col("root").alias("old"), F.least("root", "near").alias("new")
        )
        offers = best.select(F.col("a").alias("node"), F.col("new").alias("root")).unionByName(
            best.select(F.col("old").alias("node"), F.col("new").alias("root"))
        )
        hooked = offers.groupBy("node").agg(F.min("root").alias("root"))
        hooked = written(hooked, "labels")
        upper = hooked.select(F.col("node").alias("root"), F.col("root").alias("top"))
        jumped = written(
            hooked.join(upper, "root").select("node", F.col("top").alias("root")), "labels"
        )
        done += 1
        if rounds is None:
            changed = jumped.withColumnRenamed("root", "now").join(labels, "node").where("now <> root")
            if changed.isEmpty():
                return jumped
        labels = jumped
    return labels
