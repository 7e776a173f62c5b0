"""Connected components of an edge table, by label passing between stored tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from adlake.llm.common import stored


def connected_components(edges: DataFrame) -> DataFrame:
    """``node`` and ``root``, the smallest node of its component, for all nodes of
    ``edges`` (columns ``a`` and ``b`` of one orderable type).

    Each round a node takes the smallest label among its own and its neighbours', then
    the label of that label, so rounds grow with the logarithm of the longest path.
    Hubs cost nothing special: messages are combined before they are shuffled, and no
    node's neighbours are ever gathered.
    """
    both = stored(
        edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))),
        "edges",
    )
    labels = stored(both.groupBy(F.col("a").alias("node")).agg(F.least("node", F.min("b")).alias("root")), "labels")
    while True:
        sent = both.join(labels, F.col("a") == F.col("node")).select(
            F.col("b").alias("node"), "root", F.lit(None).cast(labels.schema["root"].dataType).alias("own")
        )
        own = labels.select("node", "root", F.col("root").alias("own"))
        heard = stored(
            own.unionByName(sent)
            .groupBy("node")
            .agg(F.min("root").alias("root"), F.max("own").alias("own")),
            "heard",
        )
        above = heard.select(F.col("node").alias("up"), F.col("root").alias("top"))
        jumped = heard.join(above, F.col("root") == F.col("up"), "left").select(
            "node",
            F.coalesce("top", "root").alias("root"),
            (F.coalesce("top", "root") != F.col("own")).alias("moved"),
        )
        labels = stored(jumped, "labels")
        if labels.where("moved").isEmpty():
            return labels.select("node", "root")
