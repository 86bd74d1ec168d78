"""Connected components of a link table, as Spark joins over written rounds."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyframe.llm.common import written


def components(links: DataFrame, limit: int = 100) -> DataFrame:
    """``(node, root)`` for every node of ``links(a, b)``; the root is the smallest node reachable.

    Each round a node takes the smallest label of its neighbours (an aggregate, so a node with
    very many links is summed map-side), then jumps to its label's own label. Rounds grow with the
    logarithm of the longest path in practice; every round is written to the shared folder.
    """
    both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).filter("a <> b")
    both = written(both.distinct(), "links")
    labels = written(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("node")).alias("root")), "labels")
    for _ in range(limit):
        near = (
            both.join(labels.withColumnRenamed("node", "b"), "b")
            .groupBy(F.col("a").alias("node")).agg(F.min("root").alias("near"))
        )
        # hooking: the root of a node hears of the smallest label next to any of its members
        heard = labels.join(near, "node").select(F.explode(F.array(F.struct("node", F.least("root", "near").alias("root")), F.struct(F.col("root").alias("node"), F.least("root", "near").alias("root")))).alias("x")).select("x.*").groupBy("node").agg(F.min("root").alias("root"))
        jumped = (
            heard.join(heard.select(F.col("node").alias("root"), F.col("root").alias("next")), "root", "left")
            .select("node", F.least("root", F.coalesce("next", "root")).alias("root"))
        )
        after = written(jumped, "labels")
        changed = after.join(labels.withColumnRenamed("root", "was"), "node").filter("root <> was").limit(1).count()
        labels = after
        if not changed:
            return labels
    raise RuntimeError(f"components did not settle in {limit} rounds")
