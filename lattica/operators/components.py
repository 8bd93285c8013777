"""Connected components, for graphs with or without grouping keys."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` with its lineage cut, in the folder of spark.checkpoint.dir, or in the warehouse where that is unset."""
    spark = df.sparkSession
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        warehouse = spark.conf.get("spark.sql.warehouse.dir").rstrip("/")
        spark.sparkContext.setCheckpointDir(spark.conf.get("spark.checkpoint.dir", None) or f"{warehouse}/_checkpoints")
        where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(spark.sparkContext._jsc.sc().getCheckpointDir().get())
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)
    return df.checkpoint()


def connected_components(edges: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """(keys, a, b) to (keys, node, component), component the least node reachable.

    Labels are hooked to the least neighbour's and then jump to the label of
    their label, which takes about log rounds on long chains.
    """
    keys = keys or []
    both = edges.select(*keys, "a", "b").unionAll(edges.select(*keys, F.col("b").alias("a"), F.col("a").alias("b")))
    both = checkpointed(both.where("a <> b").distinct())
    labels = checkpointed(both.groupBy(*keys, F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("component")))
    while True:
        heard = both.join(labels.withColumnRenamed("node", "b"), [*keys, "b"]).groupBy(*keys, F.col("a").alias("node")).agg(F.min("component").alias("heard"))
        near = labels.join(heard, [*keys, "node"]).select(*keys, "node", F.col("component").alias("old"), F.least("component", "heard").alias("near"))
        roots = labels.select(*keys, F.col("node").alias("near"), F.col("component").alias("far"))
        step = checkpointed(near.join(roots, [*keys, "near"]).select(*keys, "node", "old", F.least("near", "far").alias("component")))
        labels = step.select(*keys, "node", "component")
        if step.where("component <> old").isEmpty():
            return labels
