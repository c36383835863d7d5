"""What iterative operators share: the checkpoint folder, and numbering in order."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def ensure_checkpoint(spark: SparkSession) -> None:
    """Uses spark.checkpoint.dir; a local session that has none gets a folder of its own."""
    if spark.sparkContext.getCheckpointDir():
        return
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if spark.sparkContext.master.partition("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="braidlake-")
    spark.sparkContext.setCheckpointDir(folder)


def numbered(ordered: DataFrame, name: str) -> DataFrame:
    """Adds the place of each row, from 0, in the order that the rows are in. Partitions are numbered and their sizes added up."""
    ensure_checkpoint(ordered.sparkSession)
    rows = ordered.withColumn("__m", F.monotonically_increasing_id()).checkpoint()
    part = F.shiftright("__m", 33)
    sizes = rows.groupBy(part.alias("__p")).agg(F.count("*").alias("n"))
    before = Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)  # one row for each partition
    sizes = sizes.select("__p", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__base"))
    rows = rows.withColumn("__p", part).join(F.broadcast(sizes), "__p")  # as many rows as there were tasks
    return rows.withColumn(name, F.col("__base") + F.col("__m").bitwiseAND(F.lit((1 << 33) - 1))).drop("__m", "__p", "__base")
