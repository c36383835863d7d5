"""Streaming ingest of alignment lines: every micro-batch is parsed and appended, with ids that go on from the last."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from braidlake.functions import gaf


def ingest(spark: SparkSession, source: str, target: str, checkpoint: str):
    """Starts a query that takes in new text files of a folder and stops when there are none left. Malformed lines go to target/bad."""

    def append(batch: DataFrame, batch_id: int) -> None:
        lines = batch.withColumn("m", F.monotonically_increasing_id()).where(~F.col("value").startswith("@") & (F.col("value") != ""))
        # The id holds the batch, so a batch that is repeated gets its old ids again.
        number = F.row_number().over(Window.partitionBy("file").orderBy("m")).cast("long")
        files = lines.select("file").distinct().withColumn("f", F.dense_rank().over(Window.orderBy("file")).cast("long"))
        keyed = lines.join(F.broadcast(files), "file").withColumn("aln_id", F.lit(batch_id * (1 << 44)) + F.col("f") * (1 << 32) + number)
        parsed = gaf.parse_lines(keyed.select("aln_id", "value"))
        parsed.where("error is null").drop("error").write.mode("overwrite").parquet(f"{target}/reads/batch={batch_id}")
        parsed.where("error is not null").select("aln_id", "error").write.mode("overwrite").parquet(f"{target}/bad/batch={batch_id}")

    lines = spark.readStream.text(source).select("value", F.col("_metadata.file_path").alias("file"))
    return lines.writeStream.foreachBatch(append).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
