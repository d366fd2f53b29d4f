"""Entropy over event-time windows of a stream of block rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.binning import equal_width
from ..operators.entropy import entropy_of


def windowed_entropy(rows: DataFrame, n_bins: int, lo: float, hi: float, every: str = "1 day", late: str = "1 hour", time: str = "ts", block: str = "block_id", value: str = "value") -> DataFrame:
    """window_start, block, entropy: counts per (window, block, bin), then their entropy, both with state bounded by the watermark. Works on streams (append mode) and on tables."""
    binned = rows.withColumn("bin", equal_width(F.col(value), lo, hi, n_bins)).where("bin is not null")
    if rows.isStreaming:  # watermarks need an instant
        binned = binned.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late)
    hist = binned.groupBy(F.window(time, every).alias("w"), block, "bin").agg(F.count("*").alias("n"))
    return hist.groupBy("w", block).agg(entropy_of("n").alias("entropy"), F.sum("n").alias("n")).select(F.col("w.start").alias("window_start"), block, "n", "entropy")


def write_windows(rows: DataFrame, path: str, checkpoint: str, **kw) -> StreamingQuery:
    """Appends each finished window once."""
    return windowed_entropy(rows, **kw).writeStream.outputMode("append").format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def update_steps(rows: DataFrame, path: str, checkpoint: str, n_bins: int, lo: float, hi: float) -> StreamingQuery:
    """Per micro-batch, the entropy so far of each (time_step, block_id) that it has rows of.

    Each batch adds its counts to a table of its own below `_counts` and entropies are those of all batches' counts up to it, so a step whose rows come in several batches is right after the
    last one; latest_steps() gives the last state of every step. A repeated batch replaces its own counts and output.
    """

    def sink(batch: DataFrame, epoch: int) -> None:
        spark, keys = batch.sparkSession, ["time_step", "block_id"]
        binned = batch.withColumn("bin", equal_width(F.col("value"), lo, hi, n_bins)).where("bin is not null")
        binned.groupBy(*keys, "bin").agg(F.count("*").alias("n")).write.mode("overwrite").parquet(f"{path}/_counts/epoch={epoch}")
        every = spark.read.parquet(f"{path}/_counts").where(F.col("epoch") <= epoch)
        now = every.where(F.col("epoch") == epoch).select(*keys).distinct()
        merged = every.join(now, keys, "left_semi").groupBy(*keys, "bin").agg(F.sum("n").alias("n"))
        merged.groupBy(*keys).agg(entropy_of("n").alias("entropy")).write.mode("overwrite").parquet(f"{path}/epoch={epoch}")

    return rows.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest_steps(spark: SparkSession, path: str) -> DataFrame:
    """time_step, block_id, entropy: the last state that update_steps() wrote of each step."""
    rows = spark.read.parquet(path)
    return rows.groupBy("time_step", "block_id").agg(F.max_by("entropy", "epoch").alias("entropy"))
