"""Dereplication of reads that arrive over time."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from siltflow.operators.derep import dereplicate

SCHEMA = "rec_no long, seq string, exp string, sample string, loaded_at timestamp"


def read_drops(spark: SparkSession, folder: str, schema: str = SCHEMA, files_a_batch: int = 100) -> DataFrame:
    """Stream of Parquet files of reads as they are dropped into a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_a_batch).parquet(folder)


def running_counts(reads: DataFrame) -> DataFrame:
    """Running (seq, exp, sample, cnt) over the stream: state holds one counter per key. Write in update mode."""
    return dereplicate(reads)


def counts_by_window(reads: DataFrame, time: str = "loaded_at", width: str = "1 day", late: str = "1 hour") -> DataFrame:
    """(window_start, exp, sample, reads): counts of loading windows. State of a window is dropped once the watermark has passed it; later reads are not counted."""
    timed = reads.withWatermark(time, late)
    return timed.groupBy(F.window(time, width).alias("w"), "exp", "sample").agg(F.count("*").alias("reads")).select(F.col("w.start").alias("window_start"), "exp", "sample", "reads")


def start(counts: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Run over what is there and stop, with progress kept in ``checkpoint``, so that a restart counts nothing twice.

    Every batch writes the counts that it changed to a folder of its own below ``out``, over what a failed try of it has left. Nothing is gathered at the driver.
    """

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

    return counts.writeStream.outputMode("update").foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest(spark: SparkSession, out: str, value: str) -> DataFrame:
    """The counts as of the last batch: of every key the one written last."""
    df = spark.read.parquet(out)
    keys = [c for c in df.columns if c not in (value, "batch")]
    return df.groupBy(*keys).agg(F.max_by(value, "batch").alias(value))
