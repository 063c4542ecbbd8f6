"""Structured Streaming forms of the genomic windows, for variants that keep arriving."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.clean import clean_chr
from ..functions.seq import mutation_type


def read_stream(spark: SparkSession, folder: str, schema) -> DataFrame:
    """A stream of Parquet files dropped into a folder."""
    return spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(folder)


def first_deliveries(stream: DataFrame, key: str, time: str, late: str = "60 days") -> DataFrame:
    """Repeated deliveries of a key dropped, within ``late`` of event time; later rows are
    dropped as too late, and state is kept no longer."""
    return stream.filter(F.col(time).isNotNull()).withWatermark(time, late).dropDuplicatesWithinWatermark([key])


def window_counts(stream: DataFrame, time: str, size: int = 10_000, span: str = "30 days", late: str | None = "60 days") -> DataFrame:
    """Per genomic window and event-time window the number of variants and transitions: chr,
    win, from_time, n, n_ts. Null chr, pos or time are left out. ``late``
    is the watermark, or None for a stream that already has one."""
    rows = stream.withColumn("chr", clean_chr(F.col("chr"))).filter(F.col("chr").isNotNull() & (F.col("pos") >= 1) & F.col(time).isNotNull())
    rows = rows.withColumn("win", F.expr(f"cast(pos div {size} as bigint)")).withColumn("ts", (mutation_type(F.col("ref"), F.col("alt")) == "ts").cast("long"))
    rows = rows.withWatermark(time, late) if late else rows
    g = rows.groupBy(F.window(time, span), "chr", "win").agg(F.count(F.lit(1)).alias("n"), F.sum("ts").alias("n_ts"))
    return g.select("chr", "win", F.col("window.start").alias("from_time"), "n", "n_ts")


def upsert(batch: DataFrame, epoch: int, path: str) -> None:
    """foreachBatch sink: each epoch has its own folder, written over on a retry, so a
    repeated epoch changes nothing (exactly once)."""
    batch.write.mode("overwrite").parquet(f"{path}/epoch={epoch}")
