"""Search hits as a stream of raw-file URLs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lokora.functions import urls as U
from lokora.sources.lines import HIT_SCHEMA

# Folders that the written URLs are dealt to by hash; a batch reads those of its own URLs.
URL_BUCKETS = 64


def hits_to_urls(hits: DataFrame, lang: str | None = None) -> DataFrame:
    """Raw PO-file URLs of hits, batch or stream: the same column code for both."""
    rows = hits.filter(F.col("repository").isNotNull())
    if lang:
        rows = rows.filter(U.matches_locale(F.col("path"), lang))
    url: Column = U.hit_to_raw_url(F.col("repository"), F.col("commit"), F.col("path"))
    return rows.withColumn("url", url).filter(F.col("url").isNotNull() & U.is_po_url(F.col("url")))


def stream_hits(
    spark: SparkSession,
    source: str,
    lang: str | None = None,
    max_files: int = 1000,
) -> DataFrame:
    """A stream of URLs from a folder that receives hit files."""
    hits = (
        spark.readStream.schema(HIT_SCHEMA).option("maxFilesPerTrigger", max_files).json(source)
    )
    return hits_to_urls(hits, lang)


def write_url_stream(urls: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append the URLs to a Parquet folder, then stop when the input is used up."""
    return (
        urls.writeStream.format("parquet")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )


def read_new_urls(spark: SparkSession, path: str) -> DataFrame:
    """``(url, bucket, batch)``: the table that ``write_new_urls`` writes."""
    return spark.read.schema("url string, bucket int, batch long").parquet(path)


def write_new_urls(urls: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append each URL once, however late a repeat comes, then stop when the input is used up.

    The written table is the memory: each batch leaves out what earlier batches
    wrote, so that the stream itself keeps no state.  A batch that is run again,
    as after a failure, finds the same URLs and replaces its own folders.
    """
    spark = urls.sparkSession
    # An empty table to begin with; one that is there stays as it is.
    spark.createDataFrame([], "url string, bucket int, batch long").write.mode("append").partitionBy(
        "bucket", "batch"
    ).parquet(path)

    def add(batch: DataFrame, number: int) -> None:
        bucket = F.pmod(F.xxhash64("url"), F.lit(URL_BUCKETS)).cast("int")
        fresh = batch.select("url", bucket.alias("bucket")).dropDuplicates(["url"])
        own = [row["bucket"] for row in fresh.select("bucket").distinct().collect()]
        known = read_new_urls(batch.sparkSession, path)
        before = known.filter(F.col("bucket").isin(own) & (F.col("batch") < number))
        new = fresh.join(before.select("bucket", "url"), ["bucket", "url"], "left_anti")
        new.withColumn("batch", F.lit(number).cast("long")).repartition("bucket").write.mode("overwrite").option(
            "partitionOverwriteMode", "dynamic"
        ).partitionBy("bucket", "batch").parquet(path)

    return urls.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
