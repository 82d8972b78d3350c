"""Raw responses as they arrive: an addition for continuous delivery; the batch functions are the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from vellum.session import folder_exists
from vellum.sources.artifacts import new_contents

RAW = "record_id BIGINT, feed STRING, file_no INT, file_name STRING, delivered_at TIMESTAMP, payload STRING"
STORE = "content_sha256 STRING, payload STRING, part STRING"


def read_deliveries(spark: SparkSession, path: str) -> DataFrame:
    """Files of delivered records (JSON lines) as a stream."""
    return spark.readStream.schema(RAW).option("maxFilesPerTrigger", 100).json(path)


def store_new(deliveries: DataFrame, store: str, checkpoint: str) -> StreamingQuery:
    """Appends contents that the store doesn't hold yet (content_sha256, payload), once each, in whatever batch they come.

    The store lies in 256 folders by the hash's first two digits (part), and a batch reads the hashes of its own folders
    only. A batch that is run again after a failure finds what it had written and adds nothing; a store that can't be
    read is an error, never an empty store.
    """
    part = F.substring("content_sha256", 1, 2)

    def write(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        batch = batch.persist()
        if folder_exists(spark, store):
            parts = [r[0] for r in batch.where("payload is not null").select(F.substring(F.sha2("payload", 256), 1, 2)).distinct().collect()]  # at most 256
            stored = spark.read.schema(STORE).parquet(store).where(F.col("part").isin(parts)).select("content_sha256")
        else:
            stored = spark.createDataFrame([], "content_sha256 string")
        new_contents(batch, stored, "payload").withColumn("part", part).write.mode("append").partitionBy("part").parquet(store)
        batch.unpersist()

    return deliveries.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def hourly_counts(deliveries: DataFrame, late: str = "2 days") -> DataFrame:
    """Deliveries and different contents (approximate) per feed and hour; rows later than `late` are left out."""
    return deliveries.withWatermark("delivered_at", late).groupBy("feed", F.window("delivered_at", "1 hour").alias("hour")).agg(F.count("*").alias("deliveries"), F.approx_count_distinct(F.xxhash64("payload")).alias("contents"))
