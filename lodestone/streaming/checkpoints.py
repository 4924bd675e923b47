"""Structured Streaming counterparts of append-only checkpoints and latest-wins compaction."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def read_log(spark: SparkSession, path: str, schema: str, files_per_trigger: int = 100) -> DataFrame:
    """New Parquet files of a folder as a stream."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def first_per_key(stream: DataFrame, keys: list[str], time: str, late: str = "1 day") -> DataFrame:
    """Rows whose key was not seen within the watermark."""
    return stream.withWatermark(time, late).dropDuplicatesWithinWatermark(keys)


def windowed_counts(stream: DataFrame, time: str, key: str, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Rows per key and window; late rows beyond the watermark are dropped."""
    return stream.withWatermark(time, late).groupBy(F.window(time, width), key).agg(F.count(F.lit(1)).alias("n"))


def latest_into(stream: DataFrame, keys: list[str], order: list[str], target: str, checkpoint: str) -> StreamingQuery:
    """Keep the latest row of each key in versions of a Parquet table below ``target``; batches already merged are not merged again.

    Only a first batch may lack a version before it; any error of reading one is raised. The last two versions stay.
    """
    from lodestone.operators.truth import latest

    def merge(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        at = lambda v: spark._jvm.org.apache.hadoop.fs.Path(f"{target}/v={v}")
        fs = at(0).getFileSystem(spark._jsc.hadoopConfiguration())
        # a version is there whole or not at all, as its job commits
        done = [v for v in (epoch - 1,) if v >= 0 and fs.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{target}/v={v}/_SUCCESS"))]
        if epoch and not done:
            raise FileNotFoundError(f"{target} lacks version {epoch - 1}, which batch {epoch} follows")
        rows = spark.read.schema(batch.schema).parquet(f"{target}/v={epoch - 1}").unionByName(batch) if done else batch
        latest(rows, keys, order).write.mode("overwrite").parquet(f"{target}/v={epoch}")
        if epoch > 1:
            fs.delete(at(epoch - 2), True)

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
