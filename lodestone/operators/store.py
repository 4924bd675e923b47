"""A content-addressed table store: entries by digest, committed batch by batch, with an index by archive."""

from __future__ import annotations

import uuid
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def canonical_json(fields: Mapping[str, Column]) -> Column:
    """A JSON object with its fields in name order, without blanks; nulls are kept."""
    return F.to_json(F.struct(*(fields[k].alias(k) for k in sorted(fields))), {"ignoreNullFields": "false"})


def canonical_digest(fields: Mapping[str, Column]) -> Column:
    """SHA-256 of ``canonical_json``: the key of an entry."""
    return F.sha2(canonical_json(fields), 256)


def combined_digest(parts: DataFrame, keys: list[str], order: str, content: str) -> DataFrame:
    """``keys.., digest``: SHA-256 over the digests of a group's contents in order; a null content counts as empty."""
    one = F.sha2(F.coalesce(F.col(content).cast("binary"), F.lit("").cast("binary")), 256)
    return parts.groupBy(*keys).agg(F.sha2(F.concat_ws("", F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), one.alias("d")))), lambda x: x["d"])), 256).alias("digest"))


def _fs(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def batches(spark: SparkSession, path: str) -> list[str]:
    """The committed batches below ``path``: those whose job left its success mark."""
    fs, at = _fs(spark, f"{path}/batch=*/_SUCCESS")
    return sorted(x.getPath().getParent().toString() for x in (fs.globStatus(at) or []))


def write_entries(entries: DataFrame, path: str, archive: str = "archive") -> None:
    """Add ``entries(key, archive, ...)`` as one batch, partitioned by archive; a batch that fails is never read.

    A hot archive is spread over several files by key. A key must hold the same content in every batch.
    """
    entries.repartition(F.col(archive), F.substring("key", 1, 1)).write.partitionBy(archive).parquet(f"{path}/batch={uuid.uuid4().hex}")


def read_entries(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """All committed entries, a key that several batches hold once; an empty table before the first batch.

    A filter on the partitioning archive prunes files, so one archive is read alone.
    """
    done = batches(spark, path)
    if not done:
        return spark.createDataFrame([], schema)
    names = [c.split()[0] for c in schema.split(", ")]
    parts = [spark.read.option("basePath", b).schema(schema).parquet(b) for b in done]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.dropDuplicates(["key"]).select(*names)


def misses(wanted: DataFrame, entries: DataFrame, key: str = "key") -> DataFrame:
    """Wanted keys that the store lacks, each once; null keys are no keys."""
    return wanted.filter(F.col(key).isNotNull()).select(key).distinct().join(entries.select(key), key, "left_anti")


def cached_only(wanted: DataFrame, entries: DataFrame, key: str = "key") -> DataFrame:
    """The wanted entries from the store alone; reading the first that is missing is an error."""
    j = wanted.select(key).distinct().join(entries.withColumn("__have", F.lit(True)), key, "left")
    return j.filter(F.coalesce("__have", F.raise_error(F.concat(F.lit("not in the store: "), F.coalesce(F.col(key), F.lit("null")))).cast("boolean"))).drop("__have")


def differences(a: DataFrame, b: DataFrame) -> DataFrame:
    """``side, rows``: how many rows of either table the other has fewer of; two equal tables give zeros. Columns are compared by name, nulls equal nulls."""
    cols = a.columns
    both = a.select("*", F.lit(1).alias("__l"), F.lit(0).alias("__r")).unionByName(b.select(*cols, F.lit(0).alias("__l"), F.lit(1).alias("__r")))
    g = both.groupBy(*cols).agg((F.sum("__l") - F.sum("__r")).alias("__d")).agg(F.coalesce(F.sum(F.greatest("__d", F.lit(0))), F.lit(0)).alias("left"), F.coalesce(F.sum(F.greatest(-F.col("__d"), F.lit(0))), F.lit(0)).alias("right"))
    return g.select(F.explode(F.create_map(F.lit("left"), "left", F.lit("right"), "right")).alias("side", "rows"))


def archive_index(entries: DataFrame, archive: str, functions: str) -> DataFrame:
    """What may rule an archive out unread: its entries and the least and most functions of a unit."""
    return entries.groupBy(archive).agg(F.count(F.lit(1)).alias("entries"), F.min(functions).alias("least_functions"), F.max(functions).alias("most_functions"))


def reusable(wanted: DataFrame, collected: DataFrame, pair: list[str], profile: str, signature: str) -> tuple[DataFrame, DataFrame]:
    """``(reused, missing)`` pairs of case and archive: features collected under the same profile and signature are taken as they are."""
    same = [*pair, profile, signature]
    return wanted.join(collected, same), wanted.join(collected.select(*same).distinct(), same, "left_anti")
