"""Sinks: logs, reports, tables and bundles; a job's commit is atomic, so a file that is there is whole."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def write_feature_log(records: DataFrame, path: str) -> None:
    """One JSON object a line, gzip."""
    records.select(F.to_json(F.struct("*")).alias("value")).write.mode("overwrite").option("compression", "gzip").text(path)


def report_line(status: Column, fields: Mapping[str, Column]) -> Column:
    """``STATUS | k=v | k=v``; null values are empty."""
    return F.concat_ws(" | ", F.rpad(status, 7, " "), *(F.concat(F.lit(f"{k}="), F.coalesce(v.cast("string"), F.lit(""))) for k, v in fields.items()))


def write_report(lines: DataFrame, path: str) -> None:
    """A text report from one column of lines."""
    lines.write.mode("overwrite").text(path)


def write_table(df: DataFrame, path: str, kind: str = "csv") -> None:
    """CSV with header, TSV, JSON lines or Parquet; another kind is an error."""
    w = df.write.mode("overwrite")
    if kind in ("csv", "tsv"):
        w.option("header", True).option("sep", "\t" if kind == "tsv" else ",").csv(path)
    elif kind in ("json", "parquet"):
        getattr(w, kind)(path)
    else:
        raise ValueError(f"unknown kind {kind!r}")


def bundle(parts: Mapping[str, DataFrame]) -> DataFrame:
    """Tagged union of several record types: ``type, value``, each value a JSON object with its type."""
    out = None
    for tag, df in parts.items():
        rows = df.select(F.lit(tag).alias("type"), F.to_json(F.struct(F.lit(tag).alias("type"), *df.columns)).alias("value"))
        out = rows if out is None else out.unionByName(rows)
    return out


def bundle_gaps(elfs: DataFrame, libraries: DataFrame, matches: DataFrame) -> DataFrame:
    """Decisions a complete bundle lacks or has more than once: ``elf_id, library_id, n``."""
    # the libraries of a run as one array: a catalog's names, far fewer than its decisions
    names = libraries.agg(F.collect_set("library_id").alias("__l"))
    want = elfs.select("elf_id").distinct().crossJoin(F.broadcast(names)).select("elf_id", F.explode("__l").alias("library_id")).withColumn("__want", F.lit(1))
    have = matches.groupBy("elf_id", "library_id").agg(F.count(F.lit(1)).alias("n"))
    return want.join(have, ["elf_id", "library_id"], "full").filter("n is null or n <> 1 or __want is null").select("elf_id", "library_id", F.coalesce("n", F.lit(0)).alias("n"))


def write_checked(df: DataFrame, path: str) -> int:
    """Write gzip JSON lines and read them back: an error if what is there is not what was written. Returns the rows."""
    df.write.mode("overwrite").option("compression", "gzip").json(path)
    back = df.sparkSession.read.schema(df.schema).json(path, mode="FAILFAST")
    digest = lambda x: x.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64(F.to_json(F.struct("*"))).cast("decimal(38,0)")).alias("h")).first()
    a, b = digest(df), digest(back)
    if a != b:
        raise ValueError(f"{path} holds {b.n} rows that differ from the {a.n} written")
    return b.n


def write_manifest(df: DataFrame, path: str, order: list[str]) -> None:
    """A manifest as CSV with header and as JSON lines, in one file each, in order; manifests are small tables."""
    rows = df.orderBy(*order).coalesce(1)
    write_table(rows, f"{path}/csv")
    write_table(rows, f"{path}/json", "json")


def write_checked_bundle(elfs: DataFrame, libraries: DataFrame, matches: DataFrame, units: DataFrame, path: str) -> None:
    """A result bundle, only if it is complete: every binary with every library once, and as many ``PASS`` units (``elf_id, library_id, cu_status``) as ``matches.accepted`` says."""
    from lodestone.operators.quality import report_conflicts

    for bad, what in ((bundle_gaps(elfs, libraries, matches), "decisions are missing or repeated"), (report_conflicts(units, matches, ["elf_id", "library_id"], F.col("cu_status") == "PASS", "accepted"), "passing units differ from the report")):
        first = bad.first()
        if first is not None:
            raise ValueError(f"{what}: {first.asDict()}")
    write_bundle({"elf": elfs, "library": libraries, "library_match": matches, "block_cu": units}, path)


def write_bundle(parts: Mapping[str, DataFrame], path: str) -> None:
    """The union as text, split by type, so one type can be read alone."""
    bundle(parts).write.mode("overwrite").partitionBy("type").option("compression", "gzip").text(path)


def read_bundle(spark: SparkSession, path: str, tag: str, schema: str) -> DataFrame:
    """One record type of a bundle, typed."""
    return spark.read.text(path).filter(F.col("type") == tag).select(F.from_json("value", schema, {"mode": "FAILFAST"}).alias("r")).select("r.*")


def append_checkpoint(done: DataFrame, path: str) -> None:
    """Add finished cases to a checkpoint table."""
    done.write.mode("append").parquet(path)


def pending(cases: DataFrame, checkpoint: DataFrame, signature: str, key: str = "case_id", legacy: tuple[str, ...] = ()) -> DataFrame:
    """Cases the checkpoint does not hold under this signature, or one of ``legacy`` signatures that means the same."""
    return cases.join(checkpoint.filter(F.col("signature").isin(signature, *legacy)).select(key), key, "left_anti")


def migrated(checkpoint: DataFrame, signature: str, legacy: tuple[str, ...], order: list[str], key: str = "case_id") -> DataFrame:
    """The checkpoint with legacy signatures renamed; of a case that then has several records the latest stays, others are untouched."""
    from lodestone.operators.truth import latest

    old = F.col("signature").isin(*legacy) if legacy else F.lit(False)
    return latest(checkpoint.withColumn("signature", F.when(old, F.lit(signature)).otherwise(F.col("signature"))), [key, "signature"], order)


def require_empty(df: DataFrame, message: str) -> DataFrame:
    """The same rows, of which the first one read raises ``message``: a check inside the plan."""
    return df.filter(F.raise_error(F.lit(message)).cast("string").isNull())
