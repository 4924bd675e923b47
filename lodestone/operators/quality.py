"""Checks of bundles, shards, features and manifests; each returns its violations as rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.plans.skew import bounded


def set_gaps(expected: DataFrame, observed: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``keys.., side``: what is ``missing`` from the observed or ``extra`` there. Nulls equal nulls."""
    both = expected.select(*keys, F.lit(1).alias("__e"), F.lit(0).alias("__o")).unionByName(observed.select(*keys, F.lit(0).alias("__e"), F.lit(1).alias("__o")))
    g = both.groupBy(*keys).agg(F.max("__e").alias("__e"), F.max("__o").alias("__o"))
    return g.filter("__e <> __o").select(*keys, F.when(F.col("__e") == 1, "missing").otherwise("extra").alias("side"))


def completeness(pairs: DataFrame, features: DataFrame, keys: Sequence[str], needed: Sequence[str]) -> DataFrame:
    """``keys.., problem`` of each expected pair without features (``missing``), or of which a needed column is null in all (``null_<column>``)."""
    keys = list(keys)
    have = features.groupBy(*keys).agg(*(F.count(c).alias(f"__{c}") for c in needed), F.lit(True).alias("__have"))
    j = pairs.select(*keys).distinct().join(have, keys, "left")
    nulls = [F.when(F.col("__have") & (F.col(f"__{c}") == 0), f"null_{c}") for c in needed]
    problems = F.filter(F.array(F.when(F.col("__have").isNull(), "missing"), *nulls), lambda x: x.isNotNull())
    return j.select(*keys, F.explode(problems).alias("problem"))


def repeated_identities(members: DataFrame, keys: Sequence[str], digest: str) -> DataFrame:
    """``keys.., copies, contents, kind`` of identities that occur more than once: ``identical`` bytes or ``ambiguous``. A null digest is a content of its own."""
    g = members.groupBy(*keys).agg(F.count(F.lit(1)).alias("copies"), F.countDistinct(F.coalesce(digest, F.lit(""))).alias("contents"))
    return g.filter("copies > 1").withColumn("kind", F.when(F.col("contents") == 1, "identical").otherwise("ambiguous"))


def report_conflicts(matches: DataFrame, reported: DataFrame, keys: Sequence[str], passing: Column, count: str) -> DataFrame:
    """``keys.., passing, reported`` where a bundle's passing rows are not as many as its report says; a side that lacks the keys has 0."""
    p = matches.groupBy(*keys).agg(F.count_if(passing).alias("passing"))
    r = reported.groupBy(*keys).agg(F.sum(count).alias("reported"))
    return p.join(r, list(keys), "full").fillna(0, ["passing", "reported"]).filter("passing <> reported").select(*keys, "passing", "reported")


def shard_violations(rows: DataFrame, shard: str, catalog: Sequence[str], coordinates: Sequence[str]) -> DataFrame:
    """``check_name, shard, n``: of a union of shards, catalog entries a shard lacks (``catalog``), and coordinates that occur again (``repeated``) or in another shard too (``crossed``). Zeros are left out."""
    cat, shards = rows.select(*catalog).distinct(), rows.select(shard).distinct()
    want = cat.crossJoin(bounded(shards)).join(rows.select(*catalog, shard).distinct(), [*catalog, shard], "left_anti")
    g = rows.groupBy(*coordinates, shard).agg(F.count(F.lit(1)).alias("n"))
    across = g.groupBy(*coordinates).agg(F.count(F.lit(1)).alias("shards"), F.min(shard).alias(shard))
    name = lambda df, c: df.groupBy(shard).agg(F.count(F.lit(1)).alias("n")).select(F.lit(c).alias("check_name"), F.col(shard).cast("string").alias("shard"), "n")
    return name(want, "catalog").unionByName(name(g.filter("n > 1"), "repeated")).unionByName(name(across.filter("shards > 1"), "crossed"))


def record_violations(records: DataFrame, key: Sequence[str], index: str, status: str, passed: str, described: DataFrame, descriptor: Sequence[str]) -> DataFrame:
    """``check_name, n``: of shard records, groups whose indices are not 0, 1, 2, ..., statuses at odds with ``passed``, and indices described in more than one way."""
    gaps = records.groupBy(*key).agg(F.countDistinct(index).alias("n"), F.min(index).alias("low"), F.max(index).alias("high")).filter("low <> 0 or high <> n - 1")
    odd = records.filter(F.coalesce((F.col(status) == "DROP") == F.col(passed), F.lit(True)))
    two = described.groupBy(*key, index).agg(F.countDistinct(F.struct(*descriptor)).alias("n")).filter("n > 1")
    count = lambda df, c: df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(c).alias("check_name"), "n")
    return count(gaps, "contiguous").unionByName(count(odd, "status")).unionByName(count(two, "descriptor"))


def truth_conflicts(truth: DataFrame, manifest: DataFrame, key: str, item: str, fields: Sequence[str]) -> DataFrame:
    """``key, item, field, truth_value, manifest_value``: where truth and manifest differ, field by field and null-safe.

    The manifest names negatives explicitly (``expected`` false), so an item that the truth lacks must be one of them (field ``expected``), and
    each item of the truth must be named (field ``row``).
    """
    t = truth.select(key, item, F.lit(True).alias("__t"), *(F.col(f).cast("string").alias(f"t_{f}") for f in fields))
    m = manifest.select(key, item, F.lit(True).alias("__m"), F.col("expected").alias("__e"), *(F.col(f).cast("string").alias(f"m_{f}") for f in fields))
    j = t.join(m, [key, item], "full")
    has_t, has_m = F.col("__t").isNotNull(), F.col("__m").isNotNull()
    diff = lambda f, a, b, c: F.when(c, F.struct(F.lit(f).alias("field"), a.alias("truth_value"), b.alias("manifest_value")))
    none = F.lit(None).cast("string")
    rows = [diff("row", F.lit("present"), none, has_t & ~has_m), diff("expected", (has_t).cast("string"), F.col("__e").cast("string"), has_m & ~F.col("__e").eqNullSafe(has_t))]
    rows += [diff(f, F.col(f"t_{f}"), F.col(f"m_{f}"), has_t & has_m & ~F.col(f"t_{f}").eqNullSafe(F.col(f"m_{f}"))) for f in fields]
    return j.select(key, item, F.explode(F.filter(F.array(*rows), lambda x: x.isNotNull())).alias("d")).select(key, item, "d.*")


def inventory(known: DataFrame, have: DataFrame, kind: str, key: str, size: str) -> DataFrame:
    """``kind, entries, bytes, missing, extra, valid`` of a store beside the keys it should hold; valid with neither missing nor extra keys."""
    k = known.select(kind, key).distinct().withColumn("__k", F.lit(1))
    h = have.groupBy(kind, key).agg(F.count(F.lit(1)).alias("__n"), F.sum(size).alias("__b"))
    g = k.join(h, [kind, key], "full").groupBy(kind).agg(F.sum("__n").alias("entries"), F.sum("__b").alias("bytes"), F.count_if(F.col("__n").isNull()).alias("missing"), F.count_if(F.col("__k").isNull()).alias("extra"))
    return g.withColumn("valid", (F.col("missing") == 0) & (F.col("extra") == 0))


def audit_counts(files: DataFrame, key: str, payload: str) -> DataFrame:
    """``key, archive, cu, functions`` of audit files that hold ``{archive: {unit: functions}}``; a text that is no such object is an error when it is read."""
    m = files.select(key, F.explode(F.from_json(payload, "map<string,map<string,int>>", {"mode": "FAILFAST"})).alias("archive", "units"))
    return m.select(key, "archive", F.explode("units").alias("cu", "functions"))


def markdown_table(df: DataFrame, order: Sequence[str]) -> DataFrame:
    """``line_no, line`` of a table in Markdown, its rows in order; nulls are empty and bars escaped. For small report tables."""
    cell = lambda c: F.regexp_replace(F.coalesce(F.col(c).cast("string"), F.lit("")), r"\|", r"\\|")
    body = df.withColumn("line_no", F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(*order)) + 2).select("line_no", F.concat(F.lit("| "), F.concat_ws(" | ", *(cell(c) for c in df.columns)), F.lit(" |")).alias("line"))
    head = df.sparkSession.createDataFrame([(1, "| " + " | ".join(df.columns) + " |"), (2, "|" + "-|" * len(df.columns))], "line_no int, line string")
    return head.unionByName(body)
