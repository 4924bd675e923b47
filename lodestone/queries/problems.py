"""Queries of the general training-data operators over the test tables, and the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.operators import hot_keys, orphans, schema_drift
from lodestone.plans.session import table, written

#: Letters a field's keys carry, and its JSON type.
MARKERS = {"feature_schema_version": ("schema", "number"), "asm_normalization": ("norm", "string"), "palmtree_pooling": ("pool", "string")}


def _number(raw: Column) -> Column:
    """The digits of a version such as ``7`` or ``v7``."""
    return F.regexp_extract(raw, "([0-9]+)", 1).try_cast("int")


CASTS = {"feature_schema_version": _number, "asm_normalization": lambda raw: F.trim(raw), "palmtree_pooling": lambda raw: F.trim(raw)}


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    files = schema_drift.file_schemas(table(spark, d, "feature_logs"))
    return schema_drift.field_changes(files, MARKERS).select("file_id", "field_name", "change_kind")


def p1_changes(spark: SparkSession, d: str) -> DataFrame:
    files = written(schema_drift.file_schemas(table(spark, d, "feature_logs")), "file-schemas")
    return schema_drift.all_changes(files)


def p1_balance(spark: SparkSession, d: str) -> DataFrame:
    """Paths that each file lost and gained, and those whose type changed in place: what the reported changes must add up to."""
    c = p1_changes(spark, d)
    old, new, both = F.col("old_path"), F.col("new_path"), F.coalesce(F.col("old_path") == F.col("new_path"), F.lit(False))
    gone, come = F.count_distinct(F.when(~both & (F.col("change_kind") != "added"), old)), F.count_distinct(F.when(~both & (F.col("change_kind") != "removed"), new))
    return c.groupBy("file_id").agg(gone.alias("gone"), come.alias("come"), F.count_distinct(F.when(both & (F.col("change_kind") == "retyped"), old)).alias("retyped"))


def p1_unified(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "feature_logs")
    files = written(schema_drift.file_schemas(lines), "file-schemas")
    return schema_drift.unified(lines, files, MARKERS, CASTS)


def p1_rejects(spark: SparkSession, d: str) -> DataFrame:
    return schema_drift.rejected(table(spark, d, "feature_logs"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    parts = [
        hot_keys.hot_keys(table(spark, d, t), key).select(F.lit(key).alias("field_name"), F.col("key_value").cast("string").alias("key_value"))
        for t, key in (("archive_members", "name"), ("block_matches", "num_source_blocks"))
    ]
    return parts[0].unionByName(parts[1])


def p2_names(spark: SparkSession, d: str) -> DataFrame:
    by = ["extracted_at", "ingested_at", "member_id"]
    return hot_keys.dense_key_stats(table(spark, d, "archive_members"), "name", ["n_functions"], by, ["member_id", "archive", "object_sha256", "extracted_at"], key_alias="name")


def p2_source_blocks(spark: SparkSession, d: str) -> DataFrame:
    by = ["matched_at", "ingested_at", "match_id"]
    return hot_keys.dense_key_stats(table(spark, d, "block_matches"), "num_source_blocks", ["num_target_blocks", "windows_total"], by, ["match_id", "library", "matched_at"], key_alias="num_source_blocks")


def _orphans(spark: SparkSession, d: str) -> DataFrame:
    catalog = orphans.validity(table(spark, d, "library_archives"), F.nullif(F.trim("archive"), F.lit("")), "registered_at", "deleted_at", F.col("status") == "selected")
    return orphans.orphan_rows(orphans.archive_references(table(spark, d, "elf_archives"), table(spark, d, "archive_members")), catalog)


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return _orphans(spark, d).select("table_name", "row_id")


def p6_counts(spark: SparkSession, d: str) -> DataFrame:
    return orphans.orphan_counts(_orphans(spark, d))


QUERIES = {f.__name__: f for f in (p1_found, p1_changes, p1_balance, p1_unified, p1_rejects, p2_found, p2_names, p2_source_blocks, p6_found, p6_counts)}

_LATEST = "row_number() OVER (PARTITION BY {k} ORDER BY {o}) AS rn"
_ORPHANS = """
WITH r AS (SELECT DISTINCT 'elf_archives' AS table_name, ref_id AS row_id, archive, archive_basename, linked_at AS t FROM elf_archives
  UNION ALL SELECT DISTINCT 'archive_members', member_id, archive, archive_basename, extracted_at FROM archive_members),
n AS (SELECT DISTINCT table_name, row_id, coalesce(nullif(trim(archive_basename), ''), nullif(trim(regexp_extract(archive, '[^/]*$')), '')) AS name, t FROM r),
o AS (SELECT * FROM n WHERE name IS NOT NULL AND t IS NOT NULL AND NOT EXISTS (SELECT 1 FROM library_archives l WHERE trim(l.archive) = n.name AND l.status = 'selected' AND l.registered_at <= n.t AND (l.deleted_at IS NULL OR l.deleted_at > n.t)))
"""
_TREE = """
WITH RECURSIVE l AS (SELECT DISTINCT campaign_id, file_seq, file_id, payload FROM feature_logs),
ok AS (SELECT *, payload::JSON AS j FROM l WHERE json_valid(payload) AND json_type(payload) = 'OBJECT'),
t(campaign_id, file_seq, file_id, path, v) AS (
  SELECT campaign_id, file_seq, file_id, k, json_extract(j, '$."' || k || '"') FROM (SELECT *, unnest(json_keys(j)) AS k FROM ok)
  UNION ALL SELECT campaign_id, file_seq, file_id, path || '/' || k, json_extract(v, '$."' || k || '"') FROM (SELECT *, unnest(json_keys(v)) AS k FROM t WHERE json_type(v) = 'OBJECT')),
m AS (SELECT * FROM (VALUES ('feature_schema_version', 'schema'), ('asm_normalization', 'norm'), ('palmtree_pooling', 'pool')) x(field_name, mark)),
f AS (SELECT campaign_id, file_seq, file_id, field_name, list_sort(list(DISTINCT path)) AS paths,
  list_sort(list(DISTINCT CASE json_type(v) WHEN 'VARCHAR' THEN 'string' WHEN 'BOOLEAN' THEN 'boolean' WHEN 'ARRAY' THEN 'array' ELSE 'number' END)) AS kinds
  FROM t JOIN m ON contains(lower(path), mark) WHERE json_type(v) NOT IN ('OBJECT', 'NULL') GROUP BY ALL),
q AS (SELECT *, lag(file_id) OVER (PARTITION BY campaign_id ORDER BY file_seq) AS prior FROM (SELECT DISTINCT campaign_id, file_seq, file_id FROM l)),
d AS (SELECT q.file_id, m.field_name, a.paths AS op, b.paths AS np, a.kinds AS ok, b.kinds AS nk FROM q CROSS JOIN m
  LEFT JOIN f a ON a.file_id = q.prior AND a.field_name = m.field_name LEFT JOIN f b ON b.file_id = q.file_id AND b.field_name = m.field_name WHERE q.prior IS NOT NULL)
"""
_PATHS = _TREE[: _TREE.index("m AS (SELECT * FROM (VALUES")] + """p AS (SELECT file_id, path, list_sort(list(DISTINCT CASE json_type(v) WHEN 'VARCHAR' THEN 'string' WHEN 'BOOLEAN' THEN 'boolean' WHEN 'ARRAY' THEN 'array' ELSE 'number' END)) AS kinds
  FROM t WHERE json_type(v) NOT IN ('OBJECT', 'NULL') GROUP BY ALL)"""

SQL = {
    "p1_found": _TREE + """SELECT file_id, field_name, 'added' AS change_kind FROM d WHERE op IS NULL AND np IS NOT NULL
UNION ALL SELECT file_id, field_name, 'removed' FROM d WHERE op IS NOT NULL AND np IS NULL
UNION ALL SELECT file_id, field_name, 'renamed' FROM d WHERE op <> np
UNION ALL SELECT file_id, field_name, 'retyped' FROM d WHERE ok <> nk""",
    "p1_unified": """
WITH RECURSIVE ok AS (SELECT DISTINCT file_id, line_no, payload FROM feature_logs WHERE json_valid(payload) AND json_type(payload) = 'OBJECT'),
t(file_id, line_no, payload, path, v) AS (
  SELECT file_id, line_no, payload, k, json_extract(payload::JSON, '$."' || k || '"') FROM (SELECT *, unnest(json_keys(payload::JSON)) AS k FROM ok)
  UNION ALL SELECT file_id, line_no, payload, path || '/' || k, json_extract(v, '$."' || k || '"') FROM (SELECT *, unnest(json_keys(v)) AS k FROM t WHERE json_type(v) = 'OBJECT')),
l AS (SELECT file_id, line_no, payload, path, lower(path) AS low, trim(CASE json_type(v) WHEN 'VARCHAR' THEN v->>'$' ELSE replace(v::VARCHAR, ', ', ',') END) AS x FROM t WHERE json_type(v) NOT IN ('OBJECT', 'NULL')),
f AS (SELECT file_id, line_no, payload, min_by(x, path) FILTER (contains(low, 'schema')) AS a, min_by(x, path) FILTER (contains(low, 'norm')) AS b, min_by(x, path) FILTER (contains(low, 'pool')) AS c FROM l GROUP BY ALL)
SELECT file_id, line_no, try_cast(nullif(regexp_extract(a, '([0-9]+)', 1), '') AS INT) AS feature_schema_version, b AS asm_normalization, c AS palmtree_pooling FROM f""",
    "p1_rejects": """
WITH l AS (SELECT DISTINCT file_id, line_no, payload, coalesce(json_valid(payload), false) AS ok FROM feature_logs), k AS (SELECT *, CASE WHEN ok THEN json_type(payload) END AS kind FROM l)
SELECT DISTINCT file_id, line_no, CASE WHEN payload IS NULL THEN 'null' WHEN trim(payload) = '' THEN 'empty' WHEN NOT ok THEN 'broken' ELSE 'no_object' END AS reason FROM k WHERE kind IS DISTINCT FROM 'OBJECT'""",
    "p1_balance": _PATHS + """,
q AS (SELECT *, lag(file_id) OVER (PARTITION BY campaign_id ORDER BY file_seq) AS prior FROM (SELECT DISTINCT campaign_id, file_seq, file_id FROM l)),
n AS (SELECT q.file_id, p.path, p.kinds, 1 AS side FROM q JOIN p ON p.file_id = q.file_id WHERE prior IS NOT NULL UNION ALL SELECT q.file_id, p.path, p.kinds, 0 FROM q JOIN p ON p.file_id = q.prior),
g AS (SELECT file_id, path, count(*) FILTER (side = 0) AS o, count(*) FILTER (side = 1) AS w, count(DISTINCT kinds) AS k FROM n GROUP BY ALL)
SELECT file_id, count(*) FILTER (w = 0) AS gone, count(*) FILTER (o = 0) AS come, count(*) FILTER (o = 1 AND w = 1 AND k = 2) AS retyped FROM g GROUP BY file_id HAVING count(*) FILTER (w = 0 OR o = 0 OR k = 2) > 0""",
    "p2_found": """SELECT 'name' AS field_name, name AS key_value FROM archive_members WHERE name IS NOT NULL GROUP BY name HAVING count(*) >= 0.02 * (SELECT count(*) FROM archive_members)
UNION ALL SELECT 'num_source_blocks', num_source_blocks::VARCHAR FROM block_matches WHERE num_source_blocks IS NOT NULL GROUP BY num_source_blocks HAVING count(*) >= 0.02 * (SELECT count(*) FROM block_matches)""",
    "p2_names": f"""WITH x AS (SELECT *, {_LATEST.format(k="name", o="extracted_at DESC NULLS LAST, ingested_at DESC NULLS LAST, member_id DESC NULLS LAST")} FROM archive_members)
SELECT name, count(*) AS n, sum(n_functions)::BIGINT AS sum_n_functions, any_value(member_id) FILTER (rn = 1) AS latest_member_id, any_value(archive) FILTER (rn = 1) AS latest_archive,
any_value(object_sha256) FILTER (rn = 1) AS latest_object_sha256, any_value(extracted_at) FILTER (rn = 1) AS latest_extracted_at FROM x GROUP BY name""",
    "p2_source_blocks": f"""WITH x AS (SELECT *, {_LATEST.format(k="num_source_blocks", o="matched_at DESC NULLS LAST, ingested_at DESC NULLS LAST, match_id DESC NULLS LAST")} FROM block_matches)
SELECT num_source_blocks, count(*) AS n, sum(num_target_blocks)::BIGINT AS sum_num_target_blocks, sum(windows_total)::BIGINT AS sum_windows_total,
any_value(match_id) FILTER (rn = 1) AS latest_match_id, any_value(library) FILTER (rn = 1) AS latest_library, any_value(matched_at) FILTER (rn = 1) AS latest_matched_at FROM x GROUP BY num_source_blocks""",
    "p6_found": _ORPHANS + "SELECT DISTINCT table_name, row_id FROM o",
    "p6_counts": _ORPHANS + "SELECT table_name, strftime(t, '%Y-%m') AS period, count(DISTINCT row_id) AS n_orphans, count(DISTINCT name) AS n_keys FROM o GROUP BY ALL",
}
