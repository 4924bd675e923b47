"""Queries of the llm operators over the test tables, and the SQL that checks them."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm import chunking, knn, linked_splits, mixing, packing, split_overlap, tokens
from lodestone.plans.session import shared_dir, table, written


def _sizes(spark: SparkSession, d: str) -> DataFrame:
    """Token counts of all documents, written once as several steps need them."""
    return written(tokens.token_counts(table(spark, d, "documents"), "text", ["doc_id", "source"]), "token-counts")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    pairs = split_overlap.overlaps(table(spark, d, "profile_records"))
    return pairs.select(F.least("eval_id", "train_id").alias("record_id_a"), F.greatest("eval_id", "train_id").alias("record_id_b")).distinct()


def p3_counts(spark: SparkSession, d: str) -> DataFrame:
    pairs = split_overlap.overlaps(table(spark, d, "profile_records"))
    distinct = pairs.select("split_name", "source_project", "eval_id", "train_id").distinct()
    return distinct.groupBy("split_name", "source_project").agg(F.count(F.lit(1)).alias("n_pairs"))


def p3_linked(spark: SparkSession, d: str) -> DataFrame:
    return split_overlap.linked(table(spark, d, "profile_records"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    near = knn.nearest(table(spark, d, "blocks"), "block_id", "normalized_embeddings", min_similarity=0.9)
    return near.select(F.least("id", "neighbour_id").alias("block_id_a"), F.greatest("id", "neighbour_id").alias("block_id_b")).distinct()


def p4_knn(spark: SparkSession, d: str) -> DataFrame:
    # most vectors have no near neighbour, and no window tells the nearest of far ones: the query set, every twentieth id, meets all vectors
    near = knn.nearest(table(spark, d, "blocks"), "block_id", "normalized_embeddings", exact=True, queries="id % 20 = 0")
    return near.select(F.col("id").alias("block_id"), "rank", F.col("neighbour_id").alias("neighbour_block_id"), F.round("similarity", 3).alias("similarity"))


def _builds(spark: SparkSession, d: str) -> DataFrame:
    compiler = F.translate(F.lower(F.trim(F.substring_index("compiler", "/", -1))), " ", "-")
    level = F.translate(F.lower(F.trim("elf_optimization")), "-", "")
    return table(spark, d, "build_info").select(
        "build_id",
        "built_at",
        F.nullif(split_overlap.plain_name(F.col("program")), F.lit("")).alias("program"),
        F.when(F.col("binary_size") > 0, F.nullif(F.lower(F.trim("binary_sha256")), F.lit(""))).alias("binary"),
        F.concat_ws("|", F.coalesce(compiler, F.lit("-")), F.coalesce(level, F.lit("-"))).alias("stratum"),
    )


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return linked_splits.leads(linked_splits.assign(_builds(spark, d), "build_id", ["program", "binary"], "stratum", table(spark, d, "split_targets")))


def _two_batches(spark: SparkSession, d: str) -> linked_splits.Components:
    """The builds of the year's first nine months, then the others, by the state that the first batch left in the shared folder."""
    builds, targets = _builds(spark, d), table(spark, d, "split_targets")
    later = F.coalesce(F.col("built_at") >= F.lit("2025-10-01").cast("timestamp_ntz"), F.lit(False))
    path = f"{shared_dir(spark)}/lodestone/{spark.sparkContext.applicationId}/splits-{uuid.uuid4().hex}"
    linked_splits.assign(builds.filter(~later), "build_id", ["program", "binary"], "stratum", targets).save(path, 1)
    linked_splits.assign(builds.filter(later), "build_id", ["program", "binary"], "stratum", targets, linked_splits.Components.load(spark, path)).save(path, 2)
    return linked_splits.Components.load(spark, path)


def p5_splits(spark: SparkSession, d: str) -> DataFrame:
    return _two_batches(spark, d).members.select(F.col("id").alias("build_id"), F.col("root").alias("component"), "split_name", "status")


def p5_checks(spark: SparkSession, d: str) -> DataFrame:
    """Related builds after two batches, each with its lead, and whether the splits keep their rules."""
    m = _two_batches(spark, d).members
    # a build's part has one split, and only quarantined builds lack one
    one = m.filter("split_name is not null").groupBy("part").agg((F.countDistinct("split_name") == 1).alias("one_split"))
    lead = m.groupBy("root").agg(F.min("id").alias("lead_build_id"))
    ruled = F.col("split_name").isNull() == (F.col("status") == "quarantined")
    rows = m.join(lead, "root").join(one, "part", "left").filter("id <> lead_build_id")
    return rows.select("lead_build_id", F.col("id").alias("build_id"), ruled.alias("split_or_quarantined"), F.coalesce("one_split", F.lit(True)).alias("one_split"))


def p7_containers(spark: SparkSession, d: str) -> DataFrame:
    sizes = tokens.token_counts(table(spark, d, "documents"), "text", ["doc_id"])
    return packing.pack(sizes, "doc_id", "n_tokens").withColumnRenamed("item_id", "doc_id")


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return p7_containers(spark, d).filter("piece_no = 1").select("doc_id")


def p7_checks(spark: SparkSession, d: str) -> DataFrame:
    """Of each text whether its pieces make it up once, is cut only if it must be, and lies in containers that are not overfull."""
    sizes = _sizes(spark, d)
    packed = written(packing.pack(sizes, "doc_id", "n_tokens"), "packed")
    bins = packed.groupBy("container_id").agg(F.sum("size").alias("total"), F.max("fill").alias("high"), F.min("fill").alias("low"))
    good = bins.select("container_id", ((F.col("total") == F.col("high")) & (F.col("high") == F.col("low")) & (F.col("total") <= 2048)).alias("good"))
    per = packed.join(good, "container_id").groupBy(F.col("item_id").alias("doc_id")).agg(F.sum("size").alias("packed"), F.max("end").alias("end"), F.count(F.lit(1)).alias("pieces"), F.bool_and("good").alias("fits"))
    needed = F.greatest(F.lit(1), F.ceil(F.col("n_tokens") / 2048))
    return sizes.join(per, "doc_id", "left").select("doc_id", ((F.col("packed") == F.col("n_tokens")) & (F.col("end") == F.col("n_tokens"))).alias("whole"), (F.col("pieces") == needed).alias("cut_if_needed"), "fits")


def _mixed(spark: SparkSession, d: str, hold: bool = False) -> tuple[DataFrame, DataFrame]:
    """The mix, written, and its plan."""
    sizes = _sizes(spark, d)
    plan = mixing.mix_plan(sizes, table(spark, d, "mix_targets"), hold=hold)
    return written(mixing.mix(sizes, plan), "mix"), plan


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return mixing.shares(*_mixed(spark, d)).filter("lacks").select("source")


def p8_mix(spark: SparkSession, d: str) -> DataFrame:
    sizes = _sizes(spark, d)
    return mixing.mix(sizes, mixing.mix_plan(sizes, table(spark, d, "mix_targets")))


def p8_shares(spark: SparkSession, d: str) -> DataFrame:
    return mixing.shares(*_mixed(spark, d)).drop("lacks")


def p8_checks(spark: SparkSession, d: str) -> DataFrame:
    """Of each target source, with and without holding the shares: within its uses, on its share but for one document, and no document twice in a use."""
    parts = []
    for hold in (False, True):
        mixed, plan = _mixed(spark, d, hold)
        longest = mixed.groupBy("source").agg(F.max("n_tokens").alias("longest"), (F.count(F.lit(1)) == F.countDistinct("doc_id", "use_no")).alias("once"), F.min("position").between(0, 1).alias("placed"))
        x = mixing.shares(mixed, plan).join(plan.select("source", "demand", "max_uses"), "source").join(longest, "source", "left")
        met = F.col("lacks") if not hold else F.lit(False)
        on_share = met | (F.abs(F.col("tokens") - F.col("demand")) <= F.coalesce("longest", F.lit(0)))
        parts.append(x.select("source", F.lit(hold).alias("hold"), F.round("target_share", 4).alias("target_share"), (F.col("most_uses") <= F.col("max_uses")).alias("within_uses"), on_share.alias("on_share"), F.coalesce(F.col("once") & F.col("placed"), F.lit(True)).alias("once")))
    return parts[0].unionByName(parts[1])


def p9_pieces(spark: SparkSession, d: str) -> DataFrame:
    return chunking.chunk(table(spark, d, "documents"), "doc_id", "text")


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return p9_pieces(spark, d).filter("piece_no = 1").select("doc_id")


def p9_checks(spark: SparkSession, d: str) -> DataFrame:
    """Each text put together again from its pieces (or as it is, if it was not cut), and whether all pieces keep the limit and the overlap."""
    docs = table(spark, d, "documents")
    p = p9_pieces(spark, d)
    own = F.expr("substring(piece, overlap_chars + 1)")
    limits = (F.col("n_tokens") <= 768) & ((F.col("piece_no") == 0) | (F.col("overlap_chars") > 0))
    # a text's pieces are bounded by the text
    whole = p.groupBy("doc_id").agg(F.md5(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("piece_no", own.alias("own")))), lambda x: x["own"]), "")).alias("put"), F.bool_and(limits).alias("limits_kept"))
    # texts without pieces are digested where they lie
    j = docs.select("doc_id", F.md5("text").alias("as_is")).join(whole, "doc_id", "left")
    return j.select("doc_id", F.coalesce("put", "as_is").alias("digest"), F.coalesce("limits_kept", F.lit(True)).alias("limits_kept"))


QUERIES = {
    f.__name__: f
    for f in (p3_found, p3_counts, p3_linked, p4_found, p4_knn, p5_found, p5_splits, p5_checks, p7_found, p7_containers, p7_checks, p8_found, p8_mix, p8_shares, p8_checks, p9_found, p9_pieces, p9_checks)
}

_OVERLAP = r"""
WITH r AS (SELECT DISTINCT ON (record_id) record_id, split_name, source_project, hashes, programs FROM profile_records WHERE split_name IN ('train', 'validation', 'test') AND record_id IS NOT NULL),
h AS (SELECT DISTINCT record_id, lower(regexp_extract(x, '[0-9A-Fa-f]{64}')) AS e FROM (SELECT record_id, unnest(hashes) AS x FROM r) WHERE regexp_matches(x, '[0-9A-Fa-f]{64}')),
p0 AS (SELECT DISTINCT record_id, translate(lower(trim(x)), '_ ', '--') AS e FROM (SELECT record_id, unnest(programs) AS x FROM r) WHERE trim(x) <> ''),
p AS (SELECT * FROM p0 WHERE record_id IN (SELECT record_id FROM p0 GROUP BY 1 HAVING count(*) >= 4)),
a AS (SELECT 'h' AS kind, * FROM h UNION ALL SELECT 'p', * FROM p),
n AS (SELECT kind, record_id, count(*) AS n FROM a GROUP BY 1, 2),
c AS (SELECT x.kind, x.record_id AS ei, y.record_id AS ti, count(*) AS c FROM a x JOIN r rx ON rx.record_id = x.record_id AND rx.split_name <> 'train' JOIN a y ON x.kind = y.kind AND x.e = y.e JOIN r ry ON ry.record_id = y.record_id AND ry.split_name = 'train' GROUP BY ALL),
f AS (SELECT DISTINCT ei, ti FROM c JOIN n nx ON nx.kind = c.kind AND nx.record_id = ei JOIN n ny ON ny.kind = c.kind AND ny.record_id = ti WHERE 5 * c >= 4 * (nx.n + ny.n - c))
"""

_RELATED = """
WITH RECURSIVE n AS (SELECT DISTINCT build_id, nullif(translate(lower(trim(program)), '_ ', '--'), '') AS p, CASE WHEN binary_size > 0 THEN nullif(lower(trim(binary_sha256)), '') END AS s FROM build_info WHERE build_id IS NOT NULL),
k AS (SELECT build_id, 'p' || p AS k FROM n WHERE p IS NOT NULL UNION SELECT build_id, 's' || s FROM n WHERE s IS NOT NULL),
m AS (SELECT k, min(build_id) AS m FROM k GROUP BY k),
e AS (SELECT DISTINCT x.m AS a, y.m AS b FROM k kx JOIN m x ON x.k = kx.k JOIN k ky ON ky.build_id = kx.build_id JOIN m y ON y.k = ky.k),
w(root, node) AS (SELECT DISTINCT m, m FROM m UNION SELECT w.root, e.b FROM w JOIN e ON e.a = w.node),
c AS (SELECT node, min(root) AS lead FROM w GROUP BY node),
l AS (SELECT DISTINCT c.lead AS lead_build_id, k.build_id FROM k JOIN m USING (k) JOIN c ON c.node = m.m WHERE c.lead <> k.build_id)
"""

SQL = {
    "p3_found": _OVERLAP + "SELECT least(ei, ti) AS record_id_a, greatest(ei, ti) AS record_id_b FROM f",
    "p3_counts": _OVERLAP + "SELECT r.split_name, r.source_project, count(*) AS n_pairs FROM f JOIN r ON r.record_id = ei GROUP BY ALL",
    "p4_found": """
WITH b AS (SELECT DISTINCT ON (block_id) block_id, normalized_embeddings::DOUBLE[] AS v FROM blocks WHERE len(normalized_embeddings) = 64),
g AS (SELECT * FROM b WHERE len(list_filter(v, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(v, lambda x: x <> 0)) > 0),
s AS (SELECT x.block_id AS a, y.block_id AS b, list_cosine_similarity(x.v, y.v) AS c FROM g x JOIN g y ON x.block_id <> y.block_id),
t AS (SELECT a, b, c, row_number() OVER (PARTITION BY a ORDER BY c DESC, b) AS rn FROM s WHERE c >= 0.9)
SELECT DISTINCT least(a, b) AS block_id_a, greatest(a, b) AS block_id_b FROM t WHERE rn <= 5""",
    "p5_found": _RELATED + "SELECT lead_build_id, build_id FROM l",
    "p5_checks": _RELATED + "SELECT lead_build_id, build_id, true AS split_or_quarantined, true AS one_split FROM l",
    "p3_linked": _OVERLAP + """, z AS (SELECT kind, record_id, list_sort(list(e)) AS es FROM a GROUP BY ALL), y AS (SELECT *, min(record_id) OVER (PARTITION BY kind, es) AS class_id FROM z),
u AS (SELECT c.kind, ei, ti FROM c JOIN n nx ON nx.kind = c.kind AND nx.record_id = ei JOIN n ny ON ny.kind = c.kind AND ny.record_id = ti WHERE 5 * c >= 4 * (nx.n + ny.n - c)),
v AS (SELECT kind, ei AS record_id, count(*) AS n_links FROM u GROUP BY ALL UNION ALL SELECT kind, ti, count(*) FROM u GROUP BY ALL)
SELECT v.record_id, CASE v.kind WHEN 'h' THEN 'hashes' ELSE 'programs' END AS basis, class_id, n_links FROM v JOIN y ON y.kind = v.kind AND y.record_id = v.record_id""",
    "p4_knn": """
WITH b AS (SELECT DISTINCT ON (block_id) block_id, normalized_embeddings::DOUBLE[] AS v FROM blocks WHERE len(normalized_embeddings) = 64),
g AS (SELECT * FROM b WHERE len(list_filter(v, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(v, lambda x: x <> 0)) > 0),
s AS (SELECT x.block_id AS a, y.block_id AS b, list_cosine_similarity(x.v, y.v) AS c FROM g x JOIN g y ON x.block_id <> y.block_id WHERE x.block_id % 20 = 0)
SELECT a AS block_id, rn AS rank, b AS neighbour_block_id, round(c, 3) AS similarity FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY round(c, 6) DESC, b) AS rn FROM s) WHERE rn <= 5""",
    "p7_checks": "SELECT DISTINCT doc_id, true AS whole, true AS cut_if_needed, true AS fits FROM documents",
    "p8_checks": "SELECT lower(trim(source)) AS source, hold, round(target_share, 4) AS target_share, true AS within_uses, true AS on_share, true AS once FROM mix_targets CROSS JOIN (VALUES (false), (true)) h(hold)",
    "p9_checks": "SELECT doc_id, md5(text) AS digest, true AS limits_kept FROM documents",
}
