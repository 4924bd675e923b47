"""Decision, replay, metric, scenario and ground-truth queries over the test tables, with checking SQL."""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions import text as X
from lodestone.operators import decide as D
from lodestone.operators import metrics as K
from lodestone.operators import replay as P
from lodestone.operators import scenario as C
from lodestone.operators import structure as S
from lodestone.operators import truth as T
from lodestone.plans.session import table, written
from lodestone.queries.matching import SQL as MATCHING_SQL

ASM_SQL = MATCHING_SQL["asm_normalize"]
GATE = {"coverage_mean": 0.9, "coverage_ratio": 0.6, "assignment_quality": 0.8, "assignment_ratio": 0.45, "call_edge_ratio": 0.3, "function_concentration": 0.05, "function_spread": 0.05, "function_coverage": 0.3}


def _windows(spark: SparkSession, d: str) -> DataFrame:
    """One window a match; the three metrics the table lacks come from its counts."""
    m = table(spark, d, "block_matches").dropDuplicates(["match_id"])
    return m.withColumns({
        "function_concentration": F.col("windows_evaluated") / F.nullif("windows_total", F.lit(0)),
        "function_spread": F.least(F.lit(1.0), F.col("num_target_blocks") / F.nullif("num_source_blocks", F.lit(0))),
        "function_coverage": F.col("coverage_ratio") * F.col("assignment_ratio"),
    })


def gate_filter(spark: SparkSession, d: str) -> DataFrame:
    return _windows(spark, d).filter(D.passes(GATE)).select("match_id", "build_id", "library", "coverage_mean")


def status_counts(spark: SparkSession, d: str) -> DataFrame:
    w = _windows(spark, d)
    status = D.cu_status(F.col("passed"), F.col("coverage_ratio") < 0.8)
    return w.groupBy("library", status.alias("status")).agg(F.count(F.lit(1)).alias("n"), F.max("coverage_mean").alias("best_any"), F.max(F.when(F.col("passed"), F.col("coverage_mean"))).alias("best_matched"))


def fn_attribution(spark: SparkSession, d: str) -> DataFrame:
    return P.attribution(_windows(spark, d), ["build_id", "library"], GATE)


def top_failures(spark: SparkSession, d: str) -> DataFrame:
    """Twenty examples at most of each category."""
    from pyspark.sql import Window

    a = P.attribution(_windows(spark, d), ["build_id", "library"], GATE)
    n = F.row_number().over(Window.partitionBy("category").orderBy("build_id", "library"))
    return a.withColumn("example", n).filter("example <= 20").select("category", "example", "build_id", "library")


def pareto_windows(spark: SparkSession, d: str) -> DataFrame:
    w = _windows(spark, d).select("library", "match_id", *P.GATES)
    return P.pareto(w, ["library"], P.GATES, "match_id").select("library", "match_id")


def best_match(spark: SparkSession, d: str) -> DataFrame:
    """The best window of each build and library; the earliest match wins ties."""
    key = F.struct(D.passes(GATE), *(F.coalesce(g, F.lit(-1.0)) for g in P.GATES), -F.col("match_id"))
    return _windows(spark, d).groupBy("build_id", "library").agg(F.max_by("match_id", key).alias("match_id"))


def _library_score(mode: str, spark: SparkSession, d: str) -> DataFrame:
    w = _windows(spark, d)
    ok = w.withColumns({"ok": F.col("coverage_mean") >= 0.5, "pen": F.col("cu_status") == "DROP_RODATA"})
    out = D.library_evidence(ok, ["library"], "coverage_mean", "ok", "pen", mode, floor=0.5)
    return out.withColumn("library_score", F.round("library_score", 9))


def _decisions(spark: SparkSession, d: str) -> DataFrame:
    """Each build and library that either side names: predicted by passing matches, expected by the linker."""
    m = table(spark, d, "block_matches").groupBy("build_id", F.trim("library").alias("library")).agg(F.bool_or("passed").alias("predicted"), F.max("score").alias("score"), F.count_if("passed").alias("accepted"))
    t = table(spark, d, "elf_archives").groupBy("build_id", F.trim("archive_basename").alias("library")).agg(F.bool_or("selected_by_linker").alias("expected")).filter("library <> ''")
    return m.join(t, ["build_id", "library"], "full")


def _builds(spark: SparkSession, d: str) -> DataFrame:
    b = T.latest(table(spark, d, "build_info").select("build_id", "program", "compiler", "elf_optimization", "ingested_at"), ["build_id"], ["ingested_at", "program", "compiler", "elf_optimization"])
    compiler = F.translate(F.lower(F.trim(F.substring_index("compiler", "/", -1))), " ", "-")
    return b.select("build_id", F.translate(F.lower(F.trim("program")), "_ ", "--").alias("program"), compiler.alias("compiler"), F.translate(F.lower("elf_optimization"), "-", "").alias("optimization"))


def _judged(spark: SparkSession, d: str) -> DataFrame:
    b = _builds(spark, d).withColumns({c: F.coalesce(c, F.lit("-")) for c in ("program", "compiler", "optimization")})
    return _decisions(spark, d).join(b, "build_id").withColumns({c: F.coalesce(c, F.lit(False)) for c in ("expected", "predicted")})


def confusion_metrics(spark: SparkSession, d: str) -> DataFrame:
    return K.metrics(_judged(spark, d).agg(*K.counts()))


def grouped_metrics(spark: SparkSession, d: str) -> DataFrame:
    return K.grouped(_judged(spark, d), ["compiler", "program", "optimization"])


def metrics_with_all(spark: SparkSession, d: str) -> DataFrame:
    return K.with_all(_judged(spark, d), "compiler", "optimization")


def macro_pooled(spark: SparkSession, d: str) -> DataFrame:
    return K.pooled_and_macro(_judged(spark, d), "compiler")


def program_macro(spark: SparkSession, d: str) -> DataFrame:
    return K.pooled_and_macro(_judged(spark, d), "program").select(*(f"macro_{c}" for c in K.MACRO), "groups")


def cv_summary(spark: SparkSession, d: str) -> DataFrame:
    """Folds as dealt by ``grouped_folds``; cases of an unknown program are in none."""
    dealt = P.grouped_folds(_builds(spark, d).filter("program is not null"), "program", 5).select("program", "fold")
    return K.folds(_judged(spark, d).join(dealt, "program"), F.col("fold"))


def grouped_folds(spark: SparkSession, d: str) -> DataFrame:
    return P.grouped_folds(_builds(spark, d).filter("program is not null"), "program", 5)


def set_classification(spark: SparkSession, d: str) -> DataFrame:
    x = _decisions(spark, d).filter("build_id is not null")
    return K.set_classification(x.filter("predicted"), x.filter("expected"), x, ["library"], "build_id")


def family_collapse(spark: SparkSession, d: str) -> DataFrame:
    x = _decisions(spark, d).withColumn("family", X.pattern_family(F.regexp_replace("library", "(_rt|-core|-io)?\\.a$", ".a")))
    return D.family_rollup(x, ["build_id", "family"], "expected", "predicted")


def family_argmax(spark: SparkSession, d: str) -> DataFrame:
    x = _decisions(spark, d).filter("score is not null").withColumn("family", X.pattern_family(F.regexp_replace("library", "(_rt|-core|-io)?\\.a$", ".a")))
    return D.best_candidate(x, ["build_id", "family"], "score", "accepted", "library")


def pipeline_comparison(spark: SparkSession, d: str) -> DataFrame:
    x = _decisions(spark, d)
    return x.groupBy(D.detection_outcome(F.col("predicted"), F.col("expected")).alias("outcome")).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("build_id").alias("builds"))


def truth_left_join(spark: SparkSession, d: str) -> DataFrame:
    """Every expected library of a build with the matcher's answer, or MISSING."""
    x = _decisions(spark, d).filter("expected")
    return x.select("build_id", "library", F.when(F.col("predicted").isNull(), "MISSING").when(F.col("predicted"), "YES").otherwise("NO").alias("status"))


def _catalog(spark: SparkSession, d: str) -> DataFrame:
    lib = table(spark, d, "library_archives").filter("status = 'selected'").dropDuplicates(["library_id"])
    return lib.select(F.col("library_id").alias("label"), F.trim("archive").alias("family"), "path", "package", F.col("toolchain").alias("compiler"), "optimization", "role")


def _scenario_inputs(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Linked archives with their coordinates, the catalog, and the builds of it that matches accept.

    A match with most blocks covered is taken for every build of its library, a weaker one only for those of its binary's compiler.
    """
    cand = _catalog(spark, d)
    pack = cand.groupBy("family").agg(F.min("package").alias("package"), F.countDistinct("package").alias("n")).filter("n = 1").drop("n")
    refs = table(spark, d, "elf_archives").filter("selected_by_linker").select(F.col("build_id").alias("case"), F.trim("archive_basename").alias("family"), F.trim("archive").alias("path"), "compiler", "optimization", F.col("version_role").alias("role"))
    anchors = C.with_provenance(refs.join(pack, "family"), cand, "path").drop("path", "source").distinct()
    m = table(spark, d, "block_matches").filter("coverage_mean >= 0.7").join(_builds(spark, d).select("build_id", F.col("compiler").alias("own")), "build_id", "left")
    hits = m.select(F.col("build_id").alias("case"), F.trim("library").alias("family"), (F.col("coverage_ratio") >= 0.8).alias("strong"), "own").join(cand.select("label", "family", "compiler"), "family")
    return anchors, cand, hits.filter("strong or own = compiler").select("case", "label").distinct()


def anchor_provenance(spark: SparkSession, d: str) -> DataFrame:
    """What a linked archive's path alone tells of it."""
    refs = table(spark, d, "elf_archives").dropDuplicates(["ref_id"]).select("ref_id", F.trim("archive_basename").alias("family"), F.trim("archive").alias("path"))
    return C.with_provenance(refs, _catalog(spark, d), "path").select("ref_id", "label", "package", "compiler", "optimization", "role", "source")


def scenario_matrix(spark: SparkSession, d: str) -> DataFrame:
    return C.scenario_matrix(C.scenario_outcomes(*_scenario_inputs(spark, d)))


def transitions(spark: SparkSession, d: str) -> DataFrame:
    inputs = [written(x, "scenario") for x in _scenario_inputs(spark, d)]
    parts = [C.transitions(*inputs, k).withColumn("dimension", F.lit(k)) for k in ("compiler", "optimization", "role")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def _members(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "archive_members").dropDuplicates(["member_id"])


def dedup_sha(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "build_info").dropDuplicates(["build_id"]).filter("binary_sha256 is not null").select("build_id", F.lower("binary_sha256").alias("digest"))
    return T.deduplicated(x, "digest", ["build_id"])


def latest_wins(spark: SparkSession, d: str) -> DataFrame:
    return T.latest(table(spark, d, "events").select("user_id", "ts", "event_id", "event_type"), ["user_id"], ["ts", "event_id"])


def occurrence_rank(spark: SparkSession, d: str) -> DataFrame:
    x = _members(spark, d).select("member_id", F.coalesce(F.trim("archive_basename"), F.lit("-")).alias("archive"), "name")
    return T.occurrences(x, ["archive", "name"], ["member_id"]).select("member_id", "occurrence_no")


def round_robin_shard(spark: SparkSession, d: str) -> DataFrame:
    return T.sharded(_builds(spark, d).select("build_id"), ["build_id"], 4)


def expected_matrix_gap(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, "library_archives").withColumn("archive", F.trim("archive"))
    return T.matrix_gap([a.select(c).distinct() for c in ("archive", "toolchain", "optimization")], a.filter("status = 'selected'"))


def truth_summary(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, "elf_archives").dropDuplicates(["ref_id"])
    return r.groupBy(F.trim("archive_basename").alias("library")).agg(F.bool_or(F.col("included_compilation_units") > 0).alias("present"), F.sum("included_compilation_units").alias("included"), F.sum("total_compilation_units").alias("total"), F.concat_ws(",", F.array_sort(F.collect_set("version_role"))).alias("roles"))


def selection_histogram(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, "library_archives").dropDuplicates(["library_id"])
    return a.groupBy("role", "status").agg(F.count(F.lit(1)).alias("builds"), F.sum(F.col("project_candidates").try_cast("bigint")).alias("weight"))


def build_diversity(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, "library_archives").filter("status = 'selected'")
    return a.groupBy(F.trim("archive").alias("archive")).agg(F.countDistinct("role").alias("versions"), F.countDistinct("toolchain").alias("compilers"), F.countDistinct("optimization").alias("optimizations"))


def evaluability(spark: SparkSession, d: str) -> DataFrame:
    m = _members(spark, d).filter("name is not null")
    status = F.when(F.col("n_functions").isNull(), "unknown").when(F.col("n_functions") <= 1, "mono").when(F.col("occurrence") > 1, "ambiguous").otherwise("eligible")
    return T.priority_status(m.withColumn("status", status).withColumn("cu", X.cu_name(F.col("name"))), ["cu"], "status", ["eligible", "ambiguous", "unknown", "mono"])


def source_equivalence(spark: SparkSession, d: str) -> DataFrame:
    """Unit names with the same code, of which the function count is digested, in two archives or more."""
    m = _members(spark, d).filter("name is not null and n_functions is not null").withColumn("cu", X.cu_name(F.col("name")))
    return m.groupBy("cu", F.sha2(F.concat_ws(":", "cu", "n_functions"), 256).alias("digest")).agg(F.countDistinct(F.trim("archive_basename")).alias("archives")).filter("archives >= 2")


def source_differences(spark: SparkSession, d: str) -> DataFrame:
    """Unit names of an archive family that have differing contents, and how many of their members have a digest at all."""
    m = _members(spark, d).filter("name is not null and archive_basename is not null")
    g = m.groupBy(X.archive_family(F.trim("archive_basename")).alias("family"), X.cu_name(F.col("name")).alias("cu"))
    return g.agg(F.countDistinct(F.lower("object_sha256")).alias("digests"), F.count("object_sha256").alias("mapped"), F.count(F.lit(1)).alias("members")).filter("digests >= 2")


def catalog_constraints(spark: SparkSession, d: str) -> DataFrame:
    w = table(spark, d, "block_matches").dropDuplicates(["match_id"])
    checks = {
        "windows_add_up": F.col("windows_evaluated") + F.col("windows_skipped") == F.col("windows_total"),
        "ratio_in_range": F.col("coverage_ratio").between(0.0, 1.0) & F.col("assignment_ratio").between(0.0, 1.0),
        "status_agrees": F.col("passed") == (F.col("cu_status") != "DROP"),
        "score_only_if_passed": F.col("passed") | F.col("score").isNull(),
        "counts_known": F.col("num_source_blocks").isNotNull() & F.col("num_target_blocks").isNotNull(),
    }
    return T.violations(w, checks, "match_id")


def manifest_multiset_diff(spark: SparkSession, d: str) -> DataFrame:
    """Compiler and optimization pairs that the builds and the references count differently."""
    a = table(spark, d, "elf_archives").dropDuplicates(["ref_id"]).select("compiler", "optimization")
    b = table(spark, d, "library_archives").dropDuplicates(["library_id"]).select(F.col("toolchain").alias("compiler"), "optimization")
    return T.multiset_diff(a, b, ["compiler", "optimization"])


def cache_inventory(spark: SparkSession, d: str) -> DataFrame:
    b = table(spark, d, "blocks").dropDuplicates(["block_id"])
    builds, libs = table(spark, d, "build_info").select(F.col("build_id").alias("unit_id"), F.lit("ELF").alias("unit_type")), table(spark, d, "library_archives").select(F.col("library_id").alias("unit_id"), F.lit("CU").alias("unit_type"))
    known = builds.unionByName(libs).distinct()
    have = b.groupBy("unit_type", "unit_id").agg(F.count(F.lit(1)).alias("blocks"), F.sum("raw_size").alias("bytes"))
    j = known.join(have, ["unit_type", "unit_id"], "full").join(known.withColumn("k", F.lit(1)), ["unit_type", "unit_id"], "left")
    return j.groupBy("unit_type").agg(F.count("blocks").alias("units"), F.sum("blocks").alias("blocks"), F.sum("bytes").alias("bytes"), F.count_if(F.col("blocks").isNull()).alias("missing"), F.count_if(F.col("k").isNull()).alias("extra"))


def dimension_lookup(spark: SparkSession, d: str) -> DataFrame:
    """Catalog id of each reference's archive: by exact path, else by a basename the catalog has once."""
    r = table(spark, d, "elf_archives").dropDuplicates(["ref_id"]).select("ref_id", "archive")
    dim = table(spark, d, "library_archives").filter("path is not null").dropDuplicates(["library_id"])
    return T.lookup_dimension(r, F.trim("archive"), dim, "path", "library_id", "library_id").select("ref_id", "library_id")


def prefix_key_join(spark: SparkSession, d: str) -> DataFrame:
    """Catalog archives whose name equals a library or begins with its stem and a dot; an exact name wins."""
    libs = table(spark, d, "block_matches").select(F.regexp_replace(F.trim("library"), "\\.a$", "").alias("key")).distinct()
    arch = table(spark, d, "library_archives").select(F.trim("archive").alias("archive")).distinct()
    return S.prefix_join(libs, arch)


def merge_replaced(spark: SparkSession, d: str) -> DataFrame:
    """Builds' latest records, replaced by their lower-case digests where the program is named."""
    b = table(spark, d, "build_info").dropDuplicates(["build_id"]).select("build_id", "binary_sha256")
    fresh = b.filter("binary_sha256 is not null").select("build_id", F.lower("binary_sha256").alias("binary_sha256"))
    return T.replaced(b, fresh, "build_id")


def label_counts(spark: SparkSession, d: str) -> DataFrame:
    """Positive and negative labels of each split of the builds' programs."""
    x = _judged(spark, d)
    return x.groupBy("optimization").agg(F.count_if("expected").alias("positive"), F.count_if(~F.col("expected")).alias("negative"), F.count(F.lit(1)).alias("total"))


def vocabulary(spark: SparkSession, d: str) -> DataFrame:
    """Words of all texts' distinct instruction lines by falling frequency, then by letter: ids from 5 on."""
    from lodestone.queries.matching import asm_normalize

    lines = asm_normalize(spark, d)
    words = lines.select(F.explode(F.split("v2", " ")).alias("word")).filter("word <> ''").groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    placed = T.sharded(words.withColumn("neg", -F.col("n")), ["neg", "word"], 1)
    return placed.select("word", "n", (F.col("position") + 4).alias("token_id"))


def source_token_hash(spark: SparkSession, d: str) -> DataFrame:
    from lodestone.functions.source_tokens import source_digest

    return table(spark, d, "documents").select("doc_id", source_digest(F.col("text")).alias("digest"))


QUERIES = {
    f.__name__: f
    for f in (
        gate_filter, status_counts, fn_attribution, top_failures, pareto_windows, best_match, confusion_metrics, grouped_metrics, metrics_with_all, macro_pooled, program_macro, cv_summary, grouped_folds, set_classification, family_collapse, family_argmax,
        pipeline_comparison, truth_left_join, scenario_matrix, anchor_provenance, transitions, dedup_sha, latest_wins, occurrence_rank, round_robin_shard, expected_matrix_gap, truth_summary, selection_histogram, build_diversity,
        evaluability, source_equivalence, source_differences, catalog_constraints, manifest_multiset_diff, cache_inventory, dimension_lookup, prefix_key_join, merge_replaced, label_counts, vocabulary, source_token_hash,
    )
} | {f"library_score_{m}": partial(_library_score, m) for m in D.AGGREGATORS}

_W = """WITH m AS (SELECT DISTINCT ON (match_id) * FROM block_matches), w AS (SELECT *, windows_evaluated::DOUBLE / nullif(windows_total, 0) AS function_concentration, least(1.0, num_target_blocks::DOUBLE / nullif(num_source_blocks, 0)) AS function_spread, coverage_ratio * assignment_ratio AS function_coverage FROM m)
"""
_GATES = [f"coalesce({g} >= {v}::DOUBLE, false)" for g, v in GATE.items()]
_PASS = " AND ".join(_GATES)
_DEPTH = " + ".join("(" + " AND ".join(_GATES[: i + 1]) + ")::INT" for i in range(len(_GATES)))
_CATEGORY = "CASE depth " + " ".join(f"WHEN {i} THEN '{g}'" for i, g in enumerate([*GATE, "passed"])) + " END"
_ATTR = _W + f", a AS (SELECT build_id, library, max({_DEPTH}) AS depth, count(*) AS windows FROM w GROUP BY ALL)"
_J = r"""
WITH m AS (SELECT build_id, trim(library) AS library, bool_or(passed) AS predicted, max(score) AS score, count(*) FILTER (passed) AS accepted FROM block_matches GROUP BY ALL),
t AS (SELECT build_id, trim(archive_basename) AS library, bool_or(selected_by_linker) AS expected FROM elf_archives WHERE trim(archive_basename) <> '' GROUP BY ALL),
x AS (SELECT coalesce(m.build_id, t.build_id) AS build_id, coalesce(m.library, t.library) AS library, predicted, score, accepted, expected FROM m FULL JOIN t ON m.build_id = t.build_id AND m.library = t.library),
bb AS (SELECT DISTINCT ON (build_id) * FROM build_info ORDER BY build_id, ingested_at DESC),
b AS (SELECT build_id, translate(lower(trim(program)), '_ ', '--') AS program, replace(lower(trim(regexp_extract(compiler, '[^/]*$'))), ' ', '-') AS compiler, replace(lower(elf_optimization), '-', '') AS optimization FROM bb),
y AS (SELECT x.build_id, x.library, coalesce(expected, false) AS e, coalesce(predicted, false) AS p, coalesce(program, '-') AS program, coalesce(compiler, '-') AS compiler, coalesce(optimization, '-') AS optimization FROM x JOIN b ON b.build_id = x.build_id)
"""
_CNT = "count(*) FILTER (e AND p) AS tp, count(*) FILTER (NOT e AND p) AS fp, count(*) FILTER (e AND NOT p) AS fn, count(*) FILTER (NOT e AND NOT p) AS tn"
_MET = """round(CASE WHEN tp+fp+fn+tn = 0 THEN 0 ELSE (tp+tn) / (tp+fp+fn+tn) END, 6) AS accuracy, round(CASE WHEN tp+fp = 0 THEN 0 ELSE tp / (tp+fp) END, 6) AS "precision", round(CASE WHEN tp+fn = 0 THEN 0 ELSE tp / (tp+fn) END, 6) AS recall,
round(CASE WHEN tn+fp = 0 THEN 0 ELSE tn / (tn+fp) END, 6) AS specificity, round(CASE WHEN 2*tp+fp+fn = 0 THEN 0 ELSE 2*tp / (2*tp+fp+fn) END, 6) AS f1, round((CASE WHEN tp+fn = 0 THEN 0 ELSE tp / (tp+fn) END + CASE WHEN tn+fp = 0 THEN 0 ELSE tn / (tn+fp) END) / 2, 6) AS balanced_accuracy,
round(CASE WHEN (tp+fp)*(tp+fn)*(tn+fp)*(tn+fn) = 0 THEN 0 ELSE (tp::DOUBLE*tn - fp::DOUBLE*fn) / sqrt((tp+fp)::DOUBLE*(tp+fn)*(tn+fp)*(tn+fn)) END, 6) AS mcc, round(CASE WHEN tp+fp+fn+tn = 0 THEN 0 ELSE (tp+fn) / (tp+fp+fn+tn) END, 6) AS prevalence, tp+fp+fn+tn AS evaluated"""
_AVG = ", ".join(f'round(avg("{c}"), 6) AS macro_{c}' for c in K.MACRO)
_FAM = r"CASE WHEN regexp_matches(low, '^lib[^.]+') THEN regexp_extract(low, '^(lib[^.]+)', 1) ELSE low END"
_FAMS = _J + r", f0 AS (SELECT *, lower(regexp_replace(library, '(_rt|-core|-io)?\.a$', '.a')) AS low FROM x), f AS (SELECT *, " + _FAM + " AS family FROM f0)"
_MACRO = _J + ", g AS (SELECT {k}, " + _CNT + " FROM y GROUP BY {k}), h AS (SELECT *, " + _MET + " FROM g)"
_CAT = """
WITH c AS (SELECT DISTINCT ON (library_id) library_id AS label, trim(archive) AS family, path, package, toolchain AS compiler, optimization, role FROM library_archives WHERE status = 'selected'),
xp AS (SELECT path AS xpath, min(ROW(label, package, compiler, optimization, role)) AS r FROM c WHERE path IS NOT NULL GROUP BY path)
"""
_SCEN = _CAT + """, pk AS (SELECT family, min(package) AS package FROM c GROUP BY family HAVING count(DISTINCT package) = 1),
a0 AS (SELECT DISTINCT build_id AS "case", e.family, r[1] AS label, coalesce(r[3], e.compiler) AS compiler, coalesce(r[4], e.optimization) AS optimization, coalesce(r[5], version_role) AS role, coalesce(r[2], pk.package) AS package
  FROM (SELECT *, trim(archive_basename) AS family, trim(archive) AS p FROM elf_archives WHERE selected_by_linker) e JOIN pk ON pk.family = e.family LEFT JOIN xp ON xpath = e.p),
a AS (SELECT * FROM a0 WHERE compiler IS NOT NULL AND optimization IS NOT NULL AND role IS NOT NULL AND package IS NOT NULL),
bb AS (SELECT DISTINCT ON (build_id) * FROM build_info ORDER BY build_id, ingested_at DESC), ob AS (SELECT build_id, replace(lower(trim(regexp_extract(compiler, '[^/]*$'))), ' ', '-') AS own FROM bb),
k AS (SELECT DISTINCT b.build_id AS "case", c.label, c.family FROM block_matches b JOIN c ON c.family = trim(b.library) LEFT JOIN ob ON ob.build_id = b.build_id WHERE b.coverage_mean >= 0.7 AND (b.coverage_ratio >= 0.8 OR ob.own = c.compiler))
"""
_MEM = "WITH m AS (SELECT DISTINCT ON (member_id) * FROM archive_members), n AS (SELECT *, regexp_replace(regexp_replace(regexp_replace(regexp_extract(name, '[^/]*$'), '\\.o$', ''), '\\.c$', ''), '^(libpcre2_8_la-|libpcre2_posix_la-)', '') AS cu FROM m)"


def _score_sql(mode: str) -> str:
    value = "CASE WHEN ok AND NOT pen THEN coverage_mean WHEN ok AND pen THEN 0.0 END" if mode == "top3_mean" else "CASE WHEN ok AND NOT pen THEN coverage_mean END"
    s3 = "list_slice(l, 1, 3)"
    odd = lambda i: f"(CASE WHEN len(l) >= {i} THEN 1 - least(1.0, greatest(0.0, (l[{i}] - 0.5) / 0.5)) ELSE 1 END)"
    out = {"mean": "list_avg(l)", "max": "l[1]", "top3_mean": f"list_sum({s3}) / least(3, len(l))", "top3_noisy_or": f"1 - {odd(1)} * {odd(2)} * {odd(3)}"}[mode]
    return _W + f""", v AS (SELECT *, coverage_mean >= 0.5 AS ok, cu_status = 'DROP_RODATA' AS pen FROM w), g AS (SELECT library, count(*) FILTER (ok AND NOT pen) AS accepted, count(*) FILTER (ok AND pen) AS penalised, list_reverse_sort(list({value}) FILTER (({value}) IS NOT NULL)) AS l FROM v GROUP BY library)
SELECT library, accepted, penalised, round(CASE WHEN coalesce(len(l), 0) = 0 THEN 0 ELSE {out} END, 9) AS library_score FROM g"""


SQL = {
    "vocabulary": "WITH x AS (" + ASM_SQL + "), w AS (SELECT unnest(string_split(v2, ' ')) AS word FROM x), g AS (SELECT word, count(*) AS n FROM w WHERE word <> '' GROUP BY word) SELECT word, n, row_number() OVER (ORDER BY n DESC, word) + 4 AS token_id FROM g",
    "gate_filter": _W + f"SELECT match_id, build_id, library, coverage_mean FROM w WHERE {_PASS}",
    "status_counts": _W + "SELECT library, CASE WHEN NOT coalesce(passed, false) THEN 'DROP' WHEN coverage_ratio < 0.8 THEN 'DROP_RODATA' ELSE 'PASS' END AS status, count(*) AS n, max(coverage_mean) AS best_any, max(coverage_mean) FILTER (passed) AS best_matched FROM w GROUP BY ALL",
    "fn_attribution": _ATTR + f" SELECT build_id, library, depth, windows, {_CATEGORY} AS category FROM a",
    "top_failures": _ATTR + f" SELECT category, example, build_id, library FROM (SELECT *, row_number() OVER (PARTITION BY category ORDER BY build_id, library) AS example FROM (SELECT *, {_CATEGORY} AS category FROM a)) WHERE example <= 20",
    "pareto_windows": _W + ", f AS (SELECT * FROM w WHERE " + " AND ".join(f"isfinite({g})" for g in GATE) + ") SELECT library, match_id FROM f x WHERE NOT EXISTS (SELECT 1 FROM f y WHERE y.library = x.library AND y.match_id <> x.match_id AND " + " AND ".join(f"y.{g} >= x.{g}" for g in GATE) + " AND (" + " OR ".join(f"y.{g} > x.{g}" for g in GATE) + " OR y.match_id < x.match_id))",
    "best_match": _W + f"SELECT build_id, library, match_id FROM (SELECT *, row_number() OVER (PARTITION BY build_id, library ORDER BY ({_PASS}) DESC, " + ", ".join(f"coalesce({g}, -1) DESC" for g in P.GATES) + ", match_id) AS n FROM w) WHERE n = 1",
    "confusion_metrics": _J + f", g AS (SELECT {_CNT} FROM y) SELECT *, {_MET} FROM g",
    "grouped_metrics": _J + f", g AS (SELECT CASE WHEN grouping(compiler) = 0 THEN 'compiler' WHEN grouping(program) = 0 THEN 'program' WHEN grouping(optimization) = 0 THEN 'optimization' ELSE 'ALL' END AS scope, coalesce(compiler, program, optimization, 'ALL') AS value, {_CNT} FROM y GROUP BY GROUPING SETS ((), (compiler), (program), (optimization))) SELECT *, {_MET} FROM g",
    "metrics_with_all": _J + f", g AS (SELECT compiler, CASE WHEN grouping(optimization) = 1 THEN 'ALL' ELSE optimization END AS optimization, {_CNT} FROM y GROUP BY GROUPING SETS ((compiler, optimization), (compiler))) SELECT *, {_MET} FROM g",
    "macro_pooled": _MACRO.format(k="compiler") + f', i AS (SELECT sum(tp)::BIGINT AS tp, sum(fp)::BIGINT AS fp, sum(fn)::BIGINT AS fn, sum(tn)::BIGINT AS tn, {_AVG}, count(*) AS groups FROM h) SELECT *, {_MET} FROM i',
    "program_macro": _MACRO.format(k="program") + f" SELECT {_AVG}, count(*) AS groups FROM h",
    "cv_summary": _J + f", sz AS (SELECT program, count(*) AS cases FROM b WHERE program IS NOT NULL GROUP BY program), rk AS (SELECT *, row_number() OVER (ORDER BY cases DESC, sha256('fold:' || program)) - 1 AS r FROM sz), fo AS (SELECT program, CASE WHEN (r // 5) % 2 = 0 THEN r % 5 ELSE 4 - r % 5 END AS fold FROM rk), g AS (SELECT fold, {_CNT} FROM y JOIN fo USING (program) GROUP BY 1), h AS (SELECT *, {_MET} FROM g) SELECT round(avg(f1), 6) AS mean_f1, round(stddev_pop(f1), 6) AS std_f1, count(*) AS folds, round(2 * sum(tp) / (2 * sum(tp) + sum(fp) + sum(fn)), 6) AS pooled_f1 FROM h",
    "grouped_folds": _J + ", s AS (SELECT program, count(*) AS cases FROM b WHERE program IS NOT NULL GROUP BY program), r AS (SELECT *, row_number() OVER (ORDER BY cases DESC, sha256('fold:' || program)) - 1 AS r FROM s) SELECT program, cases, CASE WHEN (r // 5) % 2 = 0 THEN r % 5 ELSE 4 - r % 5 END AS fold FROM r",
    "set_classification": _J + """, g AS (SELECT build_id, count(*) FILTER (coalesce(expected, false) AND coalesce(predicted, false)) AS tp, count(*) FILTER (NOT coalesce(expected, false) AND coalesce(predicted, false)) AS fp, count(*) FILTER (coalesce(expected, false) AND NOT coalesce(predicted, false)) AS fn, count(*) FILTER (NOT coalesce(expected, false) AND NOT coalesce(predicted, false)) AS tn FROM x WHERE build_id IS NOT NULL AND library IS NOT NULL GROUP BY build_id)
SELECT build_id, tp, fp, fn, tn, round(CASE WHEN tp+fp = 0 THEN 0 ELSE tp / (tp+fp) END, 6) AS "precision", round(CASE WHEN tp+fn = 0 THEN 0 ELSE tp / (tp+fn) END, 6) AS recall, round(CASE WHEN 2*tp+fp+fn = 0 THEN 0 ELSE 2*tp / (2*tp+fp+fn) END, 6) AS f1 FROM g""",
    "family_collapse": _FAMS + " SELECT build_id, family, coalesce(bool_or(expected), false) AS expected, coalesce(bool_or(predicted), false) AS predicted, count(*) AS builds FROM f GROUP BY ALL",
    "family_argmax": _FAMS + ", g AS (SELECT build_id, family, max(ROW(score, accepted, library)) AS r FROM f WHERE score IS NOT NULL GROUP BY ALL) SELECT build_id, family, r[1] AS score, r[2] AS accepted, r[3] AS library FROM g",
    "pipeline_comparison": _J + "SELECT CASE WHEN predicted IS NULL AND expected IS NULL THEN 'missing_both' WHEN predicted IS NULL THEN 'missing_first' WHEN expected IS NULL THEN 'missing_second' WHEN predicted AND expected THEN 'both' WHEN predicted THEN 'first_only' WHEN expected THEN 'second_only' ELSE 'neither' END AS outcome, count(*) AS n, count(DISTINCT build_id) AS builds FROM x GROUP BY 1",
    "truth_left_join": _J + "SELECT build_id, library, CASE WHEN predicted IS NULL THEN 'MISSING' WHEN predicted THEN 'YES' ELSE 'NO' END AS status FROM x WHERE expected",
    "scenario_matrix": _SCEN + """, s AS (SELECT * FROM (VALUES ('same_exact_artifact', -1), ('same_build_configuration', 0), ('cross_optimization_any', 1), ('cross_compiler_any', 2), ('cross_version_any', 3)) v(scenario, i)),
o AS (SELECT DISTINCT a."case", a.family, s.scenario, c.label FROM a JOIN c ON c.family = a.family AND c.package = a.package JOIN s ON CASE WHEN s.i = -1 THEN c.label = a.label ELSE (c.optimization = a.optimization) = (s.i <> 1) AND (c.compiler = a.compiler) = (s.i <> 2) AND (c.role = a.role) = (s.i <> 3) END),
h AS (SELECT o.scenario, o."case", o.family, bool_or(k.label IS NOT NULL) AS hit FROM o LEFT JOIN k ON k."case" = o."case" AND k.label = o.label GROUP BY ALL),
q AS (SELECT g."case", g.family, s.scenario, h.hit, EXISTS (SELECT 1 FROM k WHERE k."case" = g."case" AND k.family = g.family) AS anyw FROM (SELECT DISTINCT "case", family FROM a) g CROSS JOIN s LEFT JOIN h ON h.scenario = s.scenario AND h."case" = g."case" AND h.family = g.family),
r AS (SELECT scenario, count(*) FILTER (hit) AS tp, count(*) FILTER (NOT coalesce(hit, false)) AS fn, count(*) FILTER (hit IS NULL) AS unavailable, count(*) FILTER (NOT hit AND anyw) AS off_scenario_only, count(*) FILTER (NOT hit AND NOT anyw) AS undetected FROM q GROUP BY scenario)
SELECT *, round(CASE WHEN tp + fn = 0 THEN 0 ELSE tp / (tp + fn) END, 6) AS recall, round(CASE WHEN tp + fn - unavailable = 0 THEN 0 ELSE tp / (tp + fn - unavailable) END, 6) AS recall_available FROM r""",
    "anchor_provenance": _CAT + """, s AS (SELECT family, compiler, optimization, CASE WHEN count(DISTINCT package) = 1 THEN min(package) END AS package, CASE WHEN count(DISTINCT role) = 1 THEN min(role) END AS role FROM c GROUP BY ALL), kn AS (SELECT DISTINCT compiler, optimization FROM c),
e AS (SELECT DISTINCT ON (ref_id) ref_id, trim(archive_basename) AS family, trim(archive) AS p FROM elf_archives), f AS (SELECT *, string_split(p, '/') AS x FROM e),
g AS (SELECT f.*, CASE WHEN len(x) >= 3 THEN nullif(x[len(x) - 2], '') END AS pc, CASE WHEN len(x) >= 3 THEN nullif(x[len(x) - 1], '') END AS po FROM f)
SELECT ref_id, r[1] AS label, coalesce(r[2], CASE WHEN kn.compiler IS NOT NULL THEN s.package END) AS package, coalesce(r[3], kn.compiler) AS compiler, coalesce(r[4], kn.optimization) AS optimization, coalesce(r[5], CASE WHEN kn.compiler IS NOT NULL THEN s.role END) AS role,
CASE WHEN r IS NOT NULL THEN 'exact_path' WHEN kn.compiler IS NOT NULL THEN 'path_parts' ELSE 'unresolved' END AS source FROM g LEFT JOIN xp ON xpath = p LEFT JOIN kn ON kn.compiler = pc AND kn.optimization = po LEFT JOIN s ON s.family = g.family AND s.compiler = pc AND s.optimization = po""",
    "transitions": _SCEN + ", " + ", ".join(f"""p{i} AS (SELECT DISTINCT a."case", a.family, a.{k} AS source_value, c.{k} AS target_value, c.label FROM a JOIN c ON c.family = a.family AND c.package = a.package AND c.{x} = a.{x} AND c.{y} = a.{y}),
h{i} AS (SELECT p{i}."case", p{i}.family, source_value, target_value, bool_or(k.label IS NOT NULL) AS hit FROM p{i} LEFT JOIN k ON k."case" = p{i}."case" AND k.label = p{i}.label GROUP BY ALL)""" for i, (k, x, y) in enumerate((("compiler", "optimization", "role"), ("optimization", "compiler", "role"), ("role", "compiler", "optimization"))))
    + " UNION ALL ".join(f" SELECT source_value, target_value, count(*) AS positives, count(*) FILTER (hit) AS detected, '{k}' AS dimension FROM h{i} GROUP BY ALL" for i, k in enumerate(("compiler", "optimization", "role"))),
    "dedup_sha": "WITH b AS (SELECT DISTINCT ON (build_id) build_id, lower(binary_sha256) AS digest FROM build_info WHERE binary_sha256 IS NOT NULL), r AS (SELECT *, count(*) OVER (PARTITION BY digest) AS copies, row_number() OVER (PARTITION BY digest ORDER BY build_id) - 1 AS i FROM b) SELECT build_id, digest, copies FROM r WHERE i = ('0x' || substr(digest, 1, 16))::UBIGINT % copies",
    "latest_wins": "SELECT user_id, ts, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n = 1",
    "occurrence_rank": "WITH m AS (SELECT DISTINCT ON (member_id) * FROM archive_members) SELECT member_id, row_number() OVER (PARTITION BY coalesce(trim(archive_basename), '-'), name ORDER BY member_id) AS occurrence_no FROM m",
    "round_robin_shard": "WITH b AS (SELECT DISTINCT build_id FROM build_info) SELECT build_id, row_number() OVER (ORDER BY build_id) AS position, (row_number() OVER (ORDER BY build_id) - 1) % 4 AS shard FROM b",
    "expected_matrix_gap": "WITH a AS (SELECT trim(archive) AS archive, toolchain, optimization, status FROM library_archives) SELECT x.archive, y.toolchain, z.optimization FROM (SELECT DISTINCT archive FROM a) x CROSS JOIN (SELECT DISTINCT toolchain FROM a) y CROSS JOIN (SELECT DISTINCT optimization FROM a) z WHERE NOT EXISTS (SELECT 1 FROM a WHERE a.archive = x.archive AND a.toolchain = y.toolchain AND a.optimization = z.optimization AND status = 'selected')",
    "truth_summary": "WITH r AS (SELECT DISTINCT ON (ref_id) * FROM elf_archives) SELECT trim(archive_basename) AS library, bool_or(included_compilation_units > 0) AS present, sum(included_compilation_units)::BIGINT AS included, sum(total_compilation_units)::BIGINT AS total, coalesce(array_to_string(list_sort(list(DISTINCT version_role) FILTER (version_role IS NOT NULL)), ','), '') AS roles FROM r GROUP BY 1",
    "selection_histogram": "WITH a AS (SELECT DISTINCT ON (library_id) * FROM library_archives) SELECT role, status, count(*) AS builds, sum(try_cast(project_candidates AS BIGINT))::BIGINT AS weight FROM a GROUP BY ALL",
    "build_diversity": "SELECT trim(archive) AS archive, count(DISTINCT role) AS versions, count(DISTINCT toolchain) AS compilers, count(DISTINCT optimization) AS optimizations FROM library_archives WHERE status = 'selected' GROUP BY 1",
    "evaluability": _MEM + ", s AS (SELECT cu, CASE WHEN n_functions IS NULL THEN 2 WHEN n_functions <= 1 THEN 3 WHEN occurrence > 1 THEN 1 ELSE 0 END AS r FROM n WHERE name IS NOT NULL) SELECT cu, ['eligible', 'ambiguous', 'unknown', 'mono'][min(r) + 1] AS status, count(*) AS n_rows FROM s GROUP BY cu",
    "source_equivalence": _MEM + " SELECT cu, sha256(cu || ':' || n_functions) AS digest, count(DISTINCT trim(archive_basename)) AS archives FROM n WHERE name IS NOT NULL AND n_functions IS NOT NULL GROUP BY ALL HAVING count(DISTINCT trim(archive_basename)) >= 2",
    "source_differences": _MEM + r", f AS (SELECT *, lower(regexp_extract(trim(archive_basename), '[^/]*$')) AS low FROM n WHERE name IS NOT NULL AND archive_basename IS NOT NULL) SELECT regexp_replace(CASE WHEN contains(low, '.a.') THEN split_part(low, '.a.', 1) || '.a' ELSE low END, '\.a$', '') AS family, cu, count(DISTINCT lower(object_sha256)) AS digests, count(object_sha256) AS mapped, count(*) AS members FROM f GROUP BY ALL HAVING count(DISTINCT lower(object_sha256)) >= 2",
    "catalog_constraints": """WITH m AS (SELECT DISTINCT ON (match_id) * FROM block_matches), c AS (SELECT match_id, unnest(['windows_add_up', 'ratio_in_range', 'status_agrees', 'score_only_if_passed', 'counts_known']) AS check_name,
unnest([windows_evaluated + windows_skipped = windows_total, coverage_ratio BETWEEN 0 AND 1 AND assignment_ratio BETWEEN 0 AND 1, passed = (cu_status <> 'DROP'), passed OR score IS NULL, num_source_blocks IS NOT NULL AND num_target_blocks IS NOT NULL]) AS good FROM m)
SELECT check_name, count(*) FILTER (NOT coalesce(good, false)) AS n_violations, min(match_id) FILTER (NOT coalesce(good, false)) AS first_key FROM c GROUP BY check_name""",
    "manifest_multiset_diff": "WITH u AS (SELECT compiler, optimization, 1 AS l, 0 AS r FROM (SELECT DISTINCT ON (ref_id) * FROM elf_archives) UNION ALL SELECT toolchain, optimization, 0, 1 FROM (SELECT DISTINCT ON (library_id) * FROM library_archives)) SELECT compiler, optimization, sum(l)::BIGINT AS n_left, sum(r)::BIGINT AS n_right FROM u GROUP BY ALL HAVING sum(l) <> sum(r)",
    "cache_inventory": """WITH b AS (SELECT DISTINCT ON (block_id) * FROM blocks), k AS (SELECT DISTINCT 'ELF' AS unit_type, build_id AS unit_id FROM build_info UNION SELECT 'CU', library_id FROM library_archives), h AS (SELECT unit_type, unit_id, count(*) AS n, sum(raw_size) AS s FROM b GROUP BY ALL)
SELECT coalesce(h.unit_type, k.unit_type) AS unit_type, count(h.n) AS units, sum(h.n)::BIGINT AS blocks, sum(h.s)::BIGINT AS bytes, count(*) FILTER (h.n IS NULL) AS missing, count(*) FILTER (k.unit_id IS NULL) AS extra FROM k FULL JOIN h ON h.unit_type = k.unit_type AND h.unit_id = k.unit_id GROUP BY 1""",
    "dimension_lookup": "WITH r AS (SELECT DISTINCT ON (ref_id) ref_id, trim(archive) AS p FROM elf_archives), d AS (SELECT DISTINCT ON (library_id) library_id, path FROM library_archives WHERE path IS NOT NULL), e AS (SELECT path, min(library_id) AS i FROM d GROUP BY path), b AS (SELECT regexp_extract(path, '[^/]*$') AS b, min(library_id) AS i FROM d GROUP BY 1 HAVING count(*) = 1) SELECT ref_id, coalesce(e.i, b.i) AS library_id FROM r LEFT JOIN e ON e.path = r.p LEFT JOIN b ON b.b = regexp_extract(r.p, '[^/]*$')",
    "prefix_key_join": r"WITH l AS (SELECT DISTINCT regexp_replace(trim(library), '\.a$', '') AS key FROM block_matches), a AS (SELECT DISTINCT trim(archive) AS archive FROM library_archives), j AS (SELECT key, archive, archive = key AS exact FROM l JOIN a ON archive = key OR starts_with(archive, key || '.')) SELECT key, archive FROM j WHERE exact OR key NOT IN (SELECT key FROM j WHERE exact)",
    "merge_replaced": "SELECT DISTINCT ON (build_id) build_id, lower(binary_sha256) AS binary_sha256 FROM build_info",
    "label_counts": _J + "SELECT optimization, count(*) FILTER (e) AS positive, count(*) FILTER (NOT e) AS negative, count(*) AS total FROM y GROUP BY optimization",
} | {f"library_score_{m}": _score_sql(m) for m in D.AGGREGATORS}
