"""Catalog, coordinate and check queries over the test tables, with checking SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions import text as X
from lodestone.operators import coordinates as O
from lodestone.operators import decide as D
from lodestone.operators import metrics as K
from lodestone.operators import replay as P
from lodestone.operators import similarity as M
from lodestone.operators import structure as S
from lodestone.operators import truth as T
from lodestone.plans.session import table, written
from lodestone.plans.skew import bounded
from lodestone.queries import decisions as Q
from lodestone.queries import matching as G


def function_hint(spark: SparkSession, d: str) -> DataFrame:
    m = M.function_mapping(M.block_best(*G._units(spark, d)), 0.32).withColumns({c: F.round(c, 6) for c in ("dominant_ratio", "coverage_mean", "coverage_ratio")})
    return D.best_function_hint(m, ["cu"])


def anchored_evidence(spark: SparkSession, d: str) -> DataFrame:
    """Cross-unit calls of which one end at least is accepted."""
    cu, mapping, elf = G._calls(spark, d)
    accepted = table(spark, d, "lineitem").filter("l_linestatus = 'O' and l_discount > 0.09").select(F.col("l_suppkey").alias("library"), (F.col("l_partkey") % 5).alias("cu"))
    ev = S.cross_unit_evidence(cu.filter("caller_cu <> callee_cu"), accepted, mapping, elf, "library", both=False)
    return ev.select("library", "edges_expected", "edges_evaluable", "edges_matched")


def missing_reasons(spark: SparkSession, d: str) -> DataFrame:
    """Cells of the library matrix without an archive, by reason."""
    a = table(spark, d, "library_archives").withColumn("archive", F.trim("archive"))
    gaps = T.matrix_gap([a.select("archive", "package").distinct(), a.select("toolchain").distinct(), a.select("optimization").distinct()], a.filter("status = 'selected'"))
    built = a.filter("status = 'selected'").select("package", "toolchain", "optimization").distinct().withColumn("built", F.lit(True))
    j = gaps.join(built, ["package", "toolchain", "optimization"], "left")
    return j.groupBy(O.missing_reason(F.col("package"), F.col("toolchain"), F.col("optimization"), F.col("built")).alias("reason")).agg(F.count(F.lit(1)).alias("cells"))


def archive_choice(spark: SparkSession, d: str) -> DataFrame:
    """Of each program the smallest binary that is not empty, then the first variant."""
    b = table(spark, d, "build_info").filter("binary_size > 0").dropDuplicates(["build_id"]).join(Q._builds(spark, d).select("build_id", F.col("program").alias("name")), "build_id")
    return O.chosen(b.filter("name is not null").select("name", "binary_size", F.coalesce("variant", F.lit("")).alias("variant"), "build_id"), ["name"], ["binary_size", "variant", "build_id"])


def coordinates_of_all(spark: SparkSession, d: str) -> DataFrame:
    """Versions and optimizations that every toolchain has."""
    a = table(spark, d, "library_archives").filter("status = 'selected'").withColumn("archive", F.trim("archive"))
    return O.held_by_all(a, ["role", "optimization"], "toolchain")


def profile_overlap(spark: SparkSession, d: str) -> DataFrame:
    """Digests that more than one profile has."""
    h = table(spark, d, "profile_records").select("profile", F.explode("hashes").alias("h")).select("profile", F.lower(F.regexp_extract("h", "([0-9A-Fa-f]{64})", 1)).alias("digest")).filter("digest <> ''")
    return h.groupBy("digest").agg(F.countDistinct("profile").alias("profiles"), F.count(F.lit(1)).alias("n")).filter("profiles > 1")


def manifest_summary(spark: SparkSession, d: str) -> DataFrame:
    b = table(spark, d, "build_info").dropDuplicates(["build_id"])
    return b.agg(F.count(F.lit(1)).alias("builds"), F.countDistinct(F.translate(F.lower(F.trim("program")), "_ ", "--")).alias("programs"), F.countDistinct(F.lower("binary_sha256")).alias("hashes"), F.countDistinct("variant").alias("variants"), F.sum("binary_size").alias("bytes"))


def manifest_field_diff(spark: SparkSession, d: str) -> DataFrame:
    """Fields in which a reference's toolchain or optimization differs from its build's."""
    r = table(spark, d, "elf_archives").dropDuplicates(["ref_id"])
    b = Q._builds(spark, d).select("build_id", "compiler", F.concat(F.upper(F.substring("optimization", 1, 1)), F.substring("optimization", 2, 9)).alias("optimization"))
    own = r.select("ref_id", "build_id").join(b, "build_id")
    return O.field_diff(r.select("ref_id", "compiler", "optimization"), own, "ref_id", ["compiler", "optimization"])


def member_excess(spark: SparkSession, d: str) -> DataFrame:
    """Units matched in a library more often than its archive has members of that name."""
    used = table(spark, d, "block_matches").dropDuplicates(["match_id"]).select(F.trim("library").alias("archive"), F.col("cu_name").alias("name"))
    stock = table(spark, d, "archive_members").dropDuplicates(["member_id"]).select(F.trim("archive_basename").alias("archive"), "name")
    return O.exceeds(used, stock, ["archive", "name"])


def index_gaps(spark: SparkSession, d: str) -> DataFrame:
    return O.index_gaps(table(spark, d, "blocks"), ["unit_type", "unit_id"], "block_index")


def member_expansion(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "profile_records").dropDuplicates(["record_id"]).select("record_id", F.transform("programs", lambda x: F.lower(F.trim(x))).alias("names"))
    return O.expanded(p, ["record_id"], "names")


def profile_checks(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "profile_records").dropDuplicates(["record_id"])
    checks = {
        "split_known": F.col("split_name").isin("train", "validation", "test"),
        "has_hashes": F.size("hashes") > 0,
        "hashes_distinct": F.size("hashes") == F.size(F.array_distinct("hashes")),
        "hashes_well_formed": F.forall("hashes", lambda h: X.valid_sha256(h)),
        "collected_first": F.col("collected_at") <= F.col("ingested_at"),
    }
    return T.violations(p, checks, "record_id")


def word_ids(spark: SparkSession, d: str) -> DataFrame:
    """Types and levels of all builds as ids of a vocabulary by falling frequency."""
    b = Q._builds(spark, d)
    words = F.array(F.coalesce("compiler", F.lit("?")), F.coalesce("optimization", F.lit("?")), F.coalesce("program", F.lit("?")))
    n = b.select(F.explode(words).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n")).filter("n >= 5").withColumn("neg", -F.col("n"))
    vocab = T.sharded(n, ["neg", "word"], 1).select("word", (F.col("position") + 4).alias("token_id"))
    e = O.encode_words(b.withColumn("w", words), "build_id", F.col("w"), vocab, length=4)
    return e.select("build_id", F.concat_ws(" ", F.col("ids").cast("array<string>")).alias("ids"))


def replay_grid(spark: SparkSession, d: str) -> DataFrame:
    """The family decision's f1 for each of 25 pairs of gates, in one pass over the windows."""
    base = spark.range(0, 1, 1, 1).select(*(F.lit(0.0).alias(f"min_{g}") for g in P.GATES if g not in ("coverage_mean", "assignment_ratio")))
    cfg = O.grid(base, {"min_coverage_mean": [0.5, 0.7, 0.9, 0.95, 0.98], "min_assignment_ratio": [0.0, 0.4, 0.5, 0.6, 0.8]})
    cfg = cfg.withColumn("config", F.concat_ws("/", "min_coverage_mean", "min_assignment_ratio"))
    per = P.replay(Q._windows(spark, d), cfg, ["build_id", "library"], 25)
    t = table(spark, d, "elf_archives").groupBy("build_id", F.trim("archive_basename").alias("library")).agg(F.bool_or("selected_by_linker").alias("expected"))
    j = per.join(t, ["build_id", "library"], "left").withColumn("predicted", F.col("passing") > 0)
    return K.f1_metrics(j.groupBy("config").agg(*K.counts())).select("config", "tp", "fp", "fn", "f1")


def cross_build_availability(spark: SparkSession, d: str) -> DataFrame:
    """Of each build's linked archives: is the build asked for in the catalog, as built and with each other compiler, optimization or role?"""
    anchors, cand, accepted = (written(x, "scenario") for x in Q._scenario_inputs(spark, d))
    keys, parts = ["family", "package", "compiler", "optimization", "role"], []
    for dim in ("compiler", "optimization", "role"):
        values = cand.select(F.col(dim).alias("wanted")).distinct()
        ask = anchors.dropna(subset=keys).select("case", *keys).distinct().crossJoin(bounded(values))
        have = cand.select("label", *(k for k in keys if k != dim), F.col(dim).alias("wanted"))
        j = ask.join(have, [*(k for k in keys if k != dim), "wanted"], "left").join(accepted.withColumn("got", F.lit(1)), ["case", "label"], "left")
        per = j.groupBy("case", *keys, "wanted").agg(F.max(F.col("label").isNotNull().cast("int")).alias("available"), F.max(F.coalesce("got", F.lit(0))).alias("detected"))
        parts.append(per.groupBy(F.concat(F.lit(f"{dim}_to_"), "wanted").alias("scenario")).agg(F.count(F.lit(1)).alias("asked"), F.sum("available").alias("available"), F.sum("detected").alias("detected")))
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def reclassified(spark: SparkSession, d: str) -> DataFrame:
    """Detection counts by whether a library has only one-function members."""
    mono = table(spark, d, "archive_members").groupBy(F.trim("archive_basename").alias("library")).agg(F.max("n_functions").alias("most"))
    x = Q._decisions(spark, d).join(mono, "library", "left")
    status = F.when(F.col("most").isNull(), "unknown").when(F.col("most") <= 1, "mono").otherwise("eligible")
    return x.groupBy(status.alias("status")).agg(*K.counts()).select("status", "tp", "fp", "fn")


QUERIES = {
    f.__name__: f
    for f in (
        function_hint, anchored_evidence, missing_reasons, archive_choice, coordinates_of_all, profile_overlap, manifest_summary, manifest_field_diff, member_excess, index_gaps, member_expansion, profile_checks, word_ids, replay_grid,
        cross_build_availability, reclassified,
    )
}

_GRID = ", ".join(f"({c}, {a})" for c in (0.5, 0.7, 0.9, 0.95, 0.98) for a in (0.0, 0.4, 0.5, 0.6, 0.8))
SQL = {
    "function_hint": G.SQL["function_mapping"].replace("SELECT w.cu::VARCHAR", ", hint AS (SELECT w.cu::VARCHAR") + ") SELECT * EXCLUDE (n) FROM (SELECT *, row_number() OVER (PARTITION BY cu ORDER BY dominant_ratio DESC, coverage_mean DESC, coverage_ratio DESC, cu_function, elf_function) AS n FROM hint) WHERE n = 1",
    "anchored_evidence": G._CALLS + """, ac AS (SELECT DISTINCT l_suppkey AS library, l_partkey % 5 AS cu FROM lineitem WHERE l_linestatus = 'O' AND l_discount > 0.09),
j AS (SELECT cu.library, p.e AS pe, q.e AS qe, ee.x FROM cu LEFT JOIN mp p ON p.library = cu.library AND p.cu = cu.a AND p.f = cu.af LEFT JOIN mp q ON q.library = cu.library AND q.cu = cu.b AND q.f = cu.bf LEFT JOIN ee ON ee.x = p.e AND ee.y = q.e
  WHERE cu.a <> cu.b AND (EXISTS (SELECT 1 FROM ac WHERE ac.library = cu.library AND ac.cu = cu.a) OR EXISTS (SELECT 1 FROM ac WHERE ac.library = cu.library AND ac.cu = cu.b)))
SELECT library, count(*) AS edges_expected, count(*) FILTER (pe IS NOT NULL AND qe IS NOT NULL) AS edges_evaluable, count(x) AS edges_matched FROM j GROUP BY library""",
    "missing_reasons": """WITH a AS (SELECT trim(archive) AS archive, package, toolchain, optimization, status FROM library_archives), g AS (SELECT * FROM (SELECT DISTINCT archive, package FROM a) CROSS JOIN (SELECT DISTINCT toolchain FROM a) CROSS JOIN (SELECT DISTINCT optimization FROM a)),
m AS (SELECT * FROM g WHERE NOT EXISTS (SELECT 1 FROM a WHERE a.status = 'selected' AND a.archive = g.archive AND a.package = g.package AND a.toolchain = g.toolchain AND a.optimization = g.optimization))
SELECT CASE WHEN package = 'glibc' AND starts_with(toolchain, 'clang-') THEN 'unsupported_compiler' WHEN package = 'glibc' AND optimization = 'O0' THEN 'unsupported_optimization' WHEN NOT EXISTS (SELECT 1 FROM a WHERE a.status = 'selected' AND a.package = m.package AND a.toolchain = m.toolchain AND a.optimization = m.optimization) THEN 'variant_not_built_or_unsupported' ELSE 'archive_not_produced_by_version' END AS reason, count(*) AS cells FROM m GROUP BY 1""",
    "archive_choice": Q._J + ", s AS (SELECT DISTINCT ON (build_id) build_id, binary_size, coalesce(variant, '') AS variant FROM build_info WHERE binary_size > 0), r AS (SELECT b.program AS name, s.*, row_number() OVER (PARTITION BY b.program ORDER BY binary_size, variant, s.build_id) AS n FROM s JOIN b ON b.build_id = s.build_id WHERE b.program IS NOT NULL) SELECT name, binary_size, variant, build_id FROM r WHERE n = 1",
    "coordinates_of_all": "WITH a AS (SELECT * FROM library_archives WHERE status = 'selected') SELECT role, optimization FROM a GROUP BY ALL HAVING count(DISTINCT toolchain) = (SELECT count(DISTINCT toolchain) FROM a)",
    "profile_overlap": "SELECT lower(regexp_extract(h, '[0-9A-Fa-f]{64}')) AS digest, count(DISTINCT profile) AS profiles, count(*) AS n FROM (SELECT profile, unnest(hashes) AS h FROM profile_records) WHERE regexp_matches(h, '[0-9A-Fa-f]{64}') GROUP BY 1 HAVING count(DISTINCT profile) > 1",
    "manifest_summary": "SELECT count(*) AS builds, count(DISTINCT translate(lower(trim(program)), '_ ', '--')) AS programs, count(DISTINCT lower(binary_sha256)) AS hashes, count(DISTINCT variant) AS variants, sum(binary_size)::BIGINT AS bytes FROM (SELECT DISTINCT ON (build_id) * FROM build_info)",
    "manifest_field_diff": Q._J + """, r AS (SELECT DISTINCT ON (ref_id) ref_id, build_id, compiler, optimization FROM elf_archives), o AS (SELECT r.ref_id, b.compiler, upper(substr(b.optimization, 1, 1)) || substr(b.optimization, 2) AS optimization FROM r JOIN b ON b.build_id = r.build_id)
SELECT r.ref_id, 'compiler' AS field, r.compiler AS left_value, o.compiler AS right_value FROM r JOIN o USING (ref_id) WHERE r.compiler IS DISTINCT FROM o.compiler
UNION ALL SELECT r.ref_id, 'optimization', r.optimization, o.optimization FROM r JOIN o USING (ref_id) WHERE r.optimization IS DISTINCT FROM o.optimization UNION ALL SELECT ref_id, 'row', 'present', NULL FROM r WHERE ref_id NOT IN (SELECT ref_id FROM o)""",
    "member_excess": """WITH u AS (SELECT trim(library) AS archive, cu_name AS name, count(*) AS n_used FROM (SELECT DISTINCT ON (match_id) * FROM block_matches) GROUP BY ALL), s AS (SELECT trim(archive_basename) AS archive, name, count(*) AS n_stock FROM (SELECT DISTINCT ON (member_id) * FROM archive_members) GROUP BY ALL)
SELECT archive, name, n_used, coalesce(n_stock, 0) AS n_stock FROM u LEFT JOIN s USING (archive, name) WHERE n_used > coalesce(n_stock, 0)""",
    "index_gaps": "SELECT unit_type, unit_id, count(DISTINCT block_index) AS n_indices, min(block_index) AS low, max(block_index) AS high FROM blocks GROUP BY ALL HAVING min(block_index) <> 0 OR max(block_index) <> count(DISTINCT block_index) - 1",
    "member_expansion": """WITH p AS (SELECT record_id, unnest(programs) AS x, unnest(range(0, len(programs))) AS i FROM (SELECT DISTINCT ON (record_id) * FROM profile_records)) SELECT record_id, i::INT AS position, lower(trim(x)) AS name, row_number() OVER (PARTITION BY record_id, lower(trim(x)) ORDER BY i) AS occurrence FROM p""",
    "profile_checks": """WITH p AS (SELECT DISTINCT ON (record_id) * FROM profile_records), c AS (SELECT record_id, unnest(['split_known', 'has_hashes', 'hashes_distinct', 'hashes_well_formed', 'collected_first']) AS check_name, unnest([split_name IN ('train', 'validation', 'test'), len(hashes) > 0,
len(hashes) = len(list_distinct(hashes)) + (len(list_filter(hashes, lambda h: h IS NULL)) > 0)::INT, len(list_filter(hashes, lambda h: NOT coalesce(regexp_matches(h, '^[0-9a-f]{64}$'), false))) = 0, collected_at <= ingested_at]) AS good FROM p)
SELECT check_name, count(*) FILTER (NOT coalesce(good, false)) AS n_violations, min(record_id) FILTER (NOT coalesce(good, false)) AS first_key FROM c GROUP BY check_name""",
    "word_ids": Q._J + """, w AS (SELECT build_id, unnest([coalesce(compiler, '?'), coalesce(optimization, '?'), coalesce(program, '?')]) AS word, unnest([1, 2, 3]) AS i FROM b), n AS (SELECT word, count(*) AS n FROM w GROUP BY word HAVING count(*) >= 5), v AS (SELECT word, 4 + row_number() OVER (ORDER BY n DESC, word) AS t FROM n)
SELECT build_id, array_to_string(list(coalesce(t, 1) ORDER BY i), ' ') || ' 0' AS ids FROM w LEFT JOIN v USING (word) GROUP BY build_id""",
    "replay_grid": Q._W + f""", c(cm, ar) AS (VALUES {_GRID}), r AS (SELECT cm, ar, build_id, library, bool_or(coverage_mean >= cm::DOUBLE AND assignment_ratio >= ar::DOUBLE) AS p FROM w CROSS JOIN c GROUP BY ALL),
t AS (SELECT build_id, trim(archive_basename) AS library, bool_or(selected_by_linker) AS expected FROM elf_archives GROUP BY ALL), z AS (SELECT cm, ar, coalesce(expected, false) AS e, p FROM r LEFT JOIN t USING (build_id, library)), g AS (SELECT cm, ar, {Q._CNT} FROM z GROUP BY cm, ar)
SELECT cm::DOUBLE::VARCHAR || '/' || ar::DOUBLE::VARCHAR AS config, tp, fp, fn, round(CASE WHEN 2*tp+fp+fn = 0 THEN 0 ELSE 2*tp / (2*tp+fp+fn) END, 6) AS f1 FROM g""",
    "cross_build_availability": Q._SCEN + ", d AS (SELECT DISTINCT \"case\", family, package, compiler, optimization, role FROM a), " + ", ".join(f"""j{i} AS (SELECT q."case", q.family, q.package, q.compiler, q.optimization, q.role, o.wanted, max((c.label IS NOT NULL)::INT) AS available, max((k.label IS NOT NULL)::INT) AS detected
  FROM d q CROSS JOIN (SELECT DISTINCT {k} AS wanted FROM c) o LEFT JOIN c ON c.family = q.family AND c.package = q.package AND c.{k} = o.wanted AND c.{x} = q.{x} AND c.{y} = q.{y} LEFT JOIN k ON k."case" = q."case" AND k.label = c.label GROUP BY ALL)""" for i, (k, x, y) in enumerate((("compiler", "optimization", "role"), ("optimization", "compiler", "role"), ("role", "compiler", "optimization"))))
    + " UNION ALL ".join(f" SELECT '{k}_to_' || wanted AS scenario, count(*) AS asked, sum(available)::BIGINT AS available, sum(detected)::BIGINT AS detected FROM j{i} GROUP BY wanted" for i, k in enumerate(("compiler", "optimization", "role"))),
    "reclassified": Q._J + ", mo AS (SELECT trim(archive_basename) AS library, max(n_functions) AS most FROM archive_members GROUP BY 1), z AS (SELECT CASE WHEN most IS NULL THEN 'unknown' WHEN most <= 1 THEN 'mono' ELSE 'eligible' END AS status, coalesce(expected, false) AS e, coalesce(predicted, false) AS p FROM x LEFT JOIN mo USING (library)) SELECT status, count(*) FILTER (e AND p) AS tp, count(*) FILTER (NOT e AND p) AS fp, count(*) FILTER (e AND NOT p) AS fn FROM z GROUP BY status",
}
