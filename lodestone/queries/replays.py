"""Feature records of all matches, as a log would hold them, and what is replayed from them, with checking SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.operators import metrics as K
from lodestone.operators import records as L
from lodestone.operators import replay as P
from lodestone.plans.session import table, written
from lodestone.queries import decisions as Q

KEYS = ["binary_path", "library"]
GATE = Q.GATE | {"coverage_mean": 0.7, "coverage_ratio": 0.5, "assignment_quality": 0.6, "assignment_ratio": 0.4, "function_coverage": 0.2}
#: Gates and settings of the replays; more of the test tables' constant data confirms than would by default.
SETTINGS = {"rodata_confirm": 0.6, "rodata_penalty": 0.45, "library_min_score": 0.75}


def _paths(spark: SparkSession, d: str) -> DataFrame:
    """``build_id, binary_path``: builds of one program stand for one binary."""
    return Q._builds(spark, d).select("build_id", F.concat(F.lit("/srv/elf/"), F.coalesce("program", F.lit("-"))).alias("binary_path"))


def _truth(spark: SparkSession, d: str) -> DataFrame:
    refs = table(spark, d, "elf_archives").join(_paths(spark, d), "build_id")
    return refs.groupBy("binary_path", F.trim("archive_basename").alias("library")).agg(F.bool_or("selected_by_linker").alias("expected"))


def logged(spark: SparkSession, d: str, replay: bool = True) -> DataFrame:
    """``value``: a log line for each unit of each program's builds, and one with its calls.

    The matches of a program with the same library and unit index are the windows of one record, unless they have no window count.
    A window maps up to three functions; each unit calls the next one of its library.
    """
    w = Q._windows(spark, d).withColumn("library", F.trim("library")).join(_paths(spark, d), "build_id")
    pair = lambda f: F.when((F.col("match_id") + f) % 4 != 0, F.struct(F.lit(f).alias("target_function_index"), ((F.col("match_id") + f) % 7).cast("int").alias("source_function_index"), F.lit(1.0).alias("coverage_ratio")))
    mapping = F.filter(F.array(pair(0), pair(1), pair(2)), lambda x: x.isNotNull())
    one = F.struct("match_id", *P.GATES, F.col("coverage_mean").alias("coverage_min"), mapping.alias("function_matches"))
    best = F.max_by("cu_status", F.struct(F.col("passed").cast("int"), "match_id"))
    u = w.groupBy("binary_path", "library", "target_cu_index").agg(
        F.min("cu_name").alias("name"), F.transform(F.array_sort(F.collect_list(F.when(F.col("windows_total").isNotNull(), one))), lambda x: x.dropFields("match_id")).alias("windows"), best.alias("cu_status"), F.max("coverage_mean").alias("best_score"),
        F.bool_or(F.col("num_source_blocks").isNotNull()).alias("rodata_has_rodata"), (64 * F.coalesce(F.max("num_source_blocks"), F.lit(0))).alias("rodata_bytes"), F.coalesce(F.max("num_target_blocks"), F.lit(0)).alias("rodata_strings"), F.coalesce(F.max("windows_total"), F.lit(0)).alias("rodata_ngrams"),
        F.max("coverage_ratio").alias("rodata_string_score"), F.max("assignment_quality").alias("rodata_byte_score"),
    )
    functions = table(spark, d, "archive_members").groupBy(F.trim("archive_basename").alias("library")).agg(F.max("n_functions").alias("target_function_count"))
    nxt = F.lead("target_cu_index").over(Window.partitionBy(*KEYS).orderBy("target_cu_index"))
    call = F.struct((F.col("target_cu_index") % 3).alias("caller_function_index"), nxt.alias("callee_cu_index"), (nxt % 3).alias("callee_function_index"))
    u = u.join(functions, "library", "left").withColumns({
        "rodata_string_informative": F.col("rodata_ngrams") > 100, "rodata_byte_informative": F.col("rodata_strings") > 20, "inter_cu_calls": F.when(nxt.isNotNull(), F.array(call)).otherwise(F.array().cast("array<struct<caller_function_index:int,callee_cu_index:int,callee_function_index:int>>")),
        "record_detail": L.record_detail(F.col("cu_status"), replay), "target_function_count": F.coalesce("target_function_count", F.lit(2)), "rodata_status": F.lit("unknown"), "asm_normalization": F.lit("v2"), "palmtree_pooling": F.lit("mean"),
    })
    calls = F.transform(F.sequence(F.lit(0), F.lit(6)), lambda a: F.concat(F.lit("["), a, F.lit(",["), (a * 3 + 1) % 7, F.lit("]]")))
    head = u.select(F.concat(F.lit('{"type":"source_call_targets","binary_path":"'), F.col("binary_path"), F.lit('","calls":['), F.array_join(calls, ","), F.lit("]}")).alias("value")).distinct()
    return L.record_json(u).unionByName(head)


def _parsed(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Units, windows and the binaries' calls, read back from the log."""
    parsed = written(L.parse_records(logged(spark, d), "value", []), "records")
    units = written(L.unit_records(parsed, []), "units")
    return units, L.unit_windows(units, KEYS), L.source_calls(parsed, [])


def record_shapes(spark: SparkSession, d: str) -> DataFrame:
    """Units as full and compact records, read back."""
    r = L.parse_records(logged(spark, d, replay=False), "value", []).filter("type = 'block_cu'")
    return r.groupBy("record_detail", "rejection_reason", "schema_version").agg(F.count(F.lit(1)).alias("units"), F.sum(F.coalesce(F.size("windows"), F.lit(0))).cast("bigint").alias("windows"), F.count("best_score").alias("scores"), F.count("rodata_bytes").alias("with_rodata"), F.round(F.sum("best_score"), 6).alias("total"))


def record_windows(spark: SparkSession, d: str) -> DataFrame:
    """Windows of all units with how many functions they map, read back from the log."""
    _, windows, _ = _parsed(spark, d)
    return windows.groupBy(*KEYS, "target_cu_index").agg(F.count(F.lit(1)).alias("windows"), F.sum(F.size("mapping")).alias("mapped"), F.round(F.max("coverage_mean"), 6).alias("best"))


def _configs(spark: SparkSession) -> DataFrame:
    return L.with_defaults(P.factorial(spark, GATE), **SETTINGS)


def _replayed(spark: SparkSession, d: str, configs: DataFrame) -> DataFrame:
    units, windows, calls = _parsed(spark, d)
    linked, alone = L.unit_settings(configs)
    return L.replay_libraries(L.replay_units(windows, units, alone, KEYS, passing=True), calls, linked, ["binary_path"], KEYS, pairs=units)


def replay_evidence(spark: SparkSession, d: str) -> DataFrame:
    """Every library of every build under the whole method: accepted units, score, cross-unit calls and decision."""
    r = _replayed(spark, d, _configs(spark).filter("config = 'FULL'")).drop("config")
    return r.withColumns({c: F.round(c, 6) for c in ("library_score", "adjusted")})


def _factorial(spark: SparkSession, d: str) -> DataFrame:
    per = _replayed(spark, d, _configs(spark))
    return K.metrics(per.join(_truth(spark, d), KEYS, "left").groupBy("config").agg(*K.counts())).select("config", "tp", "fp", "fn", "tn", "precision", "recall", "f1")


def ablation_factorial(spark: SparkSession, d: str) -> DataFrame:
    return _factorial(spark, d)


def ablation_delta(spark: SparkSession, d: str) -> DataFrame:
    return K.delta(_factorial(spark, d).select("config", "f1"), "config", "FULL", "f1")


def fn_causes(spark: SparkSession, d: str) -> DataFrame:
    """Why each linked library of a build was missed: no unit of it passes all gates and keeps its constant data."""
    units, windows, _ = _parsed(spark, d)
    one = L.with_defaults(spark.range(0, 1, 1, 1).select(F.lit("one").alias("config")), **{f"min_{g}": v for g, v in GATE.items()}, **SETTINGS)
    got = L.replay_units(windows, units, one, KEYS).filter("passed and not penalised").select(*KEYS).distinct()
    e = _truth(spark, d).filter("expected and library <> ''").select(*KEYS)
    lib = table(spark, d, "library_archives")
    mates = lib.filter("package is not null").select(F.trim("archive").alias("library"), "package").distinct()
    seen = units.select(*KEYS).distinct().join(mates, "library").select("binary_path", "package", F.col("library").alias("__other")).distinct()
    aliases = e.join(mates, "library").join(seen, ["binary_path", "package"]).filter(F.col("library") != F.col("__other")).select(*KEYS)
    return L.causes(e.join(got, KEYS, "left_anti"), windows, units, aliases, KEYS, GATE, SETTINGS)


def _searched(spark: SparkSession, d: str) -> dict:
    from lodestone.operators import search as S

    units, windows, calls = _parsed(spark, d)
    windows = written(windows, "windows")
    t = written(_truth(spark, d), "truth")

    def score(configs: DataFrame) -> DataFrame:
        per = L.replay_libraries(L.replay_units(windows, units, configs, KEYS, passing=True), calls, configs, ["binary_path"], KEYS, pairs=units)
        return K.f1_metrics(per.join(t, KEYS, "left").groupBy("config").agg(*K.counts())).select("config", "f1")

    start = {"min_coverage_mean": 0.9, "min_assignment_ratio": 0.45, "rodata_penalty": 0.35}
    return S.greedy_on_spark(spark, start, {"min_coverage_mean": [0.5, 0.7, 0.9], "min_assignment_ratio": [0.0, 0.4, 0.45], "rodata_penalty": [0.2, 0.35]}, score, rounds=2)


def greedy_replay(spark: SparkSession, d: str) -> DataFrame:
    """A greedy search over three parameters; each step replays all of a parameter's values in one job."""
    best, history = _searched(spark, d)
    rows = [(r["step"], r["parameter"], float(r["value"]), float(r["f1"])) for r in history]
    return spark.createDataFrame(rows, "step int, parameter string, value double, f1 double")


QUERIES = {f.__name__: f for f in (record_shapes, record_windows, replay_evidence, ablation_factorial, ablation_delta, fn_causes, greedy_replay)}

_OK = " AND ".join(f"coalesce({g}, 0) >= " + (f"CASE WHEN {'h' if g in P.MODULE_GATES['H'] else 's'} THEN {v}::DOUBLE ELSE 0 END" if g not in ("coverage_mean", "coverage_ratio") else f"{v}::DOUBLE") for g, v in GATE.items())
_CONFIGS = ", ".join("('" + ("FULL" if all(b) else "B" + "".join(m for m, x in zip("HSXR", b) if x)) + "', " + ", ".join(map(str, b)) + ")" for b in ((h, s, x, r) for h in (True, False) for s in (True, False) for x in (True, False) for r in (True, False)))
_REC = Q._W + f""", bb AS (SELECT DISTINCT ON (build_id) * FROM build_info ORDER BY build_id, ingested_at DESC), pa AS (SELECT build_id, '/srv/elf/' || coalesce(translate(lower(trim(program)), '_ ', '--'), '-') AS bp FROM bb),
k AS (SELECT w.*, trim(library) AS lib, target_cu_index AS cu, bp FROM w JOIN pa ON pa.build_id = w.build_id), tr AS (SELECT bp, trim(archive_basename) AS lib, bool_or(selected_by_linker) AS expected FROM elf_archives r JOIN pa ON pa.build_id = r.build_id GROUP BY ALL),
u AS (SELECT bp, lib, cu, min(cu_name) AS name, count(windows_total) AS nw, bool_or(num_source_blocks IS NOT NULL) AS has, 64 * coalesce(max(num_source_blocks), 0) AS nb, coalesce(max(num_target_blocks), 0) AS ns, coalesce(max(windows_total), 0) AS ng, max(coverage_ratio) AS sc, max(assignment_quality) AS bs, max(coverage_mean) AS top, max_by(cu_status, ROW(passed::INT, match_id)) AS status FROM k GROUP BY ALL),
v AS (SELECT *, CASE WHEN ng > 100 AND ns > 20 THEN 0.7::DOUBLE * sc + 0.3::DOUBLE * bs WHEN ng > 100 THEN sc WHEN ns > 20 THEN 0.5::DOUBLE * bs ELSE 0 END AS rs, has AND (nb >= 512 OR ns >= 16 OR ng >= 32) AS inf, lead(cu) OVER (PARTITION BY bp, lib ORDER BY cu) AS nxt FROM u),
c(config, h, s, x, r) AS (VALUES {_CONFIGS})"""
_REP = _REC + f""",
g AS (SELECT * FROM (SELECT config, x, r, bp, lib, cu, match_id, coverage_mean, row_number() OVER (PARTITION BY config, bp, lib, cu ORDER BY coverage_mean DESC, match_id) AS o FROM k CROSS JOIN c WHERE windows_total IS NOT NULL AND {_OK}) WHERE o = 1),
a AS (SELECT g.config, g.x, g.bp, g.lib, g.cu, g.match_id, v.nxt, g.r AND v.inf AND v.rs <= 0.45::DOUBLE AS pen, CASE WHEN g.r AND v.inf AND v.rs >= 0.6::DOUBLE THEN least(1.0, greatest(g.coverage_mean, g.coverage_mean + 0.3::DOUBLE * least(1.0, greatest(0.0, (v.rs - 0.6::DOUBLE) / (1 - 0.6::DOUBLE))) * (1 - g.coverage_mean))) ELSE g.coverage_mean END AS score FROM g JOIN v USING (bp, lib, cu)),
l AS (SELECT config, bp, lib, count(*) FILTER (NOT pen) AS accepted, count(*) FILTER (pen) AS penalised, list_reverse_sort(list(CASE WHEN pen THEN 0.0 ELSE score END)) AS s FROM a GROUP BY ALL),
e AS (SELECT a.config, a.bp, a.lib, CASE WHEN (a.match_id + a.cu % 3) % 4 <> 0 THEN (a.match_id + a.cu % 3) % 7 END AS ca, CASE WHEN (b.match_id + b.cu % 3) % 4 <> 0 THEN (b.match_id + b.cu % 3) % 7 END AS cb FROM a JOIN a b ON b.config = a.config AND b.bp = a.bp AND b.lib = a.lib AND b.cu = a.nxt WHERE NOT a.pen AND NOT b.pen),
f AS (SELECT config, bp, lib, count(*) AS ex, count(*) FILTER (ca IS NOT NULL AND cb IS NOT NULL) AS ev, count(*) FILTER (ca IS NOT NULL AND cb IS NOT NULL AND (ca * 3 + 1) % 7 = cb) AS ma FROM e GROUP BY ALL),
p AS (SELECT DISTINCT c.config, c.x, u.bp, u.lib FROM u CROSS JOIN c),
q AS (SELECT p.*, coalesce(accepted, 0) AS accepted, coalesce(penalised, 0) AS penalised, coalesce(list_sum(list_slice(l.s, 1, 3)) / least(3, len(l.s)), 0) AS sc, coalesce(ex, 0) AS ex, coalesce(ev, 0) AS ev, coalesce(ma, 0) AS ma FROM p LEFT JOIN l USING (config, bp, lib) LEFT JOIN f USING (config, bp, lib)),
z AS (SELECT *, CASE WHEN x AND ev > 0 THEN least(1.0, greatest(0.0, sc + 0.2::DOUBLE * (least(1.0::DOUBLE, ev / 8.0::DOUBLE) * ev / ex) * (ma::DOUBLE / ev) * (1 - sc))) ELSE sc END AS adj FROM q),
d AS (SELECT *, accepted > 0 AND adj >= 0.75::DOUBLE AS predicted FROM z)"""
_FACT = _REP + f""", y AS (SELECT config, coalesce(expected, false) AS e, predicted AS p FROM d LEFT JOIN tr USING (bp, lib)),
n AS (SELECT config, {Q._CNT} FROM y GROUP BY config), o AS (SELECT *, {Q._MET} FROM n)"""
_DEEP = " + ".join("(" + " AND ".join(f"coalesce({g} >= {v}::DOUBLE, false)" for g, v in list(GATE.items())[: i + 1]) + ")::INT" for i in range(len(GATE)))
_ALLOK = " AND ".join(f"coalesce({g}, 0) >= {v}::DOUBLE" for g, v in GATE.items())

SQL = {
    "record_shapes": _REC + """, y AS (SELECT *, CASE WHEN status = 'PASS' THEN 'full' ELSE 'compact' END AS record_detail FROM u)
SELECT record_detail, CASE record_detail WHEN 'compact' THEN CASE WHEN status = 'DROP_RODATA' THEN 'rodata_penalty' ELSE 'block_gates' END END AS rejection_reason, 2 AS schema_version, count(*) AS units, sum(CASE record_detail WHEN 'full' THEN nw ELSE 0 END)::BIGINT AS windows,
count(CASE record_detail WHEN 'compact' THEN top END) AS scores, count(*) FILTER (record_detail = 'full') AS with_rodata, round(sum(CASE record_detail WHEN 'compact' THEN top END), 6) AS total FROM y GROUP BY ALL""",
    "record_windows": _REC + """, mw AS (SELECT bp, lib, cu, count(*) AS windows, sum((match_id % 4 <> 0)::INT + ((match_id + 1) % 4 <> 0)::INT + ((match_id + 2) % 4 <> 0)::INT)::BIGINT AS mapped, max(coverage_mean) AS best FROM k WHERE windows_total IS NOT NULL GROUP BY ALL)
SELECT u.bp AS binary_path, u.lib AS library, u.cu AS target_cu_index, coalesce(windows, 1) AS windows, coalesce(mapped, 0) AS mapped, round(coalesce(best, 0), 6) AS best FROM u LEFT JOIN mw USING (bp, lib, cu)""",
    "replay_evidence": _REP + " SELECT bp AS binary_path, lib AS library, accepted, penalised, round(sc, 6) AS library_score, ex AS edges_expected, ev AS edges_evaluable, ma AS edges_matched, round(adj, 6) AS adjusted, predicted FROM d WHERE config = 'FULL'",
    "ablation_factorial": _FACT + ' SELECT config, tp, fp, fn, tn, "precision", recall, f1 FROM o',
    "ablation_delta": _FACT + " SELECT config, f1, round(f1 - (SELECT f1 FROM o WHERE config = 'FULL'), 6) AS delta_f1 FROM o",
    "fn_causes": _REC + f""", x AS (SELECT bp, lib, cu, max({_DEEP}) AS depth, bool_or({_ALLOK}) AS ok FROM k WHERE windows_total IS NOT NULL GROUP BY ALL), pn AS (SELECT *, inf AND rs <= 0.45::DOUBLE AS pen FROM v),
fc AS (SELECT trim(archive_basename) AS lib, max(n_functions) AS nf FROM archive_members GROUP BY 1),
s AS (SELECT pn.bp, pn.lib, coalesce(min(fc.nf), 2) AS functions, sum(nw) AS windows, coalesce(max(depth), 0) AS depth, coalesce(bool_or(depth = 8 AND NOT pen), false) AS clean FROM pn LEFT JOIN x USING (bp, lib, cu) LEFT JOIN fc USING (lib) GROUP BY ALL),
e AS (SELECT bp, lib FROM tr WHERE expected AND lib <> ''),
ms AS (SELECT e.bp, e.lib FROM e LEFT JOIN s USING (bp, lib) WHERE NOT coalesce(clean, false)),
pk AS (SELECT DISTINCT trim(archive) AS lib, package FROM library_archives WHERE package IS NOT NULL), sn AS (SELECT DISTINCT u.bp, pk.package, pk.lib FROM u JOIN pk ON pk.lib = u.lib),
al AS (SELECT DISTINCT ms.bp, ms.lib FROM ms JOIN pk ON pk.lib = ms.lib JOIN sn ON sn.bp = ms.bp AND sn.package = pk.package AND sn.lib <> ms.lib)
SELECT ms.bp AS binary_path, ms.lib AS library, coalesce(s.depth, 0) AS depth, CASE WHEN s.lib IS NULL THEN CASE WHEN al.lib IS NOT NULL THEN 'record_absent_alias_available' ELSE 'record_absent' END WHEN s.functions < 2 THEN 'candidate_below_two_functions' WHEN s.windows = 0 THEN 'record_present_no_windows'
WHEN s.depth < 8 THEN 'failed_' || [{", ".join(f"'{g}'" for g in GATE)}][least(s.depth, 7)::INT + 1] WHEN NOT s.clean THEN 'failed_rodata' ELSE 'unexpected_record_pass' END AS category
FROM ms LEFT JOIN s ON s.bp = ms.bp AND s.lib = ms.lib LEFT JOIN al ON al.bp = ms.bp AND al.lib = ms.lib""",
}
