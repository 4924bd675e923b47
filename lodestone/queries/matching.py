"""Matching, structure, text and constant-data queries over the test tables, with checking SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.functions import text as X
from lodestone.operators import rodata as R
from lodestone.operators import similarity as M
from lodestone.operators import structure as S
from lodestone.operators import truth as T
from lodestone.plans.session import table

#: Gates the test vectors can pass: they are random, so neighbours lie near 0.3.
TEST_PARAMS = M.MatchParams(block_threshold=0.32, coverage_mean=0.31, coverage_ratio=0.4, assignment_quality=0.15, assignment_ratio=0.05, call_edge_ratio=0.3, function_concentration=0.1, function_spread=0.1, function_coverage=0.3)


def _blocks(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Every fourth vector is a library block (ten units of three functions), the others are one binary of thirty functions."""
    e = table(spark, d, "embeddings").withColumn("n_instructions", F.lit(9))
    is_cu = F.col("vec_id") % 4 == 0
    cu = e.filter(is_cu).select((F.floor(F.col("vec_id") / 4) % 10).alias("u"), (F.floor(F.col("vec_id") / 40) % 3).alias("f"), "vec_id", "embedding", "n_instructions")
    return cu, e.filter(~is_cu).select(F.lit(0).alias("u"), (F.col("label") * 3 + F.col("vec_id") % 3).alias("f"), "vec_id", "embedding", "n_instructions")


def _units(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return tuple(M.indexed_blocks(x, "u", "f", ["vec_id"], "embedding", "n_instructions") for x in _blocks(spark, d))


def _edges(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """The function of each block calls that of the unit's next block, by ``vec_id``."""
    follow = F.lead("f").over(Window.partitionBy("u").orderBy("vec_id"))
    calls = lambda x: x.select("u", F.col("f").alias("caller"), follow.alias("callee")).filter("callee is not null and caller <> callee")
    return tuple(M.dense_edges(x, calls(x), "u", "f") for x in _blocks(spark, d))


def block_coverage(spark: SparkSession, d: str) -> DataFrame:
    w = M.match_windows(*_units(spark, d), TEST_PARAMS)
    return w.select("cu", "window_start", *(F.round(c, 6).alias(c) for c in ("coverage_mean", "coverage_min", "coverage_ratio")))


def block_best_coverage(spark: SparkSession, d: str) -> DataFrame:
    """The window of each unit with the best coverage, before any gate is asked."""
    w = M.match_windows(*_units(spark, d), TEST_PARAMS)
    # summation order must not decide between equal windows
    key = F.struct(F.round("coverage_mean", 9), F.round("coverage_ratio", 9), -F.col("window_start"))
    return w.groupBy("cu").agg(F.max_by(F.struct("window_start", F.round("coverage_mean", 6).alias("coverage_mean")), key).alias("w")).select("cu", "w.*")


def full_match(spark: SparkSession, d: str) -> DataFrame:
    return M.full_match(*_units(spark, d), TEST_PARAMS, *_edges(spark, d))


#: Gates that a part of the small units pass.
SMALL_PARAMS = M.MatchParams(block_threshold=0.15, coverage_mean=0.16, coverage_ratio=0.5, assignment_quality=0.1, assignment_ratio=0.3, call_edge_ratio=0.3, function_concentration=0.5, function_spread=0.6, function_coverage=0.5, multiplier=1.5, padding=0)


def _small(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Of every ten vectors three are a library unit of two functions, and the others of every twenty a binary of seven functions of two blocks."""
    e = table(spark, d, "embeddings").withColumns({"n_instructions": F.lit(9), "r": F.col("vec_id") % 10})
    cu = e.filter("r < 3").select(F.floor(F.col("vec_id") / 10).alias("u"), F.least("r", F.lit(1)).alias("f"), "vec_id", "embedding", "n_instructions")
    place = F.col("r") - 3 + F.when(F.col("vec_id") % 20 >= 10, 7).otherwise(0)
    elf = e.filter("r >= 3").select(F.floor(F.col("vec_id") / 20).alias("u"), F.floor(place / 2).alias("f"), "vec_id", "embedding", "n_instructions")
    units = [M.indexed_blocks(x, "u", "f", ["vec_id"], "embedding", "n_instructions") for x in (cu, elf)]
    cu_calls = cu.select("u", F.lit(0).alias("caller"), F.lit(1).alias("callee")).distinct()
    elf_calls = elf.select("u", F.col("f").alias("caller"), ((F.col("f") * 3 + 1) % 7).alias("callee")).distinct()
    return *units, M.dense_edges(cu, cu_calls, "u", "f"), M.dense_edges(elf, elf_calls, "u", "f")


def unit_match(spark: SparkSession, d: str) -> DataFrame:
    """The whole matcher over many small units and binaries, for which SQL can try every assignment."""
    cu, elf, cu_edges, elf_edges = _small(spark, d)
    m = M.full_match(cu, elf, SMALL_PARAMS, cu_edges, elf_edges, stride=2)
    return m.select("cu", "elf", "window_start", "passed", *(F.round(g, 6).alias(g) for g in M.GATES), F.col("windows_total").cast("bigint").alias("windows_total"), "windows_evaluated", "frontier", "bound_rejected")


def hungarian_assignment(spark: SparkSession, d: str) -> DataFrame:
    """Assignments of every window that passes the coverage gates, of units and binaries so small that SQL can try all."""
    cu, elf, *edges = _small(spark, d)
    w = M.match_windows(cu, elf, SMALL_PARAMS, *edges, stride=3)
    return w.select("cu", "elf", "window_start", F.round("assignment_quality", 6).alias("assignment_quality"), F.round("assignment_ratio", 6).alias("assignment_ratio"), "evaluated")


def negative_bound(spark: SparkSession, d: str) -> DataFrame:
    b = M.negative_bounds(M.block_best(*_units(spark, d)), TEST_PARAMS)
    return b.select("cu", F.round("bound_mean", 6).alias("bound_mean"), F.round("bound_ratio", 6).alias("bound_ratio"), "rejected")


def function_mapping(spark: SparkSession, d: str) -> DataFrame:
    m = M.function_mapping(M.block_best(*_units(spark, d)), 0.32)
    return m.select("cu", "cu_function", "elf_function", *(F.round(c, 6).alias(c) for c in ("dominant_ratio", "coverage_mean", "coverage_ratio")))


def block_spans(spark: SparkSession, d: str) -> DataFrame:
    """Where each function's blocks of five instructions or more lie in its unit's list of blocks."""
    b = table(spark, d, "blocks").dropDuplicates(["block_id"])
    return M.block_spans(b, ["unit_type", "unit_id"], "function_index", ["block_index"], "normalized_embeddings", "n_instructions")


def unit_eligibility(spark: SparkSession, d: str) -> DataFrame:
    """Members of two functions or more, numbered within their archive."""
    m = table(spark, d, "archive_members").dropDuplicates(["member_id"]).select(F.coalesce(F.trim("archive_basename"), F.lit("-")).alias("library"), "member_id", "n_functions")
    return M.eligible_units(m, ["library"], "n_functions", ["member_id"]).select("library", "member_id", "target_cu_index")


def mean_pool_units(spark: SparkSession, d: str) -> DataFrame:
    b = table(spark, d, "blocks").dropDuplicates(["block_id"])
    ok = F.forall("normalized_embeddings", lambda x: x.isNotNull() & ~F.isnan(x))
    return M.pooled(b.filter(ok), ["unit_type", "unit_id"], "normalized_embeddings").withColumn("value", F.round("value", 6))


_UNIT = ["unit_type", "unit_id"]


def _functions(b: DataFrame) -> DataFrame:
    return b.groupBy(*_UNIT, "function_index").agg(F.min("address").alias("start"), F.max(F.col("address") + F.col("raw_size")).alias("stop"))


def interval_calls(spark: SparkSession, d: str) -> DataFrame:
    """Where the address after each block lies."""
    b = table(spark, d, "blocks").dropDuplicates(["block_id"])
    calls = b.select(*_UNIT, F.col("function_index").alias("caller"), (F.col("address") + F.col("raw_size")).alias("address"))
    return S.containing_function(calls.distinct(), _functions(b), _UNIT, "address")


def resolved_calls(spark: SparkSession, d: str) -> DataFrame:
    b = table(spark, d, "blocks").dropDuplicates(["block_id"])
    calls = b.select(*_UNIT, F.col("function_index").alias("caller"), (F.col("address") + F.col("raw_size")).alias("address"))
    return S.resolved_calls(calls, _functions(b), _UNIT, "caller", "address")


def _symbols(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Members define the symbol of their function count and refer to that of the next one."""
    m = table(spark, d, "archive_members").dropDuplicates(["member_id"]).filter("archive_basename is not null and name is not null and n_functions is not null")
    lib = F.trim("archive_basename").alias("library")
    return m.select(lib, F.col("name").alias("cu"), F.col("n_functions").alias("symbol")), m.select(lib, F.col("name").alias("cu"), (F.col("n_functions") + F.col("occurrence")).alias("symbol"))


def unique_symbol_edges(spark: SparkSession, d: str) -> DataFrame:
    defs, refs = _symbols(spark, d)
    return S.inter_unit_calls(refs, defs, ["library"], "symbol", "cu")


def relocation_edges(spark: SparkSession, d: str) -> DataFrame:
    defs, refs = _symbols(spark, d)
    return S.relocation_edges(refs, defs, ["library"], "symbol", "cu")


def symbol_inferred_members(spark: SparkSession, d: str) -> DataFrame:
    """A member's name, within its library, stands for the symbol it defines."""
    m = table(spark, d, "archive_members").filter("archive_basename is not null and name is not null and object_sha256 is not null")
    symbol = lambda lib, name: F.concat_ws("/", F.trim(lib), name).alias("symbol")
    defs = m.select(F.trim("archive_basename").alias("library"), F.col("object_sha256").alias("cu"), symbol("archive_basename", "name"))
    own = table(spark, d, "block_matches").filter("library is not null and cu_name is not null").select("build_id", symbol("library", "cu_name"))
    return T.symbol_members(defs, own, "library", "cu", "symbol", "build_id")


def _calls(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Call edges of library units and of one binary, and the functions mapped, out of order lines."""
    li = table(spark, d, "lineitem")
    q = F.col("l_quantity").cast("int")
    cu = li.select(F.col("l_suppkey").alias("library"), (F.col("l_partkey") % 5).alias("caller_cu"), F.col("l_linenumber").cast("long").alias("caller_function"), (F.col("l_orderkey") % 5).alias("callee_cu"), (q % 7 + 1).cast("long").alias("callee_function")).distinct()
    mapping = li.filter("l_returnflag <> 'R'").groupBy(F.col("l_suppkey").alias("library"), (F.col("l_partkey") % 5).alias("cu"), F.col("l_linenumber").cast("long").alias("cu_function")).agg(F.max(q % 20).cast("long").alias("elf_function"))
    elf = li.select((q % 20).cast("long").alias("caller"), (F.col("l_partkey") % 13).alias("callee")).distinct()
    return cu, mapping, elf


def internal_call_ratio(spark: SparkSession, d: str) -> DataFrame:
    cu, mapping, elf = _calls(spark, d)
    key = F.concat_ws("/", "library", "caller_cu").alias("unit")
    edges = cu.filter("caller_cu = callee_cu").select(key, F.col("caller_function").alias("caller"), F.col("callee_function").alias("callee"))
    return S.preserved_ratio(edges, mapping.select(F.concat_ws("/", "library", "cu").alias("unit"), "cu_function", "elf_function"), elf, "unit").withColumn("ratio", F.round("ratio", 6))


def cross_cu_evidence(spark: SparkSession, d: str) -> DataFrame:
    cu, mapping, elf = _calls(spark, d)
    accepted = table(spark, d, "lineitem").filter("l_linestatus = 'O' and l_discount > 0.05").select(F.col("l_suppkey").alias("library"), (F.col("l_partkey") % 5).alias("cu"))
    ev = S.cross_unit_evidence(cu.filter("caller_cu <> callee_cu"), accepted, mapping, elf, "library")
    score = F.round(S.cross_adjustment(F.lit(0.9), F.col("edges_evaluable"), F.col("coverage"), F.col("ratio")), 6)
    return ev.withColumn("adjusted", score).withColumns({"ratio": F.round("ratio", 6), "coverage": F.round("coverage", 6)})


def relocation_lookup(spark: SparkSession, d: str) -> DataFrame:
    """Line numbers as instruction addresses, part keys as offsets."""
    li = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("unit"), (F.col("l_partkey") * 2).alias("address")).distinct()
    rel = table(spark, d, "part").select((F.col("p_partkey") % 10 + 1).alias("unit"), (F.col("p_partkey") * 2 + F.col("p_size") % 2).alias("offset"), "p_name")
    return S.relocation_at(li, rel, ["unit"], "address", "p_name")


def rodata_strings(spark: SparkSession, d: str) -> DataFrame:
    """Strings of every text held against those of all linker maps."""
    docs = table(spark, d, "documents").filter("text is not null")
    s = lambda x: x.select("doc_id", F.explode(R.ascii_strings(F.col("text"))).alias("s"))
    out = R.string_containment(s(docs), s(docs.filter(F.lower(F.trim("source")) == "linker_map")), "doc_id", "s")
    return out.select("doc_id", "target_strings", F.round("string_score", 6).alias("string_score"))


def rodata_ngrams(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").filter("text is not null")
    g = lambda x: R.gram_rows(x, ["doc_id"], "text")
    out = R.gram_containment(g(docs), g(docs.filter(F.lower(F.trim("source")) == "release_note")), "doc_id", "gram")
    return out.withColumn("byte_score", F.round("byte_score", 6))


def rodata_evidence(spark: SparkSession, d: str) -> DataFrame:
    """Evidence class and lifted score of each match, its ratios standing for string and byte scores."""
    m = table(spark, d, "block_matches").dropDuplicates(["match_id"])
    r = R.combined_score(F.col("coverage_ratio"), F.col("assignment_quality"), F.coalesce(F.col("windows_total") > 100, F.lit(False)), F.coalesce(F.col("num_target_blocks") > 20, F.lit(False)))
    inf = R.informative(F.col("num_source_blocks").isNotNull(), F.coalesce(F.col("num_source_blocks"), F.lit(0)) * 64, F.coalesce("num_target_blocks", F.lit(0)), F.coalesce("windows_total", F.lit(0)))
    m = m.withColumn("rodata", r).withColumn("evidence", R.evidence(inf, F.col("rodata")))
    return m.select("match_id", "evidence", F.round("rodata", 6).alias("rodata"), F.round(R.bonus(F.col("coverage_mean"), F.col("rodata"), F.col("evidence") == "confirm"), 6).alias("lifted"))


def asm_normalize(spark: SparkSession, d: str) -> DataFrame:
    """Every instruction line of every text."""
    line = F.explode(F.split("text", "\n")).alias("line")
    ins = table(spark, d, "documents").select("doc_id", line).select("doc_id", F.regexp_extract("line", r"^0x[0-9a-f]+:[ \t]+([^\r]*)", 1).alias("instruction")).filter("instruction <> ''").distinct()
    return ins.withColumn("v2", X.normalize_instruction(F.col("instruction"))).withColumn("legacy", X.normalize_instruction(F.col("instruction"), "legacy"))


def names(spark: SparkSession, d: str) -> DataFrame:
    """Families, unit names, stems, symbols, versions and labels of all catalog and member names."""
    m = table(spark, d, "archive_members").select(F.trim("archive").alias("archive"), F.trim("name").alias("name")).distinct()
    x = m.select(
        "archive", "name", X.archive_family(F.col("archive")).alias("family"), X.pattern_family(F.col("archive")).alias("pattern_family"), X.cu_name(F.col("name")).alias("cu"), X.stem(F.col("name")).alias("stem"),
        X.canonical_symbol(F.concat(F.lit("sym.imp."), F.col("name"), F.lit("@plt"))).alias("symbol"), X.safe_name(F.col("archive")).alias("safe"), X.stable_rank_key(F.col("archive"), F.col("name")).alias("rank_key"),
    )
    return x


def stable_labels(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, "library_archives").select("library_id", F.trim("archive").alias("name"), "path", "toolchain").dropDuplicates(["library_id"])
    n = a.groupBy("name").agg(F.count(F.lit(1)).alias("builds"))
    j = a.join(n, "name")
    return j.select("library_id", X.stable_label(F.col("name"), F.coalesce("path", F.lit("-")), F.col("builds")).alias("label"), F.concat_ws(".", X.version_order(F.concat(F.lit("x-"), F.regexp_extract("toolchain", "([0-9.]+)$", 1))).cast("array<string>")).alias("version"))


def report_parse(spark: SparkSession, d: str) -> DataFrame:
    """Every report line of every text, as typed columns."""
    from lodestone.sources.readers import parse_report_lines

    lines = table(spark, d, "documents").select("doc_id", F.explode(F.split("text", "\r?\n")).alias("line"))
    return parse_report_lines(lines, "line").distinct()


def linker_map_members(spark: SparkSession, d: str) -> DataFrame:
    return T.member_mentions(table(spark, d, "documents"), "doc_id", "text").distinct()


def feature_explode(spark: SparkSession, d: str) -> DataFrame:
    """Typed unit records of the feature logs; lines delivered twice count once."""
    from lodestone.sources.readers import feature_records

    return feature_records(table(spark, d, "feature_logs"), "payload", ["file_id", "line_no"])


QUERIES = {
    f.__name__: f
    for f in (
        block_coverage, block_best_coverage, full_match, unit_match, hungarian_assignment, block_spans, unit_eligibility, negative_bound, function_mapping, mean_pool_units, interval_calls, resolved_calls, unique_symbol_edges, relocation_edges, symbol_inferred_members,
        internal_call_ratio, cross_cu_evidence, relocation_lookup, rodata_strings, rodata_ngrams, rodata_evidence, asm_normalize, names, stable_labels, report_parse, linker_map_members, feature_explode,
    )
}

_SIM = """
WITH c AS (SELECT (vec_id // 4) % 10 AS cu, (vec_id // 40) % 3 AS cf, vec_id AS i, embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id % 4 = 0),
e AS (SELECT label * 3 + vec_id % 3 AS f, vec_id AS j, embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id % 4 <> 0),
d AS (SELECT f, row_number() OVER (ORDER BY f) - 1 AS ef FROM (SELECT DISTINCT f FROM e)),
s AS (SELECT c.cu, c.cf, c.i, d.ef, e.j, list_cosine_similarity(c.v, e.v) AS s FROM c CROSS JOIN e JOIN d USING (f)),
b AS (SELECT cu, i, ef, max(s) AS s FROM s GROUP BY ALL),
p AS (SELECT (SELECT count(*) FROM d) AS n, least((SELECT count(*) FROM d), greatest(k, ceil(k * 2.5)::BIGINT + 6)) AS w, cu FROM (SELECT cu, count(DISTINCT cf) AS k FROM c GROUP BY cu)),
r AS (SELECT b.cu, b.i, st.s AS window_start, max(b.s) AS m FROM p JOIN (SELECT unnest(range(0, (SELECT count(*) FROM d))) AS s) st ON st.s <= p.n - p.w JOIN b ON b.cu = p.cu AND b.ef >= st.s AND b.ef < st.s + p.w GROUP BY ALL),
cov AS (SELECT cu::VARCHAR AS cu, window_start, round(avg(m), 6) AS coverage_mean, round(min(m), 6) AS coverage_min, round(avg(CASE WHEN m >= 0.32 THEN 1.0::DOUBLE ELSE 0 END), 6) AS coverage_ratio, avg(m) AS raw, avg(CASE WHEN m >= 0.32 THEN 1.0::DOUBLE ELSE 0 END) AS rr FROM r GROUP BY ALL)
"""
_BLOCKS = "WITH b AS (SELECT DISTINCT ON (block_id) * FROM blocks), f AS (SELECT unit_type, unit_id, function_index, min(address) AS a, max(address + raw_size) AS z FROM b GROUP BY ALL), c AS (SELECT DISTINCT unit_type, unit_id, function_index AS caller, address + raw_size AS address FROM b), h AS (SELECT c.*, (SELECT min(ROW(f.a <> c.address, f.z - f.a, f.function_index)) FROM f WHERE f.unit_type = c.unit_type AND f.unit_id = c.unit_id AND f.a <= c.address AND c.address < f.z) AS x FROM c), g AS (SELECT unit_type, unit_id, caller, address, x[3] AS resolved_function FROM h)"
_SYMS = """
WITH m AS (SELECT DISTINCT ON (member_id) * FROM archive_members WHERE archive_basename IS NOT NULL AND name IS NOT NULL AND n_functions IS NOT NULL),
d AS (SELECT trim(archive_basename) AS library, name AS cu, n_functions AS symbol FROM m), r AS (SELECT trim(archive_basename) AS library, name AS cu, n_functions + occurrence AS symbol FROM m)
"""
_CALLS = """
WITH li AS (SELECT *, l_quantity::INT AS q FROM lineitem),
cu AS (SELECT DISTINCT l_suppkey AS library, l_partkey % 5 AS a, l_linenumber AS af, l_orderkey % 5 AS b, q % 7 + 1 AS bf FROM li),
mp AS (SELECT l_suppkey AS library, l_partkey % 5 AS cu, l_linenumber AS f, max(q % 20) AS e FROM li WHERE l_returnflag <> 'R' GROUP BY ALL),
ee AS (SELECT DISTINCT q % 20 AS x, l_partkey % 13 AS y FROM li)
"""
_TOKENS = "list_filter(regexp_split_to_array(regexp_replace(replace(op2, ',', ' '), '([\\[\\]+\\-*:])', ' \\1 ', 'g'), '[\\t\\n\\x0b\\x0c\\r ]+'), lambda x: x <> '' AND x <> 'ptr')"

_SMALL = """
WITH c AS (SELECT vec_id // 10 AS cu, least(vec_id % 10, 1) AS cf, vec_id AS i, embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id % 10 < 3),
e AS (SELECT vec_id // 20 AS elf, (vec_id % 10 - 3 + CASE WHEN vec_id % 20 >= 10 THEN 7 ELSE 0 END) // 2 AS ef, vec_id AS j, embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id % 10 >= 3),
s AS (SELECT cu, cf, i, elf, ef, j, list_cosine_similarity(c.v, e.v) AS s FROM c CROSS JOIN e),
g AS (SELECT cu, elf, avg(m) AS bm, avg((m >= 0.15::DOUBLE)::INT) AS br FROM (SELECT cu, elf, i, max(s) AS m FROM s GROUP BY ALL) GROUP BY ALL),
ok AS (SELECT * FROM g WHERE bm >= 0.16::DOUBLE AND br >= 0.5::DOUBLE),
sw AS (SELECT s.*, st FROM s JOIN ok ON ok.cu = s.cu AND ok.elf = s.elf JOIN (SELECT unnest(range(0, 5)) AS st) w ON s.ef >= w.st AND s.ef < w.st + 3),
r AS (SELECT cu, elf, st, i, cf, max(s) AS m FROM sw GROUP BY ALL),
cov AS (SELECT cu, elf, st, round(avg(m), 12) AS cm, round(avg((m >= 0.15::DOUBLE)::INT), 12) AS cr, count(DISTINCT CASE WHEN m >= 0.15::DOUBLE THEN cf END) / 2 AS fcov FROM r GROUP BY ALL),
ev AS (SELECT * FROM cov WHERE cm >= 0.16::DOUBLE AND cr >= 0.5::DOUBLE),
sx AS (SELECT sw.*, i % 10 AS k FROM sw JOIN ev ON ev.cu = sw.cu AND ev.elf = sw.elf AND ev.st = sw.st),
p AS (SELECT a.cu, a.elf, a.st, a.s + b.s + c.s AS total, (a.s >= 0.15::DOUBLE)::INT + (b.s >= 0.15::DOUBLE)::INT + (c.s >= 0.15::DOUBLE)::INT AS hits FROM sx a
  JOIN sx b ON b.cu = a.cu AND b.elf = a.elf AND b.st = a.st AND b.j <> a.j JOIN sx c ON c.cu = a.cu AND c.elf = a.elf AND c.st = a.st AND c.j <> a.j AND c.j <> b.j WHERE a.k = 0 AND b.k = 1 AND c.k = 2),
asg AS (SELECT cu, elf, st, max(ROW(hits, total)) AS x FROM p GROUP BY ALL),
t AS (SELECT cu, elf, st, cf, i, ef FROM (SELECT *, row_number() OVER (PARTITION BY cu, elf, st, i ORDER BY s DESC, j) AS n FROM sx) WHERE n = 1),
u AS (SELECT cu, elf, st, cf, ef, count(*) AS n FROM t GROUP BY ALL), d AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY cu, elf, st, cf ORDER BY n DESC, ef) AS o FROM u) WHERE o = 1),
z AS (SELECT cu, elf, st, sum(n) / 3 AS conc, count(DISTINCT ef) / 2 AS spread, max(CASE WHEN cf = 0 THEN ef END) AS f0, max(CASE WHEN cf = 1 THEN ef END) AS f1 FROM d GROUP BY ALL),
w AS (SELECT cov.cu, cov.elf, cov.st, cov.cm AS g1, cov.cr AS g2, coalesce(round(asg.x[2] / 3, 12), 0) AS g3, coalesce(round(asg.x[1] / 3, 12), 0) AS g4, CASE WHEN z.cu IS NULL THEN 0 WHEN (z.f0 * 3 + 1) % 7 = z.f1 THEN 1.0 ELSE 0 END AS g5,
  coalesce(round(z.conc, 12), 0) AS g6, coalesce(z.spread, 0) AS g7, CASE WHEN z.cu IS NULL THEN 0 ELSE cov.fcov END AS g8, z.cu IS NOT NULL AS evaluated
  FROM cov LEFT JOIN asg ON asg.cu = cov.cu AND asg.elf = cov.elf AND asg.st = cov.st LEFT JOIN z ON z.cu = cov.cu AND z.elf = cov.elf AND z.st = cov.st),
wp AS (SELECT *, evaluated AND g3 >= 0.1::DOUBLE AND g4 >= 0.3::DOUBLE AND g5 >= 0.3::DOUBLE AND g6 >= 0.5::DOUBLE AND g7 >= 0.6::DOUBLE AND g8 >= 0.5::DOUBLE AS passed FROM w),
fr AS (SELECT cu, elf, count(*) AS n FROM wp x WHERE evaluated AND NOT EXISTS (SELECT 1 FROM wp y WHERE y.evaluated AND y.cu = x.cu AND y.elf = x.elf AND y.st <> x.st AND y.g1 >= x.g1 AND y.g2 >= x.g2 AND y.g3 >= x.g3 AND y.g4 >= x.g4 AND y.g5 >= x.g5 AND y.g6 >= x.g6 AND y.g7 >= x.g7 AND y.g8 >= x.g8
  AND (y.g1 > x.g1 OR y.g2 > x.g2 OR y.g3 > x.g3 OR y.g4 > x.g4 OR y.g5 > x.g5 OR y.g6 > x.g6 OR y.g7 > x.g7 OR y.g8 > x.g8 OR y.st < x.st)) GROUP BY ALL),
b AS (SELECT *, row_number() OVER (PARTITION BY cu, elf ORDER BY passed DESC, g1 DESC, g2 DESC, g3 DESC, g4 DESC, g5 DESC, g6 DESC, g7 DESC, g8 DESC, st) AS o, count(*) FILTER (evaluated) OVER (PARTITION BY cu, elf) AS n_ev FROM wp)
SELECT b.cu::VARCHAR AS cu, b.elf::VARCHAR AS elf, b.st AS window_start, passed, round(g1, 6) AS coverage_mean, round(g2, 6) AS coverage_ratio, round(g3, 6) AS assignment_quality, round(g4, 6) AS assignment_ratio, g5 AS call_edge_ratio, round(g6, 6) AS function_concentration, g7 AS function_spread, g8 AS function_coverage,
5 AS windows_total, n_ev AS windows_evaluated, coalesce(fr.n, 0) AS frontier, false AS bound_rejected FROM b LEFT JOIN fr ON fr.cu = b.cu AND fr.elf = b.elf WHERE o = 1
UNION ALL SELECT cu::VARCHAR, elf::VARCHAR, -1, false, round(bm, 6), 0, 0, 0, 0, 0, 0, 0, 5, 0, 0, true FROM g WHERE NOT (bm >= 0.16::DOUBLE AND br >= 0.5::DOUBLE)"""

SQL = {
    "unit_match": _SMALL,
    "hungarian_assignment": _SMALL[: _SMALL.index("wp AS (")].replace("JOIN ok ON ok.cu = s.cu AND ok.elf = s.elf ", "").rstrip().rstrip(",") + " SELECT cu::VARCHAR AS cu, elf::VARCHAR AS elf, st AS window_start, round(g3, 6) AS assignment_quality, round(g4, 6) AS assignment_ratio, evaluated FROM w",
    "block_spans": """WITH b AS (SELECT DISTINCT ON (block_id) * FROM blocks), g AS (SELECT unit_type, unit_id, function_index, count(*) FILTER (normalized_embeddings IS NOT NULL AND n_instructions >= 5) AS n FROM b GROUP BY ALL)
SELECT unit_type, unit_id, row_number() OVER w - 1 AS f, (sum(n) OVER w)::BIGINT - n AS low, (sum(n) OVER w)::BIGINT AS high FROM g WINDOW w AS (PARTITION BY unit_type, unit_id ORDER BY function_index)""",
    "unit_eligibility": "WITH m AS (SELECT DISTINCT ON (member_id) coalesce(trim(archive_basename), '-') AS library, member_id, n_functions FROM archive_members) SELECT library, member_id, row_number() OVER (PARTITION BY library ORDER BY member_id) - 1 AS target_cu_index FROM m WHERE n_functions >= 2",
    "block_coverage": _SIM + "SELECT cu, window_start, coverage_mean, coverage_min, coverage_ratio FROM cov",
    "block_best_coverage": _SIM + "SELECT cu, window_start, coverage_mean FROM (SELECT *, row_number() OVER (PARTITION BY cu ORDER BY round(raw, 9) DESC, round(rr, 9) DESC, window_start) AS n FROM cov) WHERE n = 1",
    "negative_bound": _SIM + ", g AS (SELECT cu, i, max(s) AS g FROM s GROUP BY ALL) SELECT cu::VARCHAR AS cu, round(avg(g), 6) AS bound_mean, round(avg((g >= 0.32)::INT), 6) AS bound_ratio, avg(g) < 0.31 OR avg((g >= 0.32)::INT) < 0.4 AS rejected FROM g GROUP BY cu",
    "function_mapping": _SIM + """, t AS (SELECT cu, cf, i, ef, s, row_number() OVER (PARTITION BY cu, i ORDER BY s DESC, ef, j) AS n FROM s),
u AS (SELECT cu, cf, ef, count(*) AS k FROM t WHERE n = 1 GROUP BY ALL), v AS (SELECT cu, cf, count(*) AS k, avg(s) AS m, avg((s >= 0.32)::INT) AS r FROM t WHERE n = 1 GROUP BY ALL),
w AS (SELECT *, row_number() OVER (PARTITION BY cu, cf ORDER BY k DESC, ef) AS n FROM u)
SELECT w.cu::VARCHAR AS cu, w.cf AS cu_function, w.ef AS elf_function, round(w.k / v.k, 6) AS dominant_ratio, round(v.m, 6) AS coverage_mean, round(v.r, 6) AS coverage_ratio FROM w JOIN v USING (cu, cf) WHERE n = 1""",
    "mean_pool_units": """WITH b AS (SELECT DISTINCT ON (block_id) * FROM blocks), g AS (SELECT * FROM b WHERE normalized_embeddings IS NOT NULL AND len(list_filter(normalized_embeddings, lambda x: x IS NULL OR isnan(x))) = 0)
SELECT unit_type, unit_id, (dim - 1)::INT AS dim, round(avg(x::DOUBLE), 6) AS value FROM (SELECT unit_type, unit_id, unnest(normalized_embeddings) AS x, unnest(range(1, len(normalized_embeddings) + 1)) AS dim FROM g) GROUP BY ALL""",
    "interval_calls": _BLOCKS + "SELECT * FROM g",
    "resolved_calls": _BLOCKS + "SELECT DISTINCT unit_type, unit_id, caller, resolved_function AS callee FROM g WHERE resolved_function IS NOT NULL AND resolved_function <> caller",
    "unique_symbol_edges": _SYMS + ", u AS (SELECT library, symbol, min(cu) AS definer FROM d GROUP BY ALL HAVING count(DISTINCT cu) = 1) SELECT DISTINCT library, cu AS caller, definer, symbol FROM r JOIN u USING (library, symbol) WHERE definer <> cu",
    "relocation_edges": _SYMS + """, c AS (SELECT library, symbol, cu, count(*) AS n FROM r GROUP BY ALL), x AS (SELECT c.library, c.symbol, c.cu, c.n, min(d.cu) AS definer FROM c JOIN (SELECT DISTINCT * FROM d) d ON d.library = c.library AND d.symbol = c.symbol AND d.cu <> c.cu GROUP BY ALL HAVING count(*) = 1)
SELECT library, cu AS caller, definer, sum(n)::BIGINT AS relocations, count(*) AS symbols FROM x GROUP BY ALL""",
    "symbol_inferred_members": """WITH d AS (SELECT trim(archive_basename) AS library, object_sha256 AS cu, trim(archive_basename) || '/' || name AS symbol FROM archive_members WHERE archive_basename IS NOT NULL AND name IS NOT NULL AND object_sha256 IS NOT NULL),
u AS (SELECT library, symbol, min(cu) AS cu FROM d GROUP BY ALL HAVING count(DISTINCT cu) = 1), b AS (SELECT DISTINCT build_id, trim(library) || '/' || cu_name AS symbol FROM block_matches WHERE library IS NOT NULL AND cu_name IS NOT NULL)
SELECT build_id, library, cu, count(DISTINCT symbol) AS n_symbols FROM u JOIN b USING (symbol) GROUP BY ALL""",
    "internal_call_ratio": _CALLS + """, j AS (SELECT cu.library || '/' || cu.a AS unit, p.e AS pe, q.e AS qe, ee.x FROM cu LEFT JOIN mp p ON p.library = cu.library AND p.cu = cu.a AND p.f = cu.af LEFT JOIN mp q ON q.library = cu.library AND q.cu = cu.b AND q.f = cu.bf LEFT JOIN ee ON ee.x = p.e AND ee.y = q.e WHERE cu.a = cu.b)
SELECT unit, count(*) AS edges_total, count(*) FILTER (pe IS NOT NULL AND qe IS NOT NULL) AS edges_evaluable, count(x) AS edges_matched, round(CASE WHEN count(*) FILTER (pe IS NOT NULL AND qe IS NOT NULL) = 0 THEN 1.0 ELSE count(x) / count(*) FILTER (pe IS NOT NULL AND qe IS NOT NULL) END, 6) AS ratio FROM j GROUP BY unit""",
    "cross_cu_evidence": _CALLS + """, ac AS (SELECT DISTINCT l_suppkey AS library, l_partkey % 5 AS cu FROM lineitem WHERE l_linestatus = 'O' AND l_discount > 0.05),
j AS (SELECT cu.library, p.e AS pe, q.e AS qe, ee.x FROM cu JOIN ac ka ON ka.library = cu.library AND ka.cu = cu.a JOIN ac kb ON kb.library = cu.library AND kb.cu = cu.b LEFT JOIN mp p ON p.library = cu.library AND p.cu = cu.a AND p.f = cu.af LEFT JOIN mp q ON q.library = cu.library AND q.cu = cu.b AND q.f = cu.bf LEFT JOIN ee ON ee.x = p.e AND ee.y = q.e WHERE cu.a <> cu.b),
g AS (SELECT library, count(*) AS t, count(*) FILTER (pe IS NOT NULL AND qe IS NOT NULL) AS v, count(x) AS m FROM j GROUP BY library),
k AS (SELECT *, CASE WHEN v = 0 THEN 0 ELSE m::DOUBLE / v END AS r, v::DOUBLE / t AS c FROM g)
SELECT library, t AS edges_expected, v AS edges_evaluable, m AS edges_matched, round(r, 6) AS ratio, round(c, 6) AS coverage, round(CASE WHEN v > 0 THEN least(1.0, greatest(0.0, 0.9::DOUBLE + 0.2::DOUBLE * (least(1.0::DOUBLE, v / 8.0::DOUBLE) * c) * r * (1 - 0.9::DOUBLE))) ELSE 0.9 END, 6) AS adjusted FROM k""",
    "relocation_lookup": """WITH i AS (SELECT DISTINCT l_suppkey AS unit, l_partkey * 2 AS address FROM lineitem), r AS (SELECT p_partkey % 10 + 1 AS unit, p_partkey * 2 + p_size % 2 AS o, min(p_name) AS v FROM part GROUP BY ALL)
SELECT i.unit, i.address, coalesce(a.v, b.v) AS relocation FROM i LEFT JOIN r a ON a.unit = i.unit AND a.o = i.address LEFT JOIN r b ON b.unit = i.unit AND b.o = i.address + 1""",
    "rodata_strings": """WITH s AS (SELECT doc_id, lower(trim(source)) AS source, unnest(regexp_extract_all(text, '([ -~]{4,})', 1)) AS s FROM documents WHERE text IS NOT NULL), e AS (SELECT s, count(*) AS e FROM s WHERE source = 'linker_map' GROUP BY s),
c AS (SELECT doc_id, s, count(*) AS c, CASE WHEN length(s) < 4 THEN 0 WHEN length(s) < 6 THEN 0.5::DOUBLE ELSE least(length(s), 80) END AS w FROM s GROUP BY ALL)
SELECT doc_id, sum(c)::BIGINT AS target_strings, round(coalesce(sum(least(c, coalesce(e, 0)) * w) / nullif(sum(c * w), 0), 0), 6) AS string_score FROM c LEFT JOIN e USING (s) GROUP BY doc_id""",
    "rodata_ngrams": """WITH t AS (SELECT doc_id, lower(trim(source)) AS source, hex(encode(text)) AS h FROM documents WHERE text <> ''), g AS (SELECT DISTINCT doc_id, source, g FROM (SELECT doc_id, source, unnest(list_transform(range(0, greatest(length(h) // 2 - 16, 0) + 1), lambda i: substr(h, 2 * i + 1, 32))) AS g FROM t) WHERE regexp_matches(g, '[1-9A-F]')),
e AS (SELECT DISTINCT g, 1 AS k FROM g WHERE source = 'release_note')
SELECT doc_id, count(*) AS target_grams, count(k) AS matched_grams, round(count(k) / count(*), 6) AS byte_score FROM g LEFT JOIN e USING (g) GROUP BY doc_id""",
    "rodata_evidence": """WITH m AS (SELECT DISTINCT ON (match_id) *, coalesce(windows_total > 100, false) AS so, coalesce(num_target_blocks > 20, false) AS bo FROM block_matches),
r AS (SELECT *, CASE WHEN so AND bo THEN 0.7::DOUBLE * coverage_ratio + 0.3::DOUBLE * assignment_quality WHEN so THEN coverage_ratio WHEN bo THEN 0.5::DOUBLE * assignment_quality ELSE 0 END AS rodata, num_source_blocks IS NOT NULL AND (num_source_blocks * 64 >= 512 OR coalesce(num_target_blocks, 0) >= 16 OR coalesce(windows_total, 0) >= 32) AS inf FROM m),
e AS (SELECT *, CASE WHEN NOT inf THEN 'neutral' WHEN rodata <= 0.35 THEN 'penalty' WHEN rodata >= 0.9 THEN 'confirm' ELSE 'neutral' END AS evidence FROM r)
SELECT match_id, evidence, round(rodata, 6) AS rodata, round(CASE WHEN evidence = 'confirm' THEN least(1.0, greatest(coverage_mean, coverage_mean + 0.3::DOUBLE * greatest(0.0, least(1.0, (rodata - 0.9::DOUBLE) / (1 - 0.9::DOUBLE))) * (1 - coverage_mean))) ELSE coverage_mean END, 6) AS lifted FROM e""",
    "asm_normalize": r"""
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents), i AS (SELECT DISTINCT doc_id, regexp_extract(line, '^0x[0-9a-f]+:[ \t]+([^\r]*)', 1) AS instruction FROM l),
a AS (SELECT *, trim(regexp_replace(lower(split_part(instruction, ';', 1)), '[\t\n\x0b\x0c\r ]+', ' ', 'g')) AS t FROM i WHERE instruction <> ''),
b AS (SELECT *, split_part(t, ' ', 1) AS w1, regexp_replace(t, '^[^ ]* ?', '') AS rest FROM a),
c AS (SELECT *, w1 IN ('bnd','lock','rep','repe','repne','repnz','repz') AND rest <> '' AS pre FROM b),
d AS (SELECT *, CASE WHEN pre THEN split_part(rest, ' ', 1) ELSE w1 END AS word, CASE WHEN pre THEN regexp_replace(rest, '^[^ ]* ?', '') ELSE rest END AS op FROM c),
e AS (SELECT *, CASE WHEN word = 'movabs' THEN 'mov' ELSE word END AS mn FROM d),
f AS (SELECT *, mn IN ('call','callf','jmp','jmpf','loop','loope','loopne','loopnz','loopz','xbegin') OR (starts_with(mn, 'j') AND length(mn) > 1) AS flow,
  contains(op, '[') OR contains(op, '(') OR regexp_matches(ltrim(split_part(op, ' ', 1), '%'), '""" + X.REGISTER + r"""') AS ind FROM e),
g AS (SELECT *, CASE WHEN op <> '' AND flow AND NOT ind THEN 'address' ELSE regexp_replace(regexp_replace(regexp_replace(op, '""" + X.RIP_MEMORY + r"""', '[ address ]', 'g'), '""" + X.SYMBOL + r"""', '\1address', 'g'), '""" + X.SEGMENT + r"""', '', 'g') END AS op2 FROM f),
h AS (SELECT *, """ + _TOKENS + r""" AS toks FROM g)
SELECT doc_id, instruction, trim(regexp_replace(replace(instruction, ',', ' '), '  +', ' ', 'g')) AS legacy, CASE WHEN t = '' THEN '' ELSE array_to_string(list_concat([CASE WHEN pre THEN w1 || ' ' || mn ELSE mn END], list_transform(toks, lambda x:
  CASE WHEN x IN ('[', ']', '+', '-', '*', ':', 'address') THEN x
  WHEN regexp_matches(x, '^0x[0-9a-f]+$') THEN '0x' || coalesce(nullif(ltrim(substr(x, 3), '0'), ''), '0')
  WHEN regexp_matches(x, '^[0-9]+$') AND try_cast(x AS BIGINT) IS NOT NULL THEN '0x' || printf('%x', try_cast(x AS BIGINT))
  WHEN regexp_matches(ltrim(x, '%'), '""" + X.REGISTER + r"""') OR ltrim(x, '%') IN ('byte','dword','far','fs','gs','near','oword','qword','tword','word','xmmword','ymmword','zmmword') THEN ltrim(x, '%')
  WHEN contains(x, '.') OR contains(x, '@') OR regexp_matches(x, '^[a-z_$?][0-9a-z_$?]*$') THEN 'address' ELSE x END)), ' ') END AS v2 FROM h""",
    "names": r"""WITH m AS (SELECT DISTINCT trim(archive) AS archive, trim(name) AS name FROM archive_members), x AS (SELECT *, lower(regexp_extract(archive, '[^/]*$')) AS low, regexp_extract(name, '[^/]*$') AS base FROM m)
SELECT archive, name, regexp_replace(CASE WHEN contains(low, '.a.') THEN split_part(low, '.a.', 1) || '.a' ELSE low END, '\.a$', '') AS family,
CASE WHEN regexp_matches(low, '^libc\.a(\.|$)') THEN 'glibc' WHEN regexp_matches(low, '^libpcre2-8\.a(\.|$)') THEN 'pcre2' WHEN regexp_matches(low, '^libpcre2-posix\.a(\.|$)') THEN 'pcre2-posix' WHEN regexp_matches(low, '^libiconv\.a(\.|$)') THEN 'iconv' WHEN regexp_matches(low, '^libcharset\.a(\.|$)') THEN 'charset'
WHEN regexp_matches(low, '^libgcc_eh\.a(\.|$)') THEN 'libgcc_eh' WHEN regexp_matches(low, '^libgcc\.a(\.|$)') THEN 'libgcc' WHEN regexp_matches(low, '^lib[^.]+') THEN regexp_extract(low, '^(lib[^.]+)', 1) ELSE low END AS pattern_family,
regexp_replace(regexp_replace(regexp_replace(base, '\.o$', ''), '\.c$', ''), '^(libpcre2_8_la-|libpcre2_posix_la-)', '') AS cu,
replace(lower(regexp_replace(regexp_replace(base, '\.(o|lo|obj|c|cc|cpp|cxx|s|S|asm)$', ''), '^(lib[A-Za-z0-9_]+_la-)+', '')), '-', '_') AS stem,
split_part(name, '@', 1) AS symbol, regexp_replace(archive, '[^A-Za-z0-9_.-]+', '_', 'g') AS safe, sha256(concat_ws(':', archive, name)) AS rank_key FROM x""",
    "stable_labels": """WITH a AS (SELECT DISTINCT ON (library_id) library_id, trim(archive) AS name, path, toolchain FROM library_archives), n AS (SELECT name, count(*) AS c FROM a GROUP BY name)
SELECT library_id, CASE WHEN c = 1 THEN name ELSE name || '.' || substr(sha256(coalesce(path, '-')), 1, 16) END AS label, array_to_string(list_transform(list_filter(string_split(regexp_extract(toolchain, '([0-9.]+)$', 1), '.'), lambda x: x <> ''), lambda x: x::BIGINT), '.') AS version FROM a JOIN n USING (name)""",
    "report_parse": r"""WITH l AS (SELECT doc_id, unnest(string_split_regex(text, '\r?\n')) AS line FROM documents), p AS (SELECT doc_id, line, regexp_extract(line, '^([A-Z_]+) +\|', 1) AS status FROM l WHERE regexp_matches(line, '^[A-Z_]+ +\| +[a-z_]+='))
SELECT DISTINCT doc_id, status, regexp_extract(line, '\| *library=([^|]*?) *(\||$)', 1) AS library, regexp_extract(line, '\| *cu=([^|]*?) *(\||$)', 1) AS cu, try_cast(nullif(regexp_extract(line, '\| *score=([^|]*?) *(\||$)', 1), '') AS DOUBLE) AS score,
try_cast(nullif(regexp_extract(line, '\| *windows=([0-9]+)/', 1), '') AS BIGINT) AS windows_done, try_cast(nullif(regexp_extract(line, '\| *windows=[0-9]+/([0-9]+)', 1), '') AS BIGINT) AS windows_total FROM p""",
    "linker_map_members": r"""WITH h AS (SELECT doc_id, unnest(regexp_extract_all(text, '(\S+?\.a\([^()]+\.o\))', 1)) AS h FROM documents) SELECT DISTINCT doc_id, regexp_extract(h, '^(\S+?\.a)\(', 1) AS archive, regexp_extract(h, '\(([^()]+\.o)\)', 1) AS member FROM h""",
    "feature_explode": """SELECT DISTINCT file_id, line_no, j->>'library' AS library, j->>'name' AS name, (j->>'target_cu_index')::INT AS target_cu_index, j->>'cu_status' AS cu_status, (j->>'windows_total')::INT AS windows_total
FROM (SELECT file_id, line_no, CASE WHEN json_valid(payload) THEN payload::JSON END AS j FROM feature_logs) WHERE j->>'type' = 'block_cu'""",
}
