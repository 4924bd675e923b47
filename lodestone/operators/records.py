"""Feature records: their three shapes as JSON, their strict reading, and the replay of decisions from them.

A log holds one JSON object for a unit (or several on a line). Read once into typed rows, any number of
parameter sets is replayed over them in one pass: gates, constant data, library score, cross-unit calls.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.operators import decide, rodata
from lodestone.operators.replay import GATES
from lodestone.plans.session import written

_NUMBERS = ", ".join(f"{g}:double" for g in ("coverage_mean", "coverage_min", *GATES[1:]))
_MATCH = "array<struct<target_function_index:int,source_function_index:int,dominant_ratio:double,coverage_mean:double,coverage_ratio:double,source_call_targets:array<int>>>"
_FUNCTION = "struct<index:int,name:string,address:bigint,size:bigint,blocks:int,instructions:int>"
_SPAN = "window_start:int,window_stop:int,block_start:int,block_stop:int"
_COUNTS = "call_edges_evaluated:int,call_edges_total:int"
#: A unit's record with all its fields; a shape fills the fields it has.
RECORD = (
    "type string, record_detail string, schema_version int, binary_path string, library string, asm_normalization string, palmtree_pooling string, name string, target_cu_index int, cu_status string, rodata_status string, rejection_reason string, "
    f"target_function_count int, target_functions array<{_FUNCTION}>, best_score double, {_NUMBERS.replace(':', ' ')}, call_edges_evaluated int, call_edges_total int, window_start int, window_stop int, block_start int, block_stop int, windows_total int, windows_evaluated int, windows_skipped int, "
    f"windows array<struct<{_SPAN},{_NUMBERS},{_COUNTS},function_matches:array<string>>>, function_matches array<string>, "
    "rodata double, rodata_string_score double, rodata_byte_score double, rodata_string_informative boolean, rodata_byte_informative boolean, rodata_has_rodata boolean, rodata_strings int, rodata_ngrams int, rodata_bytes int, rodata_measured boolean, "
    "inter_cu_calls array<struct<caller_function_index:int,callee_cu_index:int,callee_function_index:int>>, "
    f"selected_match struct<passed:boolean,score:double,{_NUMBERS},{_COUNTS},{_SPAN},function_matches:array<string>>, best_function_match struct<target_function_index:int,source_function_index:int,dominant_ratio:double,coverage_mean:double,coverage_ratio:double>, "
    "calls array<array<string>>"
)
#: Fields of each record shape beside those all have.
COMMON = ("schema_version", "type", "binary_path", "library", "asm_normalization", "palmtree_pooling", "name", "target_cu_index", "cu_status", "rodata_status", "record_detail")
RODATA = ("rodata", "rodata_string_score", "rodata_byte_score", "rodata_string_informative", "rodata_byte_informative", "rodata_has_rodata", "rodata_strings", "rodata_ngrams", "rodata_bytes")
SHAPES = {
    "replay": (*COMMON, "target_function_count", "best_score", "windows_total", "windows_evaluated", "windows_skipped", "windows", *RODATA, "rodata_measured", "inter_cu_calls", "selected_match", "target_functions", "best_function_match"),
    "compact": (*COMMON, "target_function_count", "rejection_reason", "best_score", "coverage_mean", "coverage_min", *GATES[1:-1], "call_edges_evaluated", "call_edges_total", "window_start", "window_stop", "block_start", "block_stop", "windows_total", "windows_evaluated", "windows_skipped", "best_function_match", "rodata"),
    "full": (*COMMON, "target_functions", *RODATA, "windows", "inter_cu_calls", "selected_match"),
}


def record_detail(status: Column, replay: bool) -> Column:
    """Which shape a unit's record takes: all ``replay``, or ``full`` for passing units and ``compact`` for others."""
    return F.lit("replay") if replay else F.when(status == "PASS", "full").otherwise("compact")


def record_json(records: DataFrame) -> DataFrame:
    """``value``: each record as a JSON object in the shape its ``record_detail`` names; fields that are null or that ``records`` lacks are left out.

    Units of full records without a window have their metrics at the top, as compact ones do.
    """
    reason = F.when(F.col("cu_status") == "DROP_RODATA", "rodata_penalty").otherwise("block_gates")
    rows = records.withColumns({"type": F.lit("block_cu"), "schema_version": F.when(F.col("record_detail") == "replay", 3).otherwise(2), "rejection_reason": reason})
    bare = F.lit(False) if "windows" not in rows.columns else F.coalesce(F.size("windows") == 0, F.lit(True))

    def shown(shape: str) -> Column:
        top = ("coverage_mean", *GATES[1:], "function_matches") if shape == "full" else ()
        cols = [F.col(c) for c in SHAPES[shape] if c in rows.columns] + [F.when(bare, F.col(c)).alias(c) for c in top if c in rows.columns]
        return F.to_json(F.struct(*cols))

    return rows.select(F.when(F.col("record_detail") == "replay", shown("replay")).when(F.col("record_detail") == "full", shown("full")).otherwise(shown("compact")).alias("value"))


def _mapping(raw: Column) -> Column:
    """Map of unit function to binary function from function matches, either objects or a flat list key, value, ...; of a key named twice the last counts."""
    pair = F.transform(raw, lambda m: F.from_json(m, "target_function_index int, source_function_index int"))
    objects = F.transform(pair, lambda p: F.struct(p["target_function_index"].alias("k"), p["source_function_index"].alias("v")))
    flat = F.transform(F.sequence(F.lit(0), F.greatest(F.size(raw) - 2, F.lit(0)), F.lit(2)), lambda i: F.struct(F.get(raw, i).cast("int").alias("k"), F.get(raw, i + 1).cast("int").alias("v")))
    entries = F.when(F.coalesce(F.size(raw), F.lit(0)) <= 0, F.array().cast("array<struct<k:int,v:int>>")).when(F.get(raw, F.lit(0)).startswith("{"), objects).when(F.size(raw) % 2 == 1, F.raise_error(F.lit("odd flattened function mapping")).cast("array<struct<k:int,v:int>>")).otherwise(flat)
    keys = F.array_distinct(F.transform(entries, lambda e: e["k"]))
    last = lambda k: F.element_at(F.filter(entries, lambda e: e["k"] == k), -1)["v"]
    return F.map_from_arrays(keys, F.transform(keys, last))


def parse_records(lines: DataFrame, payload: str, keys: list[str], strict: bool = True) -> DataFrame:
    """``keys..`` and a record's columns (``RECORD``) of every distinct unit record and call header.

    With ``strict`` a text that is no JSON is an error when it is read, else it is left out, as null texts are. Exact repeats count once.
    """
    lines = lines.filter(F.col(payload).isNotNull())
    whole = F.col("__variant").isNotNull()
    bad = F.raise_error(F.concat(F.lit("invalid JSON feature: "), F.substring(payload, 1, 60))).cast("boolean")
    rows = lines.withColumn("__variant", F.try_parse_json(payload)).filter(F.when(whole, F.lit(True)).otherwise(bad if strict else F.lit(False)))
    return rows.select(*keys, F.from_json(payload, RECORD, {"mode": "PERMISSIVE"}).alias("r")).filter("r.type in ('block_cu', 'source_call_targets')").select(*keys, "r.*").distinct()


def unit_records(parsed: DataFrame, keys: list[str]) -> DataFrame:
    """One row for each unit: what replay needs of ``parsed``, with defaults; a unit with differing records is an error when it is read.

    A record without windows is one window itself. ``windows`` are structs of the gates, ``coverage_min`` and ``mapping``. A missing
    function coverage is the share of the unit's functions that are mapped.
    """
    n = F.coalesce("target_function_count", F.size("target_functions"), F.lit(0))

    def window(get) -> Column:
        mapping = _mapping(get("function_matches"))
        share = F.when(n > 0, F.size(F.map_keys(mapping)) / n).otherwise(F.lit(0.0))
        gates = [F.coalesce(get(g), share if g == "function_coverage" else F.lit(0.0)).alias(g) for g in ("coverage_min", *GATES)]
        return F.struct(*gates, mapping.alias("mapping"))

    windows = F.when(F.size("windows") > 0, F.transform("windows", lambda w: window(lambda f: w[f]))).otherwise(F.array(window(F.col)))
    none = "array<struct<caller_function_index:int,callee_cu_index:int,callee_function_index:int>>"
    rows = parsed.filter("type = 'block_cu'").select(
        *keys, "binary_path", "library", "name", "target_cu_index", n.alias("target_function_count"), F.greatest(F.coalesce(F.size("windows"), F.lit(0)), F.lit(0)).alias("n_windows"), windows.alias("windows"), F.coalesce("inter_cu_calls", F.array().cast(none)).alias("inter_cu_calls"), F.col("rodata_string_informative").isNotNull().alias("rodata_split"),
        *(F.coalesce(c, F.lit(0.0)).alias(c) for c in ("rodata", "rodata_string_score", "rodata_byte_score")), *(F.coalesce(c, F.lit(False)).alias(c) for c in ("rodata_string_informative", "rodata_byte_informative", "rodata_has_rodata")), *(F.coalesce(c, F.lit(0)).alias(c) for c in ("rodata_strings", "rodata_ngrams", "rodata_bytes")),
    )
    unit = [*keys, "binary_path", "library", "name", "target_cu_index"]
    rest = [c for c in rows.columns if c not in unit]
    # maps cannot be compared, their JSON can
    g = rows.groupBy(*unit).agg(F.countDistinct(F.to_json(F.struct(*rest))).alias("__n"), F.first(F.struct(*rest)).alias("r"))
    clash = F.raise_error(F.concat(F.lit("conflicting records of "), F.col("name"))).cast("boolean")
    return g.filter(F.when(F.col("__n") == 1, F.lit(True)).otherwise(clash)).select(*unit, "r.*")


def source_calls(parsed: DataFrame, keys: list[str]) -> DataFrame:
    """``keys.., binary_path, caller, callee`` of the binary, from call headers ``[[function, [callees]], ...]``."""
    c = parsed.filter("type = 'source_call_targets'").select(*keys, "binary_path", F.explode("calls").alias("c"))
    return c.select(*keys, "binary_path", F.get("c", F.lit(0)).cast("int").alias("caller"), F.explode(F.from_json(F.get("c", F.lit(1)), "array<int>")).alias("callee")).distinct()


def unit_windows(units: DataFrame, keys: list[str]) -> DataFrame:
    """One row a window: ``keys.., target_cu_index, window_no``, the gates and ``mapping``."""
    return units.select(*keys, "target_cu_index", F.posexplode("windows").alias("window_no", "w")).select(*keys, "target_cu_index", "window_no", *(F.col(f"w.{g}").alias(g) for g in GATES), F.col("w.mapping").alias("mapping"))


def rodata_score(string_weight: Column, byte_only: Column) -> Column:
    """The constant-data score with the given weights; records that lack the parts keep the score they came with."""
    s, b = F.col("rodata_string_informative"), F.col("rodata_byte_informative")
    parts = F.when(s & b, string_weight * F.col("rodata_string_score") + (1 - string_weight) * F.col("rodata_byte_score")).when(s, F.col("rodata_string_score")).when(b, byte_only * F.col("rodata_byte_score")).otherwise(F.lit(0.0))
    return F.when(F.col("rodata_split"), parts).otherwise(F.col("rodata"))


#: What a configuration row may set beside the gates; fixed values.
DEFAULTS = {
    "rodata_on": True, "rodata_min_bytes": 512, "rodata_min_strings": 16, "rodata_min_ngrams": 32, "rodata_penalty": 0.35, "rodata_confirm": 0.90, "rodata_bonus": 0.30, "rodata_string_weight": 0.70, "rodata_byte_only": 0.50,
    "cross_bonus": 0.20, "cross_penalty": 0.0, "cross_saturation": 8, "library_min_score": 0.0,
}


def with_defaults(configs: DataFrame, **given) -> DataFrame:
    """``configs`` with every setting replay reads that it lacks."""
    wanted = DEFAULTS | {f"min_{g}": 0.0 for g in GATES} | given
    return configs.withColumns({k: F.lit(v) for k, v in wanted.items() if k not in configs.columns})


def unit_settings(configs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``configs`` with ``rep``, the first configuration that treats units alike, and the configurations that are their own ``rep``.

    Cross-unit calls and the library's threshold come after the units, so configurations that differ only in these share a replay of units.
    """
    alike = [c for c in configs.columns if c.startswith("min_") or c.startswith("rodata_")]
    linked = configs.withColumn("rep", F.min("config").over(Window.partitionBy(*alike)))
    return linked, linked.filter("config = rep")


def replay_units(windows: DataFrame, units: DataFrame, configs: DataFrame, keys: list[str], passing: bool = False) -> DataFrame:
    """Of every configuration and unit whether it passes, is penalised, its score, and the mapping of its best passing window.

    ``config, keys.., target_cu_index, passed, penalised, score, mapping``. The configurations are a table of settings, a row
    each, and are broadcast; windows are scanned once and reduced to one row a unit before any join. With ``passing`` only units that pass come out.
    """
    settings = F.broadcast(configs)
    ok = F.lit(True)
    for g in GATES:
        ok = ok & (F.coalesce(F.col(g), F.lit(0.0)) >= F.col(f"min_{g}"))
    best = F.max(F.when(ok, F.struct("coverage_mean", (-F.col("window_no")).alias("early"), "window_no"))).alias("b")
    per = windows.crossJoin(settings.select("config", *(f"min_{g}" for g in GATES))).groupBy("config", *keys, "target_cu_index").agg(best)
    per = per.filter("b is not null") if passing else per
    # the mapping is fetched by window number, as it need not travel with every configuration
    chosen = windows.select(*keys, "target_cu_index", "window_no", "mapping")
    per = per.withColumn("window_no", F.col("b.window_no")).join(chosen, [*keys, "target_cu_index", "window_no"], "left")
    facts = units.select(*keys, "target_cu_index", "inter_cu_calls", "rodata", "rodata_split", "rodata_string_score", "rodata_byte_score", "rodata_string_informative", "rodata_byte_informative", "rodata_has_rodata", "rodata_strings", "rodata_ngrams", "rodata_bytes")
    j = per.join(facts, [*keys, "target_cu_index"]).join(settings.drop(*(f"min_{g}" for g in GATES)), "config")
    informative = F.col("rodata_on") & F.col("rodata_has_rodata") & ((F.col("rodata_bytes") >= F.col("rodata_min_bytes")) | (F.col("rodata_strings") >= F.col("rodata_min_strings")) | (F.col("rodata_ngrams") >= F.col("rodata_min_ngrams")))
    score = rodata_score(F.col("rodata_string_weight"), F.col("rodata_byte_only"))
    block = F.col("b.coverage_mean")
    conf = F.when(F.col("rodata_confirm") >= 1, F.lit(1.0)).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), (score - F.col("rodata_confirm")) / (1 - F.col("rodata_confirm")))))
    lifted = F.when(informative & (score >= F.col("rodata_confirm")) & (F.col("rodata_bonus") > 0), F.least(F.lit(1.0), F.greatest(block, block + F.col("rodata_bonus") * conf * (1 - block)))).otherwise(block)
    return j.select("config", *keys, "target_cu_index", F.col("b").isNotNull().alias("passed"), (informative & (score <= F.col("rodata_penalty"))).alias("penalised"), lifted.alias("score"), "mapping", "inter_cu_calls", score.alias("rodata_score"))


def replay_libraries(units: DataFrame, elf_calls: DataFrame, configs: DataFrame, case: list[str], keys: list[str], mode: str = "top3_mean", pairs: DataFrame | None = None) -> DataFrame:
    """Of every configuration and library its accepted units, its score after the cross-unit calls, and the decision.

    ``units`` from ``replay_units``, of every configuration or of each ``rep`` (see ``unit_settings``); ``elf_calls(case.., caller, callee)`` is the binary's call graph. A call counts as expected if both
    its units are accepted, as evaluable if both functions are mapped. ``pairs(keys..)`` come out for every configuration, with zeros where none of
    their units passes.
    ``config, keys.., accepted, penalised, library_score, edges_expected, edges_evaluable, edges_matched, adjusted, predicted``.
    """
    units = written(units, "replayed-units")
    scores = decide.library_evidence(units, ["config", *keys], "score", "passed", "penalised", mode)
    got = units.filter("passed and not penalised")
    calls = got.select("config", *keys, "mapping", F.explode("inter_cu_calls").alias("e"))
    calls = calls.select("config", *keys, F.col("e.callee_cu_index").alias("target_cu_index"), F.get(F.map_values(F.map_filter("mapping", lambda k, v: k == F.col("e.caller_function_index"))), F.lit(0)).alias("caller"), F.col("e.callee_function_index").alias("__f"))
    ends = got.select("config", *keys, "target_cu_index", F.col("mapping").alias("__m"))
    e = calls.join(ends, ["config", *keys, "target_cu_index"]).withColumn("callee", F.get(F.map_values(F.map_filter("__m", lambda k, v: k == F.col("__f"))), F.lit(0)))
    hit = elf_calls.select(*case, "caller", "callee").distinct().withColumn("__hit", F.lit(1))
    both = F.col("caller").isNotNull() & F.col("callee").isNotNull()
    ev = e.join(hit, [*case, "caller", "callee"], "left").groupBy("config", *keys).agg(F.count(F.lit(1)).alias("edges_expected"), F.count_if(both).alias("edges_evaluable"), F.count_if(both & F.col("__hit").isNotNull()).alias("edges_matched"))
    linked = configs if "rep" in configs.columns else configs.withColumn("rep", F.col("config"))
    linked = F.broadcast(linked.select("rep", "config", "cross_bonus", "cross_penalty", "cross_saturation", "library_min_score"))
    j = scores.join(ev, ["config", *keys], "left").withColumnRenamed("config", "rep")
    j = j.join(linked, "rep") if pairs is None else pairs.select(*keys).distinct().crossJoin(linked).join(j, ["rep", *keys], "left")
    j = j.fillna(0, ["accepted", "penalised", "library_score", "edges_expected", "edges_evaluable", "edges_matched"])
    n, exp, m, s = (F.col(c) for c in ("edges_evaluable", "edges_expected", "edges_matched", "library_score"))
    rel = F.least(F.lit(1.0), n / F.greatest(F.col("cross_saturation"), F.lit(1))) * n / exp
    moved = s + F.col("cross_bonus") * rel * (m / n) * (1 - s) - F.col("cross_penalty") * rel * (1 - m / n) * s
    adjusted = F.when((n > 0) & ((F.col("cross_bonus") != 0) | (F.col("cross_penalty") != 0)), F.least(F.lit(1.0), F.greatest(F.lit(0.0), moved))).otherwise(s)
    j = j.withColumn("adjusted", adjusted)
    return j.select("config", *keys, "accepted", "penalised", "library_score", "edges_expected", "edges_evaluable", "edges_matched", "adjusted", ((F.col("accepted") > 0) & (F.col("adjusted") >= F.col("library_min_score"))).alias("predicted"))


def causes(expected: DataFrame, windows: DataFrame, units: DataFrame, aliases: DataFrame, keys: list[str], gates: Mapping[str, float], settings: Mapping[str, object] = {}) -> DataFrame:
    """Why each expected but missed identity was missed: ``keys.., depth, category``.

    ``expected(keys..)`` are the misses, ``aliases(keys..)`` those that another name with the same content was seen for. In order:
    ``record_absent_alias_available``, ``record_absent``, ``candidate_below_two_functions``, ``record_present_no_windows``, ``failed_<gate>`` for the
    first gate that the deepest window fails, ``failed_rodata``, and ``unexpected_record_pass``.
    """
    from lodestone.operators.replay import gate_depth

    given = DEFAULTS | dict(settings)
    score = rodata_score(F.lit(given["rodata_string_weight"]), F.lit(given["rodata_byte_only"]))
    inf = F.lit(given["rodata_on"]) & rodata.informative(F.col("rodata_has_rodata"), F.col("rodata_bytes"), F.col("rodata_strings"), F.col("rodata_ngrams"), True, given["rodata_min_bytes"], given["rodata_min_strings"], given["rodata_min_ngrams"])
    facts = units.select(*keys, "target_cu_index", "target_function_count", "n_windows", (inf & (score <= given["rodata_penalty"])).alias("__pen"))
    deep = windows.groupBy(*keys, "target_cu_index").agg(F.max(gate_depth(gates)).alias("depth"))
    # a record that stands for its only window has none of its own
    per = facts.join(deep, [*keys, "target_cu_index"], "left").withColumn("depth", F.when(F.col("n_windows") > 0, F.col("depth")))
    full = len(gates)
    seen = per.groupBy(*keys).agg(F.count(F.lit(1)).alias("records"), F.max("target_function_count").alias("functions"), F.sum("n_windows").alias("windows"), F.coalesce(F.max("depth"), F.lit(0)).alias("depth"), F.bool_or((F.col("depth") == full) & ~F.col("__pen")).alias("clean"))
    known = aliases.select(*keys).distinct().withColumn("__alias", F.lit(True))
    j = expected.select(*keys).distinct().join(seen, keys, "left").join(known, keys, "left")
    failed = F.concat(F.lit("failed_"), F.array(*map(F.lit, gates))[F.least(F.col("depth"), F.lit(full - 1))])
    category = (
        F.when(F.col("records").isNull(), F.when(F.col("__alias"), "record_absent_alias_available").otherwise("record_absent"))
        .when(F.col("functions") < 2, "candidate_below_two_functions").when(F.col("windows") == 0, "record_present_no_windows")
        .when(F.col("depth") < full, failed).when(~F.coalesce("clean", F.lit(False)), "failed_rodata").otherwise("unexpected_record_pass")
    )
    return j.select(*keys, F.coalesce("depth", F.lit(0)).alias("depth"), category.alias("category"))
