"""Checks, selections, plans, stores and small text operators over the test tables, with checking SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions import text as X
from lodestone.operators import coordinates as O
from lodestone.operators import decide as D
from lodestone.operators import metrics as K
from lodestone.operators import planning as A
from lodestone.operators import quality as V
from lodestone.operators import rodata as R
from lodestone.operators import scenario as C
from lodestone.operators import similarity as M
from lodestone.operators import store as E
from lodestone.operators import structure as S
from lodestone.operators import truth as T
from lodestone.plans.session import shared_dir, table, written
from lodestone.queries import decisions as Q
from lodestone.sources import readers


def symbol_functions(spark: SparkSession, d: str) -> DataFrame:
    """Every block as a symbol, those of one instruction being objects: which stand for functions?"""
    b = table(spark, d, "blocks").dropDuplicates(["block_id"]).withColumn("kind", F.when(F.col("n_instructions") > 1, "FUNC").otherwise("OBJECT"))
    return S.symbol_functions(b, "kind", "raw_size", "address").select("block_id", "address", "raw_size")


def address_order(spark: SparkSession, d: str) -> DataFrame:
    b = table(spark, d, "blocks").dropDuplicates(["block_id"])
    return S.indexed(b.select("unit_type", "unit_id", "block_id", "address"), ["unit_type", "unit_id"], ["address", "block_id"], "place").select("block_id", "place")


def rodata_sections(spark: SparkSession, d: str) -> DataFrame:
    """The paragraphs of each text as sections of which some are no constant data and some have a wrong size."""
    s = table(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n\n")).alias("no", "data"))
    name = F.element_at(F.array(*map(F.lit, (".rodata", ".text", ".rodata.str1.1"))), F.col("no") % 3 + 1)
    size = F.octet_length("data") + F.when(F.col("no") % 5 == 4, 1).otherwise(0)
    out = R.constant_sections(s.withColumns({"name": name, "size": size}), ["doc_id"], "name", "size", "data", "no")
    return out.select("doc_id", F.octet_length("data").alias("bytes"), F.size("strings").alias("strings"), "n_sections", F.md5("data").alias("digest"))


def marked_records(spark: SparkSession, d: str) -> DataFrame:
    """Lines with a unit's marker, before any is parsed."""
    lines = readers.marked(table(spark, d, "feature_logs"), "payload", '"block_cu"')
    return lines.groupBy("campaign_id").agg(F.count(F.lit(1)).alias("lines"), F.countDistinct("file_id").alias("files"))


def report_settings(spark: SparkSession, d: str) -> DataFrame:
    return readers.report_settings(table(spark, d, "documents"), "doc_id", "text")


def report_fractions(spark: SparkSession, d: str) -> DataFrame:
    """The numbers of every report line, summed by text."""
    lines = table(spark, d, "documents").select("doc_id", F.explode(F.split("text", "\r?\n")).alias("line")).filter(F.col("line").rlike(r"^[A-Z_]+ +\| +[a-z_]+="))
    n = readers.report_numbers("line")
    return lines.select("doc_id", *(n[k].alias(k) for k in ("windows_done", "windows_total", "score"))).groupBy("doc_id").agg(F.count(F.lit(1)).alias("lines"), F.sum("windows_done").alias("windows_done"), F.sum("windows_total").alias("windows_total"), F.round(F.sum("score"), 6).alias("score"))


def report_lines(spark: SparkSession, d: str) -> DataFrame:
    """What a report says of a library: best score of any match and of passing ones, confirmed and penalised matches, units and blocks matched."""
    w = Q._windows(spark, d)
    ok = F.coalesce("passed", F.lit(False))
    return w.groupBy("library").agg(
        F.max("coverage_mean").alias("best_any"), F.max(F.when(ok, F.col("coverage_mean"))).alias("best_matched"), F.count_if(ok & (F.col("coverage_ratio") >= 0.9)).alias("confirmed"), F.count_if(F.col("cu_status") == "DROP_RODATA").alias("penalised"),
        F.countDistinct(F.when(ok, F.struct("build_id", "target_cu_index"))).alias("matched_cus"), F.coalesce(F.sum(F.when(ok, F.col("num_target_blocks"))), F.lit(0)).alias("matched_blocks"),
    )


def linker_sections(spark: SparkSession, d: str) -> DataFrame:
    """Members that the inclusion section of each linker map lists; the test maps' section has another title."""
    maps = table(spark, d, "documents").select("doc_id", F.regexp_replace("text", "Archive members pulled in", "Archive member included").alias("text"))
    maps = maps.withColumn("text", F.regexp_replace("text", r"(?m)^[ \t]*\.[a-z]+[ \t]+0x[0-9a-f]+[ \t]+[0-9]+[ \t]+", ""))
    return T.linker_map_members(maps, "doc_id", "text").distinct()


def confirmed_units(spark: SparkSession, d: str) -> DataFrame:
    """Ground truth in both encodings: odd references list names, even ones units with flags."""
    r = table(spark, d, "elf_archives").dropDuplicates(["ref_id"])
    method = F.when(F.col("selected_by_linker"), "linker_map").when(F.col("resolved"), "symbol_table").otherwise("none")
    n, inc = F.coalesce("total_compilation_units", F.lit(0)), F.coalesce("included_compilation_units", F.lit(0))
    name = lambda i: F.concat(F.lit("obj/cu_"), i, F.lit(".c.o"))
    upto = lambda k: F.when(k > 0, F.sequence(F.lit(1), k)).otherwise(F.array().cast("array<int>"))
    odd = F.col("ref_id") % 2 == 1
    t = r.select("ref_id", F.when(odd, F.transform(upto(inc), name)).alias("confirmed_compilation_units"), method.alias("confirmed_compilation_units_method"), F.when(~odd, F.transform(upto(n), lambda i: F.struct(name(i).alias("compilation_unit"), (i <= inc).alias("included"), method.alias("ground_truth_method")))).alias("compilation_units"))
    return T.confirmed_units(t, ["ref_id"])


def present_archives(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, "elf_archives").dropDuplicates(["ref_id"])
    return r.groupBy(F.trim("archive_basename").alias("library")).agg(F.count_if(T.present(F.col("included_compilation_units"))).alias("present"), F.count(F.lit(1)).alias("refs"))


def cu_metrics(spark: SparkSession, d: str) -> DataFrame:
    """Unit identities of each build and library: matched units against those the archive's members name."""
    m = table(spark, d, "block_matches")
    pred = m.filter("passed and cu_name is not null").select("build_id", F.trim("library").alias("library"), X.cu_name(F.col("cu_name")).alias("cu"))
    members = table(spark, d, "archive_members").filter("name is not null and n_functions >= 2").select(F.trim("archive_basename").alias("library"), X.cu_name(F.col("name")).alias("cu")).distinct()
    e = table(spark, d, "elf_archives").groupBy("build_id", F.trim("archive_basename").alias("library")).agg(F.bool_or("selected_by_linker").alias("expected"))
    cand = m.select("build_id", F.trim("library").alias("library")).distinct().join(e, ["build_id", "library"], "left").join(members.select("library", F.lit(True).alias("labelled")).distinct(), "library", "left")
    return K.cu_metrics(pred, members, cand, ["build_id", "library"], unit_keys=["library"])


def exact_builds(spark: SparkSession, d: str) -> DataFrame:
    """Decisions judged by family, and by single library."""
    x = Q._decisions(spark, d)
    fam = X.pattern_family(F.regexp_replace("library", "(_rt|-core|-io)?\\.a$", ".a"))
    return K.evaluated(x, "build_id", fam).withColumn("mode", F.lit("family")).unionByName(K.evaluated(x, "build_id", fam, exact=True).withColumn("mode", F.lit("exact")))


def prediction_totals(spark: SparkSession, d: str) -> DataFrame:
    """Predictions and their units, by optimization."""
    m = table(spark, d, "block_matches").groupBy("build_id", F.trim("library").alias("library")).agg(F.count_if("passed").alias("cu_tp"), F.count_if(~F.col("passed")).alias("cu_fp"))
    return Q._judged(spark, d).join(m, ["build_id", "library"], "left").groupBy("optimization").agg(*K.counts(), F.sum(F.coalesce("cu_tp", F.lit(0))).alias("cu_passed"), F.sum(F.coalesce("cu_fp", F.lit(0))).alias("cu_failed"))


def _edges(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem")
    return li.select(F.col("l_suppkey").alias("library"), (F.col("l_partkey") % 5).alias("caller_cu"), F.col("l_linenumber").cast("long").alias("caller_function"), (F.col("l_orderkey") % 5).alias("callee_cu"), (F.col("l_quantity").cast("int") % 7 + 1).cast("long").alias("callee_function")).filter("caller_cu <> callee_cu")


def function_edges(spark: SparkSession, d: str) -> DataFrame:
    return S.call_edge_counts(_edges(spark, d), ["library"])[0]


def unit_edges(spark: SparkSession, d: str) -> DataFrame:
    return S.call_edge_counts(_edges(spark, d), ["library"])[1]


def build_requirements(spark: SparkSession, d: str) -> DataFrame:
    """Archives with builds enough of each kind, and those of which one build exists with several paths."""
    a = table(spark, d, "library_archives").filter("status = 'selected'").withColumn("archive", F.trim("archive"))
    return A.diversity(a, "archive", {"role": 2, "toolchain": 3, "optimization": 2}, F.coalesce("path", F.lit("")))


def store_inventory(spark: SparkSession, d: str) -> DataFrame:
    b = table(spark, d, "blocks").dropDuplicates(["block_id"])
    builds, libs = table(spark, d, "build_info").select(F.col("build_id").alias("unit_id"), F.lit("ELF").alias("unit_type")), table(spark, d, "library_archives").select(F.col("library_id").alias("unit_id"), F.lit("CU").alias("unit_type"))
    return V.inventory(builds.unionByName(libs), b, "unit_type", "unit_id", "raw_size")


def store_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """All blocks as entries of a content-addressed store, written in two batches of which the second repeats the first, and read back."""
    b = table(spark, d, "blocks").dropDuplicates(["block_id"])
    e = b.select(E.canonical_digest({"unit": F.concat_ws("/", "unit_type", "unit_id"), "block": F.col("block_id"), "address": F.col("address")}).alias("key"), F.col("unit_type").alias("archive"), "block_id", "function_index", "raw_size")
    e, path = written(e, "entries"), f"{shared_dir(spark)}/lodestone/{spark.sparkContext.applicationId}/store-{uuid.uuid4().hex}"
    E.write_entries(e, path)
    E.write_entries(e.filter("archive = 'CU'"), path)
    back = E.read_entries(spark, path, "key string, block_id bigint, function_index int, raw_size int, archive string")
    lost = E.differences(e, back).agg(F.sum("rows").alias("lost"))
    return E.archive_index(back, "archive", "function_index").crossJoin(F.broadcast(lost))


def cache_misses(spark: SparkSession, d: str) -> DataFrame:
    """Digests that references ask for and no selected reference brings."""
    r = table(spark, d, "elf_archives")
    return E.misses(r.select(F.col("archive_sha256").alias("key")), r.filter("selected_by_linker").select(F.col("archive_sha256").alias("key")).distinct())


def feature_reuse(spark: SparkSession, d: str) -> DataFrame:
    """References of each build whose matches were made at the build's own version of the tables, and those to collect again."""
    r = table(spark, d, "elf_archives").select("build_id", F.trim("archive_basename").alias("library"), F.col("compiler").alias("profile"), F.col("optimization").alias("signature")).distinct()
    m = table(spark, d, "block_matches").join(table(spark, d, "elf_archives").select("build_id", F.col("compiler").alias("profile"), F.col("optimization").alias("signature")).distinct(), "build_id").select("build_id", F.trim("library").alias("library"), "profile", "signature").distinct()
    reused, missing = E.reusable(r, m, ["build_id", "library"], "profile", "signature")
    n = lambda x, s: x.groupBy("build_id").agg(F.count(F.lit(1)).alias("pairs")).withColumn("state", F.lit(s))
    return n(reused, "reused").unionByName(n(missing, "missing"))


def canonical_digests(spark: SparkSession, d: str) -> DataFrame:
    b = table(spark, d, "build_info").dropDuplicates(["build_id"])
    return b.select("build_id", E.canonical_digest({"variant": F.col("variant"), "build": F.col("build_id"), "size": F.col("binary_size")}).alias("digest"))


def combined_digests(spark: SparkSession, d: str) -> DataFrame:
    """One digest for each unit over its blocks' addresses."""
    b = table(spark, d, "blocks").dropDuplicates(["block_id"]).withColumn("content", F.col("address").cast("string"))
    return E.combined_digest(b, ["unit_type", "unit_id"], "block_id", "content")


def archive_set_gaps(spark: SparkSession, d: str) -> DataFrame:
    """Catalog archives that nothing refers to, and referenced ones that the catalog lacks."""
    a = table(spark, d, "library_archives").filter("status = 'selected'").select(F.trim("archive").alias("archive"))
    r = table(spark, d, "elf_archives").select(F.trim("archive_basename").alias("archive")).filter("archive <> ''")
    return V.set_gaps(a, r, ["archive"])


def feature_completeness(spark: SparkSession, d: str) -> DataFrame:
    """References without a match, or whose matches all lack a score or a call ratio."""
    r = table(spark, d, "elf_archives").select("build_id", F.trim("archive_basename").alias("library")).filter("library <> ''")
    m = table(spark, d, "block_matches").withColumn("library", F.trim("library"))
    return V.completeness(r, m, ["build_id", "library"], ["score", "call_edge_ratio"])


def duplicate_members(spark: SparkSession, d: str) -> DataFrame:
    m = table(spark, d, "archive_members").dropDuplicates(["member_id"]).select(F.trim("archive_basename").alias("archive"), "name", F.lower("object_sha256").alias("sha")).filter("name is not null and archive is not null")
    return V.repeated_identities(m, ["archive", "name"], "sha")


def report_conflicts(spark: SparkSession, d: str) -> DataFrame:
    """Libraries of which the statuses say another number of passing matches than the flags."""
    m = table(spark, d, "block_matches").dropDuplicates(["match_id"])
    said = m.groupBy("library").agg(F.count_if("passed").alias("accepted"))
    return V.report_conflicts(m, said, ["library"], F.col("cu_status") == "PASS", "accepted")


def shard_checks(spark: SparkSession, d: str) -> DataFrame:
    """All matches in shards by the month of the match: libraries that a shard lacks, matches that occur twice or in two shards."""
    m = table(spark, d, "block_matches").select("match_id", "library", F.date_format("matched_at", "yyyy-MM").alias("shard")).filter("shard is not null")
    return V.shard_violations(m, "shard", ["library"], ["match_id"])


def record_checks(spark: SparkSession, d: str) -> DataFrame:
    m = table(spark, d, "block_matches").dropDuplicates(["match_id"])
    members = table(spark, d, "archive_members").dropDuplicates(["member_id"]).select(F.trim("archive_basename").alias("library"), F.col("occurrence").alias("target_cu_index"), "name", "n_functions")
    return V.record_violations(m, ["library"], "target_cu_index", "cu_status", "passed", members, ["name", "n_functions"])


def truth_conflicts(spark: SparkSession, d: str) -> DataFrame:
    """Linked archives against the builds' matches as a manifest: passing ones are expected, others explicit negatives."""
    t = table(spark, d, "elf_archives").filter("selected_by_linker and trim(archive_basename) <> ''").groupBy("build_id", F.trim("archive_basename").alias("library")).agg(F.max("compiler").alias("compiler"))
    b = Q._builds(spark, d).select("build_id", "compiler")
    m = table(spark, d, "block_matches").groupBy("build_id", F.trim("library").alias("library")).agg(F.bool_or("passed").alias("expected")).join(b, "build_id")
    return V.truth_conflicts(t, m, "build_id", "library", ["compiler"])


def audit_counts(spark: SparkSession, d: str) -> DataFrame:
    """Function counts of all members as one audit file a library, read back."""
    m = table(spark, d, "archive_members").filter("name is not null and n_functions is not null and archive_basename is not null").groupBy(F.trim("archive_basename").alias("archive"), "name").agg(F.max("n_functions").alias("n"))
    units = F.map_from_entries(F.collect_list(F.struct("name", "n")))
    files = m.groupBy("archive").agg(F.to_json(F.create_map(F.col("archive"), units)).alias("payload"))
    return V.audit_counts(files.withColumn("file", F.col("archive")), "file", "payload").select("archive", "cu", "functions")


def decision_matrix(spark: SparkSession, d: str) -> DataFrame:
    """Every build with every library of the matches: decided, or MISSING."""
    x = Q._decisions(spark, d).filter("predicted is not null").select("build_id", "library", "predicted")
    libs = x.agg(F.collect_set("library").alias("libs"))
    # one row: the names of the libraries
    cells = table(spark, d, "build_info").select("build_id").distinct().crossJoin(F.broadcast(libs)).select("build_id", F.explode("libs").alias("library"))
    j = cells.join(x, ["build_id", "library"], "left")
    return j.groupBy("library").agg(F.count_if("predicted").alias("yes"), F.count_if(~F.col("predicted")).alias("no"), F.count_if(F.col("predicted").isNull()).alias("missing"))


def masked_mean_units(spark: SparkSession, d: str) -> DataFrame:
    """Vectors pooled over the blocks of five instructions or more; units without any pool to zeros."""
    b = table(spark, d, "blocks").dropDuplicates(["block_id"]).withColumn("counts", F.col("n_instructions") >= 5)
    ok = F.forall("normalized_embeddings", lambda x: x.isNotNull() & ~F.isnan(x))
    return M.pooled(b.filter(ok), ["unit_type", "unit_id"], "normalized_embeddings", "counts").withColumn("value", F.round("value", 6))


def _labels(spark: SparkSession, d: str) -> DataFrame:
    x = Q._judged(spark, d).filter("program <> '-'").withColumn("family", X.archive_family(F.col("library")))
    return x.groupBy("program").agg(F.countDistinct("build_id").alias("cases"), F.count_if("expected").alias("positive"), F.count_if(~F.col("expected")).alias("negative"), F.collect_set(F.when(F.col("expected"), F.col("family"))).alias("families"))


def balanced_folds(spark: SparkSession, d: str) -> DataFrame:
    """Programs in four folds with both labels in each: which program lies where is the deal's, that every one lies somewhere is checked."""
    labels = written(_labels(spark, d), "labels")
    f = A.balanced_folds(labels, "program", 4)
    j = f.join(labels.select("program", "positive", "negative"), "program")
    per = j.groupBy("fold").agg(F.sum("positive").alias("p"), F.sum("negative").alias("n"))
    return j.join(F.broadcast(per), "fold").select("program", "cases", ((F.col("p") > 0) & (F.col("n") > 0)).alias("usable"), F.col("fold").between(0, 3).alias("placed"))


def covering_cases(spark: SparkSession, d: str) -> DataFrame:
    """Builds of each optimization that together link all its libraries; every library of the optimization is one a chosen build links."""
    e = table(spark, d, "elf_archives").filter("selected_by_linker").select("optimization", "build_id", F.trim("archive_basename").alias("library")).dropna().distinct()
    chosen = A.covering_cases(e, "optimization", "build_id", "library")
    return e.join(chosen, ["optimization", "build_id"]).select("optimization", "library").distinct()


def quota_cases(spark: SparkSession, d: str) -> DataFrame:
    return A.quota_cases(Q._builds(spark, d), ["compiler", "optimization"], 3, "build_id").select("build_id", "compiler", "optimization")


def archive_pools(spark: SparkSession, d: str) -> DataFrame:
    linked = table(spark, d, "elf_archives").filter("selected_by_linker").select(F.col("build_id").alias("case"), F.trim("archive_basename").alias("archive"))
    scored = table(spark, d, "block_matches").select(F.col("build_id").alias("case"), F.trim("library").alias("archive"), "score")
    cat = table(spark, d, "library_archives").filter("status = 'selected'").select(F.trim("archive").alias("archive"), "role", F.col("toolchain").alias("compiler"), "optimization")
    return A.archive_pools(linked, scored, cat, hard=1, least_builds=4)


def version_plan(spark: SparkSession, d: str) -> DataFrame:
    """A version of each library for each program that links it, spread evenly: no version is used two times more than another."""
    r = table(spark, d, "elf_archives").join(Q._builds(spark, d).select("build_id", "program"), "build_id").select(F.trim("archive_basename").alias("library"), "program")
    v = table(spark, d, "library_archives").filter("status = 'selected'").select(F.trim("archive").alias("library"), "role")
    v = written(v.distinct(), "versions")
    n = A.version_plan(r, v, "library", "program", "role").groupBy("library", "role").agg(F.count(F.lit(1)).alias("n"))
    # versions that were never taken count as zero
    full = v.dropna().join(r.select("library").dropna().distinct(), "library").join(n, ["library", "role"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return full.groupBy("library").agg(F.sum("n").alias("programs"), F.count(F.lit(1)).alias("versions"), (F.max("n") - F.min("n") <= 1).alias("even"))


def cohort_cells(spark: SparkSession, d: str) -> DataFrame:
    """Each toolchain and optimization of the catalog takes half of the programs, from an offset of its own on."""
    c = table(spark, d, "library_archives").select("toolchain", "optimization").dropna().distinct()
    c = c.withColumns({"family": F.split("toolchain", "-")[0], "program_count": F.lit(20), "cohort_offset": F.ascii("optimization") + F.ascii(F.substring("optimization", 2, 1)) + F.length("toolchain")})
    p = Q._builds(spark, d).filter("program is not null").groupBy("program").agg(F.collect_set(F.split("compiler", "-")[0]).alias("supports"))
    return T.cohort_cells(c, p, "program").select("program", "toolchain", "optimization")


def position_ranges(spark: SparkSession, d: str) -> DataFrame:
    return T.position_ranges(T.sharded(Q._builds(spark, d).select("build_id"), ["build_id"], 4), 100).select("first", "last", "n")


def prefix_limit(spark: SparkSession, d: str) -> DataFrame:
    """The first hundred builds: a limit on inputs, taken after a total order."""
    return Q._builds(spark, d).orderBy("build_id").limit(100).select("build_id")


def frequent_libraries(spark: SparkSession, d: str) -> DataFrame:
    """Libraries by falling number of matches, then by name, with their place."""
    from pyspark.sql import Window

    n = table(spark, d, "block_matches").groupBy("library").agg(F.count(F.lit(1)).alias("n"), F.count_if("passed").alias("passed"))
    return n.withColumn("place", F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(F.desc("n"), F.desc("passed"), "library")))


def path_names(spark: SparkSession, d: str) -> DataFrame:
    """Coordinates, labels and spellings that paths give."""
    p = table(spark, d, "elf_archives").select(F.trim("archive").alias("path")).filter("path <> ''").distinct()
    c = X.path_coordinates(F.col("path"))
    return p.select("path", *(v.alias(k) for k, v in c.items()), X.path_label(F.col("path")).alias("path_label"), X.source_build(F.concat(F.lit("/src/util-linux-v2."), F.length("path"))).alias("source_build"))


def identities(spark: SparkSession, d: str) -> DataFrame:
    """Unit identities rendered and parsed again."""
    m = table(spark, d, "archive_members").select(F.trim("archive_basename").alias("a"), "name", "object_sha256").distinct()
    r = m.withColumn("identity", X.render_identity(F.col("a"), F.col("name"), F.concat(F.lit("sha256:"), F.col("object_sha256"))))
    return r.select("identity", X.parse_identity(F.col("identity"), ["family", "cu", "content"]).alias("p")).select("identity", "p.*").distinct()


def times(spark: SparkSession, d: str) -> DataFrame:
    b = table(spark, d, "build_info").dropDuplicates(["build_id"])
    return b.select("build_id", X.iso_time(F.col("built_at")).alias("built"), X.clock(F.coalesce("binary_size", F.lit(0))).alias("clock"))


def whole_numbers(spark: SparkSession, d: str) -> DataFrame:
    """Every word of every disassembly note that is a decimal or hexadecimal number."""
    w = table(spark, d, "documents").filter(F.lower(F.trim("source")) == "disasm_note").select(F.explode(F.split("text", r"[\s,;:\[\]+]+")).alias("word")).distinct()
    return w.select("word", O.whole_number(F.col("word")).alias("value")).filter("value is not null")


def pair_maps(spark: SparkSession, d: str) -> DataFrame:
    """The order lines of each supplier's part as a flat list line, quantity, ...; the last quantity of a line number counts."""
    li = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", F.col("l_quantity").cast("int").alias("q")))), lambda x: F.array(x["l_linenumber"] % 3, x["q"]))).alias("flat"))
    m = li.select("l_orderkey", O.pair_map(F.col("flat")).alias("m"))
    return m.select("l_orderkey", F.explode("m").alias("k", "v"))


def useful_symbols(spark: SparkSession, d: str) -> DataFrame:
    """Symbols of all order lines, their status and flag standing for the kind."""
    kind = F.when(F.col("l_returnflag") == "R", "U").when(F.col("l_returnflag") == "A", "w").otherwise("T")
    symbol = F.when(F.col("l_linenumber") == 7, "$d").when(F.col("l_linenumber") == 6, "").otherwise(F.concat(F.lit("s"), F.col("l_suppkey")))
    li = table(spark, d, "lineitem").select(kind.alias("kind"), symbol.alias("symbol"))
    return li.filter(O.useful_symbol(F.col("kind"), F.col("symbol"))).groupBy("kind", "symbol").agg(F.count(F.lit(1)).alias("n"))


def selectors(spark: SparkSession, d: str) -> DataFrame:
    """The baseline build of each binary, and with the linked archive's optimization or version in its place."""
    b = Q._builds(spark, d).select("build_id", F.col("compiler").alias("bc"), F.col("optimization").alias("bo"))
    r = table(spark, d, "elf_archives").dropDuplicates(["ref_id"]).join(b, "build_id")
    base = C.selectors(F.col("bc"), F.col("bo"))
    moved = C.selectors(F.col("bc"), F.col("bo"), optimization=F.lower("optimization"), role=F.col("version_role"))
    return r.select("ref_id", *(v.alias(f"base_{k}") for k, v in base.items()), *(v.alias(f"moved_{k}") for k, v in moved.items()))


def function_hints(spark: SparkSession, d: str) -> DataFrame:
    """Mapped functions with what the catalog says of them: name and size, joined back by index."""
    li = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("library"), (F.col("l_partkey") % 5).cast("int").alias("function_index")).distinct()
    desc = table(spark, d, "supplier").select(F.col("s_suppkey").alias("library"), F.explode(F.sequence(F.lit(0), F.lit(4))).alias("function_index"), F.col("s_name").alias("name"))
    j = O.with_descriptors(li.withColumnRenamed("function_index", "target_index"), desc, ["library"], "target_index", "reference")
    return j.select("library", "target_index", F.col("reference_function.name").alias("name"))


def source_matches(spark: SparkSession, d: str) -> DataFrame:
    """Members by whether their stem has one content among all archives, several, or none."""
    m = table(spark, d, "archive_members").filter("name is not null").dropDuplicates(["member_id"]).withColumn("stem", X.stem(F.col("name")))
    sources = m.filter("n_functions >= 1").select("stem", F.concat_ws(":", "stem", "n_functions").alias("digest"))
    return A.source_matches(m, sources, ["member_id"], "stem", "digest").select("member_id", "stem", "contents", "status")


def file_magic(spark: SparkSession, d: str) -> DataFrame:
    """The scale folder's own files that begin as Parquet files do."""
    found = readers.discover(spark, d, b"PAR1")
    return found.select(F.regexp_extract("path", "([a-z_]+)[.]parquet", 1).alias("name")).distinct()


def object_lines(spark: SparkSession, d: str) -> DataFrame:
    """All whole log lines of a file as one physical line, its objects taken apart again."""
    lines = table(spark, d, "feature_logs").select("file_id", "line_no", "payload").filter(F.try_parse_json("payload").isNotNull())
    one = lines.groupBy("file_id", "line_no").agg(F.concat_ws(" ", F.array_sort(F.collect_list("payload"))).alias("text"))
    return readers.objects_of_lines(one, "text").groupBy("file_id").agg(F.count(F.lit(1)).alias("objects"))


def markdown_report(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "block_matches").groupBy("cu_status").agg(F.count(F.lit(1)).alias("matches"))
    return V.markdown_table(n, ["cu_status"])


def scored_names(spark: SparkSession, d: str) -> DataFrame:
    """Library scores by the mean of passing matches, for builds of each family: the exact and the collapsed family names beside each other."""
    x = Q._decisions(spark, d).filter("score is not null").withColumn("family", X.archive_family(F.col("library")))
    return D.best_candidate(x, ["build_id", "family"], "score", "accepted", "library").groupBy("family").agg(F.count(F.lit(1)).alias("builds"), F.round(F.max("score"), 6).alias("best"))


def planted_digests(spark: SparkSession, d: str) -> DataFrame:
    """A C function for each order line, with comments and blanks that must not matter; the digest is over its tokens."""
    from lodestone.functions.source_tokens import source_digest

    li = table(spark, d, "lineitem").select(F.col("l_partkey").alias("a"), F.col("l_linenumber").alias("b")).distinct()
    pad = F.repeat(F.lit(" "), F.col("b"))
    code = F.concat(F.lit("/* part "), "a", F.lit(' "x" */\nint'), pad, F.lit("f"), "b", F.lit("(void){ // "), "a", F.lit('\n\treturn'), pad, F.lit("g(\"/* "), "a", F.lit(' */\", 0x1f)'), pad, F.lit("+="), "b", F.lit(";\n}\n"))
    return li.select("a", "b", source_digest(code).alias("digest"))


def matrix_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """The catalog as a TSV file, read back: the selected archives that have a path."""
    from lodestone.sources import sinks

    a = table(spark, d, "library_archives").select(*(c.split()[0] for c in readers.LIBRARY_MATRIX.split(", ")))
    path = _scratch(spark, "matrix")
    sinks.write_table(a, path, "tsv")
    return readers.library_matrix(spark, path).groupBy("toolchain", "optimization").agg(F.count(F.lit(1)).alias("n"), F.countDistinct(F.trim("archive")).alias("archives"))


def _scratch(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/lodestone/{spark.sparkContext.applicationId}/{label}-{uuid.uuid4().hex}"


def truth_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """Ground truth as JSON lines of all builds, read back for two compilers."""
    r = table(spark, d, "elf_archives").dropDuplicates(["ref_id"])
    arch = r.groupBy("build_id").agg(F.array_sort(F.collect_list(F.struct("archive", "archive_basename", "resolved", "selected_by_linker", "included_compilation_units"))).alias("archives"))
    b = Q._builds(spark, d).join(arch, "build_id").select(F.concat(F.lit("/srv/"), "build_id").alias("binary"), "program", "compiler", F.col("optimization").alias("elf_optimization"), "archives")
    path = _scratch(spark, "truth")
    b.write.json(path)
    t = readers.ground_truth(spark, path, compilers=["gcc-12", "clang-16"], one_a_file=False)
    return t.groupBy("binary", "elf_compiler").agg(F.count("archive_basename").alias("named"), F.sum("included_compilation_units").alias("included"), F.count_if("selected_by_linker").alias("linked"))


def elf_headers(spark: SparkSession, d: str) -> DataFrame:
    """A small executable for each build, made of its record: those of one compiler have an interpreter, failed builds are cut short."""
    b = Q._builds(spark, d).join(T.latest(table(spark, d, "build_info").select("build_id", "binary_size", "ingested_at"), ["build_id"], ["ingested_at", "binary_size"]).drop("ingested_at"), "build_id")
    head = "7f454c46020101" + "00" * 9 + "02003e0001000000" + "00" * 8 + "40" + "00" * 7 + "00" * 14 + "3800" + "0200" + "00" * 6
    kind = F.when(F.col("compiler").startswith("gcc"), "03000000").otherwise("01000000")
    content = F.unhex(F.concat(F.lit(head + "01000000" + "00" * 52), kind, F.lit("00" * 52)))
    content = F.when(F.coalesce(F.col("binary_size") > 0, F.lit(False)), content).otherwise(F.substring(content, 1, 100))
    return readers.elf_headers(b.select(F.col("build_id").cast("string").alias("path"), content.alias("content"))).select("path", "is_elf64_x86", "has_interp", "link_type")


def bundle_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """The whole result bundle of all builds and libraries, checked for completeness, written, and its decisions read back."""
    from lodestone.sources import sinks

    m = table(spark, d, "block_matches").dropDuplicates(["match_id"]).select(F.col("build_id").cast("string").alias("elf_id"), F.trim("library").alias("library_id"), "cu_status").dropna()
    m = written(m, "units")
    elfs, libs = m.select("elf_id").distinct(), m.select("library_id").distinct()
    got = m.groupBy("elf_id", "library_id").agg(F.count_if(F.col("cu_status") == "PASS").alias("accepted"))
    names = libs.agg(F.collect_set("library_id").alias("l"))
    full = elfs.crossJoin(F.broadcast(names)).select("elf_id", F.explode("l").alias("library_id")).join(got, ["elf_id", "library_id"], "left").fillna(0, ["accepted"])
    path = _scratch(spark, "bundle")
    sinks.write_checked_bundle(elfs, libs, written(full, "matches"), m, path)
    back = sinks.read_bundle(spark, path, "library_match", "elf_id string, library_id string, accepted bigint")
    return back.groupBy("library_id").agg(F.count(F.lit(1)).alias("decisions"), F.sum("accepted").alias("accepted"))


def encoded_lines(spark: SparkSession, d: str) -> DataFrame:
    """Every line of every text through an encoder in windows: its length, its place in the window, and how much the window saw."""
    from lodestone.operators.inference import encode_sequences

    load = lambda: lambda lines: [[len(x), i, len(lines)] for i, x in enumerate(lines)]
    v = encode_sequences(table(spark, d, "documents").select("doc_id", F.split("text", "\n").alias("lines")), ["doc_id"], "lines", load, size=8, ahead=3)
    n = lambda i: F.col("vector")[i].cast("bigint")
    return v.groupBy("doc_id").agg(F.count(F.lit(1)).alias("lines"), F.sum(n(0)).alias("chars"), F.sum(n(1) * (F.col("position") + 1)).alias("places"), F.sum(n(2)).alias("seen"))


def profile_table(spark: SparkSession, d: str) -> DataFrame:
    """Structural profiles: the defaults, and every value of each grid at least once."""
    from lodestone.operators.replay import profile_design

    grid = {"coverage_mean": [0.5, 0.7, 0.9], "coverage_ratio": [0.2, 0.4], "function_spread": [0.1, 0.2, 0.3, 0.4]}
    rows = [(i, k, float(v)) for i, p in enumerate(profile_design({"coverage_mean": 0.975, "coverage_ratio": 0.65, "function_spread": 0.3}, grid, 9)) for k, v in p.items()]
    return spark.createDataFrame(rows, "profile int, parameter string, value double").groupBy("parameter").agg(F.countDistinct("value").alias("values"), F.max(F.when(F.col("profile") == 0, F.col("value"))).alias("default"), F.countDistinct("profile").alias("profiles"))


def screen_cases(spark: SparkSession, d: str) -> DataFrame:
    """Two levels for each program, so that all levels occur nearly equally often."""
    b = Q._builds(spark, d)
    levels = b.select("optimization").dropna().distinct()
    cases = b.select("program").dropna().distinct().crossJoin(F.broadcast(levels))
    return O.balanced_screen(cases, "program", "optimization").groupBy("optimization").agg(F.count(F.lit(1)).alias("cases"), F.countDistinct("program").alias("programs"))


QUERIES = {
    f.__name__: f
    for f in (
        planted_digests, matrix_roundtrip, truth_roundtrip, elf_headers, bundle_roundtrip, encoded_lines, profile_table, screen_cases,
        symbol_functions, address_order, rodata_sections, marked_records, report_settings, report_fractions, report_lines, linker_sections, confirmed_units, present_archives, cu_metrics, exact_builds, prediction_totals, function_edges, unit_edges, build_requirements,
        store_inventory, store_roundtrip, cache_misses, feature_reuse, canonical_digests, combined_digests, archive_set_gaps, feature_completeness, duplicate_members, report_conflicts, shard_checks, record_checks, truth_conflicts, audit_counts, decision_matrix, masked_mean_units,
        balanced_folds, covering_cases, quota_cases, archive_pools, version_plan, cohort_cells, position_ranges, prefix_limit, frequent_libraries, path_names, identities, times, whole_numbers, pair_maps, useful_symbols, selectors, function_hints, source_matches, file_magic, object_lines,
        markdown_report, scored_names,
    )
}

_CU = lambda x: f"regexp_replace(regexp_replace(regexp_replace(regexp_extract({x}, '[^/]*$'), '\\.o$', ''), '\\.c$', ''), '^(libpcre2_8_la-|libpcre2_posix_la-)', '')"
_STEM = r"replace(lower(regexp_replace(regexp_replace(regexp_extract(name, '[^/]*$'), '\.(o|lo|obj|c|cc|cpp|cxx|s|S|asm)$', ''), '^(lib[A-Za-z0-9_]+_la-)+', '')), '-', '_')"
_B1 = "WITH b AS (SELECT DISTINCT ON (block_id) * FROM blocks)"
_EDGES = "WITH c AS (SELECT l_suppkey AS library, l_partkey % 5 AS caller_cu, l_linenumber AS caller_function, l_orderkey % 5 AS callee_cu, l_quantity::INT % 7 + 1 AS callee_function FROM lineitem WHERE l_partkey % 5 <> l_orderkey % 5), f AS (SELECT *, count(*) AS relocations FROM c GROUP BY ALL)"

SQL = {
    "planted_digests": """WITH l AS (SELECT DISTINCT l_partkey AS a, l_linenumber AS b FROM lineitem) SELECT a, b, sha256(array_to_string(['int', 'f' || b, '(', 'void', ')', '{', 'return', 'g', '(', '"/* ' || a || ' */"', ',', '0x1f', ')', '+=', b::VARCHAR, ';', '}'], chr(31))) AS digest FROM l""",
    "matrix_roundtrip": "SELECT toolchain, optimization, count(*) AS n, count(DISTINCT trim(archive)) AS archives FROM library_archives WHERE status = 'selected' AND path <> '' GROUP BY ALL",
    "truth_roundtrip": Q._J + """, r AS (SELECT DISTINCT ON (ref_id) * FROM elf_archives) SELECT '/srv/' || r.build_id AS binary, compiler AS elf_compiler, count(archive_basename) AS named, sum(included_compilation_units)::BIGINT AS included, count(*) FILTER (selected_by_linker) AS linked
FROM (SELECT build_id, archive_basename, included_compilation_units, selected_by_linker FROM r) r JOIN b ON b.build_id = r.build_id WHERE b.compiler IN ('gcc-12', 'clang-16') GROUP BY ALL""",
    "elf_headers": Q._J + """, s AS (SELECT build_id, coalesce(binary_size > 0, false) AS ok FROM bb) SELECT b.build_id::VARCHAR AS path, ok AS is_elf64_x86, ok AND coalesce(starts_with(compiler, 'gcc'), false) AS has_interp, CASE WHEN NOT ok THEN NULL WHEN starts_with(compiler, 'gcc') THEN 'dynamic' ELSE 'static' END AS link_type FROM b JOIN s ON s.build_id = b.build_id""",
    "bundle_roundtrip": """WITH m AS (SELECT DISTINCT ON (match_id) build_id, trim(library) AS library, cu_status FROM block_matches WHERE build_id IS NOT NULL AND library IS NOT NULL AND cu_status IS NOT NULL) SELECT library AS library_id, (SELECT count(DISTINCT build_id) FROM m) AS decisions, count(*) FILTER (cu_status = 'PASS') AS accepted FROM m GROUP BY library""",
    "encoded_lines": """WITH x AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS s, unnest(range(0, len(string_split(text, chr(10))))) AS i, len(string_split(text, chr(10))) AS n FROM documents)
SELECT doc_id, count(*) AS lines, sum(length(s))::BIGINT AS chars, sum((i % 8) * (i + 1))::BIGINT AS places, sum(least(n - i // 8 * 8, 11))::BIGINT AS seen FROM x GROUP BY doc_id""",
    "profile_table": """SELECT * FROM (VALUES ('coverage_mean', 4, 0.975::DOUBLE, 9), ('coverage_ratio', 3, 0.65::DOUBLE, 9), ('function_spread', 4, 0.3::DOUBLE, 9)) t(parameter, "values", "default", profiles)""",
    "screen_cases": Q._J + """, p AS (SELECT count(DISTINCT program) AS n FROM b WHERE program IS NOT NULL), l AS (SELECT optimization, row_number() OVER (ORDER BY optimization) - 1 AS i, count(*) OVER () AS k FROM (SELECT DISTINCT optimization FROM b WHERE optimization IS NOT NULL))
SELECT optimization, 2 * n // k + (i < 2 * n % k)::INT AS cases, 2 * n // k + (i < 2 * n % k)::INT AS programs FROM l CROSS JOIN p""",
    "symbol_functions": _B1 + " SELECT block_id, address, raw_size FROM b WHERE n_instructions > 1 AND raw_size > 0 AND address IS NOT NULL",
    "address_order": _B1 + " SELECT block_id, row_number() OVER (PARTITION BY unit_type, unit_id ORDER BY address NULLS FIRST, block_id) - 1 AS place FROM b",
    "rodata_sections": r"""WITH x AS (SELECT doc_id, unnest(string_split(text, chr(10) || chr(10))) AS data, unnest(range(0, len(string_split(text, chr(10) || chr(10))))) AS i FROM documents),
y AS (SELECT * FROM x WHERE i % 3 <> 1 AND i % 5 <> 4), g AS (SELECT doc_id, string_agg(hex(encode(data)), '00' ORDER BY i) AS h, count(*) AS n, sum(len(regexp_extract_all(data, '([ -~]{4,})', 1))) AS s FROM y GROUP BY doc_id)
SELECT doc_id, length(h) // 2 AS bytes, s::BIGINT AS strings, n AS n_sections, md5(unhex(h)) AS digest FROM g""",
    "marked_records": "SELECT campaign_id, count(*) AS lines, count(DISTINCT file_id) AS files FROM feature_logs WHERE contains(payload, '\"block_cu\"') GROUP BY campaign_id",
    "report_settings": "SELECT doc_id, '' AS total_time, 0.0 AS library_min_score, 'legacy' AS asm_normalization, 'mean' AS palmtree_pooling, coalesce(contains(text, 'Done processing in '), false) AS complete FROM documents",
    "report_fractions": r"""WITH l AS (SELECT doc_id, unnest(string_split_regex(text, '\r?\n')) AS line FROM documents), p AS (SELECT *, string_split(regexp_extract(line, '\| *windows=([^|]*?) *(\||$)', 1), '/') AS w FROM l WHERE regexp_matches(line, '^[A-Z_]+ +\| +[a-z_]+='))
SELECT doc_id, count(*) AS lines, sum(CASE WHEN len(w) = 2 THEN try_cast(w[1] AS BIGINT) END)::BIGINT AS windows_done, sum(CASE WHEN len(w) = 2 THEN try_cast(w[2] AS BIGINT) END)::BIGINT AS windows_total,
round(sum(try_cast(nullif(regexp_extract(line, '\| *score=([^|]*?) *(\||$)', 1), '') AS DOUBLE)), 6) AS score FROM p GROUP BY doc_id""",
    "report_lines": Q._W + "SELECT library, max(coverage_mean) AS best_any, max(coverage_mean) FILTER (passed) AS best_matched, count(*) FILTER (passed AND coverage_ratio >= 0.9) AS confirmed, count(*) FILTER (cu_status = 'DROP_RODATA') AS penalised, count(DISTINCT CASE WHEN passed THEN build_id || '/' || target_cu_index END) AS matched_cus, coalesce(sum(num_target_blocks) FILTER (passed), 0)::BIGINT AS matched_blocks FROM w GROUP BY library",
    "linker_sections": r"""WITH d AS (SELECT doc_id, regexp_extract(regexp_replace(text, '(^|\n)[ \t]*\.[a-z]+[ \t]+0x[0-9a-f]+[ \t]+[0-9]+[ \t]+', '\1', 'g'), '(^|\n)Archive members pulled in[^\n]*\n\s*((.|\n)*)$', 2) AS rest FROM documents),
s AS (SELECT doc_id, regexp_extract(rest, '^((.|\n)*?)(\n[ \t\r]*\n|$)', 1) AS sec FROM d WHERE rest <> ''), l AS (SELECT doc_id, unnest(string_split_regex(sec, '\r?\n')) AS line FROM s)
SELECT DISTINCT doc_id, regexp_extract(line, '^(\S.*?\.a)\(([^()]+)\)', 1) AS archive, regexp_extract(line, '^(\S.*?\.a)\(([^()]+)\)', 2) AS member FROM l WHERE regexp_matches(line, '^(\S.*?\.a)\(([^()]+)\)')""",
    "confirmed_units": "WITH r AS (SELECT DISTINCT ON (ref_id) * FROM elf_archives), x AS (SELECT ref_id, unnest(range(1, coalesce(CASE WHEN ref_id % 2 = 1 THEN included_compilation_units ELSE least(included_compilation_units, coalesce(total_compilation_units, 0)) END, 0) + 1)) AS i FROM r WHERE selected_by_linker) SELECT ref_id, 'cu_' || i AS cu FROM x",
    "present_archives": "WITH r AS (SELECT DISTINCT ON (ref_id) * FROM elf_archives) SELECT trim(archive_basename) AS library, count(*) FILTER (included_compilation_units IS NULL OR included_compilation_units > 0) AS present, count(*) AS refs FROM r GROUP BY 1",
    "cu_metrics": f"""WITH m AS (SELECT DISTINCT build_id, trim(library) AS library FROM block_matches), p AS (SELECT DISTINCT build_id, trim(library) AS library, {_CU('cu_name')} AS cu FROM block_matches WHERE passed AND cu_name IS NOT NULL),
a AS (SELECT DISTINCT trim(archive_basename) AS library, {_CU('name')} AS cu FROM archive_members WHERE name IS NOT NULL AND n_functions >= 2), e AS (SELECT build_id, trim(archive_basename) AS library, bool_or(selected_by_linker) AS expected FROM elf_archives GROUP BY ALL),
c AS (SELECT m.*, coalesce(e.expected, false) AS expected FROM m LEFT JOIN e USING (build_id, library)), k AS (SELECT * FROM c WHERE NOT expected OR library IN (SELECT library FROM a)), t AS (SELECT k.build_id, k.library, a.cu FROM k JOIN a USING (library) WHERE k.expected),
q AS (SELECT p.* FROM p JOIN k USING (build_id, library)), n AS (SELECT (SELECT count(*) FROM k) AS n, (SELECT count(*) FROM q JOIN t USING (build_id, library, cu)) AS tp, (SELECT count(*) FROM q) AS p, (SELECT count(*) FROM t) AS e)
SELECT n AS cu_evaluated_pairs, tp AS cu_tp, p - tp AS cu_fp, e - tp AS cu_fn, round(CASE WHEN p = 0 THEN 0 ELSE tp / p END, 6) AS cu_precision, round(CASE WHEN e = 0 THEN 0 ELSE tp / e END, 6) AS cu_recall, round(CASE WHEN p + e = 0 THEN 0 ELSE 2 * tp / (p + e) END, 6) AS cu_f1 FROM n""",
    "exact_builds": Q._FAMS + f""", h AS (SELECT build_id, family, coalesce(bool_or(expected), false) AS e, coalesce(bool_or(predicted), false) AS p FROM f GROUP BY ALL), i AS (SELECT 'family' AS mode, {Q._CNT} FROM h UNION ALL SELECT 'exact', {Q._CNT} FROM (SELECT coalesce(expected, false) AS e, coalesce(predicted, false) AS p FROM x))
SELECT *, {Q._MET} FROM i""",
    "prediction_totals": Q._J + f", cm AS (SELECT build_id, trim(library) AS library, count(*) FILTER (passed) AS a, count(*) FILTER (NOT passed) AS r FROM block_matches GROUP BY ALL) SELECT optimization, {Q._CNT}, sum(coalesce(a, 0))::BIGINT AS cu_passed, sum(coalesce(r, 0))::BIGINT AS cu_failed FROM y LEFT JOIN cm USING (build_id, library) GROUP BY optimization",
    "function_edges": _EDGES + " SELECT * FROM f",
    "unit_edges": _EDGES + " SELECT library, caller_cu, callee_cu, sum(relocations)::BIGINT AS relocations, count(*) AS function_edges FROM f GROUP BY ALL",
    "build_requirements": """WITH a AS (SELECT *, trim(archive) AS ar FROM library_archives WHERE status = 'selected'), g AS (SELECT ar, count(DISTINCT role) AS n_role, count(DISTINCT toolchain) AS n_toolchain, count(DISTINCT optimization) AS n_optimization FROM a GROUP BY ar), x AS (SELECT ar, role, toolchain, optimization, count(DISTINCT coalesce(path, '')) AS d FROM a GROUP BY ALL)
SELECT ar AS archive, n_role, n_toolchain, n_optimization, n_role >= 2 AND n_toolchain >= 3 AND n_optimization >= 2 AS enough, (SELECT max(d) > 1 FROM x WHERE x.ar = g.ar) AS ambiguous FROM g""",
    "store_inventory": """WITH b AS (SELECT DISTINCT ON (block_id) * FROM blocks), k AS (SELECT DISTINCT 'ELF' AS unit_type, build_id AS unit_id FROM build_info UNION SELECT 'CU', library_id FROM library_archives), h AS (SELECT unit_type, unit_id, count(*) AS n, sum(raw_size) AS s FROM b GROUP BY ALL),
g AS (SELECT coalesce(h.unit_type, k.unit_type) AS unit_type, sum(h.n)::BIGINT AS entries, sum(h.s)::BIGINT AS bytes, count(*) FILTER (h.n IS NULL) AS missing, count(*) FILTER (k.unit_id IS NULL) AS extra FROM k FULL JOIN h ON h.unit_type = k.unit_type AND h.unit_id = k.unit_id GROUP BY 1) SELECT *, missing = 0 AND extra = 0 AS valid FROM g""",
    "store_roundtrip": _B1 + " SELECT unit_type AS archive, count(*) AS entries, min(function_index) AS least_functions, max(function_index) AS most_functions, 0 AS lost FROM b GROUP BY unit_type",
    "cache_misses": "SELECT DISTINCT archive_sha256 AS key FROM elf_archives WHERE archive_sha256 IS NOT NULL AND archive_sha256 NOT IN (SELECT archive_sha256 FROM elf_archives WHERE selected_by_linker AND archive_sha256 IS NOT NULL)",
    "feature_reuse": """WITH r AS (SELECT DISTINCT build_id, trim(archive_basename) AS library, compiler, optimization FROM elf_archives), o AS (SELECT DISTINCT build_id, compiler, optimization FROM elf_archives), m AS (SELECT DISTINCT b.build_id, trim(library) AS library, compiler, optimization FROM block_matches b JOIN o ON o.build_id = b.build_id),
x AS (SELECT r.build_id, m.build_id IS NOT NULL AS hit FROM r LEFT JOIN m ON m.build_id = r.build_id AND m.library = r.library AND m.compiler = r.compiler AND m.optimization = r.optimization) SELECT build_id, count(*) AS pairs, CASE WHEN hit THEN 'reused' ELSE 'missing' END AS state FROM x GROUP BY build_id, hit""",
    "canonical_digests": """SELECT DISTINCT ON (build_id) build_id, sha256('{"build":' || build_id || ',"size":' || coalesce(binary_size::VARCHAR, 'null') || ',"variant":' || coalesce('"' || variant || '"', 'null') || '}') AS digest FROM build_info""",
    "combined_digests": _B1 + " SELECT unit_type, unit_id, sha256(string_agg(sha256(coalesce(address::VARCHAR, '')), '' ORDER BY block_id)) AS digest FROM b GROUP BY ALL",
    "archive_set_gaps": """WITH a AS (SELECT DISTINCT trim(archive) AS archive FROM library_archives WHERE status = 'selected'), r AS (SELECT DISTINCT trim(archive_basename) AS archive FROM elf_archives WHERE trim(archive_basename) <> '')
SELECT archive, 'missing' AS side FROM a WHERE archive NOT IN (SELECT archive FROM r) UNION ALL SELECT archive, 'extra' FROM r WHERE archive NOT IN (SELECT archive FROM a)""",
    "feature_completeness": """WITH r AS (SELECT DISTINCT build_id, trim(archive_basename) AS library FROM elf_archives WHERE trim(archive_basename) <> ''), m AS (SELECT build_id, trim(library) AS library, count(score) AS s, count(call_edge_ratio) AS c FROM block_matches GROUP BY ALL), j AS (SELECT r.*, m.build_id AS have, s, c FROM r LEFT JOIN m USING (build_id, library))
SELECT build_id, library, 'missing' AS problem FROM j WHERE have IS NULL UNION ALL SELECT build_id, library, 'null_score' FROM j WHERE have IS NOT NULL AND s = 0 UNION ALL SELECT build_id, library, 'null_call_edge_ratio' FROM j WHERE have IS NOT NULL AND c = 0""",
    "duplicate_members": """WITH m AS (SELECT DISTINCT ON (member_id) trim(archive_basename) AS archive, name, lower(object_sha256) AS sha FROM archive_members WHERE name IS NOT NULL AND archive_basename IS NOT NULL)
SELECT archive, name, count(*) AS copies, count(DISTINCT coalesce(sha, '')) AS contents, CASE WHEN count(DISTINCT coalesce(sha, '')) = 1 THEN 'identical' ELSE 'ambiguous' END AS kind FROM m GROUP BY ALL HAVING count(*) > 1""",
    "report_conflicts": "WITH m AS (SELECT DISTINCT ON (match_id) * FROM block_matches), g AS (SELECT library, count(*) FILTER (cu_status = 'PASS') AS passing, count(*) FILTER (passed) AS reported FROM m GROUP BY library) SELECT * FROM g WHERE passing <> reported",
    "shard_checks": """WITH m AS (SELECT match_id, library, strftime(matched_at, '%Y-%m') AS shard FROM block_matches WHERE matched_at IS NOT NULL), w AS (SELECT s.shard, count(*) AS n FROM (SELECT DISTINCT library FROM m) l CROSS JOIN (SELECT DISTINCT shard FROM m) s WHERE NOT EXISTS (SELECT 1 FROM m WHERE m.library = l.library AND m.shard = s.shard) GROUP BY s.shard),
g AS (SELECT match_id, shard, count(*) AS n FROM m GROUP BY ALL), a AS (SELECT match_id, count(*) AS k, min(shard) AS shard FROM g GROUP BY match_id)
SELECT 'catalog' AS check_name, shard, n FROM w UNION ALL SELECT 'repeated', shard, count(*) FROM g WHERE n > 1 GROUP BY shard UNION ALL SELECT 'crossed', shard, count(*) FROM a WHERE k > 1 GROUP BY shard""",
    "record_checks": """WITH m AS (SELECT DISTINCT ON (match_id) * FROM block_matches), g AS (SELECT library FROM m GROUP BY library HAVING min(target_cu_index) <> 0 OR max(target_cu_index) <> count(DISTINCT target_cu_index) - 1),
a AS (SELECT DISTINCT ON (member_id) trim(archive_basename) AS library, occurrence, name, n_functions FROM archive_members), t AS (SELECT library, occurrence FROM a GROUP BY ALL HAVING count(DISTINCT ROW(name, n_functions)) > 1)
SELECT 'contiguous' AS check_name, count(*) AS n FROM g UNION ALL SELECT 'status', count(*) FROM m WHERE coalesce((cu_status = 'DROP') = passed, true) UNION ALL SELECT 'descriptor', count(*) FROM t""",
    "truth_conflicts": Q._J + """, tt AS (SELECT build_id, trim(archive_basename) AS library, max(compiler) AS compiler FROM elf_archives WHERE selected_by_linker AND trim(archive_basename) <> '' GROUP BY ALL), mm AS (SELECT k.build_id, trim(k.library) AS library, bool_or(passed) AS expected, max(b.compiler) AS compiler FROM block_matches k JOIN b ON b.build_id = k.build_id GROUP BY ALL),
z AS (SELECT coalesce(tt.build_id, mm.build_id) AS build_id, coalesce(tt.library, mm.library) AS library, tt.build_id IS NOT NULL AS ht, mm.build_id IS NOT NULL AS hm, mm.expected AS me, tt.compiler AS tc, mm.compiler AS mc FROM tt FULL JOIN mm ON mm.build_id = tt.build_id AND mm.library = tt.library)
SELECT build_id, library, 'row' AS field, 'present' AS truth_value, NULL AS manifest_value FROM z WHERE ht AND NOT hm UNION ALL SELECT build_id, library, 'expected', ht::VARCHAR, me::VARCHAR FROM z WHERE hm AND me IS DISTINCT FROM ht UNION ALL SELECT build_id, library, 'compiler', tc, mc FROM z WHERE ht AND hm AND tc IS DISTINCT FROM mc""",
    "audit_counts": "SELECT trim(archive_basename) AS archive, name AS cu, max(n_functions) AS functions FROM archive_members WHERE name IS NOT NULL AND n_functions IS NOT NULL AND archive_basename IS NOT NULL GROUP BY ALL",
    "decision_matrix": Q._J + ", l AS (SELECT DISTINCT library FROM m), bi AS (SELECT DISTINCT build_id FROM build_info) SELECT l.library, count(*) FILTER (m.predicted) AS yes, count(*) FILTER (NOT m.predicted) AS no, count(*) FILTER (m.predicted IS NULL) AS missing FROM bi CROSS JOIN l LEFT JOIN m ON m.build_id = bi.build_id AND m.library = l.library GROUP BY l.library",
    "masked_mean_units": """WITH b AS (SELECT DISTINCT ON (block_id) * FROM blocks), g AS (SELECT * FROM b WHERE normalized_embeddings IS NOT NULL AND len(list_filter(normalized_embeddings, lambda x: x IS NULL OR isnan(x))) = 0)
SELECT unit_type, unit_id, (dim - 1)::INT AS dim, round(sum(CASE WHEN n_instructions >= 5 THEN x::DOUBLE ELSE 0 END) / greatest(count(*) FILTER (n_instructions >= 5), 1), 6) AS value FROM (SELECT unit_type, unit_id, n_instructions, unnest(normalized_embeddings) AS x, unnest(range(1, len(normalized_embeddings) + 1)) AS dim FROM g) GROUP BY ALL""",
    "balanced_folds": Q._J + "SELECT program, count(DISTINCT build_id) AS cases, true AS usable, true AS placed FROM y WHERE program <> '-' GROUP BY program",
    "covering_cases": "SELECT DISTINCT optimization, trim(archive_basename) AS library FROM elf_archives WHERE selected_by_linker AND optimization IS NOT NULL AND archive_basename IS NOT NULL AND build_id IS NOT NULL",
    "quota_cases": Q._J + "SELECT build_id, compiler, optimization FROM (SELECT *, row_number() OVER (PARTITION BY compiler, optimization ORDER BY sha256('quota:' || build_id), build_id) AS r FROM b) WHERE r <= 3",
    "archive_pools": """WITH l AS (SELECT DISTINCT build_id AS c, trim(archive_basename) AS a FROM elf_archives WHERE selected_by_linker), s AS (SELECT build_id AS c, trim(library) AS a, max(score) AS s FROM block_matches WHERE score IS NOT NULL GROUP BY ALL), w AS (SELECT * FROM s WHERE NOT EXISTS (SELECT 1 FROM l WHERE l.c = s.c AND l.a = s.a)),
h AS (SELECT DISTINCT a FROM (SELECT *, row_number() OVER (PARTITION BY c ORDER BY s DESC, a) AS r FROM w) WHERE r = 1), d AS (SELECT trim(archive) AS a FROM library_archives WHERE status = 'selected' GROUP BY 1 HAVING greatest(count(DISTINCT role), count(DISTINCT toolchain), count(DISTINCT optimization)) >= 4)
SELECT DISTINCT a AS archive, 'positive' AS pool FROM l WHERE a IS NOT NULL UNION ALL SELECT a, 'hard_negative' FROM h WHERE a IS NOT NULL UNION ALL SELECT a, 'diverse' FROM d WHERE a IS NOT NULL""",
    "version_plan": Q._J + """, r AS (SELECT trim(archive_basename) AS library, count(DISTINCT program) AS n FROM elf_archives e JOIN b ON b.build_id = e.build_id WHERE archive_basename IS NOT NULL GROUP BY 1), v AS (SELECT trim(archive) AS library, count(DISTINCT role) AS k FROM library_archives WHERE status = 'selected' GROUP BY 1 HAVING count(DISTINCT role) > 0)
SELECT library, n AS programs, k AS versions, true AS even FROM r JOIN v USING (library)""",
    "cohort_cells": Q._J + """, c AS (SELECT DISTINCT toolchain, optimization FROM library_archives WHERE toolchain IS NOT NULL AND optimization IS NOT NULL), p AS (SELECT program, row_number() OVER (ORDER BY program) - 1 AS i, count(*) OVER () AS n FROM (SELECT DISTINCT program FROM b WHERE program IS NOT NULL)),
s AS (SELECT DISTINCT program, split_part(compiler, '-', 1) AS f FROM b WHERE program IS NOT NULL)
SELECT p.program, toolchain, optimization FROM c CROSS JOIN p JOIN s ON s.program = p.program AND s.f = split_part(toolchain, '-', 1) WHERE (((i - (ascii(optimization) + ascii(substr(optimization, 2, 1)) + length(toolchain))) % n) + n) % n < least(20, n)""",
    "position_ranges": "WITH b AS (SELECT row_number() OVER (ORDER BY build_id) AS p FROM (SELECT DISTINCT build_id FROM build_info)) SELECT min(p) AS first, max(p) AS last, count(*) AS n FROM b GROUP BY (p - 1) // 100",
    "prefix_limit": "SELECT DISTINCT build_id FROM build_info ORDER BY build_id LIMIT 100",
    "frequent_libraries": "WITH g AS (SELECT library, count(*) AS n, count(*) FILTER (passed) AS passed FROM block_matches GROUP BY library) SELECT *, row_number() OVER (ORDER BY n DESC, passed DESC, library) AS place FROM g",
    "path_names": r"""WITH p AS (SELECT DISTINCT trim(archive) AS path FROM elf_archives WHERE trim(archive) <> ''), x AS (SELECT *, string_split(path, '/') AS s FROM p)
SELECT path, CASE WHEN len(s) >= 3 THEN nullif(s[len(s) - 2], '') END AS toolchain, CASE WHEN len(s) >= 3 THEN nullif(s[len(s) - 1], '') END AS optimization, CASE WHEN len(s) >= 3 THEN nullif(s[len(s)], '') END AS archive,
regexp_replace(regexp_replace(regexp_replace(path, '^/+', ''), '/+', '__', 'g'), '[^A-Za-z0-9_.-]+', '_', 'g') AS path_label, 'util-linux-2.' || length(path) AS source_build FROM x""",
    "identities": "SELECT DISTINCT coalesce(trim(archive_basename), '') || '|' || coalesce(name, '') || '|' || coalesce('sha256:' || object_sha256, '') AS identity, coalesce(trim(archive_basename), '') AS family, coalesce(name, '') AS cu, coalesce('sha256:' || object_sha256, '') AS content FROM archive_members",
    "times": "SELECT DISTINCT ON (build_id) build_id, strftime(built_at, '%Y-%m-%dT%H:%M:%S') AS built, CASE WHEN coalesce(binary_size, 0) < 36000 THEN '0' ELSE '' END || (coalesce(binary_size, 0) // 3600)::VARCHAR || ':' || lpad((coalesce(binary_size, 0) // 60 % 60)::VARCHAR, 2, '0') || ':' || lpad((coalesce(binary_size, 0) % 60)::VARCHAR, 2, '0') AS clock FROM build_info",
    "whole_numbers": r"""WITH w AS (SELECT DISTINCT unnest(string_split_regex(text, '[\s,;:\[\]+]+')) AS word FROM documents WHERE lower(trim(source)) = 'disasm_note')
SELECT word, CASE WHEN regexp_matches(lower(word), '^0x[0-9a-f]{1,15}$') THEN (lower(word))::BIGINT ELSE word::BIGINT END AS value FROM w WHERE regexp_matches(lower(word), '^(0x[0-9a-f]{1,15}|[-+]?[0-9]{1,18})$')""",
    "pair_maps": "WITH x AS (SELECT l_orderkey, l_linenumber % 3 AS k, l_quantity::INT AS v, row_number() OVER (PARTITION BY l_orderkey, l_linenumber % 3 ORDER BY l_linenumber DESC, l_quantity::INT DESC) AS r FROM lineitem) SELECT l_orderkey, k, v FROM x WHERE r = 1",
    "useful_symbols": "SELECT 'T' AS kind, 's' || l_suppkey AS symbol, count(*) AS n FROM lineitem WHERE l_returnflag NOT IN ('R', 'A') AND l_linenumber NOT IN (6, 7) GROUP BY ALL",
    "file_magic": "SELECT unnest(['region', 'nation', 'customer', 'supplier', 'part', 'orders', 'lineitem', 'events', 'documents', 'embeddings', 'library_archives', 'build_info', 'elf_archives', 'archive_members', 'block_matches', 'blocks', 'profile_records', 'feature_logs', 'split_targets', 'mix_targets']) AS name",
    "selectors": Q._J + "SELECT DISTINCT ON (ref_id) ref_id, b.compiler AS base_compiler, b.optimization AS base_optimization, 'current' AS base_role, b.compiler AS moved_compiler, coalesce(lower(e.optimization), b.optimization) AS moved_optimization, coalesce(version_role, 'current') AS moved_role FROM elf_archives e JOIN b ON b.build_id = e.build_id",
    "function_hints": "SELECT DISTINCT l_suppkey AS library, l_partkey % 5 AS target_index, s_name AS name FROM lineitem JOIN supplier ON s_suppkey = l_suppkey",
    "source_matches": f"""WITH m AS (SELECT DISTINCT ON (member_id) member_id, {_STEM} AS stem, n_functions FROM archive_members WHERE name IS NOT NULL), s AS (SELECT stem, count(DISTINCT n_functions) AS c FROM m WHERE n_functions >= 1 GROUP BY stem)
SELECT member_id, m.stem, coalesce(c, 0) AS contents, CASE WHEN coalesce(c, 0) = 0 THEN 'unmapped' WHEN c = 1 THEN 'mapped' ELSE 'ambiguous' END AS status FROM m LEFT JOIN s ON s.stem = m.stem""",
    "object_lines": "WITH l AS (SELECT file_id, payload FROM feature_logs WHERE json_valid(payload)) SELECT file_id, count(*) AS objects FROM l GROUP BY file_id",
    "markdown_report": "WITH g AS (SELECT cu_status, count(*) AS n, row_number() OVER (ORDER BY cu_status) + 2 AS i FROM block_matches GROUP BY cu_status) SELECT i AS line_no, '| ' || cu_status || ' | ' || n || ' |' AS line FROM g UNION ALL SELECT 1, '| cu_status | matches |' UNION ALL SELECT 2, '|-|-|'",
    "scored_names": Q._J + r", z AS (SELECT *, regexp_replace(lower(regexp_extract(library, '[^/]*$')), '\.a$', '') AS family FROM x WHERE score IS NOT NULL) SELECT family, count(DISTINCT build_id) AS builds, round(max(score), 6) AS best FROM z GROUP BY family",
}
