"""Readers: catalogs, logs, reports, truth and binaries, each with a declared schema."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

LIBRARY_MATRIX = "archive string, package string, role string, toolchain string, optimization string, project_candidates string, status string, reason string, path string"
FEATURE = "type string, library string, name string, target_cu_index int, cu_status string, windows_total int"
GROUND_TRUTH = (
    "binary string, binary_sha256 string, binary_size bigint, linker_map string, program string, variant string, compiler string, elf_optimization string, "
    "archives array<struct<archive:string,archive_basename:string,archive_sha256:string,library:string,source:string,compiler:string,optimization:string,version_role:string,resolved:boolean,"
    "selected_by_linker:boolean,included_members:array<string>,included_compilation_units:int,total_compilation_units:int,confirmed_compilation_units:array<string>,confirmed_compilation_units_method:string>>"
)


def library_matrix(spark: SparkSession, path: str) -> DataFrame:
    """The TSV catalog's selected archives that have a path."""
    return spark.read.csv(path, sep="\t", header=True, schema=LIBRARY_MATRIX).filter("status = 'selected' and path is not null and path <> ''")


def ground_truth(spark: SparkSession, path: str, programs: list[str] | None = None, compilers: list[str] | None = None, one_a_file: bool = True) -> DataFrame:
    """Ground-truth JSON files, one object a file or a line, as one row per linked archive, optionally of some programs and compilers."""
    t = spark.read.schema(GROUND_TRUTH).json(path, multiLine=one_a_file)
    for column, values in (("program", programs), ("compiler", compilers)):
        t = t.filter(F.col(column).isin(values)) if values else t
    return t.select("binary", "binary_sha256", "binary_size", "program", "variant", F.col("compiler").alias("elf_compiler"), "elf_optimization", F.explode_outer("archives").alias("a")).select("*", "a.*").drop("a")


def feature_records(lines: DataFrame, payload: str, keys: list[str]) -> DataFrame:
    """Unit records of feature-log lines, typed; exact repeats count once, lines that are no JSON are left out."""
    rec = F.from_json(payload, FEATURE, {"mode": "PERMISSIVE"})
    whole = F.try_parse_json(payload).isNotNull()
    return lines.filter(whole).select(*keys, rec.alias("r")).filter("r.type = 'block_cu'").select(*keys, "r.library", "r.name", "r.target_cu_index", "r.cu_status", "r.windows_total").distinct()


def objects_of_lines(lines: DataFrame, text: str, strict: bool = True) -> DataFrame:
    """Lines that may hold several JSON objects, one row each: all columns, ``object_no`` and ``object``.

    With ``strict`` a line with anything else is an error when it is read; else what is no object ends its line. Null and blank lines have none.
    """
    import json

    schema = f"{', '.join(f'`{n}` {t}' for n, t in lines.dtypes)}, object_no int, object string"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scan = json.JSONDecoder().raw_decode
        for b in batches:
            rows = []
            for r in b.to_dict("records"):
                s, at, n = (r[text] or ""), 0, 0
                while (at := at + len(s[at:]) - len(s[at:].lstrip())) < len(s):
                    try:
                        value, end = scan(s, at)
                        if not isinstance(value, dict):
                            raise ValueError("no object")
                    except ValueError as e:
                        if strict:
                            raise ValueError(f"invalid JSON line {s[:80]!r}") from e
                        break
                    rows.append({**r, "object_no": n, "object": s[at:end]})
                    at, n = end, n + 1
            yield pd.DataFrame(rows, columns=[*b.columns, "object_no", "object"])

    return lines.mapInPandas(run, schema)


def conflicting(records: DataFrame, keys: list[str], payload: str) -> DataFrame:
    """Keys with more than one distinct payload, an error in a log: ``keys.., versions``."""
    return records.groupBy(*keys).agg(F.countDistinct(payload).alias("versions")).filter("versions > 1")


def marked(lines: DataFrame, payload: str, *markers: str) -> DataFrame:
    """Lines that contain all markers: a byte search that spares the others a JSON parse."""
    for m in markers:
        lines = lines.filter(F.col(payload).contains(m))
    return lines


def report_settings(texts: DataFrame, key: str, text: str) -> DataFrame:
    """``key, total_time, library_min_score, asm_normalization, palmtree_pooling, complete`` of whole reports, by the last match of each; older reports' defaults where there is none."""
    last = lambda pattern: F.element_at(F.regexp_extract_all(text, F.lit(pattern), F.lit(1)), -1)
    number = r"([+-]?(?:[0-9]+(?:\.[0-9]*)?|\.[0-9]+)(?:[eE][+-]?[0-9]+)?)"
    found = lambda p: F.when(F.size(F.regexp_extract_all(text, F.lit(p), F.lit(1))) > 0, last(p))
    return texts.select(
        key, F.coalesce(found(r"Done processing in\s+(\d{2}:\d{2}:\d{2})"), found(r"\[TIMEOUT\] after\s+(\d{2}:\d{2}:\d{2})"), F.lit("")).alias("total_time"),
        F.coalesce(found(rf"(?m)^Library minimum score:\s*{number}\s*$").cast("double"), F.lit(0.0)).alias("library_min_score"), F.coalesce(found(r"(?m)^Assembly normalization:\s*(legacy|v2)\s*$"), F.lit("legacy")).alias("asm_normalization"),
        F.coalesce(found(r"(?m)^PalmTree pooling:\s*(mean|masked_mean)\s*$"), F.lit("mean")).alias("palmtree_pooling"), complete_report(F.col(text)).alias("complete"),
    )


def complete_report(text: Column, marker: str = "Done processing in ", tail: int = 16_384) -> Column:
    """Does the end of a report say that its run was done?"""
    return F.coalesce(F.substring(text, -tail, tail).contains(marker), F.lit(False))


def report_numbers(line: str) -> dict[str, Column]:
    """Typed values of a report line's ``k=v`` fields: fractions ``a/b``, triplets ``a/b/c`` and percents; of a field named twice the first counts."""
    raw = lambda k: F.regexp_extract(line, rf"\| *{k}=([^|]*?) *(?:\||$)", 1)
    part = lambda k, i, n: F.when(F.size(F.split(raw(k), "/")) == n, F.get(F.split(raw(k), "/"), i)).try_cast("bigint")
    return {
        "windows_done": part("windows", 0, 2), "windows_total": part("windows", 1, 2), "edges_matched": part("edges", 0, 3), "edges_evaluable": part("edges", 1, 3), "edges_expected": part("edges", 2, 3),
        "coverage_percent": F.rtrim(raw("coverage"), F.lit("%")).try_cast("double"), "score": F.nullif(raw("score"), F.lit("")).try_cast("double"),
    }


def resolve_patterns(spark: SparkSession, base: str, patterns: list[str], limit: int | None = None) -> list[str]:
    """Files below ``base``, sorted: of each pattern those that match in the folder, else anywhere below it, else the file of that very name; the first ``limit`` if given."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    root = hadoop.Path(base)
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    found: set[str] = set()
    for pattern in patterns:
        # in the folder first, then at any depth
        for deep in range(9):
            got = [x.getPath().toString() for x in (fs.globStatus(hadoop.Path(f"{base}/{'*/' * deep}{pattern}")) or []) if x.isFile()]
            found.update(got)
            if got and not deep:
                break
    return sorted(found)[:limit]


def parse_report_lines(lines: DataFrame, line: str) -> DataFrame:
    """``STATUS | k=v | k=v`` lines as columns; fields a line lacks are empty or null, other lines are left out."""
    field = lambda k, more="([^|]*?)": F.regexp_extract(line, rf"\| *{k}={more} *(?:\||$)", 1)
    hit = lines.filter(F.col(line).rlike(r"^[A-Z_]+ +\| +[a-z_]+="))
    number = lambda c, kind: F.nullif(c, F.lit("")).try_cast(kind)
    keep = [c for c in lines.columns if c != line]
    return hit.select(
        *keep, F.regexp_extract(line, r"^([A-Z_]+) +\|", 1).alias("status"), field("library").alias("library"), field("cu").alias("cu"), number(field("score"), "double").alias("score"),
        number(F.regexp_extract(line, r"\| *windows=([0-9]+)/", 1), "bigint").alias("windows_done"), number(F.regexp_extract(line, r"\| *windows=[0-9]+/([0-9]+)", 1), "bigint").alias("windows_total"),
    )


def discover(spark: SparkSession, path: str, magic: bytes) -> DataFrame:
    """Files below a folder that begin with ``magic``, sorted by path: ``path, length``."""
    b = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return b.filter(F.substring("content", 1, len(magic)) == F.lit(magic)).select("path", "length").orderBy("path")


def elf_headers(files: DataFrame) -> DataFrame:
    """Link type of 64-bit x86 binaries from ``(path, content)``: ``path, is_elf64_x86, has_interp, has_needed, link_type, problem``.

    A binary with an interpreter or a needed library (``DT_NEEDED`` of its dynamic segment) is ``dynamic``, one with a dynamic segment but
    neither is ``static-pie``, any other ``static``; what is no such binary, or is cut short, has a ``problem`` and no type.
    """

    def read(data: bytes | None) -> tuple[bool, bool, str | None, str | None]:
        if data is None or len(data) < 64 or data[:4] != b"\x7fELF":
            return False, False, None, "not an ELF file"
        if data[4] != 2 or data[5] not in (1, 2):
            return False, False, None, "not ELF64"
        end = "<" if data[5] == 1 else ">"
        kind, machine = struct.unpack_from(end + "HH", data, 16)
        at, (size, count) = struct.unpack_from(end + "Q", data, 32)[0], struct.unpack_from(end + "HH", data, 54)
        if machine != 62 or kind not in (2, 3):
            return False, False, None, "not an x86-64 executable"
        if not at or not count or count == 0xFFFF or size < 56 or at + size * count > len(data):
            return False, False, None, "bad program headers"
        heads = [struct.unpack_from(end + "I4xQ16xQ", data, at + i * size) for i in range(count)]
        needed = False
        for _, offset, length in (h for h in heads if h[0] == 2):
            if offset + length // 16 * 16 > len(data):
                return False, False, None, "truncated dynamic segment"
            tags = [struct.unpack_from(end + "q", data, offset + 16 * k)[0] for k in range(length // 16)]
            needed |= 1 in (tags[: tags.index(0)] if 0 in tags else tags)
        interp, dynamic = any(h[0] == 3 for h in heads), any(h[0] == 2 for h in heads)
        return interp, needed, "dynamic" if interp or needed else "static-pie" if dynamic else "static", None

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(path, x[3] is None, *x) for path, x in zip(b["path"], map(read, b["content"]))]
            yield pd.DataFrame(rows, columns=["path", "is_elf64_x86", "has_interp", "has_needed", "link_type", "problem"])

    return files.select("path", "content").mapInPandas(run, "path string, is_elf64_x86 boolean, has_interp boolean, has_needed boolean, link_type string, problem string")
