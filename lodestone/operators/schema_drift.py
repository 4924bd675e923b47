"""One consistent table out of JSON files whose schemas drift, and a report of every change.

Lines are reduced on the JVM to the distinct schemas of each file (a file has few, however many
lines it has). Over the distinct schemas similarity flooding matches each file's schema graph with
the target's and with the graph of the file before; the chosen correspondences drive the casts of
the union and the change report.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Mapping

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions import flooding
from lodestone.functions.flooding import Leaf, SchemaGraph, correspondences, trigrams
from lodestone.plans.session import cut
from lodestone.plans.skew import spread

LEAF = "array<struct<path:array<string>,kind:string>>"
NUMBERS = ("TINYINT", "SMALLINT", "INT", "BIGINT", "FLOAT", "DOUBLE", "DECIMAL")


def with_object(lines: DataFrame, payload: str) -> DataFrame:
    """``lines`` and ``__object``: the payload as a variant if it is exactly one JSON object, else null.

    Inside brackets, cut-off text and anything after the object are errors of the array. An object
    that names a key twice has no single reading and counts as not whole. Each text is parsed once.
    """
    held = lines.withColumn("__held", F.try_parse_json(F.concat(F.lit("["), F.col(payload), F.lit("]"))))
    one = held.withColumn("__one", F.try_variant_get("__held", "$[0]", "variant"))
    single = F.try_variant_get("__held", "$[1]", "variant").isNull()
    shaped = one.withColumn("__shape", F.when(single, F.schema_of_variant("__one")))
    return shaped.withColumn("__object", F.when(F.col("__shape").startswith("OBJECT"), F.col("__one"))).drop("__held", "__one")


def read_shape(shape: str) -> list[Leaf]:
    """The leaves (path, JSON type) of a ``schema_of_variant`` text; keys that hold null are left out."""
    at, leaves = 0, []

    def kind(path: tuple[str, ...]) -> None:
        nonlocal at
        word = re.compile(r"[A-Z_]+").match(shape, at).group()
        at += len(word)
        if word == "OBJECT":
            at += 1
            while shape[at] != ">":
                if shape[at] == "`":
                    end = re.compile(r"`((?:[^`]|``)*)`").match(shape, at)
                    name = end.group(1).replace("``", "`")
                else:
                    end = re.compile(r"([^:]*)").match(shape, at)
                    name = end.group(1)
                at = end.end() + 2
                kind((*path, name))
                if shape[at] == ",":
                    at += 2
            at += 1
            return
        if at < len(shape) and shape[at] in "<(":
            depth = 0
            quoted = False
            while True:
                c = shape[at]
                at += 1
                quoted ^= c == "`"
                depth += (not quoted) * ((c in "<(") - (c in ">)"))
                if not depth:
                    break
        if word != "VOID":
            leaves.append((path, "number" if word in NUMBERS else word.lower()))

    kind(())
    return leaves


def _leaves(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        yield pd.DataFrame({"shape": b["shape"], "leaves": [[{"path": list(p), "kind": k} for p, k in read_shape(s)] for s in b["shape"]]})


def file_schemas(lines: DataFrame) -> DataFrame:
    """``campaign_id, file_seq, file_id, leaves`` of every file; leaves is sorted, and empty where no line is a whole object.

    Repeated lines and files delivered twice change nothing, as schemas are sets.
    """
    parsed = with_object(lines.select("campaign_id", "file_seq", "file_id", "payload"), "payload")
    shape = F.when(F.col("__shape").startswith("OBJECT"), F.col("__shape")).alias("shape")
    # lines are parsed once: their distinct schemas, a few a file, are needed twice
    shapes = cut(parsed.select("campaign_id", "file_seq", "file_id", shape).distinct())
    known = spread(shapes.select("shape").filter("shape is not null").distinct(), "shape").mapInPandas(_leaves, f"shape string, leaves {LEAF}")
    return (
        shapes.join(known, "shape", "left")
        .groupBy("campaign_id", "file_seq", "file_id")
        .agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("leaves")))).alias("leaves"))
    )


def target_matcher(markers: Mapping[str, tuple[str, str]]):
    """``leaves -> [(field, path, kind)]``: flooding of a file's schema graph with the target's.

    ``markers`` has of each target field the letters its keys carry and its JSON type. The letters are the
    string matcher that gives the flooding its first scores; any other pair starts from its names' likeness.
    After convergence ``correspondences`` selects, for each path, the target fields that stand out in its
    scores; an exact check then drops what was selected without the letters. A file may spread a field over
    several paths, and a path may carry the letters of more than one field.
    """
    target = SchemaGraph([((f,), kind) for f, (_, kind) in markers.items()])

    known: dict[tuple, list[tuple[str, tuple[str, ...], str]]] = {}

    def match(leaves: list[Leaf]) -> list[tuple[str, tuple[str, ...], str]]:
        key = tuple(leaves)
        if key not in known:
            if len(known) > 20_000:
                known.clear()
            known[key] = one(leaves)
        return known[key]

    def one(leaves: list[Leaf]) -> list[tuple[str, tuple[str, ...], str]]:
        own = SchemaGraph(leaves)
        carries = {(p, (f,)): 1.0 for p in own.paths for f, (mark, _) in markers.items() if mark in "/".join(p).lower()}
        chosen: dict[tuple[str, ...], list[str]] = {}
        for path, field, _ in correspondences(own, target, flooding.flood(own, target, carries), relative=0.35, many=True):
            if (path, field) in carries:
                chosen.setdefault(path, []).append(field[0])
        return [(f, path, kind) for path, kind in leaves for f in chosen.get(path, ())]

    return match


def _pairs(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(file_id, prior_key, leaves_key)`` of every file whose schema is another than that of the file before it in its
    campaign, and the distinct pairs of schemas ``(prior_key, leaves_key, prior, leaves)``.

    Only keys of schemas meet in a campaign's window; there are few distinct schemas, however many files.
    """
    keyed = files.filter("campaign_id is not null and file_seq is not null").select("campaign_id", "file_seq", "file_id", F.xxhash64("leaves").alias("leaves_key"), "leaves")
    before = Window.partitionBy("campaign_id").orderBy("file_seq").rangeBetween(Window.unboundedPreceding, -1)
    prior = F.max(F.struct("file_seq", "file_id", "leaves_key")).over(before)["leaves_key"]
    pairs = keyed.select("campaign_id", "file_seq", "file_id", "leaves_key").withColumn("prior_key", prior)
    pairs = pairs.filter("prior_key is not null and prior_key <> leaves_key").select("file_id", "prior_key", "leaves_key")
    schemas = keyed.groupBy("leaves_key").agg(F.first("leaves").alias("leaves"))
    distinct = pairs.select("prior_key", "leaves_key").distinct().join(schemas, "leaves_key").join(schemas.toDF("prior_key", "prior"), "prior_key")
    return pairs, spread(distinct, "prior_key", "leaves_key")


def _read(leaves) -> list[Leaf]:
    return [(tuple(x["path"]), x["kind"]) for x in leaves]


def _text(path) -> str:
    return ".".join(path)


def field_changes(files: DataFrame, markers: Mapping[str, tuple[str, str]]) -> DataFrame:
    """Changes of the target fields from file to file: ``file_id, field_name, change_kind, old_path, new_path, old_type, new_type``.

    The first file of a campaign has none to be compared with; a file without any whole object
    takes part as one that has no field. Files without campaign or sequence are left out. Paths
    and types are joined by ``|`` where a file has several.
    """
    schema = "prior_key bigint, leaves_key bigint, field_name string, change_kind string, old_path string, new_path string, old_type string, new_type string"
    seen: list[tuple] = list(markers.items())

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        match, known = target_matcher(dict(seen)), {}

        def fields(leaves) -> dict[str, tuple[frozenset, frozenset]]:
            key = tuple(_read(leaves))
            if key not in known:
                if len(known) > 20_000:
                    known.clear()
                found: dict[str, tuple[set, set]] = {}
                for field, path, kind in match(list(key)):
                    p, k = found.setdefault(field, (set(), set()))
                    p.add(path)
                    k.add(kind)
                known[key] = {f: (frozenset(p), frozenset(k)) for f, (p, k) in found.items()}
            return known[key]

        for b in batches:
            rows = []
            for pk, lk, old, new in zip(b["prior_key"], b["leaves_key"], b["prior"], b["leaves"]):
                was, has = fields(old), fields(new)
                for f, _ in seen:
                    (op, ok), (np_, nk) = was.get(f, ((), ())), has.get(f, ((), ()))
                    kinds = ["added"] * (not op) if np_ else ["removed"] * bool(op)
                    if op and np_:
                        kinds = ["renamed"] * (op != np_) + ["retyped"] * (ok != nk)
                    shown = ["|".join(sorted(map(_text, op))) or None, "|".join(sorted(map(_text, np_))) or None, "|".join(sorted(ok)) or None, "|".join(sorted(nk)) or None]
                    rows += [(pk, lk, f, k, *shown) for k in kinds]
            yield pd.DataFrame(rows, columns=[x.split()[0] for x in schema.split(", ")])

    pairs, distinct = _pairs(files)
    return pairs.join(distinct.mapInPandas(run, schema), ["prior_key", "leaves_key"]).drop("prior_key", "leaves_key")


def all_changes(files: DataFrame) -> DataFrame:
    """Every key's change from file to file, by flooding each schema with the one before.

    ``file_id, change_kind, old_path, new_path, old_type, new_type, score``; the flooding runs once for each distinct pair
    of schemas, however many files share it.
    """
    schema = "prior_key bigint, leaves_key bigint, change_kind string, old_path string, new_path string, old_type string, new_type string, score double"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for ok, nk, old, new in zip(b["prior_key"], b["leaves_key"], b["prior"], b["leaves"]):
                was, has = _read(old), _read(new)
                kinds = [{}, {}]
                for side, leaves in zip(kinds, (was, has)):
                    for p, k in leaves:
                        side[p] = "|".join(sorted({*filter(None, side.get(p, "").split("|")), k}))
                same = set(kinds[0]) & set(kinds[1])
                a, c = SchemaGraph(was), SchemaGraph(has)
                # a key both files have under one path corresponds to itself
                s = flooding.flood(a, c, {(p, p): 1.0 for p in same})
                at, bt = {p: i for i, p in enumerate(a.paths)}, {p: i for i, p in enumerate(c.paths)}
                for p in same:
                    s[at[p], :] = 0
                    s[:, bt[p]] = 0
                # only keys whose paths share letters may be renamings of one another
                ga, gb = [trigrams("".join(p)) for p in a.paths], [trigrams("".join(q)) for q in c.paths]
                s *= [[not x.isdisjoint(y) for y in gb] for x in ga]
                s /= s.max(initial=0) or 1.0
                for p in same:
                    s[at[p], bt[p]] = 1.0
                pairs = correspondences(a, c, s)
                for p, q, score in pairs:
                    shown = (_text(p), _text(q), kinds[0][p], kinds[1][q], round(score, 4))
                    rows += [(ok, nk, "renamed", *shown)] * (p != q) + [(ok, nk, "retyped", *shown)] * (kinds[0][p] != kinds[1][q])
                rows += [(ok, nk, "removed", _text(p), None, k, None, None) for p, k in kinds[0].items() if p not in {x[0] for x in pairs}]
                rows += [(ok, nk, "added", None, _text(q), None, k, None) for q, k in kinds[1].items() if q not in {x[1] for x in pairs}]
            yield pd.DataFrame(rows, columns=[x.split()[0] for x in schema.split(", ")])

    pairs, distinct = _pairs(files)
    return pairs.join(distinct.mapInPandas(run, schema), ["prior_key", "leaves_key"]).drop("prior_key", "leaves_key")


def rejected(lines: DataFrame) -> DataFrame:
    """The lines that ``unified`` cannot read: ``file_id, line_no, reason``, each once.

    ``reason`` is ``null``, ``empty``, ``broken`` (cut off, trailing text, or a key named twice) or ``no_object``.
    """
    read = with_object(lines.select("file_id", "line_no", "payload"), "payload")
    reason = F.when(F.col("payload").isNull(), "null").when(F.trim("payload") == "", "empty").when(F.col("__shape").isNull(), "broken").otherwise("no_object")
    return read.filter(F.col("__object").isNull()).select("file_id", "line_no", reason.alias("reason")).distinct()


def unified(lines: DataFrame, files: DataFrame, markers: Mapping[str, tuple[str, str]], casts: Mapping[str, object]) -> DataFrame:
    """Every distinct whole line of every file with one typed column for each target field.

    ``casts`` has of each field a function from the raw text to the typed column. A line delivered
    twice comes out once. The paths of a file come from its own schema, so no name is fixed; a key that has
    both a quote and a dot or bracket cannot be addressed and gives null. Lines that are no whole object are in ``rejected``.
    """
    schema = "file_id bigint, " + ", ".join(f"`{f}` array<string>" for f in markers)
    seen = list(markers.items())

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        match = target_matcher(dict(seen))
        for b in batches:
            rows = []
            for file_id, leaves in zip(b["file_id"], b["leaves"]):
                paths: dict[str, list[str]] = {f: [] for f, _ in seen}
                for f, path, _ in match(_read(leaves)):
                    if not any("'" in x and set(x) & set(".[") for x in path):
                        paths[f].append("$" + "".join(f".{x}" if "'" in x else f"['{x}']" for x in path))
                rows.append((file_id, *(sorted(set(paths[f])) for f, _ in seen)))
            yield pd.DataFrame(rows, columns=["file_id", *(f for f, _ in seen)])

    routes = spread(files.filter("size(leaves) > 0").select("file_id", "leaves"), "file_id").mapInPandas(run, schema)
    for f in markers:
        routes = routes.withColumnRenamed(f, f"__{f}")
    body = with_object(lines.select("file_id", "line_no", "payload"), "payload").filter(F.col("__object").isNotNull()).select("file_id", "line_no", "payload").distinct()
    raw = {f: F.expr(f"get(filter(transform(`__{f}`, p -> get_json_object(payload, p)), x -> x is not null), 0)") for f in markers}
    return body.join(routes, "file_id").select("file_id", "line_no", *(casts[f](raw[f]).alias(f) for f in markers))
