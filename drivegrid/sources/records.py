"""Tab-separated record files in full: route graphs, rule maps and edit logs.

Lines are rows ``run_id, line, value`` (``line``: the number in the file). Every record kind is
a list of typed fields; formatting and parsing follow from the list, line by line inside the
task. What a file must satisfy as a whole (versions, counts, contiguous positions, order) is
checked with groupings and comes back as a table of violations, so a broken file costs its
run only. Numbers are written in the shortest form that reads back to the same value.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from drivegrid.lib import ordered as O
from drivegrid.lib.buckets import broadcast_if_small
from drivegrid.session import cut_lineage
from drivegrid.sources.text_tables import escape, unescape

XYZ = ("x", "y", "z")


def _fields(text: str) -> list[tuple[str, str]]:
    return [tuple(f.split(":")) for f in text.split()]


# fixed values: fields of the records, in order, with their kinds. id?: "-" for none; bool: 1 or
# 0 (also true, yes); text: escaped; words and ids: joined by commas; points: x,y,z;x,y,z
NODE = _fields("node_id:id node_type:word x:num y:num z:num")
EDGE_1 = _fields(
    "edge_id:id from_id:id to_id:id reverse_of:id? passable:bool length:num min_width:num max_curvature:num confidence:num speed:num samples:id"
)
EDGE_2 = EDGE_1 + _fields("corridor_valid:bool errors:words")
SAMPLE_1 = _fields(
    "edge_id:id i:id x:num y:num z:num left_x:num left_y:num left_z:num right_x:num right_y:num right_z:num left_clearance:num right_clearance:num"
)
SAMPLE_2 = SAMPLE_1 + _fields("left_observed:bool right_observed:bool")
FEATURE = _fields(
    "feature_id:id type:word geometry:word enabled:bool x:num y:num z:num yaw:num value:num extent:num name:text notes:text edge_ids:ids"
)
VERTEX = _fields("feature_id:id i:id x:num y:num z:num")
SPAN_SHORT = _fields("feature_id:id i:id edge_id:id start_s:num end_s:num")
SPAN_LONG = SPAN_SHORT + _fields("ax:num ay:num az:num bx:num by:num bz:num")
OP = _fields(
    "op:id type:word node_id:zero edge_id:zero reverse_id:zero from_id:zero to_id:zero child1_id:zero child2_id:zero child1_reverse_id:zero "
    "child2_reverse_id:zero x:num y:num z:num split_s:num direction:way include_reverse:bool cascade:bool polyline:points"
)
OP_TYPES = ("clear_graph", "add_node", "move_node", "delete_node", "add_edge", "delete_edge", "split_edge", "set_direction")

_TYPES = {
    "id": "bigint", "id?": "bigint", "zero": "bigint", "num": "double", "bool": "boolean", "word": "string", "text": "string", "way": "string",
    "words": "array<string>", "ids": "array<bigint>", "points": "array<struct<x:double,y:double,z:double>>",
}


def _write(name: str, kind: str) -> Column:
    c = F.col(name)
    text = c.cast("string")
    if kind == "id?":
        return F.coalesce(text, F.lit("-"))
    if kind == "zero":
        return F.coalesce(text, F.lit("0"))
    if kind == "bool":
        return F.when(c, "1").otherwise("0")
    if kind == "text":
        return escape(F.coalesce(c, F.lit("")))
    if kind == "way":
        return F.when(c == "both", "bidirectional").otherwise("one_way")
    if kind in ("words", "ids"):
        return F.coalesce(F.array_join(c.cast("array<string>"), ","), F.lit(""))
    if kind == "points":
        return F.coalesce(F.array_join(F.transform(c, lambda p: F.concat_ws(",", *[p[a].cast("string") for a in XYZ])), ";"), F.lit(""))
    return F.coalesce(text, F.lit("0"))


def _read(raw: Column, kind: str) -> Column:
    if kind in ("id", "id?", "zero", "num"):
        value = raw.try_cast(_TYPES[kind])
        return F.nullif(value, F.lit(0).cast("bigint")) if kind == "zero" else value
    if kind == "bool":
        return raw.isin("1", "true", "yes")
    if kind == "text":
        return unescape(raw)
    if kind == "way":
        return F.when(raw == "bidirectional", "both").when(raw == "one_way", "one_way")
    if kind == "words":
        return F.filter(F.split(raw, ","), lambda t: t != "")
    if kind == "ids":
        return F.transform(F.filter(F.split(raw, ","), lambda t: t != ""), lambda t: t.try_cast("bigint"))
    if kind == "points":
        return F.transform(F.filter(F.split(raw, ";"), lambda t: t != ""), lambda t: F.struct(*[F.get(F.split(t, ","), F.lit(k)).try_cast("double").alias(a) for k, a in enumerate(XYZ)]))
    return raw


def _bad(raw: Column, kind: str) -> Column:
    """A field that does not read as its kind."""
    value = _read(raw, kind)
    if kind == "id?":
        return (raw != "-") & value.isNull()
    if kind == "zero":
        return raw.try_cast("bigint").isNull()
    if kind == "ids":
        return F.exists(value, lambda v: v.isNull())
    if kind == "points":
        return F.exists(F.filter(F.split(raw, ";"), lambda t: t != ""), lambda t: F.size(F.split(t, ",")) != 3) | F.exists(value, lambda p: p["x"].isNull() | p["y"].isNull() | p["z"].isNull())
    return value.isNull() if kind in ("id", "num", "way") else F.lit(False)


def _lines(df: DataFrame, tag: str, fields: list, rank: int, order: list[Column]) -> DataFrame:
    value = F.concat_ws("\t", F.lit(tag), *[_write(n, k) for n, k in fields])
    keys = [c.cast("bigint") for c in order] + [F.lit(None).cast("bigint")] * (2 - len(order))
    return df.select("run_id", F.lit(rank).alias("_r"), keys[0].alias("_a"), keys[1].alias("_b"), value.alias("value"))


def _file(runs: DataFrame, head: list[str], parts: list[DataFrame]) -> DataFrame:
    """Lines of a file in order, numbered from 1."""
    start = runs.select("run_id").distinct().select("run_id", F.posexplode(F.array(*map(F.lit, head))).alias("_a", "value"))
    every = start.select("run_id", F.lit(0).alias("_r"), F.col("_a").cast("bigint").alias("_a"), F.lit(None).cast("bigint").alias("_b"), "value")
    for p in parts:
        every = every.unionByName(p)
    numbered = O.index_rows(every, ["run_id"], ["_r", "_a", "_b"], index="line")
    return numbered.select("run_id", (F.col("line") + 1).alias("line"), "value")


def _split(lines: DataFrame) -> DataFrame:
    value = F.regexp_replace("value", "\r$", "")
    rows = lines.select("run_id", "line", value.alias("value")).filter((F.col("value") != "") & ~F.col("value").startswith("#"))
    return rows.withColumn("_f", F.split("value", "\t")).withColumn("_tag", F.get("_f", F.lit(0)))


def _pick(rows: DataFrame, fields: list, missing: dict[str, str] | None = None) -> DataFrame:
    cols = [_read(F.get("_f", F.lit(k + 1)), kind).alias(name) for k, (name, kind) in enumerate(fields)]
    none = [F.lit(None).cast(t).alias(n) for n, t in (missing or {}).items()]
    return rows.select("run_id", "line", *cols, *none)


def _broken(fields: list) -> Column:
    out = F.size("_f") != len(fields) + 1
    for k, (_, kind) in enumerate(fields):
        out = out | F.coalesce(_bad(F.get("_f", F.lit(k + 1)), kind), F.lit(True))
    return out


def _violation(df: DataFrame, code: str, at: str = "line", of: str | None = None) -> DataFrame:
    return df.select("run_id", F.lit(code).alias("code"), F.col(at).cast("bigint").alias("line") if at else F.lit(None).cast("bigint").alias("line"),
                     F.col(of).cast("bigint").alias("id") if of else F.lit(None).cast("bigint").alias("id"))


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _versions(rows: DataFrame, tags: Column, allowed: tuple[int, ...]) -> tuple[DataFrame, list[DataFrame]]:
    """The version of each run and what is wrong with it."""
    v = rows.filter(tags).withColumn("version", F.get("_f", F.lit(1)).try_cast("int"))
    ok = v.filter(F.col("version").isin(*allowed) & (F.size("_f") == 2))
    # a row for every run, read several times: the lines themselves must not meet by run
    per = cut_lineage(ok.groupBy("run_id").agg(F.max("version").alias("version")))
    gone = rows.select("run_id").distinct().join(per, "run_id", "left_anti").withColumn("line", F.lit(None).cast("bigint"))
    wrong = v.filter(~(F.col("version").isin(*allowed) & (F.size("_f") == 2)) | F.col("version").isNull())
    return per, [_violation(gone, "version_missing"), _violation(wrong, "version_unsupported")]


@dataclass
class GraphRecords:
    nodes: DataFrame
    edges: DataFrame
    samples: DataFrame
    frames: DataFrame
    violations: DataFrame


def format_graph(nodes: DataFrame, edges: DataFrame, samples: DataFrame, frame: str = "map", version: int = 2) -> DataFrame:
    """Route graph as VERSION, FRAME, NODE, EDGE and SAMPLE records (samples after all edges)."""
    edge, sample = (EDGE_2, SAMPLE_2) if version == 2 else (EDGE_1, SAMPLE_1)
    count = samples.groupBy("run_id", "edge_id").agg(F.count("*").alias("samples"))
    e = edges.drop("samples").join(count, ["run_id", "edge_id"], "left").withColumn("samples", F.coalesce("samples", F.lit(0)))
    return _file(nodes.select("run_id").unionByName(edges.select("run_id")), [f"VERSION\t{version}", f"FRAME\t{frame}"], [
        _lines(nodes, "NODE", NODE, 1, [F.col("node_id")]), _lines(e, "EDGE", edge, 2, [F.col("edge_id")]),
        _lines(samples, "SAMPLE", sample, 3, [F.col("edge_id"), F.col("i")]),
    ])


def parse_graph(lines: DataFrame) -> GraphRecords:
    """Route graph files of both versions. An edge of version 1 has a valid corridor where it
    is passable and no errors; its samples were not observed."""
    c = F.col
    rows = _split(lines)
    version, faults = _versions(rows, c("_tag") == "VERSION", (1, 2))
    rows = rows.join(broadcast_if_small(version), "run_id", "left")
    two = c("version") == 2
    of = lambda tag: rows.filter(c("_tag") == tag)
    arity = {"VERSION": F.size("_f") != 2, "FRAME": F.size("_f") != 2, "NODE": _broken(NODE), "EDGE": F.when(two, _broken(EDGE_2)).otherwise(_broken(EDGE_1)),
             "SAMPLE": F.when(two, _broken(SAMPLE_2)).otherwise(_broken(SAMPLE_1))}
    for tag, test in arity.items():
        if tag != "VERSION":
            faults.append(_violation(of(tag).filter(test), "malformed_record"))
    faults.append(_violation(rows.filter(~c("_tag").isin(*arity)), "unknown_record"))
    nodes = _pick(of("NODE").filter(~_broken(NODE)), NODE)
    edges = _pick(of("EDGE").filter(two & ~_broken(EDGE_2)), EDGE_2).unionByName(
        _pick(of("EDGE").filter(~two & ~_broken(EDGE_1)), EDGE_1).withColumns({"corridor_valid": c("passable"), "errors": F.array().cast("array<string>")}))
    samples = _pick(of("SAMPLE").filter(two & ~_broken(SAMPLE_2)), SAMPLE_2).unionByName(
        _pick(of("SAMPLE").filter(~two & ~_broken(SAMPLE_1)), SAMPLE_1).withColumns({"left_observed": F.lit(False), "right_observed": F.lit(False)}))
    first = edges.groupBy("run_id", "edge_id").agg(F.min("line").alias("edge_line"), F.max("samples").alias("declared"), F.count("*").alias("times"))
    early = samples.join(first, ["run_id", "edge_id"], "left").filter(c("edge_line").isNull() | (c("line") < c("edge_line")))
    faults.append(_violation(early, "sample_before_edge", of="edge_id"))
    faults.append(_violation(first.filter("times > 1").withColumn("line", c("edge_line")), "duplicate_edge", of="edge_id"))
    got = samples.groupBy("run_id", "edge_id").agg(F.count("*").alias("n"))
    short = first.join(got, ["run_id", "edge_id"], "left").filter(F.coalesce("n", F.lit(0)) != c("declared")).withColumn("line", c("edge_line"))
    faults.append(_violation(short, "sample_count_mismatch", of="edge_id"))
    # positions must come in order: the k-th sample line of an edge is sample k
    ranked = O.index_rows(samples.select("run_id", "edge_id", "line", "i"), ["run_id", "edge_id"], ["line"], index="k")
    faults.append(_violation(ranked.filter("i <> k"), "sample_index_not_contiguous", of="edge_id"))
    frames = of("FRAME").select("run_id", F.get("_f", F.lit(1)).alias("frame"))
    return GraphRecords(nodes.drop("line"), edges.drop("line"), samples.drop("line"), frames, _union(faults))


@dataclass
class RuleRecords:
    features: DataFrame
    vertices: DataFrame
    spans: DataFrame
    violations: DataFrame


def format_rules(features: DataFrame, vertices: DataFrame, spans: DataFrame, header: str = "MAP_SEMANTICS", frame: str = "map") -> DataFrame:
    """Rule map as header (version 2), FRAME, FEATURE, VERTEX and SPAN records; a span without
    anchors is written in its short form."""
    both = F.lit(True)
    for name, _ in SPAN_LONG[5:]:
        both = both & F.col(name).isNotNull()
    return _file(features, [f"{header}\t2", f"FRAME\t{frame}"], [
        _lines(features, "FEATURE", FEATURE, 1, [F.col("feature_id")]), _lines(vertices, "VERTEX", VERTEX, 2, [F.col("feature_id"), F.col("i")]),
        _lines(spans.filter(both), "SPAN", SPAN_LONG, 3, [F.col("feature_id"), F.col("i")]), _lines(spans.filter(~both), "SPAN", SPAN_SHORT, 4, [F.col("feature_id"), F.col("i")]),
    ])


def parse_rules(lines: DataFrame) -> RuleRecords:
    """Rule maps of both versions; the header is any record whose name ends in SEMANTICS."""
    c = F.col
    rows = _split(lines)
    version, faults = _versions(rows, c("_tag").endswith("SEMANTICS"), (1, 2))
    rows = rows.join(broadcast_if_small(version), "run_id", "left")
    of = lambda tag: rows.filter(c("_tag") == tag)
    long_ = F.size("_f") == len(SPAN_LONG) + 1
    span_bad = F.when(long_, _broken(SPAN_LONG)).otherwise(_broken(SPAN_SHORT))
    for tag, test in (("FRAME", F.size("_f") != 2), ("FEATURE", _broken(FEATURE)), ("VERTEX", _broken(VERTEX)), ("SPAN", span_bad)):
        faults.append(_violation(of(tag).filter(test), "malformed_record"))
    faults.append(_violation(of("SPAN").filter(c("version") == 1), "span_needs_version_2"))
    faults.append(_violation(rows.filter(~c("_tag").isin("FRAME", "FEATURE", "VERTEX", "SPAN") & ~c("_tag").endswith("SEMANTICS")), "unknown_record"))
    features = _pick(of("FEATURE").filter(~_broken(FEATURE)), FEATURE)
    vertices = _pick(of("VERTEX").filter(~_broken(VERTEX)), VERTEX)
    anchors = {n: "double" for n, _ in SPAN_LONG[5:]}
    spans = _pick(of("SPAN").filter(long_ & ~_broken(SPAN_LONG)), SPAN_LONG).unionByName(_pick(of("SPAN").filter(~long_ & ~_broken(SPAN_SHORT)), SPAN_SHORT, anchors))
    twice = features.groupBy("run_id", "feature_id").agg(F.count("*").alias("n"), F.max("line").alias("line")).filter("n > 1")
    faults.append(_violation(twice, "duplicate_feature", of="feature_id"))
    known = features.select("run_id", "feature_id").distinct()
    for name, part in (("vertex", vertices), ("span", spans)):
        faults.append(_violation(part.join(known, ["run_id", "feature_id"], "left_anti"), f"{name}_of_unknown_feature", of="feature_id"))
        per = part.groupBy("run_id", "feature_id").agg(F.min("i").alias("lo"), F.max("i").alias("hi"), F.count("*").alias("n"), F.count_distinct("i").alias("d"), F.min("line").alias("line"))
        faults.append(_violation(per.filter("n <> d"), f"duplicate_{name}", of="feature_id"))
        faults.append(_violation(per.filter("n = d AND (lo <> 0 OR hi <> n - 1)"), f"{name}_index_not_contiguous", of="feature_id"))
    return RuleRecords(features.drop("line"), vertices.drop("line"), spans.drop("line"), _union(faults))


def format_edits(ops: DataFrame, frame: str = "map", base: str = "", version: int = 1) -> DataFrame:
    """Edit log with its head: next free ids follow the largest in use. The new node of a split
    (``new_node_id``) stands in the node field."""
    ops = ops.withColumn("node_id", F.coalesce("new_node_id", "node_id")) if "new_node_id" in ops.columns else ops
    ids = [n for n, k in OP if k == "zero"]
    top = ops.groupBy("run_id").agg((F.max("op") + 1).alias("next_op"), (F.greatest(*[F.coalesce(F.max(n), F.lit(0)) for n in ids]) + 1).alias("next_id"))
    nexts = [top.select("run_id", F.lit(1).alias("_r"), F.lit(k).cast("bigint").alias("_a"), F.lit(None).cast("bigint").alias("_b"), F.concat(F.lit(f"{tag}\t"), F.col(n).cast("string")).alias("value"))
             for k, (tag, n) in enumerate((("NEXT_OPERATION_ID", "next_op"), ("NEXT_ENTITY_ID", "next_id")))]
    return _file(ops, [f"VERSION\t{version}", f"FRAME\t{frame}", f"BASE\t{base}"], [*nexts, _lines(ops, "OP", OP, 2, [F.col("op")])])


def parse_edits(lines: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(operations, heads, violations). Operations carry all 19 fields; an id of 0 is none."""
    c = F.col
    rows = _split(lines)
    _, faults = _versions(rows, c("_tag") == "VERSION", (1,))
    named = ~F.get("_f", F.lit(2)).isin(*OP_TYPES)
    o = rows.filter(c("_tag") == "OP")
    faults.append(_violation(o.filter(_broken(OP) | named), "malformed_record"))
    faults.append(_violation(rows.filter(~c("_tag").isin("VERSION", "FRAME", "BASE", "NEXT_OPERATION_ID", "NEXT_ENTITY_ID", "OP")), "unknown_record"))
    ops = _pick(o.filter(~_broken(OP) & ~named), OP)
    twice = ops.groupBy("run_id", "op").agg(F.count("*").alias("n"), F.max("line").alias("line")).filter("n > 1")
    faults.append(_violation(twice, "duplicate_operation", of="op"))
    # a split names its new node in the node field
    split = c("type") == "split_edge"
    ops = ops.withColumn("new_node_id", F.when(split, c("node_id"))).withColumn("node_id", F.when(~split, c("node_id")))
    head = lambda tag, name, kind: F.max(F.when(c("_tag") == tag, F.get("_f", F.lit(1)).try_cast(kind))).alias(name)
    heads = rows.groupBy("run_id").agg(head("FRAME", "frame", "string"), head("BASE", "base", "string"), head("NEXT_OPERATION_ID", "next_op", "bigint"), head("NEXT_ENTITY_ID", "next_id", "bigint"))
    return ops.drop("line"), heads, _union(faults)
