"""Route graphs as tables: nodes (run_id, node_id, ...) and edges (run_id, edge_id, from_id,
to_id, ...)."""

from __future__ import annotations

import itertools
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from drivegrid.functions import vec as V
from drivegrid.functions.num import finite, reason_codes
from drivegrid.lib import ordered as O
from drivegrid.lib.buckets import bucket
from drivegrid.lib.doubling import connected_components, rank_lists
from drivegrid.session import cut_lineage

EDGE = ["run_id", "edge_id"]
# fixed values: limits of a verified terminal tail and of a terminal successor
CUSP_MIN_JUMP_DEG = 150.0
TAIL_MAX_M = 1.0
TAIL_MAX_RATIO = 0.01
TAIL_MAX_YAW_DEG = 15.0
SUCCESSOR_MAX_JUMP_DEG = 30.0
SUCCESSOR_GAP_M = 1.0e-3


def both_ends(edges: DataFrame, *extra: str) -> DataFrame:
    """One row per edge end: node_id, other node, and the extra columns."""
    pair = F.explode(F.array(
        F.struct(F.col("from_id").alias("node_id"), F.col("to_id").alias("other_id")),
        F.struct(F.col("to_id").alias("node_id"), F.col("from_id").alias("other_id")),
    )).alias("e")
    return edges.select("run_id", *extra, pair).select("run_id", *extra, "e.*")


def dedupe_undirected(edges: DataFrame, order: str = "edge_id") -> DataFrame:
    """One edge per unordered node pair: the first one seen keeps its direction."""
    rest = F.struct(*[c for c in edges.columns if c != "run_id"])
    pair = [F.least("from_id", "to_id").alias("_a"), F.greatest("from_id", "to_id").alias("_b")]
    return edges.groupBy("run_id", *pair).agg(F.min_by(rest, order).alias("e")).select("run_id", "e.*")


def node_degree(edges: DataFrame) -> DataFrame:
    """Distinct neighbours per node and the node type that follows from them."""
    near = both_ends(edges).distinct().groupBy("run_id", "node_id").agg(F.count("*").alias("degree"))
    kind = F.when(F.col("degree") <= 1, "endpoint").when(F.col("degree") >= 3, "junction").otherwise("normal")
    return near.withColumn("node_type", kind)


def component_summary(edges: DataFrame, passable_only: bool = True) -> DataFrame:
    """Per run: nodes, weakly connected components, connected or not."""
    e = edges.filter("passable") if passable_only else edges
    c = connected_components(e, a="from_id", b="to_id")
    return c.groupBy("run_id").agg(
        F.count("*").alias("nodes"), F.count_if(F.col("node") == F.col("component")).alias("components")
    ).withColumn("connected", F.col("components") == 1)


def maximal_chains(edges: DataFrame) -> DataFrame:
    """Directed chains without branches over passable edges: ``run_id, edge_id, head_edge_id,
    pos, closed``.  A cycle starts at its lowest edge id."""
    e = edges.filter("passable").select("run_id", "edge_id", "from_id", "to_id")
    out_n = e.groupBy("run_id", F.col("from_id").alias("node_id")).agg(F.count("*").alias("n_out"))
    in_n = e.groupBy("run_id", F.col("to_id").alias("node_id")).agg(F.count("*").alias("n_in"), F.min("edge_id").alias("pred"))
    inner = out_n.join(in_n, ["run_id", "node_id"]).filter("n_out = 1 AND n_in = 1")
    links = e.join(inner.select("run_id", F.col("node_id").alias("from_id"), "pred"), ["run_id", "from_id"], "left")
    r = rank_lists(links.select("run_id", F.col("edge_id").alias("item"), "pred"))
    return r.select("run_id", F.col("item").alias("edge_id"), F.col("root").alias("head_edge_id"), "pos", "on_cycle")


def revisit_pairs(poses: DataFrame, near: float = 0.45, crossing: float = 0.30, same_deg: float = 25.0, cross_deg: float = 50.0, min_separation: float = 2.0) -> DataFrame:
    """Pose pairs of a drive that visit the same place at least ``min_separation`` of arc
    apart, along the same path or crossing it.  ``poses``: run_id, i, x, y, z, s, heading,
    cusp.  Each pose looks up the neighbouring cells; later poses find earlier ones."""
    size = max(0.05, near, crossing)
    p = poses.filter(~F.col("cusp")).withColumns({"_bx": bucket(F.col("x"), size), "_by": bucket(F.col("y"), size)})
    o = p.select("run_id", "_bx", "_by", *[F.col(c).alias(f"o_{c}") for c in ("i", "x", "y", "z", "s", "heading")])
    axis = lambda c: F.explode(F.array(F.col(c) - 1, F.col(c), F.col(c) + 1))
    probe = p.withColumn("_cx", axis("_bx")).withColumn("_bx", F.col("_cx")).withColumn("_cy", axis("_by")).withColumn("_by", F.col("_cy"))
    c = F.col
    same, cross = _visits(near, crossing, same_deg, cross_deg, min_separation)
    j = probe.join(o, ["run_id", "_bx", "_by"]).filter(c("o_i") < c("i"))
    return j.filter(same | cross).select(
        "run_id", c("o_i").alias("a"), c("i").alias("b"), F.when(same, "same_path").otherwise("crossing").alias("kind")
    )


def _visits(near: float, crossing: float, same_deg: float, cross_deg: float, min_separation: float) -> tuple[Column, Column]:
    """A pose and another one (``o_*``) revisit a place along the same path, or crossing it."""
    c = F.col
    far = F.abs(c("s") - c("o_s")) >= min_separation
    d = V.dist2(c("x"), c("y"), c("o_x"), c("o_y"))
    dz = F.abs(c("z") - c("o_z"))
    diff = V.undirected_heading_diff(c("heading"), c("o_heading"))
    return far & (d <= near) & (dz <= near) & (diff <= math.radians(same_deg)), far & (d <= crossing) & (dz <= crossing) & (diff >= math.radians(cross_deg))


def revisit_components(poses: DataFrame, near: float = 0.45, crossing: float = 0.30, same_deg: float = 25.0, cross_deg: float = 50.0, min_separation: float = 2.0) -> DataFrame:
    """``revisit_places`` of ``revisit_pairs`` (``run_id, node, component``) without a table of pairs.

    Poses of one small cell and sector are linked exactly when their arc positions are far enough
    apart: all that are linked at all hang together with the first and the last one. Such parts,
    seen by a few poses of each cell, are joined to components. Pairs of poses are then tested only
    where neighbouring cells hold different components."""
    c, size, sectors = F.col, near / 1.5, math.ceil(180.0 / (0.6 * same_deg))
    reach = math.ceil(max(near, crossing) / size)
    cell = ["run_id", "_bx", "_by", "_bz", "_bh"]
    pose = ["i", "x", "y", "z", "s", "heading"]
    p = poses.filter(~c("cusp")).select("run_id", *pose).withColumns({
        "_bx": bucket(c("x"), size), "_by": bucket(c("y"), size), "_bz": bucket(c("z"), 0.9 * near),
        "_bh": F.floor((c("heading") + math.pi) * (sectors / math.pi)) % sectors,
    })
    p = cut_lineage(p)
    ends = p.groupBy(*cell).agg(F.min(F.struct("s", "i")).alias("_lo"), F.max("s").alias("_hi"))
    linked = (F.abs(c("s") - c("_lo.s")) >= min_separation) | (F.abs(c("s") - c("_hi")) >= min_separation)
    p = p.join(ends, cell).withColumns({"part": F.when(linked, c("_lo.i")).otherwise(c("i")), "_whole": linked}).drop("_lo", "_hi")
    p = cut_lineage(p)
    same, cross = _visits(near, crossing, same_deg, cross_deg, min_separation)
    other = lambda df, *keys: df.select(*keys, *[c(v).alias(f"o_{v}") for v in df.columns if v not in keys])
    steps = F.sequence(F.lit(-reach).cast("long"), F.lit(reach).cast("long"))

    def around(df: DataFrame) -> DataFrame:
        moved = df.withColumn("_dx", F.explode(steps)).withColumn("_dy", F.explode(steps))
        return moved.withColumns({"_bx": c("_bx") + c("_dx"), "_by": c("_by") + c("_dy")}).drop("_dx", "_dy")

    row = F.struct("part", *pose)
    seen = F.array(*[pick(row, v) for v in ("s", "x", "y") for pick in (F.min_by, F.max_by)])
    some = p.groupBy(*cell).agg(F.array_distinct(seen).alias("r")).select("run_id", "_bx", "_by", F.explode("r").alias("r")).select("run_id", "_bx", "_by", "r.*")
    some = cut_lineage(some)
    square = ["run_id", "_bx", "_by"]
    links = around(some).join(other(some, *square), square).filter((c("part") < c("o_part")) & (same | cross))
    links = cut_lineage(links.select("run_id", c("part").alias("a"), c("o_part").alias("b")).distinct())
    at = connected_components(links, a="a", b="b").select("run_id", c("node").alias("part"), "component")
    p = cut_lineage(p.join(at, ["run_id", "part"], "left").withColumn("component", F.coalesce("component", "part")))
    # what is left: neighbouring cells of different components
    groups = cut_lineage(p.select(*square, "component").distinct())
    home = groups.withColumns({"_hx": c("_bx"), "_hy": c("_by")})
    open_ = around(home).join(other(groups, *square), square).filter(c("component") < c("o_component")).select(
        "run_id", c("_hx").alias("_ax"), c("_hy").alias("_ay"), "component", "_bx", "_by", "o_component"
    )
    mine = p.select("run_id", c("_bx").alias("_ax"), c("_by").alias("_ay"), "component", *pose)
    theirs = other(p.select(*square, "component", *pose), *square)
    met = open_.join(mine, ["run_id", "_ax", "_ay", "component"]).join(theirs, [*square, "o_component"]).filter(same | cross)
    more = cut_lineage(met.select("run_id", c("component").alias("a"), c("o_component").alias("b")).distinct())
    last = connected_components(more, a="a", b="b").select("run_id", c("node").alias("component"), c("component").alias("_to"))
    p = p.join(last, ["run_id", "component"], "left").withColumn("component", F.coalesce("_to", "component"))
    alone = p.groupBy("run_id", "component").agg(F.count("*").alias("_n")).filter("_n = 1").select("run_id", "component")
    return p.join(alone, ["run_id", "component"], "left_anti").select("run_id", c("i").alias("node"), "component")


def revisit_places(pairs: DataFrame) -> DataFrame:
    """Bound of the clusters: connected components of the revisit pairs."""
    return connected_components(pairs, a="a", b="b")


def bounded_paths(edges: DataFrame, queries: DataFrame) -> DataFrame:
    """Simple directed paths from ``from_node`` to ``to_node`` no longer than ``max_length``:
    ``run_id, query_id, paths, shortest, hops, via, ambiguous`` (another path ties within 1e-7;
    ``via``: the edges of the shortest one).

    A level-by-level frontier join; a partial path is dropped as soon as it is too long or
    meets a node twice, so the loop ends when every path has arrived or is too long.
    """
    e = edges.select("run_id", F.col("edge_id").alias("e"), F.col("from_id").alias("node"), F.col("to_id").alias("nxt"), F.greatest("length", F.lit(1.0e-6)).alias("w"))
    start = queries.select("run_id", "query_id", F.col("from_node").alias("node"), "to_node", "max_length", F.lit(0.0).alias("len"), F.array("from_node").alias("seen"), F.array().cast("array<bigint>").alias("via"))
    trivial = start.filter("node = to_node").select("run_id", "query_id", F.lit(0.0).alias("len"), F.lit(0).alias("hops"), "via")
    front, found = start.filter("node <> to_node"), [cut_lineage(trivial)]
    for hop in itertools.count(1):
        step = front.join(e, ["run_id", "node"]).withColumn("len", F.col("len") + F.col("w"))
        step = step.filter((F.col("len") <= F.col("max_length") + 1.0e-9) & ~F.array_contains("seen", F.col("nxt")))
        step = cut_lineage(step.select("run_id", "query_id", F.col("nxt").alias("node"), "to_node", "max_length", "len", F.array_append("seen", F.col("nxt")).alias("seen"), F.array_append("via", F.col("e")).alias("via")))
        found.append(step.filter("node = to_node").select("run_id", "query_id", "len", F.lit(hop).alias("hops"), "via"))
        front = step.filter("node <> to_node")
        if front.isEmpty():
            break
    every = found[0]
    for f in found[1:]:
        every = every.unionByName(f)
    low = every.groupBy("run_id", "query_id").agg(F.min("len").alias("shortest"), F.count("*").alias("paths"), F.min_by("hops", F.struct("len", "hops")).alias("hops"), F.min_by("via", F.struct("len", "hops", "via")).alias("via"))
    tie = every.join(low.select("run_id", "query_id", "shortest"), ["run_id", "query_id"]).groupBy("run_id", "query_id").agg((F.count_if(F.col("len") <= F.col("shortest") + 1.0e-7) > 1).alias("ambiguous"))
    return low.join(tie, ["run_id", "query_id"])


def open_chain_route(edges: DataFrame, order: str = "edge_id") -> DataFrame:
    """Per run: is the whole graph, in stored order, one directed chain without a repeated
    node; first and last node; reason codes."""
    e = O.index_rows(edges.select("run_id", "from_id", "to_id", "passable", order), ["run_id"], [order], index="k")
    n = O.with_neighbours(e, ["run_id"], "k", ["to_id"], back=1, ahead=0)
    broken = F.col("to_id_p1").isNotNull() & (F.col("to_id_p1") != F.col("from_id"))
    line = n.groupBy("run_id").agg(
        F.count("*").alias("edges"), F.min_by("from_id", "k").alias("start_node_id"), F.max_by("to_id", "k").alias("end_node_id"),
        F.count_if(broken).alias("breaks"), F.count_if(~F.col("passable")).alias("blocked"),
    )
    first = n.filter("k = 0").select("run_id", F.col("from_id").alias("node"))
    seen = n.select("run_id", F.col("to_id").alias("node")).unionByName(first)
    again = seen.groupBy("run_id", "node").count().groupBy("run_id").agg(F.count_if(F.col("count") > 1).alias("repeated"))
    out = line.join(again, "run_id")
    codes = reason_codes(
        (F.col("blocked") > 0, "contains_a_non_passable_edge"), (F.col("breaks") > 0, "not_one_directed_chain"), (F.col("repeated") > 0, "cycle_or_repeated_node"),
    )
    return out.withColumns({"errors": codes}).withColumn("valid", F.size("errors") == 0)


def select_route_graph(edges: DataFrame, nodes: DataFrame, route: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Ordered sub-graph of named routes (``run_id, route_id, pos, edge_id``)."""
    e = route.join(edges, EDGE)
    used = e.select("run_id", "route_id", F.explode(F.array("from_id", "to_id")).alias("node_id")).distinct()
    return e, nodes.join(used, ["run_id", "node_id"])


def terminal_successor(routes: DataFrame, edges: DataFrame) -> DataFrame:
    """The one way on from the end of each named route, or the first reason why not.

    ``routes``: run_id, route_id, pos, edge_id.  ``edges``: run_id, edge_id, from_id, to_id,
    passable, reverse_of, and end geometry (sx, sy, sz, ex, ey, ez, start heading sh, end
    heading eh).
    """
    last = routes.groupBy("run_id", "route_id").agg(F.max_by("edge_id", "pos").alias("edge_id"))
    term = last.join(edges.select(*EDGE, F.col("to_id").alias("t_to"), *[F.col(c).alias(f"t_{c}") for c in ("ex", "ey", "ez", "eh")]), EDGE)
    term = term.withColumnRenamed("edge_id", "terminal_edge_id")
    # the ways on are folded per node first: many routes that end at a busy node meet one row
    way = F.struct("edge_id", "to_id", "reverse_of", "sx", "sy", "sz", "sh")
    nxt = edges.groupBy("run_id", F.col("from_id").alias("t_to")).agg(
        F.count("*").alias("n"), F.count_if(~F.col("passable")).alias("blocked"), F.min_by(way, F.when(F.col("passable"), F.col("edge_id"))).alias("s")
    )
    zero = F.lit(0).cast("long")
    per = term.join(nxt, ["run_id", "t_to"], "left").withColumns({"n": F.coalesce("n", zero), "blocked": F.coalesce("blocked", zero)})
    named = routes.join(edges.select(*EDGE, "from_id", "to_id", "reverse_of"), EDGE)
    taken = named.select("run_id", "route_id", F.explode(F.array_compact(F.array("edge_id", "reverse_of"))).alias("x")).distinct()
    reuse = per.select("run_id", "route_id", F.explode(F.array_compact(F.array("s.edge_id", "s.reverse_of"))).alias("x")).join(taken, ["run_id", "route_id", "x"], "left_semi").select("run_id", "route_id", F.lit(True).alias("reuse")).distinct()
    on_route = named.select("run_id", "route_id", F.explode(F.array("from_id", "to_id")).alias("x")).distinct()
    loop = per.select("run_id", "route_id", F.col("s.to_id").alias("x")).join(on_route, ["run_id", "route_id", "x"], "left_semi").select("run_id", "route_id", F.lit(True).alias("loop"))
    r = per.join(reuse, ["run_id", "route_id"], "left").join(loop, ["run_id", "route_id"], "left")
    c = F.col
    gap = V.dist3((c("t_ex"), c("t_ey"), c("t_ez")), (c("s.sx"), c("s.sy"), c("s.sz")))
    jump = F.degrees(F.abs(V.normalize_angle(c("s.sh") - c("t_eh"))))
    code = (
        F.when(c("blocked") > 0, "terminal_successor_no_entry_or_impassable").when(c("n") == 0, "terminal_successor_missing")
        .when(c("n") > 1, "terminal_successor_branch_ambiguous").when(c("reuse"), "terminal_successor_reuses_named_edge")
        .when(c("loop"), "terminal_successor_cycle").when(gap > SUCCESSOR_GAP_M, "terminal_successor_endpoint_mismatch")
        .when(jump > SUCCESSOR_MAX_JUMP_DEG + 1.0e-9, "terminal_successor_heading_discontinuity")
    )
    return r.select("run_id", "route_id", "terminal_edge_id", F.when(code.isNull(), c("s.edge_id")).alias("successor_edge_id"), code.alias("code"))


def trim_terminal_tail(edges: DataFrame, poses: DataFrame, verified: bool) -> DataFrame:
    """Decision per run whether the tail behind the first cusp of a chain may be left out.

    ``edges``: run_id, pos, edge_id, from_id, to_id, length (planar), start_heading,
    end_heading, ex, ey.  ``poses``: run_id, i, x, y, s (planar arc), yaw.  Everything must
    hold: explicit verification, a single open chain, a cusp >= 150 degrees, tail <= 1 m and
    <= 1 %, yaw change on the tail <= 15 degrees.
    """
    n = O.with_neighbours(edges, ["run_id"], "pos", ["to_id", "end_heading"], back=1, ahead=0)
    jump = F.degrees(F.abs(V.normalize_angle(F.col("start_heading") - F.col("end_heading_p1"))))
    joined = F.col("to_id_p1").isNull() | (F.col("to_id_p1") == F.col("from_id"))
    n = n.withColumns({"_jump": jump, "_joined": joined})
    cusp = F.when(F.col("_jump") + 1.0e-9 >= CUSP_MIN_JUMP_DEG, F.col("pos"))
    per = n.groupBy("run_id").agg(
        F.count("*").alias("source_edges"), F.sum("length").alias("source_length"), F.min(cusp).alias("cusp_pos"),
        F.bool_and("_joined").alias("chain"), F.min_by("_jump", cusp).alias("jump"),
    )
    starts = both_ends(edges).distinct().groupBy("run_id", "node_id").count()
    knot = starts.groupBy("run_id").agg(F.max("count").alias("_deg"), F.count_if(F.col("count") == 1).alias("_ends"))
    tail = n.join(per.select("run_id", "cusp_pos"), "run_id").groupBy("run_id").agg(
        F.sum(F.when(F.col("pos") >= F.col("cusp_pos"), F.col("length"))).alias("omitted_length"),
        F.sum(F.when(F.col("pos") < F.col("cusp_pos"), F.col("length"))).alias("_kept"),
        F.max_by(F.struct("ex", "ey"), F.when(F.col("pos") < F.col("cusp_pos"), F.col("pos"))).alias("_at"),
    )
    r = per.join(knot, "run_id").join(tail, "run_id")
    near = poses.join(r.select("run_id", "_at", "_kept"), "run_id")
    gap = V.dist2(F.col("x"), F.col("y"), F.col("_at.ex"), F.col("_at.ey"))
    near = near.withColumn("_gap", gap)
    score = F.col("_gap") + 1.0e-6 * F.abs(F.col("s") - F.col("_kept"))
    at = near.groupBy("run_id").agg(F.min_by(F.struct("i", "_gap"), F.struct(score, F.col("i"))).alias("p")).select("run_id", F.col("p.i").alias("from_i"), F.col("p._gap").alias("pose_gap"))
    m = O.with_neighbours(poses, ["run_id"], "i", ["yaw"], back=1, ahead=0)
    step = F.coalesce(V.normalize_angle(F.col("yaw") - F.col("yaw_p1")), F.col("yaw"))
    path = O.running(m, ["run_id"], "i", {"u": ("sum", step)}).join(at, "run_id").filter(F.col("i") >= F.col("from_i"))
    yaw = path.groupBy("run_id").agg(F.degrees(F.max("u") - F.min("u")).alias("yaw_change"))
    r = r.join(at, "run_id", "left").join(yaw, "run_id", "left")
    c = F.col
    ratio = F.try_divide(c("omitted_length"), c("source_length"))
    reason = (
        F.when(F.lit(not verified), "explicit_verification_not_provided")
        .when(~c("chain") | (c("_deg") > 2) | (c("_ends") != 2) | (c("source_edges") < 2), "route_is_not_a_single_open_chain")
        .when(c("cusp_pos").isNull(), "no_terminal_cusp")
        .when(~(c("omitted_length") > 1.0e-12), "terminal_tail_is_empty")
        .when(c("omitted_length") > TAIL_MAX_M + 1.0e-9, "terminal_tail_exceeds_1m")
        .when(ratio > TAIL_MAX_RATIO + 1.0e-12, "terminal_tail_exceeds_1_percent")
        .when(c("pose_gap") > 1.0e-3, "terminal_cusp_pose_not_found")
        .when(c("yaw_change") > TAIL_MAX_YAW_DEG + 1.0e-9, "terminal_tail_body_yaw_change_exceeds_15deg")
        .otherwise("verified_terminal_localization_settling_tail_omitted")
    )
    trim = reason == "verified_terminal_localization_settling_tail_omitted"
    return r.select("run_id", reason.alias("reason"), trim.alias("omitted"), "source_edges", F.when(trim, c("cusp_pos")).otherwise(c("source_edges")).alias("retained_edges"), "omitted_length", "yaw_change")


# --- status and candidates -----------------------------------------------------------------


def operational_graph(edges: DataFrame, nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Edges with status VALID or WARNING, their nodes, and no dangling reverse partner."""
    good = edges.filter(F.col("status").isin("VALID", "WARNING"))
    ids = good.select("run_id", F.col("edge_id").alias("reverse_of"), F.lit(True).alias("_there"))
    out = good.join(ids, ["run_id", "reverse_of"], "left").withColumn("reverse_of", F.when(F.col("_there"), F.col("reverse_of"))).drop("_there")
    used = both_ends(good).select("run_id", "node_id").distinct()
    return out.select(*edges.columns), nodes.join(used, ["run_id", "node_id"], "left_semi")


def candidate_graph(edges: DataFrame) -> DataFrame:
    """Edges that were really driven or independently validated (never reversed ones), with
    their diagnostics. Needs provenance, needs_orientation_check, reverse_direction,
    source_ids, status, errors."""
    seen = (F.col("provenance") != "manual") & ~F.col("needs_orientation_check") & ~F.col("reverse_direction") & (F.size("source_ids") > 0)
    valid = F.col("status").isin("VALID", "WARNING")
    keep = edges.filter((seen | valid) & ~F.col("reverse_direction"))
    add = F.when(seen & valid, F.array(F.lit("observed_driven_route"))).when(
        seen, F.array(F.lit("observed_driven_route"), F.lit("observed_passage_not_operational_safety_clearance"))
    ).otherwise(F.array(F.lit("closed_course_clearance_validated_manual_route")))
    return keep.withColumns({"errors": F.array_union("errors", add), "passable": F.lit(True)})


def node_status(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """VALID / WARNING / INVALID of each node from the edges that meet there."""
    s = F.col("status")
    inc = both_ends(edges, "edge_id", "status").groupBy("run_id", "node_id").agg(
        F.count_if(s.isin("VALID", "WARNING")).alias("ok"), F.count_if(s == "WARNING").alias("warn"), F.count_if(~s.isin("VALID", "WARNING")).alias("bad")
    )
    n = nodes.select("run_id", "node_id").join(inc, ["run_id", "node_id"], "left").na.fill(0, ["ok", "warn", "bad"])
    ok, warn, bad = F.col("ok"), F.col("warn"), F.col("bad")
    status = F.when(ok == 0, "INVALID").when((bad > 0) | (warn > 0), "WARNING").otherwise("VALID")
    codes = reason_codes(
        ((ok == 0) & (bad == 0), "isolated_node"), ((ok == 0) & (bad > 0), "no_valid_incident_edge"),
        ((ok > 0) & (bad > 0), "has_invalid_incident_edge"), ((ok > 0) & (warn > 0), "has_warning_incident_edge"),
    )
    return n.select("run_id", "node_id", status.alias("status"), codes.alias("errors"))


def run_statistics(edges: DataFrame) -> DataFrame:
    """Passable, blocked and physical edges (one per reverse pair) and the narrowest width; with
    ``errors`` also the physical edges of incomplete clearance, all and passable ones, and with
    ``corridor_valid`` those without a proper corridor."""
    physical = F.col("reverse_of").isNull() | (F.col("edge_id") < F.col("reverse_of"))
    more = []
    if "errors" in edges.columns:
        open_ = physical & F.array_contains("errors", "unknown_clearance")
        more += [F.count_if(open_).alias("unknown_clearance_edges"), F.count_if(open_ & F.col("passable")).alias("passable_unknown_clearance_edges")]
    if "corridor_valid" in edges.columns:
        more.append(F.count_if(physical & ~F.col("corridor_valid")).alias("invalid_corridor_edges"))
    return edges.groupBy("run_id").agg(
        F.count("*").alias("edges"), F.count_if("passable").alias("passable_edges"), F.count_if(~F.col("passable")).alias("blocked_edges"),
        F.count_if(physical).alias("physical_edges"), F.min(F.when(F.col("passable"), F.col("min_width"))).alias("min_width"), *more,
    )


def edge_issues(edges: DataFrame, min_confidence: float, lines: DataFrame | None = None) -> DataFrame:
    """Blocked or low-confidence edges for reviewers, with a reason and, given the ``lines``
    (run_id, edge_id, i, x, y, z), the point half way along. A passable edge is listed for its
    confidence; a blocked one for its first error. Of two mirrored partners (``reverse_of``)
    the one with the smaller id is listed."""
    bad = edges.filter(~F.col("passable") | (F.col("confidence") < min_confidence))
    if "reverse_of" in edges.columns:
        partner = edges.select("run_id", F.col("edge_id").alias("reverse_of")).withColumn("_twin", F.lit(True))
        bad = bad.join(partner, ["run_id", "reverse_of"], "left").filter(F.col("_twin").isNull() | (F.col("edge_id") < F.col("reverse_of"))).drop("_twin")
    reason = F.when(F.col("passable"), "low confidence").otherwise(F.coalesce(F.try_element_at("errors", F.lit(1)), F.lit("clearance failed")))
    out = bad.withColumn("reason", reason).select(*edges.columns, "reason")
    if lines is None:
        return out
    from drivegrid.operators import polylines as pl
    from drivegrid.operators.trajectory import arc_length

    arc = arc_length(lines, EDGE)
    half = arc.groupBy(*EDGE).agg((F.max("s") / 2.0).alias("t"))
    return out.join(pl.sample_at_arc(arc, half, EDGE).select(*EDGE, "x", "y", "z"), EDGE, "left")


# --- checks ---------------------------------------------------------------------------------


def check_graph(nodes: DataFrame, edges: DataFrame, ends: DataFrame | None = None, tol: float = 1.0e-6) -> DataFrame:
    """Structural violations ``run_id, entity, id, code``. ``ends``: first and last vertex of
    each edge (ax.., bx.., points)."""
    viol = lambda df, entity, id_, code: df.select("run_id", F.lit(entity).alias("entity"), F.col(id_).alias("id"), F.lit(code).alias("code"))
    ids = nodes.select("run_id", F.col("node_id").alias("id")).unionByName(edges.select("run_id", F.col("edge_id").alias("id")))
    dup = ids.groupBy("run_id", "id").count().filter("count > 1 OR id = 0")
    out = viol(dup, "id", "id", "zero_or_duplicate_id")
    out = out.unionByName(viol(nodes.filter(~finite(F.col("x"), F.col("y"), F.col("z"))), "node", "node_id", "nonfinite_position"))
    out = out.unionByName(viol(edges.filter("from_id = to_id"), "edge", "edge_id", "self_loop"))
    known = nodes.select("run_id", "node_id")
    tips = edges.select(*EDGE, F.explode(F.array("from_id", "to_id")).alias("node_id"))
    out = out.unionByName(viol(tips.join(known, ["run_id", "node_id"], "left_anti").select("run_id", "edge_id").distinct(), "edge", "edge_id", "missing_node"))
    partner = edges.select("run_id", F.col("edge_id").alias("reverse_of"), F.col("from_id").alias("pf"), F.col("to_id").alias("pt"), F.col("reverse_of").alias("pr"))
    rev = edges.filter(F.col("reverse_of").isNotNull()).join(partner, ["run_id", "reverse_of"], "left")
    ok = F.coalesce((F.col("pr") == F.col("edge_id")) & (F.col("pf") == F.col("to_id")) & (F.col("pt") == F.col("from_id")), F.lit(False))
    out = out.unionByName(viol(rev.filter(~ok), "edge", "edge_id", "reverse_not_reciprocal"))
    if ends is not None:
        at = lambda p: nodes.select("run_id", F.col("node_id").alias(f"{p}_id"), *[F.col(a).alias(f"{p}{a}") for a in "xyz"])
        g = edges.join(ends, EDGE, "left").join(at("from"), ["run_id", "from_id"], "left").join(at("to"), ["run_id", "to_id"], "left")
        p = lambda k: tuple(F.col(f"{k}{a}") for a in "xyz")
        far = (V.dist3(p("a"), p("from")) > tol) | (V.dist3(p("b"), p("to")) > tol)
        out = out.unionByName(viol(g.filter(F.coalesce(F.col("points"), F.lit(0)) < 2), "edge", "edge_id", "too_few_points"))
        out = out.unionByName(viol(g.filter(far), "edge", "edge_id", "endpoint_mismatch"))
    return out


def missing_references(rows: DataFrame, target: DataFrame, on: list[str], code: str) -> DataFrame:
    """Rows whose reference does not exist, tagged with ``code``."""
    return rows.join(target.select(*on).distinct(), on, "left_anti").withColumn("code", F.lit(code))


def same_edge_set(a: DataFrame, b: DataFrame, keys=("run_id",)) -> DataFrame:
    """Per key: do both tables hold exactly the same edge ids (counted once each)?"""
    keys = list(keys)
    tag = lambda df, n: df.select(*keys, "edge_id").distinct().withColumn("_s", F.lit(n))
    both = tag(a, 1).unionByName(tag(b, 2)).groupBy(*keys, "edge_id").agg(F.sum("_s").alias("_in"))
    return both.groupBy(*keys).agg((F.count_if(F.col("_in") != 3) == 0).alias("same"), F.count_if(F.col("_in") == 1).alias("only_left"), F.count_if(F.col("_in") == 2).alias("only_right"))


def compare_graphs(a: DataFrame, b: DataFrame) -> DataFrame:
    """Ordered identity of two edge lists (run_id, pos, edge_id, from_id, to_id, cost,
    geometry): one row per change with its code."""
    r = b.select("run_id", "pos", *[F.col(c).alias(f"b_{c}") for c in ("edge_id", "from_id", "to_id", "cost", "geometry")])
    j = a.join(r, ["run_id", "pos"], "full_outer")
    c = F.col
    codes = F.array_compact(F.array(
        F.when(c("edge_id").isNull(), F.lit("edge_added")), F.when(c("b_edge_id").isNull(), F.lit("edge_removed")),
        F.when(c("edge_id") != c("b_edge_id"), F.lit("edge_id_changed")), F.when((c("from_id") != c("b_from_id")) | (c("to_id") != c("b_to_id")), F.lit("endpoints_changed")),
        F.when(F.abs(c("cost") - c("b_cost")) > 1.0e-9, F.lit("cost_changed")), F.when(c("geometry") != c("b_geometry"), F.lit("geometry_changed")),
    ))
    return j.select("run_id", "pos", F.explode(codes).alias("code"))


def fingerprint(rows: DataFrame, columns: list[str], keys=("run_id",)) -> DataFrame:
    """Stable hash of a set of rows: SHA-256 per row, lanes summed exactly, then hashed with
    the count.  Sums commute, so no group is ever collected or sorted; put the position into
    ``columns`` to make order count. Round doubles to integers first."""
    text = F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("~")) for c in columns])
    h = F.sha2(text, 256)
    lane = lambda k: F.conv(F.substring(h, 1 + 15 * k, 15), 16, 10).cast("decimal(20,0)")
    g = rows.groupBy(*keys).agg(F.count("*").alias("_n"), *[F.sum(lane(k)).cast("decimal(38,0)").alias(f"_l{k}") for k in range(4)])
    whole = F.concat_ws("|", *[F.col(c).cast("string") for c in ("_n", "_l0", "_l1", "_l2", "_l3")])
    return g.select(*keys, F.col("_n").alias("rows"), F.sha2(whole, 256).alias("fingerprint"))


def exactly_one(candidates: DataFrame, keys, value: str) -> DataFrame:
    """The single candidate per key, or none and an error when there are several."""
    g = candidates.groupBy(*keys).agg(F.count("*").alias("candidates"), F.min(value).alias("_v"))
    return g.select(*keys, "candidates", F.when(F.col("candidates") == 1, F.col("_v")).alias("selected"), F.when(F.col("candidates") > 1, F.lit("multiple_candidates")).alias("error"))


def best_with_margin(scored: DataFrame, keys, score: str, value: str, margin: float) -> DataFrame:
    """Lowest score per key if the runner-up is at least ``margin`` worse; two rows per key
    are found by two aggregations, no group is sorted."""
    best = scored.groupBy(*keys).agg(F.min(F.struct(score, value)).alias("b"))
    rest = scored.join(best, list(keys)).filter(F.struct(score, value) != F.col("b"))
    second = rest.groupBy(*keys).agg(F.min(score).alias("second"))
    j = best.join(second, list(keys), "left")
    clear = F.col("second").isNull() | (F.col("second") - F.col(f"b.{score}") >= margin)
    return j.select(*keys, F.when(clear, F.col(f"b.{value}")).alias("selected"), F.col(f"b.{score}").alias("best"), "second")


# --- edit log ---------------------------------------------------------------------------------


def _edit_columns(ops: DataFrame) -> DataFrame:
    """``ops`` with the optional columns and the operation names in one spelling."""
    given = set(ops.columns)
    add = {c: F.lit(None).cast("long") for c in ("reverse_id", "child1_reverse_id", "child2_reverse_id") if c not in given}
    add |= {c: F.lit(v) for c, v in (("cascade", True), ("include_reverse", False)) if c not in given}
    if "direction" not in given:
        add["direction"] = F.lit("one_way")
    out = ops.withColumns(add) if add else ops
    kind = F.when(F.col("type") == "clear", "clear_graph").when(F.col("type") == "set_one_way", "set_direction").otherwise(F.col("type"))
    way = F.when(F.col("type") == "set_one_way", "one_way").otherwise(F.coalesce("direction", F.lit("one_way")))
    return out.withColumns({"direction": way, "type": kind})


def _edit_lives(nodes: DataFrame, edges: DataFrame, ops: DataFrame):
    """Lives of nodes and edges in an edit log: (nodes, edges, operations).

    One id may live several times; a life begins with the operation that creates it (-1: the
    graph given) and ends with the first one after that which removes it. Partners are pairs
    made by one operation; what removes the partner of an edge removes the life that was
    paired. An edge made by a split or as a reverse takes its ends from the life it comes from.
    """
    c = F.col
    o = cut_lineage(_edit_columns(ops))
    base = F.lit(-1).cast("long")
    of = lambda kind: o.filter(c("type") == kind)
    node_born = nodes.select("run_id", "node_id", base.alias("birth"), "x", "y", "z").unionByName(
        of("add_node").select("run_id", "node_id", c("op").alias("birth"), "x", "y", "z")
    ).unionByName(of("split_edge").select("run_id", c("new_node_id").alias("node_id"), c("op").alias("birth"), "x", "y", "z"))
    both = of("add_edge").filter("direction = 'both'")
    null = F.lit(None).cast("long")
    known = edges.select("run_id", "edge_id", base.alias("birth"), "from_id", "to_id").unionByName(
        of("add_edge").select("run_id", "edge_id", c("op").alias("birth"), "from_id", "to_id")
    ).unionByName(both.select("run_id", c("reverse_id").alias("edge_id"), c("op").alias("birth"), c("to_id").alias("from_id"), c("from_id").alias("to_id")))
    # made from another edge: which end is replaced by the new node, and whether it runs back
    child = lambda id_, keep, back: F.struct(c(id_).alias("edge_id"), F.lit(keep).alias("keep"), F.lit(back).alias("back"))
    four = F.array(child("child1_id", "from", False), child("child2_id", "to", False), child("child1_reverse_id", "from", True), child("child2_reverse_id", "to", True))
    made = of("split_edge").select("run_id", "op", c("edge_id").alias("parent"), "new_node_id", F.explode(four).alias("k")).unionByName(
        of("set_direction").filter("direction = 'both'").select("run_id", "op", c("edge_id").alias("parent"), null.alias("new_node_id"), child("reverse_id", "all", True).alias("k")))
    made = cut_lineage(made.select("run_id", "op", "parent", "new_node_id", "k.*").filter("edge_id IS NOT NULL AND edge_id <> 0"))
    births = known.select("run_id", "edge_id", "birth").unionByName(made.select("run_id", "edge_id", c("op").alias("birth")))
    # the life of the parent that an operation meets is its latest one before
    lives = births.select("run_id", c("edge_id").alias("parent"), c("birth").alias("parent_birth"))
    made = made.join(lives, ["run_id", "parent"]).filter("parent_birth < op")
    made = cut_lineage(made.groupBy("run_id", "op", "parent", "new_node_id", "edge_id", "keep", "back").agg(F.max("parent_birth").alias("parent_birth")))
    level = known.withColumns({"parent": null, "parent_birth": null, "keep": F.lit("base")})
    all_e = level
    while True:  # one level per depth of splits
        up = level.select("run_id", c("edge_id").alias("parent"), c("birth").alias("parent_birth"), "from_id", "to_id")
        k = made.join(up, ["run_id", "parent", "parent_birth"])
        a = F.when(c("keep") == "to", c("new_node_id")).otherwise(c("from_id"))
        b = F.when(c("keep") == "from", c("new_node_id")).otherwise(c("to_id"))
        level = cut_lineage(k.select("run_id", "edge_id", c("op").alias("birth"), F.when(c("back"), b).otherwise(a).alias("from_id"), F.when(c("back"), a).otherwise(b).alias("to_id"), "parent", "parent_birth", "keep"))
        if level.isEmpty():
            break
        all_e = all_e.unionByName(level)
    # partners
    pair = lambda df, x, y, at: df.select("run_id", c(x).alias("a"), c(y).alias("b"), at.alias("since"))
    pairs = pair(both, "edge_id", "reverse_id", c("op")).unionByName(pair(of("split_edge"), "child1_id", "child1_reverse_id", c("op"))).unionByName(
        pair(of("split_edge"), "child2_id", "child2_reverse_id", c("op"))).unionByName(pair(of("set_direction").filter("direction = 'both'"), "edge_id", "reverse_id", c("op")))
    if "reverse_of" in edges.columns:
        pairs = pairs.unionByName(pair(edges, "edge_id", "reverse_of", base))
    pairs = pairs.filter("b IS NOT NULL AND b <> 0")
    pairs = pairs.unionByName(pairs.select("run_id", c("b").alias("a"), c("a").alias("b"), "since")).distinct()
    takes = o.filter("type = 'split_edge' OR (type = 'delete_edge' AND include_reverse) OR (type = 'set_direction' AND direction = 'one_way')")
    takes = takes.select("run_id", "op", c("edge_id").alias("a"))
    current = takes.join(births.withColumnRenamed("edge_id", "a"), ["run_id", "a"]).filter("birth < op").groupBy("run_id", "op", "a").agg(F.max("birth").alias("birth"))
    partner = current.join(pairs, ["run_id", "a"]).filter("since >= birth AND since < op").groupBy("run_id", "op", "a").agg(F.max_by("b", "since").alias("edge_id"), F.max("since").alias("since"))
    # ends of lives
    end = lambda df, id_: df.select("run_id", c(id_).alias("edge_id"), c("op").alias("death"), F.lit(None).cast("long").alias("since"))
    kills = end(o.filter("type IN ('delete_edge', 'split_edge')"), "edge_id").unionByName(partner.select("run_id", "edge_id", c("op").alias("death"), "since"))
    gone = of("delete_node").select("run_id", "node_id", c("op").alias("death"))
    cascades = both_ends(all_e, "edge_id", "birth").join(of("delete_node").filter("cascade").select("run_id", "node_id", c("op").alias("death")), ["run_id", "node_id"])
    clears = of("clear_graph").select("run_id", c("op").alias("death"))
    e = births.join(kills, ["run_id", "edge_id"]).filter("death > birth AND (since IS NULL OR birth <= since)").select("run_id", "edge_id", "birth", "death")
    e = e.unionByName(cascades.filter("death > birth").select("run_id", "edge_id", "birth", "death")).unionByName(
        births.join(clears, "run_id").filter("death > birth").select("run_id", "edge_id", "birth", "death"))
    edge_end = e.groupBy("run_id", "edge_id", "birth").agg(F.min("death").alias("death"))
    lived_e = cut_lineage(all_e.join(edge_end, ["run_id", "edge_id", "birth"], "left"))
    n = node_born.join(gone, ["run_id", "node_id"]).filter("death > birth").select("run_id", "node_id", "birth", "death").unionByName(
        node_born.join(clears, "run_id").filter("death > birth").select("run_id", "node_id", "birth", "death"))
    node_end = n.groupBy("run_id", "node_id", "birth").agg(F.min("death").alias("death"))
    lived_n = cut_lineage(node_born.join(node_end, ["run_id", "node_id", "birth"], "left"))
    # a child is real only if its parent was, and was alive when it was made
    real = level = lived_e.filter("parent IS NULL")
    waiting = lived_e.filter("parent IS NOT NULL")
    while True:
        up = level.select("run_id", c("edge_id").alias("parent"), c("birth").alias("parent_birth"), F.coalesce("death", F.lit(2**63 - 1)).alias("_until"))
        level = waiting.join(up, ["run_id", "parent", "parent_birth"]).filter("_until >= birth").select(*lived_e.columns)
        level = cut_lineage(level)
        if level.isEmpty():
            break
        real = real.unionByName(level)
    real = cut_lineage(real)
    # a split that made no edge makes no node either
    void = of("split_edge").select("run_id", c("op").alias("birth")).join(real.filter("parent IS NOT NULL").select("run_id", "birth").distinct(), ["run_id", "birth"], "left_anti")
    return lived_n.join(void, ["run_id", "birth"], "left_anti"), real, o


def replay_edits(nodes: DataFrame, edges: DataFrame, ops: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Graph after an ordered edit log, without replaying it row by row.

    ``ops``: run_id, op, type, node_id, edge_id, from_id, to_id, child1_id, child2_id,
    new_node_id, x, y, z and optionally direction ('one_way' or 'both'), reverse_id,
    child1_reverse_id, child2_reverse_id, cascade (true), include_reverse (false). Types:
    clear_graph, add_node, move_node, delete_node, add_edge, delete_edge, split_edge,
    set_direction. Every op names the ids it creates. A node's place is the latest move in its
    own life. ``set_direction`` one_way keeps the edge and removes its reverse.
    """
    c = F.col
    n, e, o = _edit_lives(nodes, edges, ops)
    n = n.filter("death IS NULL")
    moves = o.filter("type = 'move_node'").select("run_id", "node_id", "op", F.struct("x", "y", "z").alias("m"))
    last = n.select("run_id", "node_id", "birth").join(moves, ["run_id", "node_id"]).filter("op > birth").groupBy("run_id", "node_id").agg(F.max_by("m", "op").alias("m"))
    out_n = n.join(last, ["run_id", "node_id"], "left")
    out_n = out_n.select("run_id", "node_id", *[F.coalesce(c(f"m.{a}"), c(a)).alias(a) for a in "xyz"], (c("birth") >= 0).alias("manual"))
    return out_n, e.filter("death IS NULL").select("run_id", "edge_id", "from_id", "to_id", (c("birth") >= 0).alias("manual"))


def invalid_edits(nodes: DataFrame, edges: DataFrame, ops: DataFrame) -> DataFrame:
    """Operations that name an entity that is not alive at that point (``missing_entity``),
    create an id that is (``duplicate_id``), or remove a node whose edges they may not take
    along (``incident_edges``): ``run_id, op, code``."""
    c = F.col
    ends = nodes if "x" in nodes.columns else nodes.withColumns({a: F.lit(0.0) for a in "xyz"})
    n, e, o = _edit_lives(ends, edges, ops)
    life = lambda df, id_, kind: df.select("run_id", c(id_).alias("id"), F.lit(kind).alias("kind"), "birth", F.coalesce("death", F.lit(2**63 - 1)).alias("death"))
    lives = life(n, "node_id", "n").unionByName(life(e, "edge_id", "e"))
    t = c("type")
    entry = lambda cond, col, kind: F.when(cond & c(col).isNotNull(), F.struct(c(col).alias("id"), F.lit(kind).alias("kind")))
    uses = F.array_compact(F.array(
        entry(t.isin("move_node", "delete_node"), "node_id", "n"), entry(t.isin("delete_edge", "split_edge", "set_direction"), "edge_id", "e"),
        entry(t == "add_edge", "from_id", "n"), entry(t == "add_edge", "to_id", "n")))
    used = o.select("run_id", "op", F.explode(uses).alias("u")).select("run_id", "op", "u.*")
    there = used.join(lives, ["run_id", "id", "kind"]).filter("birth < op AND death >= op").select("run_id", "op", "id", "kind").distinct()
    missing = used.join(there, ["run_id", "op", "id", "kind"], "left_anti").select("run_id", "op", F.lit("missing_entity").alias("code"))
    both = t.isin("add_edge", "set_direction") & (c("direction") == "both")
    creates = F.array_compact(F.array(
        F.when(t == "add_node", c("node_id")), F.when(t == "add_edge", c("edge_id")), F.when(both, c("reverse_id")),
        *[F.when(t == "split_edge", c(k)) for k in ("child1_id", "child2_id", "child1_reverse_id", "child2_reverse_id", "new_node_id")]))
    made = o.select("run_id", "op", F.explode(creates).alias("id")).filter("id <> 0")
    twice = made.join(lives, ["run_id", "id"]).filter("birth < op AND death >= op").select("run_id", "op")
    again = made.groupBy("run_id", "op", "id").count().filter("count > 1").select("run_id", "op")
    dup = twice.unionByName(again).withColumn("code", F.lit("duplicate_id"))
    bare = o.filter("type = 'delete_node' AND NOT cascade").select("run_id", "op", "node_id")
    held = both_ends(e.withColumn("death", F.coalesce("death", F.lit(2**63 - 1))), "birth", "death").join(bare, ["run_id", "node_id"]).filter("birth < op AND death >= op")
    held = held.select("run_id", "op", F.lit("incident_edges").alias("code"))
    return missing.unionByName(dup).unionByName(held).distinct()
