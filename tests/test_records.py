"""Record files: full records read back by value, and every fault by its line."""

from drivegrid.sources import records as rc

NODES = "run_id long, node_id long, node_type string, x double, y double, z double"
EDGES = ("run_id long, edge_id long, from_id long, to_id long, reverse_of long, passable boolean, length double, min_width double, max_curvature double, "
         "confidence double, speed double, corridor_valid boolean, errors array<string>")
SAMPLES = ("run_id long, edge_id long, i long, x double, y double, z double, left_x double, left_y double, left_z double, right_x double, right_y double, "
           "right_z double, left_clearance double, right_clearance double, left_observed boolean, right_observed boolean")


def plain(df, *drop):
    return sorted((tuple(map(repr, r)) for r in df.drop(*drop).collect()))


def graph(spark):
    nodes = spark.createDataFrame([(1, 1, "endpoint", 0.1, -2.5e-7, 1e22), (1, 2, "junction", 1 / 3, 5.0, 0.0), (2, 9, "normal", 0.0, 0.0, 0.0)], NODES)
    edges = spark.createDataFrame([(1, 5, 1, 2, 6, True, 5.25, 0.8, 0.1, 0.5, 1.0, True, []), (1, 6, 2, 1, 5, False, 5.25, 0.1, 0.1, 0.5, 1.0, False, ["a", "b_c"]), (2, 5, 9, 9, None, True, 0.0, 0.0, 0.0, 0.0, 0.1, True, [])], EDGES)
    samples = spark.createDataFrame([(1, e, i, i * 0.1, e / 7, 0.0, 1.0, 2.0, 3.0, 4.0, 5.0, 6.0, 0.7, 0.8, i == 1, True) for e in (5, 6) for i in range(12)], SAMPLES)
    return nodes, edges, samples


def test_graph_records_come_back(spark):
    nodes, edges, samples = graph(spark)
    lines = rc.format_graph(nodes, edges, samples)
    text = [r.value for r in lines.filter("run_id = 1").orderBy("line").collect()]
    assert text[:2] == ["VERSION\t2", "FRAME\tmap"] and [t.split("\t")[0] for t in text] == ["VERSION", "FRAME", "NODE", "NODE", "EDGE", "EDGE"] + ["SAMPLE"] * 24
    assert {k: {len(t.split("\t")) for t in text if t.startswith(k)} for k in ("NODE", "EDGE", "SAMPLE")} == {"NODE": {6}, "EDGE": {14}, "SAMPLE": {16}}
    assert [t.split("\t")[2] for t in text if t.startswith("SAMPLE\t5")] == [str(k) for k in range(12)]
    got = rc.parse_graph(lines)
    assert got.violations.collect() == [] and {r.frame for r in got.frames.collect()} == {"map"}
    assert plain(got.nodes) == plain(nodes) and plain(got.samples) == plain(samples)
    assert plain(got.edges, "samples") == plain(edges)
    old = rc.parse_graph(rc.format_graph(nodes, edges, samples, version=1))
    assert old.violations.collect() == []
    assert {(r.run_id, r.edge_id, r.corridor_valid, tuple(r.errors)) for r in old.edges.collect()} == {(1, 5, True, ()), (1, 6, False, ()), (2, 5, True, ())}
    assert old.samples.filter("left_observed OR right_observed").count() == 0 and old.samples.count() == 24


def test_graph_faults_are_found_by_line(spark):
    text = [
        "# comment", "VERSION\t2", "FRAME\tmap", "NODE\t1\tnormal\t0\t0\tx", "NODE\t1\tnormal\t0\t0", "SAMPLE\t7\t0" + "\t0" * 13,
        "EDGE\t7\t1\t2\t-\t1\t1\t1\t1\t1\t1\t2\t1\t", "EDGE\t7\t1\t2\t-\t1\t1\t1\t1\t1\t1\t2\t1\t", "SAMPLE\t7\t2" + "\t0" * 13 + "\r", "WHAT\t1", "",
        "EDGE\t8\t1\t2\tq\t1\t1\t1\t1\t1\t1\t0\t1\t",
    ]
    rows = [(1, k + 1, t) for k, t in enumerate(text)] + [(2, 1, "FRAME\tmap"), (3, 1, "VERSION\t3"), (4, 1, "VERSION\t1")]
    got = rc.parse_graph(spark.createDataFrame(rows, "run_id long, line long, value string"))
    found = {(r.run_id, r.code, r.line) for r in got.violations.collect()}
    assert found == {
        (1, "malformed_record", 4), (1, "malformed_record", 5), (1, "malformed_record", 12), (1, "sample_before_edge", 6), (1, "duplicate_edge", 7), (1, "sample_index_not_contiguous", 9),
        (1, "unknown_record", 10), (2, "version_missing", None), (3, "version_missing", None), (3, "version_unsupported", 1),
    }


FEATURES = "run_id long, feature_id long, type string, geometry string, enabled boolean, x double, y double, z double, yaw double, value double, extent double, name string, notes string, edge_ids array<long>"
SPANS = "run_id long, feature_id long, i long, edge_id long, start_s double, end_s double, ax double, ay double, az double, bx double, by double, bz double"


def test_rule_records_come_back_with_faults_by_line(spark):
    features = spark.createDataFrame([(1, 3, "speed_limit", "route", True, 1.0, 2.0, 3.0, 0.5, 0.3, 2.0, "tab\tand\\slash", "two\nlines", [5, 6]), (1, 4, "no_entry", "polygon", False, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, "", "", [])], FEATURES)
    vertices = spark.createDataFrame([(1, 4, k, k * 0.1, 1.0, 0.0) for k in range(11)], "run_id long, feature_id long, i long, x double, y double, z double")
    spans = spark.createDataFrame([(1, 3, 0, 5, 0.25, 1.5, 1.0, 2.0, 3.0, 4.0, 5.0, 6.0), (1, 3, 1, 6, 0.0, 1.0, None, None, None, None, None, None)], SPANS)
    lines = rc.format_rules(features, vertices, spans)
    sizes = sorted(len(r.value.split("\t")) for r in lines.filter("value LIKE 'SPAN%'").collect())
    assert sizes == [6, 12] and lines.filter("value LIKE 'FEATURE%'").first().value.count("\t") == 13
    got = rc.parse_rules(lines)
    assert got.violations.collect() == []
    assert plain(got.features) == plain(features) and plain(got.vertices) == plain(vertices) and plain(got.spans) == plain(spans)
    text = [
        "OLD_SEMANTICS\t1", "FEATURE\t1\tstop\tpoint\t1" + "\t0" * 6 + "\tn\t\t", "FEATURE\t1\tstop\tpoint\t1" + "\t0" * 6 + "\tn\t\t1,x", "FEATURE\t1\tstop\tpoint\t1" + "\t0" * 6 + "\tn\t\t",
        "VERTEX\t1\t1\t0\t0\t0", "VERTEX\t9\t0\t0\t0\t0", "SPAN\t1\t0\t5\t0\t1", "SPAN\t1\t0\t5\t0\t1\t0", "VERTEX\t1\t1\t0\t0\t0",
    ]
    bad = rc.parse_rules(spark.createDataFrame([(1, k + 1, t) for k, t in enumerate(text)], "run_id long, line long, value string"))
    assert {(r.code, r.line) for r in bad.violations.collect()} == {
        ("malformed_record", 3), ("duplicate_feature", 4), ("duplicate_vertex", 5), ("vertex_of_unknown_feature", 6), ("span_needs_version_2", 7), ("malformed_record", 8), ("span_needs_version_2", 8),
    }


def test_edit_records_come_back(spark):
    schema = "run_id long, " + ", ".join(f"{n} {rc._TYPES[k]}" for n, k in rc.OP) + ", new_node_id long"
    line = [(0.1, 0.2, 0.0), (1e-9, 2.0, 1 / 3)]
    rows = [
        (1, 10, "add_edge", None, 7, 8, 1, 2, None, None, None, None, 0.0, 0.0, 0.0, 0.0, "both", False, True, line, None),
        (1, 11, "split_edge", None, 7, None, None, None, 20, 21, 22, 23, 0.5, 0.25, 0.0, 1.75, "one_way", True, False, [], 24),
        (1, 9, "move_node", 5, None, None, None, None, None, None, None, None, 1.0, 2.0, 3.0, 0.0, "one_way", False, True, [], None),
    ]
    ops = spark.createDataFrame(rows, schema)
    lines = rc.format_edits(ops, base="abc")
    text = [r.value for r in lines.orderBy("line").collect()]
    assert text[:5] == ["VERSION\t1", "FRAME\tmap", "BASE\tabc", "NEXT_OPERATION_ID\t12", "NEXT_ENTITY_ID\t25"]
    assert [len(t.split("\t")) for t in text[5:]] == [20, 20, 20] and [t.split("\t")[1] for t in text[5:]] == ["9", "10", "11"]
    back, heads, violations = rc.parse_edits(lines)
    assert violations.collect() == [] and plain(back.select(*ops.columns)) == plain(ops)
    h = heads.first()
    assert (h.frame, h.base, h.next_op, h.next_id) == ("map", "abc", 12, 25)
    broken = spark.createDataFrame([(1, 1, "VERSION\t1"), (1, 2, text[5]), (1, 3, text[5]), (1, 4, text[6].replace("add_edge", "add_lane")), (1, 5, text[7].replace("one_way", "sideways")), (1, 6, "OP\t1")], "run_id long, line long, value string")
    assert {(r.code, r.line) for r in rc.parse_edits(broken)[2].collect()} == {("duplicate_operation", 3), ("malformed_record", 4), ("malformed_record", 5), ("malformed_record", 6)}


def test_empty_tables(spark):
    none = spark.createDataFrame([], "run_id long, line long, value string")
    assert rc.parse_graph(none).violations.count() == 0 and rc.parse_rules(none).features.count() == 0 and rc.parse_edits(none)[0].count() == 0
