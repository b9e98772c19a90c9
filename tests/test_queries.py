"""A cross-section of the registered queries against their SQL checks (small data).

All of them: ``python tests/compare.py --sf 0.01``.
"""

import pytest
from compare import difference, duck

SF = "/root/testdata/sf0.001"
PICK = [
    "flagship_drive_summary", "w2_dedupe_poses", "w3_longest_segment", "j1_pose_at", "a1_voxelize", "a3_ground_height",
    "w8_densify", "i1_merge_spans", "i2_segment_rules", "a13_node_degree", "v4_check_routes", "f20_graph_fingerprint", "s1_read_tum_rejects",
]


@pytest.mark.parametrize("name", PICK)
def test_query_matches_sql(spark, name):
    from drivegrid.plans import catalog

    got = catalog.QUERIES[name](spark, SF).toArrow()
    want = duck(SF).sql(catalog.CHECKS[name]).to_arrow_table()
    assert difference(got, want) is None


def test_registry_is_consistent():
    from drivegrid.plans import catalog

    assert set(catalog.CHECKS) <= set(catalog.QUERIES)
    assert len(catalog.QUERIES) > 150
