"""Tables that are generated from small ones are never broadcast, whatever the planner takes their size for."""

import os

import pytest

from tilewright.plans.queries import QUERIES

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
NAMES = [
    "dataset_pair", "tile_pixels", "tiling_counts", "tiling_job", "tiling_pipeline", "tissue_segmentation", "tissue_filter", "overlap_center_tissue", "overlap_full_blur",
    "overlap_full_folding", "overlap_full_residual", "overlap_full_epithelium", "tile_samples", "tiles_by_slide", "bucketed_pair", "embed_pending",
]


@pytest.mark.parametrize("name", NAMES)
def test_no_broadcast(spark, name):
    assert spark.conf.get("spark.sql.autoBroadcastJoinThreshold").startswith("10")
    plan = QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "Join" in plan and "Broadcast" not in plan
