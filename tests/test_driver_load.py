"""What the driver holds doesn't follow the tables: no plan that a job runs has a broadcast, and scores are computed once."""

import os

import pytest

from tilewright.plans.queries import QUERIES

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def test_no_broadcast_in_any_plan_of_the_job(spark):
    """`tiling_job` writes its pair before it returns a plan, so the plans that were run are looked at, as they were run."""
    store, before = spark._jsparkSession.sharedState().statusStore(), spark._jsparkSession.sharedState().statusStore().executionsCount()
    QUERIES["tiling_job"](spark, SF)
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    ran = store.executionsList()
    plans = [ran.apply(i).physicalPlanDescription() for i in range(before, ran.size())]
    assert any("SortMergeJoin" in p and "ShuffledHashJoin" in p for p in plans)
    assert not any("Broadcast" in p for p in plans)


@pytest.mark.parametrize("name,overlaps", [("overlap_full_blur", 1), ("overlap_full_epithelium", 1), ("overlap_full_folding", 1), ("overlap_full_residual", 1), ("tiling_job", 5)])
def test_fraction_is_counted_once(spark, name, overlaps):
    """A sum of columns is counted for the carries, and ahead of each side of a tile: three times in a plan, not five."""
    query = QUERIES["tiling_pipeline" if name == "tiling_job" else name]
    assert query(spark, SF)._jdf.queryExecution().optimizedPlan().toString().count("bit_count") == 3 * overlaps
