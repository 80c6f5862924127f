"""Facts of aligned segments are written as Parquet, so that branches read the columns they need."""

from parley.plans import catalog

catalog.load()


def test_facts_are_not_kept_as_rows(spark):
    plan = catalog.QUERIES["alignment_merge"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "LogicalRDD" not in plan
