"""Physical-plan properties: no Python in the hot path, one aggregation for cohort +
Overall, pruned scans, bounded broadcasts."""

import re

from cohortlens.plans.analyses import ANALYSES
from cohortlens.plans.registry import queries
from tests.conftest import SMALL


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_no_python_udf_in_any_registered_query(spark):
    for name, q in queries().items():
        if name in {"scan_union_shards", "json_ingest", "materialize_roundtrip", "stream_ingest", "write_dispositions",
                    "json_bad_records", "csv_bad_records"}:
            continue
        plan = _plan(q(spark, SMALL))
        assert "BatchEvalPython" not in plan and "ArrowEvalPython" not in plan, name


def test_cohort_and_overall_in_one_aggregation(small_community):
    plan = _plan(ANALYSES["q05_posts_per_user_cohort_time"](small_community, order=False))
    assert "Expand" in plan  # GROUPING SETS: each cell feeds both groupings in one pass
    assert "Union" not in plan.split("Expand")[0]


def test_cells_need_no_count_distinct(small_community):
    plan = _plan(ANALYSES["q06_posts_per_user_cohort_utime"](small_community))
    assert "count(distinct" not in plan.lower()
    direct = _plan(ANALYSES["q06_posts_per_user_cohort_utime"](small_community, method="direct"))
    assert "count(distinct" in direct.lower() or "Expand" in direct or direct.count("HashAggregate") > 4


def test_fixture_scans_are_pruned(spark):
    from cohortlens.plans.community import Community

    posts = Community.from_fixture(spark, SMALL).posts  # lazy: the plan reaches the raw scans
    plan = posts._jdf.queryExecution().executedPlan().toString()
    schemas = re.findall(r"ReadSchema: (struct<[^>]*>)", posts._jdf.queryExecution().toString())
    joined = " ".join(schemas)
    assert "lineitem" in plan and "orders" in plan
    assert "struct<l_orderkey:bigint,l_partkey:bigint,l_suppkey:bigint,l_linenumber:int,l_quantity:double>" in joined
    # l_extendedprice, l_discount, l_shipdate, o_totalprice, ... never leave the files
    for col in ("l_extendedprice", "l_discount", "l_shipdate", "o_totalprice", "p_brand"):
        assert col not in joined and col not in plan


def test_analyses_read_only_saved_tables(spark):
    from cohortlens.plans.registry import community_for

    c = community_for(spark, SMALL)
    for name, fn in ANALYSES.items():
        plan = fn(c)._jdf.queryExecution().executedPlan().toString()
        locations = re.findall(r"InMemoryFileIndex\(\d+ paths?\)\[([^\]]*)\]", plan)
        assert locations, name
        assert all("/root/testdata" not in loc for loc in locations), name
