from stocktake.fixed_values import ENDPOINTS
from stocktake.sources.registry import resolved_registry


def rows(df):
    return {r["key"]: r.asDict() for r in df.collect()}


def test_paging_resolution(spark):
    r = rows(resolved_registry(spark))
    assert len(r) == len(ENDPOINTS) == 27
    assert r["workspace_file"]["paginate"] is True          # override turns paging on
    assert r["instance_pool"]["paginate"] is False and r["instance_pool"]["page_cap"] == 1
    assert r["job"]["page_cap"] == 0


def test_master_switch_and_global_cap(spark):
    off = rows(resolved_registry(spark, master=False))
    assert not any(v["paginate"] for v in off.values())
    capped = rows(resolved_registry(spark, global_max_pages=5, max_pages={"job": 2}))
    assert capped["job"]["page_cap"] == 5 and capped["instance_pool"]["page_cap"] == 1


def test_disabled_endpoints_and_prefix(spark):
    r = rows(resolved_registry(spark, enabled={"job": False}, prefix="p_"))
    assert "p_job" not in r and "p_cluster" in r
    assert r["p_vector_search_index"]["parent_key"] == "p_vector_search_endpoint"
    assert r["p_cluster"]["keep_fields"][0] == "cluster_id"
