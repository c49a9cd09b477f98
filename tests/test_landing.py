from pyspark.sql import functions as F

from conftest import pages
from stocktake.sources.landing import apply_page_rules, cap_pages, landed_records, page_flags, unnest
from stocktake.sources.registry import resolved_registry


def body(items, token=None, **extra):
    import json
    d = {"jobs": items}
    if token:
        d["next_page_token"] = token
    d.update(extra)
    return json.dumps(d)


def kept_pages(df):
    return sorted(r["page_no"] for r in df.select("page_no").distinct().collect())


def test_prefix_and_complete_rules(spark):
    p = pages(spark, [("job", None, 1, 200, body([1], "t2")), ("job", None, 2, 200, body([2], "t3")),
                      ("job", None, 3, 500, "{}"), ("job", None, 4, 200, body([4]))])
    flags = page_flags(p)
    assert kept_pages(apply_page_rules(flags, "prefix")) == [1, 2]
    assert kept_pages(apply_page_rules(flags, "complete")) == []


def test_terminal_page_ends_listing(spark):
    p = pages(spark, [("job", None, 1, 200, body([1], "t2")), ("job", None, 2, 200, body([2])),
                      ("job", None, 3, 200, body([3]))])
    assert kept_pages(apply_page_rules(page_flags(p), "prefix")) == [1, 2]
    more = pages(spark, [("job", None, 1, 200, body([1], has_more=True)), ("job", None, 2, 200, body([2]))])
    assert kept_pages(apply_page_rules(page_flags(more), "prefix")) == [1, 2]
    assert kept_pages(apply_page_rules(page_flags(more, token_only=True), "prefix")) == [1]


def test_html_body_is_quarantined(spark):
    p = pages(spark, [("job", None, 1, 200, body([1], "t")), ("job", None, 2, 200, "<html>oops</html>")])
    assert kept_pages(apply_page_rules(page_flags(p), "prefix")) == [1]


def test_caps(spark):
    p = pages(spark, [("job", None, n, 200, body([n], "t" if n < 8 else None)) for n in range(1, 9)])
    assert kept_pages(cap_pages(p, 0)) == list(range(1, 9))
    assert kept_pages(cap_pages(p, 1)) == [1]
    reg = resolved_registry(spark, global_max_pages=5)
    recs = landed_records(p, reg)
    assert sorted(r["page_no"] for r in recs.collect()) == [1, 2, 3, 4, 5]


def test_unpaged_endpoint_reads_first_page_only(spark):
    p = pages(spark, [("instance_pool", None, 1, 200, '{"instance_pools":[1,2],"next_page_token":"x"}'),
                      ("instance_pool", None, 2, 200, '{"instance_pools":[3]}')])
    recs = landed_records(p, resolved_registry(spark))
    assert sorted(r["page_no"] for r in recs.collect()) == [1, 1]


def test_unnest_modes(spark):
    p = pages(spark, [("workspace_conf", None, 1, 200, '{"a":1,"b":"x"}'),
                      ("pipeline", None, 1, 200, '{"count":2,"items":[{"i":1},{"i":2}],"zz":[9]}'),
                      ("secret_scope", None, 1, 200, '[{"s":1}]'),
                      ("group", None, 1, 200, '{"group_names":["g1","g2"]}')])
    recs = landed_records(p, resolved_registry(spark), wrap={"group": "group_name"})
    got = {}
    for r in recs.collect():
        got.setdefault(r["endpoint"], []).append(r["rec"].toJson())
    assert got["workspace_conf"] == ['{"a":1,"b":"x"}']
    assert sorted(got["pipeline"]) == ['{"i":1}', '{"i":2}']
    assert got["secret_scope"] == ['{"s":1}']
    assert sorted(got["group"]) == ['{"group_name":"g1"}', '{"group_name":"g2"}']


def test_paged_endpoint_ignores_bare_arrays(spark):
    p = pages(spark, [("job", None, 1, 200, "[1,2,3]")])
    assert landed_records(p, resolved_registry(spark)).count() == 0


def test_unnest_keeps_page_order(spark):
    p = pages(spark, [("job", None, 1, 200, body(["a", "b"]))])
    recs = unnest(page_flags(p), "jobs").orderBy("pos")
    assert [(r["pos"], r["rec"].toJson()) for r in recs.collect()] == [(0, '"a"'), (1, '"b"')]


def test_stray_token_is_followed_only_where_declared(spark):
    # files are paged by override but declare no token; jobs declare one
    p = pages(spark, [("workspace_file", None, 1, 200, '{"objects":[1],"next_page_token":"x"}'),
                      ("workspace_file", None, 2, 200, '{"objects":[2]}'),
                      ("dbfs_file", None, 1, 200, '{"files":[1],"has_more":true}'), ("dbfs_file", None, 2, 200, '{"files":[2]}'),
                      ("job", None, 1, 200, body([1], "x")), ("job", None, 2, 200, body([2]))])
    got = {(r["endpoint"], r["page_no"]) for r in landed_records(p, resolved_registry(spark)).collect()}
    assert got == {("workspace_file", 1), ("dbfs_file", 1), ("dbfs_file", 2), ("job", 1), ("job", 2)}


def test_small_sides_are_measured_in_bytes(spark):
    from stocktake.functions.joins import materialize_small
    side, size = materialize_small(spark.createDataFrame([("ab",), (None,)], "a string"))
    assert side.count() == 2 and size == 2 * 24 + 2
    assert materialize_small(side.limit(0))[1] == 0
