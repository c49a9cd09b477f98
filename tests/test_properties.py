"""Properties from the test strategy: safe names, wide = pivot of long."""

import json

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from conftest import records
from stocktake.functions.names import safe_column_names
from stocktake.operators.flatten import flatten, flatten_long

_chars = st.sampled_from(list("aAbB_. []:-={}();,\"'\t\n1é"))
_names = st.lists(st.text(_chars, min_size=1, max_size=6), min_size=1, max_size=12)


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(_names)
def test_safe_names_are_unique_and_non_empty(spark, names):
    out = safe_column_names(spark, names)
    assert len(out) == len(names) and len(set(out)) == len(out) and all(out)


_scalar = st.one_of(st.integers(-5, 5), st.booleans(), st.none(), st.sampled_from(["x", "y"]))
_json = st.recursive(_scalar, lambda inner: st.one_of(
    st.lists(inner, max_size=3), st.dictionaries(st.sampled_from(["a", "b", "c"]), inner, max_size=3)),
    max_leaves=8)


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.dictionaries(st.sampled_from(["k", "m", "n"]), _json, max_size=3), min_size=1, max_size=4))
def test_wide_is_pivot_of_long(spark, docs):
    recs = records(spark, [(i, json.dumps(d)) for i, d in enumerate(docs)])
    long = {(r["id"], r["path"]): r["value"].toJson() for r in flatten_long(recs, "rec", ["id"]).collect()}
    wide = flatten(recs, "rec", ["id"])
    # one wide column per distinct long path
    assert len(wide.columns) - 1 == len({p for _, p in long})
    # every leaf value is present in its row of the wide form
    as_text = wide.select("id", F.to_json(F.struct(*[c for c in wide.columns if c != "id"])).alias("j")).collect()
    cells = {r["id"]: set(json.loads(r["j"]).values()) for r in as_text}
    for (i, _), v in long.items():
        val = json.loads(v)
        if val is not None:
            assert val in cells[i] or str(val).lower() in {str(x).lower() for x in cells[i]}
