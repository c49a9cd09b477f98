"""Schema-on-read flattening of VARIANT records.

Long form: one row per leaf, made by a chain of ``inline`` generators (one per
nesting level, no shuffle). Object keys add ``.key``, array elements ``[i]``;
empty objects and arrays vanish; a scalar record is the leaf ``_value``.

Wide form: one discovery aggregate (path -> set of kinds, partially aggregated
on the executors, tiny result) and then one narrow ``select`` of a typed column
per discovered path. Discovery counts the distinct shapes of the records (their schema as
text) and expands these; only records whose shape does not tell every path become a row a leaf.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..fixed_values import DEDUP_SEPARATOR, JSON_SUFFIX, SCALAR_ROOT_NAME
from ..functions import variant as V
from ..functions.joins import checkpoint_once
from ..functions.names import clean_name, with_suffix

FIRST_DEPTH = 3          # first guess; deeper records trigger one more, deeper pass
MAX_DEPTH = 256
DEFAULT_MAX_COLUMNS = 20000
# Rows of the column plan the driver takes before it looks for groups that are too wide.
PLAN_ROWS = 200_000
INJECT_MARK = "@"
AS_JSON = "#json"
# metadata of a column: the path it was read from (a table keeps one name for each path)
PATH_KEY = "path"
# the path of a record's own key or element: the first step of a deeper path
TOP_STEP = r"""(?s)^(\$(?:\['[^']*'\]|\["[^"]*"\]|\[\x00.*?\x00\]|\[\d+\]))"""
# kind codes a leaf can carry (anything else counts as OTHER, typed as text)
KIND_CODES = [V.K_INT, V.K_DEC, V.K_NUM, V.K_BOOL, V.K_STR, V.K_NULL, V.K_JSON, V.K_FORCE_STR, V.K_OBJ, V.K_ARR, V.K_DEEP,
              "DATE", "TIMESTAMP", "TIMESTAMP_NTZ"]
OTHER = "OTHER"
# a shape's text as JSON: unquoted keys, and the scalar types that are left
SHAPE_KEY, SHAPE_TYPE = r"([A-Za-z_][A-Za-z0-9_]*): ", r"(?<=[ <])([A-Z][A-Z_ ]*(?:\(\d+,\d+\))?)(?=[,>])"
# paths of whole numbers and fractions whose reach is read by path; of more, every leaf is looked at
SPAN_PATHS = 200
# groups with records that no shape tells, up to which these groups alone are read again
ODD_GROUPS = 100
# the path of a record's own key, quoted either way
OWN_KEY = re.compile(r"""\$\[(?:'([^'`]+)'|"([^"`]+)")\]""")
COMMON_FIRST = sorted((k for k in KIND_CODES if k != V.K_DEC), key=[V.K_STR, V.K_INT, V.K_FORCE_STR, V.K_OBJ, V.K_JSON].__contains__, reverse=True)


class FlattenError(ValueError):
    pass


def _leaf(p: Column, j: Column, v: Column, k: Column) -> Column:
    return F.struct(p.alias("p"), j.alias("j"), v.alias("v"), k.alias("k"))


def _child_path(p: Column, key: Column) -> Column:
    return F.when(p == "", key).otherwise(F.concat(p, F.lit("."), key))


def _start(df: DataFrame, v: str, ids: list[str], keep: Column | None) -> DataFrame:
    cols = [F.col(c) for c in ids]
    out = df.where(F.col(v).isNotNull()).select(
        *cols, F.lit("").alias("_p"), F.lit("$").alias("_j"), F.col(v).alias("_v"),
        F.lit(None).cast("string").alias("_k"),
        (keep if keep is not None else F.lit(None).cast("array<string>")).alias("_keep"))
    return out


def _step(df: DataFrame, ids: list[str], with_keep: bool) -> DataFrame:
    """Expand every container row by one level; leaves and markers pass through.

    Two code-generated generators: ``posexplode_outer`` over a slot array (arrays:
    marker + elements; objects: marker + one slot for their entries), then
    ``explode_outer`` of the object's map in that slot. Slot 0 carries the container
    marker, so an empty container leaves only its marker and vanishes from the leaves.
    """
    p, j, v, k = F.col("_p"), F.col("_j"), F.col("_v"), F.col("_k")
    ctx = [F.col(c) for c in ids] + ([F.col("_keep")] if with_keep else []) + [p, j]
    base = [*ctx, v, k]
    df = df.select(*base, F.when(k.isNull(), F.try_variant_get(v, "$", "map<string,variant>")).alias("_m"))
    null_v = F.lit(None).cast("variant")
    a = F.when(k.isNull() & F.col("_m").isNull(), F.try_variant_get(v, "$", "array<variant>"))
    slots = (F.when(F.col("_m").isNotNull(), F.array(null_v, null_v))
              .otherwise(F.when(a.isNotNull(), F.concat(F.array(null_v), a))))
    df = df.select(*base, "_m", slots.alias("_slots"))
    # a container's own value is not copied beside each of its children
    df = df.select(*ctx, F.when(F.col("_slots").isNull(), v).alias("_v"), k, "_m", F.posexplode_outer("_slots").alias("_ai", "_av"))
    is_obj = F.col("_m").isNotNull()
    entries = F.when(is_obj & (F.col("_ai") == 1), F.col("_m"))
    df = df.select(*base, "_ai", "_av", is_obj.alias("_obj"), F.explode_outer(entries).alias("_key", "_val"))
    ai, obj, key, val = F.col("_ai"), F.col("_obj"), F.col("_key"), F.col("_val")
    # an empty object's entry slot produces one row without a key: drop it
    df = df.where(~(obj & (ai == 1) & key.isNull()))
    # Schema strings computed once per row, in their own columns: a scalar child gets its
    # kind right away (so n nesting levels need n steps); a container child is expanded
    # by the next step.
    scalar_row = k.isNull() & ai.isNull()
    child_val = F.when(~obj & (ai > 0), F.col("_av")).when(obj & (ai == 1), val)
    df = df.select("*", F.schema_of_variant(F.when(scalar_row, v)).alias("_sv"),
                   F.schema_of_variant(child_val).alias("_sc"))
    sc = F.col("_sc")
    child_cont = sc.startswith("OBJECT") | sc.startswith("ARRAY")
    child_kind = F.when(~child_cont, V.kind_from_schema(sc))

    marker = (ai == 0)
    arr_child = ~obj & (ai > 0)
    obj_child = obj & (ai == 1)
    idx = V.index_step(ai - 1)
    o_p, o_j, o_k = _child_path(p, key), F.concat(j, V.key_step(key)), child_kind
    if with_keep:
        # Keep-list projection on the record's own keys: containers become <key>_json text,
        # listed scalars keep their kind, the other scalars become text.
        keep = F.col("_keep")
        on = keep.isNotNull() & (p == "")
        kept_kind = (F.when(child_cont, F.lit(V.K_JSON))
                     .when((F.size(keep) == 0) | F.array_contains(keep, key), V.kind_from_schema(sc))
                     .otherwise(F.lit(V.K_FORCE_STR)))
        o_p = F.when(on & child_cont, F.concat(key, F.lit(JSON_SUFFIX))).otherwise(o_p)
        o_k = F.when(on, kept_kind).otherwise(o_k)
    new_p = F.when(arr_child, F.concat(p, idx)).when(obj_child, o_p).otherwise(p)
    new_j = F.when(arr_child, F.concat(j, idx)).when(obj_child, o_j).otherwise(j)
    new_v = (F.when(k.isNotNull(), v).when(marker, null_v).when(arr_child, F.col("_av"))
             .when(obj_child, val).otherwise(v))
    new_k = (F.when(k.isNotNull(), k).when(marker & obj, F.lit(V.K_OBJ)).when(marker, F.lit(V.K_ARR))
             .when(arr_child, child_kind).when(obj_child, o_k)
             .otherwise(V.kind_from_schema(F.col("_sv"))))
    return df.select(*[F.col(c) for c in ids], new_p.alias("_p"), new_j.alias("_j"), new_v.alias("_v"),
                     new_k.alias("_k"))


def leaf_rows(df: DataFrame, v: str, ids: list[str], depth: int = FIRST_DEPTH,
              keep: Column | None = None) -> DataFrame:
    """All leaves and container markers after ``depth`` levels (``_p, _j, _v, _k``)."""
    cur = _start(df, v, ids, keep)
    for level in range(depth):
        # a keep-list is about a record's own keys: all of them are leaves after the first step
        cur = _step(cur, ids, keep is not None and level == 0)
    return cur.withColumn("_k", F.coalesce(F.col("_k"), F.lit(V.K_DEEP))).drop("_keep")


def _discovered_rows(df: DataFrame, v: str, by: list[str], depth: int, listed: int, keep: Column | None) -> DataFrame:
    """``leaf_rows`` where records with a keep-list take ``listed`` levels and the others ``depth``.

    The own keys of an object with a keep-list are leaves after one level; each further level would only
    carry them on, at several times the cost of the first.
    """
    if keep is None or depth == listed:
        return leaf_rows(df, v, by, depth, keep)
    return leaf_rows(df.where(keep.isNotNull()), v, by, listed, keep).unionByName(
        leaf_rows(df.where(keep.isNull()), v, by, depth))


def flatten_long(df: DataFrame, v: str, ids: list[str], depth: int | None = None,
                 keep: Column | None = None) -> DataFrame:
    """Long form: ``ids..., path, jpath, value (variant), kind``; one row per leaf.

    ``depth`` defaults to the depth found by a discovery pass, so no container is cut off.
    """
    if depth is None:
        depth = required_depth(df, v, ids, keep)
    leaves = leaf_rows(df, v, ids, depth, keep)
    leaves = leaves.where(~F.col("_k").isin(V.K_OBJ, V.K_ARR, V.K_DEEP))
    return leaves.select(*ids,
                         F.when(F.col("_p") == "", F.lit(SCALAR_ROOT_NAME)).otherwise(F.col("_p")).alias("path"),
                         F.col("_j").alias("jpath"), F.col("_v").alias("value"),
                         F.when(F.col("_k").startswith(V.K_DEC), V.K_NUM).otherwise(F.col("_k")).alias("kind"))


def required_depth(df: DataFrame, v: str, ids: list[str], keep: Column | None = None) -> int:
    """Levels needed so that no container is left unexpanded."""
    depth = FIRST_DEPTH
    while True:
        deep = (leaf_rows(df.select(*ids, v), v, ids, depth, keep).where(F.col("_k") == V.K_DEEP)
                .agg(F.count(F.lit(1)).alias("n"), F.schema_of_variant_agg(F.col("_v")).alias("s")).first())
        if not deep["n"]:
            return depth
        if depth >= MAX_DEPTH:
            raise FlattenError(f"records nest deeper than {MAX_DEPTH} levels")
        depth = min(depth + max(schema_depth(deep["s"]), 1), MAX_DEPTH)


@dataclass(frozen=True)
class ColumnPlan:
    group: tuple
    jpath: str
    path: str
    type: str
    guard: bool
    name: str

    @property
    def key(self) -> str:
        """What the column holds, for the names that a table keeps: the path, and whether as JSON text."""
        return self.jpath + (AS_JSON if self.type == "json" else "")


def discover(df: DataFrame, v: str, by: list[str] | None = None, keep: Column | None = None,
             depth: int | None = None, max_columns: int = DEFAULT_MAX_COLUMNS,
             inject: list[str] | None = None, counts_out: dict | None = None,
             names: dict[tuple, dict[str, str]] | None = None, by_shape: bool = True) -> dict[tuple, list[ColumnPlan]]:
    """One aggregate over the records: the wide columns per group of ``by``.

    Partial aggregation keeps the shuffle at one row per (task, shape) and (task, path). ``by_shape=False`` makes
    every leaf a row. If some records
    nest deeper than ``depth`` the pass is repeated deeper; nothing is cut off.
    ``inject`` names top-level string fields supplied as columns (context such as the
    parent's name); they are named and de-duplicated together with the record's keys.
    ``counts_out`` receives the number of records per group (same pass). A group with more than
    ``max_columns`` paths keeps its widest keys as JSON text (``_narrowed``). ``names`` holds, per group, the
    columns that paths have had in earlier runs: these keep them, and new paths take names never used.
    """
    by = list(by or [])
    depth, listed = depth or FIRST_DEPTH, 1
    records = df.select(*by, v)
    shapes, odd = _shapes(records, v, by, keep) if by_shape and _same_for_group(records, by, keep) else (None, records)
    while True:
        parts = []
        if shapes is not None:
            found = leaf_rows(shapes, v, [*by, "_times"], depth, keep)
            # the scalars of a shape are the names of their types
            parts.append((found.withColumn("_k", F.when(F.col("_k") == V.K_STR, V.kind_from_schema(F.try_variant_get("_v", "$", "string")))
                                           .otherwise(F.col("_k"))), True))
        if odd is not None:
            parts.append((_discovered_rows(odd, v, by, depth, listed, keep).withColumn("_times", F.lit(1).cast("long")), False))
        # One bit per kind code in a fixed-width buffer, so a plain hash aggregate with
        # map-side combine (collect_set would need object buffers per group).
        # The bit and the numbers are made where the leaves are, so no value travels to the aggregate.
        bits = {k: 1 << i for i, k in enumerate([*KIND_CODES, OTHER])}
        bit = F.when(F.col("_k").startswith(V.K_DEC), F.lit(bits[V.K_DEC]))
        for k in COMMON_FIRST:
            bit = bit.when(F.col("_k") == k, F.lit(bits[k]))
        seen = None
        for leaves, shaped in parts:
            value = F.lit(None).cast("variant") if shaped else F.col("_v")
            some = leaves.select(*by, "_times", "_j", "_p", bit.otherwise(F.lit(bits[OTHER])).alias("_bit"), *V.sizes(F.col("_k"), value))
            seen = some if seen is None else seen.unionByName(some)
        kinds = (seen.groupBy(*by, "_j", "_p")
                 .agg(F.bit_or("_bit").alias("_bits"), V.reach().alias("reach"),
                      # every record has exactly one row at the root path: its count comes free
                      F.sum("_times").alias("_rows"))
                 .select(*by, "_j", "_p", "_rows", "reach",
                         F.array_compact(F.array(*[F.when(F.col("_bits").bitwiseAND(F.lit(b)) != 0, F.lit(k))
                                                   for k, b in bits.items()])).alias("kinds")))
        if inject:
            extra = (kinds.select(*by).distinct()
                     .select(*by, F.explode(F.array(*[F.lit(n) for n in inject])).alias("_p"))
                     .select(*by, F.concat(F.lit(INJECT_MARK), F.col("_p")).alias("_j"), "_p",
                             F.array(F.lit(V.K_STR)).alias("kinds"), F.lit(0).cast("long").alias("_rows"),
                             F.lit(None).cast(V.REACH_TYPE).alias("reach")))
            kinds = kinds.unionByName(extra)
        rows = _planned(kinds, by, names).limit(PLAN_ROWS + 1).collect()
        if shapes is not None:
            # a shape tells no number: where whole numbers meet fractions, their reach is read by path
            met = sorted({r["_j"] for r in rows if _numbers_meet(r["kinds"])})
            if len(met) > SPAN_PATHS or met and len(rows) > PLAN_ROWS:
                return discover(df, v, by, keep, depth, max_columns, inject, counts_out, names, by_shape=False)
            if met:
                kinds = checkpoint_once(_with_spans(kinds, records, v, by, met))
                rows = _planned(kinds, by, names).limit(PLAN_ROWS + 1).collect()
        if len(rows) > PLAN_ROWS or _too_wide(rows, by, max_columns):
            kinds = checkpoint_once(kinds)
            deep = not kinds.where(F.array_contains("kinds", V.K_DEEP)).isEmpty()
            rows = rows if deep else _planned(_narrowed(kinds, by, max_columns), by, names).collect()
        else:
            deep = any(r["deep"] for r in rows)
        if not deep:
            break
        if depth >= MAX_DEPTH and (keep is None or listed >= MAX_DEPTH):
            raise FlattenError(f"records nest deeper than {MAX_DEPTH} levels")
        # rare: shape of what is still unexpanded tells how much deeper to go
        deeper = max(schema_depth(leaves.where(F.col("_k") == V.K_DEEP).agg(F.schema_of_variant_agg(F.col("_v")).alias("s")).first()["s"])
                     for leaves, _ in parts)
        depth = listed = min(depth + max(deeper, 1), MAX_DEPTH)
    out: dict[tuple, list[ColumnPlan]] = {}
    if counts_out is not None:
        for r in rows:
            if r["_j"] == "$" and r["_rows"]:
                g = tuple(r[c] for c in by)
                counts_out[g] = counts_out.get(g, 0) + int(r["_rows"])
    for r in rows:
        if not r["is_column"]:
            continue
        g = tuple(r[c] for c in by)
        out.setdefault(g, []).append(ColumnPlan(g, r["_j"], r["display"], r["type"], bool(r["guard"]), r["name"]))
    return out


def _same_for_group(records: DataFrame, by: list[str], keep: Column | None) -> bool:
    """Whether the keep-list depends on the group alone, and not on the record."""
    try:
        return keep is None or bool(records.select(*by).select(keep).columns)
    except AnalysisException:
        return False


def _shapes(records: DataFrame, v: str, by: list[str], keep: Column | None) -> tuple[DataFrame | None, DataFrame | None]:
    """The distinct shapes of the records, as VARIANTs that hold the name of each scalar's type, with the number of
    their records (``_times``); and the records whose shape does not tell all paths and kinds. None where there are none.

    Those are no objects, have a key that needs quotes, or a list anywhere (its elements share one type in the
    schema); under a keep-list, lists and objects are JSON text whatever is in them.
    """
    listed = F.lit(False) if keep is None else keep.isNotNull()
    text = F.col("_text")
    told = text.startswith("OBJECT<") & ~text.contains("`") & (listed | ~text.contains("ARRAY<"))
    typed = lambda some: some.where(F.col(v).isNotNull()).withColumn("_text", F.schema_of_variant(v))
    found = checkpoint_once(typed(records).select(*by, F.when(told, text).alias("_shape")).groupBy(*by, "_shape")
                            .agg(F.count(F.lit(1)).alias("_times")))
    heads = found.select(*by, F.col("_shape").isNull().alias("_odd")).distinct().limit(ODD_GROUPS + 1).collect()
    few, odd_in = len(heads) <= ODD_GROUPS, [r for r in heads if r["_odd"]]
    if few and len(odd_in) == len(heads):
        return None, records
    here = F.lit(not few)  # only the folders of these groups are read again
    for r in odd_in if few else ():
        group = F.lit(True)
        for c in by:
            group = group & (F.col(c).isNull() if r[c] is None else F.col(c) == F.lit(r[c]))
        here = here | group
    json = F.regexp_replace(F.regexp_replace("_shape", F.lit(SHAPE_KEY), F.lit('"$1": ')), F.lit(SHAPE_TYPE), F.lit('"$1"'))
    for mark, brace in (("OBJECT<", "{"), ("ARRAY<", '{"":'), (">", "}")):
        json = F.replace(json, F.lit(mark), F.lit(brace))
    shapes = found.where(F.col("_shape").isNotNull()).select(*by, "_times", F.parse_json(json).alias(v))
    return shapes, typed(records.where(here)).where(~told).drop("_text") if odd_in or not few else None


def _numbers_meet(kinds: list[str]) -> bool:
    numbers = {V.K_INT, V.K_DEC, V.K_NUM}
    found = set(kinds) - {V.K_NULL, V.K_OBJ, V.K_ARR, V.K_DEEP}
    return V.K_INT in found and len(found) > 1 and found <= numbers


def _with_spans(kinds: DataFrame, records: DataFrame, v: str, by: list[str], paths: list[str]) -> DataFrame:
    """``kinds`` with the least and the largest BIGINT at these paths: one aggregate that makes no leaf a row."""
    ends = []
    for i, path in enumerate(paths):
        x = V.value_at(F.col(v), path)
        whole = F.when(V.kind_of(x) == V.K_INT, F.try_variant_get(x, "$", "bigint"))
        ends += [F.min(whole).alias(f"_low{i}"), F.max(whole).alias(f"_high{i}")]
    groups = [f"_g{i}" for i in range(len(by))]
    at = F.array(*[F.struct(F.lit(p).alias("_at"), F.col(f"_low{i}").alias("_low"), F.col(f"_high{i}").alias("_high")) for i, p in enumerate(paths)])
    spans = checkpoint_once(records.groupBy(*[F.col(c).alias(g) for c, g in zip(by, groups)]).agg(*ends).select(*groups, F.inline(at)))
    same = F.col("_j") == F.col("_at")
    for c, g in zip(by, groups):
        same = same & F.col(c).eqNullSafe(F.col(g))
    reach = F.col("reach")
    # a row a group and path: as few as the paths found to meet
    return kinds.join(F.broadcast(spans), same, "left").withColumn("reach", F.when(reach.isNotNull(), F.struct(
        F.least(reach["low"], F.col("_low")).alias("low"), F.greatest(reach["high"], F.col("_high")).alias("high"),
        reach["digits"].alias("digits"), reach["whole"].alias("whole"), reach["scale"].alias("scale")))).drop(*groups, "_at", "_low", "_high")


def _is_column() -> Column:
    return F.size(F.array_except("kinds", F.array(*[F.lit(x) for x in (V.K_OBJ, V.K_ARR, V.K_DEEP)]))) > 0


def _planned(kinds: DataFrame, by: list[str], names: dict[tuple, dict[str, str]] | None = None) -> DataFrame:
    """The plan's rows that the driver needs: columns, unexpanded containers, and the roots with the counts."""
    return _plan_frame(kinds, by, names).where(F.col("is_column") | F.col("deep") | (F.col("_j") == "$"))


def _too_wide(rows: list, by: list[str], max_columns: int) -> bool:
    return any(n > max_columns for n in Counter(tuple(r[c] for c in by) for r in rows if r["is_column"]).values())


def _narrowed(kinds: DataFrame, by: list[str], max_columns: int) -> DataFrame:
    """Paths (stored) of which no group has more than ``max_columns``; nothing of the records is lost.

    In a group that is too wide (maps keyed by ids), the record's keys with the most paths below
    them become one JSON text column each, widest first, until the rest fits; a record that is
    itself such a map becomes the JSON text column ``_value``. Paths are counted on the
    executors; the driver takes one row a group, and for a wide group ``max_columns`` at most.
    """
    top = F.regexp_extract("_j", TOP_STEP, 1)
    totals = kinds.where(_is_column()).groupBy(*by).agg(F.count(F.lit(1)).alias("n")).collect()
    out = kinds
    for r in totals:
        if r["n"] <= max_columns:
            continue
        here = F.lit(True)
        for c in by:
            here = here & F.col(c).eqNullSafe(F.lit(r[c]))
        left, wide = r["n"], []
        for t in (kinds.where(here & _is_column() & (top != "")).groupBy(top.alias("top")).agg(F.count(F.lit(1)).alias("n"))
                  .orderBy(F.desc("n"), "top").limit(max_columns).collect()):
            if left <= max_columns or t["n"] < 2:
                break
            wide.append(t["top"])
            left -= t["n"] - 1
        as_json = F.array(F.lit(V.K_JSON))
        if left > max_columns:
            # the root row stays for the record count; its JSON form is a row of its own
            root = kinds.where(here & (F.col("_j") == "$"))
            out = out.where(~here | (F.col("_j") == "$") | F.col("_j").startswith(INJECT_MARK)).unionByName(
                root.withColumn("kinds", as_json).withColumn("_rows", F.lit(0).cast("long")))
        elif wide:
            head = kinds.where(here & (top == F.col("_j")) & top.isin(wide))
            out = out.where(~(here & top.isin(wide)) | (top == F.col("_j"))).unionByName(
                head.withColumn("kinds", as_json).withColumn("_p", F.concat("_p", F.lit(JSON_SUFFIX))))
    return out


def _plan_frame(kinds: DataFrame, by: list[str], names: dict[tuple, dict[str, str]] | None = None) -> DataFrame:
    """Type, guard flag and safe, de-duplicated name for every discovered path.

    A path with a stored name keeps it. The others are numbered behind the highest number that their cleaned
    name has had, so no column ever changes its path.
    """
    scalar = F.array_except("kinds", F.array(*[F.lit(x) for x in (V.K_OBJ, V.K_ARR, V.K_DEEP)]))
    has_container = (F.array_contains("kinds", V.K_OBJ) | F.array_contains("kinds", V.K_ARR)
                     | F.array_contains("kinds", V.K_JSON))
    display = F.when(F.col("_p") == "", F.lit(SCALAR_ROOT_NAME)).otherwise(F.col("_p"))
    df = (kinds
          .withColumn("deep", F.array_contains("kinds", V.K_DEEP))
          .withColumn("is_column", F.size(scalar) > 0)
          .withColumn("type", V.lattice_type(F.col("kinds"), F.col("reach")))
          # Any container at the same path (also one turned into <key>_json) must not leak
          # its JSON text into a string column.
          .withColumn("guard", F.max(has_container.cast("int")).over(Window.partitionBy(*by, "_j")) > 0)
          .withColumn("display", display)
          # rows that are no columns need no name; their path keeps them out of one window partition
          .withColumn("clean", F.when(F.col("is_column"), clean_name("display")).otherwise(F.col("_j"))))
    df = _with_stored_names(df, by, names or {})
    w = Window.partitionBy(*by, "is_column", "clean", F.col("stored").isNull()).orderBy("display", "_j")
    number = F.col("used") + F.row_number().over(w) - 1
    return df.withColumn("name", F.when(F.col("is_column"), F.coalesce("stored", with_suffix(F.col("clean"), number))))


def _with_stored_names(df: DataFrame, by: list[str], names: dict[tuple, dict[str, str]]) -> DataFrame:
    """``stored``: the path's column of earlier runs; ``used``: names its cleaned name has had.

    The dictionary has one entry a column of the tables (``max_columns`` each at most), and is broadcast.
    """
    entries, used = [], {}
    for group, columns in names.items():
        for key, name in columns.items():
            entries.append((*group, key, name))
            base, _, number = name.rpartition(DEDUP_SEPARATOR)
            base, n = (base, int(number)) if base and number.isdigit() else (name, 0)
            used[(*group, base)] = max(used.get((*group, base), 0), n + 1)
    if not entries:
        return df.withColumn("stored", F.lit(None).cast("string")).withColumn("used", F.lit(0))
    spark, heads = df.sparkSession, ", ".join(f"_g{i} string" for i in range(len(by)))
    known = spark.createDataFrame(entries, f"{heads + ', ' if by else ''}_key string, stored string")
    highest = spark.createDataFrame([(*k, n) for k, n in used.items()], f"{heads + ', ' if by else ''}_base string, used int")
    same = F.lit(True)
    for i, c in enumerate(by):
        same = same & F.col(c).eqNullSafe(F.col(f"_g{i}"))
    key = F.when(F.col("type") == "json", F.concat("_j", F.lit(AS_JSON))).otherwise(F.col("_j"))
    groups = [f"_g{i}" for i in range(len(by))]
    df = df.join(F.broadcast(known), same & (key == F.col("_key")) & F.col("is_column"), "left").drop(*groups, "_key")
    df = df.join(F.broadcast(highest), same & (F.col("clean") == F.col("_base")), "left").drop(*groups, "_base")
    return df.withColumn("used", F.coalesce("used", F.lit(0)))


def schema_depth(schema: str | None) -> int:
    """Nesting depth of a variant schema string (OBJECT<..>/ARRAY<..> levels).

    Mixed arrays merge to VARIANT and hide their depth: one more level is added, and
    any container still left unexpanded triggers another, deeper pass.
    """
    schema = schema or ""
    depth = best = 0
    i = 0
    while i < len(schema):
        if schema.startswith("OBJECT<", i) or schema.startswith("ARRAY<", i):
            depth += 1
            best = max(best, depth)
            i += 7 if schema[i] == "O" else 6
            continue
        if schema[i] == ">":
            depth -= 1
        i += 1
    return best + (1 if "VARIANT" in schema else 0)


def flatten_wide(df: DataFrame, v: str, plan: list[ColumnPlan], keep_cols: list | None = None,
                 inject: dict[str, Column] | None = None) -> DataFrame:
    """One narrow projection: ``keep_cols`` plus one typed column per planned path.

    The record's own keys are read together, as one struct: by path, each key would be sought from the start.
    """
    keep_cols = [F.col(c) if isinstance(c, str) else c for c in keep_cols or []]
    inject = inject or {}
    keys, types = _own_keys(plan), {}
    for c in plan:
        if c.jpath in keys:
            plain = c.jpath not in types and c.type != "json" and not (c.guard and c.type == "string")
            types[c.jpath] = c.type if plain else "variant"
    if types:
        own = ", ".join(f"`{keys[path]}`: {t}" for path, t in types.items())
        df = df.withColumn(OWN, F.try_variant_get(v, "$", f"struct<{own}>"))

    def column(c: ColumnPlan) -> Column:
        if c.jpath.startswith(INJECT_MARK):
            return inject[c.path]
        if c.jpath not in types:
            return V.extract(v, c.jpath, c.type, c.guard)
        x = F.col(OWN).getField(keys[c.jpath])
        return x if types[c.jpath] != "variant" else V.extracted(x, c.type, c.guard)

    return df.select(*keep_cols, *[column(c).alias(c.name, metadata={PATH_KEY: c.key}) for c in plan])


#: The record's own keys as a struct, while its columns are made.
OWN = "__own"


def _own_keys(plan: list[ColumnPlan]) -> dict[str, str]:
    """Key of each path that is a key of the record itself; names that differ in case alone are left to their paths."""
    found = {c.jpath: m.group(1) or m.group(2) for c in plan if (m := OWN_KEY.fullmatch(c.jpath))}
    same = Counter(key.lower() for key in found.values())
    return {path: key for path, key in found.items() if same[key.lower()] == 1}


def flatten(df: DataFrame, v: str, keep_cols: list[str] | None = None, keep: Column | None = None,
            max_columns: int = DEFAULT_MAX_COLUMNS) -> DataFrame:
    """Discover and project in one call, for one group of records."""
    plans = discover(df, v, keep=keep, max_columns=max_columns)
    return flatten_wide(df, v, plans.get((), []), keep_cols)
