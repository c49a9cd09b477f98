"""Landed API pages: read, apply paging and failure rules, unnest records.

A landed page is one row ``(workspace, endpoint, parent, page_no, status,
collected_at, body)``; ``body`` is the JSON envelope as text. Each body is parsed once: the parsed
page (flags, number of records, records as VARIANT) is written to the shared checkpoint folder,
by endpoint, and everything later reads the columns it needs from there: the bounds and the
counts read no record. Everything here is row-local except the page-rule bounds, an aggregate of one row
per listing (workspace, collection time, endpoint, parent) that is joined back with a checked broadcast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..fixed_values import MORE_FIELDS, TOKEN_FIELD
from ..functions.joins import checkpoint_once, join_checked, materialize_small

PAGE_SCHEMA = ("workspace string, endpoint string, parent string, page_no int, status int, "
               "collected_at timestamp, body string")
# One listing of one collection run: a later run of the same workspace is a listing of its own.
LISTING = ["workspace", "collected_at", "endpoint", "parent"]
#: A parsed page: what the rules, the counts and the records need.
PARSED_COLS = [*LISTING, "page_no", "status", "_usable", "_terminal", "_n", "_records"]
RECORD_COLS = ["workspace", "endpoint", "parent", "page_no", "pos", "collected_at", "rec"]
_NO_BOUND = 2**31 - 1


def read_pages(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """Landed pages from files (parquet or JSON lines); partition the folder by
    ``endpoint`` so that endpoint filters prune whole folders."""
    return spark.read.schema(PAGE_SCHEMA).format(fmt).load(path)


def cap_pages(pages: DataFrame, cap: Column | int | None = None) -> DataFrame:
    """First ``cap`` pages of every listing; 0 = all (L3). ``cap`` defaults to the
    resolved registry column ``page_cap`` (1 when paging is off: L4)."""
    if isinstance(cap, int):
        return pages.where(F.col("page_no") <= cap) if cap else pages
    cap = F.col("page_cap") if cap is None else cap
    return pages.where((cap == 0) | (F.col("page_no") <= cap))


def capped_by_endpoint(pages: DataFrame, caps: dict[str, int]) -> DataFrame:
    """The pages of these endpoints under their caps (L3, L4), as one scan for each cap.

    The caps are literals beside literal endpoints, so the reader skips folders by endpoint and row
    groups by page number; a cap that comes from a join would be met only after the read.
    """
    groups: dict[int, list[str]] = {}
    for endpoint, cap in sorted(caps.items()):
        groups.setdefault(int(cap or 0), []).append(endpoint)
    out = None
    for cap, endpoints in sorted(groups.items()):
        some = cap_pages(pages.where(F.col("endpoint").isin(endpoints)), cap)
        out = some if out is None else out.unionByName(some)
    return pages.where(F.lit(False)) if out is None else out


def page_flags(pages: DataFrame, token_only: Column | bool = False,
               paginate: Column | bool = True, reads_token: Column | bool = True) -> DataFrame:
    """Parse the body once and flag the page.

    usable: status 200 and the body parses (as an object, when paging).
    terminal: usable, no continuation token and (unless ``token_only``) no more-flag.
    ``reads_token`` is false for endpoints that declare no continuation token: a stray one in
    the body is then not followed.
    """
    token_only = F.lit(token_only) if isinstance(token_only, bool) else token_only
    paginate = F.lit(paginate) if isinstance(paginate, bool) else paginate
    reads_token = F.lit(reads_token) if isinstance(reads_token, bool) else reads_token
    v = F.try_parse_json("body")
    obj = F.col("body").rlike(r"^\s*\{")
    df = pages.withColumn("_v", F.when(F.col("status") == 200, v))
    usable = F.col("_v").isNotNull() & (obj | ~paginate)
    token = F.try_variant_get("_v", f"$.{TOKEN_FIELD}", "string")
    has_token = reads_token & token.isNotNull() & (token != "")
    more = F.lit(False)
    for f in MORE_FIELDS:
        more = more | F.coalesce(F.try_variant_get("_v", f"$.{f}", "boolean"), F.lit(False))
    terminal = usable & ~has_token & (token_only | ~more)
    return df.withColumn("_usable", F.coalesce(usable, F.lit(False))).withColumn("_terminal", terminal)


def apply_page_rules(flagged: DataFrame, policy: str = "prefix", listing: list[str] | None = None,
                     broken: Column | None = None) -> DataFrame:
    """Keep the pages a sequential reader would have used.

    prefix:   pages before the first bad page, up to the first terminal page (F8).
    complete: as prefix, but a bad page before the end empties the listing (F9).
    ``broken`` marks failures that lose the whole listing even under ``prefix`` (a
    body that cannot be read, where an HTTP error keeps the earlier pages).
    """
    listing = list(listing or LISTING)
    brk = broken if broken is not None else F.lit(False)
    bounds = (flagged.select(*listing, "page_no", "_usable", "_terminal", brk.alias("_broken"))
              .groupBy(*listing)
              .agg(F.min(F.when(~F.col("_usable"), F.col("page_no"))).alias("_bad"),
                   F.min(F.when(F.col("_terminal"), F.col("page_no"))).alias("_term"),
                   F.min(F.when(F.col("_broken"), F.col("page_no"))).alias("_brk")))
    renamed = bounds.select(*[F.col(c).alias(f"_g_{c}") for c in listing], "_bad", "_term", "_brk")
    small, n = materialize_small(renamed)
    cond = None
    for c in listing:
        e = flagged[c].eqNullSafe(small[f"_g_{c}"])
        cond = e if cond is None else cond & e
    j = join_checked(flagged, small, cond, "inner", small_bytes=n)
    bad = F.coalesce(F.col("_bad"), F.lit(_NO_BOUND))
    term = F.coalesce(F.col("_term"), F.lit(_NO_BOUND))
    # An unusable page is at or after the first bad page, so the bounds alone exclude
    # it; not testing it again here keeps the body from being parsed twice.
    keep = (F.col("page_no") < bad) & (F.col("page_no") <= term)
    if policy == "complete":
        keep = keep & (F.col("_bad").isNull() | (F.col("_bad") > term))
    elif policy != "prefix":
        raise ValueError(f"unknown page policy {policy!r}")
    # the first failure (before the end) is a broken body: nothing of the listing counts
    lost = F.coalesce(F.col("_brk") == F.col("_bad"), F.lit(False)) & (F.col("_bad") < term)
    return j.where(keep & ~lost).drop(*[f"_g_{c}" for c in listing], "_bad", "_term", "_brk")


def listed_records(list_key: Column | str | None = None, paginate: Column | bool = True,
                   object_mode: Column | bool = False, list_keys: list[str] | None = None) -> tuple[Column, Column]:
    """(records of a flagged page as an array, the list under its key): over ``_v``, ``body`` and the list as ``_listed``.

    - the list under ``list_key`` when it is an array (S1, S2);
    - unpaged only: the body itself in object mode (S3); else the first array-valued
      key, in the body's own order, or a bare top-level array (S5).
    A column ``list_key`` is resolved through a CASE over ``list_keys`` (the registry's
    list keys), so each page reads its list by a literal path, without copying the
    envelope into a map.
    """
    paginate = F.lit(paginate) if isinstance(paginate, bool) else paginate
    object_mode = F.lit(object_mode) if isinstance(object_mode, bool) else object_mode
    v = F.col("_v")
    as_array = lambda x: F.try_variant_get(x, "$", "array<variant>")

    def by_path(key: str) -> Column:
        step = f"$['{key}']" if "'" not in key else f'$["{key}"]'
        return F.try_variant_get(v, step, "array<variant>")

    if isinstance(list_key, str):
        listed = by_path(list_key)
    elif list_key is None:
        listed = F.lit(None).cast("array<variant>")
    else:
        listed = F.lit(None).cast("array<variant>")
        for k in sorted(set(list_keys or [])):
            listed = F.when(list_key == k, by_path(k)).otherwise(listed)
    m = F.try_variant_get(v, "$", "map<string,variant>")       # only the unpaged branches use it
    # a variant sorts its keys, so their order is read off the text
    ordered = F.filter(F.json_object_keys("body"), lambda k: as_array(F.element_at(m, k)).isNotNull())
    first_list = as_array(F.element_at(m, F.try_element_at(ordered, F.lit(1))))
    return (F.when(F.col("_listed").isNotNull(), F.col("_listed"))
            .when(~paginate & object_mode & m.isNotNull(), F.array(v))
            .when(~paginate & ~object_mode, F.coalesce(first_list, as_array(v)))), listed


def parse_pages(pages: DataFrame, list_key: Column | str | None = None, paginate: Column | bool = True,
                object_mode: Column | bool = False, list_keys: list[str] | None = None, token_only: Column | bool = False,
                reads_token: Column | bool = True, keep_records: Column | None = None) -> DataFrame:
    """Landed pages -> parsed pages (PARSED_COLS), each body parsed once and the outcome written once.

    ``keep_records`` (all by default) tells whose records are written; of the others only the number is.
    """
    flagged = page_flags(pages, token_only, paginate, reads_token)
    records, listed = listed_records(list_key, paginate, object_mode, list_keys)
    parsed = flagged.withColumn("_listed", listed).withColumn("_all", records)
    kept = F.col("_all") if keep_records is None else F.when(keep_records, F.col("_all"))
    parsed = parsed.withColumn("_n", F.when(F.col("_all").isNull(), F.lit(0)).otherwise(F.size("_all")).cast("long")).withColumn("_records", kept)
    return checkpoint_once(parsed.select(*PARSED_COLS), by=["endpoint"])


def unnest(pages: DataFrame, list_key: Column | str | None = None, paginate: Column | bool = True,
           object_mode: Column | bool = False, wrap_field: str | None = None,
           list_keys: list[str] | None = None) -> DataFrame:
    """One row per record of every kept page, parsed or only flagged (order key: page_no, pos).

    ``wrap_field`` turns scalar records into ``{wrap_field: value}`` (S4).
    """
    if "_records" not in pages.columns:
        records, listed = listed_records(list_key, paginate, object_mode, list_keys)
        pages = pages.withColumn("_listed", listed).withColumn("_records", records)
    cols = [c for c in RECORD_COLS if c not in ("pos", "rec")]
    out = pages.select(*cols, F.posexplode("_records").alias("pos", "rec"))
    if wrap_field:
        out = out.withColumn("rec", wrap_scalar(F.col("rec"), wrap_field))
    return out.select(*RECORD_COLS)


def wrap_scalar(rec: Column, field: str) -> Column:
    """``"x"`` -> ``{field: "x"}``; objects and arrays stay as they are."""
    s = F.schema_of_variant(rec)
    wrapped = F.parse_json(F.to_json(F.create_map(F.lit(field), rec)))
    return F.when(s.startswith("OBJECT") | s.startswith("ARRAY"), rec).otherwise(wrapped)


def landed_pages(pages: DataFrame, registry: DataFrame, policy: str = "prefix",
                 records_of: list[str] | None = None) -> DataFrame:
    """Pages -> parsed pages that count, for every enabled registry endpoint (caps, one parse, rules).

    The registry is a fixed 27-row table, so its broadcast is bounded. ``records_of`` names the endpoints whose
    records will be read (all by default); of the others the number of records is kept.
    """
    reg = registry.select(F.col("key").alias("endpoint"), "list_key", "paginate", "page_cap", "object_mode", "has_token",
                          F.col("parent_key").isNotNull().alias("token_only"))
    rows = reg.select("endpoint", "list_key", "page_cap").collect()
    # the registry's list keys (at most one per endpoint): literal paths for the records
    keys = sorted({r["list_key"] for r in rows if r["list_key"]})
    p = capped_by_endpoint(pages, {r["endpoint"]: r["page_cap"] for r in rows}).join(F.broadcast(reg), "endpoint")
    p = parse_pages(p, F.col("list_key"), F.col("paginate"), F.col("object_mode"), keys, F.col("token_only"), F.col("has_token"),
                    None if records_of is None else F.col("endpoint").isin(records_of))
    return apply_page_rules(p, policy)


def landed_records(pages: DataFrame, registry: DataFrame, policy: str = "prefix", wrap: dict | None = None) -> DataFrame:
    """Pages -> records for every enabled registry endpoint (caps, rules, unnest)."""
    recs = unnest(landed_pages(pages, registry, policy))
    if wrap:
        for endpoint, field in wrap.items():
            recs = recs.withColumn("rec", F.when(F.col("endpoint") == endpoint, wrap_scalar(F.col("rec"), field))
                                   .otherwise(F.col("rec")))
    return recs
