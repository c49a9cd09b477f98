"""Build landed pages from relational tables (the test tables play API listings).

Records become JSON text with ``to_json``; a page groups at most a bounded number
of records (the page number is derived from the data), so ``collect_list`` per page
is bounded by construction. Continuation tokens point to the next page of the
same listing; the last page of a listing has none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..fixed_values import TOKEN_FIELD
from ..functions.joins import join_checked

DEFAULT_TS = "2024-01-01 00:00:00"


def pack_pages(df: DataFrame, endpoint: str, list_key: str | None, page_no: Column, record: Column,
               order: Column, parent: Column | None = None, workspace: Column | str = "ws-main",
               status: Column | None = None, html: Column | None = None, token: bool = True,
               end_here: Column | None = None, extra_fields: dict[str, str] | None = None,
               collected_at: str = DEFAULT_TS, by_listing: bool = False) -> DataFrame:
    """Group records into envelopes ``{list_key: [...], next_page_token?}``.

    ``status`` / ``html`` / ``end_here`` are aggregated over a page's records (a max)
    and mark it failed, give it a non-JSON body, or drop its token although later
    pages exist. ``extra_fields`` adds envelope fields (JSON text values).
    ``list_key=None`` lands each record as the page body itself (object listings).
    ``by_listing`` is for many short listings: each is packed by one task, in one exchange and without a join.
    """
    ws = F.lit(workspace) if isinstance(workspace, str) else workspace
    par = parent if parent is not None else F.lit(None).cast("string")
    # The table's own columns travel through one page shuffle; records, their order and the JSON text of a whole
    # page are made after it, so no record is sorted or sent beside its order columns.
    keyed = df.select("*", ws.alias("_pw"), par.cast("string").alias("_pp"), page_no.cast("int").alias("_pn"))
    listing = [c for c, given in (("_pw", not isinstance(workspace, str)), ("_pp", parent is not None)) if given]
    src = keyed.repartition(*(listing if by_listing and listing else [*listing, "_pn"])).select(
        F.col("_pw").alias("workspace"), F.col("_pp").alias("parent"), F.col("_pn").alias("page_no"),
        order.alias("_o"), record.alias("_r"),
        (status if status is not None else F.lit(200)).alias("_st"),
        (html if html is not None else F.lit(False)).alias("_html"),
        (end_here if end_here is not None else F.lit(False)).alias("_end"))
    # An order of several columns is spread out: sort_array would make a new ordering for each two nested structs it compares.
    o = src.schema["_o"].dataType
    keys = [F.col("_o")[f.name].alias(f"_o{i}") for i, f in enumerate(o.fields)] if isinstance(o, T.StructType) else [F.col("_o")]
    aggs = [F.sort_array(F.collect_list(F.struct(*keys, F.col("_r")))).alias("_rs"),
            F.max("_st").alias("status"), F.max(F.col("_html").cast("int")).alias("_html"),
            F.max(F.col("_end").cast("int")).alias("_end")]
    pages = src.groupBy("workspace", "parent", "page_no").agg(*aggs)
    if not listing:
        # a single listing: its last page is one number
        last_no = keyed.agg(F.max("_pn")).first()[0]
        pages = pages.withColumn("_last", F.lit(last_no))
    elif by_listing:
        pages = pages.withColumn("_last", F.max("page_no").over(Window.partitionBy("workspace", "parent")))
    else:
        last = keyed.groupBy(F.col("_pw").alias("_w"), F.col("_pp").alias("_p")) \
                    .agg(F.max("_pn").alias("_last"))
        on = (pages["workspace"].eqNullSafe(last["_w"])) & (pages["parent"].eqNullSafe(last["_p"]))
        pages = join_checked(pages, last, on)
    records = F.transform("_rs", lambda x: x["_r"])
    tok = F.when(F.lit(token) & (F.col("page_no") < F.col("_last")) & (F.col("_end") == 0),
                 F.concat(F.lit(f',"{TOKEN_FIELD}":"p'), (F.col("page_no") + 1).cast("string"), F.lit('"')))
    if list_key is None:
        body = F.to_json(F.element_at(records, 1))
    else:
        extra = "".join(f',"{k}":{v}' for k, v in (extra_fields or {}).items())
        body = F.concat(F.lit('{"' + list_key + '":'), F.to_json(records), F.lit(extra), F.coalesce(tok, F.lit("")),
                        F.lit("}"))
    body = F.when(F.col("_html") == 1, F.lit("<html><body>Service unavailable</body></html>")).otherwise(body)
    return pages.select("workspace", F.lit(endpoint).alias("endpoint"), "parent", "page_no",
                        F.col("status").cast("int").alias("status"),
                        F.to_timestamp(F.lit(collected_at)).alias("collected_at"), body.alias("body"))
