"""stocktake: landed JSON listings -> analysis-ready inventory tables, on Spark.

Main entry points:

- ``sources.landing``: ``read_pages``, ``landed_records`` (page rules, caps, unnesting)
- ``operators.flatten`` / ``operators.shape``: ``flatten_long``, ``discover``, ``flatten_wide``,
  ``shape_records``
- ``operators.hierarchy``: ``catalog_scan``, ``child_rows``, ``count_types``
- ``operators.summary``: ``build_summary``, ``merge_counts``, ``grand_totals``
- ``sinks.tables``: ``InventorySink`` (evolving parquet tables), ``drop_matching``
- ``streaming.stream``: ``stream_raw`` (incremental, idempotent per micro-batch)
- ``plans.batch``: ``build_inventory``, ``run_batch``
"""

__version__ = "0.1.0"
