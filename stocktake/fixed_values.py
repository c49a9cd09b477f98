"""Fixed values that must match the behaviour being reproduced.

Everything here is data, not logic: endpoint registry, paging overrides,
per-type keep-lists, summary labels and the characters the name cleaner
replaces. Keys carry no platform prefix; ``registry_df(prefix=...)`` adds one.
"""

# --- FIXED VALUES: endpoint registry -------------------------------------------------
# (key, list_key, built-in paging flag, declares paging parameters, parent key, parent field)
ENDPOINTS = [
    ("cluster", "clusters", True, True, None, None),
    ("cluster_policy", "policies", True, True, None, None),
    ("instance_pool", "instance_pools", False, False, None, None),
    ("workspace_file", "objects", False, False, None, None),
    ("dbfs_file", "files", False, False, None, None),
    ("workspace_conf", None, False, False, None, None),
    ("global_init_script", "scripts", False, False, None, None),
    ("job", "jobs", True, True, None, None),
    ("pipeline", "statuses", False, False, None, None),
    ("dashboard", "dashboards", True, True, None, None),
    ("registered_model", "registered_models", True, True, None, None),
    ("experiment", "experiments", True, True, None, None),
    ("model_serving", "endpoints", True, True, None, None),
    ("sql_endpoint", "warehouses", True, True, None, None),
    ("sql_alerts", "results", True, True, None, None),
    ("catalog", "catalogs", False, False, None, None),
    ("external_location", "external_locations", True, True, None, None),
    ("storage_credential", "storage_credentials", True, True, None, None),
    ("share", "shares", True, True, None, None),
    ("recipient", "recipients", True, True, None, None),
    ("repo", "repos", True, True, None, None),
    ("secret_scope", "scopes", False, False, None, None),
    ("group", "group_names", True, True, None, None),
    ("connection", "connections", True, True, None, None),
    ("credential", "instance_profiles", False, False, None, None),
    ("vector_search_endpoint", "endpoints", True, True, None, None),
    ("vector_search_index", "vector_indexes", True, True, "vector_search_endpoint", "endpoint_name"),
]

# --- FIXED VALUES: per-endpoint paging overrides (None = no override) ---------------
PAGING_OVERRIDES = {
    "cluster": True,
    "cluster_policy": True,
    "instance_pool": None,
    "workspace_file": True,
    "dbfs_file": True,
    "workspace_conf": None,
    "global_init_script": None,
    "job": True,
    "pipeline": None,
    "dashboard": True,
    "registered_model": True,
    "experiment": True,
    "model_serving": True,
    "sql_endpoint": True,
    "sql_alerts": True,
    "catalog": None,
    "external_location": True,
    "storage_credential": True,
    "share": True,
    "recipient": True,
    "repo": True,
    "secret_scope": None,
    "group": True,
    "connection": True,
    "credential": None,
    "vector_search_endpoint": True,
    "vector_search_index": True,
}

# Endpoints of the catalog scan (listed per parent, not in the registry above).
SCHEMA_KEY = "schema"
TABLE_KEY = "table"
CATALOG_SCAN_LIST_KEYS = {"catalog": "catalogs", SCHEMA_KEY: "schemas", TABLE_KEY: "tables"}

# --- FIXED VALUES: keep-lists, fields kept as typed scalars per object type ----------
KEEP_FIELDS = {
    "table": [
        "name", "table_name", "full_name", "catalog_name", "schema_name",
        "table_id", "metastore_id",
        "table_type", "data_source_format",
        "owner", "created_at", "created_by", "updated_at", "updated_by",
        "comment", "generation",
        "_catalog", "_schema", "_collected_at", "_workspace",
    ],
    "schema": [
        "catalog_name", "schema_name", "full_name", "owner",
        "created_at", "updated_at", "comment", "_catalog", "_schema",
    ],
    "cluster": [
        "cluster_id", "cluster_name", "cluster_source",
        "state", "state_message", "start_time", "terminated_time",
        "last_state_loss_time", "last_activity_time", "last_restarted_time",
        "spark_version", "node_type_id", "driver_node_type_id",
        "num_workers", "autoscale_min_workers", "autoscale_max_workers",
        "autotermination_minutes", "enable_elastic_disk", "enable_local_disk_encryption",
        "creator_user_name", "single_user_name",
        "cluster_memory_mb", "cluster_cores",
        "policy_id", "data_security_mode", "runtime_engine",
        "_collected_at", "_workspace",
    ],
    "job": [
        "job_id", "creator_user_name", "created_time", "run_as_user_name",
        "_collected_at", "_workspace",
    ],
    "pipeline": [
        "pipeline_id", "name", "creator_user_name", "state", "health",
        "latest_updates_state", "latest_updates_creation_time",
        "_collected_at", "_workspace",
    ],
    "model_serving": [
        "id", "name", "creator", "creation_timestamp", "last_updated_timestamp",
        "state_config_served_models", "state_ready",
        "_collected_at", "_workspace",
    ],
    "instance_pool": [
        "instance_pool_id", "instance_pool_name", "node_type_id",
        "min_idle_instances", "max_capacity", "idle_instance_autotermination_minutes",
        "state", "_collected_at", "_workspace",
    ],
    "registered_model": [
        "name", "creation_timestamp", "last_updated_timestamp", "user_id",
        "id", "description", "_collected_at", "_workspace",
    ],
    "catalog": [
        "name", "catalog_type", "owner", "comment", "metastore_id",
        "created_at", "created_by", "updated_at", "updated_by",
        "_collected_at", "_workspace",
    ],
    "connection": [
        "name", "connection_type", "owner", "comment", "metastore_id",
        "created_at", "created_by", "updated_at", "updated_by",
        "_collected_at", "_workspace",
    ],
    "recipient": [
        "name", "owner", "comment", "metastore_id",
        "created_at", "created_by", "updated_at", "updated_by",
        "authentication_type", "data_recipient_global_metastore_id",
        "_collected_at", "_workspace",
    ],
    "cluster_policy": [
        "policy_id", "name", "creator_user_name", "created_at_timestamp",
        "description", "is_default", "max_clusters_per_user",
        "_collected_at", "_workspace",
    ],
    "experiment": [
        "experiment_id", "name", "artifact_location", "lifecycle_stage",
        "creation_time", "last_update_time",
        "_collected_at", "_workspace",
    ],
}

# --- FIXED VALUES: summary labels -----------------------------------------------------
# counter key -> (Category, Object)
SUMMARY_FIXED = {
    "uc_catalogs": ("Metastore", "UC Catalogs"),
    "uc_schemas": ("Metastore", "UC Schemas"),
    "uc_tables": ("Metastore", "UC Tables"),
    "managed_tables": ("Metastore", "UC Tables (Managed)"),
    "external_tables": ("Metastore", "UC Tables (External)"),
    "dbfs_mount_points": ("DBFS/Mounts", "Mount Points"),
}
AUTO_CATEGORY = "Auto"
OTHER_CATEGORY = "Other"
NOT_MIGRATED_CATEGORIES = ["Workspace", "MLflow"]
COUNTER_KEYS = ["uc_catalogs", "uc_schemas", "uc_tables", "managed_tables", "external_tables"]
MOUNTS_KEY = "dbfs_mount_points"
MOUNT_FIELD = "mount_point"

# --- FIXED VALUES: names, suffixes, table naming --------------------------------------
# Characters the column-name cleaner turns into "_" (after lower-casing).
NAME_REPLACED_CHARS = [".", "[", "]", " ", ":", "-", "=", "{", "}", "(", ")", ";", ",", '"', "'", "\n", "\t"]
DEDUP_SEPARATOR = "__"
SCALAR_ROOT_NAME = "_value"
JSON_SUFFIX = "_json"
RAW_TABLE_PREFIX = "raw_"
SUMMARY_TABLE = "workspace_scan_summary"
LEGACY_CATALOG = "hive_metastore"
EMPTY_PLACEHOLDER_COLUMN = "_empty"
COLLECTED_AT = "_collected_at"
WORKSPACE = "_workspace"
GROUP_WRAP_FIELD = "group_name"
TOKEN_FIELD = "next_page_token"
MORE_FIELDS = ["has_more", "has_next_page"]
INJECTED_TABLE_FIELDS = ("_catalog", "_schema")
INJECTED_CHILD_FIELD = "_endpoint_name"
TABLE_TYPE_MANAGED = "MANAGED"
TABLE_TYPE_EXTERNAL = "EXTERNAL"
