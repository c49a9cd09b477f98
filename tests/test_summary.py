from stocktake.operators.summary import build_summary, grand_totals, merge_counts


def test_summary_categories(spark):
    counts = spark.createDataFrame([("job", 3), ("uc_tables", 7), ("dbfs_mount_points", 1), ("mystery", 2)],
                                   "key string, count long")
    got = {(r["Category"], r["Object"]): (r["Count"], r["To_be_Migrated"])
           for r in build_summary(counts).collect()}
    assert got == {("Auto", "Job"): (3, "Y"), ("Metastore", "UC Tables"): (7, "Y"),
                   ("DBFS/Mounts", "Mount Points"): (1, "Y"), ("Other", "mystery"): (2, "Y")}


def test_merge_counts_right_wins(spark):
    a = spark.createDataFrame([("x", 1), ("y", 2)], "key string, count long")
    b = spark.createDataFrame([("y", 5), ("z", 6)], "key string, count long")
    assert {r["key"]: r["count"] for r in merge_counts(a, b).collect()} == {"x": 1, "y": 5, "z": 6}


def test_grand_totals_cover_every_dataset(spark):
    counts = spark.createDataFrame([("job", 3), ("repo", 0), ("dbfs_mount_points", 2), ("uc_catalogs", 4), ("uc_schemas", 5),
                                    ("uc_tables", 0), ("managed_tables", 0)], "key string, count long")
    r = grand_totals(counts).first()
    assert (r["object_types"], r["total_records"]) == (4, 10)
    r = grand_totals(counts.limit(0)).first()
    assert (r["object_types"], r["total_records"]) == (0, 0)
