from pyspark.sql import functions as F

from stocktake.functions.names import display_name, safe_column_names, table_name


def test_clean_and_dedup(spark):
    names = ["A.B", "a b", "x[0].y", "__z__", "K:V=1", "(){};", "it's \"q\"", "tab\there"]
    assert safe_column_names(spark, names) == ["a_b", "a_b__1", "x_0_y", "z", "k_v_1", "_blank", "it_s_q",
                                               "tab_here"]


def test_display_name(spark):
    df = spark.createDataFrame([("vector_search_index",), ("p_sql_alerts",)], "k string")
    assert [r[0] for r in df.select(display_name(F.col("k"))).collect()] == ["Vector Search Index", "P Sql Alerts"]
    assert [r[0] for r in df.select(display_name(F.col("k"), "p_")).collect()] == ["Vector Search Index",
                                                                                    "Sql Alerts"]


def test_table_name():
    assert table_name("c", "s", "job") == "`c`.`s`.`raw_job`"
    assert table_name(None, "s", "we`ird") == "`s`.`raw_we``ird`"
