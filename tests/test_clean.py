import datetime as dt

import pandas as pd
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from cohortline.functions import columns as C
from cohortline.operators import clean
from cohortline.operators.panel import pivot_result, pivot_weeks, stack_pivots, wide_export
from cohortline.sources import tables as T
from tests.compare import TABLES, connect


def rows(df, *cols):
    return sorted(map(tuple, df.select(*cols).collect()), key=repr)


def test_numbers_are_read_tolerantly_and_rounded_half_even(spark):
    df = spark.createDataFrame([("2.5",), ("3.5",), ("n/a",), ("NaN",), (None,), ("7",)], "x string")
    got = [r.x for r in clean.coerce_numeric(df, {"x": "double", "absent": "long"}).collect()]
    assert got == [2.0, 4.0, None, None, None, 7.0]
    assert [r.x for r in clean.coerce_numeric(df, {"x": "long"}).collect()] == [2, 4, None, None, None, 7]


def test_dates_of_two_digit_years(spark):
    df = spark.createDataFrame([("1/5/21 00:00:00",), ("12/31/75 10:00:00",), ("junk",), (None,)], "d string")
    assert [r.d for r in C.parse_dates(df, ["d"]).collect()] == [dt.date(2021, 1, 5), dt.date(1975, 12, 31), None, None]


def test_text_cast_keeps_nulls(spark):
    df = spark.createDataFrame([(1,), (None,)], "a int")
    assert [r.a for r in C.cast_text(df, ["a"]).collect()] == ["1", None]


def test_measurements_are_cleaned(spark):
    df = spark.createDataFrame(
        [(1, "a", 4, "1/2/24 00:00:00", "10.5", "x", "3"), (2, "a", 6, "1/2/24 00:00:00", "1", "2", None)],
        "measurement_ID long, NR_Name string, week int, actual_date string, weight string, rbg string, pregnant_days string")
    out = clean.clean_measurements(df).collect()
    assert [tuple(r) for r in out] == [(1, "a", 4, dt.date(2024, 1, 2), 10.0, None, 3)]


def test_breeding_block(spark):
    names = [f"c{i}" for i in range(10)] + ["d0_date", "d0_count"] + [f"e{i}" for i in range(10)]
    df = spark.createDataFrame([tuple(["x"] * 10 + ["1/2/24 00:00:00", "4.5"] + [None] * 10), tuple(["x"] * 10 + [None] * 12)],
                               ", ".join(f"{n} string" for n in names))
    got = clean.litter_readings(clean.clean_breeding(df)).collect()
    assert len(got) == 1 and got[0].d0_count == 4 and got[0].d0_date == dt.date(2024, 1, 2)


def test_corrections_may_leave_the_grid(spark):
    df = spark.createDataFrame([(56277, 36), (56925, 12), (1, 4), (56035, 8)], "measurement_ID long, week int")
    fixed = clean.apply_corrections(df, clean.WEEK_CORRECTIONS, "measurement_ID", "week")
    kept = clean.drop_keys(fixed, clean.DELETED_MEASUREMENTS, "measurement_ID")
    assert rows(kept, "measurement_ID", "week") == [(1, 4), (56277, 38), (56925, 16)]


def test_pivot_refuses_duplicates(spark):
    df = spark.createDataFrame([("a", 4, 1.0), ("a", 4, 2.0), ("b", 8, 3.0)], "id string, week int, w double")
    with pytest.raises(Exception, match="duplicate week"):
        pivot_weeks(df, "id", [4, 8], {"w": "w"}).collect()
    assert clean.find_duplicates(df, ["id", "week"]).count() == 2
    assert pivot_weeks(df, "id", [4, 8], {"w": "w"}, strict=False).count() == 2


def test_pivots(spark):
    df = spark.createDataFrame([("a", 4, 1.0, "Rod"), ("a", 8, None, "Rab"), ("b", 8, 3.0, None)],
                               "id string, week int, w double, diet string")
    assert rows(pivot_weeks(df, "id", [4, 8], {"w": "w", "diet": "diet"}), "id", "w4", "w8", "diet4", "diet8") == [
        ("a", 1.0, None, "Rod", "Rab"), ("b", None, 3.0, None, None)]
    assert rows(stack_pivots(df, "id", [4, 8], ["w", "diet"]), "id", "measure", "w4", "w8") == [
        ("a", "diet", "Rod", "Rab"), ("a", "w", "1.0", None), ("b", "diet", None, None), ("b", "w", None, "3.0")]
    subjects = spark.createDataFrame([("a", "x"), ("b", "y")], "id string, birth_date string")
    out = wide_export(df, subjects, df.filter("id = 'a'").select("id").distinct(), "id", (4, 8), ("w",), ("birth_date",))
    assert rows(out, "id", "birth_date", "w4", "w8") == [("a", "x", 1.0, None)]


def test_gaps_of_a_curve(spark):
    df = spark.createDataFrame([(4, "a", 10.0), (8, "b", 20.0), (12, "a", 30.0)], "t int, g string, v double")
    assert rows(pivot_result(df, ["t"], "g", ["a", "b"], "v"), "t", "a", "b") == [(12, 30.0, 0.0), (4, 10.0, 0.0), (8, 0.0, 20.0)]
    carried = pivot_result(df, ["t"], "g", ["a", "b"], "v", carry_forward="t")
    assert rows(carried, "t", "a", "b") == [(12, 30.0, 20.0), (4, 10.0, 0.0), (8, 10.0, 20.0)]


def test_flags_of_missing_categories_are_false(spark):
    df = spark.createDataFrame([("Rod",), ("New",), (None,)], "d string")
    got = df.select(C.encode_flag("d", "Rod").alias("a"), C.encode_flag("d", "Rod", "New").alias("b"),
                    C.encode_map("d", {"Rod": 1}).alias("c")).collect()
    assert [tuple(r) for r in got] == [(True, True, 1), (False, True, None), (False, False, None)]


def test_csv_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(0, "a", 1.5), (1, None, None)], "row long, id string, x double")
    path = T.write_table(df, str(tmp_path / "t.csv"), "csv")
    assert rows(T.read_table(spark, path, df.schema, drop_index=True), "id", "x") == [("a", 1.5), (None, None)]
    assert rows(T.read_ids(spark, T.write_table(df.select("id"), str(tmp_path / "ids.csv"), "csv"), "id"), "id") == [("a",)]
    assert T.SUBJECT_SCHEMA.fieldNames()[:2] == ["NR_ID", "NR_Name"] and len(T.MEASUREMENT_SCHEMA) == 15


def test_tables_of_a_folder_and_of_the_catalog(spark, data):
    assert T.list_tables(spark, data).count() == 14
    spark.range(1).createOrReplaceTempView("some_view")
    assert ("some_view",) in rows(T.list_tables(spark), "table_name")


def test_min_observations_and_complete_weeks(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("b", 3.0)], "id string, x double")
    assert rows(clean.min_observations(df, "id", 2), "id", "x") == [("a", 1.0), ("a", 2.0)]
    assert rows(clean.complete_weeks(df, ["x"], {"x": 3}), "x") == [(1.0,), (2.0,)]
    assert C.week_class(F.lit(24)) is not None


def test_duplicates_of_null_keys(spark):
    df = spark.createDataFrame([(None, 1), (None, 1), ("a", None), ("a", None), ("a", 2), (None, None)], "k string, j int")
    assert clean.find_duplicates(df, ["k", "j"]).count() == 4


def test_largest_of_several_corrections(spark):
    df = spark.createDataFrame([(1, 5), (2, 6)], "id int, week int")
    fixes = spark.createDataFrame([(1, 8), (1, 12), (3, 4)], "id int, week int")
    assert sorted(map(tuple, clean.apply_corrections(df, fixes, "id", "week").collect())) == [(1, 12), (2, 6)]


def test_tables_of_a_folder(spark, tmp_path):
    for name in ("a.parquet", "b"):
        spark.range(10).repartition(3).write.parquet(f"{tmp_path}/{name}")
    spark.range(1).toPandas().to_parquet(f"{tmp_path}/c.parquet")
    assert sorted(r.table_name for r in T.list_tables(spark, str(tmp_path)).collect()) == ["a", "b", "c"]


def test_rows_of_each_table_of_a_folder_are_counted(spark, tmp_path):
    query = entry.queries()["s3_list_tables"]
    assert query(spark, str(tmp_path)).collect() == []
    spark.range(10).repartition(3).write.parquet(f"{tmp_path}/a.parquet")
    spark.range(7).selectExpr("id", "id % 2 AS k").write.partitionBy("k").parquet(f"{tmp_path}/b")
    spark.range(0).write.parquet(f"{tmp_path}/none.parquet")
    pd.DataFrame({"x": pd.to_datetime(["2020-01-01"] * 3).astype("datetime64[ns]")}).to_parquet(f"{tmp_path}/days.parquet")
    pd.DataFrame({"x": [1, 2], "X": [1, 2]}).to_parquet(f"{tmp_path}/x[1].parquet")
    pd.DataFrame({"x": [None] * 5}, dtype="float").to_parquet(f"{tmp_path}/x1.parquet")
    pd.DataFrame({"x": [1]}).to_parquet(f"{tmp_path}/two words %20.parquet")
    assert rows(query(spark, str(tmp_path)), "table_name", "n_rows") == [
        ("a", 10), ("b", 7), ("days", 3), ("none", 0), ("two words %20", 1), ("x1", 5), ("x[1]", 2)]


def test_rows_of_all_given_tables_are_counted_by_query_and_sql(spark, data):
    want = sorted((t, spark.read.parquet(f"{data}/{t}.parquet").count()) for t in TABLES)
    assert rows(entry.queries()["s3_list_tables"](spark, data), "table_name", "n_rows") == want
    assert sorted(connect(data).sql(entry.oracle_sql()["s3_list_tables"]).fetchall()) == want


def test_rows_of_tables_of_the_catalog_are_counted(spark):
    session = spark.newSession()
    session.range(4).createOrReplaceTempView("`four rows`")
    assert ("four rows", 4) in rows(T.count_tables(session), "table_name", "n_rows")


def test_wide_export_of_texts(spark, monkeypatch):
    from cohortline.operators import panel

    rows = [("a", 4, 1.0, "Rod"), ("a", 8, 2.0, None), ("b", 4, None, "Éa"), ("b", 8, 3.0, ""), ("c", 4, 4.0, "Rod")]
    df = spark.createDataFrame(rows, "id string, week int, w double, diet string")
    subjects = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3)], "id string, birth int")
    for most in (1000, 2):
        monkeypatch.setattr(panel, "CATEGORIES", most)
        out = wide_export(df, subjects, df.select("id").distinct(), "id", (4, 8), ("w", "diet"), ("birth",))
        assert sorted(map(tuple, out.collect())) == [("a", 1, 1.0, 2.0, "Rod", None), ("b", 2, None, 3.0, "Éa", ""), ("c", 3, 4.0, None, "Rod", None)]
        assert ("SortAggregate" in out._jdf.queryExecution().executedPlan().toString()) == (most == 2)
    none = df.filter("false")
    monkeypatch.setattr(panel, "CATEGORIES", 1000)
    assert wide_export(none, subjects, df.select("id"), "id", (4, 8), ("w", "diet"), ("birth",)).collect() == []
