"""Sources, projections, filters."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortline.catalog.registry import query
from cohortline.catalog.views import measurements, onset, raw_panel, subjects, table, wide
from cohortline.functions import columns as C
from cohortline.operators import clean, onset as O
from cohortline.plans.joint import index_categories
from cohortline.session import scratch_path
from cohortline.sources.tables import count_tables, list_tables, read_ids, read_table, write_table

CUSTOMER = T.StructType([
    T.StructField("c_custkey", T.LongType()), T.StructField("c_name", T.StringType()),
    T.StructField("c_nationkey", T.LongType()), T.StructField("c_acctbal", T.DoubleType())])


@query("s1_read_table", "SELECT c_custkey, c_name, CAST(c_nationkey AS BIGINT) AS c_nationkey, c_acctbal FROM customer")
def s1(spark, d):
    return read_table(spark, f"{d}/customer.parquet", CUSTOMER)


@query("s2_reread_csv", "SELECT subject_id, sex, mother, birth_date, death_date, rbg200 FROM fx_onset")
def s2(spark, d):
    cols = ("subject_id", "sex", "mother", "birth_date", "death_date", "rbg200")
    rows = onset(spark, d).select(F.col("subject_id").alias("row_id"), *cols)
    path = write_table(rows, scratch_path(spark, "onset.csv"), "csv")
    return read_table(spark, path, rows.schema, drop_index=True)


_TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages",
           "benchmark", "labels", "conversations")


@query("s3_list_tables", " UNION ALL ".join(f"SELECT '{t}' AS table_name, COUNT(*) AS n_rows FROM {t}" for t in _TABLES))
def s3(spark, d):
    return count_tables(spark, d)


@query("s3_list_written_tables", "SELECT 'nation' AS table_name, COUNT(*) AS n FROM nation UNION ALL SELECT 'region', COUNT(*) FROM region")
def s3b(spark, d):
    folder = scratch_path(spark, "source")
    rows = None
    for name, path in (("nation", "nation.parquet"), ("region", "region")):  # tables as folders of several part files
        write_table(table(spark, d, name).repartition(3), f"{folder}/{path}")
        n = spark.read.parquet(f"{folder}/{path}").agg(F.lit(name).alias("table_name"), F.count(F.lit(1)).alias("n"))
        rows = n if rows is None else rows.unionByName(n)
    return list_tables(spark, folder).join(rows, "table_name")


@query("s4_read_ids", """
SELECT m.* FROM fx_measurement m WHERE subject_id IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')""")
def s4(spark, d):
    ids = table(spark, d, "customer").filter("c_mktsegment = 'BUILDING'").select("c_custkey")
    path = write_table(ids, scratch_path(spark, "ids.csv"), "csv")
    return clean.keep_ids(measurements(spark, d), read_ids(spark, path, "subject_id", "long"), "subject_id")


@query("s5_write_table", """
SELECT sex, COUNT(*) AS n, CAST(SUM(rbg200) AS BIGINT) AS weeks FROM fx_onset GROUP BY sex""")
def s5(spark, d):
    path = write_table(onset(spark, d), scratch_path(spark, "onset"), "parquet", partition_by=["sex"])
    return spark.read.parquet(path).groupBy("sex").agg(F.count(F.lit(1)).alias("n"), F.sum("rbg200").alias("weeks"))


@query("p1_coerce_numeric", """
SELECT l_orderkey, l_linenumber,
       CASE WHEN l_returnflag = 'R' THEN NULL ELSE round_even(l_quantity / 2, 0) END AS half,
       CASE WHEN l_linestatus = 'O' THEN NULL ELSE CAST(round_even(l_extendedprice, 0) AS BIGINT) END AS price
FROM lineitem""")
def p1(spark, d):
    text = table(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber",
        F.when(F.col("l_returnflag") == "R", "n/a").otherwise((F.col("l_quantity") / 2).cast("string")).alias("half"),
        F.when(F.col("l_linestatus") == "O", "NaN").otherwise(F.col("l_extendedprice").cast("string")).alias("price"))
    return clean.coerce_numeric(text, {"half": "double", "price": "long"})


@query("p2_parse_dates", """
SELECT o_orderkey, CASE WHEN o_orderpriority = '5-LOW' THEN NULL ELSE CAST(o_orderdate AS DATE) END AS day FROM orders""")
def p2(spark, d):
    text = F.when(F.col("o_orderpriority") == "5-LOW", "unknown").otherwise(F.date_format("o_orderdate", "M/d/yy H:mm:ss"))
    return C.parse_dates(table(spark, d, "orders").select("o_orderkey", text.alias("day")), ["day"])


@query("p3_parse_iso_dates", "SELECT o_orderkey, CAST(o_orderdate AS DATE) AS day FROM orders")
def p3(spark, d):
    text = F.date_format("o_orderdate", "yyyy-MM-dd").alias("day")
    return C.parse_dates(table(spark, d, "orders").select("o_orderkey", text), ["day"], "yyyy-MM-dd")


@query("p4_cast_text", "SELECT subject_id, CAST(mother AS VARCHAR) AS mother, CAST(father AS VARCHAR) AS father FROM fx_main")
def p4(spark, d):
    return C.cast_text(subjects(spark, d).select("subject_id", "mother", "father"), ["mother", "father"])


@query("p5_select_reorder", "SELECT diet, week, subject_id, rbg FROM fx_measurement")
def p5(spark, d):
    return measurements(spark, d).select("diet", "week", "subject_id", "rbg")


@query("p6_slice_columns", """
SELECT wt8, wt12, rbg4 FROM fx_wide WHERE wt8 IS NOT NULL OR wt12 IS NOT NULL OR rbg4 IS NOT NULL""")
def p6(spark, d):
    return C.slice_columns(wide(spark, d), 2, 5).dropna("all")


@query("p7_apply_corrections", """
SELECT m.subject_id, m.measurement_id, CASE WHEN o.o_orderkey IS NULL THEN m.week ELSE 38 END AS week
FROM fx_measurement m LEFT JOIN (SELECT o_orderkey FROM orders WHERE o_orderpriority = '1-URGENT') o
ON o.o_orderkey = m.measurement_id""")
def p7(spark, d):
    fixes = table(spark, d, "orders").filter("o_orderpriority = '1-URGENT'").select(
        F.col("o_orderkey").alias("measurement_id"), F.lit(38).alias("week"))
    rows = measurements(spark, d).select("subject_id", "measurement_id", "week")
    return clean.apply_corrections(rows, fixes, "measurement_id", "week")


@query("p7_repeated_corrections", """
SELECT o_orderkey, COALESCE(fix, CAST(o_custkey AS BIGINT)) AS o_custkey
FROM orders LEFT JOIN (SELECT l_orderkey, MAX(l_suppkey) AS fix FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1) ON l_orderkey = o_orderkey""")
def p7b(spark, d):
    fixes = table(spark, d, "lineitem").filter("l_returnflag = 'R'").select(
        F.col("l_orderkey").alias("o_orderkey"), F.col("l_suppkey").alias("o_custkey"))
    return clean.apply_corrections(table(spark, d, "orders").select("o_orderkey", "o_custkey"), fixes, "o_orderkey", "o_custkey")


@query("p8_drop_keys", """
SELECT * FROM fx_measurement WHERE measurement_id NOT IN (SELECT o_orderkey FROM orders WHERE o_orderpriority = '2-HIGH')""")
def p8(spark, d):
    ids = table(spark, d, "orders").filter("o_orderpriority = '2-HIGH'").select(F.col("o_orderkey").alias("measurement_id"))
    return clean.drop_keys(measurements(spark, d), ids, "measurement_id")


@query("p9_find_duplicates", """
SELECT subject_id, week, measurement_id FROM (
  SELECT *, COUNT(*) OVER (PARTITION BY subject_id, week) AS n FROM fx_raw) WHERE n > 1""")
def p9(spark, d):
    return clean.find_duplicates(raw_panel(spark, d).select("subject_id", "week", "measurement_id"), ["subject_id", "week"])


@query("p9_duplicates_null_keys", """
SELECT subject_id, mother, father FROM (SELECT *, COUNT(*) OVER (PARTITION BY mother, father) AS n FROM fx_main) WHERE n > 1""")
def p9b(spark, d):
    return clean.find_duplicates(subjects(spark, d).select("subject_id", "mother", "father"), ["mother", "father"])


@query("p10_fill_constant", "SELECT subject_id, week, COALESCE(weight, 80) AS weight FROM fx_measurement")
def p10(spark, d):
    return measurements(spark, d).select("subject_id", "week", "weight").fillna(80.0, ["weight"])


@query("p11_dropna_any", """
SELECT * FROM fx_wide WHERE wt4 IS NOT NULL AND wt8 IS NOT NULL AND wt12 IS NOT NULL
AND rbg4 IS NOT NULL AND rbg8 IS NOT NULL AND rbg12 IS NOT NULL""")
def p11(spark, d):
    return wide(spark, d).dropna("any")


@query("p11_dropna_subset", "SELECT * FROM fx_wide WHERE wt4 IS NOT NULL AND wt8 IS NOT NULL")
def p11b(spark, d):
    return wide(spark, d).dropna(subset=["wt4", "wt8"])


@query("p12_censor", "SELECT subject_id, CASE WHEN rbg300 <= 20 THEN rbg300 ELSE 80 END AS rbg300 FROM fx_onset")
def p12(spark, d):
    return onset(spark, d).select("subject_id", C.censor("rbg300", 20).alias("rbg300"))


@query("p13_replace", "SELECT subject_id, CASE WHEN rbg300 = 80 THEN 40 ELSE rbg300 END AS duration FROM fx_onset")
def p13(spark, d):
    return onset(spark, d).select("subject_id", F.col("rbg300").alias("duration")).replace(80, 40, ["duration"])


@query("p14_encode_flag", """
SELECT subject_id, sex = 'M' AS male, gestational_diet = 'Rab' AS gestational_diet, nursing_diet = 'Rab' AS nursing_diet
FROM fx_main""")
def p14(spark, d):
    return subjects(spark, d).select(
        "subject_id", C.encode_flag("sex", "M").alias("male"),
        *[C.encode_flag(c, "Rab").alias(c) for c in ("gestational_diet", "nursing_diet")])


@query("p15_encode_member", """
SELECT subject_id, weanling_diet IN ('Rod', 'New') AS weanling_diet, nursing_diet IN ('Rod', 'New') AS nursing_diet
FROM fx_main""")
def p15(spark, d):
    return subjects(spark, d).select(
        "subject_id", *[C.encode_flag(c, "Rod", "New").alias(c) for c in ("weanling_diet", "nursing_diet")])


@query("p16_encode_map", "SELECT subject_id, CASE nursing_diet WHEN 'Rab' THEN 1 WHEN 'Rod' THEN 0 END AS diet FROM fx_main")
def p16(spark, d):
    return subjects(spark, d).select("subject_id", C.encode_map("nursing_diet", {"Rab": 1, "Rod": 0}).alias("diet"))


@query("p17_index_categories", """
WITH lv AS (SELECT diet, ROW_NUMBER() OVER (ORDER BY diet) - 1 AS code FROM (SELECT DISTINCT diet FROM fx_measurement))
SELECT subject_id, CAST(code AS DOUBLE) AS nursing_diet FROM fx_main JOIN lv ON diet = nursing_diet""")
def p17(spark, d):
    reference = measurements(spark, d).select(F.col("diet").alias("nursing_diet"))
    return index_categories(reference, [subjects(spark, d).select("subject_id", "nursing_diet")], "nursing_diet")[0]


@query("p18_week_class", """
SELECT subject_id, CASE WHEN rbg300 <= 24 THEN 0 WHEN rbg300 <= 40 THEN 1 ELSE 2 END AS class FROM fx_onset""")
def p18(spark, d):
    return onset(spark, d).select("subject_id", C.week_class("rbg300").alias("class"))


@query("p19_derived_columns", """
SELECT subject_id, wt8 - wt4 AS diff48, ROUND((wt8 - wt4) / NULLIF(wt8, 0) * 100, 6) AS growth, 100 - rbg4 AS rest
FROM fx_wide""")
def p19(spark, d):
    diff = F.col("wt8") - F.col("wt4")
    return wide(spark, d).select("subject_id", diff.alias("diff48"), (F.try_divide(diff, "wt8") * 100).alias("growth"),
                                 (100 - F.col("rbg4")).alias("rest"))


@query("p20_constant_column", "SELECT subject_id, sex, 'Rod' AS nursing FROM fx_main WHERE nursing_diet = 'Rod'")
def p20(spark, d):
    return subjects(spark, d).filter("nursing_diet = 'Rod'").select("subject_id", "sex", F.lit("Rod").alias("nursing"))


@query("p21_rename_columns", "SELECT subject_id AS id, wt4 AS weight_4, wt8 AS weight_8 FROM fx_wide")
def p21(spark, d):
    return wide(spark, d).drop("wt12", "rbg4", "rbg8", "rbg12").withColumnsRenamed(
        {"subject_id": "id"} | {f"wt{w}": f"weight_{w}" for w in (4, 8)})


@query("f1_week_grid", "SELECT * FROM fx_measurement WHERE week % 8 = 0")
def f1(spark, d):
    return clean.on_grid(measurements(spark, d), 8)


@query("f2_range_filters", "SELECT * FROM fx_measurement WHERE week <= 12 AND week IN (4, 8, 12) AND rbg > 100 AND diet <> 'New'")
def f2(spark, d):
    week = F.col("week")
    return measurements(spark, d).filter((week <= 12) & week.isin(4, 8, 12) & (F.col("rbg") > 100) & (F.col("diet") != "New"))


@query("f3_diet_cohort", """
SELECT subject_id, sex FROM fx_onset WHERE overall_diet = 'Rod' AND weanling_diet = 'Rod' AND nursing_diet = 'Rab'
AND gestational_diet = 'Rab'""")
def f3(spark, d):
    kept = O.cohort(onset(spark, d), overall_diet="Rod", weanling_diet="Rod", nursing_diet="Rab", gestational_diet="Rab")
    return kept.select("subject_id", "sex")


@query("f4_lived_at_least", """
SELECT subject_id, COALESCE(date_diff('day', birth_date, death_date) >= 280, FALSE) AS lived FROM fx_main""")
def f4(spark, d):
    return subjects(spark, d).select("subject_id", C.lived_at_least(280).alias("lived"))


@query("f5_onset_groups", """
WITH a AS (SELECT *, CASE sex WHEN 'M' THEN 4 ELSE 8 END AS cut FROM fx_onset)
SELECT subject_id, sex, CASE WHEN rbg200 <= cut THEN 'onset' ELSE 'no onset' END AS onset_group FROM a
WHERE rbg200 <= cut OR date_diff('day', birth_date, death_date) >= 7 * cut""")
def f5(spark, d):
    return O.onset_groups(onset(spark, d), {"M": 4, "F": 8}).select("subject_id", "sex", "onset_group")


@query("f6_eligible_strict", """
WITH a AS (SELECT *, CASE sex WHEN 'M' THEN 16 ELSE 36 END AS cut FROM fx_onset)
SELECT subject_id FROM a WHERE rbg300 <= cut OR date_diff('day', birth_date, death_date) >= 7 * cut""")
def f6(spark, d):
    return O.eligible(onset(spark, d), {"M": 16, "F": 36}, "rbg300").select("subject_id")


@query("f6_eligible_recorded", """
WITH a AS (SELECT *, CASE sex WHEN 'M' THEN 16 ELSE 36 END AS cut FROM fx_onset)
SELECT subject_id FROM a WHERE rbg300 > 0 OR date_diff('day', birth_date, death_date) >= 7 * cut""")
def f6b(spark, d):
    return O.eligible(onset(spark, d), {"M": 16, "F": 36}, "rbg300", strict=False).select("subject_id")


@query("f7_exclude_early", "SELECT * FROM fx_wide WHERE rbg8 < 200")
def f7(spark, d):
    return wide(spark, d).filter(F.col("rbg8") < 200)


@query("f8_min_observations", """
SELECT * FROM fx_measurement WHERE subject_id IN (SELECT subject_id FROM fx_measurement GROUP BY 1 HAVING COUNT(*) >= 6)""")
def f8(spark, d):
    return clean.min_observations(measurements(spark, d), "subject_id", 6)


@query("f9_onset_at_week", "SELECT gestational_diet, COUNT(*) AS n FROM fx_onset WHERE rbg200 = 8 GROUP BY 1")
def f9(spark, d):
    return O.onset_counts_by(onset(spark, d), 8, "gestational_diet")


@query("f10_complete_weeks", "SELECT * FROM fx_wide WHERE wt4 > 0 AND wt8 > 0 AND rbg4 > 0 AND rbg8 > 0 AND rbg8 < 200")
def f10(spark, d):
    return clean.complete_weeks(wide(spark, d), ["wt4", "wt8", "rbg4", "rbg8"], {"rbg8": 200})
