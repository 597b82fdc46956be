"""A subject panel over the given tables, as DataFrames and as DuckDB text.

Subject = customer, reading = order value / 1000, weight = quantity ordered, 240 days = one step of
four weeks. Mothers and fathers are other customers; some are unknown.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortline.operators.onset import onset_table
from cohortline.operators.panel import pivot_weeks
from cohortline.session import materialize

START = "1995-01-01"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _day(c: str):
    return F.datediff(F.col(c).cast("date"), F.lit(START).cast("date"))


def raw_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per order: a subject can have several in one step."""
    week = (4 * (1 + F.floor(_day("o_orderdate") / 240.0))).cast("int")
    return table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("subject_id"), week.alias("week"), F.col("o_orderkey").alias("measurement_id"),
        "o_totalprice", "o_orderstatus")


def measurements(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("measurement_id")).agg(
        F.sum("l_quantity").alias("qty"))
    rows = raw_panel(spark, sf_dir).join(items, "measurement_id", "left")
    status = F.min("o_orderstatus")
    return rows.groupBy("subject_id", "week").agg(
        F.min("measurement_id").alias("measurement_id"), F.round(F.avg("o_totalprice") / 1000, 0).alias("rbg"),
        F.round(F.avg("qty"), 0).alias("weight"),
        F.when(status == "F", "Rod").when(status == "O", "Rab").otherwise("New").alias("diet"))


def subjects(spark: SparkSession, sf_dir: str) -> DataFrame:
    last = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(
        F.max(_day("o_orderdate")).alias("d"))
    k = F.col("c_custkey")
    maternal = F.when(k % 3 == 0, "Rab").otherwise("Rod")
    later = F.when(F.col("c_mktsegment") == "AUTOMOBILE", "New").otherwise("Rod")
    birth = F.lit(START).cast("date")
    died = F.date_add(birth, F.floor(F.col("d") * 7 / 60.0).cast("int"))
    return table(spark, sf_dir, "customer").join(last, "c_custkey", "left").select(
        k.alias("subject_id"), F.when(k % 2 == 0, "M").otherwise("F").alias("sex"),
        F.when(k % 11 == 0, None).when(k % 17 == 0, F.lit(-1).cast("long")).otherwise(F.floor(k / 4.0)).alias("mother"),
        F.when((k % 13 == 0) | (k == 45), None).otherwise(40 + F.floor(k / 8.0)).alias("father"),
        maternal.alias("gestational_diet"), maternal.alias("nursing_diet"),
        later.alias("weanling_diet"), later.alias("overall_diet"), birth.alias("birth_date"),
        F.when(F.col("c_acctbal") >= 0, died).alias("death_date"))


def onset(spark: SparkSession, sf_dir: str) -> DataFrame:
    return onset_table(subjects(spark, sf_dir), measurements(spark, sf_dir))


def panel(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Readings and onset table for queries that use both: readings are written once, not derived twice."""
    readings = materialize(measurements(spark, sf_dir))
    return readings, onset_table(subjects(spark, sf_dir), readings)


def stored_onset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The onset table written once, for queries that join it to itself."""
    return materialize(onset(spark, sf_dir))


def wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weight and reading at weeks 4, 8 and 12."""
    return pivot_weeks(measurements(spark, sf_dir), "subject_id", (4, 8, 12), {"weight": "wt", "rbg": "rbg"})


PANEL_SQL = """fx_qty AS (SELECT l_orderkey, SUM(l_quantity) AS qty FROM lineitem GROUP BY l_orderkey),
fx_raw AS (
  SELECT o_custkey AS subject_id, o_orderkey AS measurement_id, o_totalprice, o_orderstatus,
         4 * (1 + CAST(FLOOR(date_diff('day', DATE '1995-01-01', CAST(o_orderdate AS DATE)) / 240.0) AS INT)) AS week
  FROM orders),
fx_measurement AS (
  SELECT subject_id, week, MIN(measurement_id) AS measurement_id,
         ROUND(AVG(o_totalprice) / 1000, 0) AS rbg, ROUND(AVG(qty), 0) AS weight,
         CASE MIN(o_orderstatus) WHEN 'F' THEN 'Rod' WHEN 'O' THEN 'Rab' ELSE 'New' END AS diet
  FROM fx_raw LEFT JOIN fx_qty ON measurement_id = l_orderkey GROUP BY 1, 2),
fx_last AS (SELECT o_custkey, MAX(date_diff('day', DATE '1995-01-01', CAST(o_orderdate AS DATE))) AS d
  FROM orders GROUP BY o_custkey),
fx_main AS (
  SELECT c_custkey AS subject_id, CASE WHEN c_custkey % 2 = 0 THEN 'M' ELSE 'F' END AS sex,
         CASE WHEN c_custkey % 11 = 0 THEN NULL WHEN c_custkey % 17 = 0 THEN CAST(-1 AS BIGINT)
              ELSE CAST(FLOOR(c_custkey / 4.0) AS BIGINT) END AS mother,
         CASE WHEN c_custkey % 13 = 0 OR c_custkey = 45 THEN NULL
              ELSE CAST(40 + FLOOR(c_custkey / 8.0) AS BIGINT) END AS father,
         CASE WHEN c_custkey % 3 = 0 THEN 'Rab' ELSE 'Rod' END AS gestational_diet,
         CASE WHEN c_custkey % 3 = 0 THEN 'Rab' ELSE 'Rod' END AS nursing_diet,
         CASE WHEN c_mktsegment = 'AUTOMOBILE' THEN 'New' ELSE 'Rod' END AS weanling_diet,
         CASE WHEN c_mktsegment = 'AUTOMOBILE' THEN 'New' ELSE 'Rod' END AS overall_diet,
         DATE '1995-01-01' AS birth_date,
         CASE WHEN c_acctbal < 0 THEN NULL
              ELSE DATE '1995-01-01' + CAST(FLOOR(d * 7 / 60.0) AS INT) END AS death_date
  FROM customer LEFT JOIN fx_last ON o_custkey = c_custkey),
fx_cross AS (
  SELECT subject_id, MIN(CASE WHEN rbg > 100 THEN week END) AS r100, MIN(CASE WHEN rbg > 120 THEN week END) AS r120,
         MIN(CASE WHEN rbg > 200 THEN week END) AS r200, MIN(CASE WHEN rbg > 300 THEN week END) AS r300
  FROM fx_measurement GROUP BY subject_id),
fx_onset AS (
  SELECT a.*, COALESCE(r100, 80) AS rbg100, COALESCE(r120, 80) AS rbg120, COALESCE(r200, 80) AS rbg200,
         COALESCE(r300, 80) AS rbg300
  FROM fx_main a LEFT JOIN fx_cross USING (subject_id)),
fx_wide AS (
  SELECT subject_id, MAX(CASE WHEN week = 4 THEN weight END) AS wt4, MAX(CASE WHEN week = 8 THEN weight END) AS wt8,
         MAX(CASE WHEN week = 12 THEN weight END) AS wt12, MAX(CASE WHEN week = 4 THEN rbg END) AS rbg4,
         MAX(CASE WHEN week = 8 THEN rbg END) AS rbg8, MAX(CASE WHEN week = 12 THEN rbg END) AS rbg12
  FROM fx_measurement WHERE week IN (4, 8, 12) GROUP BY subject_id)"""
