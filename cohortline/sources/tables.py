"""Typed table sources and sinks."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed schemas of the exported study tables. Columns that need tolerant casts are read as text
# and typed afterwards by ``clean_subjects`` / ``clean_measurements`` / ``clean_breeding``.
SUBJECT_SCHEMA = T.StructType(
    [T.StructField("NR_ID", T.LongType())]
    + [T.StructField(c, T.StringType()) for c in (
        "NR_Name", "sex", "generation", "father", "mother", "foster", "gestational_diet",
        "nursing_diet", "weanling_diet", "majority_diet", "overall_diet", "birth_date", "death_date")]
    + [T.StructField("litter_size", T.IntegerType()), T.StructField("litter_order", T.IntegerType()),
       T.StructField("notes", T.StringType())])

MEASUREMENT_SCHEMA = T.StructType(
    [T.StructField("measurement_ID", T.LongType()), T.StructField("NR_Name", T.StringType()),
     T.StructField("week", T.IntegerType())]
    + [T.StructField(c, T.StringType()) for c in (
        "expected_date", "actual_date", "weight", "rbg", "weight percentile", "diet", "next_diet",
        "pregnant_days", "measurement_notes", "Plasma", "LN2", "RNAlater")])

# Ten columns on the litter, then the twelve of the litter readings, which are taken by position.
BREEDING_SCHEMA = T.StructType(
    [T.StructField("breeding_ID", T.LongType())]
    + [T.StructField(c, T.StringType()) for c in (
        "mother", "father", "mating_date", "pups_born", "weaned_date", "maternal_onset", "paternal_onset", "notes", "cage",
        *[f"d{day}_{what}" for day in (0, 7, 14, 21) for what in ("date", "count", "weight")])])


def read_table(spark: SparkSession, path: str, schema: T.StructType | None = None, fmt: str | None = None,
               drop_index: bool = False) -> DataFrame:
    """Read a CSV (with header) or Parquet table with a declared schema.

    ``drop_index`` drops the first column, the row id that an earlier CSV export wrote.
    Parquet columns are cast to the declared types, so a narrower file type is accepted.
    """
    fmt = fmt or ("csv" if ".csv" in path.rsplit("/", 1)[-1] else "parquet")
    if fmt == "csv":
        reader = spark.read.option("header", True).option("mode", "PERMISSIVE")
        df = (reader.schema(schema) if schema is not None else reader).csv(path)
    else:
        df = spark.read.format(fmt).load(path)
        if schema is not None:
            df = df.select(*[F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in schema.fields])
    return df.drop(df.columns[0]) if drop_index else df


def _tables(spark: SparkSession, source: str | None) -> list[tuple[str, str]]:
    """Name of each table with its path (folder) or full identifier (database)."""
    if source is not None and "/" in source:
        path = spark._jvm.org.apache.hadoop.fs.Path(source)
        entries = path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).listStatus(path)
        found = [(e.getPath().getName(), e.isDirectory(), e.getPath().toString()) for e in entries]
        return [(n.removesuffix(".parquet"), p) for n, folder, p in found
                if n[0] not in "._" and (n.endswith(".parquet") or folder and "." not in n)]
    return [(t.name, ".".join("`" + part.replace("`", "``") + "`" for part in (t.catalog, *(t.namespace or []), t.name) if part))
            for t in spark.catalog.listTables(source)]


def list_tables(spark: SparkSession, source: str | None = None) -> DataFrame:
    """Names of the tables of a database (catalog name) or of a folder of Parquet tables (path).

    In a folder, a table is a ``.parquet`` file, or a folder of part files with that ending or without one.
    """
    return spark.createDataFrame([(name,) for name, _ in _tables(spark, source)], "table_name string")


def count_tables(spark: SparkSession, source: str | None = None) -> DataFrame:
    """The tables of ``list_tables``, each with its number of rows. A folder of other files than Parquet fails."""
    counts = spark.createDataFrame([], "table_name string, n_rows long")
    for name, at in _tables(spark, source):
        if source is not None and "/" in source:
            # No column is needed, so none is declared, which also admits types and names that Spark does not read.
            rows = spark.read.schema(T.StructType([])).parquet(re.sub(r"([\\*?{}\[\]])", r"\\\1", at))  # no pattern
        else:
            rows = spark.table(at)
        counts = counts.unionByName(rows.agg(F.lit(name).alias("table_name"), F.count(F.lit(1)).alias("n_rows")))
    return counts


def read_ids(spark: SparkSession, path: str, name: str = "subject_id", dtype: str = "string") -> DataFrame:
    """A one-column CSV of ids as a distinct DataFrame, for a semi-join."""
    df = spark.read.option("header", True).csv(path)
    return df.select(F.col(f"`{df.columns[0]}`").cast(dtype).alias(name)).dropna().distinct()


def write_table(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite",
                partition_by: list[str] | None = None) -> str:
    """Write a result as CSV or Parquet and return the path."""
    writer = df.write.mode(mode)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    if fmt == "csv":
        writer = writer.option("header", True)
    writer.format(fmt).save(path)
    return path
