"""Readers of delimited files, instrument tables, lookups and metadata; writers of tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import written

#: Splits with a preamble that are sent to all tasks; more are joined by a shuffle.
MOST_HEADS = 100_000


def read_csv(spark: SparkSession, path: str | Sequence[str], schema: T.StructType | str, sep: str = ",", encoding: str = "UTF-8") -> DataFrame:
    """A delimited file with a header, by an explicit schema; dirty columns are best read as text. A header that differs from the schema fails."""
    return spark.read.schema(schema).options(header=True, sep=sep, encoding=encoding, enforceSchema=False).csv(path)


def name_number(text: Column) -> Column:
    """A number as file names write it: 0_5 and 0p5 are 0.5."""
    return F.regexp_replace(text, "[_p]", ".").try_cast("double")


def _named(reader, whole_path: bool):
    return reader.option("recursiveFileLookup", True) if whole_path else reader


def _name(whole_path: bool) -> Column:
    return F.col("_metadata.file_path" if whole_path else "_metadata.file_name")


def read_tagged_files(spark: SparkSession, path: str, schema: T.StructType | str, rules: Mapping[str, tuple[str, str]], keep: str | None = None, geometry: DataFrame | None = None, on: str = "act", whole_path: bool = False) -> DataFrame:
    """All files of a path, each row tagged with values from its file's name, or, with `whole_path`, from its path in folders below it too.

    rules: column -> (pattern with one group, 'number' or 'text'). `keep`: files whose name does not match this pattern are left out. A kept name that a rule does not
    match fails. `geometry` is a small table joined on `on`. Files are read in one scan, not one by one.
    """
    df = _named(spark.read.schema(schema).options(header=True, enforceSchema=False), whole_path).csv(path).withColumn("file_name", _name(whole_path))
    if keep:
        df = df.where(F.col("file_name").rlike(keep))
    for name, (pattern, kind) in rules.items():
        found = F.regexp_extract("file_name", pattern, 1)
        value = name_number(found) if kind == "number" else F.when(found != "", found)
        df = df.withColumn(name, F.when(value.isNull(), F.raise_error(F.concat(F.lit(f"no {name} in file name "), F.col("file_name")))).otherwise(value))
    return df.join(geometry, on, "left") if geometry is not None else df


def read_instrument(spark: SparkSession, path: str, schema: str, skip: int = 39, name_pattern: str = r"MvH(\d+)K", tag: str = "t", whole_path: bool = False) -> DataFrame:
    """Comma-separated tables below a preamble of `skip` lines and a header line; columns empty in all files are dropped; `tag` is a whole number of the file's name.

    Files are read in splits, a line a row. Lines are counted by file and split; only splits in which a preamble can stand, the first of a file and those before which it has not more than `skip`
    lines, have their lines numbered. Empty columns are found when this is called, by one count over all rows.
    """
    place = [F.col("_metadata.file_path").alias("__file"), F.col("_metadata.file_block_start").alias("__block")]
    lines = _named(spark.read, whole_path).text(path).select("value", _name(whole_path).alias("file_name"), *place)
    counts = lines.groupBy("__file", "__block").agg(F.count(F.lit(1)).alias("__n"))
    before = F.sum("__n").over(Window.partitionBy("__file").orderBy("__block")) - F.col("__n")
    heads = written(counts.select("__file", "__block", before.alias("__before")).where(F.col("__before") <= skip), "heads")
    heads = F.broadcast(heads) if heads.count() <= MOST_HEADS else heads
    ordered = lines.withColumn("__id", F.monotonically_increasing_id())  # ascends with the lines of a split
    at = F.row_number().over(Window.partitionBy("__file", "__block").orderBy("__id")) + F.col("__before") - 1
    first = ordered.join(heads, ["__file", "__block"]).withColumn("__at", at).where(F.col("__at") > skip).select("value", "file_name")
    rest = lines.join(heads, ["__file", "__block"], "left_anti").select("value", "file_name")
    kept = first.unionByName(rest).where(F.trim("value") != "")
    rows = kept.select(F.regexp_extract("file_name", name_pattern, 1).try_cast("int").alias(tag), F.from_csv("value", schema).alias("row")).select(tag, "row.*")
    filled = rows.agg(*(F.count(c).alias(c) for c in rows.columns)).first()
    return rows.drop(*(c for c in rows.columns if not filled[c]))


# Columns of hotspot files that are kept.
HOTSPOT_COLUMNS = "LATITUDE double, LONGITUDE double, ACQ_DATE string, SATELLITE string, CONFIDENCE string, BRIGHT_T31 double, FRP double, TYPE int"


def read_hotspots(spark: SparkSession, path: str | Sequence[str], schema: str = HOTSPOT_COLUMNS, name_pattern: str = r"^(?:fire_)?([A-Za-z0-9\-]+)_", whole_path: bool = False) -> DataFrame:
    """Fire points of several satellites as one table, with sat_id from the file's name and the date as a date."""
    df = _named(spark.read.schema(schema).options(header=True, enforceSchema=False), whole_path).csv(path).withColumn("sat_id", F.regexp_extract(_name(whole_path), name_pattern, 1))
    return df.select("sat_id", F.col("LATITUDE").alias("lat"), F.col("LONGITUDE").alias("lon"), F.to_date("ACQ_DATE").alias("acq_date"), F.col("SATELLITE").alias("satellite"), F.col("CONFIDENCE").alias("confidence"), F.col("BRIGHT_T31").alias("bright_t31"), F.col("FRP").alias("frp"), F.col("TYPE").alias("type"))


def read_lookup(spark: SparkSession, path: str) -> DataFrame:
    """A small lookup table: byte-order mark taken off the first header, names and values trimmed, the first column as whole numbers where all are."""
    df = spark.read.options(header=True).csv(path)  # read as text
    df = df.toDF(*(c.replace("﻿", "").strip() for c in df.columns))
    df = df.select(*(F.trim(c).alias(c) for c in df.columns))
    first = df.columns[0]
    whole = df.where(F.col(first).isNotNull() & F.col(first).try_cast("int").isNull()).isEmpty()
    return df.withColumn(first, F.col(first).cast("int")) if whole else df


def read_table_metadata(spark: SparkSession, path: str) -> DataFrame:
    """Rows (table, universe, description) of survey metadata: an array of objects with name, universe, description and other keys that go."""
    df = spark.read.schema("name string, universe string, description string").option("multiLine", True).json(path)
    return df.select(F.col("name").alias("table"), "universe", "description")


def write_table(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "error", partition_by: Sequence[str] = (), **options: object) -> None:
    """Writes a table as Parquet, CSV (with header), JSON, ORC, or over JDBC (path is the URL, the table an option)."""
    writer = df.write.mode(mode).options(**{k: str(v) for k, v in options.items()})
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    if fmt == "jdbc":
        writer.format("jdbc").option("url", path).save()
    elif fmt == "csv":
        writer.option("header", True).csv(path)
    else:
        writer.format(fmt).save(path)
