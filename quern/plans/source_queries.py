"""Queries that write given tables as the files the readers are for, and read them back."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import functions as F

from ..sources import io
from .registry import query
from .tables import cte, table


def _folder(spark, name: str) -> str:
    """A new folder in the shared one that the cluster names, or a local one where none is named."""
    top = spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
        top = "file://" + tempfile.mkdtemp(prefix="spark-quern-")
    return f"{top.rstrip('/')}/{name}-{uuid.uuid4().hex}"


@query("SELECT p_partkey, p_name, p_size, p_retailprice FROM part")
def csv_round_trip(spark, d):
    path = _folder(spark, "csv")
    rows = table(spark, d, "part").select("p_partkey", "p_name", "p_size", "p_retailprice")
    io.write_table(rows, path, "csv")
    return io.read_csv(spark, path, rows.schema)


@query("SELECT s_suppkey, s_acctbal FROM supplier UNION ALL SELECT s_suppkey, s_acctbal FROM supplier WHERE s_acctbal > 0")
def parquet_append(spark, d):
    path = _folder(spark, "append")
    rows = table(spark, d, "supplier").select("s_suppkey", "s_acctbal")
    io.write_table(rows, path)
    io.write_table(rows.where("s_acctbal > 0"), path, mode="append")
    return spark.read.schema(rows.schema).parquet(path)


@query("SELECT event_type AS act, cast(user_id % 4 AS double) / 2 AS t, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def tagged_files(spark, d):
    """Runs written to files named by act and temperature (0_5 for 0.5), read in one scan and tagged from the names."""
    path = _folder(spark, "tagged")
    rows = table(spark, d, "events").select(F.col("event_type").alias("a"), F.concat(F.lit("T"), F.translate(((F.col("user_id") % 4) / 2).cast("string"), ".", "_"), F.lit("K")).alias("k"), "event_id", "value")
    rows.write.partitionBy("a", "k").option("header", True).csv(path)
    rules = {"act": (r"a=([^/]+)/", "text"), "t": (r"k=T([0-9_p]+)K", "number")}
    tagged = io.read_tagged_files(spark, path, "event_id bigint, value double", rules, keep=r"a=", whole_path=True)
    return tagged.groupBy("act", "t").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))


@query("SELECT cast([2, 5, 10, 15][p_partkey % 4 + 1] AS int) AS t, cast(p_partkey AS double) AS temperature, cast(p_size AS double) AS field, p_retailprice AS moment FROM part")
def instrument_tables(spark, d):
    """Tables below 39 lines of preamble, files of at most 1,000 rows in folders named by temperature, read back without the column that is empty everywhere."""
    path = _folder(spark, "instrument")
    rows = table(spark, d, "part").withColumn("k", F.concat(F.lit("MvH"), F.array(*(F.lit(x) for x in (2, 5, 10, 15)))[(F.col("p_partkey") % 4).cast("int")].cast("string"), F.lit("K")))
    lines = rows.withColumn("line", F.concat_ws(",", F.col("p_partkey").cast("double"), F.lit(""), F.col("p_size").cast("double"), "p_retailprice"))
    head = F.lit("".join(f"preamble {i}\n" for i in range(39)) + "temperature,empty,field,moment\n")
    files = lines.groupBy("k", F.floor(F.col("p_partkey") / 1000).alias("part")).agg(F.concat(head, F.array_join(F.collect_list("line"), "\n")).alias("value"))
    files.repartition("k", "part").write.partitionBy("k", "part").text(path)
    return io.read_instrument(spark, path, "temperature double, empty double, field double, moment double", whole_path=True)


@query(f"""WITH {cte('fires')} SELECT sat_id, round(lat, 6) AS lat, round(lon, 6) AS lon, acq_date, sat_id AS satellite, confidence, cast(300 AS double) AS bright_t31, cast(fire_id AS double) AS frp, type FROM fires""")
def hotspots(spark, d):
    """Fire points written to a folder for each satellite and read as one table."""
    path = _folder(spark, "hotspots")
    fires = table(spark, d, "fires")
    rows = fires.select(F.concat(F.lit("fire_"), "sat_id", F.lit("_SV")).alias("sat"), F.col("lat").alias("LATITUDE"), F.col("lon").alias("LONGITUDE"), F.col("acq_date").alias("ACQ_DATE"), F.col("sat_id").alias("SATELLITE"), F.col("confidence").alias("CONFIDENCE"), F.lit(300.0).alias("BRIGHT_T31"), F.col("fire_id").cast("double").alias("FRP"), F.col("type").alias("TYPE"))
    rows.write.partitionBy("sat").option("header", True).csv(path)
    return io.read_hotspots(spark, path, name_pattern=r"/sat=fire_([A-Za-z0-9\-]+)_", whole_path=True).withColumns({"lat": F.round("lat", 6), "lon": F.round("lon", 6)})


@query("SELECT cast(n_nationkey AS int) AS NationID, n_name AS Nation FROM nation")
def lookup(spark, d):
    """A lookup table with a byte-order mark and blanks around names and values."""
    path = _folder(spark, "lookup")
    rows = table(spark, d, "nation").select(F.col("n_nationkey").cast("string").alias("\ufeffNationID "), F.concat(F.lit("  "), "n_name", F.lit(" ")).alias(" Nation"))
    io.write_table(rows.coalesce(1), path, "csv", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    return io.read_lookup(spark, path)


def _rounded(c: str):
    """A number rounded to a whole one, as text as the SQL has it: with the sign of a negative zero, without an exponent below 1e16; nothing where it is missing."""
    size, sign = F.round(F.abs(c)), F.when(F.col(c).cast("string").startswith("-"), "-").otherwise("")
    plain = F.when(size < 1e16, size.cast("decimal(17,1)").cast("string"))
    other = F.when(F.isnan(size), "nan").when(size == float("inf"), "inf").otherwise(F.regexp_replace(size.cast("string"), r"(\.0)?E", "e+"))
    return F.when(F.col(c).isNull(), "").otherwise(F.concat(sign, F.coalesce(plain, other)))


@query("""SELECT s_name AS "table", concat('nation ', s_nationkey) AS universe, concat('balance ', round(s_acctbal)) AS description FROM supplier""")
def table_metadata(spark, d):
    """Survey metadata: files that are arrays of at most 1,000 objects."""
    path = _folder(spark, "metadata")
    one = F.struct(F.col("s_name").alias("name"), F.concat(F.lit("nation "), F.coalesce(F.col("s_nationkey").cast("string"), F.lit(""))).alias("universe"), F.concat(F.lit("balance "), _rounded("s_acctbal")).alias("description"), F.lit("v.html").alias("variables"))
    arrays = table(spark, d, "supplier").groupBy(F.floor(F.col("s_suppkey") / 1000).alias("part")).agg(F.to_json(F.collect_list(one)).alias("value"))
    arrays.repartition("part").write.partitionBy("part").text(path)
    return io.read_table_metadata(spark, path).select("table", "universe", "description")
