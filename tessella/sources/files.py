"""Readers and writers of files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SEED = "id string, vector array<float>, payload map<string,string>"


def read_seed(spark: SparkSession, path: str, schema: str = SEED) -> DataFrame:
    """JSON lines of points; lines that aren't JSON are left out."""
    rows = spark.read.schema(schema + ", _bad string").option("columnNameOfCorruptRecord", "_bad").option("mode", "PERMISSIVE").json(path)
    return rows.where("_bad is null").drop("_bad")


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """(url, doc_type, skip_sections, user_agent, max_chunks, estimate, force_delete): the items of a batch manifest."""
    schema = "items array<struct<url string, doc_type string, skip_sections array<string>, user_agent string>>, max_chunks int, estimate boolean, force_delete boolean"
    one = spark.read.schema(schema).option("multiLine", "true").json(path)
    return one.select(F.explode("items").alias("i"), "max_chunks", "estimate", "force_delete").select("i.*", "max_chunks", "estimate", "force_delete")


def list_files(spark: SparkSession, folder: str, pattern: str = "*.pdf") -> DataFrame:
    """(path, name, size) of the folder's files, contents unread."""
    rows = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder)
    return rows.select("path", F.element_at(F.split("path", "/"), -1).alias("name"), F.col("length").alias("size"))


def seed_table(spark: SparkSession, path: str, table_path: str, fallback_dim: int = 1536) -> int:
    """Read a seed and write it as a new table, replacing what was there; the dimension, which is that of the first
    line's vector, else fallback_dim.  Fails where the file has no line that can be read."""
    rows = read_seed(spark, path)
    first = rows.select("vector").first()
    if first is None:
        raise ValueError(f"no data in {path}")
    rows.write.mode("overwrite").parquet(table_path)
    return len(first["vector"] or ()) or fallback_dim


def read_base64(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select("path", F.base64("content").alias("content"))


def read_shared(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """As read_base64, of a file of the folder; a name with a path in it is refused."""
    if not name or name in (".", "..") or "/" in name or "\\" in name or any(c in name for c in "*?[]{}"):
        raise ValueError("the name cannot contain path components or patterns")
    return read_base64(spark, f"{folder.rstrip('/')}/{name}")


def read_places(spark: SparkSession, path: str) -> DataFrame:
    """(name, ident, iata_code, type, lat, lng, scheduled_service, iso_region, iso_country, municipality, elevation_ft) of
    a JSON or CSV file, whose coordinates are lat and lng or latitude_deg and longitude_deg; rows without coordinates drop
    out."""
    texts = ("name", "ident", "iata_code", "type", "scheduled_service", "iso_region", "iso_country", "municipality", "elevation_ft")
    numbers = ("lat", "lng", "latitude_deg", "longitude_deg")
    if path.endswith((".json", ".jsonl")):
        rows = spark.read.schema(", ".join(f"{c} string" for c in (*texts, *numbers))).json(path)
    else:
        rows = spark.read.option("header", "true").csv(path)
        rows = rows.select(*(F.col(c) if c in rows.columns else F.lit(None).cast("string").alias(c) for c in (*texts, *numbers)))
    ok = F.lower(F.coalesce("scheduled_service", F.lit("no"))).isin("yes", "true", "1")
    at = lambda a, b: F.coalesce(F.col(a).try_cast("double"), F.col(b).try_cast("double"))
    out = rows.select("name", "ident", "iata_code", "type", at("lat", "latitude_deg").alias("lat"), at("lng", "longitude_deg").alias("lng"), ok.alias("scheduled_service"), "iso_region", "iso_country", "municipality", F.col("elevation_ft").try_cast("int").alias("elevation_ft"))
    return out.where("lat is not null and lng is not null")


def progress_lines(items: DataFrame, order: str = "pos") -> DataFrame:
    """The lines of a batch's report: for each item, in order, its url, status and share done, then a summary.  items: pos,
    url, status, chunks, tokens.  A batch is one manifest, so its items are few; line is its place."""
    n, w = Window.partitionBy(), Window.orderBy(order)
    done = items.withColumns({"_n": F.count(F.lit(1)).over(n), "_k": F.row_number().over(w)})
    line = F.to_json(F.struct(F.lit("item").alias("event"), "url", "status", F.round(100.0 * F.col("_k") / F.col("_n"), 1).alias("percent")))
    last = items.agg(F.count(F.lit(1)).alias("items"), F.count_if(F.col("status") == "ok").alias("success"), F.count_if(F.coalesce(F.col("status"), F.lit("")) != "ok").alias("failed"), F.coalesce(F.sum("chunks"), F.lit(0)).alias("chunks"), F.coalesce(F.sum("tokens"), F.lit(0)).alias("tokens"))
    summary = last.select((F.col("items") + 1).alias("line"), F.to_json(F.struct(F.lit("summary").alias("event"), *last.columns)).alias("value"))
    return done.select(F.col("_k").cast("bigint").alias("line"), line.alias("value")).unionByName(summary)


def write_lines(df: DataFrame, path: str, column: str = "value") -> None:
    df.select(column).write.mode("overwrite").text(path)
