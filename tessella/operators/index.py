"""Writing to an index: upsert, delete, update, backfill, clone, export.  Tables are values: each operator gives the new
table, which the caller writes to a new place and swaps in."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.functions import text as T
from tessella.functions import vector as V


def upsert(old: DataFrame, new: DataFrame, key: str, version: str) -> DataFrame:
    """old with its rows replaced by those of new with the same key; of several new rows the latest version counts."""
    latest = new.withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy(F.desc_nulls_last(version)))).where("_r = 1").drop("_r")
    return old.join(latest.select(key), key, "left_anti").unionByName(latest)


def delete_where(df: DataFrame, match: Column) -> DataFrame:
    """Rows that don't match; a null comparison doesn't match."""
    return df.where(~F.coalesce(match, F.lit(False)))


def delete_ids(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    return df.join(ids.select(key), key, "left_anti")


def update_where(df: DataFrame, match: Column, column: str, value: Column) -> DataFrame:
    return df.withColumn(column, F.when(match, value).otherwise(F.col(column)))


def backfill_base_url(df: DataFrame, key: str = "point_id", max_updates: int | None = None, dry_run: bool = False) -> DataFrame:
    """base_url and base_url_lower where either is missing: the lower-case url without fragment; needs_update tells.  Of
    max_updates rows at most, those of the smallest keys, which must be unique; of none in a dry run."""
    base = F.split(F.lower(F.trim(F.coalesce("url_lower", "url"))), "#")[0]
    needs = T.present(F.col("base_url")).isNull() | T.present(F.col("base_url_lower")).isNull()
    needs = needs & base.isNotNull()
    done = needs & F.lit(not dry_run)
    if max_updates is not None and not dry_run:
        done = done & (F.col(key) <= df.where(needs).select(key).orderBy(key).limit(max_updates).agg(F.max(key)).scalar())
    done = F.coalesce(done, F.lit(False))
    return df.withColumns({"needs_update": needs, "base_url": F.when(done, base).otherwise(F.col("base_url")), "base_url_lower": F.when(done, base).otherwise(F.col("base_url_lower"))})


def backfill_summary(df: DataFrame) -> DataFrame:
    return backfill_base_url(df).agg(F.count(F.lit(1)).alias("scanned"), F.count_if("needs_update").alias("needs"), F.count_if(F.col("needs_update") & F.col("base_url").isNotNull()).alias("updated"))


def clone_points(df: DataFrame, key: str, skip_first: int = 0, max_points: int | None = None) -> DataFrame:
    """The rows from number skip_first in order of the key on, which must be unique; a limit is the feature here.  The
    key of the last row skipped is found by a top-k of each partition, so the rows themselves aren't sorted."""
    out = df if skip_first <= 0 else df.where(F.col(key) > df.select(key).orderBy(key).limit(skip_first).agg(F.max(key)).scalar())
    return out if max_points is None else out.orderBy(key).limit(max_points)


def export_json(df: DataFrame, key: str, payload: list[str], vector: str = "vector") -> DataFrame:
    """One JSON line per row: id, vector and payload, null fields left out; of a map of named vectors the first."""
    v = F.map_values(vector)[0] if df.schema[vector].dataType.typeName() == "map" else F.col(vector)
    return df.select(F.to_json(F.struct(F.col(key).alias("id"), v.alias("vector"), F.struct(*payload).alias("payload"))).alias("value"))


def checked_points(df: DataFrame, dim: int | None = None) -> DataFrame:
    """Rows to upsert, with url_lower and updated_at; fails at the first vector that is null or holds no number, or isn't
    of the length given."""
    good = V.valid(F.col("vector"), F.lit(dim) if dim is not None else F.size("vector"))
    vector = F.when(good, F.col("vector").cast("array<float>")).otherwise(F.raise_error(F.concat(F.lit("no valid vector: "), F.coalesce(F.col("id").cast("string"), F.lit("null")))).cast("array<float>"))
    return df.withColumns({"vector": vector, "url_lower": F.lower("url"), "updated_at": F.current_timestamp()})


def counted_delete(df: DataFrame, match: Column) -> tuple[DataFrame, DataFrame]:
    """(rows that stay, one row with the number of deleted ones)."""
    hit = F.coalesce(match, F.lit(False))
    return df.where(~hit), df.agg(F.count_if(hit).alias("deleted"))


def counted_update(df: DataFrame, match: Column, column: str, value: Column) -> tuple[DataFrame, DataFrame]:
    """(the new table, one row with the number of updated rows)."""
    return update_where(df, match, column, value), df.agg(F.count_if(F.coalesce(match, F.lit(False))).alias("updated"))


def clone_report(source: DataFrame, target: DataFrame) -> DataFrame:
    """(source_points, target_points, complete): the counts that verify a clone."""
    n = source.agg(F.count(F.lit(1)).alias("n")).scalar()
    return target.agg(F.count(F.lit(1)).alias("target_points")).select(n.alias("source_points"), "target_points", (F.col("target_points") == n).alias("complete"))


def copied_collection(collections: DataFrame, source: str, target: str) -> DataFrame:
    """collections with a row for target that has the dimension and distance of source; fails where target exists with
    others."""
    row = collections.where(F.col("collection_name") == source).limit(1)
    there = collections.where(F.col("collection_name") == target).select(F.col("dim").alias("_dim"), F.col("distance").alias("_distance")).limit(1)
    checked = row.join(there, F.lit(True), "left").select(*(F.lit(target).alias(c) if c == "collection_name" else F.col(c) for c in collections.columns), "_dim", "_distance")
    same = F.col("_dim").isNull() | (F.col("_dim") == F.col("dim")) & (F.col("_distance") == F.col("distance"))
    checked = checked.withColumn("dim", F.when(same, F.col("dim")).otherwise(F.raise_error(F.lit("the target has another dimension or distance")).cast("int")))
    return collections.where(F.col("collection_name") != target).unionByName(checked.drop("_dim", "_distance"))


def truncate(df: DataFrame) -> DataFrame:
    """No rows, same columns."""
    return df.limit(0)
