"""Scans, filters and nearest-vector searches over chunks and points."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.functions import vector as V


def payload_filter(conditions: dict[str, object]) -> Column:
    """All of the equalities; null values are skipped, url is compared in lower case with url_lower; none: true."""
    out = F.lit(True)
    for k, v in conditions.items():
        if v is not None:
            out = out & (F.col("url_lower") == str(v).lower() if k == "url" else F.col(k) == F.lit(v))
    return out


def lowered_filter(conditions: dict[str, object]) -> Column:
    """All of the equalities, with every string in lower case, url as url_lower; null values are skipped; none: true.
    A field that isn't stored in lower case can't match, which is what the search endpoint does."""
    return payload_filter({k: v.lower() if isinstance(v, str) else v for k, v in conditions.items()})


def any_url(url: str) -> Column:
    """url as it is or in lower case as url_lower."""
    return (F.col("url") == url) | (F.col("url_lower") == url.lower())


def chunks_by_url(df: DataFrame, url: str, limit: int = 100, by: str = "url_lower", id_col: str = "point_id") -> DataFrame:
    """The first chunks of a page, by url_lower or base_url_lower, without vectors; the limit is the feature."""
    return df.where(F.col(by) == url.lower()).drop("vector").orderBy(id_col).limit(limit)


def scan(df: DataFrame, conditions: dict[str, object], columns: Sequence[str]) -> DataFrame:
    """Filter and projection, both pushed into the Parquet scan where df is one."""
    return df.where(payload_filter(conditions)).select(*columns)


def top_k(df: DataFrame, query: list[float], k: int = 8, threshold: float | None = 0.35, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(id, score): the k nearest to one query vector, ties to the smaller id.  The query is a literal, so the search is
    one scan with a top-k in each partition (TakeOrderedAndProject); the score is computed once, below the filter."""
    q = np.asarray(query, dtype=np.float64)
    size = float(np.sqrt((q * q).sum()))
    unit = F.array(*(F.lit(float(x) / size) for x in q))
    n = V.norm(F.col(vector_col))
    scored = df.where(F.size(vector_col) == len(query)).select(F.col(id_col), F.when(n > 0, V.dot(F.col(vector_col), unit) / n).alias("score")).where("score is not null")
    if threshold is not None:
        scored = scored.where(F.col("score") >= threshold)
    return scored.orderBy(F.desc("score"), id_col).limit(k)


#: Query vectors are sent to the executors in blocks of this many: a proven bound of what is broadcast.
QUERY_BLOCK = 4096


def batch_top_k(df: DataFrame, queries: DataFrame, k: int = 8, threshold: float | None = None, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, id, score, rank): the k nearest of df for each row of queries (same columns), itself excluded.

    One matrix product per Arrow batch, from which only each query's k best leave; the partitions' bests are merged by
    window.  queries come to the driver in blocks of QUERY_BLOCK, each a pass over df; df is never collected."""
    spark = df.sparkSession
    rows = df.select(F.col(id_col).alias("id"), F.col(vector_col).alias("v")).where("id is not null and v is not null")
    asks = queries.select(F.col(id_col).alias("id"), F.col(vector_col).alias("v")).where("id is not null and v is not null")
    parts, last = [], None
    while True:
        block = (asks if last is None else asks.where(F.col("id") > last)).orderBy("id").limit(QUERY_BLOCK).collect()
        if not block:
            break
        last = block[-1]["id"]
        q = np.array([r["v"] for r in block], dtype=np.float64)
        q /= np.maximum(np.sqrt((q * q).sum(1, keepdims=True)), 1e-300)
        shipped = spark.sparkContext.broadcast((np.array([r["id"] for r in block], dtype=np.int64), q))

        def best(batches: Iterator[pa.RecordBatch], shipped=shipped) -> Iterator[pa.RecordBatch]:
            ids, q = shipped.value
            for b in batches:
                v = np.asarray(b.column("v").flatten(), dtype=np.float64).reshape(b.num_rows, -1)
                n = np.sqrt((v * v).sum(1))
                own = np.asarray(b.column("id"))
                s = np.round(q @ np.divide(v, n[:, None], where=n[:, None] > 0, out=np.full_like(v, np.nan)).T, 9)
                s[ids[:, None] == own[None, :]] = np.nan
                s = np.where(np.isnan(s) | (s < (-2 if threshold is None else threshold)), -np.inf, s)
                order = np.lexsort((np.broadcast_to(own, s.shape), -s), axis=1)[:, :k]
                got = np.take_along_axis(s, order, 1)
                keep = np.isfinite(got)
                yield pa.RecordBatch.from_arrays([pa.array(np.broadcast_to(ids[:, None], order.shape)[keep]), pa.array(own[order][keep]), pa.array(got[keep])], ["query_id", "id", "score"])

        parts.append(rows.mapInArrow(best, "query_id bigint, id bigint, score double"))
        if len(block) < QUERY_BLOCK:
            break
    if not parts:
        return spark.createDataFrame([], "query_id bigint, id bigint, score double, rank int")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    return out.withColumn("rank", rank).where(F.col("rank") <= k)
