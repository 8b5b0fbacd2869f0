"""HTML pages to section rows.  Parsing needs Python; batches travel as Arrow, each page by itself."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from urllib.parse import urljoin

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessella.functions import markup


def html_sections(df: DataFrame, skip: tuple[str, ...] = (), id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """(id, block, section, subsection, section_index, subsection_index, anchor, kind, text).  Null pages: no rows."""
    gone = frozenset(s.lower() for s in skip)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(i, k, *r) for i, h in zip(b.column("id").to_pylist(), b.column("h").to_pylist()) if h for k, r in enumerate(markup.sections(h, gone))]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names)

    names = ["id", "block", "section", "subsection", "section_index", "subsection_index", "anchor", "kind", "text"]
    kinds = [pa.int64(), pa.int32(), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.string()]
    out = df.select(F.col(id_col).cast("bigint").alias("id"), F.col(html_col).alias("h")).mapInArrow(run, "id bigint, block int, section string, subsection string, section_index int, subsection_index int, anchor string, kind string, text string")
    return out.withColumnRenamed("id", id_col)


def html_meta(df: DataFrame, id_col: str = "page_id", html_col: str = "html", url_col: str = "url", base: str | None = None) -> DataFrame:
    """(id, title, description, links): absolute links, those under `base` only if it is given."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [(*markup.meta(h), sorted({x for x in (urljoin(u or "", y).split("#")[0] for y in markup.links(h)) if not base or x.startswith(base)})) for h, u in zip(b.column("h").to_pylist(), b.column("u").to_pylist())]
            t, d, ls = zip(*got) if got else ((), (), ())
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(t, pa.string()), pa.array(d, pa.string()), pa.array(ls, pa.list_(pa.string()))], ["id", "title", "description", "links"])

    out = df.select(F.col(id_col).cast("bigint").alias("id"), F.col(html_col).alias("h"), F.col(url_col).alias("u")).mapInArrow(run, "id bigint, title string, description string, links array<string>")
    return out.withColumnRenamed("id", id_col)


def html_tables(df: DataFrame, per: int = 12, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """(id, table_index, table_chunk_index, table_total_chunks, content_type, text) of each page's tables and, as
    content_type infobox with index 0, the rows `label: value` of its infobox.  Null pages: no rows."""
    names = ["id", "table_index", "table_chunk_index", "table_total_chunks", "content_type", "text"]
    kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows: list[tuple] = []
            for i, h in zip(b.column("id").to_pylist(), b.column("h").to_pylist()):
                if h and "<table" in h.lower():
                    box = markup.infobox(h)
                    rows += [(i, 0, 0, 1, "infobox", "\n".join(f"{k}: {v}" for k, v in box))] if box else []
                    rows += [(i, t, k, n, "table", x) for t, k, n, x in markup.table_chunks(h, per)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names)

    out = df.select(F.col(id_col).cast("bigint").alias("id"), F.col(html_col).alias("h")).mapInArrow(run, "id bigint, table_index int, table_chunk_index int, table_total_chunks int, content_type string, text string")
    return out.withColumnRenamed("id", id_col)


def page_chunks(df: DataFrame, skip: tuple[str, ...] = (), id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """(id, chunk_index, total_chunks, content_type, section, subsection, text): the infobox, then the text of the
    sections, then the tables of each page, numbered through."""
    parts = html_sections(df, skip, id_col, html_col).where("kind = 'text'").select(id_col, F.lit(1).alias("_o"), F.col("block").alias("_a"), F.lit(0).alias("_b"), F.lit("text").alias("content_type"), "section", "subsection", "text")
    tabs = html_tables(df, id_col=id_col, html_col=html_col).select(id_col, F.when(F.col("content_type") == "infobox", 0).otherwise(2).alias("_o"), F.col("table_index").alias("_a"), F.col("table_chunk_index").alias("_b"), "content_type", F.when(F.col("content_type") == "infobox", "INFOBOX").alias("section"), F.lit(None).cast("string").alias("subsection"), "text")
    w = Window.partitionBy(id_col)
    rows = parts.unionByName(tabs).withColumns({"chunk_index": F.row_number().over(w.orderBy("_o", "_a", "_b")) - 1, "total_chunks": F.count(F.lit(1)).over(w)})
    return rows.select(id_col, "chunk_index", "total_chunks", "content_type", "section", "subsection", "text")


def price_points(df: DataFrame, payload_col: str = "payload", id_col: str = "symbol") -> DataFrame:
    """(symbol, pos, d, close) of price payloads: a list, or one under data, prices, history, results, items[0].history
    or the symbol; points name date and close as d/date/t and c/close/v.  Unreadable payloads give no rows."""

    def points(symbol: str, raw: str | None) -> list[tuple]:
        try:
            x = json.loads(raw or "")
        except ValueError:
            return []
        if isinstance(x, dict):
            first = (x.get("items") or [None])[0] if isinstance(x.get("items"), list) else None
            x = next((v for v in (x.get(symbol), first.get("history") if isinstance(first, dict) else None, *(x.get(k) for k in ("data", "prices", "history", "results"))) if isinstance(v, list)), [])
        out = []
        for p in x if isinstance(x, list) else []:
            d = next((p[k] for k in ("d", "date", "t") if isinstance(p, dict) and p.get(k)), None)
            c = next((p[k] for k in ("c", "close", "v") if isinstance(p, dict) and p.get(k) is not None), None)
            if d is not None and isinstance(c, (int, float)) and re.match(r"\d{4}-\d{2}-\d{2}", str(d)):
                out.append((symbol, len(out), str(d)[:10], round(float(c), 2)))
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [r for s, p in zip(b.column("s").to_pylist(), b.column("p").to_pylist()) for r in points(s, p)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.string(), pa.int32(), pa.string(), pa.float64()))], ["symbol", "pos", "d", "close"])

    return df.select(F.col(id_col).alias("s"), F.col(payload_col).alias("p")).mapInArrow(run, "symbol string, pos int, d string, close double")
