"""Cutting documents: token windows, table batches, section walks, numbering, caps, guards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.functions import text as T


def word_windows(df: DataFrame, id_col: str, text_col: str, size: int, overlap: int, drop_tail_overlap: bool = False) -> DataFrame:
    """(id, chunk_index, total_chunks, text, words): sliding windows of `size` words, each repeating the last `overlap`
    of the one before.  An overlap of size or more counts as size - 1.  Without drop_tail_overlap a last window may
    hold nothing but repeated words.  Texts without words give no rows."""
    if size <= 0:
        raise ValueError("size must be positive")
    step = size - min(overlap, size - 1)
    w = F.filter(F.split(F.col(text_col), r"[ \t\n\r]+"), lambda x: x != "")
    rows = df.where(F.col(text_col).isNotNull()).select(F.col(id_col), w.alias("w")).where(F.size("w") > 0)
    end = F.greatest(F.lit(0), F.size("w") - 1 - ((size - step) if drop_tail_overlap else 0))
    starts = rows.select(id_col, "w", F.sequence(F.lit(0), end, F.lit(step)).alias("s"))
    return starts.select(id_col, F.size("s").alias("total_chunks"), "w", F.posexplode("s").alias("chunk_index", "start")).select(id_col, "chunk_index", "total_chunks", F.array_join(F.slice("w", F.col("start") + 1, size), " ").alias("text"), F.least(F.lit(size), F.size("w") - F.col("start")).alias("words"))


def table_batches(rows: DataFrame, per: int = 12) -> DataFrame:
    """rows: table_id, row_no (0 the header), line.  (table_id, batch, text): batches of `per` rows, the header before each."""
    head = rows.where("row_no = 0").select("table_id", F.col("line").alias("head"))
    body = rows.where("row_no > 0").withColumn("batch", F.floor((F.row_number().over(Window.partitionBy("table_id").orderBy("row_no")) - 1) / per).cast("int"))
    g = body.groupBy("table_id", "batch").agg(F.array_sort(F.collect_list(F.struct("row_no", "line"))).alias("a"))
    return g.join(head, "table_id", "left").select("table_id", "batch", F.concat_ws("\n", "head", F.array_join(F.transform("a", lambda x: x["line"]), "\n")).alias("text"))


def section_walk(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, pos, section, subsection, section_index, subsection_index, text): the non-blank lines of a text under the
    Markdown (`##`) or wikitext (`==`) headings before them.  Lines before the first heading belong to `Lead`; a
    subsection ends with its section.  Indices count headings from 1; 0 before the first.

    The walk runs within each text's own array, so no row of one document waits for another."""
    lines = F.filter(F.transform(F.split(F.regexp_replace(text_col, "\r", ""), "\n"), lambda x: F.trim(x)), lambda x: x != "")
    zero = F.struct(F.lit("Lead").alias("section"), F.lit(None).cast("string").alias("sub"), F.lit(0).alias("i"), F.lit(0).alias("j"), F.array().cast("array<struct<pos:int,section:string,sub:string,i:int,j:int,text:string>>").alias("out"), F.lit(0).alias("pos"))

    def step(acc: Column, line: Column) -> Column:
        top = F.regexp_extract(line, r"^(?:#{1,2}\s+|==\s*)([^#=].*?)\s*(?:=*)$", 1)
        low = F.regexp_extract(line, r"^(?:#{3,6}\s+|===+\s*)([^#=].*?)\s*(?:=*)$", 1)
        is_top, is_low = top != "", low != ""
        section = F.when(is_top, top).otherwise(acc["section"])
        sub = F.when(is_top, F.lit(None)).when(is_low, low).otherwise(acc["sub"])
        i = acc["i"] + is_top.cast("int")
        j = F.when(is_top, 0).otherwise(acc["j"] + is_low.cast("int"))
        row = F.struct(acc["pos"].alias("pos"), section.alias("section"), sub.alias("sub"), i.alias("i"), j.alias("j"), line.alias("text"))
        return F.struct(section.alias("section"), sub.alias("sub"), i.alias("i"), j.alias("j"), F.when(is_top | is_low, acc["out"]).otherwise(F.concat(acc["out"], F.array(row))).alias("out"), (acc["pos"] + 1).alias("pos"))

    walked = df.where(F.col(text_col).isNotNull()).select(F.col(id_col), F.explode(F.aggregate(lines, zero, step, lambda a: a["out"])).alias("r"))
    return walked.select(id_col, "r.pos", "r.section", F.col("r.sub").alias("subsection"), F.col("r.i").alias("section_index"), F.col("r.j").alias("subsection_index"), "r.text")


def anchored_url(url: Column, section: Column, subsection: Column) -> Column:
    """url with an anchor of the deepest heading, unless it has one or there is none but the lead."""
    name = F.coalesce(T.present(subsection), F.when(section != "Lead", T.present(section)))
    return F.when(url.contains("#") | name.isNull(), url).otherwise(F.concat(url, F.lit("#"), T.slug(name)))


def number_chunks(df: DataFrame, group: str, *order: str) -> DataFrame:
    w = Window.partitionBy(group)
    return df.withColumns({"new_index": F.row_number().over(w.orderBy(*order)) - 1, "new_total": F.count(F.lit(1)).over(w)})


def capped(df: DataFrame, group: str, order: str, most: int) -> DataFrame:
    """The first `most` chunks of each document: the limit is the feature."""
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(group).orderBy(order))).where(F.col("_r") <= most).drop("_r")


def within_tokens(df: DataFrame, group: str, order: str, text: str, budget: int) -> DataFrame:
    """The chunks of each document up to the token budget, by running sum."""
    w = Window.partitionBy(group).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("used", F.sum(F.greatest(F.lit(1), F.floor(F.length(text) / 4))).over(w).cast("bigint")).where(F.col("used") <= budget)
