"""Counting, listing, grouping and sampling what is in an index."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.functions import text as T


def document_key() -> Column:
    return T.first_present(F.col("base_url"), F.col("url"), F.col("url_lower"))


def list_documents(df: DataFrame) -> DataFrame:
    """(document, chunks, title, updated_at): title of the chunk with the smallest id that has one."""
    return df.groupBy(document_key().alias("document")).agg(F.count(F.lit(1)).alias("chunks"), F.min_by("title", F.when(T.present(F.col("title")).isNotNull(), F.col("point_id"))).alias("title"), F.max("updated_at").alias("updated_at"))


def analyse_chunks(df: DataFrame, fields: list[str]) -> DataFrame:
    """For each document and field: distinct values, smallest and largest."""
    cols = [c for f in fields for c in (F.count_distinct(f).alias(f"{f}_distinct"), F.min(f).alias(f"{f}_min"), F.max(f).alias(f"{f}_max"))]
    return df.groupBy(document_key().alias("document")).agg(F.count(F.lit(1)).alias("chunks"), *cols)


def first_seen(df: DataFrame, group: str, order: str, title: str, width: int) -> DataFrame:
    """(group, title cut to width) of the first row that has a title."""
    return df.where(F.col(group).isNotNull()).groupBy(group).agg(F.min_by(title, F.when(F.col(title).isNotNull(), F.col(order))).alias("t")).select(group, F.substring("t", 1, width).alias("title"))


def stratified_sample(df: DataFrame, key: Column, stratum: Column, per_stratum: int, total: int, seed: str) -> DataFrame:
    """Distinct by key, at most per_stratum of each stratum and total in all, in an order that the seed decides."""
    rank = F.sha2(F.concat_ws("\u001f", F.lit(seed), key.cast("string")), 256)
    one = df.withColumns({"_k": key.cast("string"), "_s": stratum, "_o": rank}).where("_k is not null").dropDuplicates(["_k"])
    some = one.withColumn("_r", F.row_number().over(Window.partitionBy("_s").orderBy("_o", "_k"))).where(F.col("_r") <= per_stratum)
    return some.orderBy("_o", "_k").limit(total).select(F.col("_k").alias("key"), F.col("_s").alias("stratum"))


def repeated_margins(lines: DataFrame, share: float = 0.6, edge: int = 3, shortest: int = 5) -> DataFrame:
    """(doc_id, line, occurrences): headers and footers.  lines: doc_id, page, pos, text.  Among the first and last
    `edge` non-blank lines of a page, those of at least `shortest` characters that occur on max(2, share * pages)."""
    shown = lines.withColumn("line", F.lower(F.trim(F.regexp_replace("text", r"\s+", " ")))).where("line <> ''")
    w = Window.partitionBy("doc_id", "page")
    at = shown.withColumns({"up": F.row_number().over(w.orderBy("pos")), "down": F.row_number().over(w.orderBy(F.desc("pos")))})
    pages = lines.groupBy("doc_id").agg(F.count_distinct("page").alias("pages"))
    count = at.where((F.col("up") <= edge) | (F.col("down") <= edge)).where(F.length("line") >= shortest).groupBy("doc_id", "line").agg(F.count(F.lit(1)).alias("occurrences"))
    return count.join(pages, "doc_id").where(F.col("occurrences") >= F.greatest(F.lit(2), F.floor(F.col("pages") * share))).select("doc_id", "line", "occurrences")


def without_repeated_margins(lines: DataFrame, share: float = 0.6, edge: int = 3, shortest: int = 5) -> DataFrame:
    """lines (doc_id, page, pos, text) without what repeats of headers and footers: of each repeated_margins line among the
    first and last `edge` lines of pages the first occurrence stays."""
    shown = lines.withColumn("line", F.lower(F.trim(F.regexp_replace("text", r"\s+", " "))))
    w = Window.partitionBy("doc_id", "page")
    full = F.when(F.col("line") != "", F.col("pos"))
    at = shown.withColumns({"_up": F.count(full).over(w.orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)), "_all": F.count(full).over(w)})
    margin = (F.col("line") != "") & ((F.col("_up") <= edge) | (F.col("_all") - F.col("_up") < edge))
    found = repeated_margins(lines, share, edge, shortest).select("doc_id", "line", F.lit(True).alias("_rep"))
    marked = at.withColumn("_m", margin).join(found, ["doc_id", "line"], "left").withColumn("_m", F.col("_m") & F.coalesce("_rep", F.lit(False)))
    first = marked.where("_m").groupBy("doc_id", "line").agg(F.min(F.struct("page", "pos")).alias("_f"))  # partial minima
    kept = marked.join(first, ["doc_id", "line"], "left").where(~F.col("_m") | (F.struct("page", "pos") == F.col("_f")))
    return kept.select("doc_id", "page", "pos", "text")


def payload_fields(df: DataFrame) -> DataFrame:
    """(field, rows): every column that any row fills, with the number of rows that do."""
    cols = df.columns
    one = df.agg(*(F.count(c).alias(c) for c in cols))
    return one.select(F.explode(F.array(*(F.struct(F.lit(c).alias("field"), F.col(c).alias("rows")) for c in cols))).alias("x")).select("x.*").where("rows > 0")


def ranked(df: DataFrame, group: str, order: list[Column], id_col: str, width: int = 65_536) -> DataFrame:
    """df with pos: the row's number within its group, by order and then by the (unique, whole) id.

    A group of any size is spread over tasks: rows are numbered within slices of equal order values and ids of one
    stretch of `width`, and each slice begins where the counts of those before it end."""
    names = [f"_o{k}" for k in range(len(order))]
    at = df.withColumns({**dict(zip(names, order)), "_b": F.floor(F.col(id_col) / width)})
    slice_ = [group, *names, "_b"]
    counts = at.groupBy(*slice_).agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(Window.partitionBy(group).orderBy(*names, "_b").rowsBetween(Window.unboundedPreceding, -1))
    starts = counts.withColumn("_s", F.coalesce(before, F.lit(0))).drop("_n")
    same = None
    for c in slice_:
        eq = F.col(f"r.{c}").eqNullSafe(F.col(f"s.{c}"))
        same = eq if same is None else same & eq
    numbered = at.withColumn("_r", F.row_number().over(Window.partitionBy(*slice_).orderBy(id_col)))
    j = numbered.alias("r").join(starts.alias("s"), same)
    return j.select(*(F.col(f"r.{c}").alias(c) for c in df.columns), (F.col("s._s") + F.col("r._r")).cast("int").alias("pos"))


def evict_idle(summaries: DataFrame, now: Column, idle_seconds: int = 3600) -> tuple[DataFrame, DataFrame]:
    """summaries: ns, key, text, last_seen.  (those that stay, one row: namespaces_cleared, summaries_removed,
    reclaimed_bytes): a namespace goes if all of it was last seen more than idle_seconds before now, or never."""
    last = summaries.groupBy("ns").agg(F.max("last_seen").alias("_l"))
    idle = last.where(F.col("_l").isNull() | (F.unix_micros(now.cast("timestamp")) - F.unix_micros("_l") > idle_seconds * 1_000_000)).select("ns")
    gone = summaries.join(idle, "ns", "left_semi")
    report = gone.agg(F.count_distinct("ns").alias("namespaces_cleared"), F.count(F.lit(1)).alias("summaries_removed"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("reclaimed_bytes"))
    return summaries.join(idle, "ns", "left_anti"), report


def collapse_sources(context: DataFrame) -> DataFrame:
    """context: idx, url, section, subsection.  One entry a place with all numbers that point there, in order of the
    first: `[1, 3] url (Section: a > b)`."""
    rows = context.where(T.present(F.col("url")).isNotNull())
    g = rows.groupBy("url", F.coalesce("section", F.lit("")).alias("section"), F.coalesce("subsection", F.lit("")).alias("subsection")).agg(F.array_sort(F.collect_set("idx")).alias("ids"))
    path = F.concat_ws(" > ", T.present(F.col("section")), T.present(F.col("subsection")))
    return g.select(F.array_min("ids").alias("first_idx"), F.concat(F.lit("["), F.array_join(F.transform("ids", lambda x: x.cast("string")), ", "), F.lit("] "), F.col("url"), F.when(path != "", F.concat(F.lit(" (Section: "), path, F.lit(")"))).otherwise("")).alias("entry"))
