"""Documents whose text is already decoded (lines of PDF pages, wikitext, Markdown tables) to sections and fields."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.functions import text as T

# Numbered headings, entries of a table of contents, bold lines, list items, references in brackets.
NUMBERED = r"^(\d+(?:\.\d+){0,2})\s+(.+)$"
CONTENTS = r"^\s*\d+(?:\.\d+)*\s+.+?\.{2,}\s*\d+\s*$"
BOLD = r"^\*\*([^*][^*]{0,100})\*\*\s*$"
ITEM = r"^(\d+[.)]|[-*•▪])\s+"
REFERENCE = r"(\w)\s*\[(?:\d{1,3})(?:[\s,–-]+\d{1,3})*\]"


def pdf_normalise(c: Column, list_share: float = 0.6) -> Column:
    """Text of PDF lines: entities, no-break spaces, typographic quotes and dashes made plain, Markdown links made their
    labels, single line breaks within a paragraph made spaces unless at least list_share of its lines are list items,
    references in brackets and superscript digits after a word dropped."""
    c = F.translate(T.unescape(c), " ’‘“”–—", " ''\"\"--")
    c = F.regexp_replace(F.regexp_replace(c, "\r\n?", "\n"), r"\[([^\]]+)\]\([^)]+\)", "$1")

    def paragraph(p: Column) -> Column:
        lines = F.filter(F.transform(F.split(p, "\n"), lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")), lambda x: x != "")
        items = F.size(F.filter(lines, lambda x: x.rlike(ITEM)))
        return F.when(items >= list_share * F.greatest(F.size(lines), F.lit(1)), F.array_join(lines, "\n")).otherwise(F.array_join(lines, " "))

    c = F.array_join(F.transform(F.split(c, "\n{2,}"), paragraph), "\n\n")
    c = F.regexp_replace(F.regexp_replace(c, "\n{3,}", "\n\n"), "[\t ]{2,}", " ")
    c = F.regexp_replace(F.regexp_replace(c, REFERENCE, "$1"), r"(\w)\s*[¹²³⁰-⁹]+", "$1")
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def heading_level(line: Column, size: Column | None = None, median: Column | None = None, shortest: int = 4) -> Column:
    """0 for ordinary lines; numbered ones 1 to 3 by their depth; 1 for lines clearly larger than the page's median and
    for lines of at least `shortest` and at most 60 letters of which more than 80 % are capitals."""
    s = F.regexp_replace(F.coalesce(line, F.lit("")), r"^\s+|\s+$", "")
    number = F.regexp_extract(s, NUMBERED, 1)
    depth = F.least(F.lit(3), F.length(F.regexp_replace(number, "[^.]", "")) + 1)
    letters, capitals = F.length(F.regexp_replace(s, r"[^\p{L}]", "")), F.length(F.regexp_replace(s, r"[^\p{Lu}]", ""))
    large = F.lit(False) if size is None else F.coalesce((size > 0) & (size >= F.greatest(median * 1.2, median + 1)), F.lit(False))
    loud = (letters >= shortest) & (letters <= 60) & (capitals > 0.8 * letters)
    return F.when(s == "", 0).when(number != "", depth).when(large | loud, 1).otherwise(0).cast("int")


def pdf_sections(lines: DataFrame, skip: tuple[str, ...] = ()) -> DataFrame:
    """lines: doc_id, page, pos, text, size.  (doc_id, page, pos, section, subsection, section_index, text): the lines
    that aren't headings nor entries of a table of contents, under the last heading of level 1 and of lower level before
    them.  Sections named in skip (letter case aside) drop out at any level."""
    median = F.element_at(F.array_sort(F.collect_list("size")), F.floor(F.count("size") / 2).cast("int") + 1)
    sizes = lines.groupBy("doc_id", "page").agg(F.when(F.count("size") > 0, median).alias("_m"))
    l = lines.where(~F.coalesce(F.col("text").rlike(CONTENTS), F.lit(False))).join(sizes, ["doc_id", "page"])
    l = l.withColumn("_l", heading_level(F.col("text"), F.col("size"), F.coalesce("_m", F.lit(0.0))))
    name = F.when(F.col("text").rlike(NUMBERED), F.regexp_extract(F.trim("text"), NUMBERED, 2)).otherwise(F.trim("text"))
    w = Window.partitionBy("doc_id").orderBy("page", "pos").rowsBetween(Window.unboundedPreceding, 0)
    l = l.withColumns({"_top": F.when(F.col("_l") == 1, name), "_low": F.when(F.col("_l") > 1, name)})
    l = l.withColumns({"section": F.coalesce(F.last("_top", ignorenulls=True).over(w), F.lit("Lead")), "section_index": F.count("_top").over(w).cast("int")})
    low = F.last("_low", ignorenulls=True).over(Window.partitionBy("doc_id", "section_index").orderBy("page", "pos").rowsBetween(Window.unboundedPreceding, 0))
    l = l.withColumn("subsection", low).where((F.col("_l") == 0) & T.present(F.col("text")).isNotNull())
    gone = [x.lower() for x in skip]
    if gone:
        l = l.where(~F.lower("section").isin(gone) & ~F.coalesce(F.lower("subsection").isin(gone), F.lit(False)))
    return l.select("doc_id", "page", "pos", "section", "subsection", "section_index", "text")


def wiki_sections(df: DataFrame, skip: tuple[str, ...] = (), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, section_no, section, subsection, subsubsection, section_index, subsection_index, text) of wikitext: cleaned text
    between headings of two to four `=`; section_index counts sections from 0, the lead's; subsection_index counts those
    of the section from 1, 0 for none.  Sections named in skip drop out with all below them; so do empty texts."""
    parts = F.split(F.regexp_replace(F.regexp_replace(text_col, "\r", ""), r"(?m)^(={2,4})([^=\n].*?)\1[ \t]*$", "\u0002$1\u0003$2\u0003"), "\u0002")
    rows = df.where(F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), F.posexplode(parts).alias("n", "p"))
    has = F.col("p").contains("\u0003")
    rows = rows.withColumns({"level": F.when(has, F.length(F.split("p", "\u0003")[0])).otherwise(0), "name": F.when(has, F.trim(F.split("p", "\u0003")[1])), "t": F.when(has, F.split("p", "\u0003")[2]).otherwise(F.col("p"))})
    w = Window.partitionBy("id").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    is_ = lambda k: F.when(F.col("level") == k, F.col("name"))
    rows = rows.withColumns({"section_index": F.count(is_(2)).over(w).cast("int"), "section": F.last(is_(2), ignorenulls=True).over(w)})
    w = Window.partitionBy("id", "section_index").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumns({"subsection_index": F.count(is_(3)).over(w).cast("int"), "subsection": F.last(is_(3), ignorenulls=True).over(w)})
    w = Window.partitionBy("id", "section_index", "subsection_index").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("subsubsection", F.last(is_(4), ignorenulls=True).over(w)).withColumn("text", F.regexp_replace(T.clean_wikitext(F.col("t")), r"^\s+|\s+$", "")).where("text <> ''")
    gone = [x.lower() for x in skip]
    if gone:
        rows = rows.where(~F.lower(F.coalesce("section", F.lit("lead"))).isin(gone))
    return rows.select(F.col("id").alias(id_col), F.col("n").alias("section_no"), F.coalesce("section", F.lit("Lead")).alias("section"), "subsection", "subsubsection", "section_index", "subsection_index", "text")


def _cells(row: Column) -> Column:
    return F.transform(F.split(F.regexp_replace(F.trim(row), r"^\|+|\|+$", ""), r"\|"), lambda x: F.trim(F.regexp_replace(F.regexp_replace(x, r"(?i)<br ?/?>|~~", " "), r"\s+", " ")))


def _table_rows(c: Column) -> tuple[Column, Column]:
    """(non-blank lines, those of them after head and rule that begin with a bar)."""
    lines = F.filter(F.split(c, "\r?\n"), lambda x: F.trim(x) != "")
    return lines, F.filter(F.slice(lines, 3, 1_000_000), lambda x: F.trim(x).startswith("|"))


def is_field_table(c: Column) -> Column:
    """A Markdown table of two columns and at least two rows, of the first ten of which two or more have a short label that
    isn't a number, and a value."""
    lines, rows = _table_rows(c)
    good = F.filter(F.transform(F.slice(rows, 1, 10), _cells), lambda x: (F.size(x) >= 2) & (x[0] != "") & (F.get(x, F.lit(1)) != "") & (F.length(x[0]) <= 40) & ~x[0].rlike(r"^[\d.,%-]+$"))
    head = F.get(lines, F.lit(0))
    return F.coalesce(F.trim(head).startswith("|") & (F.size(_cells(head)) == 2) & (F.size(rows) >= 2) & (F.size(good) >= 2), F.lit(False))


def table_fields(c: Column) -> Column:
    """map(label, value) of a Markdown table's first two columns; values of a repeated label are joined by ` ; `."""
    _, rows = _table_rows(c)
    edge = r"^[ :;,\-]+|[ :;,\-]+$"
    pairs = F.transform(F.filter(F.transform(rows, _cells), lambda x: F.size(x) >= 2), lambda x: F.struct(F.regexp_replace(x[0], edge, "").alias("k"), F.regexp_replace(x[1], edge, "").alias("v")))
    full = F.filter(pairs, lambda x: (x["k"] != "") & (x["v"] != ""))
    labels = F.array_distinct(F.transform(full, lambda x: x["k"]))
    return F.map_from_arrays(labels, F.transform(labels, lambda k: F.array_join(F.transform(F.filter(full, lambda x: x["k"] == k), lambda x: x["v"]), " ; ")))
