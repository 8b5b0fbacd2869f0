"""Problem 2: lines that come back on page after page of one site.

PrefixSpan over the sequences of line identifiers of each site: frequent single lines first, which the sequences are
reduced to; then, level by level, each frequent prefix is grown by every line that follows in its projected database,
at any distance, until none is frequent.  The support of a pattern is the number of distinct pages of the site that
hold it.  A projected database is kept as positions: for each sequence, the line where the prefix's first match ends.
Prefixes with the same projected database have the same support and the same continuations, so it is grown once for
all of them: the frequent patterns are the paths of the graph of these steps.
"""

from __future__ import annotations

from functools import reduce
from itertools import count

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import cut, page_key, page_url, site_key, small

#: Frequent patterns are 24 bytes each when broadcast; above this many (about 50 MB) the join is shuffled instead.
MAX_BROADCAST_PATTERNS = 2_000_000
#: Steps are 52 bytes each.
MAX_BROADCAST_STEPS = 1_000_000


def numbered_lines(df: DataFrame, id_col: str = "point_id", text_col: str = "text") -> DataFrame:
    """One row per line with letters: doc, site, page, copy (hashes; doc and copy tell texts apart), line_no from 1, key
    and check (together the line's identity within its site).  Rows without text or page, and lines without letters,
    give nothing."""
    page = page_url(F.col("base_url"), F.col("url"))
    rows = df.select(F.col(id_col).alias("doc"), page_key(page).alias("p"), site_key(page).alias("site"), F.col(text_col).alias("t")).where("doc is not null and t is not null and p <> '' and site <> ''")
    lines = rows.select("doc", "site", F.xxhash64("p").alias("page"), F.xxhash64("p", "t").alias("copy"), F.posexplode(F.split("t", "\n", -1)).alias("i", "line"))
    letters = F.lower(F.regexp_replace("line", r"[^\p{L}]+", ""))
    return lines.select("doc", "site", "page", "copy", (F.col("i") + 1).cast("int").alias("line_no"), letters.alias("l")).where("l <> ''").select("doc", "site", "page", "copy", "line_no", F.xxhash64("site", "l").alias("key"), F.hash("l", "site").alias("check"))


def _support(occurrences: DataFrame, min_pages: int) -> DataFrame:
    """Patterns (key, check) on at least min_pages pages.  Two aggregations with partial sums: a line that stands on
    a third of all pages is spread over the first shuffle by its page and arrives at the second as partial counts."""
    pages = occurrences.select("key", "check", "page").distinct()
    return pages.groupBy("key", "check").agg(F.count(F.lit(1)).alias("pages")).where(F.col("pages") >= min_pages)


def frequent_lines(df: DataFrame, min_pages: int = 5, id_col: str = "point_id", text_col: str = "text") -> DataFrame:
    """The occurrences of frequent lines, as a written table (doc, site, page, copy, line_no, key, check, pages)."""
    lines = numbered_lines(df, id_col, text_col)
    found = cut(_support(lines, min_pages), "p2-lines")
    return cut(lines.join(small(found, found.count(), MAX_BROADCAST_PATTERNS), ["key", "check"]).distinct(), "p2-occurrences")


def _union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def _sequences(lines: DataFrame) -> DataFrame:
    """One row per text: doc, copy, site, page and s, its frequent lines in order, each with prev, the number of the line
    before it that is the same (0 if none).  A group is one text, so as long as that text at most."""
    seq = lines.groupBy("doc", "copy", "site", "page").agg(F.sort_array(F.collect_list(F.struct("line_no", "key", "check"))).alias("s"))
    before = F.transform("s", lambda x: F.struct(*(x[c].alias(c) for c in ("line_no", "key", "check")), F.coalesce(F.array_max(F.transform(F.filter("s", lambda y: (y["line_no"] < x["line_no"]) & (y["key"] == x["key"]) & (y["check"] == x["check"])), lambda y: y["line_no"])), F.lit(0)).alias("prev")))
    return cut(seq.withColumn("s", before), "p2-sequences")


def _grown(seq: DataFrame, projected: DataFrame) -> DataFrame:
    """Every line after the prefix in its projected database (doc, copy, prefix, at).  first: the longer pattern's first
    match ends here, as the same line doesn't stand between."""
    after = seq.join(projected, ["doc", "copy"]).select("doc", "copy", "page", "prefix", "at", F.explode(F.filter("s", lambda x: x["line_no"] > F.col("at"))).alias("x"))
    return after.select("doc", "copy", "page", "prefix", "x.line_no", "x.key", "x.check", (F.col("x.prev") <= F.col("at")).alias("first"))


def _steps(grown: DataFrame, min_pages: int) -> DataFrame:
    """(prefix, key, check, pages, to): the frequent patterns one line longer.  to stands for the pattern's projected
    database: two hashes over its positions.  Counted as in _support, in two steps."""
    same = [F.bit_xor(F.xxhash64("doc", "copy", "line_no")).alias("a"), F.bit_xor(F.xxhash64("line_no", "copy", "doc")).alias("b")]
    pages = grown.where("first").groupBy("prefix", "key", "check", "page").agg(*same)
    steps = pages.groupBy("prefix", "key", "check").agg(F.count(F.lit(1)).alias("pages"), F.bit_xor("a").alias("a"), F.bit_xor("b").alias("b")).where(F.col("pages") >= min_pages)
    return steps.select("prefix", "key", "check", "pages", F.struct("a", "b").alias("to"))


def _grow(df: DataFrame, min_pages: int, max_length: int | None, id_col: str, text_col: str) -> tuple[DataFrame, list[DataFrame], list[DataFrame]]:
    """The sequences; by level, the steps that start there; by level, the projected databases not met before, with all
    lines where an occurrence ends (doc, copy, prefix, line_no, first)."""
    seq = _sequences(frequent_lines(df, min_pages, id_col, text_col))
    steps, levels, known = [], [], []
    root = F.struct(F.lit(0).cast("bigint").alias("a"), F.lit(0).cast("bigint").alias("b"))
    projected = seq.select("doc", "copy", root.alias("prefix"), F.lit(0).alias("at"))
    for n in count(1):
        if max_length is not None and n > max_length:
            break
        grown = _grown(seq, projected)
        steps.append(cut(_steps(grown, min_pages), f"p2-steps{n}"))
        new = steps[-1].groupBy("to").agg(F.min(F.struct("prefix", "key", "check")).alias("by")).select("to", "by.*")
        if known:
            new = new.join(_union(known), "to", "left_anti")
        new = cut(new, f"p2-new{n}")
        rows = new.count()
        if not rows and levels:
            break
        known.append(new.select("to"))
        ends = grown.join(small(new, rows, MAX_BROADCAST_STEPS), ["prefix", "key", "check"])
        levels.append(cut(ends.select("doc", "copy", F.col("to").alias("prefix"), "line_no", "first"), f"p2-level{n}"))
        projected = levels[-1].where("first").select("doc", "copy", "prefix", F.col("line_no").alias("at"))
    return seq, steps, levels


def _patterns(seq: DataFrame, steps: list[DataFrame], levels: list[DataFrame], max_length: int | None) -> DataFrame:
    """The paths along the steps, by length and projected database."""
    item = F.array(F.struct("key", "check"))
    step = _union(steps).select(F.col("prefix").alias("from"), "to", "pages", item.alias("item"))
    paths = [cut(steps[0].select("to", "pages", F.lit(1).alias("length"), F.lit(1.0).alias("patterns"), item.alias("keys")), "p2-paths1")]
    for n in count(2):
        if max_length is not None and n > max_length:
            break
        longer = paths[-1].select(F.col("to").alias("from"), "patterns", "keys").join(step, "from")
        longer = cut(longer.groupBy("to").agg(F.max("pages").alias("pages"), F.lit(n).alias("length"), F.sum("patterns").alias("patterns"), F.min(F.concat("keys", "item")).alias("keys")), f"p2-paths{n}")
        if longer.isEmpty():
            break
        paths.append(longer)
    seen = _union(levels).where("first").groupBy(F.col("prefix").alias("to")).agg(F.min(F.struct("doc", "copy")).alias("seen")).select("to", "seen.*")
    after = lambda lines, k: F.filter("s", lambda x: (x["line_no"] > F.coalesce(F.array_max(lines), F.lit(0))) & (x["key"] == k["key"]) & (x["check"] == k["check"]))
    lines = F.aggregate("keys", F.array().cast("array<int>"), lambda lines, k: F.concat(lines, F.array(after(lines, k)[0]["line_no"])))
    rows = _union(paths).join(seen, "to").join(seq, ["doc", "copy"]).withColumn("lines", lines)
    return rows.select("site", "length", "pages", F.col("doc").alias("first_doc"), F.col("lines")[0].alias("first_line"), "lines", "patterns")


def prefixspan(df: DataFrame, min_pages: int = 5, max_length: int | None = None, id_col: str = "point_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(patterns, occurrences).

    patterns: site, length, pages, first_doc, first_line and lines, where a pattern can be seen, and patterns.  A pattern
    is a sequence of lines that follow each other at any distance.  Patterns of one length that have the same projected
    database (so the same pages and the same last line) share a row, which shows one of them; patterns is their number.
    occurrences: doc, line_no: the lines where occurrences of the patterns end.  A line within an occurrence ends that
    of a shorter pattern, so these are all lines that occurrences cover.
    Without max_length both go on until no pattern is frequent any more.
    Repeated rows of a document count once; null or blank text, null page: no lines; no rows: empty results.
    """
    seq, steps, levels = _grow(df, min_pages, max_length, id_col, text_col)
    return _patterns(seq, steps, levels, max_length), _union(levels).select("doc", "line_no").distinct()


def repeated_lines(df: DataFrame, min_pages: int = 5, id_col: str = "point_id", text_col: str = "text") -> DataFrame:
    """(id, line_no) of every line that an occurrence of a frequent pattern covers, each once."""
    _, _, levels = _grow(df, min_pages, None, id_col, text_col)
    return _union(levels).select(F.col("doc").alias(id_col), "line_no").distinct()


def remove_repeated_lines(df: DataFrame, min_pages: int = 5, id_col: str = "point_id", text_col: str = "text") -> DataFrame:
    """df with text_col as it is without its repeated lines, and removed_lines, their number.

    All rows and other columns stay; a text of which all lines go becomes empty, a null text stays null."""
    marks = repeated_lines(df, min_pages, id_col, text_col).groupBy(id_col).agg(F.collect_set("line_no").alias("_gone"))
    gone = F.coalesce("_gone", F.array().cast("array<int>"))
    kept = F.filter(F.split(text_col, "\n", -1), lambda line, i: ~F.array_contains(gone, (i + 1).cast("int")))
    return df.join(marks, id_col, "left").withColumn(text_col, F.array_join(kept, "\n")).withColumn("removed_lines", F.size(gone)).drop("_gone")
