"""After retrieval: when to rerank, how to order, what is cited; and the joins that serve them."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.functions import geo
from tessella.functions import text as T


def rerank_decision(scores: DataFrame, least_top: float = 0.60, least_margin: float = 0.15, least_exact: float = 0.80, rows: int = 5) -> DataFrame:
    """scores: query_id, id, score and, optionally, exact (an exact match of the query).  (query_id, n, top1, top5,
    reason): a single result or none, fewer than `rows`, an exact match of high score among the first, a clear winner
    (high first score and enough margin to the last of `rows`); everything else is to be reranked.  Null scores count as
    0.  The defaults are the configured values; where nothing is configured least_top is 0.65."""
    score = F.coalesce("score", F.lit(0.0))
    exact = F.coalesce(F.col("exact"), F.lit(False)) if "exact" in scores.columns else F.lit(False)
    r = scores.select("query_id", "id", score.alias("score"), exact.alias("exact"))
    r = r.withColumn("r", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id")))
    first = F.col("r") <= rows
    g = r.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"), F.max(F.when(F.col("r") == 1, F.col("score"))).alias("top1"), F.min(F.when(first, F.col("score"))).alias("top5"), F.max(F.when(first, F.col("exact") & (F.col("score") >= least_exact))).alias("exact"))
    reason = F.when(F.col("n") <= 1, "single").when(F.col("n") < rows, "few").when(F.col("exact"), "exact").when((F.col("top1") >= least_top) & (F.col("top1") - F.col("top5") >= least_margin), "clear").otherwise("rerank")
    return g.select("query_id", "n", "top1", "top5", reason.alias("reason"))


def parsed_order(reply: Column, n: Column) -> Column:
    """The order that a reranker's reply gives: the JSON array of numbers in it, if need be between its first `[` and
    last `]`, without numbers outside 0 to n - 1; the given order where nothing valid is left."""
    kind = "array<string>"
    plain = T.strip_fence(F.coalesce(reply, F.lit("")))
    inner = F.regexp_extract(plain, r"(?s)(\[.*\])", 1)
    found = F.coalesce(F.from_json(plain, kind), F.from_json(inner, kind))
    whole = F.filter(found, lambda x: x.rlike("^-?[0-9]{1,9}$"))
    valid = F.filter(F.transform(whole, lambda x: x.cast("int")), lambda x: (x >= 0) & (x < n))
    given = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    return F.when(F.size(valid) > 0, valid).otherwise(given)


def apply_order(pool: DataFrame, order: DataFrame) -> DataFrame:
    """pool: query_id, idx, ...; order: query_id, indices.  Pool rows by the given order; unknown indices drop out,
    repeated ones stay."""
    return order.select("query_id", F.posexplode("indices").alias("pos", "idx")).join(pool, ["query_id", "idx"])


def cited_context(answers: DataFrame, context: DataFrame) -> DataFrame:
    """answers: query_id, answer; context: query_id, idx, ...  The context rows that the answer cites."""
    refs = answers.select("query_id", F.explode(T.cited(F.col("answer"))).alias("idx")).distinct()
    return context.join(refs, ["query_id", "idx"], "left_semi")


# The phrasings that ask what a collection holds.
OVERVIEW = (
    r"\bwhat\s+(?:data|docs?|content|knowledge)\s+(?:do\s+(?:you|we)\s+)?have\??",
    r"\bwhat\s+can\s+(?:you|we)\s+(?:answer|talk\s+about|cover)\b",
    r"\bshow\s+me\s+(?:examples|samples)\b",
    r"\bcorpus\s+(?:overview|summary)\b",
    r"\bwhat'?s\s+in\s+(?:here|this)\b",
    r"\bwhat\s+topics\s+(?:are|do\s+you)\s+have\b",
)
# The phrases that ask for a web search.
WEB = ("use web search", "search the web", "web search", "search online", "browse the web", "do a web search", "google this", "bing this")
# Pointing words, question words, words of charts, phrases and mark of answers without support.
POINTING = r"(?i)\b(it|this|that|these|those|here|there|they|them|their|its|he|she|his|her|also|then)\b"
QUESTION = r"(?i)\b(where|when|how|why|which|what)\b"
CHART = r"(?i)\b(chart|sparkline|trend|line\s*chart|bar\s*chart|time[-\s]?series|visual)\b"
UNSUPPORTED = ("the provided context does not contain", "the context provided does not contain", "provided context does not", "context does not")
NO_SOURCES = "NO_SUPPORTED_SOURCES"
# Words that no name begins with.
STOP = frozenset("""the this that it weather climate sources section lead edit n/a today now summer winter spring autumn fall
    jan feb mar apr may jun jul aug sep sept oct nov dec january february march april june july august september october
    november december""".split())
NAME = r"\b([A-Z][A-Za-z0-9+/-]*(?:\s+[A-Z][A-Za-z0-9+/-]*){1,2})\b"


def overview_match(c: Column) -> Column:
    """The words that ask what the collection holds; empty where none do."""
    return F.regexp_extract(F.coalesce(F.trim(c), F.lit("")), "(?i)(" + "|".join(OVERVIEW) + ")", 1)


def wants_overview(c: Column) -> Column:
    return overview_match(c) != ""


def _any_of(low: Column, phrases: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for phrase in phrases:
        out = out | low.contains(phrase)
    return F.coalesce(out, F.lit(False))


def wants_web(c: Column) -> Column:
    return _any_of(F.lower(c), WEB)


def wants_chart(c: Column) -> Column:
    return F.coalesce(c.rlike(CHART), F.lit(False))


def without_support(answer: Column) -> Column:
    """The answer ends in the mark of missing sources, up to blanks and quotes, or says that the context lacks it."""
    return F.coalesce(F.regexp_replace(answer, "[ \\t\\r\\n'\"]+$", "").endswith(NO_SOURCES), F.lit(False)) | _any_of(F.lower(answer), UNSUPPORTED)


def without_mark(answer: Column) -> Column:
    """The answer without the mark of missing sources: its last line goes, or the mark where there is but one line."""
    bare = F.regexp_replace(answer, r"[ \t\r\n]+$", "")
    marked = F.regexp_replace(answer, "[ \\t\\r\\n'\"]+$", "").endswith(NO_SOURCES)
    cut = F.when(bare.contains("\n"), F.regexp_replace(bare, r"\n[^\n]*$", "")).otherwise(F.regexp_replace(bare, NO_SOURCES, ""))
    return F.when(marked, F.regexp_replace(cut, r"[ \t\r\n]+$", "")).otherwise(answer)


def unsafe_svg(c: Column) -> Column:
    """Scripts, script links, foreign objects or event handlers in an SVG text."""
    return F.coalesce(F.lower(c).rlike(r"<script|javascript:|<foreignobject|\son[a-z]+\s*="), F.lit(False))


def should_rewrite(c: Column) -> Column:
    """At most seven words, or a pointing word together with a question word; an empty message isn't rewritten."""
    return F.coalesce((c != "") & ((T.words(c) <= 7) | (c.rlike(POINTING) & c.rlike(QUESTION))), F.lit(False))


def accept_rewrite(changed: Column, ambiguous: Column, confidence: Column, least: float = 0.7) -> Column:
    return F.coalesce(changed, F.lit(False)) & ~F.coalesce(ambiguous, F.lit(False)) & (F.coalesce(confidence, F.lit(0.0)) >= least)


def needs_clarification(ambiguous: Column, confidence: Column, least: float = 0.7) -> Column:
    """Asked of rewrites that aren't accepted."""
    return F.coalesce(ambiguous, F.lit(False)) | (F.coalesce(confidence, F.lit(0.0)) < least)


def proper_names(c: Column) -> Column:
    """Names of two or three capitalised words or numbers, without a leading The, in their order, each once (letter case
    aside); none that is or begins with a stop word."""
    shown = F.transform(F.regexp_extract_all(c, F.lit(NAME), F.lit(1)), lambda x: F.regexp_replace(F.regexp_replace(x, r"^[Tt]he\s+", ""), r"[\s\-–—,:;.!?]+$", ""))
    stop = F.array(*(F.lit(w) for w in sorted(STOP)))
    good = F.filter(shown, lambda x: x.rlike(r"\S\s+\S") & ~F.array_contains(stop, F.lower(F.regexp_extract(x, r"^(\S+)", 1))))
    return F.filter(good, lambda x, i: F.array_position(F.transform(good, F.lower), F.lower(x)) == i + 1)


def clarify_candidates(messages: DataFrame, last: int = 2, gathered: int = 5, most: int = 3) -> DataFrame:
    """messages: conv_id, turn, role, text.  (conv_id, candidates): names in the last user messages, the newest first;
    of the first few gathered those of the most words, then by text."""
    w = Window.partitionBy("conv_id").orderBy(F.desc("turn"))
    said = messages.where("role = 'user'").withColumn("r", F.row_number().over(w)).where(F.col("r") <= last)
    g = said.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("r", proper_names(F.coalesce("text", F.lit(""))).alias("n")))).alias("x"))
    flat = F.flatten(F.transform("x", lambda m: m["n"]))
    rows = g.select("conv_id", flat.alias("f")).select("conv_id", F.slice(F.filter("f", lambda x, i: F.array_position(F.transform("f", F.lower), F.lower(x)) == i + 1), 1, gathered).alias("f"))
    order = F.array_sort(F.transform("f", lambda x: F.struct((-F.size(F.split(x, r"\s+"))).alias("n"), x.alias("x"))))
    return rows.select("conv_id", F.slice(F.transform(order, lambda x: x["x"]), 1, most).alias("candidates"))


def nearby(places: DataFrame, sites: DataFrame, radius_km: float, most: int, types: tuple[str, ...] = (), scheduled: bool = False) -> DataFrame:
    """places and sites: id, lat, lng (and, of sites, type and scheduled_service, if the filters are used).  (place_id,
    site_id, km, miles, rank): the `most` nearest sites within the radius, ties to the smaller id.

    Sites fall into cells of a grid whose rows are as high as the radius and whose cells are about as wide, so fewer
    towards the poles.  A place looks into the cells that its circle can touch: an equi-join, exact at any longitude."""
    height = radius_km / 111.19
    band = lambda lat: F.floor((lat + 90) / height).cast("int")

    def cells(b: Column) -> Column:
        """How many cells the row has: as wide as the radius at its edge that is nearer to a pole."""
        edge = F.greatest(F.abs(b * height - 90), F.abs((b + 1) * height - 90))
        return F.greatest(F.lit(1), F.floor(360 * F.cos(F.radians(F.least(edge, F.lit(90.0)))) / height)).cast("int")

    if types:
        sites = sites.where(F.col("type").isin(*types))
    if scheduled:
        sites = sites.where("scheduled_service")
    s = sites.where("lat is not null and lng is not null").select(F.col("id").alias("site_id"), F.col("lat").alias("slat"), F.col("lng").alias("slng"))
    s = s.withColumn("band", band(F.col("slat"))).withColumn("cell", F.pmod(F.floor((F.col("slng") + 180) / 360 * cells(F.col("band"))).cast("int"), cells(F.col("band"))))
    p = places.where("lat is not null and lng is not null").select(F.col("id").alias("place_id"), F.col("lat").alias("plat"), F.col("lng").alias("plng"))
    # The widest longitude that the circle reaches; all of them where it holds a pole.
    angle = radius_km / geo.EARTH_KM
    wide = F.when(F.abs(F.radians("plat")) + angle * 1.001 < math.pi / 2, F.degrees(F.asin(F.least(F.lit(1.0), F.lit(math.sin(min(angle * 1.001, math.pi / 2))) / F.cos(F.radians("plat")))))).otherwise(180.0)
    p = p.withColumn("_d", wide).withColumn("band", F.explode(F.sequence(band(F.col("plat")) - 1, band(F.col("plat")) + 1))).withColumn("_n", cells(F.col("band")))
    at = lambda lng: F.floor((lng + 180) / 360 * F.col("_n")).cast("int")
    p = p.withColumn("_lo", at(F.col("plng") - F.col("_d"))).withColumn("_hi", F.least(at(F.col("plng") + F.col("_d")), F.col("_lo") + F.col("_n") - 1))
    p = p.withColumn("cell", F.explode(F.sequence("_lo", "_hi"))).withColumn("cell", F.pmod("cell", "_n")).drop("_d", "_n", "_lo", "_hi")
    km = geo.haversine_km(F.col("plat"), F.col("plng"), F.col("slat"), F.col("slng"))
    near = p.join(s, ["band", "cell"]).withColumn("km", F.round(km, 3)).where(F.col("km") <= radius_km)
    rank = F.row_number().over(Window.partitionBy("place_id").orderBy("km", "site_id"))
    return near.withColumn("rank", rank).where(F.col("rank") <= most).select("place_id", "site_id", "km", F.round(F.col("km") * geo.MILES_PER_KM, 2).alias("miles"), "rank")


def distinct_calls(calls: DataFrame) -> DataFrame:
    """calls: conv_id, pos, name, call_id, args.  Each call once, at its first place: by its id, else by name and
    arguments; calls without a name drop out."""
    key = F.coalesce(T.present(F.trim("call_id")), F.concat_ws("\u001f", F.trim("name"), F.coalesce("args", F.lit("null"))))
    named = calls.where(T.present(F.col("name")).isNotNull()).withColumn("_k", key)
    return named.withColumn("_r", F.row_number().over(Window.partitionBy("conv_id", "_k").orderBy("pos"))).where("_r = 1").drop("_k", "_r")


def with_new_results(found: DataFrame, web: DataFrame, most: int = 3) -> DataFrame:
    """found: query_id, pos, url; web: the same.  Found rows, then at most `most` web rows of each query whose url isn't
    among them, each url once; pos counts on."""
    first = web.withColumn("_r", F.row_number().over(Window.partitionBy("query_id", "url").orderBy("pos"))).where("_r = 1").drop("_r")
    new = first.join(found.select("query_id", "url"), ["query_id", "url"], "left_anti")
    new = new.withColumn("_r", F.row_number().over(Window.partitionBy("query_id").orderBy("pos", "url"))).where(F.col("_r") <= most)
    n = found.groupBy("query_id").agg(F.max("pos").alias("_n"))
    new = new.join(n, "query_id", "left").select("query_id", (F.coalesce("_n", F.lit(0)) + F.col("_r")).cast("int").alias("pos"), "url", F.lit("web").alias("origin"))
    return found.select("query_id", F.col("pos").cast("int").alias("pos"), "url", F.lit("index").alias("origin")).unionByName(new)


def drop_contained(blocks: DataFrame) -> DataFrame:
    """blocks: doc_id, section_index, level, pos, text.  Without blocks whose text holds that of a deeper block of the
    same section: the parent repeats the child."""
    child = blocks.select("doc_id", "section_index", F.col("level").alias("_l"), F.col("text").alias("_t")).where("_t <> ''")
    parents = blocks.join(child, ["doc_id", "section_index"]).where((F.col("_l") > F.col("level")) & F.col("text").contains(F.col("_t"))).select("doc_id", "pos").distinct()
    return blocks.join(parents, ["doc_id", "pos"], "left_anti")


def series_summary(points: DataFrame) -> DataFrame:
    """points: symbol, pos, close.  (symbol, n, first, last, change, trend) in input order."""
    g = points.where("close is not null").groupBy("symbol").agg(F.count(F.lit(1)).alias("n"), F.min_by("close", "pos").alias("first_close"), F.max_by("close", "pos").alias("last_close"))
    change = F.round(F.col("last_close") - F.col("first_close"), 2)
    return g.withColumn("change", change).withColumn("trend", F.when(change > 0, "up").when(change < 0, "down").otherwise("flat"))
