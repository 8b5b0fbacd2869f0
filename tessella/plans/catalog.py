"""Every core query by name, with the same in SQL for DuckDB where SQL can express it.  All read whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessella.functions import text as T
from tessella.functions import vector as V
from tessella.operators import analytics, chunking, documents, embedding, extraction, history, index, metering, ranking, search
from tessella.streaming import events as stream

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def chunks(spark: SparkSession, d: str, *cols: str, where: Column | str | None = None) -> DataFrame:
    """Each point once: replayed rows are identical, so the filter comes first, at the scan, and equal rows are merged
    before the shuffle."""
    c = table(spark, d, "chunks")
    if where is not None:
        c = c.where(where)
    return (c.select("point_id", *[x for x in cols if x != "point_id"]) if cols else c).distinct()


C = "WITH c AS (SELECT * FROM chunks QUALIFY row_number() OVER (PARTITION BY point_id ORDER BY point_id) = 1) "
KEY = "coalesce(CASE WHEN trim(base_url) <> '' THEN base_url END, CASE WHEN trim(url) <> '' THEN url END, CASE WHEN trim(url_lower) <> '' THEN url_lower END)"
MSG = """WITH l AS (SELECT doc_id AS conv_id, unnest(string_split(replace(text, chr(13), ''), chr(10))) AS line, unnest(range(len(string_split(replace(text, chr(13), ''), chr(10))))) AS p FROM documents WHERE text IS NOT NULL),
 s AS (SELECT conv_id, p, regexp_extract(line, '^(user|assistant): ', 1) AS role, regexp_replace(line, '^(user|assistant): ', '') AS text FROM l),
 m AS (SELECT conv_id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY p) AS INTEGER) AS turn, role, text FROM s WHERE role <> '') """
USAGE = """WITH u AS (SELECT user_id AS ns, event_id AS turn, event_type AS stage, 'model_' || (event_id % 3) AS model_key, CAST(length(props) * 40 AS BIGINT) AS input, CAST(event_id % 500 AS BIGINT) AS cached, CAST(floor(abs(value)) AS BIGINT) AS output FROM events),
 r AS (SELECT * FROM (VALUES ('model_0', 2.0, 0.5, 8.0), ('model_1', 0.15, 0.075, 0.6)) t(model_key, input_rate, cached_rate, output_rate)),
 k AS (SELECT ns, turn, stage, u.model_key, coalesce(input, 0) AS input, coalesce(cached, 0) AS cached, coalesce(output, 0) AS output,
   round(greatest(coalesce(input, 0) - coalesce(cached, 0), 0) / 1e6 * coalesce(input_rate, 0) + coalesce(cached, 0) / 1e6 * coalesce(cached_rate, 0) + coalesce(output, 0) / 1e6 * coalesce(output_rate, 0), 10) AS cost FROM u LEFT JOIN r USING (model_key)) """


def messages(spark: SparkSession, d: str) -> DataFrame:
    return history.from_transcripts(table(spark, d, "documents"))


def usage(spark: SparkSession, d: str) -> DataFrame:
    """Usage facts derived from the events."""
    e = table(spark, d, "events")
    return e.select(F.col("user_id").alias("ns"), F.col("event_id").alias("turn"), F.col("event_type").alias("stage"), F.concat(F.lit("model_"), (F.col("event_id") % 3).cast("string")).alias("model_key"), (F.length("props") * 40).cast("bigint").alias("input"), (F.col("event_id") % 500).alias("cached"), F.floor(F.abs("value")).cast("bigint").alias("output"))


def costs(spark: SparkSession, d: str) -> DataFrame:
    rates = spark.createDataFrame([("model_0", 2.0, 0.5, 8.0), ("model_1", 0.15, 0.075, 0.6)], "model_key string, input_rate double, cached_rate double, output_rate double")
    return metering.stage_costs(usage(spark, d), F.broadcast(rates))  # two rows


# Searches


def _query_vector(spark: SparkSession, d: str) -> list[float]:
    return list(table(spark, d, "embeddings").where("vec_id = 0").first()["embedding"])


@query("j1_vector_topk", "SELECT vec_id, round(list_cosine_similarity(embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 0)), 6) AS score FROM embeddings QUALIFY row_number() OVER (ORDER BY list_cosine_similarity(embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 0)) DESC, vec_id) <= 8 AND score >= 0.35")
def _(spark, d):
    return search.top_k(table(spark, d, "embeddings"), _query_vector(spark, d)).select("vec_id", F.round("score", 6).alias("score"))


@query("j1_filtered_topk", "SELECT vec_id, round(list_cosine_similarity(embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 0)), 6) AS score FROM embeddings WHERE label = 3 QUALIFY row_number() OVER (ORDER BY list_cosine_similarity(embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 0)) DESC, vec_id) <= 5")
def _(spark, d):
    return search.top_k(table(spark, d, "embeddings").where(search.payload_filter({"label": 3})), _query_vector(spark, d), 5, None).select("vec_id", F.round("score", 6).alias("score"))


@query("j1_batch_topk", """SELECT q.vec_id AS query_id, e.vec_id AS id, round(list_cosine_similarity(q.embedding::DOUBLE[], e.embedding::DOUBLE[]), 6) AS score FROM embeddings q JOIN embeddings e ON e.vec_id <> q.vec_id WHERE q.vec_id % 50 = 0
 QUALIFY row_number() OVER (PARTITION BY q.vec_id ORDER BY round(list_cosine_similarity(q.embedding::DOUBLE[], e.embedding::DOUBLE[]), 9) DESC, e.vec_id) <= 8""")
def _(spark, d):
    e = table(spark, d, "embeddings")
    return search.batch_top_k(e, e.where("vec_id % 50 = 0")).select("query_id", "id", F.round("score", 6).alias("score"))


@query("f9_vector_validity", "SELECT point_id, updated_at, coalesce(len(vector) = dim AND len(list_filter(vector, lambda x: x IS NULL OR NOT isfinite(x))) = 0, false) AS valid FROM points p JOIN (SELECT DISTINCT lower(trim(embedding_model)) AS m, dim FROM collections) c ON lower(trim(p.embedding_model)) = c.m")
def _(spark, d):
    dims = table(spark, d, "collections").select(F.lower(F.trim("embedding_model")).alias("m"), "dim").distinct()
    return table(spark, d, "points").withColumn("m", F.lower(F.trim("embedding_model"))).join(dims, "m").select("point_id", "updated_at", V.valid(F.col("vector"), F.col("dim")).alias("valid"))


@query("a23_vector_norms", "SELECT vec_id, round(sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))), 6) AS norm FROM embeddings")
def _(spark, d):
    return table(spark, d, "embeddings").select("vec_id", F.round(V.norm(F.col("embedding")), 6).alias("norm"))


@query("a21_collection_stats", "SELECT lower(trim(embedding_model)) AS model, count(*) AS points, count(DISTINCT point_id) AS distinct_points, max(len(vector)) AS dim FROM points WHERE embedding_model IS NOT NULL GROUP BY 1")
def _(spark, d):
    return table(spark, d, "points").where("embedding_model is not null").groupBy(F.lower(F.trim("embedding_model")).alias("model")).agg(F.count(F.lit(1)).alias("points"), F.count_distinct("point_id").alias("distinct_points"), F.max(F.size("vector")).cast("bigint").alias("dim"))


@query("s1_filtered_scan", C + "SELECT point_id, title, section FROM c WHERE document_type = 'pdf' AND section = 'Overview'")
def _(spark, d):
    return search.scan(table(spark, d, "chunks"), {"document_type": "pdf", "section": "Overview", "domain": None}, ["point_id", "title", "section"]).distinct()


@query("s2_get_by_field", C + "SELECT point_id, rpad(left(coalesce(title, ''), 25), 25, ' ') AS title, base_url_lower FROM c WHERE domain = 'lantern_wiki'")
def _(spark, d):
    return chunks(spark, d, "title", "base_url_lower", where="domain = 'lantern_wiki'").select("point_id", F.rpad(F.substring(F.coalesce("title", F.lit("")), 1, 25), 25, " ").alias("title"), "base_url_lower")


@query("s3_chunks_by_url", C + "SELECT a.point_id, b.n FROM c a JOIN (SELECT url_lower, count(*) AS n FROM c GROUP BY 1) b USING (url_lower)")
def _(spark, d):
    return chunks(spark, d, "url_lower", where="url_lower is not null").select("point_id", F.count(F.lit(1)).over(Window.partitionBy("url_lower")).alias("n"))


@query("s7_payload_text", "SELECT DISTINCT request_id, coalesce(nullif(content, ''), CASE WHEN length(title) > 50 THEN title END, CASE WHEN length(description) > 50 THEN description END, CASE WHEN length(url) > 50 THEN url END) AS body FROM embedding_requests")
def _(spark, d):
    r = table(spark, d, "embedding_requests")
    payload = F.create_map(*(x for c in ("content", "title", "description", "url") for x in (F.lit(c), F.col(c))))
    return r.select("request_id", T.payload_text(payload).alias("body")).distinct()


@query("s3_chunks_of_url", "SELECT DISTINCT point_id, section, text FROM chunks WHERE url_lower = (SELECT min(url_lower) FROM chunks WHERE url_lower <> '') ORDER BY point_id LIMIT 100")
def _(spark, d):
    url = table(spark, d, "chunks").where("url_lower <> ''").agg(F.min("url_lower")).first()[0] or ""
    return search.chunks_by_url(chunks(spark, d, "section", "text", "url_lower", where=F.col("url_lower") == url), url).select("point_id", "section", "text")


@query("s4_chunks_of_base_url", "SELECT DISTINCT point_id, section, text FROM chunks WHERE base_url_lower = (SELECT min(base_url_lower) FROM chunks WHERE base_url_lower <> '') ORDER BY point_id LIMIT 100")
def _(spark, d):
    url = table(spark, d, "chunks").where("base_url_lower <> ''").agg(F.min("base_url_lower")).first()[0] or ""
    return search.chunks_by_url(chunks(spark, d, "section", "text", "base_url_lower", where=F.col("base_url_lower") == url), url, by="base_url_lower").select("point_id", "section", "text")


@query("f2_lowered_filter", C + "SELECT point_id, domain FROM c WHERE document_type = 'pdf' AND domain = 'lantern_wiki'")
def _(spark, d):
    return chunks(spark, d, "domain", where=search.lowered_filter({"document_type": "PDF", "domain": "Lantern_Wiki", "section": None}))


@query("f3_any_url", C + "SELECT point_id, url FROM c WHERE url = (SELECT min(url) FROM chunks WHERE url LIKE 'https://www.%') OR url_lower = lower((SELECT min(url) FROM chunks WHERE url LIKE 'https://www.%'))")
def _(spark, d):
    url = table(spark, d, "chunks").where("url like 'https://www.%'").agg(F.min("url")).first()[0] or ""
    return chunks(spark, d, "url", where=search.any_url(url))


@query("f12_chunks_with_text", C + "SELECT point_id, length(text) AS n FROM c WHERE length(text) > 0")
def _(spark, d):
    return chunks(spark, d, "text", where="length(text) > 0").select("point_id", F.length("text").cast("bigint").alias("n"))


@query("f5_prefix", C + "SELECT point_id, url FROM c WHERE starts_with(url, 'https://www.') AND contains(url, '#')")
def _(spark, d):
    return chunks(spark, d, "url", where=F.col("url").startswith("https://www.") & F.col("url").contains("#"))


@query("f15_preview", C + "SELECT point_id, CASE WHEN length(text) > 500 THEN left(text, 500) || '…' ELSE text END AS preview FROM c")
def _(spark, d):
    return chunks(spark, d, "text").select("point_id", T.preview(F.col("text"), 500).alias("preview"))


def _phrases(c: str, phrases: tuple[str, ...]) -> str:
    return "(" + " OR ".join(f"contains(lower({c}), '{x}')" for x in phrases) + ")"


OVERVIEW_SQL = "'(?i)(" + "|".join(ranking.OVERVIEW).replace("'", "''") + ")'"


@query("f17_intents", f"SELECT doc_id, {_phrases('text', ranking.WEB)} AS web, coalesce(regexp_matches(text, '{ranking.CHART}'), false) AS chart FROM documents WHERE text IS NOT NULL")
def _(spark, d):
    return table(spark, d, "documents").where("text is not null").select("doc_id", ranking.wants_web(F.col("text")).alias("web"), ranking.wants_chart(F.col("text")).alias("chart"))


@query("f18_overview_intent", f"SELECT doc_id, regexp_extract(trim(text), {OVERVIEW_SQL}, 1) <> '' AS overview, regexp_extract(trim(text), {OVERVIEW_SQL}, 1) AS matched FROM documents WHERE text IS NOT NULL")
def _(spark, d):
    return table(spark, d, "documents").where("text is not null").select("doc_id", ranking.wants_overview(F.col("text")).alias("overview"), ranking.overview_match(F.col("text")).alias("matched"))


@query("f19_should_rewrite", MSG + f"SELECT conv_id, turn, text <> '' AND (len(regexp_extract_all(text, '[^ \\t\\n\\r]+')) <= 7 OR (regexp_matches(text, '{ranking.POINTING}') AND regexp_matches(text, '{ranking.QUESTION}'))) AS rewrite FROM m WHERE role = 'user'")
def _(spark, d):
    return messages(spark, d).where("role = 'user'").select("conv_id", "turn", ranking.should_rewrite(F.col("text")).alias("rewrite"))


@query("f21_unsupported_answers", MSG + f"SELECT conv_id, turn, ends_with(regexp_replace(text, '[ \\t\\r\\n''\"]+$', ''), 'NO_SUPPORTED_SOURCES') OR {_phrases('text', ranking.UNSUPPORTED)} AS unsupported FROM m WHERE role = 'assistant'")
def _(spark, d):
    return messages(spark, d).where("role = 'assistant'").select("conv_id", "turn", ranking.without_support(F.col("text")).alias("unsupported"))


@query("f22_unsafe_markup", "SELECT DISTINCT request_id, regexp_matches(lower(content), '<script|javascript:|<foreignobject|[ \\t\\n\\r]on[a-z]+[ \\t\\n\\r]*=') AS unsafe FROM embedding_requests WHERE content IS NOT NULL")
def _(spark, d):
    return table(spark, d, "embedding_requests").where("content is not null").select("request_id", ranking.unsafe_svg(F.col("content")).alias("unsafe")).distinct()


NAMES_SQL = "list_filter(list_transform(regexp_extract_all({c}, '" + ranking.NAME + "', 1), lambda x: regexp_replace(regexp_replace(x, '^[Tt]he\\s+', ''), '[ \\t\\n\\r\\-–—,:;.!?]+$', '')), lambda x: regexp_matches(x, '[^\\s]\\s+[^\\s]') AND NOT list_contains([" + ", ".join(f"'{w}'" for w in sorted(ranking.STOP)) + "], lower(regexp_extract(x, '^([^\\s]+)', 1))))"


@query("o6_clarify_candidates", MSG + ", u AS (SELECT conv_id, turn, text FROM m WHERE role = 'user' QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 2), f AS (SELECT conv_id, flatten(list(" + NAMES_SQL.replace("{c}", "text") + """ ORDER BY turn DESC)) AS f FROM u GROUP BY 1),
 g AS (SELECT conv_id, list_filter(f, lambda x, i: list_position(list_transform(f, lambda y: lower(y)), lower(x)) = i)[1:5] AS g FROM f),
 e AS (SELECT conv_id, unnest(g) AS x FROM g), r AS (SELECT conv_id, x, row_number() OVER (PARTITION BY conv_id ORDER BY len(regexp_split_to_array(x, '\\s+')) DESC, x) AS r FROM e)
SELECT g.conv_id, coalesce((SELECT string_agg(x, '|' ORDER BY r) FROM r WHERE r.conv_id = g.conv_id AND r <= 3), '') AS candidates FROM g""")
def _(spark, d):
    return ranking.clarify_candidates(messages(spark, d)).select("conv_id", F.array_join("candidates", "|").alias("candidates"))


@query("m3_rewrite_policy", "SELECT event_id, event_id % 3 > 0 AND event_id % 5 > 0 AND (event_id % 11) / 10.0 >= 0.7 AS accepted, NOT (event_id % 3 > 0 AND event_id % 5 > 0 AND (event_id % 11) / 10.0 >= 0.7) AND (event_id % 5 = 0 OR (event_id % 11) / 10.0 < 0.7) AS clarify FROM events")
def _(spark, d):
    e = table(spark, d, "events").select("event_id", (F.col("event_id") % 3 > 0).alias("c"), (F.col("event_id") % 5 == 0).alias("a"), (F.col("event_id") % 11 / 10.0).alias("p"))
    ok = ranking.accept_rewrite(F.col("c"), F.col("a"), F.col("p"))
    return e.select("event_id", ok.alias("accepted"), (~ok & ranking.needs_clarification(F.col("a"), F.col("p"))).alias("clarify"))


@query("f24_already_indexed", "SELECT DISTINCT r.request_id, EXISTS (SELECT 1 FROM chunks c WHERE c.url_lower = lower(r.url)) AS indexed FROM embedding_requests r WHERE r.url IS NOT NULL")
def _(spark, d):
    have = table(spark, d, "chunks").select(F.col("url_lower").alias("u")).distinct().withColumn("indexed", F.lit(True))
    r = table(spark, d, "embedding_requests").where("url is not null").select("request_id", F.lower("url").alias("u")).distinct()
    return r.join(have, "u", "left").select("request_id", F.coalesce("indexed", F.lit(False)).alias("indexed"))


# The index

LATEST = "SELECT * FROM points QUALIFY row_number() OVER (PARTITION BY point_id ORDER BY updated_at DESC NULLS LAST) = 1"


@query("d1_upsert", f"WITH old AS (SELECT point_id, embedding_model, updated_at FROM points WHERE point_id % 2 = 0 QUALIFY row_number() OVER (PARTITION BY point_id ORDER BY updated_at NULLS FIRST) = 1), new AS (SELECT point_id, embedding_model, updated_at FROM ({LATEST})) SELECT point_id, updated_at FROM old WHERE point_id NOT IN (SELECT point_id FROM new) UNION ALL SELECT point_id, updated_at FROM new")
def _(spark, d):
    p = table(spark, d, "points").select("point_id", "updated_at")
    later = F.coalesce(F.col("updated_at") >= F.lit("2025-01-15").cast("timestamp"), F.lit(False))
    old = p.where(~later).groupBy("point_id").agg(F.max("updated_at").alias("updated_at"))
    return index.upsert(old, p.where(later), "point_id", "updated_at")


@query("d2_point_ids", C + """, a AS (SELECT point_id, url, chunk_index, sha1(unhex('6ba7b8119dad11d180b400c04fd430c8') || encode(url)) AS h FROM c WHERE url IS NOT NULL AND chunk_index IS NOT NULL),
 b AS (SELECT point_id, chunk_index, h[1:12] || '5' || h[14:16] || substr('89ab', CAST(CAST('0x' || h[17:17] AS INTEGER) % 4 + 1 AS INTEGER), 1) || h[18:32] AS ns FROM a),
 e AS (SELECT point_id, sha1(unhex(ns) || encode(CAST(chunk_index AS VARCHAR))) AS h FROM b)
SELECT point_id, h[1:8] || '-' || h[9:12] || '-5' || h[14:16] || '-' || substr('89ab', CAST(CAST('0x' || h[17:17] AS INTEGER) % 4 + 1 AS INTEGER), 1) || h[18:20] || '-' || h[21:32] AS uuid FROM e""")
def _(spark, d):
    return chunks(spark, d, "url", "chunk_index", where="url is not null and chunk_index is not null").select("point_id", T.point_id(F.col("url"), F.col("chunk_index")).alias("uuid"))


@query("d4_delete_by_base_url", C + f", k AS (SELECT {KEY} AS document, count(*) AS n FROM c GROUP BY 1 HAVING count(*) >= 5) SELECT point_id, {KEY} AS document FROM c WHERE {KEY} IS NULL OR {KEY} NOT IN (SELECT document FROM k WHERE document IS NOT NULL)")
def _(spark, d):
    c = chunks(spark, d, "url", "base_url", "url_lower").select("point_id", analytics.document_key().alias("document"))
    big = c.where("document is not null").groupBy("document").agg(F.count(F.lit(1)).alias("n")).where("n >= 5")
    return index.delete_ids(c, big, "document").select("point_id", "document")


@query("d7_delete_by_field", C + "SELECT point_id, document_type FROM c WHERE document_type IS NULL OR lower(document_type) <> 'pdf'")
def _(spark, d):
    return index.delete_where(table(spark, d, "chunks"), F.lower("document_type") == "pdf").select("point_id", "document_type").distinct()


@query("d9_update_payload", C + "SELECT point_id, CASE WHEN lower(document_type) = 'pdf' THEN 'paper' ELSE content_type END AS content_type FROM c")
def _(spark, d):
    return index.update_where(chunks(spark, d, "document_type", "content_type"), F.lower("document_type") == "pdf", "content_type", F.lit("paper")).select("point_id", "content_type")


BACKFILL = C + ", b AS (SELECT point_id, base_url, base_url_lower, string_split(lower(trim(coalesce(url_lower, url))), '#')[1] AS base FROM c), n AS (SELECT *, (base IS NOT NULL AND (base_url IS NULL OR trim(base_url) = '' OR base_url_lower IS NULL OR trim(base_url_lower) = '')) AS needs FROM b) "


@query("d10_backfill", BACKFILL + "SELECT point_id, CASE WHEN needs THEN base ELSE base_url END AS base_url, CASE WHEN needs THEN base ELSE base_url_lower END AS base_url_lower FROM n")
def _(spark, d):
    return index.backfill_base_url(chunks(spark, d, "url", "url_lower", "base_url", "base_url_lower")).select("point_id", "base_url", "base_url_lower")


@query("d10_backfill_summary", BACKFILL + "SELECT count(*) AS scanned, count(*) FILTER (WHERE needs) AS needs, count(*) FILTER (WHERE needs) AS updated FROM n")
def _(spark, d):
    return index.backfill_summary(chunks(spark, d, "url", "url_lower", "base_url", "base_url_lower"))


@query("d11_clone", C + "SELECT point_id, domain FROM c ORDER BY point_id OFFSET 100")
def _(spark, d):
    return index.clone_points(chunks(spark, d, "domain"), "point_id", 100).select("point_id", "domain")


@query("d14_export", "WITH p AS (SELECT point_id, vector FROM (" + LATEST + ")), " + C[len("WITH "):] + "SELECT p.point_id AS id, coalesce(len(vector), -1) AS elements, title, section, url FROM p JOIN c USING (point_id) WHERE vector IS NULL OR len(list_filter(vector, lambda x: x IS NULL OR NOT isfinite(x))) = 0")
def _(spark, d):
    """The lines of the export, read again: JSON has no numbers that aren't finite."""
    p = table(spark, d, "points").groupBy("point_id").agg(F.max_by("vector", F.struct("updated_at", F.xxhash64("vector"))).alias("vector"))
    p = p.where(F.col("vector").isNull() | ~F.exists("vector", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))))
    lines = index.export_json(p.join(chunks(spark, d, "title", "section", "url"), "point_id"), "point_id", ["title", "section", "url"])
    x = F.from_json("value", "id bigint, vector array<float>, payload struct<title string, section string, url string>")
    return lines.select(x.alias("x")).select("x.id", F.when(F.col("x.vector").isNull(), -1).otherwise(F.size("x.vector")).cast("bigint").alias("elements"), "x.payload.title", "x.payload.section", "x.payload.url")


@query("d4_delete_by_url", C + "SELECT count(*) FILTER (WHERE base_url_lower = (SELECT min(base_url_lower) FROM chunks WHERE base_url_lower <> '')) AS deleted FROM c")
def _(spark, d):
    url = table(spark, d, "chunks").where("base_url_lower <> ''").agg(F.min("base_url_lower")).first()[0]
    return index.counted_delete(chunks(spark, d, "base_url_lower"), F.col("base_url_lower") == F.lit(url))[1]


@query("d10_backfill_limited", "WITH " + BACKFILL[len("WITH "):] + ", l AS (SELECT max(point_id) AS l FROM (SELECT point_id FROM n WHERE needs ORDER BY point_id LIMIT 50)) SELECT point_id, CASE WHEN needs AND point_id <= l THEN base ELSE base_url END AS base_url, needs AS needs_update FROM n, l")
def _(spark, d):
    return index.backfill_base_url(chunks(spark, d, "url", "url_lower", "base_url", "base_url_lower"), max_updates=50).select("point_id", "base_url", "needs_update")


@query("d13_clone_report", C + "SELECT count(*) AS source_points, count(*) - 100 AS target_points, false AS complete FROM c")
def _(spark, d):
    c = chunks(spark, d, "domain")
    return index.clone_report(c, index.clone_points(c, "point_id", 100))


@query("d12_copy_collection", "SELECT collection_name, dim, distance FROM collections UNION ALL SELECT 'copy', dim, distance FROM collections WHERE collection_name = (SELECT min(collection_name) FROM collections)")
def _(spark, d):
    c = table(spark, d, "collections")
    return index.copied_collection(c, c.agg(F.min("collection_name")).first()[0], "copy").select("collection_name", "dim", "distance")


# Analytics


@query("a1_counts_by_url", C + "SELECT url_lower, count(*) AS n FROM c WHERE url_lower IS NOT NULL GROUP BY 1")
def _(spark, d):
    return chunks(spark, d, "url_lower", where="url_lower is not null").groupBy("url_lower").agg(F.count(F.lit(1)).alias("n"))


@query("a2_list_documents", C + f"SELECT {KEY} AS document, count(*) AS chunks, arg_min(title, CASE WHEN trim(title) <> '' THEN point_id END) AS title, max(updated_at) AS updated_at FROM c GROUP BY 1")
def _(spark, d):
    return analytics.list_documents(chunks(spark, d, "title", "url", "base_url", "url_lower", "updated_at"))


@query("a3_list_chunks", C + f"SELECT point_id, {KEY} AS document, coalesce(title, '') AS title FROM c WHERE contains({KEY}, 'guide')")
def _(spark, d):
    return chunks(spark, d, "title", "url", "base_url", "url_lower", where=analytics.document_key().contains("guide")).select("point_id", analytics.document_key().alias("document"), F.coalesce("title", F.lit("")).alias("title"))


@query("a4_first_seen", C + "SELECT base_url, left(arg_min(title, point_id), 30) AS title FROM c WHERE base_url IS NOT NULL GROUP BY 1")
def _(spark, d):
    return analytics.first_seen(chunks(spark, d, "base_url", "title"), "base_url", "point_id", "title", 30)


@query("a5_analyse_chunks", C + f"SELECT {KEY} AS document, count(*) AS chunks, count(DISTINCT section) AS section_distinct, min(section) AS section_min, max(section) AS section_max, count(DISTINCT chunk_index) AS chunk_index_distinct, min(chunk_index) AS chunk_index_min, max(chunk_index) AS chunk_index_max FROM c GROUP BY 1")
def _(spark, d):
    return analytics.analyse_chunks(chunks(spark, d, "url", "base_url", "url_lower", "section", "chunk_index"), ["section", "chunk_index"])


@query("a7_sections", C + "SELECT DISTINCT coalesce(section, 'Lead') AS section FROM c")
def _(spark, d):
    return chunks(spark, d, "section").select(F.coalesce("section", F.lit("Lead")).alias("section")).distinct()


@query("a22_debug_index", C + "SELECT point_id, CAST(row_number() OVER (PARTITION BY domain ORDER BY coalesce(section_index, 0), coalesce(chunk_index, 0), point_id) AS INTEGER) AS pos FROM c WHERE domain IS NOT NULL")
def _(spark, d):
    c = chunks(spark, d, "domain", "section_index", "chunk_index", where="domain is not null")
    return analytics.ranked(c, "domain", [F.coalesce("section_index", F.lit(0)), F.coalesce("chunk_index", F.lit(0))], "point_id").select("point_id", "pos")


@query("a20_text_bytes", C + "SELECT domain, CAST(sum(octet_length(encode(text))) AS BIGINT) AS bytes FROM c GROUP BY 1")
def _(spark, d):
    return chunks(spark, d, "domain", "text").groupBy("domain").agg(F.sum(F.octet_length("text")).alias("bytes"))


@query("a11_collapse_sources", C + """, x AS (SELECT CAST(row_number() OVER (PARTITION BY domain ORDER BY point_id) AS INTEGER) AS idx, base_url AS url, coalesce(section, '') AS section, coalesce(subsection, '') AS subsection FROM c WHERE domain IS NOT NULL),
 g AS (SELECT url, section, subsection, list_sort(list_distinct(list(idx))) AS ids FROM x WHERE trim(url) <> '' GROUP BY ALL)
SELECT ids[1] AS first_idx, '[' || array_to_string(ids, ', ') || '] ' || url || CASE WHEN section <> '' OR subsection <> '' THEN ' (Section: ' || section || CASE WHEN section <> '' AND subsection <> '' THEN ' > ' ELSE '' END || subsection || ')' ELSE '' END AS entry FROM g""")
def _(spark, d):
    c = chunks(spark, d, "base_url", "section", "subsection", "domain", where="domain is not null")
    return analytics.collapse_sources(analytics.ranked(c, "domain", [], "point_id").select(F.col("pos").alias("idx"), F.col("base_url").alias("url"), "section", "subsection"))


@query("w9_stratified_sample", C + f""", k AS (SELECT DISTINCT {KEY} AS key FROM c WHERE {KEY} IS NOT NULL), h AS (SELECT key, regexp_replace(regexp_extract(lower(key), '^[a-z][a-z0-9+.\\-]*://([^/?#]*)', 1), '^.*@|:[0-9]*$', '') AS stratum, sha256('seed' || chr(31) || key) AS o FROM k),
 r AS (SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY o, key) AS r FROM h) SELECT key, stratum FROM r WHERE r <= 5 ORDER BY o, key LIMIT 200""")
def _(spark, d):
    c = table(spark, d, "chunks").select("url", "base_url", "url_lower")
    return analytics.stratified_sample(c.where(analytics.document_key().isNotNull()), analytics.document_key(), T.host(analytics.document_key()), 5, 200, "seed")


@query("a13_batch_summary", "SELECT count(*) AS items, count(*) FILTER (WHERE content <> '') AS success, count(*) FILTER (WHERE content IS NULL OR content = '') AS failed, CAST(sum(coalesce(total_chunks, 0)) AS BIGINT) AS chunks, CAST(sum(coalesce(length(content) // 4, 0)) AS BIGINT) AS tokens, round(sum(coalesce(length(content) / 1e6, 0)), 6) AS cost FROM (SELECT DISTINCT * FROM embedding_requests)")
def _(spark, d):
    r = table(spark, d, "embedding_requests").distinct()
    return metering.batch_summary(r.select(F.when(F.col("content") != "", "ok").otherwise("error").alias("status"), F.lit(None).cast("int").alias("indexed"), F.col("total_chunks").alias("planned"), F.floor(F.length("content") / 4).cast("bigint").alias("tokens"), (F.length("content") / 1e6).alias("cost")))


@query("a14_estimate", C + ", r AS (SELECT base_url, greatest(1, length(coalesce(text, '')) // 4) AS t FROM c WHERE base_url IS NOT NULL QUALIFY row_number() OVER (PARTITION BY base_url ORDER BY point_id) <= 500) SELECT base_url, count(*) AS planned, CAST(sum(t) AS BIGINT) AS tokens, round(sum(t) * 0.02 / 1e6, 8) AS cost FROM r GROUP BY 1")
def _(spark, d):
    return metering.estimate(chunks(spark, d, "base_url", "text"), "base_url", "point_id", "text", 500, 0.02)


# Tokens and costs


@query("a8_stage_costs", USAGE + "SELECT ns, turn, stage, model_key, input, cached, output, cost FROM k")
def _(spark, d):
    return costs(spark, d)


@query("a9_turn_totals", USAGE + "SELECT ns, turn, CAST(sum(input) AS BIGINT) AS input, CAST(sum(output) AS BIGINT) AS output, CAST(sum(CASE WHEN stage = 'embedding' THEN input ELSE 0 END) AS BIGINT) AS embedding, round(sum(cost), 10) AS cost FROM k GROUP BY 1, 2")
def _(spark, d):
    return metering.turn_totals(costs(spark, d))


@query("a10_running_totals", USAGE + ", t AS (SELECT ns, turn, sum(input) AS input, sum(output) AS output, round(sum(cost), 10) AS cost FROM k GROUP BY 1, 2) SELECT ns, turn, CAST(sum(input + output) OVER w AS BIGINT) AS tokens, CAST(round(sum(cost) OVER w * 1e10) AS BIGINT) AS cost_e10 FROM t WINDOW w AS (PARTITION BY ns ORDER BY turn ROWS UNBOUNDED PRECEDING)")
def _(spark, d):
    return metering.running_totals(metering.turn_totals(costs(spark, d))).select("ns", "turn", "tokens", F.round(F.col("cost") * 1e10).cast("bigint").alias("cost_e10"))


COST_PARTS = USAGE + """, p AS (SELECT ns, turn, stage, u.model_key, coalesce(input, 0) AS input, coalesce(cached, 0) AS cached, coalesce(output, 0) AS output,
  CASE WHEN stage = 'embedding' THEN input ELSE greatest(input - cached, 0) END / 1e6 * coalesce(input_rate, 0) AS cp, cached / 1e6 * coalesce(cached_rate, 0) AS cc, output / 1e6 * coalesce(output_rate, 0) AS co FROM u LEFT JOIN r USING (model_key)),
 q AS (SELECT ns, turn, stage, model_key, input, cached, output, round(cp, 10) AS cost_prompt, round(cc, 10) AS cost_cached, round(co, 10) AS cost_completion, round(cp + cc + co, 10) AS cost_total, CASE WHEN stage = 'embedding' THEN round(cp, 10) ELSE round(cp + cc + co, 10) END AS cost FROM p) """
RATES = [("model_0", 2.0, 0.5, 8.0), ("model_1", 0.15, 0.075, 0.6)]


def _parts(spark: SparkSession, d: str) -> DataFrame:
    rates = spark.createDataFrame(RATES, "model_key string, input_rate double, cached_rate double, output_rate double")
    return metering.cost_parts(usage(spark, d), F.broadcast(rates))  # two rows


@query("a8_cost_parts", COST_PARTS + "SELECT * FROM q")
def _(spark, d):
    return _parts(spark, d)


@query("a9_turn_split", COST_PARTS + "SELECT ns, turn, CAST(sum(CASE WHEN stage = 'embedding' THEN input ELSE 0 END) AS BIGINT) AS embedding, CAST(sum(CASE WHEN stage = 'embedding' THEN 0 ELSE input END) AS BIGINT) AS llm_input, CAST(sum(CASE WHEN stage = 'embedding' THEN 0 ELSE output END) AS BIGINT) AS llm_output, CAST(sum(input + CASE WHEN stage = 'embedding' THEN 0 ELSE output END) AS BIGINT) AS tokens, round(sum(cost), 10) AS cost FROM q GROUP BY 1, 2")
def _(spark, d):
    return metering.turn_split(_parts(spark, d))


@query("a10_conversation_totals", COST_PARTS + "SELECT ns, CAST(sum(CASE WHEN stage = 'embedding' THEN input ELSE 0 END) AS BIGINT) AS embedding, CAST(sum(CASE WHEN stage = 'embedding' THEN 0 ELSE input END) AS BIGINT) AS llm_input, CAST(sum(CASE WHEN stage = 'embedding' THEN 0 ELSE output END) AS BIGINT) AS llm_output, CAST(sum(input + CASE WHEN stage = 'embedding' THEN 0 ELSE output END) AS BIGINT) AS tokens, round(sum(cost), 8) AS cost FROM q GROUP BY 1")
def _(spark, d):
    return metering.conversation_totals(metering.turn_split(_parts(spark, d)))


@query("a20_idle_eviction", "WITH l AS (SELECT user_id, max(ts) AS l FROM events GROUP BY 1), g AS (SELECT e.* FROM events e JOIN l USING (user_id) WHERE epoch_us((SELECT max(ts) FROM events)) - epoch_us(l) > 3600000000) SELECT count(DISTINCT user_id) AS namespaces_cleared, count(*) AS summaries_removed, CAST(coalesce(sum(octet_length(encode(props))), 0) AS BIGINT) AS reclaimed_bytes FROM g")
def _(spark, d):
    e = table(spark, d, "events").select(F.col("user_id").alias("ns"), F.col("event_id").alias("key"), F.col("props").alias("text"), F.col("ts").cast("timestamp").alias("last_seen"))
    return analytics.evict_idle(e, F.lit(e.agg(F.max("last_seen")).first()[0]))[1]


@query("a21_collections", "SELECT k.collection_name, k.dim, k.distance, count(DISTINCT c.point_id) AS points FROM collections k LEFT JOIN chunks c ON c.domain = k.domain GROUP BY 1, 2, 3")
def _(spark, d):
    n = chunks(spark, d, "domain", where="domain is not null").groupBy("domain").agg(F.count(F.lit(1)).alias("n"))
    return table(spark, d, "collections").join(n, "domain", "left").select("collection_name", "dim", "distance", F.coalesce("n", F.lit(0)).alias("points"))


# Conversations


@query("w1_token_budget", MSG + ", u AS (SELECT conv_id, turn, role, CAST(sum(len(regexp_extract_all(text, '[^ \\t\\n\\r]+'))) OVER (PARTITION BY conv_id ORDER BY turn DESC ROWS UNBOUNDED PRECEDING) AS BIGINT) AS used FROM m) SELECT * FROM u WHERE used <= 60")
def _(spark, d):
    return history.within_budget(messages(spark, d), 60)


@query("w2_split_history", MSG + ", r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS r FROM m) SELECT conv_id, turn, role, CASE WHEN r <= 2 THEN 'verbatim' ELSE 'summary' END AS band FROM r WHERE r <= 6")
def _(spark, d):
    return history.split_for_prompt(messages(spark, d), 1, 2)


@query("w4_rollover", MSG + ", n AS (SELECT conv_id, max(turn) AS n FROM m GROUP BY 1), k AS (SELECT conv_id, n, unnest(range((n - 1) // 4 + 1)) AS k FROM n) SELECT conv_id, CAST(k AS INTEGER) AS chunk, CAST(greatest(1, 4 * k - 1) AS INTEGER) AS first_turn, CAST(least(4 * k + 4, n) AS INTEGER) AS last_turn FROM k")
def _(spark, d):
    return history.rollover_chunks(messages(spark, d), 2)


@query("w5_token_rollover", "WITH RECURSIVE " + MSG[len("WITH "):] + """, r AS (SELECT conv_id, turn, CAST(length(text) AS BIGINT) AS chars, 0 AS chunk FROM m WHERE turn = 1
 UNION ALL SELECT m.conv_id, m.turn, CASE WHEN r.chars // 4 >= 100 THEN 0 ELSE r.chars END + length(m.text), r.chunk + CASE WHEN r.chars // 4 >= 100 THEN 1 ELSE 0 END FROM r JOIN m ON m.conv_id = r.conv_id AND m.turn = r.turn + 1)
SELECT conv_id, turn, CAST(chunk AS INTEGER) AS chunk FROM r""")
def _(spark, d):
    return history.token_rollover(messages(spark, d), 100)


@query("w3_summary_prompt", MSG + """, w AS (SELECT *, regexp_extract_all(text, '[^ \\t\\n\\r]+') AS w, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS r FROM m),
 y AS (SELECT *, CASE WHEN r = 1 AND len(w) + 2 > 52 THEN role || ': ' || array_to_string(w[1:50], ' ') || '…' ELSE role || ': ' || text END AS line FROM w),
 z AS (SELECT *, sum(len(regexp_extract_all(line, '[^ \\t\\n\\r]+')) + 1) OVER (PARTITION BY conv_id ORDER BY turn DESC ROWS UNBOUNDED PRECEDING) AS used FROM y)
SELECT conv_id, 'Summarize the following conversation in a few sentences:' || chr(10) || chr(10) || string_agg(line, chr(10) ORDER BY turn) AS prompt, CAST(count(*) AS INTEGER) AS kept FROM z WHERE r = 1 OR used <= 52 GROUP BY 1""")
def _(spark, d):
    return history.summary_prompt(messages(spark, d), 60)


@query("w_history_key", MSG + "SELECT conv_id, sha1(string_agg(role || chr(31) || text, chr(30) ORDER BY turn)) AS key FROM m GROUP BY 1")
def _(spark, d):
    return history.history_key(messages(spark, d))


@query("j5_cited_context", MSG + """, a AS (SELECT conv_id, unnest(list_distinct(list_transform(flatten(list_transform(regexp_extract_all(text, '\\[([0-9]+(?:\\s*,\\s*[0-9]+)*)\\]', 1), lambda g: regexp_split_to_array(g, '\\s*,\\s*'))), lambda x: CAST(x AS INTEGER)))) AS idx FROM m WHERE role = 'assistant')
SELECT DISTINCT a.conv_id AS query_id, a.idx FROM a JOIN m ON m.conv_id = a.conv_id AND m.turn = a.idx""")
def _(spark, d):
    m = messages(spark, d)
    return ranking.cited_context(m.where("role = 'assistant'").select(F.col("conv_id").alias("query_id"), F.col("text").alias("answer")), m.select(F.col("conv_id").alias("query_id"), F.col("turn").alias("idx"))).distinct()


# Chunking


@query("w11_word_windows", """WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(text, '[ \\t\\n\\r]+'), lambda x: x <> '') AS w FROM documents WHERE text IS NOT NULL),
 s AS (SELECT doc_id, w, unnest(range(0, len(w), 40)) AS s, CAST((len(w) + 39) // 40 AS INTEGER) AS total_chunks FROM w WHERE len(w) > 0)
SELECT doc_id, CAST(s // 40 AS INTEGER) AS chunk_index, total_chunks, array_to_string(w[s + 1:s + 50], ' ') AS text, CAST(least(50, len(w) - s) AS INTEGER) AS words FROM s""")
def _(spark, d):
    return chunking.word_windows(table(spark, d, "documents"), "doc_id", "text", 50, 10)


@query("w12_table_batches", """WITH n AS (SELECT o_custkey % 50 AS table_id, row_number() OVER (PARTITION BY o_custkey % 50 ORDER BY o_orderkey) AS row_no, CAST(o_orderkey AS VARCHAR) || ' | ' || o_orderstatus AS line FROM orders),
 g AS (SELECT table_id, CAST((row_no - 1) // 12 AS INTEGER) AS batch, string_agg(line, chr(10) ORDER BY row_no) AS body FROM n GROUP BY 1, 2) SELECT table_id, batch, 'order | status' || chr(10) || body AS text FROM g""")
def _(spark, d):
    o = table(spark, d, "orders").select((F.col("o_custkey") % 50).alias("table_id"), "o_orderkey", F.concat(F.col("o_orderkey").cast("string"), F.lit(" | "), "o_orderstatus").alias("line"))
    rows = o.select("table_id", F.row_number().over(Window.partitionBy("table_id").orderBy("o_orderkey")).alias("row_no"), "line")
    heads = o.select("table_id").distinct().select("table_id", F.lit(0).alias("row_no"), F.lit("order | status").alias("line"))
    return chunking.table_batches(rows.unionByName(heads))


@query("w6_section_walk")
def _(spark, d):
    return chunking.section_walk(table(spark, d, "documents"), "doc_id", "text")


@query("w8_renumber", C + f", k AS (SELECT point_id, {KEY} AS document, coalesce(section_index, 0) AS s, coalesce(chunk_index, 0) AS i FROM c) SELECT point_id, CAST(row_number() OVER (PARTITION BY document ORDER BY s, i, point_id) - 1 AS INTEGER) AS new_index, count(*) OVER (PARTITION BY document) AS new_total FROM k WHERE document IS NOT NULL")
def _(spark, d):
    c = chunks(spark, d, "url", "base_url", "url_lower", "section_index", "chunk_index").select("point_id", analytics.document_key().alias("document"), F.coalesce("section_index", F.lit(0)).alias("s"), F.coalesce("chunk_index", F.lit(0)).alias("i")).where("document is not null")
    return chunking.number_chunks(c, "document", "s", "i", "point_id").select("point_id", "new_index", "new_total")


@query("w13_chunk_cap", C + f", k AS (SELECT point_id, {KEY} AS document FROM c) SELECT point_id, document FROM k WHERE document IS NOT NULL QUALIFY row_number() OVER (PARTITION BY document ORDER BY point_id) <= 3")
def _(spark, d):
    c = chunks(spark, d, "url", "base_url", "url_lower").select("point_id", analytics.document_key().alias("document")).where("document is not null")
    return chunking.capped(c, "document", "point_id", 3)


@query("w14_token_guard", C + f", k AS (SELECT point_id, {KEY} AS document, greatest(1, length(text) // 4) AS t FROM c WHERE text IS NOT NULL), u AS (SELECT point_id, document, CAST(sum(t) OVER (PARTITION BY document ORDER BY point_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS used FROM k WHERE document IS NOT NULL) SELECT * FROM u WHERE used <= 400")
def _(spark, d):
    c = chunks(spark, d, "url", "base_url", "url_lower", "text", where="text is not null").select("point_id", analytics.document_key().alias("document"), "text").where("document is not null")
    return chunking.within_tokens(c, "document", "point_id", "text", 400).select("point_id", "document", "used")


@query("x9_anchored_urls", C + """, n AS (SELECT point_id, base_url AS url, coalesce(CASE WHEN trim(subsection) <> '' THEN subsection END, CASE WHEN section <> 'Lead' AND trim(section) <> '' THEN section END) AS name FROM c WHERE base_url IS NOT NULL)
SELECT point_id, CASE WHEN contains(url, '#') OR name IS NULL THEN url ELSE url || '#' || coalesce(nullif(regexp_replace(regexp_replace(lower(name), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), ''), 'section') END AS url FROM n""")
def _(spark, d):
    return chunks(spark, d, "base_url", "section", "subsection", where="base_url is not null").select("point_id", chunking.anchored_url(F.col("base_url"), F.col("section"), F.col("subsection")).alias("url"))


@query("f_normalised_text")
def _(spark, d):
    return table(spark, d, "documents").select("doc_id", T.normalise(F.col("text")).alias("text"), T.tokens(F.col("text")).alias("tokens"))


@query("f_urls", C + "SELECT point_id, regexp_replace(url, '#.*$', '') AS page, regexp_replace(regexp_extract(lower(url), '^[a-z][a-z0-9+.\\-]*://([^/?#]*)', 1), '^.*@|:[0-9]*$', '') AS host, sha256(url) AS digest FROM c WHERE url IS NOT NULL")
def _(spark, d):
    return chunks(spark, d, "url", where="url is not null").select("point_id", T.strip_fragment(F.col("url")).alias("page"), T.host(F.col("url")).alias("host"), F.sha2("url", 256).alias("digest"))


# Joins and ranking


@query("w10_rerank_decision", """WITH s AS (SELECT o_custkey AS query_id, o_orderkey AS id, round(o_totalprice / 500000.0, 8) AS score, o_orderpriority = '1-URGENT' AS exact FROM orders), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS r FROM s),
 g AS (SELECT query_id, count(*) AS n, max(CASE WHEN r = 1 THEN score END) AS top1, min(CASE WHEN r <= 5 THEN score END) AS top5, coalesce(max(CASE WHEN r <= 5 AND exact AND score >= 0.8 THEN 1 END), 0) = 1 AS exact FROM r GROUP BY 1)
SELECT query_id, n, top1, top5, CASE WHEN n <= 1 THEN 'single' WHEN n < 5 THEN 'few' WHEN exact THEN 'exact' WHEN top1 >= 0.60 AND top1 - top5 >= 0.15 THEN 'clear' ELSE 'rerank' END AS reason FROM g""")
def _(spark, d):
    return ranking.rerank_decision(table(spark, d, "orders").select(F.col("o_custkey").alias("query_id"), F.col("o_orderkey").alias("id"), F.round(F.col("o_totalprice") / 500000.0, 8).alias("score"), (F.col("o_orderpriority") == "1-URGENT").alias("exact")))


PLACES = "SELECT c_custkey AS id, (c_custkey * 7919 % 16000) / 100.0 - 80 AS lat, (c_custkey * 104729 % 36000) / 100.0 - 180 AS lng FROM customer"


@query("j2_nearby", f"""WITH p AS ({PLACES}), s AS (SELECT s_suppkey AS id, (s_suppkey * 7907 % 16000) / 100.0 - 80 AS lat, (s_suppkey * 104723 % 36000) / 100.0 - 180 AS lng FROM supplier),
 k AS (SELECT p.id AS place_id, s.id AS site_id, round(2 * 6371.0088 * asin(sqrt(least(1.0, pow(sin(radians(s.lat - p.lat) / 2), 2) + cos(radians(p.lat)) * cos(radians(s.lat)) * pow(sin(radians(s.lng - p.lng) / 2), 2)))), 3) AS km FROM p, s)
SELECT place_id, site_id, km, round(km * 0.621371, 2) AS miles, CAST(row_number() OVER (PARTITION BY place_id ORDER BY km, site_id) AS INTEGER) AS rank FROM k WHERE km <= 500 QUALIFY rank <= 5""")
def _(spark, d):
    place = lambda t, k, a, b: table(spark, d, t).select(F.col(k).alias("id"), ((F.col(k) * a % 16000) / 100.0 - 80).alias("lat"), ((F.col(k) * b % 36000) / 100.0 - 180).alias("lng"))
    return ranking.nearby(place("customer", "c_custkey", 7919, 104729), place("supplier", "s_suppkey", 7907, 104723), 500.0, 5)


@query("j3_new_urls", "SELECT DISTINCT lower(r.url) AS url FROM embedding_requests r WHERE r.url IS NOT NULL AND lower(r.url) NOT IN (SELECT url_lower FROM chunks WHERE url_lower IS NOT NULL)")
def _(spark, d):
    have = table(spark, d, "chunks").select(F.col("url_lower").alias("url"))
    return table(spark, d, "embedding_requests").where("url is not null").select(F.lower("url").alias("url")).distinct().join(have, "url", "left_anti")


@query("j4_apply_order", "WITH p AS (SELECT l_orderkey AS query_id, l_linenumber AS idx, l_partkey FROM lineitem), o AS (SELECT o_orderkey AS query_id, [3, 1, 1, 99] AS indices FROM orders), x AS (SELECT query_id, unnest(indices) AS idx, unnest(range(4)) AS pos FROM o) SELECT query_id, CAST(pos AS INTEGER) AS pos, x.idx, l_partkey FROM x JOIN p USING (query_id, idx)")
def _(spark, d):
    pool = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("query_id"), F.col("l_linenumber").alias("idx"), "l_partkey")
    order = table(spark, d, "orders").select(F.col("o_orderkey").alias("query_id"), F.array(*(F.lit(k) for k in (3, 1, 1, 99))).alias("indices"))
    return ranking.apply_order(pool, order).select("query_id", "pos", "idx", "l_partkey")


@query("j7_domain_default", C + "SELECT point_id, coalesce(k.collection_name, 'kb_default') AS collection FROM c LEFT JOIN collections k ON k.domain = c.domain")
def _(spark, d):
    known = table(spark, d, "collections").select("domain", "collection_name")
    return chunks(spark, d, "domain").join(known, "domain", "left").select("point_id", F.coalesce("collection_name", F.lit("kb_default")).alias("collection"))


@query("j8_drop_contained", C + ", b AS (SELECT base_url AS doc_id, coalesce(section_index, 0) AS section_index, CASE WHEN subsection IS NULL THEN 2 ELSE 3 END AS level, point_id AS pos, text FROM c WHERE base_url IS NOT NULL AND text IS NOT NULL) SELECT doc_id, pos FROM b x WHERE NOT EXISTS (SELECT 1 FROM b y WHERE y.doc_id = x.doc_id AND y.section_index = x.section_index AND y.level > x.level AND y.text <> '' AND contains(x.text, y.text))")
def _(spark, d):
    c = chunks(spark, d, "base_url", "section_index", "subsection", "text", where="base_url is not null and text is not null")
    blocks = c.select(F.col("base_url").alias("doc_id"), F.coalesce("section_index", F.lit(0)).alias("section_index"), F.when(F.col("subsection").isNull(), 2).otherwise(3).alias("level"), F.col("point_id").alias("pos"), "text")
    return ranking.drop_contained(blocks).select("doc_id", "pos")


@query("a16_series", "SELECT event_type AS symbol, count(*) AS n, arg_min(value, event_id) AS first_close, arg_max(value, event_id) AS last_close, round(arg_max(value, event_id) - arg_min(value, event_id), 2) AS change, CASE WHEN round(arg_max(value, event_id) - arg_min(value, event_id), 2) > 0 THEN 'up' WHEN round(arg_max(value, event_id) - arg_min(value, event_id), 2) < 0 THEN 'down' ELSE 'flat' END AS trend FROM events WHERE value IS NOT NULL GROUP BY 1")
def _(spark, d):
    return ranking.series_summary(table(spark, d, "events").select(F.col("event_type").alias("symbol"), F.col("event_id").alias("pos"), F.col("value").alias("close")))


@query("u2_ordered_dedup", C + "SELECT min(point_id) AS point_id, count(*) AS copies FROM c WHERE text IS NOT NULL GROUP BY text")
def _(spark, d):
    return chunks(spark, d, "text", where="text is not null").groupBy(F.sha2("text", 256)).agg(F.min("point_id").alias("point_id"), F.count(F.lit(1)).alias("copies")).select("point_id", "copies")


@query("u1_with_new_results", "WITH f AS (SELECT o_custkey AS query_id, o_orderkey % 40 AS u, min(o_orderkey) AS o FROM orders GROUP BY 1, 2), i AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY o) AS INTEGER) AS pos, 'u' || u AS url FROM f), w AS (SELECT o_custkey AS query_id, 'u' || (o_orderkey * 7 % 60) AS url, min(o_orderkey) AS o FROM orders GROUP BY 1, 2), x AS (SELECT w.*, row_number() OVER (PARTITION BY query_id ORDER BY o, url) AS r FROM w ANTI JOIN i USING (query_id, url)), n AS (SELECT query_id, max(pos) AS n FROM i GROUP BY 1) SELECT query_id, pos, url, 'index' AS origin FROM i UNION ALL SELECT query_id, CAST(n + r AS INTEGER), url, 'web' FROM x JOIN n USING (query_id) WHERE r <= 3")
def _(spark, d):
    o = table(spark, d, "orders")
    f = o.groupBy(F.col("o_custkey").alias("query_id"), (F.col("o_orderkey") % 40).alias("u")).agg(F.min("o_orderkey").alias("o"))
    found = f.select("query_id", F.row_number().over(Window.partitionBy("query_id").orderBy("o")).alias("pos"), F.concat(F.lit("u"), F.col("u").cast("string")).alias("url"))
    web = o.select(F.col("o_custkey").alias("query_id"), F.col("o_orderkey").alias("pos"), F.concat(F.lit("u"), (F.col("o_orderkey") * 7 % 60).cast("string")).alias("url"))
    return ranking.with_new_results(found, web)


@query("u2_distinct_calls", "WITH c AS (SELECT user_id AS conv_id, event_id AS pos, event_type AS name, CASE WHEN event_id % 4 = 0 THEN 'c' || event_id % 16 END AS call_id, CAST(floor(value) AS VARCHAR) AS args FROM events) SELECT conv_id, pos, name FROM c WHERE trim(name) <> '' QUALIFY row_number() OVER (PARTITION BY conv_id, coalesce(call_id, name || chr(31) || coalesce(args, 'null')) ORDER BY pos) = 1")
def _(spark, d):
    e = table(spark, d, "events").select(F.col("user_id").alias("conv_id"), F.col("event_id").alias("pos"), F.col("event_type").alias("name"), F.when(F.col("event_id") % 4 == 0, F.concat(F.lit("c"), (F.col("event_id") % 16).cast("string"))).alias("call_id"), F.format_string("%.1f", F.floor("value").cast("double")).alias("args"))
    return ranking.distinct_calls(e).select("conv_id", "pos", "name")


@query("a6_payload_fields", " UNION ALL ".join(f"SELECT '{f}' AS field, count({f}) AS rows FROM c HAVING count({f}) > 0" for f in ("title", "section", "subsection", "page_number", "content_type")).join([C, ""]))
def _(spark, d):
    return analytics.payload_fields(chunks(spark, d, "title", "section", "subsection", "page_number", "content_type").drop("point_id"))


MARGINS = C + """, n AS (SELECT base_url AS doc_id, point_id AS page, unnest(string_split(text, chr(10))) AS text, unnest(range(len(string_split(text, chr(10))))) AS pos FROM c WHERE text IS NOT NULL AND base_url IS NOT NULL),
 s AS (SELECT *, lower(trim(regexp_replace(text, '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g'))) AS line FROM n), a AS (SELECT *, row_number() OVER (PARTITION BY doc_id, page ORDER BY pos) AS up, row_number() OVER (PARTITION BY doc_id, page ORDER BY pos DESC) AS down FROM s WHERE line <> ''),
 g AS (SELECT doc_id, count(DISTINCT page) AS pages FROM n GROUP BY 1), k AS (SELECT doc_id, line, count(*) AS occurrences FROM a WHERE (up <= 3 OR down <= 3) AND length(line) >= 5 GROUP BY 1, 2),
 f AS (SELECT doc_id, line, occurrences FROM k JOIN g USING (doc_id) WHERE occurrences >= greatest(2, floor(pages * 0.6))) """


@query("a12_repeated_margins", MARGINS + "SELECT * FROM f")
def _(spark, d):
    return analytics.repeated_margins(_margin_lines(spark, d))


def _margin_lines(spark: SparkSession, d: str) -> DataFrame:
    c = chunks(spark, d, "text", "base_url", where="text is not null and base_url is not null")
    return c.select(F.col("base_url").alias("doc_id"), F.col("point_id").alias("page"), F.posexplode(F.split("text", "\n")).alias("pos", "text"))


@query("j9_without_margins", MARGINS + ", m AS (SELECT a.doc_id, a.page, a.pos, a.line FROM a JOIN f USING (doc_id, line) WHERE up <= 3 OR down <= 3), d AS (SELECT * FROM m QUALIFY row_number() OVER (PARTITION BY doc_id, line ORDER BY page, pos) > 1) SELECT page, count(*) AS lines FROM n ANTI JOIN d USING (doc_id, page, pos) GROUP BY 1")
def _(spark, d):
    return analytics.without_repeated_margins(_margin_lines(spark, d)).groupBy("page").agg(F.count(F.lit(1)).alias("lines"))


@query("x6_heading_lines", """WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS t, unnest(range(len(string_split(text, chr(10))))) AS pos FROM documents WHERE text IS NOT NULL),
 s AS (SELECT doc_id, CAST(pos AS INTEGER) AS pos, trim(t, ' ' || chr(9) || chr(13)) AS s FROM l), n AS (SELECT *, regexp_extract(s, '^([0-9]+(?:\\.[0-9]+){0,2})\\s+(.+)$', 1) AS num, length(regexp_replace(s, '[^\\p{L}]', '', 'g')) AS letters, length(regexp_replace(s, '[^\\p{Lu}]', '', 'g')) AS caps FROM s)
SELECT doc_id, pos, CAST(CASE WHEN num <> '' THEN least(3, length(regexp_replace(num, '[^.]', '', 'g')) + 1) ELSE 1 END AS INTEGER) AS level FROM n WHERE s <> '' AND (num <> '' OR (letters BETWEEN 4 AND 60 AND caps > 0.8 * letters))""")
def _(spark, d):
    l = table(spark, d, "documents").where("text is not null").select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "t"))
    return l.select("doc_id", "pos", documents.heading_level(F.col("t")).alias("level")).where("level > 0")


@query("f_pdf_normalised")
def _(spark, d):
    return table(spark, d, "documents").select("doc_id", documents.pdf_normalise(F.col("text")).alias("text"))


@query("x5_wiki_sections")
def _(spark, d):
    return documents.wiki_sections(table(spark, d, "documents"), ("references",))


@query("x8_process_documents", """WITH r AS (SELECT DISTINCT request_id, content, CASE WHEN lower(trim(coalesce(document_type, 'html'))) IN ('html', 'pdf', 'mediawiki') THEN lower(trim(coalesce(document_type, 'html'))) ELSE 'text' END AS document_type FROM embedding_requests WHERE content IS NOT NULL),
 w AS (SELECT request_id, document_type, list_filter(regexp_split_to_array(content, '[ \\t\\n\\r]+'), lambda x: x <> '') AS w FROM r), s AS (SELECT request_id, document_type, w, unnest(range(0, len(w), 400)) AS s, CAST(least(500, (len(w) + 399) // 400) AS INTEGER) AS total_chunks FROM w WHERE len(w) > 0)
SELECT request_id, document_type, CAST(s // 400 AS INTEGER) AS chunk_index, total_chunks, array_to_string(w[s + 1:s + 500], ' ') AS text, CAST(least(500, len(w) - s) AS INTEGER) AS words FROM s WHERE s // 400 < 500""")
def _(spark, d):
    r = table(spark, d, "embedding_requests").select("request_id", "content", "document_type").distinct()
    return embedding.process_documents(r, "request_id", "content", "document_type")


@query("m1_index_rows")
def _(spark, d):
    r = table(spark, d, "embedding_requests").select("request_id", "url", "content", "document_type").distinct()
    c = embedding.process_documents(r, "request_id", "content", "document_type").join(r.select("request_id", "url"), "request_id")
    return embedding.index_rows(c, embedding.hashing_embedder(), "hash:words", "local", order="request_id")


@query("a17_midrange", "SELECT user_id, round((max(value) + min(value)) / 2, 1) AS middle FROM events GROUP BY 1")
def _(spark, d):
    return table(spark, d, "events").groupBy("user_id").agg(F.round((F.max("value") + F.min("value")) / 2, 1).alias("middle"))


@query("o5_numeric_sort", "SELECT c_custkey, CAST(row_number() OVER (PARTITION BY c_nationkey ORDER BY coalesce(TRY_CAST(regexp_extract(c_name, '([0-9]+)$', 1) AS INTEGER), 0) % 97, c_custkey) AS INTEGER) AS pos FROM customer")
def _(spark, d):
    number = F.coalesce(F.regexp_extract("c_name", "([0-9]+)$", 1).try_cast("int"), F.lit(0))
    return analytics.ranked(table(spark, d, "customer"), "c_nationkey", [number % 97], "c_custkey").select("c_custkey", "pos")


@query("f_last_sources", MSG + "SELECT conv_id, turn, length(regexp_replace(text, '\\s+$', '')) AS n FROM m WHERE role = 'assistant'")
def _(spark, d):
    """Messages are one line each here, so no block of sources ends them: only blanks go."""
    return messages(spark, d).where("role = 'assistant'").select("conv_id", "turn", F.length(T.strip_last_sources(F.col("text"))).cast("bigint").alias("n"))


# Events


@query("st_bounded_queue", "SELECT user_id, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) <= 256")
def _(spark, d):
    return stream.bounded_queue(table(spark, d, "events")).select("user_id", "event_id")


@query("st_keepalives", "WITH g AS (SELECT user_id, event_id, (epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id))) // 12000000 AS keepalives FROM events) SELECT user_id, event_id, CAST(keepalives AS BIGINT) AS keepalives FROM g WHERE keepalives > 0")
def _(spark, d):
    return stream.keepalives(table(spark, d, "events"))


@query("st_sessions", "WITH g AS (SELECT *, CASE WHEN epoch_us(ts) - epoch_us(lag(ts) OVER w) >= 3600000000 THEN 1 ELSE 0 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), s AS (SELECT *, CAST(sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS session FROM g) SELECT user_id, session, min(ts) AS first_ts, max(ts) AS last_ts, count(*) AS n FROM s GROUP BY 1, 2")
def _(spark, d):
    return stream.sessions(table(spark, d, "events"))


@query("st_progress", "SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS done, round(100.0 * row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id)::DOUBLE / count(*) OVER (PARTITION BY user_id), 2) AS percent FROM events")
def _(spark, d):
    return stream.progress(table(spark, d, "events"))


@query("st_backlog", "WITH u AS (SELECT user_id, arg_max(ts, event_id) AS since FROM (SELECT * FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) <= 6) GROUP BY 1), e AS (SELECT events.user_id, event_id, ts < since AS replayed, row_number() OVER (PARTITION BY events.user_id, ts < since ORDER BY ts DESC, event_id DESC) AS r FROM events JOIN u USING (user_id)) SELECT user_id, event_id, replayed FROM e WHERE NOT replayed OR r <= 4")
def _(spark, d):
    e = table(spark, d, "events")
    early = e.withColumn("_r", F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id"))).where("_r <= 6")
    return stream.backlog(e, early.groupBy("user_id").agg(F.max_by("ts", "event_id").alias("since")), 4).select("user_id", "event_id", "replayed")


@query("st_until_closed", "SELECT user_id, event_id FROM (SELECT *, coalesce(max(CASE WHEN value > 90 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS c FROM events) WHERE c = 0")
def _(spark, d):
    return stream.until_closed(table(spark, d, "events"), F.col("value") > 90).select("user_id", "event_id")


@query("st_payload", "SELECT event_id, 'stage' AS type, event_type AS stage, CAST(event_id AS VARCHAR) AS id, round(epoch_us(ts) / 1e6, 3) AS ts, CAST(user_id AS VARCHAR) AS user FROM events")
def _(spark, d):
    e = table(spark, d, "events")
    x = stream.payload(F.lit("stage"), F.col("event_type"), F.col("event_id"), F.col("ts"), F.create_map(F.lit("user"), F.col("user_id").cast("string"), F.lit("stage"), F.col("event_type")))
    j = e.select("event_id", F.from_json(x, "type string, stage string, id string, ts double, user string").alias("x"))
    return j.select("event_id", "x.*")


@query("x2_html_sections")
def _(spark, d):
    r = table(spark, d, "embedding_requests").where(F.lower(F.trim("document_type")) == "html").dropDuplicates(["request_id"])
    return extraction.html_sections(r, id_col="request_id", html_col="content")


# Pages built from the tables, so that what is extracted of them is known.

_PLAIN = r"[^\p{L}\p{N}]+"


def _plain(c: str) -> Column:
    t = F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), _PLAIN, " "))
    return F.when(t != "", t).otherwise("none")


_PLAIN_SQL = "coalesce(nullif(trim(regexp_replace(coalesce({c}, ''), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')), ''), 'none')"


@query("x2_built_sections", C + f", n AS (SELECT point_id, {_PLAIN_SQL.format(c='section')} AS s, {_PLAIN_SQL.format(c='subsection')} AS u FROM c)" + """
SELECT point_id, 0 AS block, 'Lead' AS section, NULL AS subsection, 0 AS section_index, 0 AS subsection_index, 'lead ' || point_id AS text FROM n
UNION ALL SELECT point_id, 1, s, NULL, 1, 0, 'first ' || point_id FROM n UNION ALL SELECT point_id, 2, s, u, 1, 1, 'second ' || point_id FROM n
UNION ALL SELECT point_id, 3, s, 'Deep', 1, 1, 'third ' || point_id FROM n UNION ALL SELECT point_id, 4, 'Last', NULL, 3, 0, 'fifth ' || point_id FROM n""")
def _(spark, d):
    """Sections, subsections and a fourth level, of which only the third counts; a skipped section takes its own along."""
    c, i = chunks(spark, d, "section", "subsection"), F.col("point_id").cast("string")
    html = F.concat(F.lit("<nav>menu</nav><p>lead "), i, F.lit("<h2>"), _plain("section"), F.lit("</h2><p>first "), i, F.lit("<h3>"), _plain("subsection"), F.lit("</h3><div><p>second "), i, F.lit("</div><h4>Deep</h4><p>third "), i, F.lit("<h2>Gone</h2><p>fourth<h3>Child</h3><p>fourth<div class='toc x'><p>toc</div><h2>Last</h2><p>fifth "), i)
    got = extraction.html_sections(c.select("point_id", html.alias("html")), ("gone",), "point_id")
    return got.select("point_id", "block", "section", "subsection", "section_index", "subsection_index", "text")


@query("x1_built_meta", "SELECT c_custkey, c_name AS title, CASE c_custkey % 4 WHEN 0 THEN 'own ' WHEN 1 THEN 'open ' WHEN 2 THEN 'card ' END || c_custkey AS description FROM customer")
def _(spark, d):
    """The description is that of the meta tag, else of the first card that has one."""
    k, i = F.col("c_custkey") % 4, F.col("c_custkey").cast("string")
    tag = lambda a, n, word: F.concat(F.lit(f"<meta {a}='{n}' content='{word} "), i, F.lit("'>"))
    none = F.lit("")
    html = F.concat(F.lit("<html><head><title> "), F.col("c_name"), F.lit(" </title>"), F.when(k <= 2, tag("name", "twitter:description", "card")).otherwise(none), F.when(k <= 1, tag("property", "og:description", "open")).otherwise(none), F.when(k == 0, tag("name", "description", "own")).otherwise(none), F.lit("</head><body><p>x"))
    c = table(spark, d, "customer").select("c_custkey", html.alias("html"), F.lit("https://a.example/").alias("url"))
    return extraction.html_meta(c, "c_custkey").select("c_custkey", "title", "description")


@query("x4_built_tables", """WITH r AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS k, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders)
SELECT o_custkey, CAST(k // 12 AS INTEGER) AS table_chunk_index, CAST((any_value(n) + 11) // 12 AS INTEGER) AS table_total_chunks, 'Columns: key | status' || chr(10) || string_agg(o_orderkey || ' | ok', chr(10) ORDER BY k) AS text FROM r GROUP BY o_custkey, k // 12""")
def _(spark, d):
    """A table for each customer, a row for each order: twelve at a time under the column names."""
    row = F.concat(F.lit("<tr><td>"), F.col("o_orderkey").cast("string"), F.lit("<td>ok<td>"))
    g = table(spark, d, "orders").groupBy("o_custkey").agg(F.array_sort(F.collect_list(F.struct("o_orderkey", row.alias("r")))).alias("a"))
    html = F.concat(F.lit("<table><thead><tr><th>key<th>status</thead>"), F.array_join(F.transform("a", lambda x: x["r"]), ""), F.lit("</table>"))
    got = extraction.html_tables(g.select("o_custkey", html.alias("html")), id_col="o_custkey")
    return got.select("o_custkey", "table_chunk_index", "table_total_chunks", "text")


@query("j4_parsed_order", "SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN '2,0' WHEN 1 THEN '1,1' ELSE '0,1,2' END AS o FROM orders")
def _(spark, d):
    """A reply that is an array, one that holds one among words, and one without any."""
    k = F.col("o_orderkey") % 3
    reply = F.when(k == 0, "```json\n[2, 0, 7]\n```").when(k == 1, "Best: [1, 1, -4].").otherwise("I don't know")
    return table(spark, d, "orders").select("o_orderkey", F.array_join(F.transform(ranking.parsed_order(reply, F.lit(3)), lambda x: x.cast("string")), ",").alias("o"))


@query("fn_table_fields", "SELECT o_orderkey, 'Date=' || o_orderstatus || ' ; ' || o_orderkey || ',Total=5' AS fields, true AS is_table FROM orders")
def _(spark, d):
    """Labels and values of a two-column table in Markdown; a repeated label's values are joined."""
    md = F.concat(F.lit("| Field | Value |\n|-|-|\n| Date: | "), F.col("o_orderstatus"), F.lit(" |\n| Total | 5<br> |\n| Date | "), F.col("o_orderkey").cast("string"), F.lit(" |\n"))
    m = documents.table_fields(md)
    entries = F.array_join(F.transform(F.array_sort(F.map_keys(m)), lambda x: F.concat(x, F.lit("="), m[x])), ",")
    return table(spark, d, "orders").select("o_orderkey", entries.alias("fields"), documents.is_field_table(md).alias("is_table"))


@query("o3_sorted_fragments", C + ", f AS (SELECT point_id, base_url, lower(regexp_extract(url, '#(.*)$', 1)) AS fragment, coalesce(chunk_index, 1000000000000) AS i FROM c WHERE base_url IS NOT NULL AND url IS NOT NULL) SELECT point_id, CAST(row_number() OVER (PARTITION BY base_url ORDER BY fragment, i, point_id) AS INTEGER) AS pos FROM f")
def _(spark, d):
    w = Window.partitionBy("base_url").orderBy(F.lower(F.regexp_extract("url", "#(.*)$", 1)), F.coalesce("chunk_index", F.lit(10**12)), "point_id")
    return chunks(spark, d, "base_url", "url", "chunk_index", where="base_url is not null and url is not null").select("point_id", F.row_number().over(w).alias("pos"))


@query("a15_upper_median", "SELECT o_custkey, list_sort(list(o_totalprice))[len(list(o_totalprice)) // 2 + 1] AS median FROM orders GROUP BY 1")
def _(spark, d):
    """The upper median of each group: sorted values, number n div 2 from 0.  By rank, so no group is gathered in a list."""
    w = Window.partitionBy("o_custkey")
    ranked = table(spark, d, "orders").select("o_custkey", "o_totalprice", F.row_number().over(w.orderBy("o_totalprice")).alias("r"), F.count(F.lit(1)).over(w).alias("n"))
    return ranked.where("r = n div 2 + 1").select("o_custkey", F.col("o_totalprice").alias("median"))


@query("a19_distinct_stages", "SELECT user_id, array_to_string(list_sort(list_distinct(list(event_type))), ',') AS stages FROM events GROUP BY 1")
def _(spark, d):
    return table(spark, d, "events").groupBy("user_id").agg(F.array_join(F.array_sort(F.collect_set("event_type")), ",").alias("stages"))


@query("f20_source_entries", MSG + "SELECT conv_id, turn, len(regexp_extract_all(text, '(\\[[0-9]+(?:, ?[0-9]+)*\\][^\\[]*)')) AS entries FROM m")
def _(spark, d):
    return messages(spark, d).select("conv_id", "turn", F.size(T.source_entries(F.col("text"))).cast("bigint").alias("entries"))


@query("a7_payload_fields", "SELECT domain, count(title) AS title, count(section) AS section, count(subsection) AS subsection, count(page_number) AS page_number FROM (SELECT DISTINCT * FROM chunks) GROUP BY 1")
def _(spark, d):
    """How many points of each domain have each payload field: the union of field names is those above 0."""
    c = chunks(spark, d, "domain", "title", "section", "subsection", "page_number")
    return c.groupBy("domain").agg(*(F.count(x).alias(x) for x in ("title", "section", "subsection", "page_number")))
