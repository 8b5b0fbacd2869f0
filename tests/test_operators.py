"""Operators on small inputs with results computed by hand."""

import json
import random
import uuid

import pytest
from pyspark.sql import functions as F

from tessella.functions import markup
from tessella.functions import text as T
from tessella.functions import registry
from tessella.operators import analytics, chunking, documents, embedding, extraction, history, index, metering, ranking, search
from tessella.sources import files
from tessella.streaming import events as stream


def one(spark, c, **values):
    schema = ", ".join(f"{k} string" for k in values)
    return spark.createDataFrame([tuple(values.values())], schema).select(c.alias("x")).first()["x"]


def test_point_id_is_a_nested_uuid(spark):
    url = "https://a.example/p?q=é"
    df = spark.createDataFrame([(url, 7)], "u string, i int")
    assert df.select(T.point_id(F.col("u"), F.col("i")).alias("x")).first()["x"] == str(uuid.uuid5(uuid.uuid5(uuid.NAMESPACE_URL, url), "7"))


def test_text_functions(spark):
    assert one(spark, T.slug(F.col("a")), a="  Über uns: A–B ") == "ber-uns-a-b"
    assert one(spark, T.slug(F.col("a")), a="!!") == "section"
    assert one(spark, T.strip_sources(F.col("a")), a="Answer [1].\n\nSources:\n[1] x") == "Answer [1]."
    assert one(spark, T.strip_fence(F.col("a")), a="```json\n{\"a\": 1}\n```") == '{"a": 1}'
    assert one(spark, T.clean_wikitext(F.col("a")), a="'''B''' [[x|y]] {{t|{{u}}}}<ref>r</ref>[[File:a.png]] <!-- c -->end") == "B y  end"
    assert one(spark, T.cited(F.col("a")), a="x [3, 1] y [1] [web-1]") == [1, 3]
    assert one(spark, T.source_entries(F.col("a")), a="[1] one [2, 3] two") == ["[1] one ", "[2, 3] two"]
    assert one(spark, T.normalise(F.col("a")), a="a\t b\nc\n\n\nd [12] “q”") == "a b c\n\nd  \"q\""


def test_html_sections(spark):
    page = """<html><head><title>T</title><meta property="og:description" content="d"></head><body><nav>menu</nav><article><p>lead<p>two
    <h2 id=geo>Geography</h2><div><p>g</p></div><h3>Lakes</h3><ul><li>a<li>b</ul><table><tr><th>h<td>1<tr><td>x<td>2</table>
    <h2>Skip me</h2><p>s</p><h3>Child</h3><p>c</p><h2>Last</h2>loose</article></body></html>"""
    df = spark.createDataFrame([(1, page), (2, None), (3, ""), (4, "plain")], "page_id long, html string")
    got = extraction.html_sections(df, ("skip me",)).orderBy("page_id", "block").collect()
    assert [(r.page_id, r.section, r.subsection, r.section_index, r.subsection_index, r.anchor, r.kind, r.text) for r in got] == [
        (1, "Lead", None, 0, 0, None, "text", "lead"), (1, "Lead", None, 0, 0, None, "text", "two"), (1, "Geography", None, 1, 0, "geo", "text", "g"),
        (1, "Geography", "Lakes", 1, 1, "geo", "text", "a b"), (1, "Geography", "Lakes", 1, 1, "geo", "table", "h | 1\nx | 2"),
        (1, "Last", None, 3, 0, None, "text", "loose"), (4, "Lead", None, 0, 0, None, "text", "plain"),
    ]
    assert markup.meta(page) == ("T", "d")
    m = extraction.html_meta(spark.createDataFrame([(1, '<a href="/b#x">b</a><a href="https://o.example/">o</a>', "https://a.example/")], "page_id long, html string, url string"), base="https://a.example")
    assert m.first()["links"] == ["https://a.example/b"]


def test_upsert_is_idempotent(spark):
    old = spark.createDataFrame([(1, "a", 1), (2, "b", 1)], "id int, v string, ver int")
    new = spark.createDataFrame([(2, "c", 1), (2, "d", 2), (3, "e", 1)], "id int, v string, ver int")
    once = index.upsert(old, new, "id", "ver")
    assert sorted(map(tuple, once.collect())) == [(1, "a", 1), (2, "d", 2), (3, "e", 1)] == sorted(map(tuple, index.upsert(once, new, "id", "ver").collect()))
    assert index.delete_where(once, F.col("v") == "a").count() == 2
    assert index.truncate(once).count() == 0


def test_token_budget_equals_the_loop(spark):
    rng = random.Random(3)
    said = [(c, t, "user", " ".join(["w"] * rng.randint(0, 9))) for c in range(30) for t in range(1, rng.randint(2, 12))]
    want = set()
    for c in range(30):
        used = 0
        for _, t, _, x in sorted((m for m in said if m[0] == c), key=lambda m: -m[1]):
            if used + len(x.split()) > 15:
                break
            used += len(x.split())
            want.add((c, t))
    got = history.within_budget(spark.createDataFrame(said, "conv_id long, turn int, role string, text string"), 15)
    assert {(r.conv_id, r.turn) for r in got.collect()} == want


def test_split_drops_a_pending_pair(spark):
    m = spark.createDataFrame([(1, k + 1, r, x) for k, (r, x) in enumerate([("user", "a"), ("assistant", "b"), ("user", "c"), ("assistant", "processing")])], "conv_id long, turn int, role string, text string")
    assert [(r.turn, r.band) for r in history.split_for_prompt(m, 1, 1).orderBy("turn").collect()] == [(1, "verbatim"), (2, "verbatim")]


def test_rollover_overlaps_one_turn(spark):
    m = spark.createDataFrame([(1, k, "user", "x") for k in range(1, 9)], "conv_id long, turn int, role string, text string")
    assert [(r.first_turn, r.last_turn) for r in history.rollover_chunks(m, 2).orderBy("chunk").collect()] == [(1, 4), (3, 8)]
    m = spark.createDataFrame([(1, k, "user", "x") for k in range(1, 13)], "conv_id long, turn int, role string, text string")
    assert [(r.first_turn, r.last_turn) for r in history.rollover_chunks(m, 2).orderBy("chunk").collect()] == [(1, 4), (3, 8), (7, 12)]


def test_windows_and_sections(spark):
    df = spark.createDataFrame([(1, " ".join(map(str, range(10)))), (2, ""), (3, None)], "id int, text string")
    assert [r.text for r in chunking.word_windows(df, "id", "text", 4, 1).orderBy("chunk_index").collect()] == ["0 1 2 3", "3 4 5 6", "6 7 8 9", "9"]
    assert [r.text for r in chunking.word_windows(df, "id", "text", 4, 1, True).orderBy("chunk_index").collect()] == ["0 1 2 3", "3 4 5 6", "6 7 8 9"]
    with pytest.raises(ValueError):
        chunking.word_windows(df, "id", "text", 0, 0)
    doc = spark.createDataFrame([(1, "l\n## A\na\n### B\nb\n== C ==\nc")], "id int, text string")
    got = chunking.section_walk(doc, "id", "text").orderBy("pos").collect()
    assert [(r.section, r.subsection, r.section_index, r.subsection_index, r.text) for r in got] == [("Lead", None, 0, 0, "l"), ("A", None, 1, 0, "a"), ("A", "B", 1, 1, "b"), ("C", None, 2, 0, "c")]


def test_costs(spark):
    u = spark.createDataFrame([(1, 1, "infer", "m", 100, 150, 10), (1, 1, "rerank", "none", 5, 0, 5), (1, 2, "embedding", "m", None, None, None)], "ns int, turn int, stage string, model_key string, input long, cached long, output long")
    r = spark.createDataFrame([("m", 1.0, 0.5, 2.0)], "model_key string, input_rate double, cached_rate double, output_rate double")
    c = metering.stage_costs(u, r)
    assert sorted(x.cost for x in c.collect()) == [0.0, 0.0, pytest.approx((150 * 0.5 + 10 * 2) / 1e6)]
    assert metering.running_totals(metering.turn_totals(c)).orderBy("turn").collect()[-1].tokens == 120


def test_ranking(spark):
    s = spark.createDataFrame([(1, 1, 0.9)] + [(2, k, 0.9 - k / 100) for k in range(6)] + [(3, k, 0.5 - k / 100) for k in range(6)] + [(4, 1, 0.2), (4, 2, 0.1)], "query_id int, id int, score double")
    assert {r.query_id: r.reason for r in ranking.rerank_decision(s).collect()} == {1: "single", 2: "rerank", 3: "rerank", 4: "few"}
    p = spark.createDataFrame([(1, 0, "a"), (1, 1, "b")], "query_id int, idx int, v string")
    o = spark.createDataFrame([(1, [1, 1, 5, 0])], "query_id int, indices array<int>")
    assert [r.v for r in ranking.apply_order(p, o).orderBy("pos").collect()] == ["b", "b", "a"]
    ctx = spark.createDataFrame([(1, "u", "s", None), (3, "u", "s", None), (2, "v", None, None), (4, "", "s", None)], "idx int, url string, section string, subsection string")
    assert [r.entry for r in analytics.collapse_sources(ctx).orderBy("first_idx").collect()] == ["[1, 3] u (Section: s)", "[2] v"]


def test_searches(spark):
    e = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [1.0, 1.0]), (4, [0.0, 0.0]), (5, None)], "vec_id long, embedding array<float>")
    assert [r.vec_id for r in search.top_k(e, [1.0, 0.1], 2).collect()] == [1, 3]
    got = search.batch_top_k(e, e.where("vec_id in (1, 4, 5)"), 2).orderBy("query_id", "rank").collect()
    assert [(r.query_id, r.id) for r in got if r.query_id == 1] == [(1, 3), (1, 2)]


def test_sources(spark, tmp_path):
    (tmp_path / "s.jsonl").write_text('{"id": "a", "vector": [1.0], "payload": {"t": "x"}}\nnot json\n')
    assert [r.id for r in files.read_seed(spark, str(tmp_path / "s.jsonl")).collect()] == ["a"]
    (tmp_path / "m.json").write_text(json.dumps({"items": [{"url": "u1", "doc_type": "html", "skip_sections": ["x"]}, {"url": "u2"}], "max_chunks": 5}))
    assert [(r.url, r.max_chunks) for r in files.read_manifest(spark, str(tmp_path / "m.json")).collect()] == [("u1", 5), ("u2", 5)]
    (tmp_path / "p.csv").write_text("name,iata_code,type,lat,lng,scheduled_service\nA,AAA,small,1.5,2.5,yes\nB,,x,,3,no\n")
    assert [(r.name, r.scheduled_service, r.elevation_ft) for r in files.read_places(spark, str(tmp_path / "p.csv")).collect()] == [("A", True, None)]
    (tmp_path / "q.csv").write_text("name,ident,latitude_deg,longitude_deg,elevation_ft,municipality\nB,X1,1.5,2.5,30,Town\n")
    assert [(r.ident, r.lat, r.elevation_ft, r.municipality) for r in files.read_places(spark, str(tmp_path / "q.csv")).collect()] == [("X1", 1.5, 30, "Town")]
    assert files.seed_table(spark, str(tmp_path / "s.jsonl"), str(tmp_path / "seed")) == 1 and spark.read.parquet(str(tmp_path / "seed")).count() == 1
    assert files.read_shared(spark, str(tmp_path), "p.csv").count() == 1
    for name in ("../p.csv", "a/b", "*.csv", ""):
        with pytest.raises(ValueError):
            files.read_shared(spark, str(tmp_path), name)
    items = spark.createDataFrame([(1, "u1", "ok", 3, 10), (2, "u2", None, None, None)], "pos int, url string, status string, chunks int, tokens int")
    lines = [json.loads(r.value) for r in files.progress_lines(items).orderBy("line").collect()]
    assert [x.get("percent") for x in lines] == [50.0, 100.0, None] and lines[2] == {"event": "summary", "items": 2, "success": 1, "failed": 1, "chunks": 3, "tokens": 10}
    (tmp_path / "a.pdf").write_bytes(b"%PDF")
    assert [(r.name, r["size"]) for r in files.list_files(spark, str(tmp_path)).collect()] == [("a.pdf", 4)]
    prices = spark.createDataFrame([("X", '{"X": [{"d": "2024-01-01", "c": 1.005}, {"date": "2024-01-02", "close": 2}]}'), ("Y", "bad"), ("Z", '{"items": [{"history": [{"t": "2024-01-03", "v": 3}]}]}')], "symbol string, payload string")
    assert [(r.symbol, r.d) for r in extraction.price_points(prices).orderBy("symbol", "pos").collect()] == [("X", "2024-01-01"), ("X", "2024-01-02"), ("Z", "2024-01-03")]


def test_streams(spark, tmp_path):
    rows = [(k, f"2024-01-01 00:{k:02d}:00", 1, "a", 1.0) for k in range(7)]
    df = spark.createDataFrame(rows, "event_id long, ts string, user_id long, event_type string, value double").withColumn("ts", F.col("ts").cast("timestamp"))
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    s = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    for name, out, mode in (("win", stream.stream_windows(s), "complete"), ("roll", stream.stream_rollover(s, 3), "append")):
        q = out.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).start()
        q.processAllAvailable()
        q.stop()
    assert sum(r.n for r in spark.table("win").collect()) == 7
    assert [r.chunk for r in spark.table("roll").orderBy("chunk").collect()] == [0, 1]
    assert [r.keepalives for r in stream.keepalives(df).collect()] == [5] * 6
    assert stream.sessions(df, 60).count() == 7


def test_rerank_rules(spark):
    flat, steep = [0.9, 0.89, 0.88, 0.87, 0.86], [0.7, 0.6, 0.58, 0.56, 0.54]
    rows = [(1, k, x, False) for k, x in enumerate(flat)] + [(2, k, x, False) for k, x in enumerate(steep)] + [(3, k, x, k == 4) for k, x in enumerate(flat)] + [(4, k, x, k == 4) for k, x in enumerate(steep)] + [(5, k, x / 2, False) for k, x in enumerate(steep)] + [(6, k, None, False) for k in range(5)]
    got = ranking.rerank_decision(spark.createDataFrame(rows, "query_id int, id int, score double, exact boolean"))
    assert {r.query_id: r.reason for r in got.collect()} == {1: "rerank", 2: "clear", 3: "exact", 4: "clear", 5: "rerank", 6: "rerank"}
    replies = [("[2, 0]", [2, 0]), ("```json\n[1, 9, -1, 1]\n```", [1, 1]), ("The order is [2, 1].", [2, 1]), ("none", [0, 1, 2]), ("[7]", [0, 1, 2]), (None, [0, 1, 2])]
    df = spark.createDataFrame([(k, r) for k, (r, _) in enumerate(replies)], "k int, r string").select("k", ranking.parsed_order(F.col("r"), F.lit(3)).alias("o"))
    assert {r.k: r.o for r in df.collect()} == {k: o for k, (_, o) in enumerate(replies)}


def test_intents(spark):
    assert one(spark, ranking.overview_match(F.col("a")), a=" So, what data do we have? ") == "what data do we have?"
    assert one(spark, ranking.overview_match(F.col("a")), a="give an overview of it") == ""
    assert one(spark, ranking.wants_web(F.col("a")), a="Please Google this") and not one(spark, ranking.wants_web(F.col("a")), a="latest news today")
    asks = {"a short one": True, "": False, "please tell me in full detail how their settings also work": True, "please tell me in full detail about the settings of the server": False}
    for a, want in asks.items():
        assert one(spark, ranking.should_rewrite(F.col("a")), a=a) is want
    assert one(spark, ranking.without_support(F.col("a")), a="No.\nNO_SUPPORTED_SOURCES' ") and one(spark, ranking.without_support(F.col("a")), a="The context does not say.")
    assert one(spark, ranking.without_mark(F.col("a")), a="No.\nNO_SUPPORTED_SOURCES") == "No." and one(spark, ranking.without_mark(F.col("a")), a="Yes. ") == "Yes. "
    assert one(spark, ranking.unsafe_svg(F.col("a")), a="<svg ONLOAD = 'x'>") and not one(spark, ranking.unsafe_svg(F.col("a")), a="<svg><path/></svg>")
    assert one(spark, ranking.proper_names(F.col("a")), a="The Ford F-150 and the Rio Grande, THE Rio grande; January Sales of Ford F-150 in Weather Today") == ["Ford F-150", "Rio Grande"]
    m = spark.createDataFrame([(1, 1, "user", "Old Name"), (1, 2, "user", "Blue Lake and Mount Red Top"), (1, 3, "assistant", "Not This"), (1, 4, "user", "near Alpha Base"), (2, 1, "user", None)], "conv_id long, turn int, role string, text string")
    assert {r.conv_id: r.candidates for r in ranking.clarify_candidates(m).collect()} == {1: ["Mount Red Top", "Alpha Base", "Blue Lake"], 2: []}


def test_nearby_equals_all_pairs(spark):
    rng = random.Random(8)
    at = lambda: (rng.choice([rng.uniform(-90, 90), rng.uniform(86, 90), rng.uniform(-90, -88)]), rng.choice([rng.uniform(-180, 180), rng.uniform(178, 180), rng.uniform(-180, -179)]))
    places = spark.createDataFrame([(k, *at()) for k in range(120)], "id int, lat double, lng double")
    sites = spark.createDataFrame([(k, *at(), "large" if k % 2 else "small", k % 3 == 0) for k in range(300)] + [(900, None, 1.0, "large", True)], "id int, lat double, lng double, type string, scheduled_service boolean")
    km = ranking.geo.haversine_km(F.col("p.lat"), F.col("p.lng"), F.col("s.lat"), F.col("s.lng"))
    for radius in (300.0, 2500.0):
        every = places.alias("p").join(sites.where("type = 'large' and scheduled_service").alias("s"), km <= radius).select(F.col("p.id").alias("a"), F.col("s.id").alias("b"))
        got = ranking.nearby(places, sites, radius, 1000, ("large",), True)
        assert {(r.place_id, r.site_id) for r in got.collect()} == {(r.a, r.b) for r in every.collect()}


def test_token_rollover_starts_anew(spark):
    m = spark.createDataFrame([(1, k + 1, "user", "x" * n) for k, n in enumerate([7, 7, 3, 8, 0, 30])] + [(2, 1, "user", None)], "conv_id long, turn int, role string, text string")
    assert [(r.turn, r.chunk) for r in history.token_rollover(m, 4).where("conv_id = 1").orderBy("turn").collect()] == [(1, 0), (2, 0), (3, 0), (4, 1), (5, 1), (6, 1)]
    prompts = {r.conv_id: (r.prompt, r.kept) for r in history.summary_prompt(m.where("conv_id = 2"), None, "H: ").collect()}
    assert prompts == {2: ("H: user: ", 1)}
    said = spark.createDataFrame([(1, 1, "user", "a b"), (1, 2, "assistant", "c d e f")], "conv_id long, turn int, role string, text string")
    got = [history.summary_prompt(said, n, "H ").first().prompt for n in (3, 5, 7, 10, 11)]
    assert got == ["H assistant:", "H assistant: c d…", "H assistant: c d e f", "H assistant: c d e f", "H user: a b\nassistant: c d e f"]


def test_index_changes(spark):
    df = spark.createDataFrame([(k, f"https://a.example/P#{k}", [1.0, float(k)]) for k in range(6)], "id int, url string, vector array<double>")
    rows = index.checked_points(df, 2).collect()
    assert rows[0].url_lower == "https://a.example/p#0" and rows[0].updated_at is not None
    with pytest.raises(Exception, match="no valid vector"):
        index.checked_points(df.withColumn("vector", F.when(F.col("id") == 3, F.col("vector"))), 2).collect()
    kept, n = index.counted_delete(df, F.col("id") < 2)
    assert kept.count() == 4 and n.first().deleted == 2
    assert sorted(r.id for r in index.clone_points(df, "id", 2, 3).collect()) == [2, 3, 4] and index.clone_points(df, "id", 9).count() == 0
    assert "Sort" not in index.clone_points(df, "id", 2)._jdf.queryExecution().optimizedPlan().toString().split("scalar-subquery")[0].split("Filter")[0]
    assert index.clone_report(df, index.clone_points(df, "id", 2)).first()[:] == (6, 4, False)
    c = spark.createDataFrame([("a", 2, "cosine"), ("b", 3, "cosine")], "collection_name string, dim int, distance string")
    assert {tuple(r) for r in index.copied_collection(c, "a", "c").collect()} == {("a", 2, "cosine"), ("b", 3, "cosine"), ("c", 2, "cosine")}
    with pytest.raises(Exception, match="another dimension"):
        index.copied_collection(c, "a", "b").collect()
    old = spark.createDataFrame([(k, f"https://x.example/{k}#s", None, None, None) for k in range(4)], "point_id int, url string, url_lower string, base_url string, base_url_lower string")
    assert index.backfill_base_url(old, dry_run=True).where("needs_update and base_url is null").count() == 4
    assert [r.point_id for r in index.backfill_base_url(old, max_updates=2).where("base_url is not null").orderBy("point_id").collect()] == [0, 1]


def test_ranked_is_a_row_number(spark):
    df = spark.createDataFrame([(k, "g" if k % 5 else None, (k * 7) % 3 or None) for k in range(400)], "id long, g string, o int")
    got = analytics.ranked(df, "g", [F.col("o")], "id", width=16)
    w = F.row_number().over(__import__("pyspark").sql.Window.partitionBy("g").orderBy("o", "id"))
    assert {(r.id, r.pos) for r in got.collect()} == {(r.id, r.pos) for r in df.withColumn("pos", w).collect()}


def test_filters_reach_the_scan(spark, tmp_path):
    spark.range(100).selectExpr("id as point_id", "cast(id % 3 as string) as document_type", "'x' as title", "'y' as section", "'d' as domain").write.parquet(str(tmp_path / "chunks.parquet"))
    from tessella.plans import catalog

    for name in ("s1_filtered_scan", "f2_lowered_filter"):
        plan = catalog.QUERIES[name](spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
        assert "EqualTo(document_type,pdf)" in plan, name


def test_pdf_and_wiki(spark):
    assert one(spark, documents.pdf_normalise(F.col("a")), a="A\u00a0line\nof [text](http://x) more[1].\n\n\n- one\n- two\n\n“q” – end¹") == "A line of text more.\n\n- one\n- two\n\n\"q\" - end"
    lines = [("1 Intro", 10.0), ("text a", 10.0), ("1.2 Part", 10.0), ("text b", 10.0), ("BIG NEWS TODAY", 10.0), ("text c", 10.0), ("Large", 14.0), ("text d", 10.0), ("1.1 Intro ..... 3", 10.0)]
    df = spark.createDataFrame([(1, 1, k, t, s) for k, (t, s) in enumerate(lines)], "doc_id int, page int, pos int, text string, size double")
    got = [(r.section, r.subsection, r.section_index, r.text) for r in documents.pdf_sections(df).orderBy("pos").collect()]
    assert got == [("Intro", None, 1, "text a"), ("Intro", "Part", 1, "text b"), ("BIG NEWS TODAY", None, 2, "text c"), ("Large", None, 3, "text d")]
    assert documents.pdf_sections(df, ("INTRO", "part")).count() == 2
    wiki = "Lead ''t''.\n== A ==\na {{x}}\n=== B ===\nb\n==== C ====\nc\n== References ==\nr\n=== R ===\nr2\n== D ==\nd"
    df = spark.createDataFrame([(1, wiki), (2, None), (3, "")], "doc_id int, text string")
    got = [(r.section, r.subsection, r.subsubsection, r.section_index, r.subsection_index, r.text) for r in documents.wiki_sections(df, ("references",)).orderBy("section_no").collect()]
    assert got == [("Lead", None, None, 0, 0, "Lead t."), ("A", None, None, 1, 0, "a"), ("A", "B", None, 1, 1, "b"), ("A", "B", "C", 1, 1, "c"), ("D", None, None, 3, 0, "d")]
    kv = "| Key | Value |\n|-|-|\n| Area: | 5 km<br>2 |\n| Peak | A |\n| Peak | B |\n| | x |"
    assert one(spark, documents.table_fields(F.col("a")), a=kv) == {"Area": "5 km 2", "Peak": "A ; B"} and one(spark, documents.is_field_table(F.col("a")), a=kv)
    assert not one(spark, documents.is_field_table(F.col("a")), a="| a | b | c |\n|-|-|-|\n| 1 | 2 | 3 |\n| 1 | 2 | 3 |")


def test_html_tables(spark):
    body = "".join(f"<tr><td>{k}<td>v{k}" for k in range(13))
    page = f"<table class='x infobox'><tr><th>Area<td>5</table><table><thead><tr><th>n<th>v</thead>{body}<tr><td>in<td><table><tr><td>z</table></table><table><tr><td>p<td>q<tr><td>r<td>s</table>"
    got = extraction.html_tables(spark.createDataFrame([(1, page), (2, None), (3, "x")], "page_id long, html string")).orderBy("table_index", "table_chunk_index").collect()
    assert [(r.table_index, r.table_chunk_index, r.table_total_chunks, r.content_type) for r in got] == [(0, 0, 1, "infobox"), (1, 0, 2, "table"), (1, 1, 2, "table"), (2, 0, 1, "table")]
    assert got[0].text == "Area: 5" and got[1].text.startswith("Columns: n | v\n0 | v0\n") and got[3].text == "Columns: p | q\nr | s"
    h4 = markup.sections("<h2>A</h2><h3>B</h3><p>b</p><h4>C</h4><p>c</p><div class=toc><p>no</p></div>")
    assert [(r[1], r[3], r[6]) for r in h4] == [("B", 1, "b"), ("C", 1, "c")]


def test_embedding(spark):
    df = spark.createDataFrame([(1, " HTML ", "a b " * 600, "https://a.example/p"), (2, None, "", "https://a.example/q"), (3, "odd", "one two", None)], "id int, kind string, text string, url string")
    c = embedding.process_documents(df, "id", "text", "kind", 2)
    assert {(r.id, r.document_type, r.chunk_index, r.total_chunks, r.words) for r in c.collect()} == {(1, "html", 0, 2, 500), (1, "html", 1, 2, 500), (3, "text", 0, 1, 2)}
    rows = embedding.index_rows(c.join(df.select("id", "url"), "id"), embedding.hashing_embedder(32), "m", "p").collect()
    assert len(rows) == 2 and all(len(r.vector) == 32 and r.embedding_normalized and r.base_url == "https://a.example/p" for r in rows)
    assert {r.id for r in rows} == {str(uuid.uuid5(uuid.uuid5(uuid.NAMESPACE_URL, "https://a.example/p"), k)) for k in "01"}
    path = "/opt/tokenizers/byte_bpe_50k.json"
    import os

    if os.path.exists(path):
        got = embedding.tokenised(df, "id", "text", path, 100, 20).where("id = 1").orderBy("chunk_index").collect()
        assert all(r.tokens <= 100 for r in got) and got[0].text.startswith("a b") and len(got) == got[0].total_chunks


def test_registry(spark):
    r = registry.default()
    r.install(spark)
    row = spark.sql("select slug('A b!') as a, text_tokens('abcdefgh') as b, preview('abc', 2) as c, round(haversine_km(0D, 0D, 0D, 1D), 1) as d, midrange(1D, 2.5D) as e").first()
    assert row[:] == ("a-b", 2, "ab…", 111.2, 1.8)
    assert spark.range(1).select(r.call("slug", F.lit("X y"))).first()[0] == "x-y" and r.definitions(spark).count() == len(r.entries)
    with pytest.raises(ValueError):
        r.add("slug", {}, "STRING", "", "''")
    with pytest.raises(KeyError):
        r.call("unknown")
    r.add_table("nearby", ranking.nearby)
    p = spark.createDataFrame([(1, 0.0, 0.0)], "id int, lat double, lng double")
    assert r.table("nearby", p, p, 10.0, 1).count() == 1


def test_payload_rules(spark):
    got = spark.createDataFrame([(1, {"stage": "s", "ts": "12.5", "k": "v"}), (2, None)], "id int, extra map<string,string>").select("id", stream.payload(F.lit("stage"), F.lit("t"), F.col("id"), F.lit("1970-01-01 00:00:01"), F.col("extra")).alias("j"))
    assert {r.id: json.loads(r.j) for r in got.collect()} == {1: {"type": "stage", "stage": "s", "id": "1", "ts": 12.5, "k": "v"}, 2: {"type": "stage", "stage": "t", "id": "2", "ts": 1.0}}
    assert one(spark, T.strip_last_sources(F.col("a")), a="See Sources: here.\n\nSources:\n[1] x ") == "See Sources: here."
    assert one(spark, T.strip_last_sources(F.col("a")), a="x\nSources: [1]") == "x\nSources: [1]"
    assert one(spark, T.unescape(F.col("a")), a="a &lt;b&gt; &amp;lt; &quot;") == 'a <b> &lt; "'


def test_memoised_models(spark):
    df = spark.createDataFrame([(1, "a b c"), (2, "a b c"), (3, None), (4, "d")], "id int, text string")
    got = embedding.memoised(df, "text", "summary", embedding.first_sentences(2))
    assert {r.id: r.summary for r in got.collect()} == {1: "a b", 2: "a b", 3: None, 4: "d"}


def test_cost_parts_and_eviction(spark):
    u = spark.createDataFrame([(1, 1, "inference", "m", 100, 40, 10), (1, 1, "inference_tools_synth", "m", 10, 0, 5), (1, 1, "embedding", "m", 50, 20, 9)], "ns int, turn int, stage string, model_key string, input long, cached long, output long")
    r = spark.createDataFrame([("m", 1.0, 0.5, 2.0)], "model_key string, input_rate double, cached_rate double, output_rate double")
    parts = {x.stage: x for x in metering.cost_parts(u, r).collect()}
    assert parts["inference"][-5:] == pytest.approx((60e-6, 20e-6, 20e-6, 100e-6, 100e-6)) and parts["embedding"].cost == pytest.approx(50e-6)
    t = metering.turn_split(metering.cost_parts(u, r)).first()
    assert t[2:6] == (50, 110, 15, 175) and t.cost == pytest.approx(170e-6)
    s = spark.createDataFrame([("a", "k", "é", "2024-01-01 00:00:00"), ("b", "k", "x", "2024-01-01 02:00:00"), ("c", "k", None, None)], "ns string, key string, text string, last_seen string").withColumn("last_seen", F.col("last_seen").cast("timestamp"))
    kept, report = analytics.evict_idle(s, F.lit("2024-01-01 02:30:00"))
    assert [x.ns for x in kept.collect()] == ["b"] and report.first()[:] == (2, 2, 2)


def test_page_chunks(spark):
    page = "<table class=infobox><tr><th>Area<td>5</table><p>lead</p><h2>A</h2><p>text</p><table><tr><th>k<tr><td>v</table>"
    got = extraction.page_chunks(spark.createDataFrame([(1, page)], "page_id long, html string")).orderBy("chunk_index").collect()
    assert [(r.content_type, r.section, r.total_chunks) for r in got] == [("infobox", "INFOBOX", 4), ("text", "Lead", 4), ("text", "A", 4), ("table", None, 4)]
