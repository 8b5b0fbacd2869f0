"""The operators for training data: against brute force on small inputs, and on nulls, empty tables and clashing names."""

import os
import random
from itertools import combinations

import duckdb
import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessella.llm import common, furniture, knn_forest, leakage, mixing, moderation, near_dups, oracle, queries, render, repeated_lines, splitter

DATA = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_query(spark, name):
    got = queries.queries()[name](spark, DATA).toPandas()
    if name in oracle.oracle_sql():
        con = duckdb.connect()
        for f in os.listdir(DATA):
            con.execute(f"create view {f[:-8]} as select * from read_parquet('{DATA}/{f}')")
        want = con.execute(oracle.oracle_sql()[name]).df()
        key = lambda d: sorted(map(repr, d[sorted(d.columns)].round(6).values.tolist()))
        assert key(got) == key(want)


def test_shared_folder(spark, monkeypatch):
    class Remote:
        conf, sparkContext = spark.conf, type("C", (), {"master": "spark://host:7077", "getConf": staticmethod(lambda: type("N", (), {"get": staticmethod(lambda *a: None)}))})

    monkeypatch.setattr(Remote, "conf", type("E", (), {"get": staticmethod(lambda *a: None)}))
    with pytest.raises(ValueError):
        common.shared_dir(Remote)
    t = common.cut(spark.range(5).toDF("id"), "test")
    assert t.count() == 5 and common.release(spark) >= 1 and common.release(spark) == 0


# 1


def test_rendering():
    page = "<div hidden>no</div><h1>T</h1><p>a <b>b</b><p>c<ul><li>x<li>y</ul><ol><li>one</ol><table><tr><td>k<td>1<tr><td>long<td>2</table><script>s</script><span style='display:none'>n</span>"
    assert render.render(page) == "T\n\na b\n\nc\n\n- x\n- y\n\n1. one\n\nk     1\nlong  2"
    assert render.render(None) == render.render("") == ""
    assert [x.text for x in render.source_lines("a\n<li><a href='/'>H</a></li>\n1 < 2")] == ["a", "H", "1 < 2"]


PAGE = "Home | Forum | Search\nWe use cookies to run this site. Accept our cookie policy.\nAccept all\nLakes of {0}\n## History\nThe lake {0} is deep.\n| a | 1 |\nA cookie baked in {0} is sweet.\nYou might also like\nHills of {1}\nBack to top\n© 2020 Site"


def test_furniture(spark):
    rows = [(k, f"https://s.example/p{k}", PAGE.format(f"N{k}", f"M{k}"), f"Lakes of N{k}", "HTML", 1) for k in range(6)]
    rows += [(0, *rows[0][1:]), (7, None, None, None, "html", None), (8, None, "", None, "html", None), (9, "https://s.example/q", "Home | Forum | Search", None, "pdf", 1), (None, None, "x", None, "html", 1)]
    df = spark.createDataFrame(rows, "request_id long, url string, content string, title string, document_type string, total_chunks int").withColumns({"id": F.lit(1), "lines": F.lit("x"), "site": F.lit("y")})
    got = furniture.furniture_lines(df).toPandas()
    for k in range(6):
        assert sorted(got[got.request_id == k].line_no) == [1, 2, 3, 9, 10, 11, 12]
    assert set(got.request_id) == set(range(6))
    body = {r.request_id: r.body for r in furniture.main_body(df).collect()}
    assert body[0] == "Lakes of N0\n## History\nThe lake N0 is deep.\n| a | 1 |\nA cookie baked in N0 is sweet."
    assert furniture.furniture_lines(df.limit(0)).count() == 0


def test_furniture_of_many_sites(spark, monkeypatch):
    """What several sites share is furniture on a page of a site of its own, in a language that nobody listed."""
    menu = ["Domus", "Fora", "Quaere"]
    page = "{m}\nCrustulis utimur ut haec pagina melior fiat anno {k}.\nAccipe omnia\nDe lacu {w}\n## Historia\nLacus {w} profundus est.\nHistoria\nNavis {w} in eo mergitur.\nSi haec placent\nDe monte {w} alto\nDe valle {w} lata\n(c) {k} Omnia iura"
    word = lambda k: "".join("abcdefghij"[int(c)] for c in str(k)) + "um"
    one = lambda i, u, k: (i, u, page.format(m=" | ".join(menu), k=k, w=word(k)), f"De lacu {word(k)}", "html", 1)
    rows = [one(10 * s + k, f"https://s{s}.example/p{k}", 100 * s + k) for s in range(5) for k in range(6)]
    rows += [one(999, "https://lonely.example/q", 777), one(998, None, 888)]
    df = spark.createDataFrame(rows, "request_id long, url string, content string, title string, document_type string, total_chunks int")
    got = furniture.furniture_lines(df).toPandas()
    for k in (0, 23, 999, 998):
        assert sorted(got[got.request_id == k].line_no) == [1, 2, 3, 9, 10, 11, 12], k
    monkeypatch.setattr(furniture, "MAX_BROADCAST_BYTES", -1)  # the shuffled join gives the same
    again = furniture.furniture_lines(df).toPandas()
    assert set(map(tuple, again.values)) == set(map(tuple, got.values))


def test_long_sidebar():
    names = "Harbour Walls,Winter Ferries,Old Mills,Quiet Valleys,Stone Bridges,Northern Lamps,Salt Roads,Market Days,Paper Kites,Copper Roofs,Glass Towers,Moss Gardens,River Songs".split(",")
    page = ["Lakes of the north", "The lake is deep.", "You might also like", *names, "The shore is long and flat."]
    key = furniture.line_keys(page[2])[0]
    known = furniture.Known(phrases=[key], asides=[key])
    got = furniture.furniture(render.source_lines("\n".join(page)), "Lakes of the north", None, known)
    assert got == set(range(3, 4 + len(names)))


# 2


def test_repeated_lines(spark):
    rows = [(k, f"http://www.S.example/p{k}/", None, f"Share this!\nown {'abcdefgh'[k % 8]}\nshare THIS\n\n---\nLegal notice {k}") for k in range(6)]
    rows += [(0, *rows[0][1:]), (20, "", "https://s.example/p0#x", "Share this"), (21, None, None, "Share this"), (22, "https://t.example/a", None, "Share this"), (23, "https://s.example/z", None, None)]
    df = spark.createDataFrame(rows, "point_id long, base_url string, url string, text string").withColumn("key", F.lit(1))
    got = {(r.point_id, r.line_no) for r in repeated_lines.repeated_lines(df).collect()}
    assert got == {(k, n) for k in range(6) for n in (1, 3, 6)} | {(20, 1)}
    patterns = repeated_lines.prefixspan(df)[0].toPandas()
    assert patterns.length.max() == 3 and set(patterns.pages) == {6}
    clean = {(r.point_id, r.text) for r in repeated_lines.remove_repeated_lines(df).collect()}
    assert (1, "own b\n\n---") in clean and (23, None) in clean
    assert repeated_lines.repeated_lines(df.limit(0)).count() == 0


def test_long_sequences(spark):
    footer = "\n".join(f"footer {'abcdefg'[k]}" for k in range(7))
    df = spark.createDataFrame([(k, f"https://s.example/p{k}", f"own {'abcdef'[k]}\n{footer}") for k in range(6)], "point_id long, base_url string, text string").withColumn("url", F.lit(None).cast("string"))
    got = repeated_lines.prefixspan(df)[0].toPandas()
    assert sorted(got.length) == sorted(n for n in range(1, 8) for _ in range(8 - n))
    assert list(got[got.length == 7].first_line) == [2]


def test_gapped_sequences(spark, monkeypatch):
    rng = random.Random(3)
    texts = {k: "".join(c for c in "abcdba" if rng.random() < 0.8) for k in range(14)}
    texts |= {14: "ab", 15: "aed", 16: "eeb"}
    page = lambda k: k % 15  # noqa: E731  two texts on pages 0 and 1
    rows = [(k, f"https://s.example/p{page(k)}", "\n".join(f"line {c}" for c in t)) for k, t in texts.items()]
    rows += [(3, rows[3][1], "line d\nline d\nline a"), rows[4], (20, "https://t.example/", "line a\nline b")]
    df = spark.createDataFrame(rows, "point_id long, base_url string, text string").withColumn("url", F.lit(None).cast("string"))
    support = {}
    for k, url, text in rows:
        t = text.replace("line ", "").split("\n")
        for n in range(1, len(t) + 1):
            for at in combinations(range(len(t)), n):
                support.setdefault((url[8], tuple(t[i] for i in at)), set()).add(url)
    frequent = {p: len(pages) for (site, p), pages in support.items() if len(pages) >= 5}
    marked = {(k, i + 1) for k, url, text in rows if url[8] == "s" for i, line in enumerate(text.split("\n")) if (line[5],) in frequent}
    names = []
    monkeypatch.setattr(repeated_lines, "cut", lambda d, name: names.append(name) or common.cut(d, name))
    got, ends = (d.toPandas() for d in repeated_lines.prefixspan(df))
    assert got.groupby("length").patterns.sum().to_dict() == {n: sum(len(p) == n for p in frequent) for n in {len(p) for p in frequent}}
    at = {}
    for k, _, text in rows:
        at.setdefault(k, []).append(text.replace("line ", "").split("\n"))
    for r in got.itertuples():
        assert any(len(t) >= max(r.lines) and frequent.get(tuple(t[i - 1] for i in r.lines)) == r.pages for t in at[r.first_doc]) and len(r.lines) == r.length and r.lines[0] == r.first_line
    assert set(zip(ends.doc, ends.line_no)) == marked
    deepest = max(int(n[8:]) for n in names if n.startswith("p2-level"))
    names.clear()
    assert {(r.point_id, r.line_no) for r in repeated_lines.repeated_lines(df).collect()} == marked
    assert deepest > 2 and f"p2-level{deepest}" in names  # grown until nothing new is frequent


# 3


def test_neighbours_against_brute_force(spark):
    rng = np.random.default_rng(1)
    v = rng.standard_normal((900, 16)).astype(np.float32)
    v[100:140] = v[3]  # equal vectors
    v[200:210] = 2 * v[4]  # equal directions
    df = spark.createDataFrame([(k, "m" if k % 3 else "n", x.tolist()) for k, x in enumerate(v)], "id long, model string, vector array<float>")
    got = knn_forest.all_knn(df).toPandas().groupby("id").neighbour_id.apply(list)
    forest = knn_forest.all_knn(df, trees=8, candidates=700, segment=1000).toPandas().groupby("id").neighbour_id.apply(list)
    x = v.astype(np.float64)
    x /= np.sqrt((x * x).sum(1, keepdims=True))
    hit = 0
    for k in range(900):
        own = [j for j in range(900) if j != k and (j % 3 > 0) == (k % 3 > 0)]
        s = np.round(x[own] @ x[k], 10)
        want = [own[j] for j in np.lexsort((own, -s))[:8]]
        assert got[k] == want
        hit += len(set(want) & set(forest[k]))
    assert 0.9 < hit / (900 * 8) < 1, hit / (900 * 8)


@pytest.mark.parametrize("copies", [1, 2])
def test_neighbours_among_scaled_copies(spark, copies):
    """More vectors of one direction, each of its own norm, than float32 tells apart: ties go to the smallest ids."""
    rng = np.random.default_rng(3)
    one = rng.standard_normal(48)
    v = np.concatenate([rng.uniform(0.1, 9, (300, 1)) * one, rng.standard_normal((100, 48))]).astype(np.float32)
    v = np.repeat(v, copies, 0)[rng.permutation(400 * copies)]
    df = spark.createDataFrame([(k, "m", x.tolist()) for k, x in enumerate(v)], "id long, model string, vector array<float>")
    got = knn_forest.all_knn(df).toPandas().groupby("id").neighbour_id.apply(list)
    x = v.astype(np.float64)
    x /= np.sqrt((x * x).sum(1, keepdims=True))
    s = np.round(x @ x.T, 10)
    for k in range(len(v)):
        others = np.delete(np.arange(len(v)), k)
        assert got[k] == list(others[np.lexsort((others, -s[k, others]))[:8]])


def test_valid_vectors(spark):
    t = "2024-01-0{} 00:00:00".format
    rows = [(1, " M ", [1.0, 0.0], t(1)), (1, "m", [0.0, 1.0], t(2)), (1, "m", [0.0, 1.0], t(2)), (2, "m", [1.0], t(1)), (3, "m", [0.0, 0.0], t(1)), (4, "m", [1.0, float("nan")], t(1)), (5, "m", [1.0, None], t(1)), (6, "m", None, t(1)), (7, None, [1.0, 2.0], t(1)), (8, "M", [1.0, float("inf")], t(1)), (9, "m", [3.0, 4.0], None), (10, "m", [1.0, 1.0], t(1)), (10, "m", None, t(3))]
    p = spark.createDataFrame(rows, "point_id long, embedding_model string, vector array<float>, updated_at string")
    c = spark.createDataFrame([("m", 2, 0), ("M ", 2, 1)], "embedding_model string, dim int, id int")
    got = knn_forest.valid_vectors(p, c)
    assert {(r.id, tuple(r.vector)) for r in got.collect()} == {(1, (0.0, 1.0)), (9, (3.0, 4.0))}
    assert {(r.id, r.neighbour_id) for r in knn_forest.all_knn(got).collect()} == {(1, 9), (9, 1)}
    assert knn_forest.all_knn(got.limit(0)).count() == 0


# 4


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="ab .\n。é🙂", max_size=400), st.integers(1, 20), st.integers(0, 19), st.integers(1, 4))
def test_pieces_round_trip(text, limit, overlap, per):
    overlap = min(overlap, limit - 1)
    t = splitter.CharTokens(per)
    at = splitter.spans(text, limit, overlap, t)
    out = ""
    for s, e in at:
        assert s <= len(out) <= e and t.count(text[s:e]) <= limit
        out += text[len(out) : e]
    assert out == text
    assert all(b[0] > a[0] and b[1] > a[1] for a, b in zip(at, at[1:]))


def test_split_oversized(spark):
    long = "Sentence one is here. " * 200
    df = spark.createDataFrame([(1, long, 0), (1, long, 0), (2, "x" * 2003, 0), (3, "x" * 2004, 0), (4, None, 0), (5, "", 0)], "request_id long, content string, start int")
    got = splitter.split_oversized(df).toPandas()
    assert sorted(set(got.request_id)) == [1, 3] and got.tokens.max() <= 500
    one = got[got.request_id == 1].sort_values("chunk_index")
    assert all(c.rstrip().endswith(".") for c in one.content) and list(one.total_chunks) == [len(one)] * len(one)
    overlaps = [a - b for a, b in zip(one.end[:-1], one.start[1:])]
    assert min(overlaps) > 0 and max(overlaps) <= 400
    path = "/opt/tokenizers/byte_bpe_50k.json"
    if os.path.exists(path):
        bpe = splitter.split_oversized(df, limit=100, overlap=20, tokenizer_path=path).toPandas()
        assert bpe[bpe.request_id == 1].tokens.max() <= 100
        odd = spark.createDataFrame([(1, "naïve🙂\n\n  x" * 200 + "ß" * 900), (2, "a.b,c;d " * 700)], "request_id long, content string")
        for limit in (1, 3, 10, 100):
            cut = splitter.split_oversized(odd, limit=limit, overlap=limit // 4, tokenizer_path=path).toPandas()
            assert ((cut.tokens <= limit) | (cut.end - cut.start == 1)).all() and set(cut.request_id) == {1, 2}


# 5


def brute(texts):
    grams = {i: {tuple(w[k : k + 3]) for k in range(len(w) - 2)} for i, t in texts.items() for w in [common.WORD.findall((t or "").lower())]}
    ids = sorted(i for i, g in grams.items() if g)
    return {(a, b) for n, a in enumerate(ids) for b in ids[n + 1 :] if 2 * len(grams[a] & grams[b]) >= len(grams[a] | grams[b])}


def test_near_duplicates(spark, monkeypatch):
    rng = random.Random(5)
    vocab = [f"w{k}" for k in range(400)]
    texts = {}
    for k in range(120):
        base = [rng.choice(vocab) for _ in range(60)]
        texts[k * 10] = " ".join(base)
        for e in range(1, 4):
            edit = list(base)
            for _ in range(e * 2):
                edit[rng.randrange(60)] = rng.choice(vocab)
            texts[k * 10 + e] = "  ".join(edit).upper()
        texts[k * 10 + 5] = " ".join(base) + "!"
    texts |= {5001: None, 5002: "", 5003: "two words", 5004: "äö ß 東 京 x"}
    df = spark.createDataFrame([*texts.items(), (0, texts[0])], "point_id long, text string").withColumns({"id": F.lit(1), "rep": F.lit(2), "a": F.lit(3)})
    got = {(r.point_id_a, r.point_id_b) for r in near_dups.near_duplicate_pairs(df).collect()}
    want = brute(texts)
    assert got <= want and len(got) >= 0.995 * len(want)
    monkeypatch.setattr(near_dups, "BLOCK_ROWS", 2)  # buckets in blocks lose nothing
    assert {(r.point_id_a, r.point_id_b) for r in near_dups.near_duplicate_pairs(df).collect()} == got
    monkeypatch.setattr(near_dups, "SAMPLED", 1)
    monkeypatch.setattr(near_dups, "HEAVY", 3)  # nor do heavy buckets
    assert {(r.point_id_a, r.point_id_b) for r in near_dups.near_duplicate_pairs(df).collect()} == got
    star = {(r.point_id_a, r.point_id_b) for r in near_dups.near_duplicate_pairs(df, expand_up_to=1).collect()}
    assert star < got and {(k * 10, k * 10 + 5) for k in range(120)} <= star
    groups = near_dups.near_duplicate_groups(df, 0.5).toPandas().set_index("point_id").group_id
    parent = {i: i for i in texts}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in got:
        parent[max(root(a), root(b))] = min(root(a), root(b))
    assert all(groups[i] == root(i) for i in groups.index)
    assert near_dups.near_duplicate_pairs(df.limit(0)).count() == 0


def test_groups_hold_all_edited_copies(spark):
    base = [f"w{k}" for k in range(40)]
    edited = base[:10] + ["x"] + base[11:30] + ["y"] + base[31:]  # similarity 32 / 44, between 0.5 and 0.8
    texts = [(1, " ".join(base)), (2, " ".join(edited)), (2, " ".join(edited)), (3, "other words altogether here"), (4, None), (5, ""), (6, " -- "), (7, None), (8, "two words"), (None, "x")]
    df = spark.createDataFrame(texts, "point_id long, text string")
    got = sorted((r.point_id, r.group_id, r.links) for r in near_dups.near_duplicate_groups(df).collect())
    assert got == [(1, 1, 1), (2, 1, 1)] + [(k, k, 0) for k in range(3, 9)]


# 6


def test_leaks(spark):
    rng = random.Random(2)
    vocab = [f"v{k}" for k in range(60)] + ["the", "of"] * 10
    items = {k: " ".join(rng.choice(vocab) for _ in range(40)) + "\nwhat is " + " ".join(rng.choice(vocab) for _ in range(14)) for k in range(40)}
    items |= {50: items[3], 51: "short item", 52: None}
    docs = {}
    for k in range(300):
        w = [rng.choice(vocab) for _ in range(rng.randint(0, 150))]
        if k % 3 == 0:
            src = items[rng.randrange(40)].split()
            n = rng.choice([10, 11, 12, 13, 30])
            s, p = rng.randrange(len(src) - n), rng.randrange(len(w) + 1)
            w[p:p] = src[s : s + n]
        docs[k] = rng.choice([" ", "\n", "- "]).join(w)
    docs |= {900: None, 901: "", 902: items[5].upper().replace(" ", " – ")}
    grams = {i: {tuple(w[k : k + 12]) for k in range(len(w) - 11)} for i, t in items.items() for w in [common.plain_words(t)]}
    want = {(d, i) for d, t in docs.items() for w in [common.plain_words(t)] for k in range(len(w) - 11) for i in grams if tuple(w[k : k + 12]) in grams[i]}
    e = spark.createDataFrame([(i, t, "v1 v2", 1) for i, t in items.items()] + [(0, items[0], "v1 v2", 1)], "item_id long, text string, answer string, doc_id int")
    df = spark.createDataFrame([*docs.items()], "doc_id long, text string").withColumn("item_id", F.lit(1))
    got = leakage.find_leaks(df, e)
    assert {(r.doc_id, r.item_id) for r in got.collect()} == want and len(want) > 60
    assert got.where("doc_id = 902").select(F.max("run_words")).first()[0] == 56
    assert leakage.find_leaks(df, e.limit(0)).count() == leakage.find_leaks(df.limit(0), e).count() == 0
    assert common.plain_words("Été STRASSE_x9") == ["ete", "strasse", "x9"]


# 7


def test_mixing(spark):
    docs = [(k, " A " if k % 2 else "a", "w " * 10) for k in range(1000)] + [(2000 + k, "b", "x\ty\nz ") for k in range(20)] + [(3000, None, "q"), (3001, "c", "q"), (3002, "a", None)]
    df = spark.createDataFrame(docs, "doc_id long, source string, text string").withColumns({"_source": F.lit(1), "tokens": F.lit(1)})
    t = spark.createDataFrame([("a", 0.5, 1), ("b", 0.4, 3), ("d", 0.1, 2)], "source string, target_share double, max_repeats int")
    plan = {r.source: r for r in mixing.source_plan(df, t).collect()}
    assert (plan["a"].tokens, plan["b"].tokens, plan["d"].tokens) == (10000, 60, 0)
    assert [s for s in plan if plan[s].short] == ["b", "d"] and plan["b"].repeats == 3.0
    got = mixing.mix(df, t, shards=8, blocks=64).toPandas()
    assert got[got.source == "b"].groupby("doc_id").size().eq(3).all()
    a = got[got.source == "a"]
    assert abs(a.tokens.sum() - plan["a"].planned) < 300 and not a.duplicated(["doc_id", "copy"]).any()
    parts = mixing.mix(df, t, shards=8, blocks=64).select("shard", "position", F.spark_partition_id().alias("part")).collect()
    assert all(a.shard != b.shard or a.part == b.part and a.position <= b.position for a, b in zip(parts, parts[1:]))
    path = "/opt/tokenizers/byte_bpe_50k.json"
    if os.path.exists(path):
        few = {r.source: r.tokens for r in mixing.source_plan(df, t, tokenizer_path=path).collect()}
        assert few["a"] >= 10000 and few["b"] >= 60 and few["d"] == 0
    assert mixing.source_plan(df.limit(0), t).count() == 3 and mixing.mix(df.limit(0), t).count() == 0
    dealt = mixing.splitting_tree({"x": 37, "y": 91}, 7, 1)
    assert [sum(v) for v in dealt.values()] == [37, 91] and max(map(sum, zip(*dealt.values()))) - min(map(sum, zip(*dealt.values()))) <= 1


@pytest.mark.parametrize("seed", range(3))
def test_quota_is_met_to_one_document(spark, seed):
    """Blocks as skewed as documents: one text holds 80 % of a source, or each quota is under half a block."""
    docs = [(k, "a", 10) for k in range(200)] + [(500, "a", 8000)] + [(1000 + k, "b", 7) for k in range(900)] + [(3000, "c", 100)]
    df = spark.createDataFrame(docs, "doc_id long, source string, n int").select("doc_id", "source", F.expr("repeat('w ', n)").alias("text"))
    for blocks, share in ((16, 0.2), (1, 0.1), (16, 0.02)):
        t = spark.createDataFrame([("a", share, 1), ("b", share, 2), ("c", 0.9, 3)], "source string, target_share double, max_repeats int")
        plan = {r.source: r for r in mixing.source_plan(df, t).collect()}
        got = mixing.mix(df, t, shards=4, blocks=blocks, seed=seed).toPandas()
        assert not got.duplicated(["source", "doc_id", "copy"]).any()
        used = got.groupby("source").tokens.sum()
        assert abs(used["a"] - plan["a"].planned) <= 10 and abs(used["b"] - plan["b"].planned) <= 7 and used["c"] == 300
        assert (got.groupby(["source", "doc_id"]).size() <= got.source.map({"a": 1, "b": 2, "c": 3}).groupby([got.source, got.doc_id]).first()).all()


def test_source_use_is_what_the_mixture_holds(spark):
    docs = [(k, "a", 10) for k in range(50)] + [(100, "b", 70), (101, "b", 20), (102, "c", 5)]
    df = spark.createDataFrame(docs, "doc_id long, source string, n int").select("doc_id", "source", F.expr("repeat('w ', n)").alias("text"))
    t = spark.createDataFrame([("a", 0.7, 1), ("b", 0.2, 1), ("c", 0.1, 2), ("d", 0.0, 1)], "source string, target_share double, max_repeats int")
    rows = mixing.mix(df, t).toPandas().groupby("source").tokens.sum()
    use = {r.source: r for r in mixing.source_use(df, t).collect()}
    for s in "abcd":
        assert use[s].used_tokens == rows.get(s, 0)
        assert use[s].actual_share == pytest.approx(rows.get(s, 0) / rows.sum())
    assert [s for s in "abcd" if use[s].short] == [s for s in "abcd" if {r.source: r.short for r in mixing.source_plan(df, t).collect()}[s]] == ["c"]
    assert use["a"].repeats == rows["a"] / 500 and use["c"].repeats == 2.0 and use["d"].used_documents == 0
    # No documents of b give what was planned: the use is what was dealt, not the plan.
    assert use["b"].planned == pytest.approx(71.4) and use["b"].used_tokens in (70, 90) and use["b"].repeats == use["b"].used_tokens / 90
    assert mixing.source_use(df.limit(0), t).count() == 4


# 8


def labelled_texts(n: int, seed: int, bad: float = 0.2) -> list[tuple[str, int]]:
    """Invented words stand for bad ones: a document is bad if it has a passage built around them."""
    rng = random.Random(seed)
    vocab = [f"{a}{b}{c}" for a in "klmnprst" for b in "aeiou" for c in ("n", "r", "st", "lt", "mp")]
    core = {1: "grolfen zibbat", 2: "you smurd plocking", 3: "folk dretch varnish"}
    out = []
    for _ in range(n):
        lines = [" ".join(rng.choice(vocab) for _ in range(8)) for _ in range(5)]
        g = rng.randint(1, 3) if rng.random() < bad else 0
        if g:
            lines[rng.randrange(5)] = f"the {core[g]} {rng.choice(vocab)} shall {core[g].split()[-1]} away"
        elif rng.random() < 0.2:
            lines[0] = f"a report says that {rng.choice(vocab)} smurd is a rule of the house"
        out.append((". ".join(lines) + ".", g))
    return out


def test_moderation(spark):
    texts = labelled_texts(600, 1) + labelled_texts(600, 3, 0.03)
    rng = random.Random(4)
    noisy = [(t, g if rng.random() > 0.04 else (0 if g else 2)) for t, g in texts[:600]] + [(t, -1) for t, _ in texts[600:]]
    model = moderation.train(noisy)
    held = labelled_texts(300, 2)
    severity, p = model.score([t for t, _ in held])
    said = p >= model.bar
    assert np.mean(said == np.array([g > 0 for _, g in held])) > 0.98
    grade = np.array([g for _, g in held])
    assert severity[grade == 3].mean() > severity[grade == 2].mean() > severity[grade == 1].mean() > severity[grade == 0].mean()
    for bad in ("The you SMURRRD plocking xan shall p l o c k i n g away", "the you 5murd pl0cking kan shall plocking away", "the you sm*rd pl*cking ran shall plocking away", "the you s\u200bmurd p-l-o-c-k-i-n-g shall plocking away"):
        assert model.score(["Fine. " + bad])[1][0] >= model.bar
    assert list(moderation.train([]).score(["smurd", None, ""])[1] < 0.1) == [True] * 3
    labels = spark.createDataFrame([(1, " ABUSE ", "r"), (1, "abuse", None), (1, "ok", "s"), (2, "ok", None), (2, "hate", None), (3, None, None), (4, "odd", "r")], "doc_id long, label string, rater string")
    assert {(r.doc_id, r.grade) for r in moderation.agreed_labels(labels).collect()} == {(1, 2)}
    docs = spark.createDataFrame([(1, "the you smurd plocking kan shall plocking away", "S "), (2, "kan ran", "s"), (3, None, None), (4, "", "t"), (2, "kan ran", "s")], "doc_id long, text string, source string").withColumns({"id": F.lit(1), "severity": F.lit(2)})
    scores = moderation.score_texts(docs, model)
    assert {r.doc_id: r.flagged for r in scores.collect()} == {1: True, 2: False, 3: False, 4: False}
    assert {(r.source, r.documents, r.flagged) for r in moderation.source_rates(docs, scores).collect()} == {("s", 2, 1), (None, 1, 0), ("t", 1, 0)}
    assert not any(r.flagged for r in moderation.score_texts(docs, moderation.fit(docs, labels.limit(0))).collect())
    assert moderation.score_texts(docs.limit(0), model).count() == 0 and moderation.fit(docs.limit(0), labels.limit(0)) is not None
    frame = spark.createDataFrame([(k, t) for k, (t, _) in enumerate(texts)], "doc_id long, text string")
    names = {v: k for k, v in moderation.GRADES.items()}
    rated = spark.createDataFrame([(k, names[g], "r") for k, (_, g) in enumerate(noisy[:600])], "doc_id long, label string, rater string")
    got = moderation.score_texts(frame, moderation.fit(frame, rated)).toPandas().set_index("doc_id").flagged
    assert np.mean([got[k] == (g > 0) for k, (_, g) in enumerate(texts)]) > 0.98
