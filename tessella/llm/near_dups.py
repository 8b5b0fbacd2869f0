"""Problem 5: near-duplicate texts by b-bit MinHash.

Texts with the same words are one class.  For each class: minima of ROWS x BANDS hash functions over the shingles of
three words; each band of ROWS minima makes a key; the lowest two bits of every minimum are packed into longs.  Classes
that share a key are candidates; the count of packed minima that agree gives an estimate of the similarity, corrected
for the quarter of them that agree by chance, first over 64 minima that travel with the keys, then over all.  The
pairs that pass are checked exactly over all shingles.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.llm.common import cut, small

#: A pair of similarity s is a candidate with probability 1 - (1 - s**ROWS)**BANDS: 0.955 at 0.5, 0.9988 at 0.6.
ROWS, BANDS = 4, 48
#: Minima packed in a long, longs of all minima, and of those that travel with the band keys.
LANES = 32
LONGS, NEAR_LONGS = ROWS * BANDS // LANES, 2
#: Buckets above this many classes are compared block by block (no pair is lost).
BLOCK_ROWS = 2048
#: Buckets of which a sample of one class in SAMPLED holds at least HEAVY members are dealt into blocks by that estimate,
#: without being counted in one place; up to so many of them are broadcast (16 bytes each).
SAMPLED, HEAVY, MAX_BROADCAST_KEYS = 64, 32, 2_000_000
#: Up to so many ids of candidates (16 bytes each) are broadcast; beyond that the join with the texts is shuffled.
MAX_BROADCAST_IDS = 3_000_000
_SEED = np.random.default_rng(20240501)
_MUL = _SEED.integers(1, 1 << 63, ROWS * BANDS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _SEED.integers(0, 1 << 63, ROWS * BANDS, dtype=np.uint64)
_MIX = np.uint64(0x9E3779B97F4A7C15)  # 2**64 divided by the golden ratio


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _MIX
    return x ^ (x >> np.uint64(29))


def sketch(texts: pa.Array, n: int = 3) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of texts whose words are parted by single spaces: rows with at least n words, their band keys (rows x BANDS,
    uint32) and packed bits (rows x LONGS)."""
    lists = pc.split_pattern(texts, " ")
    offsets = np.asarray(lists.offsets)
    flat = lists.flatten().dictionary_encode()
    # A word's number depends on its letters only: eight bytes at a time, mixed.
    terms = flat.dictionary.to_pylist()
    codes = np.fromiter((int.from_bytes(blake2b(w.encode(), digest_size=8).digest(), "little") for w in terms), dtype=np.uint64, count=len(terms))
    words = codes[np.asarray(flat.indices)] if len(terms) else np.zeros(0, np.uint64)
    lengths = np.diff(offsets)
    rows = np.flatnonzero(lengths >= n)
    keys, bits = np.empty((len(rows), BANDS), np.uint32), np.empty((len(rows), LONGS), np.uint64)
    if not len(rows):
        return rows, keys, bits
    # Shingles of all texts in one array; those that would span two texts are left out.
    h = words[: len(words) - n + 1].copy()
    for k in range(1, n):
        h = _mixed(h) + words[k : len(words) - n + 1 + k] * _MUL[k]
    h = _mixed(h)
    base = offsets[0]
    at = 0
    places = np.arange(LANES, dtype=np.uint64) * np.uint64(2)
    while at < len(rows):  # some thousand shingles at a time stay in the cache
        end, count = at, 0
        while end < len(rows) and (count == 0 or count + lengths[rows[end]] < 60_000):
            count += lengths[rows[end]]
            end += 1
        some = rows[at:end]
        sizes = lengths[some] - n + 1
        first = np.concatenate(([0], np.cumsum(sizes)[:-1]))
        pos = np.repeat(offsets[some] - base - first, sizes) + np.arange(sizes.sum())
        x = h[pos]
        minima = np.empty((ROWS * BANDS, len(some)), np.uint32)
        buf = np.empty_like(x)
        for k in range(ROWS * BANDS):
            np.multiply(x, _MUL[k], out=buf)
            np.add(buf, _ADD[k], out=buf)
            minima[k] = np.minimum.reduceat(buf.view(np.uint32)[1::2], first)  # the high halves
        m = minima.astype(np.uint64)
        band = np.zeros((BANDS, len(some)), np.uint64)
        for r in range(ROWS):
            band = _mixed(band + m[r * BANDS : (r + 1) * BANDS] + np.uint64(r + 1))
        keys[at:end] = (band >> np.uint64(32)).astype(np.uint32).T
        low = ((m & np.uint64(3)).T.reshape(len(some), LONGS, LANES) << places).sum(2, dtype=np.uint64)
        bits[at:end] = low
        at = end
    return rows, keys, bits


def normal_words(text: Column) -> Column:
    """Words (runs of letters and digits) in lower case, parted by single spaces."""
    return F.trim(F.lower(F.regexp_replace(text, r"[^\p{L}\p{N}]+", " ")))


_BITS = tuple(f"b{k}" for k in range(LONGS))


def _sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for lo in range(0, b.num_rows, 2000):
            c = b.slice(lo, 2000)
            rows, keys, bits = sketch(c.column("w"))
            if len(rows):
                take = pa.array(rows)
                packed = pa.Array.from_buffers(pa.list_(pa.int32()), len(rows), [None, pa.py_buffer(np.arange(0, (len(rows) + 1) * BANDS, BANDS, dtype=np.int32))], children=[pa.array(np.ascontiguousarray(keys).view(np.int32).ravel())])
                yield pa.RecordBatch.from_arrays([*(c.column(n).take(take) for n in ("id", "h1", "h2")), packed, *(pa.array(bits[:, k].copy().view(np.int64)) for k in range(LONGS))], ["id", "h1", "h2", "bands", *_BITS])


def word_rows(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, w (the words), h1 and h2 (128 bits of them, by which texts of the same words are known)."""
    rows = df.select(F.col(id_col).alias("id"), normal_words(F.col(text_col)).alias("w")).where("id is not null and w <> ''")
    return rows.select("id", F.xxhash64("w").alias("h1"), F.xxhash64(F.lit(1), "w").alias("h2"), "w")


def classes(df: DataFrame, id_col: str = "point_id", text_col: str = "text") -> DataFrame:
    """One row per class of texts with the same words, as a written table: h1, h2, rep (smallest id), copies, bands, bits."""
    rows = word_rows(df, id_col, text_col).mapInArrow(_sketches, "id bigint, h1 bigint, h2 bigint, bands array<int>, " + ", ".join(f"{b} bigint" for b in _BITS))
    # Equal words, equal sketch: partial aggregation merges the copies before they are shuffled.
    one = rows.groupBy("h1", "h2").agg(F.min("id").alias("rep"), F.max("id").alias("last"), *(F.first(c).alias(c) for c in ("bands", *_BITS)))
    return cut(one, "p5-classes")


def _bar(threshold: float, longs: int) -> int:
    """Of n packed minima a pair of similarity s agrees in n (1 + 3 s) / 4 on average: the count 3.5 standard deviations
    below what the threshold gives."""
    n, p = LANES * longs, (1 + 3 * threshold) / 4
    return int(n * p - 3.5 * (n * p * (1 - p)) ** 0.5)


def _agreeing(left: str, right: str, longs: int) -> Column:
    """How many of the packed minima agree."""
    out = F.lit(LANES * longs)
    for k in range(longs):
        x = F.col(f"{left}b{k}").bitwiseXOR(F.col(f"{right}b{k}"))
        out = out - F.bit_count(x.bitwiseOR(F.shiftrightunsigned(x, 1)).bitwiseAND(F.lit(0x5555555555555555)))
    return out


def candidate_pairs(cls: DataFrame, threshold: float) -> DataFrame:
    """Pairs a < b of classes that share a band and of whose packed minima enough agree.

    A bucket of more than BLOCK_ROWS classes is compared block by block: each member goes to the pairs of blocks that
    hold it, so that no task holds more than two blocks of it and no pair is lost.  How many blocks a heavy bucket has is
    estimated from a sample of all classes, so none of it is gathered to be counted; whatever the estimate, all members
    of a bucket share it, and the blocks hold all pairs."""
    near = _BITS[:NEAR_LONGS]
    keyed = cls.select("rep", *near, F.posexplode("bands").alias("band", "h")).select("rep", *near, (F.col("band").cast("bigint") * F.lit(1 << 32) + F.col("h")).alias("key"))
    sample = keyed.where(F.pmod(F.xxhash64("rep", F.lit(3)), F.lit(SAMPLED)) == 0).groupBy("key").agg((F.count(F.lit(1)) * SAMPLED).alias("n"))
    heavy = cut(sample.where(F.col("n") >= HEAVY * SAMPLED), "p5-heavy")
    many = heavy.count()
    sized = keyed
    if many:
        sized = keyed.join(small(heavy.select("key"), many, MAX_BROADCAST_KEYS), "key", "left_anti")
    sized = sized.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("key"))).where("n > 1")
    if many:
        sized = sized.unionByName(keyed.join(small(heavy, many, MAX_BROADCAST_KEYS), "key").select(sized.columns))
    sized = cut(sized, "p5-shared")  # used for both sides; few classes share a key
    sized = sized.withColumn("blocks", F.ceil(F.col("n") / F.lit(BLOCK_ROWS)).cast("int")).withColumn("own", F.pmod(F.hash("rep"), F.col("blocks")))

    def side(name: str, own: str, other: str, others: Column) -> DataFrame:
        return sized.withColumn("other", F.explode(others)).select("key", F.col("own").alias(own), F.col("other").alias(other), *(F.col(c).alias(f"{name}{c}") for c in ("rep", *near)))

    left = side("l_", "i", "j", F.sequence(F.col("own"), F.col("blocks") - 1))
    right = side("r_", "j", "i", F.sequence(F.lit(0), F.col("own")))
    once = (F.col("i") < F.col("j")) | (F.col("l_rep") < F.col("r_rep"))
    pairs = left.join(right, ["key", "i", "j"]).where((F.col("l_rep") != F.col("r_rep")) & once & (_agreeing("l_", "r_", NEAR_LONGS) >= _bar(threshold, NEAR_LONGS)))
    pairs = pairs.select(F.least("l_rep", "r_rep").alias("a"), F.greatest("l_rep", "r_rep").alias("b")).distinct()
    packed = cls.select("rep", *_BITS)
    for name, c in (("l_", "a"), ("r_", "b")):
        pairs = pairs.join(packed.select(F.col("rep").alias(c), *(F.col(x).alias(f"{name}{x}") for x in _BITS)), c)
    return pairs.where(_agreeing("l_", "r_", LONGS) >= _bar(threshold, LONGS)).select("a", "b")


def _verify(threshold: float, n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def grams(text: str) -> set[tuple[str, ...]]:
            w = text.split(" ")
            return {*zip(*(w[k:] for k in range(n)))}

        for b in batches:
            keep, sims = [], []
            for k, (x, y) in enumerate(zip(b.column("wa").to_pylist(), b.column("wb").to_pylist())):
                s, t = grams(x), grams(y)
                both = len(s & t)
                if both >= threshold * (len(s) + len(t) - both):
                    keep.append(k)
                    sims.append(both / (len(s) + len(t) - both))
            if keep:
                take = pa.array(keep)
                yield pa.RecordBatch.from_arrays([b.column("a").take(take), b.column("b").take(take), pa.array(sims, pa.float64())], ["a", "b", "similarity"])

    return run


def similar_classes(df: DataFrame, cls: DataFrame, threshold: float, id_col: str, text_col: str) -> DataFrame:
    """(a, b, similarity): pairs of class representatives with different words, as a written table."""
    pairs = cut(candidate_pairs(cls, threshold), "p5-candidates")
    ids = cut(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct(), "p5-candidate-ids")
    words = word_rows(df, id_col, text_col).select("id", "w").join(small(ids, ids.count(), MAX_BROADCAST_IDS), "id", "left_semi").dropDuplicates(["id"])
    both = pairs.join(words.select(F.col("id").alias("a"), F.col("w").alias("wa")), "a").join(words.select(F.col("id").alias("b"), F.col("w").alias("wb")), "b")
    return cut(both.mapInArrow(_verify(threshold, 3), "a bigint, b bigint, similarity double"), "p5-similar")


def near_duplicate_pairs(df: DataFrame, threshold: float = 0.5, expand_up_to: int = 64, id_col: str = "point_id", text_col: str = "text") -> DataFrame:
    """(id_a, id_b, similarity) with id_a < id_b: pairs of rows whose texts reach the threshold.

    Classes of at most expand_up_to copies are written out in all their pairs.  Of a larger class each member is
    paired with the class's smallest id, and that id with what other texts it is similar to: no link between texts
    is lost, and a class that holds a third of all rows gives as many pairs as it has rows.
    Null, blank and shorter texts than three words have no shingles and no pairs.  Repeated rows of an id count once."""
    cls = classes(df, id_col, text_col)
    similar = similar_classes(df, cls, threshold, id_col, text_col)
    many = cls.where("last > rep").select("h1", "h2", "rep")
    rows = word_rows(df, id_col, text_col).select("id", "h1", "h2").distinct()
    members = cut(rows.join(many, ["h1", "h2"]).select("rep", "id"), "p5-members")
    sizes = members.groupBy("rep").agg(F.count(F.lit(1)).alias("n"))
    members = members.join(sizes, "rep")
    few = members.where(F.col("n") <= expand_up_to).select("rep", "id")
    inside = few.alias("x").join(few.alias("y"), "rep").where("x.id < y.id").select(F.col("x.id").alias("a"), F.col("y.id").alias("b"))
    star = members.where((F.col("n") > expand_up_to) & (F.col("id") != F.col("rep"))).select(F.col("rep").alias("a"), F.col("id").alias("b"))
    left = similar.join(few.select(F.col("rep").alias("a"), F.col("id").alias("ia")), "a", "left")
    full = left.join(few.select(F.col("rep").alias("b"), F.col("id").alias("ib")), "b", "left")
    across = full.select(F.coalesce("ia", "a").alias("x"), F.coalesce("ib", "b").alias("y"), "similarity").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), "similarity")
    copies = inside.unionByName(star).withColumn("similarity", F.lit(1.0))
    return across.unionByName(copies).select(F.col("a").alias(f"{id_col}_a"), F.col("b").alias(f"{id_col}_b"), "similarity")


def near_duplicate_groups(df: DataFrame, threshold: float = 0.5, id_col: str = "point_id", text_col: str = "text", max_rounds: int = 60) -> DataFrame:
    """(id, group_id, links): every id, the smallest id of its connected group, and the number of other classes its
    text is linked to.  Texts without words (null, blank) are linked to nothing: each is a group of its own.

    Components over class representatives by alternating large-star and small-star rounds, each written to the shared
    folder, until nothing changes; a hub's edges are re-hung to smaller neighbours, never gathered into one list."""
    cls = classes(df, id_col, text_col)
    similar = similar_classes(df, cls, threshold, id_col, text_col)
    both = similar.select(F.col("a").alias("u"), F.col("b").alias("v"))
    links = both.unionByName(both.select(F.col("v").alias("u"), F.col("u").alias("v"))).groupBy("u").agg(F.count(F.lit(1)).alias("links"))
    edges, last = both, None
    for k in range(max_rounds):
        sym = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = sym.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = sym.join(least, "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        least = low.groupBy("u").agg(F.min("v").alias("m"))
        near = low.join(least, "u")
        edges = cut(near.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").unionByName(near.select("u", F.col("m").alias("v"))).distinct(), f"p5-round{k}")
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == last:
            break
        last = now
    else:
        raise RuntimeError(f"components are not complete after {max_rounds} rounds")
    roots = edges.groupBy("u").agg(F.min("v").alias("root")).withColumnRenamed("u", "rep")
    per = cls.select("h1", "h2", "rep").join(roots, "rep", "left").join(links.withColumnRenamed("u", "rep"), "rep", "left").select("h1", "h2", F.coalesce("root", "rep").alias("group_id"), F.coalesce("links", F.lit(0)).alias("links"))
    words = F.when(F.col("w") != "", F.struct(F.xxhash64("w").alias("h1"), F.xxhash64(F.lit(1), "w").alias("h2")))
    rows = df.select(F.col(id_col).alias("id"), normal_words(F.col(text_col)).alias("w")).where("id is not null")
    rows = rows.groupBy("id").agg(F.collect_set(words).alias("x")).select("id", F.explode_outer("x").alias("x")).select("id", "x.h1", "x.h2")
    return rows.join(per, ["h1", "h2"], "left").select(F.col("id").alias(id_col), F.coalesce("group_id", "id").alias("group_id"), F.coalesce("links", F.lit(0)).alias("links"))
