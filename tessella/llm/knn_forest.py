"""Problem 3: the k most similar vectors for every vector, by a hash-prefix forest.

Each of several trees gives every vector a long hash string of 60 signs and is the array of these strings in their
order, so that vectors which share a prefix stand side by side.  A vector descends to its own place in each array,
where the longest prefixes are shared with its next neighbours.  Then it ascends in all trees at once: prefixes get
shorter by one sign at a time, the same length in every tree, until the trees together hold enough candidates.  So a
vector among many others stops at a long prefix and a lonely one ascends further, to the root if need be.  The
candidates are compared by matrix products over the stretch of the array that they are; the best of all trees are
merged, and the cosines that decide are computed in double precision.

The signs are those of projections that prefer the directions in which a model's vectors differ most, fitted on a
bounded sample of its vectors; every vector is indexed.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.llm.common import cut, small

HASH_BITS = 60
#: Trees; candidates, of all trees together (a vector met in two trees counts twice), at which the ascent ends.
TREES, CANDIDATES = 8, 16_000
#: Vectors of a model, those of the smallest hashes, on which its projections are fitted.
SAMPLE = 4096
#: Lengths of prefixes that the ascent looks at, around the one at which a tree alone would hold its part; then the root.
ABOVE, BELOW = 5, 5
#: A tree's array is cut into segments of about so many vectors; a stretch of candidates ends with its segment.
SEGMENT = 16_384
#: Up to so many rows of counts or levels (about 40 bytes each) are broadcast; beyond that the joins are shuffled.
MAX_BROADCAST = 3_000_000


def model_key(c: Column) -> Column:
    return F.lower(F.regexp_replace(c, r"^\s+|\s+$", ""))


def valid_vectors(points: DataFrame, collections: DataFrame) -> DataFrame:
    """(id, model, vector): the latest version of each point, if it is valid.

    Valid: not null, of the length that collections gives for the model, all elements finite and not null, not all
    zero.  Of versions with equal updated_at the larger vector counts (identical repeats are one); a null updated_at is
    older than any other.  Models are compared without outer spaces and letter case; unknown or null ones aren't valid.
    Partial aggregation keeps one version of a point before the shuffle."""
    latest = points.where("point_id is not null").groupBy("point_id").agg(F.max_by(F.struct(model_key(F.col("embedding_model")).alias("model"), "vector"), F.struct("updated_at", F.xxhash64("vector"))).alias("x"))
    dims = collections.select(model_key(F.col("embedding_model")).alias("model"), F.col("dim").cast("int").alias("dim")).where("model is not null").dropDuplicates(["model"])
    rows = latest.select(F.col("point_id").alias("id"), "x.model", F.col("x.vector").alias("vector")).join(dims, "model")
    finite = F.forall("vector", lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf")))
    return rows.where((F.size("vector") == F.col("dim")) & finite & F.exists("vector", lambda e: e != 0)).select("id", "model", "vector")


def _planes(sample: np.ndarray, tree: int) -> tuple[np.ndarray, np.ndarray]:
    """(dim x HASH_BITS directions, HASH_BITS thresholds): random combinations of the sample's principal directions,
    each weighted with its variance; thresholds are medians, so that a sign halves the vectors."""
    mean = sample.mean(0)
    _, size, axes = np.linalg.svd(sample - mean, full_matrices=False)
    share = (size / size[0]) ** 2 if size[0] > 0 else np.ones_like(size)
    planes = axes.T @ (share[:, None] * np.random.default_rng([17, sample.shape[1], tree]).standard_normal((len(size), HASH_BITS)))
    return planes.astype(np.float32), np.median(sample @ planes, axis=0).astype(np.float32)


def _matrix(col: pa.Array) -> np.ndarray:
    """Rows of equal length, as doubles of norm 1.  Divided by the largest element first: squares can't overflow."""
    v = np.asarray(col.flatten()).astype(np.float64).reshape(len(col), -1)
    v = v / np.abs(v).max(1, keepdims=True)
    return v / np.sqrt((v * v).sum(1, keepdims=True))


def _hashes(shipped):
    """shipped: for each model its planes and thresholds, side by side for all trees."""
    w = np.int64(1) << np.arange(HASH_BITS - 1, -1, -1, dtype=np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            models = np.array(b.column("model").to_pylist())
            for m in sorted(set(models.tolist())):
                c = b.take(pa.array(np.flatnonzero(models == m)))
                planes, bars = shipped.value[m]
                up = _matrix(c.column("vector")).astype(np.float32) @ planes > bars
                h = up.reshape(c.num_rows, -1, HASH_BITS) @ w
                yield pa.RecordBatch.from_arrays([*(c.column(x) for x in ("uid", "model", "ids", "vector")), pa.FixedSizeListArray.from_arrays(pa.array(h.ravel()), h.shape[1]).cast(pa.list_(pa.int64()))], ["uid", "model", "ids", "vector", "hashes"])

    return run


def _crowded(v: np.ndarray, q: np.ndarray, near: np.ndarray, keep: int, take: int) -> tuple[np.ndarray, np.ndarray]:
    """For queries with more candidates than float32 can tell apart: the keep entries of highest cosine, ties to the
    smaller id, and their cosines; filled up to take.  near: the candidates, by id."""
    cos = np.round(v[q] @ v[near].T, 10)
    cos[near[None, :] == q[:, None]] = 1.0
    last = np.partition(cos, len(near) - keep, axis=1)[:, len(near) - keep]
    top, exact = np.zeros((len(q), take), np.int64), np.full((len(q), take), -2.0)
    for r in range(len(q)):
        above, equal = np.flatnonzero(cos[r] > last[r]), np.flatnonzero(cos[r] == last[r])
        best = np.concatenate((above, equal[: keep - len(above)]))
        top[r, :keep], exact[r, :keep] = near[best], cos[r, best]
    return top, exact


def _best(v: np.ndarray, v32: np.ndarray, first: np.ndarray, q: np.ndarray, lo: int, hi: int, keep: int) -> tuple[np.ndarray, np.ndarray]:
    """(entries, cosines) for each query of q: the keep (fewer, if there are fewer) of highest cosine among the entries lo
    to hi, ties to the smaller first id, and some more; the query itself with 1."""
    near, near32 = v[lo:hi], v32[lo:hi]
    own = q - lo
    take = min(hi - lo, keep + 8)
    keep = min(keep, take)
    # A float32 product of unit vectors is off by less than half of this (rounded elements, products and sums).
    margin = np.float32(2 * (v.shape[1] + 3) * 2.0**-24 + 1e-9)
    s = v32[q] @ near32.T
    s[np.arange(len(q)), own] = 2.0
    top = np.argpartition(-s, take - 1, axis=1)[:, :take] if take < len(near) else np.tile(np.arange(len(near)), (len(q), 1))
    exact = np.round(np.einsum("qd,qcd->qc", v[q], near[top]), 10)
    exact[top == own[:, None]] = 1.0
    if take < len(near):
        bar = np.partition(np.take_along_axis(s, top, 1), take - keep, axis=1)[:, take - keep] - margin
        crowded = np.flatnonzero((s >= bar[:, None]).sum(1) > take)
        if len(crowded):
            by_id = np.argsort(first[lo:hi])
            top[crowded], exact[crowded] = _crowded(near, own[crowded], by_id[(s[crowded] >= bar[crowded, None]).any(0)[by_id]], keep, take)
    return top + lo, exact


def _segment(k: int):
    """Compares the queries of one segment of the sorted arrays, in which rows stand by model, tree, hash."""
    keep = k + 1
    names = ["uid", "found", "cos"]

    def array_part(t: pa.Table) -> Iterator[pa.RecordBatch]:
        v = _matrix(t.column("vector").combine_chunks())
        v32 = v.astype(np.float32)
        h, level, uid = (np.asarray(t.column(c)) for c in ("h", "level", "uid"))
        lists = t.column("ids").combine_chunks()
        ids, start = np.asarray(lists.flatten()), np.asarray(lists.offsets)
        start = start - start[0]
        first, lone = ids[start[:-1]], len(ids) == len(uid)
        asks = np.flatnonzero((level > 0) | (np.asarray(t.column("tree")) == 0))  # the root is the same in all trees
        shift = HASH_BITS - level[asks]
        low = (h[asks] >> shift) << shift
        lo, hi = np.searchsorted(h, low), np.searchsorted(h, low + (np.int64(1) << shift))
        order = np.lexsort((hi, lo))
        asks, lo, hi = asks[order], lo[order], hi[order]
        cuts = np.flatnonzero(np.concatenate(([True], (lo[1:] != lo[:-1]) | (hi[1:] != hi[:-1])))) if len(asks) else []
        for s, e in zip(cuts, [*cuts[1:], len(asks)]):
            for a in range(s, e, 512):
                q = asks[a : min(e, a + 512)]
                top, exact = _best(v, v32, first, q, int(lo[s]), int(hi[s]), keep)
                if lone:
                    o = np.lexsort((first[top], -exact), axis=1)[:, :keep]
                    found, cos = list(np.take_along_axis(first[top], o, 1)), list(np.take_along_axis(exact, o, 1))
                else:
                    found, cos = [], []
                    for r in range(len(q)):
                        flat = sorted((-c, i) for c, x in zip(exact[r], top[r]) for i in ids[start[x] : start[x + 1]].tolist())[:keep]
                        found.append([i for _, i in flat])
                        cos.append([-c for c, _ in flat])
                yield pa.RecordBatch.from_arrays([pa.array(uid[q]), pa.array(found, pa.list_(pa.int64())), pa.array(cos, pa.list_(pa.float64()))], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [b for b in batches if b.num_rows]  # one segment, so bounded
        if not rows:
            return
        t = pa.Table.from_batches(rows)
        model, tree = np.array(t.column("model").to_pylist()), np.asarray(t.column("tree"))
        begins = np.flatnonzero(np.concatenate(([True], (model[1:] != model[:-1]) | (tree[1:] != tree[:-1]))))
        for s, e in zip(begins, [*begins[1:], len(tree)]):
            yield from array_part(t.slice(s, e - s))

    return run


def _levels(hashed: DataFrame, sizes: dict[str, int], trees: int, candidates: int) -> DataFrame:
    """(uid, level): the length of prefix at which a vector's synchronous ascent ends: the longest one that in all trees
    together at least `candidates` vectors share with it, 0 (the root) if none of those looked at has so many.

    Counts of prefixes are a table; neither they nor hashes come to the driver."""
    rows = []
    for m, n in sizes.items():
        alone = math.log2(max(1.0, n * trees / candidates))
        rows += [(m, d) for d in range(max(1, math.floor(alone) - ABOVE), min(HASH_BITS, math.ceil(alone) + BELOW) + 1) if n * trees > candidates]
    spark = hashed.sparkSession
    looked = F.broadcast(spark.createDataFrame(rows, "model string, level int"))  # some ten rows a model
    at = hashed.select("uid", "model", F.posexplode("hashes").alias("tree", "h")).join(looked, "model")
    at = at.select("uid", "model", "tree", "level", F.expr(f"shiftright(h, {HASH_BITS} - level)").alias("prefix"))
    counts = cut(at.groupBy("model", "tree", "level", "prefix").agg(F.count(F.lit(1)).alias("n")), "p3-counts")
    held = at.join(small(counts, counts.count(), MAX_BROADCAST), ["model", "tree", "level", "prefix"]).groupBy("uid", "level").agg(F.sum("n").alias("n"))
    return cut(held.where(F.col("n") >= candidates).groupBy("uid").agg(F.max("level").alias("level")), "p3-levels")


def all_knn(vectors: DataFrame, k: int = 8, trees: int = TREES, candidates: int = CANDIDATES, segment: int = SEGMENT) -> DataFrame:
    """(id, neighbour_id, cosine, rank): for each row of vectors (id, model, vector) its k nearest others of the same
    model (all, if there are fewer) by cosine, ties to the smaller id.  Vectors must be valid, see valid_vectors.

    Equal vectors are one entry of the forest, with the k + 1 smallest ids that have it: no more of them can be among
    any vector's k nearest.  Every vector is indexed and every vector is a query.  Some neighbours can be missed (recall
    is measured in the README); where all vectors of a model are no more than the candidates asked for, the ascent ends
    at the root and nothing is.  A segment is one task's work, however many vectors share a prefix."""
    rows = vectors.select("id", "model", "vector", F.xxhash64("vector", "model").alias("h1"), F.xxhash64(F.lit(1), "vector", "model").alias("h2"))
    rank = F.row_number().over(Window.partitionBy("h1", "h2").orderBy("id"))  # Spark limits groups before the shuffle
    heads = rows.select("h1", "h2", "id", "model", "vector").distinct().withColumn("r", rank).where(F.col("r") <= k + 1)
    unique = heads.groupBy("h1", "h2").agg(F.sort_array(F.collect_list("id")).alias("ids"), F.first("model").alias("model"), F.first("vector").alias("vector")).select(F.col("ids")[0].alias("uid"), "model", "ids", "vector")
    unique = cut(unique, "p3-unique")
    spark = vectors.sparkSession
    # A bounded sample of each model, and its size: some rows for each model.
    sizes = {r["model"]: r["n"] for r in unique.groupBy("model").agg(F.count(F.lit(1)).alias("n")).collect()}
    some = unique.select("model", "vector", F.row_number().over(Window.partitionBy("model").orderBy(F.xxhash64("uid"), "uid")).alias("r")).where(F.col("r") <= SAMPLE)
    by: dict[str, list] = {}
    for r in some.orderBy("model", "r").select("model", "vector").toLocalIterator():
        by.setdefault(r["model"], []).append(r["vector"])
    fitted = {}
    for m, x in by.items():
        unit = _matrix(pa.array(x, pa.list_(pa.float32())))
        planes, bars = zip(*(_planes(unit, t) for t in range(trees)))
        fitted[m] = np.concatenate(planes, 1), np.concatenate(bars)
    shipped = spark.sparkContext.broadcast(fitted)  # 240 bytes a dimension and tree for each model
    hashed = cut(unique.mapInArrow(_hashes(shipped), "uid bigint, model string, ids array<bigint>, vector array<float>, hashes array<bigint>"), "p3-hashed")
    levels = _levels(hashed, sizes, trees, candidates)
    placed = hashed.join(small(levels, levels.count(), MAX_BROADCAST), "uid", "left").select("uid", "model", "ids", "vector", F.coalesce("level", F.lit(0)).alias("level"), F.posexplode("hashes").alias("tree", "h"))
    # The sorted arrays, cut into segments; the id parts even equal hashes.
    parts = max(1, -(-sum(sizes.values()) * trees // segment))
    arrays = placed.repartitionByRange(parts, "model", "tree", "h", "uid").sortWithinPartitions("model", "tree", "h", "uid")
    best = arrays.mapInArrow(_segment(k), "uid bigint, found array<bigint>, cos array<double>")
    pairs = F.arrays_zip("found", "cos")
    merged = best.groupBy("uid").agg(F.flatten(F.collect_list(pairs)).alias("p"))  # a list for each tree
    ordered = F.slice(F.array_sort(F.array_distinct(F.transform("p", lambda x: F.struct((-x["cos"]).alias("c"), x["found"].alias("i"))))), 1, k + 1)
    top = merged.select("uid", ordered.alias("p"))
    # Each row of a class gets the class's list, without itself.
    cls = unique.select(F.col("uid"), F.xxhash64("vector", "model").alias("h1"), F.xxhash64(F.lit(1), "vector", "model").alias("h2"))
    own = rows.select("id", "h1", "h2").distinct().join(cls, ["h1", "h2"]).join(top, "uid")
    lists = own.select("id", F.slice(F.filter("p", lambda x: x["i"] != F.col("id")), 1, k).alias("p"))
    return lists.select("id", F.posexplode("p").alias("rank", "x")).select("id", F.col("x.i").alias("neighbour_id"), (-F.col("x.c")).alias("cosine"), (F.col("rank") + 1).alias("rank"))
