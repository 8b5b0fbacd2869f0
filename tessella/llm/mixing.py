"""Problem 7: mix sources to target weights.

Each source's documents fall into blocks by a seeded hash.  Whole passes over a small source come first, then those of
its blocks, in a seeded order, that the quota still takes; the last of it is filled by document.  The chosen blocks are dealt to output shards by a splitting
tree: each node deals the block counts of all sources between its two halves by a multivariate hypergeometric draw,
so that every shard gets an exact number of blocks of each source.  Within a shard rows are ordered by a seeded hash.
Only counts by source and block, both bounded, ever reach the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.llm.common import cut

_MOST = (1 << 63) - 1


def words_of(text: Column) -> Column:
    """Tokens: maximal runs of characters other than space, tab and line breaks."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^ \t\r\n]+")), F.lit(0)).cast("bigint")


def source_key(c: Column) -> Column:
    return F.lower(F.regexp_replace(c, r"^\s+|\s+$", ""))


def _counted(df: DataFrame, path: str, *keep: str) -> DataFrame:
    """df (_k, _text and kept columns) with _tokens of a public tokenizer's JSON file, which the executors read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(path)
        t.encode_special_tokens = True
        for b in batches:
            texts = b.column("_text").to_pylist()
            n = [len(t.encode(x, add_special_tokens=False).ids) if x else 0 for x in texts]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in (*keep, "_k")), pa.array(n, pa.int64())], [*keep, "_k", "_tokens"])

    kinds = ", ".join(f"{c} {df.schema[c].dataType.simpleString()}" for c in (*keep, "_k"))
    return df.mapInArrow(run, f"{kinds}, _tokens bigint")


def _sized(df: DataFrame, targets: DataFrame, source_col: str, text_col: str, *keep: str, tokenizer_path: str | None = None) -> DataFrame:
    """The kept columns with _source, the target's spelling, and _tokens, which are words or those of the tokenizer
    file; rows of other or no sources drop out.  The targets are one row a source, of which there are few; the planner
    decides by their size whether to broadcast."""
    names = targets.select(F.col("source").alias("_source"), source_key(F.col("source")).alias("_k")).dropDuplicates(["_k"])
    own = [F.col(c).alias(c) for c in keep] + [source_key(F.col(source_col)).alias("_k")]
    if tokenizer_path:
        rows = _counted(df.select(*own, F.col(text_col).alias("_text")).where("_k is not null"), tokenizer_path, *keep)
    else:
        rows = df.select(*own, words_of(F.col(text_col)).alias("_tokens"))
    return rows.join(names, "_k").drop("_k")


def source_plan(df: DataFrame, targets: DataFrame, size: float = 0.6, source_col: str = "source", text_col: str = "text", tokenizer_path: str | None = None) -> DataFrame:
    """One row per target source: tokens, documents, wanted tokens, planned tokens (at most max_repeats times the
    source's), repeats and actual_share as planned, and short.  Nothing is drawn here; source_use tells what was.

    The mix is to hold `size` times the tokens of all documents with a target source.  A source without documents has
    0 tokens and is short unless its target is 0; null or negative targets count as 0, null max_repeats as 1."""
    return _plan(_sized(df, targets, source_col, text_col, tokenizer_path=tokenizer_path).select(F.col("_source").alias("source"), F.col("_tokens").alias("tokens")), targets, size)


def _plan(sized: DataFrame, targets: DataFrame, size: float) -> DataFrame:
    """sized: source (as in targets) and tokens of each document."""
    have = sized.groupBy(F.col("source").alias("_source")).agg(F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("documents"))
    t = targets.select("source", F.greatest(F.coalesce("target_share", F.lit(0.0)), F.lit(0.0)).alias("target_share"), F.greatest(F.coalesce("max_repeats", F.lit(1)), F.lit(0)).alias("max_repeats")).join(have, F.col("source") == F.col("_source"), "left").select("source", "target_share", "max_repeats", F.coalesce("tokens", F.lit(0)).alias("tokens"), F.coalesce("documents", F.lit(0)).alias("documents"))
    every = Window.partitionBy()  # the targets, one row a source: few
    t = t.withColumn("_total", F.sum("tokens").over(every))
    wanted = F.col("target_share") * F.lit(float(size)) * F.col("_total")
    t = t.withColumns({"wanted": wanted, "limit": F.col("tokens") * F.col("max_repeats")})
    t = t.withColumn("planned", F.least("wanted", F.col("limit").cast("double")))
    t = t.withColumn("_got", F.sum("planned").over(every))
    return t.select("source", "target_share", "max_repeats", "tokens", "documents", "wanted", "planned", F.when(F.col("tokens") > 0, F.col("planned") / F.col("tokens")).otherwise(0.0).alias("repeats"), F.when(F.col("_got") > 0, F.col("planned") / F.col("_got")).otherwise(0.0).alias("actual_share"), (F.col("limit") < wanted).alias("short"))


def splitting_tree(quotas: dict[str, int], shards: int, seed: int) -> dict[str, list[int]]:
    """For each source the number of its blocks in each shard.  Shard sizes differ by one block at most."""
    names, out = sorted(quotas), {k: [0] * shards for k in quotas}
    rng = np.random.default_rng(seed)

    def deal(counts: np.ndarray, lo: int, hi: int) -> None:
        if hi - lo == 1:
            for k, n in zip(names, counts):
                out[k][lo] = int(n)
            return
        mid, total = (lo + hi) // 2, int(counts.sum())
        left = (total * (mid - lo) + (hi - lo) // 2) // (hi - lo)
        drawn = rng.multivariate_hypergeometric(counts, left) if total else counts
        deal(drawn, lo, mid)
        deal(counts - drawn, mid, hi)

    if names and shards:
        deal(np.array([quotas[k] for k in names], dtype=np.int64), 0, shards)
    return out


def mix(df: DataFrame, targets: DataFrame, size: float = 0.6, shards: int = 32, blocks: int = 256, seed: int = 7, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", tokenizer_path: str | None = None) -> DataFrame:
    """The mixture: (id, source, copy, block, shard, position, tokens), a row for each time a document is used.  Each
    shard is one partition, in the order of position, a seeded hash: the local shuffle.

    blocks (at most 4096) is the number of blocks a source is cut into: the driver gets sources x blocks counts, never
    rows.  A document has one block, so the blocks of one pass are disjoint.  Of a pass that the quota does not take in
    whole, blocks that don't fit are skipped; what is then left is filled by document, so that a source misses its
    planned tokens by less than one document."""
    return _dealt(df, targets, size, shards, blocks, seed, id_col, source_col, text_col, tokenizer_path)[0].repartition(shards, "shard").sortWithinPartitions("shard", "position")


def _dealt(df: DataFrame, targets: DataFrame, size: float, shards: int, blocks: int, seed: int, id_col: str, source_col: str, text_col: str, tokenizer_path: str | None) -> tuple[DataFrame, DataFrame]:
    """(the mixture, unordered; every document with its source, tokens and block)."""
    if not 1 <= blocks <= 4096:
        raise ValueError("blocks must be from 1 to 4096")
    spark = df.sparkSession
    rows = _sized(df, targets, source_col, text_col, id_col, tokenizer_path=tokenizer_path).select(F.col(id_col), F.col("_source").alias("source"), F.col("_tokens").alias("tokens"), F.pmod(F.xxhash64(F.col(id_col), F.lit(seed)), F.lit(blocks)).cast("int").alias("block"))
    every = cut(rows, "p7-rows")
    rows = every.where(F.col(id_col).isNotNull())
    counts = rows.groupBy("source", "block").agg(F.sum("tokens").alias("tokens")).collect()
    plan = {r["source"]: r for r in _plan(every, targets, size).select("source", "planned", "max_repeats").collect()}
    by: dict[str, dict[int, int]] = {}
    for r in counts:
        by.setdefault(r["source"], {})[r["block"]] = r["tokens"]
    chosen: dict[str, list[tuple[int, int, int, int, float]]] = {}  # copy, block, low, high, bar: see _documents
    open_: dict[str, tuple[int, float, list[int]]] = {}
    for s in sorted(by):
        rng, left, use = np.random.default_rng([seed, *s.encode()]), plan[s]["planned"], []
        for copy in range(plan[s]["max_repeats"]):
            if left <= 0:
                break
            whole, over = sum(by[s].values()) <= left, []
            for b in map(int, rng.permutation(sorted(by[s]))):
                n = by[s][b]
                if whole or left > 0 and n <= left:
                    use.append((copy, b, 0, _MOST, float("inf")))
                    left -= n
                else:
                    over.append(b)
            if over and left > 0:
                open_[s] = copy, left, over
                break
        chosen[s] = use
    for s, ends in _last_blocks(rows, open_, by).items():
        chosen[s] += ends
    dealt = splitting_tree({s: len(u) for s, u in chosen.items()}, shards, seed)
    where = []
    for s, use in chosen.items():
        order = np.random.default_rng([seed + 1, *s.encode()]).permutation(len(use))
        shard = np.repeat(np.arange(shards), dealt[s])
        where += [(s, *use[int(i)], int(k)) for i, k in zip(order, shard)]
    places = spark.createDataFrame(where, "source string, copy int, block int, low bigint, high bigint, bar double, shard int")
    at = rows.join(places, ["source", "block"])
    parts = _documents(at.where(F.col("bar") < float("inf")), id_col, seed)
    return at.where(F.col("bar") == float("inf")).where("tokens between low and high").unionByName(parts).select(id_col, "source", "copy", "block", "shard", F.xxhash64(id_col, "copy", F.lit(seed)).alias("position"), "tokens"), every


def _last_blocks(rows: DataFrame, open_: dict[str, tuple[int, float, list[int]]], by: dict[str, dict[int, int]]) -> dict[str, list[tuple[int, int, int, int, float]]]:
    """What fills the quotas that whole blocks leave open.  open_: copy, tokens left, and the blocks that don't fit, in
    their order.  Of these the documents that fit are taken, block after block, up to the one that reaches the quota.
    If they don't reach it the smallest of the larger documents is taken, if the quota is nearer with it."""
    spark = rows.sparkSession
    if not open_:
        return {}
    asked = spark.createDataFrame([(s, b, float(left)) for s, (_, left, over) in open_.items() for b in over], "source string, block int, left double")
    fits = F.col("tokens") <= F.col("left")
    sums = rows.join(asked, ["source", "block"]).groupBy("source", "block").agg(F.sum(F.when(fits, F.col("tokens"))).alias("small"), F.min(F.when(~fits, F.col("tokens"))).alias("larger")).collect()
    of = {(r["source"], r["block"]): (r["small"] or 0, r["larger"]) for r in sums}
    out: dict[str, list[tuple[int, int, int, int, float]]] = {}
    for s, (copy, left, over) in open_.items():
        ends, high = [], int(left)
        for b in over:
            small = of[s, b][0]
            if small > left:
                ends.append((copy, b, 0, high, float(left)))
                left = 0.0
                break
            if small:
                ends.append((copy, b, 0, high, float("inf")))
                left -= small
        larger = min(((of[s, b][1], b) for b in over if of[s, b][1] is not None), default=None)
        if left > 0 and larger and larger[0] < 2 * left:
            n, b = larger
            ends.append((copy, b, n, n, float(n)))
        out[s] = ends
    return out


def _documents(at: DataFrame, id_col: str, seed: int) -> DataFrame:
    """The documents of at, of low to high tokens, that in a seeded order come nearest to bar: at most one block of a
    source for each window."""
    order = Window.partitionBy("source", "block", "low").orderBy(F.xxhash64(id_col, F.lit(seed + 2)), id_col).rowsBetween(Window.unboundedPreceding, 0)
    sized = at.where("tokens between low and high").withColumn("_sum", F.sum("tokens").over(order))
    # The one that passes the bar counts if it ends nearer to it than it begins.
    return sized.where((F.col("_sum") <= F.col("bar")) | (F.col("_sum") - F.col("tokens") < F.col("bar")) & (2 * F.col("_sum") - F.col("tokens") < 2 * F.col("bar"))).drop("_sum")


def source_use(df: DataFrame, targets: DataFrame, size: float = 0.6, shards: int = 32, blocks: int = 256, seed: int = 7, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", tokenizer_path: str | None = None) -> DataFrame:
    """One row per target source, of the rows that mix deals: used_documents and used_tokens (each use counts), repeats
    (used_tokens by the source's tokens) and actual_share (of all used tokens), beside what source_plan asks for; short,
    where all that may be dealt of the source has been and is less than what is wanted of it."""
    dealt, every = _dealt(df, targets, size, shards, blocks, seed, id_col, source_col, text_col, tokenizer_path)
    plan = _plan(every, targets, size).select("source", "target_share", "max_repeats", "tokens", "documents", "wanted", "planned")
    used = dealt.groupBy("source").agg(F.count(F.lit(1)).alias("used_documents"), F.sum("tokens").alias("used_tokens"))
    t = plan.join(used, "source", "left").na.fill(0, ["used_documents", "used_tokens"])
    t = t.withColumn("_all", F.sum("used_tokens").over(Window.partitionBy()))  # the targets, one row a source: few
    return t.withColumns({"repeats": F.when(F.col("tokens") > 0, F.col("used_tokens") / F.col("tokens")).otherwise(0.0), "actual_share": F.when(F.col("_all") > 0, F.col("used_tokens") / F.col("_all")).otherwise(0.0), "short": (F.col("used_tokens") == F.col("tokens") * F.col("max_repeats")) & (F.col("used_tokens") < F.col("wanted"))}).drop("_all", "wanted")
