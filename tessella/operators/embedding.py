"""From documents to points: cutting by document type, embedding in batches, rows to upsert.

Hosted models are represented by the Embedder protocol: a function from a list of texts to vectors, called once for each
batch on the executors.  The one that comes along needs no model and no network: it hashes words into signed slots, so
that equal texts get equal vectors and texts with common words similar ones.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.functions import text as T
from tessella.operators import chunking

Embedder = Callable[[Sequence[str]], np.ndarray]

# Size and overlap, in tokens, by document type, and for all others; most chunks of a document; texts in a batch.
SIZES = {"html": (500, 100), "pdf": (500, 100), "mediawiki": (500, 100)}
DEFAULT_SIZE, MAX_CHUNKS, BATCH = (500, 100), 500, 30


def hashing_embedder(dim: int = 64) -> Embedder:
    """Unit vectors of dim elements; the zero vector for texts without words."""

    def embed(texts: Sequence[str]) -> np.ndarray:
        out = np.zeros((len(texts), dim), np.float64)
        for k, t in enumerate(texts):
            for w in t.lower().split():
                h = int.from_bytes(blake2b(w.encode(), digest_size=8).digest(), "little")
                out[k, h % dim] += 1.0 if h >> 63 else -1.0
        n = np.sqrt((out * out).sum(1, keepdims=True))
        return np.divide(out, n, out=np.zeros_like(out), where=n > 0).astype(np.float32)

    return embed


def tokenised(df: DataFrame, id_col: str, text_col: str, path: str, size: int, overlap: int) -> DataFrame:
    """(id, chunk_index, total_chunks, text, tokens): sliding windows of `size` tokens of the tokenizer file, each
    repeating the last `overlap`; an overlap of size or more counts as size - 1.  Windows are cut at the tokens' places in
    the text, so nothing of it changes.  Null and empty texts give no rows."""
    if size <= 0:
        raise ValueError("size must be positive")
    step = size - min(overlap, size - 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from tokenizers import Tokenizer

        tok = Tokenizer.from_file(path)
        tok.encode_special_tokens = True
        for b in batches:
            out: list[tuple] = []
            for i, t in zip(b.column("id").to_pylist(), b.column("t").to_pylist()):
                at = tok.encode(t, add_special_tokens=False).offsets if t else []
                starts = range(0, len(at), step)
                for k, s in enumerate(starts):
                    e = min(len(at), s + size)
                    out.append((i, k, len(starts), t[at[s][0] : at[e - 1][1]], e - s))
            if out:
                c = list(zip(*out))
                yield pa.RecordBatch.from_arrays([pa.array(c[0], b.schema.field("id").type), *(pa.array(x, y) for x, y in zip(c[1:], (pa.int32(), pa.int32(), pa.string(), pa.int32())))], ["id", "chunk_index", "total_chunks", "text", "tokens"])

    kind = df.schema[id_col].dataType.simpleString()
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("t"))
    return rows.mapInArrow(run, f"id {kind}, chunk_index int, total_chunks int, text string, tokens int").withColumnRenamed("id", id_col)


def document_type(c: Column) -> Column:
    """In lower case without outer spaces; html where there is none, text for unknown ones."""
    low = F.lower(F.trim(F.coalesce(c, F.lit("html"))))
    return F.when(low.isin(*SIZES), low).otherwise("text")


def process_documents(df: DataFrame, id_col: str, text_col: str, type_col: str, max_chunks: int | None = None) -> DataFrame:
    """(id, document_type, chunk_index, total_chunks, text, words): documents cut by the size and overlap of their type,
    in words, at most max_chunks of each and never above MAX_CHUNKS: the cap is the feature."""
    cap = min(MAX_CHUNKS, max_chunks) if max_chunks and max_chunks > 0 else MAX_CHUNKS
    typed = df.withColumn("_type", document_type(F.col(type_col)))
    by: dict[tuple[int, int], list[str]] = {}
    for name in (*SIZES, "text"):
        by.setdefault(SIZES.get(name, DEFAULT_SIZE), []).append(name)
    out = None
    for (size, overlap), names in by.items():  # types of equal sizes in one pass
        part = typed.where(F.col("_type").isin(*names)).withColumn("_id", F.struct(id_col, "_type"))
        cut = chunking.word_windows(part, "_id", text_col, size, overlap).where(F.col("chunk_index") < cap)
        out = cut if out is None else out.unionByName(cut)
    return out.select(F.col(f"_id.{id_col}").alias(id_col), F.col("_id._type").alias("document_type"), "chunk_index", F.least("total_chunks", F.lit(cap)).alias("total_chunks"), "text", "words")


def embed(df: DataFrame, text_col: str, embedder: Embedder, batch: int = BATCH) -> DataFrame:
    """df with vector; the embedder sees `batch` texts at a time.  Null texts get null."""
    schema = df.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, batch):
                c = b.slice(lo, batch)
                texts = c.column(text_col).to_pylist()
                full = [k for k, t in enumerate(texts) if t is not None]
                got = embedder([texts[k] for k in full]) if full else []
                vectors: list = [None] * len(texts)
                for k, v in zip(full, got):
                    vectors[k] = np.asarray(v, dtype=np.float32)
                yield pa.RecordBatch.from_arrays([*c.columns, pa.array(vectors, pa.list_(pa.float32()))], [*c.schema.names, "vector"])

    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)
    return df.mapInArrow(run, f"{columns}, vector array<float>")


def index_rows(chunks: DataFrame, embedder: Embedder, model: str, provider: str, url_col: str = "url", text_col: str = "text", order: str = "chunk_index") -> DataFrame:
    """Rows to upsert: chunks with text, numbered within their page, with point id, vector, its norm, urls and their lower
    case, base urls, model and provider.  Chunks without text or url drop out."""
    full = chunks.where((F.length(F.coalesce(text_col, F.lit(""))) > 0) & T.present(F.col(url_col)).isNotNull())
    at = full.withColumn("_p", F.row_number().over(Window.partitionBy(url_col).orderBy(order)) - 1)
    base = T.strip_fragment(F.col(url_col))
    rows = at.withColumns({"id": T.point_id(F.col(url_col), F.col("_p")), "url_lower": F.lower(url_col), "base_url": base, "base_url_lower": F.lower(base), "embedding_model": F.lit(model), "embedding_provider": F.lit(provider)}).drop("_p")
    out = embed(rows, text_col, embedder)
    norm = F.sqrt(F.aggregate("vector", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return out.withColumns({"embedding_magnitude": norm, "embedding_normalized": F.abs(norm - 1) < 1e-3})


def memoised(df: DataFrame, text_col: str, out_col: str, model: Callable[[Sequence[str]], Sequence[str]], batch: int = BATCH) -> DataFrame:
    """df with out_col, what a model of texts (a summariser, a rewriter) makes of text_col; null for null.  Equal texts, of
    which there are many where a cache pays, are asked once: by their hash, before Python sees them."""
    keyed = df.withColumn("_k", F.sha1(F.col(text_col)))
    asked = keyed.where(F.col(text_col).isNotNull()).groupBy("_k").agg(F.first(text_col).alias("t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, batch):
                c = b.slice(lo, batch)
                yield pa.RecordBatch.from_arrays([c.column("_k"), pa.array(list(model(c.column("t").to_pylist())), pa.string())], ["_k", out_col])

    return keyed.join(asked.mapInArrow(run, f"_k string, `{out_col}` string"), "_k", "left").drop("_k")


def first_sentences(words: int = 40) -> Callable[[Sequence[str]], list[str]]:
    """A summariser that needs no model: the first words of each text."""
    return lambda texts: [" ".join(t.split()[:words]) for t in texts]
