"""Problem 4: cut oversized texts into pieces at natural boundaries.

For each text the token offsets are prefix sums over characters and the possible cuts one sorted array for each kind
of boundary.  A piece ends at the last boundary under the limit, found by binary search, of the best kind that leaves
it at least half full; without any boundary it is cut hard.  The next piece steps back by the overlap.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Ends of paragraphs, lines, sentences (of scripts with and without spaces), clauses, words.
BOUNDARIES = tuple(re.compile(p) for p in (r"\r?\n(?:[^\S\n]*\r?\n)+", r"\r?\n", r"[.!?…]+[\"'”’»)\]]*\s+|[。！？]+[」』”’]*", r"[;:,，、；]\s*", r"\s+"))


class CharTokens:
    """A token for every `per` characters (code points), rounded down: the prefix sum is i // per."""

    def __init__(self, per: int = 4):
        self.per = per

    def count(self, text: str) -> int:
        return len(text) // self.per

    def furthest(self, text: str, start: int, tokens: int) -> int:
        """The largest end such that text[start:end] has at most so many tokens."""
        return min(len(text), start + (tokens + 1) * self.per - 1)

    def back(self, text: str, end: int, tokens: int) -> int:
        return max(0, end - tokens * self.per)

    def of_piece(self, text: str, start: int, end: int) -> int:
        return (end - start) // self.per


class OffsetTokens:
    """Any tokenizer that gives the end offset of each token; offsets(text) is sorted."""

    def __init__(self, offsets: Callable[[str], list[int]]):
        self.offsets, self._of, self._ends = offsets, None, []

    def _at(self, text: str) -> list[int]:
        if self._of is not text:
            self._of, self._ends = text, self.offsets(text)
        return self._ends

    def count(self, text: str) -> int:
        return len(self._at(text))

    def furthest(self, text: str, start: int, tokens: int) -> int:
        ends = self._at(text)
        k = bisect_right(ends, start) + tokens
        return len(text) if k >= len(ends) else max(ends[k - 1], start + 1)

    def back(self, text: str, end: int, tokens: int) -> int:
        ends = self._at(text)
        k = bisect_right(ends, end) - tokens
        return 0 if k <= 0 else ends[k - 1]

    def of_piece(self, text: str, start: int, end: int) -> int:
        """Tokens of the piece by itself: cut out of its text it can fall into other ones."""
        return len(self.offsets(text[start:end]))


def public_tokenizer(path: str) -> OffsetTokens:
    """Tokens of a tokenizers JSON file, such as the public vocabularies; path is read on the executors."""
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True
    return OffsetTokens(lambda text: [e for _, e in t.encode(text, add_special_tokens=False).offsets])


def spans(text: str, limit: int, overlap: int, tokens) -> list[tuple[int, int]]:
    """(start, end) of the pieces, in order; together they cover the text, and each advances past the last one's end.  A
    piece that has more tokens by itself than within its text is cut shorter until it is within the limit; only a piece
    of a single character can be above."""
    if tokens.count(text) <= limit:
        return [(0, len(text))]
    cuts = [[m.end() for m in b.finditer(text)] for b in BOUNDARIES]
    out, start, n, room = [], 0, len(text), limit
    while True:
        done = out[-1][1] if out else 0  # the new piece must reach beyond this
        end = max(tokens.furthest(text, start, room), done + 1) if room > 0 else done + 1
        over = tokens.of_piece(text, start, end) - limit
        if over > 0 and room > 0:
            room -= over
            continue
        if over > 0 and start < done:  # no room for an overlap
            start, room = done, limit
            continue
        room = limit
        if end >= n:
            return [*out, (start, n)]
        least, cut = max(done + 1, start + (end - start) // 2), 0
        for ends in cuts:
            k = bisect_right(ends, end) - 1
            if k >= 0 and ends[k] >= least:
                cut = ends[k]
                break
        if not cut or tokens.of_piece(text, start, cut) > limit:
            cut = end
        out.append((start, cut))
        back = tokens.back(text, cut, overlap)
        # Begin at the first word or better boundary from there on, if that still repeats something.
        nxt = next((ends[k] for ends in (cuts[4],) if (k := bisect_left(ends, back)) < len(ends) and ends[k] < cut), back)
        start = nxt if nxt > start else min(cut, start + 1)


def split_oversized(df: DataFrame, id_col: str = "request_id", text_col: str = "content", limit: int = 500, overlap: int = 100, chars_per_token: int = 4, tokenizer_path: str | None = None) -> DataFrame:
    """Pieces (id, chunk_index from 0, total_chunks, content, tokens, start, end) of the texts above the limit.

    A row per id: repeated rows of an id count once.  Null and empty texts and texts within the limit give no rows.
    limit must be positive, overlap from 0 to less than limit.  Tokens are characters by chars_per_token, or those of
    the tokenizer file.  Only texts above the limit reach Python; each is handled whole, by itself.
    """
    if limit < 1 or not 0 <= overlap < limit:
        raise ValueError("limit must be positive and overlap less than it")
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("t")).where("id is not null")
    if tokenizer_path is None:
        rows = rows.where(F.floor(F.length("t") / chars_per_token) > limit)
    rows = rows.dropDuplicates(["id"])

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = public_tokenizer(tokenizer_path) if tokenizer_path else CharTokens(chars_per_token)
        for b in batches:
            out: list[tuple] = []
            for i, t in zip(b.column("id").to_pylist(), b.column("t").to_pylist()):
                if t and tokens.count(t) > limit:
                    at = spans(t, limit, overlap, tokens)
                    out += [(i, k, len(at), t[s:e], tokens.count(t[s:e]), s, e) for k, (s, e) in enumerate(at)]
            if out:
                c = list(zip(*out))
                yield pa.RecordBatch.from_arrays([pa.array(c[0], b.schema.field("id").type), *(pa.array(x, y) for x, y in zip(c[1:], (pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.int64())))], ["id", "chunk_index", "total_chunks", "content", "tokens", "start", "end"])

    kind = rows.schema["id"].dataType.simpleString()
    got = rows.mapInArrow(pieces, f"id {kind}, chunk_index int, total_chunks int, content string, tokens bigint, start bigint, end bigint")
    return got.withColumnRenamed("id", id_col)
