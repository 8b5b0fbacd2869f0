"""Problem 6: passages of evaluation items inside training text.

The items are the documents of a BM25 inverted index; every passage (window of words) of every training text is a
query.  Block-max WAND finds all items whose score reaches the threshold.  That threshold is proven, not tuned: a
passage that holds `run` consecutive words of an item scores at least what the cheapest such run of that item scores,
so nothing that the exact check would confirm is lost.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import plain_words

K1, B = 1.2, 0.75
BLOCK = 16


@dataclass
class ItemIndex:
    """Inverted index of items: for each term its postings by item, with the highest impact of each block of BLOCK.

    Impacts are parts of what the item's cheapest run scores, so that 1 is the threshold of every item, and an item of
    common words makes no other one's threshold lower."""

    items: list[tuple[int, str, str | None]]
    run: int = 12
    ids: dict[str, int] = field(default_factory=dict)
    postings: list[tuple[list[int], list[float], list[int], list[float]]] = field(default_factory=list)

    def __post_init__(self) -> None:
        self.words = [plain_words(t) for _, t, _ in self.items]
        self.answers = [plain_words(a) for _, _, a in self.items]
        # The question is the last line of an item.
        self.question_at = [len(plain_words(t.rpartition("\n")[0])) if t else 0 for _, t, _ in self.items]
        n, average = len(self.items), max(1.0, sum(map(len, self.words)) / max(1, len(self.items)))
        df = Counter(w for ws in self.words for w in set(ws))
        lists: dict[str, list[tuple[int, float]]] = defaultdict(list)
        impact: list[dict[str, float]] = []
        for i, ws in enumerate(self.words):
            own = {}
            for w, f in Counter(ws).items():
                idf = math.log(1 + (n - df[w] + 0.5) / (df[w] + 0.5))
                own[w] = idf * f * (K1 + 1) / (f + K1 * (1 - B + B * len(ws) / average))
                lists[w].append((i, own[w]))
            impact.append(own)
        self.runs: list[dict[tuple[str, ...], int]] = []
        self.least: list[float] = []
        for ws, own in zip(self.words, impact):
            grams = {}
            for k in range(len(ws) - self.run + 1):
                grams.setdefault(tuple(ws[k : k + self.run]), k)
            self.runs.append(grams)
            self.least.append(min((sum(own[w] for w in set(g)) for g in grams), default=math.inf))
        # Items shorter than a run can't be held.
        lists = {w: [(i, x / self.least[i]) for i, x in p if self.least[i] < math.inf] for w, p in lists.items()}
        lists = {w: p for w, p in lists.items() if p}
        for w in sorted(lists):
            docs, impacts = [i for i, _ in lists[w]], [x for _, x in lists[w]]
            ends = [min(k + BLOCK, len(docs)) for k in range(0, len(docs), BLOCK)]
            self.ids[w] = len(self.postings) + 1
            self.postings.append((docs, impacts, ends, [max(impacts[e - (e - 1) % BLOCK - 1 : e]) for e in ends]))
        self.most = np.array([0.0, *(max(p[1]) for p in self.postings)])
        self.threshold = 1 - 1e-9

    def wand(self, terms: set[int]) -> list[tuple[int, float]]:
        """Items that score at least the threshold for a query of these terms.  Block-max WAND: the cursors stay sorted
        by item; the pivot is the first at which the lists' highest impacts could reach the threshold; it is scored
        only if the blocks that hold it could, too, else the cursors jump past the nearest block end."""
        cursors = [[0, self.postings[t - 1], self.most[t]] for t in terms]
        found = []
        while cursors:
            cursors.sort(key=lambda c: c[1][0][c[0]])
            bound, pivot = 0.0, -1
            for k, c in enumerate(cursors):
                bound += c[2]
                if bound >= self.threshold:
                    pivot = k
                    break
            if pivot < 0:
                return found
            item = cursors[pivot][1][0][cursors[pivot][0]]
            while pivot + 1 < len(cursors) and cursors[pivot + 1][1][0][cursors[pivot + 1][0]] == item:
                pivot += 1
            ahead = cursors[: pivot + 1]
            blocks, nearest = 0.0, math.inf
            for c in ahead:
                docs, _, ends, tops = c[1]
                b = c[0] // BLOCK
                while b < len(ends) and docs[ends[b] - 1] < item:
                    b += 1
                if b < len(ends):
                    blocks += tops[b]
                    nearest = min(nearest, docs[ends[b] - 1])
            if blocks < self.threshold:
                after = cursors[pivot + 1][1][0][cursors[pivot + 1][0]] if pivot + 1 < len(cursors) else math.inf
                to = min(nearest + 1, after) if nearest < math.inf else after
                to = max(to, item + 1)
            else:
                score = 0.0
                for c in ahead:
                    docs, impacts = c[1][0], c[1][1]
                    while c[0] < len(docs) and docs[c[0]] < item:
                        c[0] += 1
                    if c[0] < len(docs) and docs[c[0]] == item:
                        score += impacts[c[0]]
                if score >= self.threshold:
                    found.append((item, score * self.least[item]))
                to = item + 1
            for c in ahead:
                docs = c[1][0]
                while c[0] < len(docs) and docs[c[0]] < to:
                    c[0] += 1
            cursors = [c for c in cursors if c[0] < len(c[1][0])]
        return found

    def leaks(self, words: list[str]) -> list[tuple[int, int, float, bool, float]]:
        """(item, longest run in words, share of the question's words that runs cover, answer there, best score)."""
        n, run = len(words), self.run
        if n < run:
            return []
        get = self.ids.get
        terms = np.fromiter((get(w, 0) for w in words), dtype=np.int64, count=n)
        size, step = 2 * run, run + 1  # any run of consecutive words lies within one window
        total = np.concatenate(([0.0], np.cumsum(self.most[terms])))
        starts = np.arange(0, max(1, n - run + 1), step)
        ends = np.minimum(starts + size, n)
        best: dict[int, float] = {}
        where: dict[int, list[tuple[int, int]]] = defaultdict(list)
        # WAND's first pivot test for all windows at once: no pivot where all lists' highest impacts together are too low.
        for k in np.flatnonzero(total[ends] - total[starts] >= self.threshold):
            s, e = int(starts[k]), int(ends[k])
            for item, score in self.wand({int(t) for t in terms[s:e] if t}):
                best[item] = max(best.get(item, 0.0), score)
                where[item].append((s, e))
        out = []
        for item, windows in where.items():
            grams, own = self.runs[item], self.words[item]
            longest, covered = 0, set()
            for s, e in windows:
                for k in range(s, e - run + 1):
                    at = grams.get(tuple(words[k : k + run]))
                    if at is not None:
                        m = run
                        while at + m < len(own) and k + m < n and own[at + m] == words[k + m]:
                            m += 1
                        longest = max(longest, m)
                        covered.update(range(at, at + m))
            if longest:
                q, a = self.question_at[item], self.answers[item]
                asked = len(own) - q
                there = bool(a) and any(words[k : k + len(a)] == a for k in range(n - len(a) + 1) if words[k] == a[0])
                out.append((item, longest, sum(x >= q for x in covered) / asked if asked else 0.0, there, best[item]))
        return out


#: The index goes to every executor; items beyond this are dealt with in further passes over the texts.
MAX_ITEMS = 20_000


def find_leaks(df: DataFrame, items: DataFrame, run: int = 12, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, item_id, run_words, question_overlap, has_answer, score): a row for each text and item of which it holds at
    least `run` consecutive words.  Words are runs of letters and digits in lower case without accents.

    Whole texts are searched.  Null, empty and short texts and items give no rows; items that share a passage each get
    theirs; repeated rows of a text or item count once.  Items come to the driver in blocks of MAX_ITEMS (they are a
    fixed test set); a larger set takes a pass over the texts for each block."""
    rows = items.select("item_id", "text", "answer").where("item_id is not null and text is not null").dropDuplicates(["item_id"])
    spark = df.sparkSession
    kind = df.schema[id_col].dataType.simpleString()
    texts = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("t")).where("id is not null and t is not null")
    passes, done = [], None
    while True:
        part = (rows if done is None else rows.where(F.col("item_id") > done)).orderBy("item_id").limit(MAX_ITEMS).collect()
        if not part:
            break
        passes.append(_one_pass(texts, spark, [(r[0], r[1], r[2]) for r in part], run, kind))
        done = part[-1][0]
        if len(part) < MAX_ITEMS:
            break
    if not passes:
        return spark.createDataFrame([], f"{id_col} {kind}, item_id bigint, run_words int, question_overlap double, has_answer boolean, score double")
    out = passes[0]
    for p in passes[1:]:
        out = out.unionByName(p)
    # Only leaks get here, so this is small beside the corpus.
    out = out.groupBy("id", "item_id").agg(F.max("run_words").alias("run_words"), F.max("question_overlap").alias("question_overlap"), F.max("has_answer").alias("has_answer"), F.max("score").alias("score"))
    return out.withColumnRenamed("id", id_col)


def _one_pass(texts: DataFrame, spark, items: list[tuple], run: int, kind: str) -> DataFrame:
    shipped = spark.sparkContext.broadcast(ItemIndex(items, run))  # built once; a worker's tasks share it

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shipped.value
        for b in batches:
            out = [(i, index.items[x][0], m, q, a, s) for i, t in zip(b.column("id").to_pylist(), b.column("t").to_pylist()) for x, m, q, a, s in index.leaks(plain_words(t))]
            if out:
                c = list(zip(*out))
                yield pa.RecordBatch.from_arrays([pa.array(c[0], b.schema.field("id").type), *(pa.array(x, y) for x, y in zip(c[1:], (pa.int64(), pa.int32(), pa.float64(), pa.bool_(), pa.float64())))], ["id", "item_id", "run_words", "question_overlap", "has_answer", "score"])

    return texts.mapInArrow(search, f"id {kind}, item_id bigint, run_words int, question_overlap double, has_answer boolean, score double")
