"""Problem 8: score abusive, hateful or sexually explicit language.

A cumulative-link (proportional odds) regression predicts the grade of each passage from sparse text features: one
weight for each feature, shared by the ordered thresholds.  Grades: 0 fine, 1 sexually explicit, 2 insult or threat to
a person, 3 demeaning or harm to a group.  The score is the expected grade; a document has that of its worst passage.

Everything is learned from the labels; there are no word lists.  Features are words (spelling undone as far as rules
can: look-alike signs, repeated and spelled-out letters, letters hidden by stars), pairs of neighbouring words, and the
ways of disguise themselves.  Labels are given for documents and some are wrong, so training finds out, round by round,
which passages of the bad documents are meant: at first those whose words are far more frequent in bad documents than
in others, then those that the model finds bad.  Unlabelled documents, of which most must be fine, take part: as fine
text, as long as the model doesn't find them bad, and as further bad passages where it is sure.  The probability from which a document counts as
bad is chosen on labelled documents that the model scored without having seen them.
"""

from __future__ import annotations

import html
import re
import unicodedata
from collections.abc import Iterator, Sequence
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import cut

#: The grade of each label.
GRADES = {"ok": 0, "sexual": 1, "abuse": 2, "hate": 3}
#: At most so many labelled bad documents, and so many fine ones (unlabelled ones where labels lack), are used for
#: training: those of the smallest hashes.
MAX_BAD, MAX_FINE = 2500, 6000
#: Labelled documents are dealt into so many folds to choose the threshold; a passage counts as meant from SURE on.
FOLDS, SURE = 5, 0.9
#: No feature weighs more than this: a passage is bad by several words together, so that a name which happens to stand
#: beside bad words makes none.
MOST = 1.0

_HIDDEN = re.compile("[\u00ad\u200b-\u200f\u2060-\u2064\ufeff]+")
_MARKS = re.compile("[\u0300-\u036f]+")
# A word with look-alike signs and stars, a word of letters, or what ends a passage: a line break or a sentence's end.
_PIECE = re.compile(r"[.!?…]+[\"'”’»)\]]*\s+|[\r\n]+|(?:[a-z0-9@$*]|!(?=[a-z0-9@$*]))+|[^\W\d_]+")
_ODD = re.compile(r"[0-9@$!]")
_TWICE = re.compile(r"([^*])\1+")
_LEET = str.maketrans("013457@$!", "oieastasi")
_MIX = np.uint64(0x9E3779B97F4A7C15)  # 2**64 divided by the golden ratio


def plain(text: str) -> str:
    """Lower case, without accents, hidden characters and entities."""
    if "&" in text:
        text = html.unescape(text)
    if not text.isascii():
        text = _MARKS.sub("", unicodedata.normalize("NFD", unicodedata.normalize("NFKC", _HIDDEN.sub("", text))))
    return text.lower()


def canonical(word: str) -> tuple[str, str]:
    """(the word with look-alike signs undone and doubled letters made one, how it was disguised: leet, star or
    nothing).  Empty for numbers and signs."""
    word, how = word.strip("!*"), ""
    if _ODD.search(word):
        if not any("a" <= c <= "z" for c in word):
            return "", ""
        word, how = word.translate(_LEET), "leet"
    if "*" in word:
        how = "star"
    return _TWICE.sub(r"\1", word), how


def _key(name: str) -> int:
    return int.from_bytes(blake2b(name.encode(), digest_size=8).digest(), "little") | 1


class Reader:
    """Turns texts into feature keys.  words: canonical words that stars may stand for parts of, the likeliest first."""

    def __init__(self, words: Sequence[str] = ()):
        self.words = list(words)
        self.clear()

    def clear(self) -> None:
        self.number: dict[str, int] = {}
        self.keys, self.marks = [0], [0]  # number 0: the end of a passage
        self.letters: dict[int, str] = {}

    def _new(self, word: str, how: str) -> int:
        self.keys.append(_key(word) if word else 0)
        self.marks.append(_key("#" + how) if how else 0)
        return len(self.keys) - 1

    def _add(self, piece: str) -> int:
        k = 0
        if not piece[-1].isspace():
            word, how = canonical(piece)
            if how == "star":
                pattern = re.compile(re.escape(word).replace(r"\*", "[a-z]?"))
                word = next((w for w in self.words if pattern.fullmatch(w)), "")
            k = self._new(word, how)
            if len(piece) == 1 and piece.isalpha():
                self.letters[k] = piece
        self.number[piece] = k
        return k

    def pieces(self, text: str) -> list[int]:
        get, out = self.number.get, []
        for p in _PIECE.findall(plain(text)):
            n = get(p)
            out.append(self._add(p) if n is None else n)
        return out

    def _joined(self, numbers: np.ndarray) -> np.ndarray:
        """Runs of three or more single letters are one word written letter by letter."""
        out: list[int] = []
        run: list[int] = []
        for n in [*numbers.tolist(), -1]:
            if n in self.letters:
                run.append(n)
                continue
            if len(run) > 2:
                word = "".join(self.letters[x] for x in run)
                spelled = " " + word  # not a piece that findall gives
                if spelled not in self.number:
                    self.number[spelled] = self._new(canonical(word)[0], "spelled")
                out.append(self.number[spelled])
            else:
                out += run
            run = []
            if n >= 0:
                out.append(n)
        return np.array(out, dtype=np.int64)

    def read(self, texts: Sequence[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(document of each passage, passage of each feature, key of each feature), features in the order of passages;
        every text has at least one passage."""
        if len(self.keys) > 500_000:
            self.clear()
        flat: list[int] = []
        heads: list[int] = []
        for t in texts:
            heads.append(len(flat))
            flat.append(0)
            if t:
                flat += self.pieces(t)
        flat.append(0)
        numbers = np.array(flat, dtype=np.int64)
        first = np.zeros(len(flat), bool)
        first[heads] = True
        one = np.isin(numbers, list(self.letters))
        spelled = np.flatnonzero(one[:-2] & one[1:-1] & one[2:])
        if len(spelled):
            parts = np.split(numbers[:-1], heads[1:])
            for k in set((np.searchsorted(heads, spelled, "right") - 1).tolist()):
                parts[k] = self._joined(parts[k])
            heads = np.concatenate(([0], np.cumsum([len(x) for x in parts])[:-1])).astype(np.int64)
            numbers = np.concatenate([*parts, [0]])
            first = np.zeros(len(numbers), bool)
            first[heads] = True
        keys, marks = np.array(self.keys, dtype=np.uint64)[numbers], np.array(self.marks, dtype=np.uint64)[numbers]
        # Passages begin at ends of the one before; numbers and signs drop out.
        begin = numbers == 0
        begin[-1] = False
        passage = np.cumsum(begin) - 1
        doc = (np.cumsum(first) - 1)[begin]
        word = keys != 0
        at, w = passage[word], keys[word]
        before = np.concatenate(([np.uint64(0)], w[:-1]))
        before[np.concatenate(([True], at[1:] != at[:-1]))] = np.uint64(1)  # the passage's first word
        x = (before ^ (before >> np.uint64(29))) * _MIX + w
        pairs = (x ^ (x >> np.uint64(31))) * _MIX & ~np.uint64(1)  # words have odd keys, pairs even ones
        marked = marks != 0
        where = np.concatenate((at, at, passage[marked]))
        return doc, where, np.concatenate((w, pairs, marks[marked]))


class Model:
    """words: canonical words with weights above 0, heaviest first; keys (sorted) and weights of all features;
    P(grade >= k) = 1 / (1 + exp(cuts[k - 1] - sum of the weights of a passage's features)); bar: the probability of
    any grade above 0 from which a document counts as bad."""

    def __init__(self, words: list[str], keys: np.ndarray, weights: np.ndarray, cuts: np.ndarray, bar: float = 0.5):
        self.words, self.keys, self.weights, self.cuts, self.bar = words, keys, weights, cuts, bar
        self.reader = Reader(words)
        # A first sieve by the keys' middle bits, of which nearly all features of fine text fail.
        self.sieve = np.zeros(1 << 20, bool)
        self.sieve[self._slot(keys)] = True

    @staticmethod
    def _slot(keys: np.ndarray) -> np.ndarray:
        return (keys >> np.uint64(20)) & np.uint64((1 << 20) - 1)

    def margins(self, texts: Sequence[str | None]) -> np.ndarray:
        """The highest sum of weights of any passage of each text; 0 without features."""
        doc, where, keys = self.reader.read(texts)
        if not len(self.keys):
            return np.zeros(len(texts))
        hit = np.flatnonzero(self.sieve[self._slot(keys)])
        k = np.minimum(np.searchsorted(self.keys, keys[hit]), len(self.keys) - 1)
        good = self.keys[k] == keys[hit]
        pair = np.unique(where[hit[good]] * len(self.keys) + k[good])  # a feature counts once in a passage
        total = np.bincount(pair // len(self.keys), self.weights[pair % len(self.keys)], len(doc))
        return np.maximum.reduceat(total, np.flatnonzero(np.concatenate(([True], doc[1:] != doc[:-1]))))

    def score(self, texts: Sequence[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(expected grade, P(grade >= 1)) of the worst passage of each text."""
        p = 1 / (1 + np.exp(self.cuts[None, :] - np.round(self.margins(texts), 9)[:, None]))
        return p.sum(1), p[:, 0]


def _ordinal(where: np.ndarray, feature: np.ndarray, width: int, y: np.ndarray, sw: np.ndarray, steps: int = 100, l2: float = 0.1) -> tuple[np.ndarray, np.ndarray]:
    """Weights and cuts of the cumulative-link model by full-batch Adam.  where, feature: row and column of each 1."""
    grades = max(GRADES.values())
    w, t = np.zeros(width), np.array([3.0, *np.full(grades - 1, -0.5)])  # first cut, then logs of steps
    m, v = [np.zeros_like(w), np.zeros_like(t)], [np.zeros_like(w), np.zeros_like(t)]
    sig = lambda z: 1 / (1 + np.exp(-np.clip(z, -30, 30)))
    for step in range(1, steps + 1):
        cuts = np.cumsum(np.concatenate((t[:1], np.exp(t[1:]))))
        s = np.bincount(where, w[feature], len(y))
        edge = np.concatenate(([-np.inf], cuts, [np.inf]))
        up, lo = sig(edge[y + 1] - s), sig(edge[y] - s)
        up[y == grades], lo[y == 0] = 1.0, 0.0
        p = np.maximum(up - lo, 1e-9)
        du, dl = up * (1 - up), lo * (1 - lo)
        gw = np.bincount(feature, (sw * (du - dl) / p)[where], width) + l2 * w
        gc = np.array([-np.sum((sw * du / p)[y == k]) + np.sum((sw * dl / p)[y == k + 1]) for k in range(grades)])
        rest = np.cumsum(gc[::-1])[::-1]
        gt = np.concatenate((rest[:1], rest[1:] * np.exp(t[1:]))) + np.concatenate((t[:1] - 3.0, t[1:] + 0.5))  # the cuts stay near where they begin
        for k, (par, g) in enumerate(((w, gw), (t, gt))):
            m[k] = 0.9 * m[k] + 0.1 * g
            v[k] = 0.999 * v[k] + 0.001 * g * g
            par -= 0.15 * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
        np.minimum(w, MOST, out=w)
    return w, np.cumsum(np.concatenate((t[:1], np.exp(t[1:]))))


class _Sample:
    """The documents of the training sample as passages of features, each feature that two documents share a number."""

    def __init__(self, texts: Sequence[str]):
        self.reader = Reader()
        self.doc, where, keys = self.reader.read(texts)
        self.keys, feature = np.unique(keys, return_inverse=True)
        pair = np.unique(where * len(self.keys) + feature)
        where, feature = pair // len(self.keys), pair % len(self.keys)
        df = np.bincount(np.unique(self.doc[where] * len(self.keys) + feature) % len(self.keys), minlength=len(self.keys))
        keep = df[feature] > 1
        number = np.cumsum(df > 1) - 1
        self.keys, self.where, self.feature = self.keys[df > 1], where[keep], number[feature[keep]]

    def documents(self, which: np.ndarray) -> np.ndarray:
        """In how many of the documents, given as a mask, each feature stands."""
        ok = which[self.doc[self.where]]
        pair = np.unique(self.doc[self.where[ok]] * len(self.keys) + self.feature[ok])
        return np.bincount(pair % max(1, len(self.keys)), minlength=len(self.keys))


def _fit(s: _Sample, grade: np.ndarray, fold: np.ndarray, rounds: int = 3) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(keys, weights, cuts, margin of each document's worst passage by a model that hasn't seen the document's fold).

    grade of each document: above 0 bad, 0 fine, -1 unlabelled.  Which passages are meant, and which labels are wrong,
    is judged by models that haven't seen them either: a document can't vouch for itself."""
    n_bad, n_rest = max(1, (grade > 0).sum()), max(1, (grade <= 0).sum())
    bad, rest = s.documents(grade > 0), s.documents(grade <= 0)
    lift = np.log(np.maximum(1e-9, bad / n_bad) / ((rest + 1) / n_rest))
    telling = (bad >= 2) & (lift - 1.5 / np.sqrt(np.maximum(bad, 1)) > np.log(8))
    # What a passage's words say by themselves: at first the passages of a bad document with the most of it are meant.
    hint = np.bincount(s.where, np.where(telling, np.minimum(lift, np.log(50)), 0.0)[s.feature], len(s.doc))
    beside = np.zeros(len(s.doc), bool)
    beside[s.where[telling[s.feature]]] = True
    near, every = np.bincount(s.feature[beside[s.where]], minlength=len(s.keys)), np.bincount(s.feature, minlength=len(s.keys))
    used = telling | (near >= 3) & (near > 0.3 * every)  # and words that tell what is fine beside such words
    number, ok = np.cumsum(used) - 1, used[s.feature]
    where, feature, width = s.where[ok], number[s.feature[ok]], int(used.sum())
    # Passages with the same features are one row.
    print_ = np.zeros(len(s.doc), np.int64)
    np.add.at(print_, where, np.random.default_rng(5).integers(1, 1 << 62, width)[feature])
    _, head, row = np.unique(print_, return_index=True, return_inverse=True)
    is_head = np.zeros(len(s.doc), bool)
    is_head[head] = True
    sel = np.flatnonzero(is_head[where])
    sel = sel[np.argsort(row[where[sel]], kind="stable")]
    columns = feature[sel]
    length = np.bincount(row[where[sel]], minlength=len(head))
    start = np.cumsum(length) - length
    g, f = grade[s.doc], fold[s.doc]
    # A row that other documents hold as often as bad ones is fine, whatever it looks like.
    in_bad, in_rest = np.bincount(row[g > 0], minlength=len(head)), np.bincount(row[g <= 0], minlength=len(head))
    plain_row = ((in_rest >= 3) & (in_rest / n_rest > 0.5 * in_bad / n_bad))[row]

    def fitted(seen: np.ndarray, margin: np.ndarray, cuts: np.ndarray, first: bool) -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(np.clip(cuts[0] - margin, -30, 30)))
        best = np.full(len(grade), -np.inf)
        np.maximum.at(best, s.doc, margin)
        meant = (g > 0) & ~plain_row & ((p > 0.5) | (margin == best[s.doc]) & (p > (0.05 if first else 0.3)))
        more = (g == -1) & ~plain_row & (p > SURE) & (not first)
        fine = (g == 0) & ((p < SURE) | plain_row) | (g == -1) & ((p < 0.3) | plain_row)
        sure = 1 + np.clip((margin[:, None] >= cuts[None, 1:]).sum(1), 0, 2)
        rows = []  # a row for each set of features and grade, weighted by its passages, of fine ones 30 at most
        for mask, grades, most, each in ((meant, g, 1e9, 1.0), (more, sure, 1e9, 0.5), (fine, np.zeros_like(g), 30.0, 1.0)):
            u, c = np.unique(row[mask & seen] * 4 + grades[mask & seen], return_counts=True)
            rows.append((u // 4, u % 4, np.minimum(c, most) * each))
        at, y, sw = (np.concatenate(x) for x in zip(*rows))
        n = length[at]
        idx = np.repeat(start[at] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        return _ordinal(np.repeat(np.arange(len(at)), n), columns[idx], width, y, sw)

    margin, cuts = hint, np.array([8.0, 9.0, 10.0])
    for r in range(rounds):
        apart, at = np.zeros(len(s.doc)), []
        for k in range(FOLDS):
            w, c = fitted(f != k, margin, cuts, r == 0)
            own = f[where] == k
            # Margins of different models compare by their distance to the first cut.
            m = np.bincount(where[own], w[feature[own]], len(s.doc)) - c[0]
            apart += np.where(f == k, m, 0.0)
            at.append(c - c[0])
        margin, cuts = apart, np.mean(at, 0)
    w, c = fitted(np.ones(len(s.doc), bool), margin, cuts, False)
    best = np.full(len(grade), -np.inf)
    np.maximum.at(best, s.doc, margin)
    return s.keys[used], w, c, best


def train(labelled: list[tuple[str, int]]) -> Model:
    """labelled: text and grade of documents, -1 of unlabelled ones.  Without bad documents nothing is ever bad.

    The bar is the middle of those whose F1 on the labelled documents, scored by models of other folds, is within half a
    percent of the best.  Copies of a text fall into the same fold."""
    docs = [(t, g) for t, g in labelled if t]
    grade = np.array([g for _, g in docs], dtype=np.int64)
    if not (grade > 0).any():
        return Model([], np.zeros(0, np.uint64), np.zeros(0), np.array([3.0, 4.0, 5.0]))
    sample = _Sample([t for t, _ in docs])
    fold = np.array([_key(t) // 2 % FOLDS for t, _ in docs])
    keys, weights, cuts, best = _fit(sample, grade, fold)
    bars = np.arange(1, 20) / 20
    above = 1 / (1 + np.exp(-best))[:, None] >= bars[None, :]
    hit, said = above[grade > 0].sum(0), above[grade >= 0].sum(0)
    f1 = 2 * hit / ((grade > 0).sum() + said)
    good = bars[f1 >= f1.max() - 0.005]
    read = sample.reader
    words = {read.keys[n]: canonical(p.strip())[0] for p, n in read.number.items() if read.keys[n]}
    order = np.argsort(-weights, kind="stable")
    found = [words[int(keys[k])] for k in order if weights[k] > 0 and int(keys[k]) in words]
    return Model([w for w in found if "*" not in w], keys, weights, cuts, float(good[len(good) // 2]))


def agreed_labels(labels: DataFrame) -> DataFrame:
    """(doc_id, grade): the label most raters give a document; none where labels tie.  Labels are compared without outer
    spaces and letter case, unknown ones don't count, a rater's equal labels count once."""
    grade = F.create_map(*(F.lit(x) for kv in GRADES.items() for x in kv))[F.lower(F.trim("label"))]
    votes = labels.select("doc_id", grade.alias("grade"), F.coalesce("rater", F.lit("")).alias("rater")).where("grade is not null and doc_id is not null").distinct()
    n = votes.groupBy("doc_id", "grade").agg(F.count(F.lit(1)).alias("n"))
    best = n.groupBy("doc_id").agg(F.max_by("grade", "n").alias("grade"), F.max("n").alias("top"), F.collect_list("n").alias("all"))
    return best.where(F.size(F.filter("all", lambda x: x == F.col("top"))) == 1).select("doc_id", "grade")


def fit(documents: DataFrame, labels: DataFrame, max_bad: int = MAX_BAD, max_fine: int = MAX_FINE) -> Model:
    """Train on at most max_bad documents labelled bad and max_fine others, those labelled fine first, then unlabelled
    ones (the smallest hashes of doc_id each): this bounded sample is all that comes to the driver."""
    agreed = cut(agreed_labels(labels), "p8-labels")
    order = (F.xxhash64("doc_id"), F.col("doc_id"))
    bad = agreed.where("grade > 0").orderBy(*order).limit(max_bad)
    fine = agreed.where("grade = 0").orderBy(*order).limit(max_fine)
    ids = {r["doc_id"]: r["grade"] for part in (bad, fine) for r in part.collect()}
    lack = max_fine - sum(not g for g in ids.values())
    texts = documents.select("doc_id", "text").where("doc_id is not null and text is not null")
    if lack > 0 and any(ids.values()):
        more = texts.select("doc_id").join(labels.select("doc_id"), "doc_id", "left_anti").orderBy(*order).limit(lack)
        ids |= {r["doc_id"]: -1 for r in more.collect()}
    if not any(g > 0 for g in ids.values()):
        return train([])
    rows = texts.where(F.col("doc_id").isin(sorted(ids))).dropDuplicates(["doc_id"]).collect()  # reads row groups by id
    return train([(r["text"], ids[r["doc_id"]]) for r in sorted(rows, key=lambda r: r["doc_id"])])


def score_texts(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, severity, probability, flagged) for every row with an id: the expected grade of the worst passage, the
    probability that its grade is above 0, and whether that reaches the model's bar.  Null and empty texts score as one
    without features and are never flagged.  Every passage of every text is scored; of repeated rows of an id the worst
    counts."""
    shipped = df.sparkSession.sparkContext.broadcast((model.words, model.keys, model.weights, model.cuts))  # bounded by the sample

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Model(*shipped.value)
        for b in batches:
            for lo in range(0, b.num_rows, 1000):
                c = b.slice(lo, 1000)
                texts = c.column("t").to_pylist()
                severity, p = own.score(texts)
                yield pa.RecordBatch.from_arrays([c.column("id"), pa.array(severity), pa.array(p), pa.array([bool(t) for t in texts])], ["id", "severity", "probability", "full"])

    kind = df.schema[id_col].dataType.simpleString()
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("t")).where("id is not null").mapInArrow(run, f"id {kind}, severity double, probability double, full boolean")
    one = rows.groupBy("id").agg(F.max("severity").alias("severity"), F.max("probability").alias("probability"), F.max("full").alias("full"))
    return one.select(F.col("id").alias(id_col), "severity", "probability", (F.col("full") & (F.col("probability") >= model.bar)).alias("flagged"))


def source_rates(df: DataFrame, scores: DataFrame, id_col: str = "doc_id", source_col: str = "source") -> DataFrame:
    """(source, documents, flagged, rate, mean_severity): sources without outer spaces and letter case, null where a
    document has none."""
    src = df.select(id_col, F.lower(F.trim(source_col)).alias("source")).dropDuplicates([id_col])
    return src.join(scores, id_col).groupBy("source").agg(F.count(F.lit(1)).alias("documents"), F.count_if("flagged").alias("flagged"), F.avg(F.col("flagged").cast("double")).alias("rate"), F.avg("severity").alias("mean_severity"))
