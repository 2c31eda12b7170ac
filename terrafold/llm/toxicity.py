"""Toxic spans by a linear-chain conditional random field over words.

Labels exist for documents only, so tokens are labelled first: a word or word beginning that turns up
in toxic labelled texts far more often than in others (a G-test over groups of near-equal texts)
labels its occurrences in toxic texts. The field has two states; a word's features are itself, its
beginnings of 3 to 6 letters and its last 3, hashed into one weight vector. It is fitted by gradient
steps on the exact log-likelihood of windows from a bounded sample of labelled rows. Scoring runs
forward and backward over every word of a whole text; the marginals give the offending offsets and,
joined by noisy-or, the score of the document.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terrafold.llm.common import stored

#: The bounded sample of the fit: labelled rows at most, by class, in the order of a hash of their id; characters of all of them.
MAX_TOXIC, MAX_CLEAN, MAX_CHARS = 1500, 2500, 64 << 20
FOLDS, HELD_OUT = 3, 1
BITS = 18
#: Words of a window; windows of each of three kinds that the fit uses at most, drawn evenly from all windows of the sample.
WINDOW, MAX_WINDOWS = 24, 8000
#: A feature labels tokens from this G statistic and this share of toxic texts on.
LEAST_G, LEAST_SHARE = 18.0, 0.97
EPOCHS, RATE, DECAY = 80, 0.5, 1e-4
#: Marginals from here on join the noisy-or; spans are reported from SPAN on.
FLOOR, SPAN, THRESHOLD = 0.2, 0.5, 0.7

_WORDS = re.compile(r"[^\W_]+")


def words_of(text: str) -> list[str]:
    """The text's words in lower case, one for each match of the pattern in the text itself."""
    lower = text.lower()
    # lower-casing may lengthen a text and split its words; words are then cut first
    return _WORDS.findall(lower) if len(lower) == len(text) else [w.lower() for w in _WORDS.findall(text)]


def features(word: str) -> tuple[str, ...]:
    return ("w" + word, *(f"p{word[:n]}" for n in (3, 4, 5, 6) if len(word) > n), "s" + word[-3:])


def _slot(feature: str) -> int:
    return zlib.crc32(feature.encode("utf-8", "surrogatepass")) & ((1 << BITS) - 1)


@dataclass
class Field:
    """Weights of the toxic state against the other (the last entry is the bias) and log transitions."""

    weights: np.ndarray
    start: float
    trans: np.ndarray

    def emission(self, word: str) -> float:
        w = self.weights
        return float(w[-1] + sum(w[_slot(f)] for f in features(word)))


def token_labels(texts: list[list[str]], toxic: list[int]) -> set[str]:
    """Features that label tokens; near-equal texts (same least word hash) count once."""
    seen: dict[str, set[tuple[int, int]]] = {}
    groups: set[tuple[int, int]] = set()
    for words, y in zip(texts, toxic, strict=True):
        own = set(words)
        if not own:
            continue
        group = (y, min(zlib.crc32(w.encode("utf-8", "surrogatepass")) for w in own))
        groups.add(group)
        for f in {f for w in own for f in features(w) if f[0] == "w" or f[0] == "p" and len(f) > 4}:
            seen.setdefault(f, set()).add(group)
    n1 = sum(y for y, _ in groups)
    n0 = len(groups) - n1
    if not n1 or not n0:
        return set()
    out, log = set(), np.log
    for f, where in seen.items():
        a = sum(y for y, _ in where)
        if a < 3:
            continue
        b = len(where) - a
        share = (a / n1) / (a / n1 + b / n0)
        if share < LEAST_SHARE:
            continue
        n, k = n0 + n1, a + b
        cells = ((a, k * n1 / n), (b, k * n0 / n), (n1 - a, (n - k) * n1 / n), (n0 - b, (n - k) * n0 / n))
        if 2 * sum(o * log(o / e) for o, e in cells if o and e) >= LEAST_G:
            out.add(f)
    return out


def _windows(texts: list[list[str]], toxic: list[int], labelled: set[str], seed: int = 0) -> tuple[np.ndarray, np.ndarray, list[list[str]]]:
    """Windows of words with their token labels: around labelled tokens, around words of clean texts that begin like those, and anywhere."""
    rng = np.random.default_rng(seed)
    near, like, far = [], [], []
    begin = {f"p{f[1:n]}" for f in labelled for n in (4, 5)}
    for words, y in zip(texts, toxic, strict=True):
        if not words:
            continue
        tags = [int(bool(y) and any(f in labelled for f in features(w))) for w in words] if y else [0] * len(words)
        hits = [i for i, t in enumerate(tags) if t]
        for i in hits:
            at = max(0, min(i - WINDOW // 2, len(words) - WINDOW))
            near.append((words[at : at + WINDOW], tags[at : at + WINDOW]))
        if not y:
            for i in [i for i, w in enumerate(words) if not begin.isdisjoint(features(w))]:
                at = max(0, min(i - WINDOW // 2, len(words) - WINDOW))
                like.append((words[at : at + WINDOW], tags[at : at + WINDOW]))
        for _ in range(1 if y else 3):
            at = int(rng.integers(0, max(1, len(words) - WINDOW + 1)))
            far.append((words[at : at + WINDOW], tags[at : at + WINDOW]))
    pick = lambda rows: [rows[i] for i in sorted(rng.permutation(len(rows))[: MAX_WINDOWS])]
    rows = pick(near) + pick(like) + pick(far)
    tags = np.full((len(rows), WINDOW), -1, np.int8)
    for i, (_, t) in enumerate(rows):
        tags[i, : len(t)] = t
    return tags, tags >= 0, [w for w, _ in rows]


def fit(texts: list[str], toxic: list[int]) -> Field | None:
    """The field of labelled texts; None if no token can be labelled."""
    split = [words_of(t) for t in texts]
    labelled = token_labels(split, toxic)
    if not labelled:
        return None
    tags, inside, words = _windows(split, toxic, labelled)
    known: dict[str, np.ndarray] = {}
    for w in {w for row in words for w in row}:
        known[w] = np.array([_slot(f) for f in features(w)])
    where = [(i, t) for i, row in enumerate(words) for t in range(len(row))]
    slots = [known[words[i][t]] for i, t in where]
    flat = np.concatenate(slots)
    owner = np.repeat(np.arange(len(slots)), [len(s) for s in slots])
    rows, cols = np.array(where).T
    n, length = tags.shape
    y = (tags == 1).astype(float)
    w = np.zeros((1 << BITS) + 1)
    w[-1] = -4.0
    start, trans = -1.0, np.zeros((2, 2))
    g2, gs2, gt2 = np.full_like(w, 1e-8), 1e-8, np.full((2, 2), 1e-8)
    lengths = inside.sum(axis=1)
    for _ in range(EPOCHS):
        e = np.zeros((n, length))
        e[rows, cols] = np.bincount(owner, w[flat], minlength=len(slots)) + w[-1]
        a, logz = np.zeros((n, length, 2)), np.zeros((n, 2))
        a[:, 0, 1] = start + e[:, 0]
        for t in range(1, length):
            step = np.logaddexp(a[:, t - 1, 0, None] + trans[0], a[:, t - 1, 1, None] + trans[1])
            step[:, 1] += e[:, t]
            a[:, t] = np.where(inside[:, t, None], step, a[:, t - 1])
        logz = np.logaddexp(a[:, -1, 0], a[:, -1, 1])
        b = np.zeros((n, length, 2))
        both = np.zeros((2, 2))
        for t in range(length - 2, -1, -1):
            nxt = b[:, t + 1] + np.stack([np.zeros(n), e[:, t + 1]], axis=1)
            step = np.logaddexp(trans[:, 0] + nxt[:, 0, None], trans[:, 1] + nxt[:, 1, None])
            on = inside[:, t + 1]
            b[:, t] = np.where(on[:, None], step, b[:, t + 1])
            joint = np.exp(a[:, t, :, None] + trans + nxt[:, None, :] - logz[:, None, None])
            both += joint[on].sum(axis=0)
            for i in (0, 1):
                for j in (0, 1):
                    both[i, j] -= (((tags[:, t] == i) & (tags[:, t + 1] == j)) & on).sum()
        p = np.exp(a[:, :, 1] + b[:, :, 1] - logz[:, None])
        miss = np.where(inside, p - y, 0.0)
        grad = np.zeros_like(w)
        grad[:-1] = np.bincount(flat, miss[rows, cols][owner], minlength=1 << BITS)
        grad[-1] = miss.sum()
        grad = grad / n + DECAY * np.concatenate([w[:-1], [0.0]])
        g2 += grad**2
        w -= RATE * grad / np.sqrt(g2)
        gs = (miss[:, 0] * (lengths > 0)).sum() / n
        gs2 += gs**2
        start -= RATE * gs / np.sqrt(gs2)
        gt = both / n + DECAY * trans
        gt2 += gt**2
        trans = trans - RATE * gt / np.sqrt(gt2)
    return Field(w, float(start), trans)


class Scorer:
    """Marginals of whole texts under a field; a word's emission is computed once."""

    CACHE_WORDS = 500_000

    def __init__(self, field: Field) -> None:
        self.field = field
        self.known: dict[str, float] = {}
        (a, b), (c, d) = np.exp(field.trans).tolist()
        self.trans = (a, b, c, d)
        self.start = float(np.exp(field.start))

    def marginals(self, words: list[str]) -> list[float]:
        """P(toxic) of each word: ratios of the two states, forward and backward."""
        known = self.known
        if len(known) > self.CACHE_WORDS:
            known.clear()
        for w in set(words).difference(known):
            known[w] = float(np.exp(np.clip(self.field.emission(w), -60, 60)))
        e = list(map(known.__getitem__, words))
        a, b, c, d = self.trans
        forward, r = [], 0.0
        for i, x in enumerate(e):
            r = x * (b + d * r) / (a + c * r) if i else x * self.start
            forward.append(r)
        out, back = [0.0] * len(e), 1.0
        for i in range(len(e) - 1, -1, -1):
            q = forward[i] * back
            out[i] = q / (1.0 + q)
            x = e[i] * back
            back = (c + d * x) / (a + b * x)
        return out

    def score(self, text: str | None) -> tuple[float, list[tuple[int, int, float]]]:
        """The document's score, and (start, end, marginal) of offending words in code points."""
        if not text:
            return 0.0, []
        words = words_of(text)
        if not words:
            return 0.0, []
        p = self.marginals(words)
        top = max(p)
        if top < FLOOR:
            return top, []
        clean = 1.0
        for x in p:
            if x >= FLOOR:
                clean *= 1.0 - x
        spans = []
        if top >= SPAN:
            places = _WORDS.finditer(text.lower() if len(text.lower()) == len(text) else text)
            spans = [(m.start(), m.end(), x) for m, x in zip(places, p, strict=True) if x >= SPAN]
        return min(1.0, max(top, 1.0 - clean)), spans


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == HELD_OUT, F.lit(False))


def trained(docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id", max_toxic: int = MAX_TOXIC, max_clean: int = MAX_CLEAN, max_chars: int = MAX_CHARS) -> Field | None:
    """Fits on labelled rows outside the held-out fold: ``max_toxic`` and ``max_clean`` of them, and ``max_chars`` characters, at most.

    Rows without an id or a label, and null texts, take no part; a row labelled twice is toxic if any label says so; of
    rows with one id the least text counts. None if the labels or the documents are empty or no token can be labelled.
    """
    rows = labels.filter(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("y"))
    order = F.xxhash64("doc_id")
    chosen = rows.filter("y = 1").orderBy(order, "doc_id").limit(max_toxic).union(rows.filter("y = 0").orderBy(order, "doc_id").limit(max_clean))
    src = docs.select(docs[doc_id].alias("doc_id"), docs[text].alias("t")).filter(F.col("t").isNotNull())
    rows = stored(src.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "y").agg(F.min("t").alias("t")), "sample")
    # whole rows in the order of the hash until the characters are used up
    so_far = F.sum(F.length("t")).over(Window.orderBy(F.xxhash64("doc_id"), "doc_id"))
    few = rows.select("doc_id", so_far.alias("upto")).filter(F.col("upto") <= max_chars).select("doc_id")  # max_toxic + max_clean rows at most
    got = sorted(rows.join(F.broadcast(few), "doc_id").collect(), key=lambda r: r["doc_id"])
    return fit([r["t"] for r in got], [r["y"] for r in got])


def scored(docs: DataFrame, field: Field | None, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, held_out, score, predicted and spans, one row for each row of ``docs``.

    Null texts and texts without words score 0, and so do all if no field could be fitted. Null ids
    aren't held out; repeated rows come back repeated; other columns are never read; an empty table
    gives an empty result.
    """
    src = docs.select(docs[doc_id].cast("long").alias("doc_id"), held_out(docs[doc_id]).alias("held_out"), docs[text].alias("t"))
    shared = docs.sparkSession.sparkContext.broadcast(field)  # one weight vector of fixed size
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("p", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Scorer(shared.value) if shared.value is not None else None
        for b in batches:
            got = [own.score(t.as_py()) if own else (0.0, []) for t in b.column(2)]
            s = [x for x, _ in got]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(s, pa.float64()), pa.array([int(x >= THRESHOLD) for x in s], pa.int32()), pa.array([[dict(zip(("start", "end", "p"), x, strict=True)) for x in f] for _, f in got], span)],
                names=["doc_id", "held_out", "score", "predicted", "spans"],
            )

    return src.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int, spans array<struct<start:bigint,end:bigint,p:double>>")


def toxicity(docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """:func:`scored` by a field :func:`trained` on ``labels``; see there for nulls, repeated rows and empty tables."""
    return scored(docs, trained(docs, labels, text, doc_id), text, doc_id)


__all__ = ["Field", "Scorer", "fit", "scored", "toxicity", "trained"]
