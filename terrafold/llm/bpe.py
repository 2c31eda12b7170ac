"""BPE encoding and decoding by speculation: longest match first, vectorised checks, merging only where needed.

A sequence of tokens is the merging's own result exactly if every token is the merging's result of
its own characters and every adjacent pair is the merging's result of the two tokens' characters
put together. So each new word is cut greedily into the longest tokens, all adjacent pairs of a
batch are looked up at once among pairs with a known answer, and only words with a failing pair
are merged step by step. Answers about pairs and words are kept by each worker in bounded caches.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

VOCABULARY = "word_bpe_49k.json"
#: Words, letters in them and pairs that a worker remembers; what it keeps beyond is of its last texts only.
CACHE_WORDS, CACHE_LETTERS, CACHE_PAIRS = 250_000, 3_000_000, 4_000_000
#: Sequences of so many symbols or fewer are merged by scanning all their pairs, longer ones by a heap; the result is the same.
SHORT = 64
#: Texts of these characters alone need no library to be normalised and cut into words.
_PLAIN = re.compile("[^\t\n\r\x20-\x7e\xa1-\xac\xae-\u024f]")
LETTER, NUMBER = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\u024f", "0-9\xb2\xb3\xb9\xbc-\xbe"
#: The vocabulary's splitter for those characters, lower-cased; its branches begin with different characters, so the most frequent comes first.
_SPLIT = re.compile(f"[{LETTER}]+|'(?:s|t|re|ve|m|ll|d)|[{NUMBER}]|[^\\s{LETTER}{NUMBER}]+")
_NEVER = 1 << 60


def byte_letters() -> list[str]:
    """The printable character that byte-level vocabularies use for each byte."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(spare)) for b in range(256)]


class Merger:
    """Encodes words by a vocabulary file of the public tokenizers' JSON format."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.suffix: str = model.get("end_of_word_suffix") or ""
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.made = [self.vocab[a + b] for a, b in pairs]
        self.token = {i: t for t, i in self.vocab.items()}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.token |= {i: t for t, i in self.special.items()}
        self.width = max(self.token) + 1
        #: Rank of each mergeable pair (a * width + b).
        self.rank = {self.vocab[a] * self.width + self.vocab[b]: r for r, (a, b) in reversed(list(enumerate(pairs)))}
        self.longest = max(map(len, self.vocab))
        self.letters = byte_letters()
        self.library = Tokenizer.from_file(path)
        self.special_split = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.own: dict[int, bool] = {}
        self.pair_keys = np.empty(0, np.int64)
        self.pair_ok = np.empty(0, bool)
        self.words: dict[str | int, list[int]] = {}
        self.shown: dict[str | int, str] = {}
        self.text: dict[str | int, str] = {}
        self.decimal = {i: str(i) for i in self.token}
        self.merged_words = 0
        self._forget()

    # words -----------------------------------------------------------------

    def symbols(self, letters: str) -> list[int]:
        """Ids of single letters, the last with the word-end mark; letters outside the vocabulary go."""
        marked = [*letters[:-1], letters[-1] + self.suffix]
        return [self.vocab[s] for s in marked if s in self.vocab]

    def merge(self, ids: list[int]) -> list[int]:
        """The plain algorithm: join the leftmost pair of the lowest rank until none is left."""
        if len(ids) > SHORT:
            return self._merge_long(ids)
        ids, get, width, made = list(ids), self.rank.get, self.width, self.made
        ranks = [get(a * width + b, _NEVER) for a, b in zip(ids, ids[1:])]
        while ranks:
            low = min(ranks)
            if low == _NEVER:
                break
            i = ranks.index(low)
            ids[i : i + 2] = (made[low],)
            del ranks[i]
            if i:
                ranks[i - 1] = get(ids[i - 1] * width + ids[i], _NEVER)
            if i < len(ranks):
                ranks[i] = get(ids[i] * width + ids[i + 1], _NEVER)
        return ids

    def _merge_long(self, ids: list[int]) -> list[int]:
        """The same by a heap of (rank, place) and links between places: n log n steps."""
        ids, get, width, made, n = list(ids), self.rank.get, self.width, self.made, len(ids)
        right, left = list(range(1, n + 1)), list(range(-1, n - 1))
        waiting = [(r, i) for i in range(n - 1) if (r := get(ids[i] * width + ids[i + 1])) is not None]
        heapq.heapify(waiting)
        while waiting:
            rank, i = heapq.heappop(waiting)
            j = right[i]
            # a place that has gone, or whose pair has changed since
            if ids[i] < 0 or j >= n or get(ids[i] * width + ids[j]) != rank:
                continue
            ids[i], ids[j], right[i] = made[rank], -1, right[j]
            if right[j] < n:
                left[right[j]] = i
            for k in (left[i], i):
                if k >= 0 and right[k] < n and (r := get(ids[k] * width + ids[right[k]])) is not None:
                    heapq.heappush(waiting, (r, k))
        return [t for t in ids if t >= 0]

    def parts(self, token: int) -> list[int]:
        """The single-letter ids that a token stands for."""
        s = self.token[token]
        if self.suffix and s.endswith(self.suffix) and len(s) > len(self.suffix):
            return self.symbols(s[: -len(self.suffix)])
        return [self.vocab[c] for c in s]

    def stands(self, token: int) -> bool:
        """Whether merging the token's own letters gives the token."""
        ok = self.own.get(token)
        if ok is None:
            ok = self.own[token] = all(c in self.vocab for c in self.token[token].removesuffix(self.suffix)) and self.merge(self.parts(token)) == [token]
        return ok

    def speculate(self, letters: str) -> list[int] | None:
        """Longest tokens from the left; None if some place has none."""
        out, at, n, get = [], 0, len(letters), self.vocab.get
        while at < n:
            for end in range(min(n, at + self.longest), at, -1):
                t = get(letters[at:end] + self.suffix if end == n else letters[at:end])
                if t is not None and self.stands(t):
                    break
            else:
                return None
            out.append(t)
            at = end
        return out

    def compatible(self, keys: np.ndarray) -> np.ndarray:
        """For each pair a * width + b: whether merging its letters gives exactly (a, b)."""
        distinct, back = np.unique(keys, return_inverse=True)
        at = np.searchsorted(self.pair_keys, distinct)
        known = (at < len(self.pair_keys)) & (self.pair_keys[np.minimum(at, max(len(self.pair_keys) - 1, 0))] == distinct) if len(self.pair_keys) else np.zeros(len(distinct), bool)
        ok = np.zeros(len(distinct), bool)
        ok[known] = self.pair_ok[at[known]]
        fresh = distinct[~known]
        if len(fresh):
            a, b = fresh // self.width, fresh % self.width
            answers = np.fromiter((self.merge(self.parts(x) + self.parts(y)) == [x, y] for x, y in zip(a.tolist(), b.tolist(), strict=True)), bool, len(fresh))
            ok[~known] = answers
            if len(self.pair_keys) > CACHE_PAIRS:
                self.pair_keys, self.pair_ok = fresh, answers
            else:
                keys_ = np.concatenate([self.pair_keys, fresh])
                order = np.argsort(keys_, kind="stable")
                self.pair_keys, self.pair_ok = keys_[order], np.concatenate([self.pair_ok, answers])[order]
        return ok[back]

    def encode_words(self, letters: list[str]) -> list[list[int]]:
        """Ids of words given as byte letters, one list for each."""
        guesses = [self.speculate(w) for w in letters]
        sizes = np.array([len(g) if g else 0 for g in guesses], np.int64)
        flat = np.fromiter(chain.from_iterable(g for g in guesses if g), np.int64, int(sizes.sum()))
        fails = np.array([g is None for g in guesses], bool)
        if len(flat) > 1:
            owner = np.repeat(np.arange(len(guesses)), sizes)
            inside = owner[:-1] == owner[1:]
            ok = self.compatible((flat[:-1] * self.width + flat[1:])[inside])
            fails[owner[:-1][inside][~ok]] = True
        for i in np.flatnonzero(fails).tolist():
            self.merged_words += 1
            guesses[i] = self.merge(self.symbols(letters[i]))
        return guesses

    # texts -----------------------------------------------------------------

    def _cut(self, text: str) -> list[str]:
        """Words of a piece without special tokens; those the library cut are marked by a leading NUL."""
        if not _PLAIN.search(text):
            return _SPLIT.findall(text.lower())
        clean = self.library.normalizer.normalize_str(text)
        return ["\0" + w for w, _ in self.library.pre_tokenizer.pre_tokenize_str(clean)]

    def _forget(self, recent: set[str | int] = frozenset()) -> None:
        """Only ``recent`` words stay, or none if they are many themselves."""
        left = recent & self.words.keys()
        if len(left) > CACHE_WORDS // 2 or sum(len(w) for w in left if isinstance(w, str)) > CACHE_LETTERS // 2:
            left = set()
        self.words = {w: self.words[w] for w in left} | {i: [i] for i in self.special.values()}
        self.shown = {w: self.shown[w] for w in left} | {i: self.decimals([i]) for i in self.special.values()}
        self.text = {w: self.text[w] for w in left} | {i: self.decode([i]) for i in self.special.values()}
        self.held = sum(len(w) for w in left if isinstance(w, str))

    def _known(self, texts: Iterable[str]) -> list[list[str | int]]:
        """Texts as words (special tokens as their ids), all of which have an entry in the caches."""
        cut: list[list[str | int]] = []
        for t in texts:
            if self.special_split and any(s in t for s in self.special):
                row: list[str | int] = []
                for piece in self.special_split.split(t):
                    row += [self.special[piece]] if piece in self.special else self._cut(piece) if piece else []
                cut.append(row)
            else:
                cut.append(self._cut(t))
        asked = set().union(*cut)
        if len(self.words) > CACHE_WORDS or self.held > CACHE_LETTERS:
            self._forget(asked)
        letters = self.letters
        new = list(asked.difference(self.words))
        self.held += sum(map(len, new))
        spelled = [w[1:] if w[0] == "\0" else "".join([letters[b] for b in w.encode("utf-8", "surrogatepass")]) for w in new]
        for w, ids in zip(new, self.encode_words(spelled), strict=True):
            self.words[w], self.shown[w], self.text[w] = ids, self.decimals(ids), self.decode(ids)
        return cut

    def encode(self, texts: Iterable[str]) -> list[list[int]]:
        """Ids of whole texts, without special tokens added; those written in a text keep their ids."""
        cut = self._known(texts)
        get = self.words.__getitem__
        return [list(chain.from_iterable(map(get, row))) for row in cut]

    def described(self, texts: Iterable[str]) -> list[tuple[int, str, str]]:
        """For each text: how many ids, the ids in decimals, and their decoding; both joins go word by word, as the decoding of a text is that of its words."""
        out = []
        for row in self._known(texts):
            ids = [x for x in map(self.shown.__getitem__, row) if x]
            shown = " ".join(ids)
            out.append((shown.count(" ") + 1 if shown else 0, shown, " ".join([x for x in map(self.text.__getitem__, row) if x])))
        return out

    def decode(self, ids: list[int]) -> str:
        """The library's text of ids where the vocabulary names no decoder: tokens with spaces between."""
        return " ".join(map(self.token.__getitem__, ids))

    def decimals(self, ids: list[int]) -> str:
        return " ".join(map(self.decimal.__getitem__, ids))


_mergers: dict[str, Merger] = {}


def merger(path: str) -> Merger:
    if path not in _mergers:
        _mergers[path] = Merger(path)
    return _mergers[path]


#: Texts that are encoded together; a batch of very long texts is cut by characters too.
TEXTS, CHARS = 256, 4 << 20


def _groups(texts: list[str]) -> Iterator[list[str]]:
    held, size = [], 0
    for t in texts:
        held.append(t)
        size += len(t)
        if len(held) >= TEXTS or size >= CHARS:
            yield held
            held, size = [], 0
    if held:
        yield held


def encoded(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), vocabulary: str | None = None) -> DataFrame:
    """``keep`` columns and ``ids`` (array of int) of every whole text; null and empty texts: none."""
    path = vocabulary or public_tokenizers.path(VOCABULARY)
    src = docs.select(*(F.col(f"`{c}`").alias(f"k_{i}") for i, c in enumerate(keep)), F.col(f"`{text}`").alias("t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = merger(path)
        for b in batches:
            ids = chain.from_iterable(m.encode(g) for g in _groups([t or "" for t in b.column(b.num_columns - 1).to_pylist()]))
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(list(ids), pa.list_(pa.int32()))], names=[*b.schema.names[:-1], "ids"])

    out = src.mapInArrow(run, ", ".join([f"k_{i} {t}" for i, (_, t) in enumerate(src.dtypes[:-1])] + ["ids array<int>"]))
    return out.select(*(F.col(f"k_{i}").alias(c) for i, c in enumerate(keep)), "ids")


def decoded(rows: DataFrame, ids: str = "ids", out: str = "decoded", vocabulary: str | None = None) -> DataFrame:
    """``rows`` with the text of their ids in ``out``; null ids: null."""
    path = vocabulary or public_tokenizers.path(VOCABULARY)

    @F.pandas_udf("string")
    def text_of(column):  # noqa: ANN001, ANN202
        m = merger(path)
        return column.map(lambda x: None if x is None else m.decode(x.tolist()))

    return rows.withColumn(out, text_of(F.col(f"`{ids}`")))


def digests(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", vocabulary: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256: each text encoded, then its ids decoded, in one pass.

    One row for each row of ``docs``, repeated ones and null ids included; null and empty texts have
    no tokens. Columns other than the two are never read; an empty table gives an empty result.
    """
    path = vocabulary or public_tokenizers.path(VOCABULARY)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = merger(path)
        sha = lambda s: hashlib.sha256(s.encode("utf-8", "surrogatepass")).hexdigest()
        for b in batches:
            n, a, d = [], [], []
            for group in _groups([t or "" for t in b.column(1).to_pylist()]):
                for count, ids, text_ in m.described(group):
                    n.append(count)
                    a.append(sha(ids))
                    d.append(sha(text_))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(d, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    src = docs.select(docs[doc_id].cast("long").alias("doc_id"), docs[text].alias("t"))
    return src.mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
