"""Token-ID output: documents as Parquet list columns, in document order, and back.

File format: one row for each document with ``doc_id``, ``part`` (which file), ``local_start`` (ids
before it in that file), ``n_tokens`` and ``tokens`` (list of int, the end id last). Files hold
ascending ranges of doc_id, rows ascend inside them. Tokens are dictionary encoded (a page that
outgrows its dictionary falls back to the v2 writer's delta encoding); row groups and pages are
kept small and page indexes are written, so a reader of some documents or of the metadata alone
fetches only those pages.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from terrafold.llm.bpe import LETTER, NUMBER, byte_letters
from terrafold.llm.common import new_path, shuffle_width

VOCABULARY = "byte_bpe_50k.json"
END_ID = 2
ROW_GROUP, PAGE = 16 << 20, 256 << 10
#: Words, and letters in them, that a worker remembers before it keeps those of its last texts only (about 90 MB).
CACHE_WORDS, CACHE_LETTERS = 400_000, 5_000_000
#: Longer words are never remembered.
LONG_WORD = 64
#: Texts and bytes that are encoded together, and words that are looked up together.
TEXTS, CHARS, WORDS = 1024, 4 << 20, 1 << 20
#: Texts with one of these characters go to the library whole; all others are split into words here.
_ODD = "[^\t\n\r\x20-\x7e\xa1-\xac\xae-\u024f]"
_WHITE = 3
WRITE_OPTIONS = {
    "parquet.block.size": str(ROW_GROUP),
    "parquet.page.size": str(PAGE),
    "parquet.writer.version": "v2",
    "parquet.enable.dictionary": "true",
    "parquet.dictionary.page.size": str(1 << 20),
    "compression": "zstd",
}


def _kinds() -> np.ndarray:
    """For each character up to U+024F: letter (1), number (2), white space (3) or other (0)."""
    every = "".join(map(chr, range(0x250)))
    out = np.zeros(len(every), np.uint8)
    for kind, chars in ((1, f"[{LETTER}]"), (2, f"[{NUMBER}]"), (_WHITE, r"\s")):
        out[[m.start() for m in re.finditer(chars, every)]] = kind
    return out


_KIND = _kinds()


def word_starts(data: np.ndarray, texts: np.ndarray) -> np.ndarray:
    """Where the words of the UTF-8 bytes ``data`` begin, and their end; ``texts`` has the same for texts (without _ODD characters).

    The words are those of the vocabulary's splitter, in turn the whole text:
    ``'(?:s|t|re|ve|m|ll|d)| ?letters+| ?numbers+| ?others+|\\s+(?!\\S)|\\s+``.
    """
    n = len(data)
    kind = _KIND[data]
    lead = np.flatnonzero(data >= 0xC0)  # all other characters are of two bytes
    kind[lead] = kind[lead + 1] = _KIND[(data[lead] & np.uint16(31)) << 6 | data[lead + 1] & 63]
    first = np.zeros(n + 3, bool)
    first[texts] = True
    start = first.copy()
    # another kind of character begins a word, unless a space before it does
    start[1:n] |= (kind[1:] != kind[:-1]) & (data[:-1] != 32)
    # the last of several white space characters is left to the word that follows in the same text
    white = kind == _WHITE
    last = np.flatnonzero(white[1:-1] & white[:-2] & ~white[2:]) + 1
    start[last[~first[last + 1]]] = True
    tick = np.flatnonzero(data == 39)
    tick = tick[start[tick]]
    if len(tick):
        after = np.concatenate([data, np.zeros(2, np.uint8)])
        a, b = after[tick + 1], after[tick + 2]
        short = np.isin(a, [*b"stmd"]) & ~first[tick + 1]
        long = (np.isin(a, [*b"rv"]) & (b == ord("e")) | (a == ord("l")) & (b == ord("l"))) & ~first[tick + 1] & ~first[tick + 2]
        start[tick[short | long] + 1] = False
        start[tick[short] + 2] = start[tick[long] + 3] = True
    return np.flatnonzero(start[: n + 1]).astype(np.int32)


class _Words(dict[str, bytes]):
    """Ids of words as packed 32-bit integers; a word that isn't there yet is given to the library's model."""

    def __init__(self, model, letters: list[str]) -> None:  # noqa: ANN001
        self.tokenize = model.tokenize
        self.letters = dict(enumerate(letters))
        self.space = letters[32]
        self.held = 0

    def __missing__(self, word: str) -> bytes:
        if word.isascii() and word.isprintable():  # of those characters only the space is shown by another
            shown = word.replace(" ", self.space)
        else:
            shown = word.encode().decode("latin-1").translate(self.letters)
        out = array("i", [t.id for t in self.tokenize(shown)]).tobytes()
        if len(word) <= LONG_WORD and not self.full():
            self[word] = out
            self.held += len(word)
        return out

    def forget(self) -> None:
        self.clear()
        self.held = 0

    def full(self) -> bool:
        return len(self) >= CACHE_WORDS or self.held >= CACHE_LETTERS

    def keep(self, recent: list[str]) -> None:
        """Only ``recent`` words stay, or none if they are many themselves."""
        left = {w: self[w] for w in recent if w in self}
        letters = sum(map(len, left))
        self.forget()
        if len(left) <= CACHE_WORDS // 2 and letters <= CACHE_LETTERS // 2:
            self.update(left)
            self.held = letters


class WordEncoder:
    """The library's ids of whole texts, with the ids of a frequent word asked for once.

    The vocabulary's splitter cuts a text into words that never merge across their borders, so
    ids of words in turn are the ids of the text. All texts of a batch are split at once, and each
    of their distinct words is looked up once, however many places it has. Special tokens' strings,
    and characters on which two Unicode versions might disagree, send the whole text to the library.
    """

    def __init__(self, path: str) -> None:
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.words = _Words(self.tokenizer.model, byte_letters())
        self.odd = "|".join([_ODD, *(re.escape(t.content) for t in self.tokenizer.get_added_tokens_decoder().values())])

    def ids(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts (no nulls) one after the other, and how many each text has."""
        texts = texts.cast(pa.string())
        odd = pc.match_substring_regex(texts, self.odd).to_numpy(zero_copy_only=False)
        if not odd.any():
            return self._plain(texts)
        n = np.empty(len(texts), np.int64)
        plain, n[~odd] = self._plain(texts.filter(pa.array(~odd)))
        whole = [np.array(self.tokenizer.encode(t, add_special_tokens=False).ids, np.int32) for t in texts.filter(pa.array(odd)).to_pylist()]
        n[odd] = [len(x) for x in whole]
        of_odd = np.repeat(odd, n)
        out = np.empty(len(of_odd), np.int32)
        out[~of_odd], out[of_odd] = plain, np.concatenate(whole)
        return out, n

    def _plain(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        size = pc.binary_length(texts).to_numpy().astype(np.int64)
        if not size.any():
            return np.empty(0, np.int32), size
        _, at, chars = texts.buffers()
        offsets = np.frombuffer(at, np.int32, len(texts) + 1, 4 * texts.offset)
        chars = chars.slice(int(offsets[0]), int(size.sum()))
        offsets = offsets - offsets[0]
        starts = word_starts(np.frombuffer(chars, np.uint8), offsets)
        words = pa.StringArray.from_buffers(len(starts) - 1, pa.py_buffer(starts), chars)
        ends, out = [np.zeros(1, np.int64)], []
        for lo in range(0, len(words), WORDS):
            coded = words.slice(lo, WORDS).dictionary_encode()
            distinct = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
            packed = list(map(self.words.__getitem__, distinct))
            if self.words.full():
                self.words.keep(distinct)
            n = np.fromiter(map(len, packed), np.int64, len(packed)) // 4
            flat, place = np.frombuffer(b"".join(packed), np.int32), coded.indices.to_numpy()
            each = n[place]
            upto = np.cumsum(each)
            out.append(flat[np.repeat((np.cumsum(n) - n)[place] - upto + each, each) + np.arange(upto[-1])])
            ends.append(ends[-1][-1] + upto)
        return np.concatenate(out), np.diff(np.concatenate(ends)[np.searchsorted(starts, offsets)])

    def packed(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as 32-bit integers."""
        ids, n = self.ids(pa.array(texts, pa.string()))
        return [ids[end - k : end].tobytes() for end, k in zip(np.cumsum(n), n, strict=True)]


_encoders: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


def _pieces(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """The batch in slices of TEXTS rows and about CHARS bytes of text at most (one text at least)."""
    size = pc.fill_null(pc.binary_length(b.column(1)), 0).to_numpy(zero_copy_only=False).cumsum()
    at = 0
    while at < b.num_rows:
        upto = int(np.searchsorted(size, (size[at - 1] if at else 0) + CHARS, "right"))
        n = max(1, min(upto - at, TEXTS))
        yield b.slice(at, n)
        at += n


def write_tokens(docs: DataFrame, target: str, text: str = "text", doc_id: str = "doc_id", vocabulary: str | None = None, end_id: int = END_ID, files: int | None = None, row_group: int = ROW_GROUP) -> None:
    """Writes the ids of every whole text, ``end_id`` appended, to ``target`` in the file format above."""
    path = vocabulary or public_tokenizers.path(VOCABULARY)
    src = docs.select(docs[doc_id].cast("long").alias("doc_id"), docs[text].alias("t"))
    ranged = src.repartitionByRange(files or shuffle_width(docs.sparkSession), "doc_id").sortWithinPartitions("doc_id", F.xxhash64("t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, at, enc = TaskContext.get().partitionId(), 0, encoder(path)
        for b in batches:
            for piece in _pieces(b):
                ids, n = enc.ids(pc.fill_null(piece.column(1), ""))
                flat = np.insert(ids, np.cumsum(n), end_id)
                n += 1
                ends = np.cumsum(n)
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), pa.array(flat))
                yield pa.RecordBatch.from_arrays([piece.column(0), pa.array(np.full(len(n), part, np.int32)), pa.array(at + ends - n), pa.array(n), lists], names=["doc_id", "part", "local_start", "n_tokens", "tokens"])
                at += int(ends[-1])

    out = ranged.mapInArrow(run, "doc_id long, part int, local_start long, n_tokens long, tokens array<int>")
    out.write.options(**WRITE_OPTIONS | {"parquet.block.size": str(row_group)}).parquet(target)


def read_tokens(spark, target: str) -> DataFrame:  # noqa: ANN001
    """The documents of a token folder with ``start``: ids of all documents before each."""
    rows = spark.read.schema("doc_id long, part int, local_start long, n_tokens long, tokens array<int>").parquet(target)
    sizes = rows.groupBy("part").agg(F.sum("n_tokens").alias("size"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = sizes.select("part", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("base"))  # a row for each file
    return rows.join(F.broadcast(bases), "part").select("doc_id", (F.col("base") + F.col("local_start")).alias("start"), "n_tokens", "tokens")


def digests(rows: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 (of the ids as little-endian unsigned 32-bit integers)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column(3)
            off, flat = lists.offsets.to_numpy(), lists.values.to_numpy().astype("<u4", copy=False)
            crc = [zlib.crc32(flat[off[i] : off[i + 1]]) for i in range(len(lists))]
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return rows.select("doc_id", "start", "n_tokens", "tokens").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_table(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", vocabulary: str | None = None) -> DataFrame:
    """Writes ``docs`` and gives the digest columns from the files.

    Null and empty texts hold the end id alone. Null doc_ids come first; rows with equal ids follow
    a hash of their text. An empty table writes an empty folder. Other columns are never read.
    """
    spark = docs.sparkSession
    target = new_path(spark, "tokens")
    write_tokens(docs, target, text, doc_id, vocabulary)
    return digests(read_tokens(spark, target))
