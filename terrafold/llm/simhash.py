"""SimHash near-duplicates: fingerprints, pigeonhole blocks, verified links, components.

Blocks: 64 bits in five parts; fingerprints that differ in two bits at most agree in three parts
or more, so each fingerprint gives one key for every three of the five parts (38 or 39 bits) and
close ones share a block.

Verification: the fingerprints of a block are joined with each other and the pairs' Hamming distances
checked. A block of more than :data:`CROWD` distinct fingerprints isn't paired: there, each fingerprint is sent to the
65 values within one bit of it. Two values differ in two bits or fewer exactly if they meet in one of those, so every
meeting is a proof, and a meeting place holds 65 fingerprints at most.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terrafold.llm import jaccard
from terrafold.llm.common import free_name, split_by_key, stored
from terrafold.operators.components import connected

SHINGLE, SEED, MAX_BITS = 3, 42, 2
#: First bit and width of each part.
PARTS = ((0, 13), (13, 13), (26, 13), (39, 13), (52, 12))
#: Shingles that are summed at a time; bounds memory for very long texts.
STEP = 1 << 15
#: Fingerprints that one in so many rows has, or more, are handled apart.
HOT = 1000
#: Distinct fingerprints of a block that are paired; the pairs are 32 a fingerprint and block at most.
CROWD = 64
_UPPER = bytes(range(256)).lower()


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """The unsigned 64-bit fingerprint; null and texts without words: 0."""
    if not text:
        return 0
    words = text.encode("utf-8", "surrogatepass").translate(_UPPER).split()
    if not words:
        return 0
    if len(words) < shingle:
        return xxhash.xxh64_intdigest(b" ".join(words), SEED)
    digest, join = xxhash.xxh64_intdigest, b" ".join
    n = len(words) - shingle + 1
    ones = np.zeros(64, np.int64)
    for at in range(0, n, STEP):
        part = words[at : min(at + STEP, n) + shingle - 1]
        rows = zip(*(part[i:] for i in range(shingle)))
        h = np.array([digest(join(x), SEED) for x in rows], np.uint64)
        bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > n, bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), shingle: int = SHINGLE) -> DataFrame:
    """``keep`` columns and ``fp``, the fingerprint as a signed long, a row for each row of ``docs``.

    Null and empty texts have 0; repeated rows come back repeated; other columns are never read; an empty table gives an empty result.
    """
    src = docs.select(*(F.col(f"`{c}`").alias(f"k_{i}") for i, c in enumerate(keep)), F.col(f"`{text}`").alias("t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.array([fingerprint(t.as_py(), shingle) for t in b.column(b.num_columns - 1)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(fps, pa.int64())], names=[*b.schema.names[:-1], "fp"])

    schema = ", ".join([f"k_{i} {t}" for i, (_, t) in enumerate(src.dtypes[:-1])] + ["fp long"])
    out = src.mapInArrow(run, schema)
    return out.select(*(F.col(f"k_{i}").alias(c) for i, c in enumerate(keep)), "fp")


def _block_keys(fp: Column) -> Column:
    out = []
    for k, chosen in enumerate(combinations(PARTS, 3)):
        mask = sum(((1 << w) - 1) << at for at, w in chosen)
        mask -= (mask >> 63) << 64
        out.append(F.struct(F.lit(k).cast("byte").alias("k"), fp.bitwiseAND(F.lit(mask)).alias("v")))
    return F.array(*out)


def _ball(fp: Column) -> Column:
    flips = [(1 << i) - ((i == 63) << 64) for i in range(64)]
    return F.array(fp, *(fp.bitwiseXOR(F.lit(x)) for x in flips))


def links(fps: DataFrame) -> DataFrame:
    """Verified links (a, b), a < b, between distinct fingerprints ``fp``: connected exactly as those within two bits are."""
    keyed = fps.select("fp").distinct().select("fp", F.explode(_block_keys(F.col("fp"))).alias("key"))
    shared = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    met = stored(keyed.join(shared, "key"), "blocks")
    one = met.filter(F.col("n") <= CROWD)
    a, b = one.select("key", F.col("fp").alias("a")), one.select("key", F.col("fp").alias("b"))
    pairs = a.join(b, "key").filter("a < b").select("a", "b")
    near = met.filter(F.col("n") > CROWD).select("fp").distinct()
    places = near.select("fp", F.explode(_ball(F.col("fp"))).alias("m")).groupBy("m").agg(F.collect_set("fp").alias("fps"))
    crowded = places.filter(F.size("fps") > 1).select(F.array_min("fps").alias("a"), F.explode("fps").alias("b")).filter("a < b")
    return pairs.union(crowded).filter(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= MAX_BITS).distinct()


def _grouped(fps: DataFrame) -> DataFrame:
    """fp, component (a fingerprint) for every distinct fingerprint of a stored table."""
    comp = connected(stored(links(fps), "links"))
    return fps.select("fp").distinct().join(comp.select(F.col("node").alias("fp"), "component"), "fp", "left").select("fp", F.coalesce("component", "fp").alias("component"))


def near_duplicates(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", shingle: int = SHINGLE) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id, one row for each row of ``docs``.

    component_id is the smallest doc_id reachable over links of two bits or fewer. Null and empty
    texts have fingerprint 0 and link like any other. Rows whose doc_id is null take part and get the
    smallest non-null doc_id of their component (null if it has none). Repeated rows come back
    repeated; other columns are never read; an empty table gives an empty result.
    """
    fps = stored(fingerprints(docs, text, (doc_id,), shingle).toDF("doc_id", "fp"), "simhash")
    own = fps.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("copies"))
    named = stored(own.join(_grouped(fps), "fp"), "named")
    # most components are one fingerprint; only the others need a second aggregate
    firsts = named.groupBy("component").agg(F.min("first").alias("component_id"))
    full = stored(named.join(firsts, "component").select("fp", "component_id", "copies"), "components")
    # fingerprints of over a thousandth of all rows: a thousand at most, so they are broadcast, and no hot key is shuffled
    often = F.col("copies") > F.lit(fps.count() / HOT)
    hot = F.broadcast(full.filter(often).select("fp", F.col("component_id").alias("hot_id"), F.lit(True).alias("is_hot")))
    marked = fps.join(hot, "fp", "left")
    rest = marked.filter("is_hot IS NULL").select("doc_id", "fp").join(full.filter(~often).select("fp", "component_id"), "fp")
    out = rest.unionByName(marked.filter("is_hot").select("doc_id", "fp", F.col("hot_id").alias("component_id")))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def survivors(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", words: int = jaccard.WORDS) -> DataFrame:
    """``docs`` with one row of each component: the one with the smallest doc_id (null ids last; ties by a hash of the row).

    Texts are linked if their sets of five-word shingles have a Jaccard similarity of 0.8 or more. Candidates are pairs of
    fingerprints that :func:`links` finds, and what no fingerprint of 64 bits can promise to find comes an exact way; all of them
    are compared as whole sets (:mod:`terrafold.llm.jaccard`). The three words above are those of the query op4 alone.
    Null and empty texts are copies of each other; an empty table gives an empty result.
    """
    key = free_name(docs, "row_key")
    src = docs.withColumn(key, F.struct(F.col(f"`{doc_id}`").isNull().alias("none"), F.col(f"`{doc_id}`").alias("id"), F.xxhash64(*(F.col(f"`{c}`") for c in docs.columns)).alias("h")))
    rows, comp = jaccard.components(src.select(F.col(key).alias("k"), F.col(f"`{text}`").alias("t")), words, links)
    # what goes: all keys of a component but its first, and repeated rows of one key but one
    own = rows.groupBy("k").agg(F.any_value("sid").alias("sid"), F.count(F.lit(1)).alias("times"))
    named = own.join(comp, "sid", "left").withColumn("component", F.coalesce("component", "sid"))
    # joined by row, not by component: a component may hold a third of the corpus
    firsts = named.groupBy("component").agg(F.min("k").alias("k")).select("k", F.lit(True).alias("stays"))
    odd = own.select("k", "times").join(firsts, "k", "left").filter("stays IS NULL OR times > 1")
    odd = stored(odd.select(F.col("k").alias(key), F.coalesce("stays", F.lit(False)).alias("stays")), "dropped")
    plain, rest = split_by_key(src, odd, key)
    nth, stays = free_name(docs, "row_nth"), free_name(docs, "stays")
    joined = rest.join(odd.withColumnRenamed("stays", stays), key, "left").filter(F.coalesce(stays, F.lit(True)))
    # of the rest only repeated rows are numbered
    once = joined.filter(F.col(stays).isNull())
    many = joined.filter(F.col(stays)).withColumn(nth, F.row_number().over(Window.partitionBy(key).orderBy(F.lit(0)))).filter(F.col(nth) == 1)
    names = [F.col(f"`{c}`") for c in docs.columns]
    return plain.select(*names).unionByName(once.select(*names)).unionByName(many.select(*names))
