"""Texts whose sets of word shingles have a Jaccard similarity of a threshold or more: every such pair is found or implied.

Candidates come two ways. Pairs of SimHash fingerprints of the sets that share pigeonhole blocks and differ in two bits at most
(:func:`terrafold.llm.simhash.links`) are most of the close copies. No number of bits that blocks can serve reaches down to a
similarity of 0.8 (such pairs differ in 10 of 64 bits on average), so an exact way finds the rest: put in any
one order, two sets of similarity 4/5 or more share a member among the first n - ceil(4n/5) + 1 of
each. The order starts with members that a sample of the texts doesn't show to be common, so common lines and passages are
rarely among them. The sample decides the order alone, never the result.

Links: among the texts that share a first member, the smallest and the largest are its ends; a text is compared with the two ends
that it shares most members with, and so are the pairs by fingerprints; components are built from what is found. Only where a
shared member still joins several components are pairs listed, between texts outside its main component and the others, so a large
group of near copies is never expanded. A pair is listed only where both have the member early enough for their two sizes: similar
sets of n and m members share a = ceil(4/9 (n + m)), and then one of the first n - a + 1 and m - a + 1.

A member that over :data:`CROWD` texts share isn't paired. Its texts are described by their differences D from a center, the members
that over half of a sample of them have. Sets of n and m members are similar exactly if their D differ in (n + m) / 9 members at most,
that is with s = 9 |D| - n, if their D share (s + s') / 18. Where s + s' <= 0 both are similar to the text with the least s, to
which alone they are linked; all others share one of the first |D| - (s + s') / 18 + 1 of each D, rarest members first. These
are the edits of a near copy, not what its family has in common.

Before whole sets are compared, pairs go whose sizes can't fit, and those that share too few first members: with c shared
ones, the whole sets share c + ceil(4/5 max(n, m)) - 1 at most. All comparisons are exact, on whole sets.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terrafold.llm.common import drop_stored, split_by_key, stored
from terrafold.operators.components import connected

WORDS, SEED = 5, 42
#: The least similarity, as a fraction.
NUM, DEN = 4, 5
#: The sample has one text in SHARE; a common member is in so many of them, and those are so many at most (8 bytes each).
SHARE, COMMON, MOST = 4, 3, 1_000_000
#: Texts of a member that are paired, and texts that a center is drawn from.
CROWD, DRAWN = 64, 32
#: Words whose hashes are kept; texts and members that are looked at together.
CACHE, ROWS, STEP = 50_000, 500, 1 << 15
_LOWER = bytes(range(256)).lower()


class Shingles:
    """Sorted distinct 64-bit hashes of the runs of ``words`` words; shorter texts are one run, texts without words none."""

    def __init__(self, words: int = WORDS) -> None:
        self.words, self.seen = words, {}

    def __call__(self, text: str | None) -> np.ndarray:
        split = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()
        if len(split) < self.words:
            return np.array([xxhash.xxh64_intdigest(b" ".join(split), SEED)] if split else [], np.uint64)
        if len(self.seen) > CACHE:
            self.seen.clear()
        seen = self.seen
        for w in set(split):
            if w not in seen:
                seen[w] = xxhash.xxh64_intdigest(w, SEED)
        h = np.array([seen[w] for w in split], np.uint64)
        n = len(h) - self.words + 1
        out = np.zeros(n, np.uint64)
        for i in range(self.words):
            out = (out ^ h[i : i + n]) * np.uint64(0x9E3779B97F4A7C15)
            out ^= out >> np.uint64(29)
        return np.unique(out)


def first_members(members: np.ndarray, common: np.ndarray) -> np.ndarray:
    """The members of which a similar set must share one."""
    n = len(members)
    late = common[np.minimum(np.searchsorted(common, members), len(common) - 1)] == members if len(common) else np.zeros(n, bool)
    return np.concatenate([members[~late], members[late]])[: n - -(-NUM * n // DEN) + 1] if n else members


def majority(members: np.ndarray) -> int:
    """The SimHash fingerprint of a set, as a signed long: the bits that over half of its members have."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(members), STEP):
        ones += np.unpackbits(members[at : at + STEP].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(members), bitorder="little").view(np.int64)[0])


def set_id(members: np.ndarray) -> int:
    """A hash of the whole set, as a signed long."""
    h = xxhash.xxh64_intdigest(members.tobytes(), SEED)
    return h - ((h >> 63) << 64)


def _lists(arrays: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *map(len, arrays)]).astype(np.int32)
    flat = np.concatenate([*arrays, np.empty(0, np.uint64)])
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat.astype(np.uint64).view(np.int64)))


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for lo in range(0, b.num_rows, ROWS):
            yield b.slice(lo, ROWS)


def _sets(texts: DataFrame, words: int) -> DataFrame:
    """sid and s, the set, of ``texts`` (t)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cut = Shingles(words)
        for b in _pieces(batches):
            sets = [cut(t.as_py()) for t in b.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array(map(set_id, sets), pa.int64()), _lists(sets)], names=["sid", "s"])

    return texts.mapInArrow(run, "sid long, s array<long>")


def _common(src: DataFrame, words: int) -> np.ndarray:
    """Members that are common in a sample; sorted."""
    some = src.filter(F.pmod(F.xxhash64("k"), F.lit(SHARE)) == 0).select("t")
    counts = _sets(some, words).select(F.explode("s").alias("m")).groupBy("m").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= COMMON)
    return np.sort(counts.orderBy(F.desc("n"), "m").limit(MOST).select("m").toPandas().m.to_numpy(np.int64).view(np.uint64))


def keyed(src: DataFrame, words: int = WORDS) -> DataFrame:
    """k, sid, fp (the fingerprint), n (the set's size) and keys (its first members) of ``src`` (k, t)."""
    shared = src.sparkSession.sparkContext.broadcast(_common(src, words))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cut, common = Shingles(words), shared.value
        for b in _pieces(batches):
            sets = [cut(t.as_py()) for t in b.column(1)]
            sid, fp, n = (pa.array([f(s) for s in sets], pa.int64()) for f in (set_id, majority, len))
            yield pa.RecordBatch.from_arrays([b.column(0), sid, fp, n, _lists([first_members(s, common) for s in sets])], names=["k", "sid", "fp", "n", "keys"])

    return src.mapInArrow(run, f"k {src.schema['k'].dataType.simpleString()}, sid long, fp long, n long, keys array<long>")


def _fits(n: Column, m: Column) -> Column:
    """Sets of these sizes can be similar."""
    return F.least(n, m) * DEN >= F.greatest(n, m) * NUM


def _reaches(c: Column, n: Column, m: Column) -> Column:
    """Sets of sizes n and m with c shared first members can be similar."""
    most = F.greatest(n, m)
    return (c + F.ceil(most * NUM / F.lit(DEN)) - 1) * (NUM + DEN) >= (n + m) * NUM


def _early(place: Column, n: Column, m: Column) -> Column:
    """A member at ``place`` (from 0) of a set of n is among those of which a similar set of m must have one."""
    return place <= n - F.ceil((n + m) * NUM / F.lit(NUM + DEN))


def _nodes(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("a").alias("sid")).union(pairs.select("b")).distinct()


def _both(pairs: DataFrame, facts: DataFrame, *columns: str) -> DataFrame:
    """``pairs`` with ``columns`` of both ends, suffixed _a and _b; an inner join."""
    for end in ("a", "b"):
        pairs = pairs.join(facts.select(F.col("sid").alias(end), *(F.col(c).alias(f"{c}_{end}") for c in columns)), end)
    return pairs


class Join:
    """The similarity join of ``src`` (k, t)."""

    def __init__(self, src: DataFrame, words: int = WORDS, links: Callable[[DataFrame], DataFrame] | None = None) -> None:
        self.src, self.words = src, words
        self.rows = stored(keyed(src, words), "shingles")
        self.sizes = stored(self.rows.groupBy("sid").agg(F.min("k").alias("k"), F.max("n").alias("n"), F.max("fp").alias("fp")), "sizes")
        self.links = links

    def by_fingerprint(self) -> DataFrame:
        """a, b: sets with equal or linked fingerprints, by the smallest set of each fingerprint."""
        least = self.sizes.groupBy("fp").agg(F.min("sid").alias("rep"))
        same = self.sizes.join(least, "fp").filter("sid <> rep").select(F.col("rep").alias("a"), F.col("sid").alias("b"))
        if self.links is None:
            return same
        ends = self.links(self.sizes.select("fp")).toDF("fa", "fb")
        near = ends.join(least.toDF("fa", "a"), "fa").join(least.toDF("fb", "b"), "fb").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        return same.union(near)

    def met(self) -> DataFrame:
        """key, sid, place, lo, hi: first members that two sets or more have, their sets with the member's place, and the ends of those."""
        flat = self.rows.select("sid", F.posexplode("keys").alias("place", "key"))
        ends = stored(flat.groupBy("key").agg(F.min("sid").alias("lo"), F.max("sid").alias("hi")).filter("lo < hi"), "ends")
        return stored(flat.join(ends, "key").distinct(), "met")

    def stars(self, met: DataFrame) -> DataFrame:
        """a, b: each set with the smallest and with the largest end that it shares most members with."""
        out = None
        for end in ("lo", "hi"):
            shared = met.filter(F.col(end) != F.col("sid")).groupBy("sid", F.col(end).alias("o")).agg(F.count(F.lit(1)).alias("c"))
            best = shared.groupBy("sid").agg(F.max_by("o", F.struct("c", "o")).alias("o"))
            pairs = best.select(F.least("sid", "o").alias("a"), F.greatest("sid", "o").alias("b"))
            out = pairs if out is None else out.union(pairs)
        return out

    def promising(self, pairs: DataFrame) -> DataFrame:
        """Those of ``pairs`` whose sizes and shared first members allow the similarity."""
        fit = stored(_both(pairs, self.sizes, "n").filter(_fits(F.col("n_a"), F.col("n_b"))), "fit")
        nodes = _nodes(fit)
        lists = split_by_key(self.rows.select("sid", "keys"), nodes, "sid")[1].join(nodes, "sid", "left_semi").dropDuplicates(["sid"])
        shared = _both(fit, stored(lists, "lists"), "keys").withColumn("c", F.size(F.array_intersect("keys_a", "keys_b")))
        return stored(shared.filter(_reaches(F.col("c"), F.col("n_a"), F.col("n_b"))).select("a", "b", "n_a", "n_b"), "promising")

    def whole(self, nodes: DataFrame) -> DataFrame:
        """sid, s: the whole sets of a stored table ``nodes`` (sid), stored."""
        wanted = self.sizes.join(nodes, "sid", "left_semi").select("k")
        # the texts aren't shuffled: those whose key may be wanted are cut again, and their sets are joined by what they hold
        texts = split_by_key(self.src, wanted, "k")[1].select("t")
        return stored(_sets(texts, self.words).join(nodes, "sid", "left_semi").dropDuplicates(["sid"]), "sets")

    def similar(self, pairs: DataFrame) -> DataFrame:
        """a, b of a stored table ``pairs`` (a, b, n_a, n_b) that are similar, by whole sets."""
        sets = self.whole(stored(_nodes(pairs), "nodes"))
        both = _both(pairs, sets, "s").filter(F.size(F.array_intersect("s_a", "s_b")) * (NUM + DEN) >= (F.col("n_a") + F.col("n_b")) * NUM)
        out = stored(both.select("a", "b"), "links")
        drop_stored(sets)
        return out

    def across(self, met: DataFrame, comp: DataFrame, seen: DataFrame) -> DataFrame:
        """a, b: pairs of two components that share a first member, may be similar and aren't among ``seen``."""
        member = met.select("key", "sid", "place").join(self.sizes.select("sid", "n"), "sid").join(comp, "sid", "left").withColumn("component", F.coalesce("component", "sid"))
        member = stored(member, "members")
        parts = member.groupBy("key", "component").agg(F.count(F.lit(1)).alias("c"))
        main = F.max_by("component", F.struct("c", "component")).alias("main")
        open_ = parts.groupBy("key").agg(main, F.sum("c").alias("texts"), F.count(F.lit(1)).alias("parts")).filter("parts > 1").drop("parts")
        left = stored(member.join(open_, "key"), "open")
        few = left.filter(F.col("texts") <= CROWD)
        p, q = few.filter("component <> main").alias("p"), few.alias("q")
        other = (F.col("p.component") != F.col("q.component")) & ((F.col("q.component") == F.col("q.main")) | (F.col("p.sid") < F.col("q.sid")))
        n, m = F.col("p.n"), F.col("q.n")
        close = _fits(n, m) & _early(F.col("p.place"), n, m) & _early(F.col("q.place"), m, n)
        met_ = p.join(q, (F.col("p.key") == F.col("q.key")) & other & close)
        pairs = met_.select(F.least("p.sid", "q.sid").alias("a"), F.greatest("p.sid", "q.sid").alias("b"))
        crowd = stored(left.filter(F.col("texts") > CROWD).select("sid", "n", "component", F.col("main").alias("c")).distinct(), "crowd")
        if not crowd.isEmpty():
            pairs = pairs.union(self.around(crowd))
        return stored(pairs.distinct().join(seen, ["a", "b"], "left_anti"), "across")

    def differences(self, crowd: DataFrame) -> DataFrame:
        """``crowd`` (sid, n, component, c) with d, the members that a set or the center of its c has alone; size, that of d; and s."""
        sets = self.whole(stored(crowd.select("sid").distinct(), "nodes"))
        drawn = crowd.select("c", "sid", F.row_number().over(Window.partitionBy("c").orderBy("sid")).alias("i")).filter(F.col("i") <= DRAWN)
        drawn = stored(drawn.select("c", "sid"), "drawn")
        of = drawn.groupBy("c").agg(F.count(F.lit(1)).alias("of"))
        held = drawn.join(of, "c").join(sets, "sid").select("c", "of", F.explode("s").alias("m")).groupBy("c", "m").agg(F.count(F.lit(1)).alias("v"), F.any_value("of").alias("of"))
        centers = held.filter("2 * v > of").groupBy("c").agg(F.collect_list("m").alias("center"))
        # a center has over CROWD texts, so so many copies of it are fewer rows than those, and none is a hot key
        copies = of.join(centers, "c", "left").select("c", F.coalesce("center", F.array().cast("array<long>")).alias("center"), F.explode(F.sequence(F.lit(0), F.lit(CROWD - 1))).alias("copy"))
        both = crowd.withColumn("copy", F.pmod(F.col("sid"), F.lit(CROWD)).cast("int")).join(copies, ["c", "copy"]).join(sets, "sid")
        both = both.select(*crowd.columns, F.concat(F.array_except("s", "center"), F.array_except("center", "s")).alias("d")).withColumn("size", F.size("d").cast("long"))
        out = stored(both.withColumn("s", F.col("size") * (DEN + NUM) - F.col("n") * (DEN - NUM)), "differences")
        drop_stored(sets)
        return out

    def around(self, crowd: DataFrame) -> DataFrame:
        """a, b: pairs of a stored table ``crowd`` (sid, n, component, c) with one c that may be similar: all such pairs of two components are among them or implied."""
        diffs = self.differences(crowd)
        share = 2 * (DEN + NUM)
        nearest = diffs.groupBy("c").agg(F.min(F.struct("s", "sid", "component")).alias("o"))
        nearest = stored(nearest.select("c", F.col("o.s").alias("s0"), F.col("o.sid").alias("sid0"), F.col("o.component").alias("home")), "nearest")
        # tables with a row for each center are broadcast: a CROWDth of the texts' rows at most
        placed = diffs.join(F.broadcast(nearest), "c").withColumn("free", (F.col("component") != F.col("home")) & (F.col("s") + F.col("s0") > 0))
        sure = placed.filter((F.col("component") != F.col("home")) & ~F.col("free")).select(F.least("sid", "sid0").alias("a"), F.greatest("sid", "sid0").alias("b"))
        lows = stored(placed.filter("free").groupBy("c").agg(F.min("s").alias("low")), "lows")
        placed = placed.join(F.broadcast(lows), "c")
        # the least numbers of members that a similar set's D shares: with any set (of a free one), and with any free one
        least = F.greatest(F.lit(1), F.col("size") - F.floor(F.col("n") * (DEN - NUM) / F.lit(NUM)))
        far = F.col("size") - F.greatest(least, F.ceil((F.col("s") + F.col("s0")) / F.lit(share)))
        near = F.col("size") - F.greatest(least, F.ceil((F.col("s") + F.col("low")) / F.lit(share)))
        flat = placed.select("c", "sid", "n", "component", "free", "size", "s", far.alias("far"), near.alias("near"), F.explode("d").alias("m"))
        flat = flat.withColumn("v", F.count(F.lit(1)).over(Window.partitionBy("c", "m")))
        flat = flat.withColumn("place", F.row_number().over(Window.partitionBy("c", "sid").orderBy("v", "m")) - 1)
        early = (F.col("place") <= F.col("near")) | F.col("free") & (F.col("place") <= F.col("far"))
        flat = stored(flat.filter((F.col("v") > 1) & early), "edits")
        p, q = flat.filter(F.col("free") & (F.col("place") <= F.col("far"))).alias("p"), flat.filter(F.col("place") <= F.col("near")).alias("q")
        same = (F.col("p.c") == F.col("q.c")) & (F.col("p.m") == F.col("q.m"))
        other = (F.col("p.component") != F.col("q.component")) & (~F.col("q.free") | (F.col("p.sid") < F.col("q.sid")))
        needed = F.ceil((F.col("p.s") + F.col("q.s")) / F.lit(share))
        close = _fits(F.col("p.n"), F.col("q.n")) & (F.col("p.place") + needed <= F.col("p.size")) & (F.col("q.place") + needed <= F.col("q.size"))
        return p.join(q, same & other & close).select(F.least("p.sid", "q.sid").alias("a"), F.greatest("p.sid", "q.sid").alias("b")).union(sure)


def components(src: DataFrame, words: int = WORDS, links: Callable[[DataFrame], DataFrame] | None = None) -> tuple[DataFrame, DataFrame]:
    """Rows k, sid of ``src`` (k, t), and sid, component (its smallest sid) of each sid that is linked with another.

    ``links`` finds links (a, b) between fingerprints ``fp``. Texts without words are one set; they have no members and are
    linked with no other. An empty table gives two empty ones.
    """
    join = Join(src, words, links)
    met = join.met()
    first = join.promising(join.stars(met).union(join.by_fingerprint()).distinct())
    found = join.similar(first)
    more = join.similar(join.promising(join.across(met, _named(found), first.select("a", "b"))))
    comp = _named(found if more.isEmpty() else stored(found.union(more), "links"))
    return join.rows.select("k", "sid"), comp


def _named(links: DataFrame) -> DataFrame:
    """sid, component of every linked sid of a stored table."""
    return stored(connected(links, keep=True).select(F.col("node").alias("sid"), "component"), "components")
