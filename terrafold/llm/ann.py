"""Approximate nearest neighbours by a forest of hash-string prefixes.

Every tree gives each vector a string of eight symbols (64 bits): the index of the largest coordinate after a
random rotation, with its sign; vectors near each other on the sphere often agree. The later symbols, which only tell rows of
crowded places apart, rotate into fewer coordinates. The rows are indexed where they lie, in segments of a bounded number of rows, each with a sorted array of strings for every tree;
nothing is shuffled but results, and equal vectors, however many, spread over segments like any others.

Descent: a query goes down each tree with its own string and with those of the next best cells, and
finds how many strings of the segment share a prefix of each length with one of them.
Ascent: all trees go up together, a symbol at a time, until strings of enough distinct ids besides the query's own share
a prefix of that length; every one of those is then a candidate, without a cap. A segment with too few at any
length gives all its rows. Candidates get exact distances, and the best of all segments are merged.

Queries are served in blocks of bounded size, each broadcast to all segments.
"""

from __future__ import annotations

from collections.abc import Collection, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terrafold.llm.common import stored

TREES, SYMBOLS, PROBES, SEED = 64, 8, 24, 7
#: Coordinates of a rotation at most, by symbol; the last holds for all later ones.
WIDTHS = (128, 128, 128, 16)
#: Distinct ids besides the query's own at which the ascent ends; rows of a segment; queries of a block.
ENOUGH, SEGMENT, BLOCK = 256, 8192, 4096
#: Best coordinates of each of the first two symbols whose pairs are probed, and distances computed at a time.
NEXT, STEP = 8, 200_000
#: Queries and matches that are looked at together.
ROWS, MATCHES = 256, 4_000_000
#: Rows that are rotated together.
TURNED = 1024
BITS = 8


def rotations(dim: int, trees: int = TREES, symbols: int = SYMBOLS, seed: int = SEED) -> list[np.ndarray]:
    """Random directions, (dim, trees, width) for each symbol; the seed alone decides them."""
    rng = np.random.default_rng(seed)
    return [rng.standard_normal((dim, trees, min(dim, WIDTHS[min(s, len(WIDTHS) - 1)])), dtype=np.float32) for s in range(symbols)]


def _unit(v: np.ndarray) -> np.ndarray:
    v = v / np.abs(v).max(axis=1, keepdims=True)
    return (v / np.linalg.norm(v, axis=1, keepdims=True)).astype(np.float32)


def _turned(unit: np.ndarray, r: np.ndarray) -> np.ndarray:
    """(rows, trees, width): the rows' coordinates after the rotations of one symbol."""
    return (unit @ r.reshape(len(r), -1)).reshape(len(unit), *r.shape[1:])


def strings(v: np.ndarray, rot: list[np.ndarray]) -> np.ndarray:
    """(rows, trees) hash strings: a byte for each symbol, the first in the highest."""
    out, unit = np.zeros((len(v), rot[0].shape[1]), np.uint64), _unit(v)
    for lo in range(0, len(v), TURNED):
        for r in rot:
            x = _turned(unit[lo : lo + TURNED], r)
            at = np.abs(x).argmax(axis=2)
            minus = np.take_along_axis(x, at[:, :, None], axis=2)[:, :, 0] < 0
            out[lo : lo + TURNED] = out[lo : lo + TURNED] << np.uint64(BITS) | (2 * at + minus).astype(np.uint64)
    return out


def probes(v: np.ndarray, rot: list[np.ndarray], count: int = PROBES) -> np.ndarray:
    """(rows, trees, count) strings: the own one first, then those whose first two symbols fit next best."""
    own, unit = strings(v, rot), _unit(v)
    if len(rot) < 2 or count <= 1:
        return own[:, :, None]
    low = np.uint64(BITS * (len(rot) - 2))
    rest = own & ((np.uint64(1) << low) - np.uint64(1))
    parts = []
    for lo in range(0, len(v), TURNED):
        pick = []
        for r in rot[:2]:
            x = _turned(unit[lo : lo + TURNED], r)
            best = np.argsort(-np.abs(x), axis=2, kind="stable")[:, :, :NEXT]
            signed = np.take_along_axis(x, best, axis=2)
            size = np.abs(signed)
            pick.append(((2 * best + (signed < 0)).astype(np.uint64), (size[:, :, :1] - size) ** 2))
        n, trees = size.shape[:2]
        cost = (pick[0][1][:, :, :, None] + pick[1][1][:, :, None, :]).reshape(n, trees, -1)
        both = (pick[0][0][:, :, :, None] << np.uint64(BITS) | pick[1][0][:, :, None, :]).reshape(n, trees, -1)
        order = np.argsort(cost, axis=2, kind="stable")[:, :, :count]
        parts.append(np.take_along_axis(both, order, axis=2) << low)
    return np.concatenate(parts) | rest[:, :, None]


class Forest:
    """The trees of one segment."""

    def __init__(self, ids: np.ndarray, v: np.ndarray, rot: list[np.ndarray]) -> None:
        self.ids, self.v, self.symbols = ids, v, len(rot)
        self.distinct, self.id_at = np.unique(ids, return_inverse=True)
        self.id_count = len(self.distinct)
        codes = strings(v, rot)
        self.order = np.argsort(codes, axis=0, kind="stable")
        self.codes = np.take_along_axis(codes, self.order, axis=0)

    def ranges(self, asked: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
        """First and last + 1 places of the strings that share ``depth`` symbols with each of (queries, trees, probes).

        Probes that agree to that length count once.
        """
        keep = np.uint64(BITS * (self.symbols - depth))
        prefix = np.sort(asked >> keep, axis=2)
        lo = np.empty(prefix.shape, np.int64)
        hi = np.empty(prefix.shape, np.int64)
        for t in range(prefix.shape[1]):
            own = self.codes[:, t] >> keep
            lo[:, t] = np.searchsorted(own, prefix[:, t], "left")
            hi[:, t] = np.searchsorted(own, prefix[:, t], "right")
        again = np.zeros(prefix.shape, bool)
        again[:, :, 1:] = prefix[:, :, 1:] == prefix[:, :, :-1]
        hi[again] = lo[again]
        return lo, hi

    def candidates(self, q_ids: np.ndarray, asked: np.ndarray, enough: int) -> tuple[np.ndarray, np.ndarray]:
        """(query, row) pairs, each once; each query has ``enough`` ids besides its own, or all rows."""
        todo, out = np.arange(len(asked)), []
        for depth in range(self.symbols, 0, -1):
            if not len(todo):
                break
            lo, hi = self.ranges(asked[todo], depth)
            total = (hi - lo).sum(axis=(1, 2))
            done = np.zeros(len(todo), bool)
            maybe = np.flatnonzero(total >= enough)
            for part in np.array_split(maybe, max(1, -(-len(maybe) // ROWS), -(-int(total[maybe].sum()) // MATCHES))):
                q, t, p = np.nonzero((hi - lo)[part])
                first, size = lo[part][q, t, p], (hi - lo)[part][q, t, p]
                at = np.repeat(first - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum()) if len(size) else np.empty(0, np.int64)
                seen = np.zeros((len(part), len(self.ids)), bool)
                seen[np.repeat(q, size), self.order[at, np.repeat(t, size)]] = True
                ask, row = np.nonzero(seen)
                # an id that comes twice counts once, and the query's own not at all
                once = np.zeros((len(part), self.id_count), bool)
                once[ask, self.id_at[row]] = True
                own = np.minimum(np.searchsorted(self.distinct, q_ids[todo[part]]), self.id_count - 1)
                once[np.arange(len(part)), own] &= self.distinct[own] != q_ids[todo[part]]
                full = once.sum(axis=1) >= enough
                done[part] = full
                out.append(todo[part][ask[full[ask]]] * len(self.ids) + row[full[ask]])
            todo = todo[~done]
        out.append((todo[:, None] * len(self.ids) + np.arange(len(self.ids))[None]).ravel())
        pairs = np.concatenate(out)
        return pairs // len(self.ids), pairs % len(self.ids)

    def nearest(self, q_ids: np.ndarray, q: np.ndarray, asked: np.ndarray, k: int, enough: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """query ids, row ids and distances of the k nearest candidates of each query but itself."""
        qi, ri = self.candidates(q_ids, asked, max(k, enough))
        other = q_ids[qi] != self.ids[ri]
        qi, ri = qi[other], ri[other]
        d = np.concatenate([np.sqrt(((q[qi[i : i + STEP]] - self.v[ri[i : i + STEP]]) ** 2).sum(axis=1)) for i in range(0, len(qi), STEP)] or [np.empty(0)])
        order = np.lexsort((self.ids[ri], d, qi))
        qi, ri, d = qi[order], ri[order], d[order]
        # an id that comes twice counts once, by its nearer vector
        key = np.stack([qi, self.ids[ri]], axis=1)
        once = np.sort(np.unique(key, axis=0, return_index=True)[1])
        qi, ri, d = qi[once], ri[once], d[once]
        nth = np.arange(len(qi)) - np.searchsorted(qi, qi, "left")
        top = nth < k
        return q_ids[qi[top]], self.ids[ri[top]], d[top]


def valid_vectors(rows: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """vec_id and v (array of double) of rows that take part.

    Out are null ids, null, empty and zero vectors, and vectors with null or non-finite components.
    """
    src = rows.select(rows[vec_id].cast("long").alias("vec_id"), rows[embedding].cast("array<double>").alias("v")).filter(F.col("vec_id").isNotNull() & (F.size("v") > 0))
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    return src.filter(F.coalesce(fine, F.lit(False)))


def neighbours(
    rows: DataFrame, is_query: Column, k: int = 10, vec_id: str = "vec_id", embedding: str = "embedding",
    trees: int = TREES, symbols: int = SYMBOLS, count: int = PROBES, seed: int = SEED, enough: int = ENOUGH,
) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k nearest found of each query, without itself.

    ``is_query`` is a condition on ``vec_id``. score is the Euclidean distance of the original vectors
    in doubles; ties go to the smaller id. Vectors of one length are a space of their own: none is dropped for its length, and
    only vectors of one length are compared. An id that comes twice in a space counts once, by its nearer vector (as a query: by
    the smaller vector). See :func:`valid_vectors` for the rows that take part. An empty table gives an empty result.
    """
    spark = rows.sparkSession
    vectors = valid_vectors(rows, vec_id, embedding)
    queries = vectors.filter(is_query).groupBy("vec_id", F.size("v").alias("dim")).agg(F.min("v").alias("v"))
    total = queries.count()
    schema = "query_id long, vec_id long, score double"
    found = None
    blocks = -(-total // BLOCK)
    for i in range(blocks):
        block = queries.filter(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == i).orderBy("vec_id").collect()  # about BLOCK rows
        spaces = {}
        for dim in sorted({r["dim"] for r in block}):
            own = [r for r in block if r["dim"] == dim]
            q = np.array([r["v"] for r in own], float)
            spaces[dim] = np.array([r["vec_id"] for r in own], np.int64), q, probes(q, rotations(dim, trees, symbols, seed), count)
        if not spaces:
            continue
        shared = spark.sparkContext.broadcast(spaces)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:  # noqa: ANN001
            rot = {}
            for dim, ids, v in _segments(batches, shared.value):
                if dim not in rot:
                    rot = {dim: rotations(dim, trees, symbols, seed)}
                a, b, d = Forest(ids, v, rot[dim]).nearest(*shared.value[dim], k, enough)
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(d)], names=["query_id", "vec_id", "score"])

        part = vectors.mapInArrow(run, schema)
        if blocks > 1:
            part = stored(part, "ann")
        found = part if found is None else found.unionByName(part)
    if found is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    best = found.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    near = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return best.withColumn("rank", F.row_number().over(near)).filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def _segments(batches: Iterator[pa.RecordBatch], dims: Collection[int]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(dim, ids, vectors) of SEGMENT rows at most, from the batches of a partition; lengths that aren't in ``dims`` are passed over."""
    held: dict[int, tuple[list[np.ndarray], list[np.ndarray]]] = {}

    def joined(dim: int) -> tuple[int, np.ndarray, np.ndarray]:
        ids, vs = held.pop(dim)
        return dim, np.concatenate(ids), np.concatenate(vs)

    for b in batches:
        sizes = pc.list_value_length(b.column(1)).to_numpy(zero_copy_only=False)
        for dim in sorted({*sizes.tolist()} & {*dims}):
            own = b.filter(pa.array(sizes == dim))
            at = 0
            while at < own.num_rows:
                ids, vs = held.setdefault(dim, ([], []))
                piece = own.slice(at, SEGMENT - sum(map(len, ids)))
                at += piece.num_rows
                ids.append(piece.column(0).to_numpy())
                vs.append(piece.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, dim))
                if sum(map(len, ids)) == SEGMENT:
                    yield joined(dim)
    for dim in sorted(held):
        yield joined(dim)
