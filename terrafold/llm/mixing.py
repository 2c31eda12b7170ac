"""Mixing sources to target weights by Pfair scheduling.

A source of weight w owes its j-th block (j from 0) a slot in the window [floor(j / w), ceil((j + 1) / w)).
Serving, in each slot, the released block with the earliest deadline keeps every source within
less than one block of w * t at every time t. The weights are exact fractions and the schedule runs over
the whole stream, so nothing is rounded and nothing adds up. It has one row for each block, which one task writes
as it goes, with a block of each source in memory; the documents are joined with it by source and block.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from fractions import Fraction

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrafold.llm.common import exact_rank, free_name, shuffle_width, stored

#: Slots that are written at a time (of a schedule of its own: slots of one period), and documents in a block at least.
PERIOD, BLOCK = 1000, 8
#: Blocks are made longer where a table would have more of them than this, as one task writes the schedule: it bounds that
#: task, and the deviation stays below one block. Sources at most; the schedule has a block of each in memory.
MAX_BLOCKS, MAX_SOURCES = 8_000_000, 100_000
#: Target weights, if none are given: sizes of sources to this power, in proportion.
TEMPERATURE = 0.8


def shares(weights: dict[str | None, float], period: int = PERIOD) -> dict[str | None, int]:
    """Slots of each source in one period: largest remainders, at least one slot for a positive weight."""
    live = {s: w for s, w in weights.items() if w > 0}
    if not live:
        return {}
    period = max(period, 4 * len(live))
    total = sum(live.values())
    exact = {s: w / total * period for s, w in live.items()}
    out = {s: max(1, int(x)) for s, x in exact.items()}
    order = sorted(live, key=lambda s: (-(exact[s] - int(exact[s])), s is None, s or ""))
    spare, i = period - sum(out.values()), 0
    while spare > 0:
        out[order[i % len(order)]] += 1
        spare, i = spare - 1, i + 1
    while spare < 0:
        out[max(out, key=lambda s: (out[s], s or ""))] -= 1
        spare += 1
    return out


def schedule(slots: dict[str | None, int]) -> list[str | None]:
    """The source served in each slot of one period: earliest deadline first among released blocks."""
    period = sum(slots.values())
    window = lambda s, j: (j * period // slots[s], -(-(j + 1) * period // slots[s]))
    waiting = [(window(s, 0)[0], s is None, s or "", 0) for s in slots]
    heapq.heapify(waiting)
    ready: list[tuple[int, bool, str, int]] = []
    out: list[str | None] = []
    for t in range(period):
        while waiting and waiting[0][0] <= t:
            _, none, name, j = heapq.heappop(waiting)
            s = None if none else name
            heapq.heappush(ready, (window(s, j)[1], none, name, j))
        deadline, none, name, j = heapq.heappop(ready)
        s = None if none else name
        if deadline <= t:
            raise AssertionError("a block missed its deadline")
        out.append(s)
        if j + 1 < slots[s]:
            heapq.heappush(waiting, (window(s, j + 1)[0], none, name, j + 1))
    return out


def whole_weights(weights: list[float]) -> list[int]:
    """Integers in exactly the proportion of ``weights``."""
    exact = [Fraction(w) for w in weights]
    scale = max((w.denominator for w in exact), default=1)  # powers of two
    return [int(w * scale) for w in exact]


def stream(weights: list[int], need: list[int]) -> Iterator[tuple[int, int, int]]:
    """(source, block, slot) by earliest deadline among released blocks, until each source has had ``need`` blocks."""
    total, short, t = sum(weights), sum(n > 0 for n in need), 0
    waiting = [(0, i, 0) for i in range(len(weights))]
    ready: list[tuple[int, int, int]] = []
    while short:
        while waiting and waiting[0][0] <= t:
            _, i, j = heapq.heappop(waiting)
            heapq.heappush(ready, (-(-(j + 1) * total // weights[i]), i, j))
        deadline, i, j = heapq.heappop(ready)
        if deadline <= t:
            raise AssertionError("a block missed its deadline")
        yield i, j, t
        short -= j + 1 == need[i]
        heapq.heappush(waiting, ((j + 1) * total // weights[i], i, j + 1))
        t += 1


def _plan(spark: SparkSession, weights: list[int], need: list[int], rows: int) -> DataFrame:
    """i_, j_, t_: the stream's blocks as a stored table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _ in batches:
            held = []
            for x in stream(weights, need):
                held.append(x)
                if len(held) == rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*held)], names=["i_", "j_", "t_"])
                    held = []
            if held:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*held)], names=["i_", "j_", "t_"])

    return stored(spark.range(0, 1, 1, 1).mapInArrow(run, "i_ long, j_ long, t_ long"), "mix")


def lag(order: list[str | None], slots: dict[str | None, int]) -> Fraction:
    """The largest deviation, in blocks, of any source from its weight over all times of a period."""
    period, worst, served = len(order), Fraction(0), dict.fromkeys(slots, 0)
    for t, s in enumerate(order, 1):
        served[s] += 1
        worst = max(worst, *(abs(Fraction(k * t, period) - served[x]) for x, k in slots.items()))
    return worst


def _sizes(docs: DataFrame, source: str) -> dict[str | None, int]:
    """Documents of each source; the driver holds a number for each source, :data:`MAX_SOURCES` at most, none for each document."""
    rows = docs.groupBy(F.col(f"`{source}`").alias("s")).agg(F.count(F.lit(1)).alias("n")).limit(MAX_SOURCES + 1).collect()
    if len(rows) > MAX_SOURCES:
        raise ValueError(f"over {MAX_SOURCES} sources: give a column that names sources, not single documents")
    return {r[0]: r[1] for r in rows}


def tempered(sizes: dict[str | None, int], power: float = TEMPERATURE) -> dict[str | None, float]:
    raw = {s: n**power for s, n in sizes.items() if n}
    total = sum(raw.values()) or 1.0
    return {s: x / total for s, x in raw.items()}


def mixed(docs: DataFrame, weights: dict[str | None, float] | None = None, source: str = "source", doc_id: str = "doc_id", block: int | None = None, period: int = PERIOD, repeat: bool = True) -> DataFrame:
    """``docs`` with ``mix_position`` (its place in the mixed stream), ``mix_slot``, ``mix_epoch`` and ``mix_target`` (the weight as a share).

    Documents of a source follow a hash of their id; ``block`` of them fill one slot (:data:`BLOCK`, or as many as keep a table
    within :data:`MAX_BLOCKS`). Every row comes at least once. With ``repeat``, the stream lasts until the source that is longest for its weight
    has been used up, and shorter sources start over (``mix_epoch`` counts from 0), so all shares hold
    to the end; without it each row comes once, and a source that has run dry leaves its slots empty.
    A source without a positive weight is put after the stream, in no proportion, once.
    Null is a source of its own. Rows with null ids follow a hash of all their columns, and so do ties of the id's hash; rows
    that are equal in all columns are interchangeable. (Maps have no hash; they are left out of it.) An empty table gives an empty result. Columns of ``docs`` that have
    the name of an added one are replaced.
    """
    docs = docs.drop("mix_position", "mix_slot", "mix_epoch", "mix_target")
    names = docs.columns
    inner = [f"in_{i}" for i in range(len(names))]
    out = _mixed(docs.toDF(*inner), weights, inner[names.index(source)], inner[names.index(doc_id)], block, period, repeat)
    return out.toDF(*names, *out.columns[len(names) :])


def _mixed(docs: DataFrame, weights: dict[str | None, float] | None, source: str, doc_id: str, block: int | None, period: int, repeat: bool) -> DataFrame:
    spark = docs.sparkSession
    sizes = _sizes(docs, source)
    block = block or max(BLOCK, -(-sum(sizes.values()) // MAX_BLOCKS))
    weights = weights if weights is not None else tempered(sizes)
    live = sorted((s for s, w in weights.items() if w > 0 and sizes.get(s)), key=lambda s: (s is None, s or ""))
    names = docs.columns
    rank, key, tie = (free_name(docs, f"mix_{x}") for x in ("rank", "key", "tie"))
    if not sizes:
        return docs.select("*", *(F.lit(None).cast(t).alias(c) for c, t in (("mix_position", "long"), ("mix_slot", "long"), ("mix_epoch", "long"), ("mix_target", "double"))))
    # blocks until the last source is used up
    need = [-(-sizes[s] // block) for s in live]
    whole = whole_weights([weights[s] for s in live])
    plan = _plan(spark, whole, need, period)
    served = {r["i_"]: (r["n"], r["t"]) for r in plan.groupBy("i_").agg(F.count(F.lit(1)).alias("n"), F.max("t_").alias("t")).collect()}
    end = max((t + 1 for _, t in served.values()), default=0)
    # a row for each source; those without a weight follow the stream one after the other
    rows = [(s, i, sizes[s], served[i][0] if repeat else need[i], float(Fraction(whole[i], sum(whole))), 0) for i, s in enumerate(live)]
    at = end * block
    for s in sorted((s for s in sizes if s not in live), key=lambda s: (s is None, s or "")):
        rows.append((s, None, 1, 0, 0.0, at))
        at += sizes[s]
    head = spark.createDataFrame(rows, "s string, i long, n long, owed long, share double, at long")

    hashed = F.xxhash64(*(F.col(f"`{c}`") for c, kind in docs.dtypes if "map<" not in kind))
    own = F.col(f"`{doc_id}`")
    mark = docs.withColumn(tie, hashed).withColumn(key, F.when(own.isNull(), F.col(tie)).otherwise(F.xxhash64(own)))

    def slots(buckets: DataFrame) -> DataFrame:
        """``buckets`` (group, bucket, n, base) with their source's row and, in ``plan``, the slots of their blocks by epoch."""
        at_ = buckets.join(F.broadcast(head), F.col("rank_group.g0").eqNullSafe(head["s"]), "left").drop("s")
        most = F.greatest(F.lit(1), F.ceil(F.col("owed") * block / F.col("n"))) if repeat else F.lit(1)
        each = at_.filter("i IS NOT NULL").withColumn("e", F.explode(F.sequence(F.lit(0).cast("long"), most.cast("long") - 1)))
        first = F.col("e") * F.col("n") + F.col("rank_base")
        each = each.withColumn("j0", F.floor(first / block)).withColumn("j", F.explode(F.sequence(F.floor(first / block), F.floor((first + F.col("rank_n") - 1) / block))))
        found = each.join(plan, (F.col("i") == F.col("i_")) & (F.col("j") == F.col("j_")))
        lists = found.groupBy("rank_group", "rank_bucket", "e", "j0").agg(F.transform(F.sort_array(F.collect_list(F.struct("j", "t_"))), lambda x: x["t_"]).alias("t"))
        whole_ = lists.groupBy("rank_group", "rank_bucket").agg(F.collect_list(F.struct("e", "j0", "t")).alias("plan"))
        return at_.join(whole_, ["rank_group", "rank_bucket"], "left")

    a = exact_rank(mark, [source], F.col(key), rank, sum(sizes.values()), [own, F.col(tie)], buckets=slots)
    a = a.withColumn("x_", F.explode_outer("plan")).drop("plan")
    nth = F.col("x_.e") * F.col("n") + F.col(rank)
    # every row once, and again while its source is owed blocks
    a = a.filter(F.col("i").isNull() | (F.col("x_.e") == 0) | (nth < F.col("owed") * block))
    slot = F.get("x_.t", (F.floor(nth / block) - F.col("x_.j0")).cast("int"))
    place_ = F.when(F.col("i").isNotNull(), slot * block + nth % block).otherwise(F.col("at") + F.col(rank))
    a = a.withColumn("mix_position", place_.cast("long"))
    return a.select(
        *(F.col(f"`{c}`") for c in names),
        "mix_position",
        F.floor(F.col("mix_position") / block).cast("long").alias("mix_slot"),
        F.coalesce("x_.e", F.lit(0)).cast("long").alias("mix_epoch"),
        F.col("share").alias("mix_target"),
    )


def mixed_table(docs: DataFrame, **options) -> DataFrame:  # noqa: ANN003
    """``docs`` as the mixed stream: its columns only, repeated as the target asks, laid out in stream order."""
    names = docs.columns
    out = mixed(docs, **options)
    names = [c for c in names if c in out.columns]
    ordered = out.repartitionByRange(shuffle_width(docs.sparkSession), "mix_position").sortWithinPartitions("mix_position")
    return ordered.select(*(F.col(f"`{c}`") for c in names))


__all__ = ["lag", "mixed", "mixed_table", "schedule", "shares", "stream", "tempered", "whole_weights"]
