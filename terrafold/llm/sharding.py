"""Shards by balanced label propagation over copies of texts.

Documents with equal texts are linked. They start on the shard that a hash of their id names; in each
round a document looks at the shards of those it is linked with and asks to move to the one that
most of them are on (a group larger than a shard for several). A shard grants moves, largest group first, while it has room
or others leave it, so no quota is ever exceeded and full shards swap; rounds end when no move is granted. Documents without links are ballast: they fill what is left, and all shards end
with row counts that differ by one at most, however large a group is.

All documents of a group are neighbours of each other, and equal documents of a group on one shard are interchangeable. So what a
join of every document with its neighbours' shards would count, a round has in (group, shard, count) rows that are brought
together by group: 40 at most for a group, even one that holds a third of the corpus. :func:`cut` measures the links that remain cut. What the driver
sees in a round is a sum for each shard and level of demand.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terrafold.llm.common import drop_stored, exact_rank, stored

SHARDS, LAW = 40, "rows"


def _granted(demand: list[tuple[int, int, int, int]], room: dict[int, int], swap: bool = True) -> dict[tuple[int, int], int]:
    """Moves granted from shard to target, of ``demand`` (shard, target, level, rows); no shard ends with more than its room.

    All moves are granted at first, so a shard has the room that its departures free, and full shards swap. A shard with too
    many arrivals then refuses some, low levels first; what stays where it was can fill other shards, so that is repeated.
    Without ``swap`` departures don't count.
    """
    ids = sorted(room)
    at, levels = {s: i for i, s in enumerate(ids)}, sorted({d[2] for d in demand})
    flow = np.zeros((len(levels), len(ids), len(ids)), np.int64)
    for shard, target, level, n in demand:
        flow[levels.index(level), at[shard], at[target]] += n
    free = np.array([room[s] for s in ids], np.int64)
    while True:
        over = flow.sum(axis=(0, 1)) - flow.sum(axis=(0, 2)) * swap - free
        if (over <= 0).all() or not flow.any():
            break
        for t in np.flatnonzero(over > 0):
            cut = int(over[t])
            for part in flow[:, :, t]:
                less = min(cut, int(part.sum()))
                if less:
                    upto = np.cumsum(part)  # in proportion, to the row
                    part -= np.diff(upto * less // upto[-1], prepend=0)
                    cut -= less
    total = flow.sum(axis=0)
    return {(ids[s], ids[t]): int(total[s, t]) for s, t in zip(*np.nonzero(total))}


def propagated(bundles: DataFrame, caps: dict[int, int]) -> DataFrame:
    """(g, shard, c) after label propagation under the quotas ``caps``, until no move is granted; its input is a stored table.

    A group asks for the shards that hold most of it, as many as it needs at least. Rows go only where as many of their group
    are or more, or all rows of a shard go, so a move lessens the shards of a group or makes its counts less even, and the rounds end.
    """
    spark, held, blocked = bundles.sparkSession, bundles, []
    closing = False  # a round in which rows of a shard go together or not at all, into room that is there
    group, most = Window.partitionBy("g"), max(caps.values())
    giants = {bytes(r["g"]): -(-r["n"] // most) for r in held.groupBy("g").agg(F.sum("c").alias("n")).filter(F.col("n") > most).collect()}  # fewer than SHARDS
    while True:
        load = {r["shard"]: r["n"] for r in held.groupBy("shard").agg(F.sum("c").alias("n")).collect()}
        room = {s: cap - load.get(s, 0) for s, cap in caps.items()}
        # a group larger than a shard goes on asking for the same ones; others ask for them last, and not where they were refused
        taken, parts = set(), {}
        if giants:
            for r in held.filter(F.col("g").isin(list(giants))).select("g", "shard", "c", F.xxhash64("g", "shard").alias("x")).collect():
                parts.setdefault(bytes(r["g"]), []).append((-r["c"], r["x"], r["shard"]))
            taken = {s for g, p in parts.items() for _, _, s in sorted(p)[: giants[g]]}
        if closing:
            blocked = [s for s, x in room.items() if x <= 0]
        order = F.when(F.col("shard").isin(blocked), 2).when(F.col("shard").isin(list(taken)), 1).otherwise(0)
        shut = F.when(F.col("need") == 1, order).otherwise(F.lit(0))
        entry = F.struct(shut.alias("shut"), (-F.col("c")).alias("o"), F.xxhash64("g", "shard").alias("x"), F.col("shard").alias("s"))
        all_ = held.withColumn("need", F.ceil(F.sum("c").over(group) / F.lit(most)).cast("int")).withColumn("all", F.sort_array(F.collect_list(entry).over(group)))
        # the group's targets, and which of them takes the rows of this shard
        asked = all_.withColumn("own", F.array_position(F.transform("all", lambda x: x["s"]), F.col("shard")).cast("int") - 1)
        # the least full target takes the largest part
        pick = F.col("all")[F.when(F.col("own") < F.col("need"), F.col("own")).otherwise(F.col("need") - 1 - F.col("own") % F.col("need"))]
        asked = asked.withColumn("to", pick).withColumn("target", F.col("to.s")).withColumn("level", F.floor(F.log2(-F.col("to.o"))).cast("int"))
        wants = (F.col("shard") != F.col("target")) & (F.col("to.shut") < 2) & (F.lit(closing) | (F.col("c") <= -F.col("to.o")))
        asked = stored(asked.withColumn("target", F.when(wants, F.col("target"))).select("g", "shard", "c", "target", "level"), "asked")
        sums = asked.filter("target IS NOT NULL").groupBy("shard", "target", "level").agg(F.sum("c").alias("n")).collect()  # SHARDS x SHARDS x 64 at most
        grants = _granted([tuple(r) for r in sums], room, not closing)
        if not grants:
            drop_stored(asked)
            if closing:
                return held
            closing, blocked = not blocked, []
            continue
        told = asked.filter("target IS NOT NULL").join(F.broadcast(spark.createDataFrame([(s, t, n) for (s, t), n in grants.items()], "shard int, target int, quota long")), ["shard", "target"])
        # largest groups first; the last one that a quota reaches gets what is left of it
        before = Window.partitionBy("shard", "target").orderBy(F.desc("level"), F.xxhash64("g"), "g").rowsBetween(Window.unboundedPreceding, -1)
        go = F.least(F.col("c"), F.col("quota") - F.coalesce(F.sum("c").over(before), F.lit(0)))
        moves = stored(told.withColumn("go", go).filter("go = c" if closing else "go > 0"), "moves")
        if closing and moves.isEmpty():
            return held
        parts = asked.select("g", "shard", "c").union(moves.select("g", "shard", -F.col("go"))).union(moves.select("g", "target", "go"))
        now = stored(parts.groupBy("g", "shard").agg(F.sum("c").alias("c")).filter("c > 0"), "bundles")
        refused = {t: 0 for t in caps}
        for s, t, _, n in sums:
            refused[t] += n
        for (_, t), n in grants.items():
            refused[t] -= n
        # groups look elsewhere in the next round where they have been refused
        blocked = [t for t, n in refused.items() if n > 0]
        drop_stored(held)
        drop_stored(asked)
        drop_stored(moves)
        closing = False
        held = now


def cut(placed: DataFrame, link: str = "text_crc32", shard: str = "shard") -> DataFrame:
    """One row: links (pairs of rows with an equal ``link``) and cut (those of them on two shards).

    All rows of a group are linked with each other, so both follow from counts; no pair is listed. Null is a value like any other.
    """
    pairs = lambda n: F.sum(F.col(n).cast("decimal(38,0)") * (F.col(n) - 1) / 2)
    parts = placed.groupBy(F.col(f"`{link}`").alias("g"), F.col(f"`{shard}`").alias("s")).agg(F.count(F.lit(1)).alias("c"))
    groups = parts.groupBy("g").agg(F.sum("c").alias("n"), pairs("c").alias("kept"))
    one = groups.agg(F.coalesce(pairs("n"), F.lit(0)).alias("links"), F.coalesce(F.sum("kept"), F.lit(0)).alias("kept"))
    return one.select(F.col("links").cast("long").alias("links"), (F.col("links") - F.col("kept")).cast("long").alias("cut"))


def _pick(ranges: Column, rank: Column) -> Column:
    """The shard of the first (hi, shard) in ``ranges`` with rank < hi."""
    return F.element_at(F.filter(ranges, lambda x: rank < x["hi"]), 1)["shard"]


def shards(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", n_shards: int = SHARDS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard: one row for each row of ``docs``.

    Null texts count as empty, and so are copies of empty ones; rows with null or repeated ids are rows like any
    other; an empty table gives an empty result; other columns are never read. Row counts of shards
    differ by one at most. A group of copies larger than a shard is cut over as few shards as the
    quotas leave; ties between shards go by a hash of group and shard.
    """
    t = F.coalesce(docs[text], F.lit(""))
    base = docs.select(docs[doc_id].cast("long").alias("doc_id"), (F.octet_length(t) + 16).cast("long").alias("size"), F.crc32(t.cast("binary")).cast("long").alias("text_crc32"), F.unhex(F.sha2(t, 256)).alias("g"))
    base = stored(base.withColumn("key", F.xxhash64("doc_id", "g")), "shards")
    total = base.count()
    caps = {s: total // n_shards + (s < total % n_shards) for s in range(n_shards)}

    first = base.groupBy("g", F.pmod("key", F.lit(n_shards)).cast("int").alias("shard")).agg(F.count(F.lit(1)).alias("c"))
    linked = first.groupBy("g").agg(F.sum("c").alias("n")).filter("n > 1").select("g")
    bundles = propagated(stored(first.join(linked, "g", "left_semi"), "bundles"), caps)

    sized = bundles.groupBy("g").agg(F.sort_array(F.collect_list(F.struct((-F.col("c")).alias("o"), "shard", "c"))).alias("a"))  # 40 entries at most
    upto = F.transform("a", lambda x, i: F.struct(F.aggregate(F.slice("a", 1, i + 1), F.lit(0).cast("long"), lambda s, y: s + y["c"]).alias("hi"), x["shard"].alias("shard")))
    ranges = sized.select("g", upto.alias("ranges"))
    ranked = exact_rank(base, ["g"], F.col("key"), "nth", total, [F.col("doc_id")], ranges)
    # rows of groups without ranges are alone; the others know their shard
    known = stored(ranked.select("doc_id", "size", "text_crc32", "key", _pick(F.col("ranges"), F.col("nth")).alias("shard")), "ranked")

    load = {r["shard"]: r["n"] for r in bundles.groupBy("shard").agg(F.sum("c").alias("n")).collect()}
    at, fill = 0, []
    for s in range(n_shards):
        at += caps[s] - load.get(s, 0)
        fill.append(F.struct(F.lit(at).cast("long").alias("hi"), F.lit(s).alias("shard")))
    singles = exact_rank(known.filter("shard IS NULL").drop("shard"), [], F.col("key"), "nth", total, [F.col("doc_id")]).select("doc_id", "size", "text_crc32", "key", _pick(F.array(*fill), F.col("nth")).alias("shard"))
    placed = known.filter("shard IS NOT NULL").union(singles).withColumn("key2", F.xxhash64("doc_id", F.lit(1)))
    out = exact_rank(placed, ["shard"], F.col("key2"), "slot", total, [F.col("doc_id"), F.col("text_crc32")])
    return out.select("doc_id", "size", "text_crc32", F.lit(LAW).alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
