"""Helpers shared by the corpus operators: tables, free names, exact ranks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from terrafold.store import delete, drop_stored, new_path, shared_dir, stored

#: Characters that separate words: space, tab, LF, VT, FF, CR (fixed values).
SPACE_CLASS = r"[\x20\x09-\x0D]"
#: Buckets of an exact rank for each million rows: a group with a third of them still has short buckets.
RANK_BUCKETS = 64
#: Values of a folded hash (see :func:`split_by_key`).
FOLD = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def free_name(df: DataFrame, base: str) -> str:
    """``base``, prefixed until no column of ``df`` has that name."""
    taken = {c.lower() for c in df.columns}
    name = base
    while name.lower() in taken:
        name = "_" + name
    return name


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def split_by_key(df: DataFrame, some: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """``df`` in two: rows whose ``key`` is surely not in ``some``, and the rest, which alone has to be shuffled to join ``some``.

    The hashes of ``some``'s keys, folded to :data:`FOLD` values, are broadcast: so many longs at most, however large ``some`` is.
    """
    at, hit = free_name(df, "fold"), free_name(df, "fold_hit")
    fold = F.pmod(F.xxhash64(F.col(key)), F.lit(FOLD))
    marks = some.select(fold.alias(at)).distinct().withColumn(hit, F.lit(True))
    marked = df.withColumn(at, fold).join(F.broadcast(marks), at, "left")
    names = [F.col(f"`{c}`") for c in df.columns]
    return marked.filter(F.col(hit).isNull()).select(*names), marked.filter(F.col(hit)).select(*names)


def exact_rank(df: DataFrame, group: list[str], key: Column, out: str, rows: int, ties: list[Column] | None = None, extra: DataFrame | None = None, buckets: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Adds ``out``: the 0-based rank of each row in its ``group``, ordered by a hash bucket, ``key`` and ``ties``.

    A plain window would put a whole group into one task. Here ``key`` (a long that is spread
    evenly, such as a hash) is cut into buckets sized by ``rows``; each bucket is ranked alone and
    shifted by the sizes of the buckets before it. The order is total as far as ``key`` and
    ``ties`` are. ``extra`` (the group columns and more) adds its other columns to each row by way
    of the small table of buckets, so a hot group isn't joined as one key. Null groups count as equal. ``buckets`` may add columns to
    that table itself (rank_group, rank_bucket, rank_n and rank_base, the names prefixed where ``df`` has them); rows get those too.
    """
    count = RANK_BUCKETS * (1 + -(-rows // 1_000_000))
    g, b, n, base, local = (free_name(df, x) for x in ("rank_group", "rank_bucket", "rank_n", "rank_base", "rank_local"))
    whole = F.struct(*(F.col(f"`{c}`").alias(f"g{i}") for i, c in enumerate(group))) if group else F.struct(F.lit(0).alias("g0"))
    cut = df.withColumn(g, whole).withColumn(b, (F.shiftrightunsigned(key, 40) % F.lit(count)).cast("int"))
    sizes = cut.groupBy(g, b).agg(F.count(F.lit(1)).alias(n))
    before = Window.partitionBy(g).orderBy(b).rowsBetween(Window.unboundedPreceding, -1)
    bases = sizes.select(g, b, n, F.coalesce(F.sum(n).over(before), F.lit(0)).alias(base))
    more = []
    if buckets is not None:
        bases = buckets(bases)
        more = [c for c in bases.columns if c not in (g, b, n, base)]
    bases = bases.drop(n)
    if extra is not None:
        more += [c for c in extra.columns if c not in group]
        bases = bases.join(extra.select(whole.alias(g), *more), g, "left")
    within = Window.partitionBy(g, b).orderBy(key, *(ties or []))
    joined = cut.withColumn(local, F.row_number().over(within)).join(bases, [g, b])
    return joined.select(*(F.col(f"`{c}`") for c in df.columns), *more, (F.col(base) + F.col(local) - 1).cast("long").alias(out))


__all__ = ["delete", "documents", "drop_stored", "exact_rank", "free_name", "new_path", "shared_dir", "shuffle_width", "split_by_key", "stored", "table"]
