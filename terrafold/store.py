"""Tables in the folder that all machines see: they cut lineage and survive lost executors.

Everything that a loop or a second pass reads again is a Parquet table under ``spark.checkpoint.dir``: a lost
executor costs a re-read, never a recomputation, and no file is kept on one machine only.
"""

from __future__ import annotations

import atexit
import contextlib
import contextvars
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

#: Paths made so far, oldest first, with their sessions.
_tables: dict[str, SparkSession] = {}
_scope: contextvars.ContextVar[list[str] | None] = contextvars.ContextVar("scope", default=None)


def shared_dir(spark: SparkSession) -> str:
    """The folder all machines see; one is made only where the session names none (tests)."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not named:
        named = tempfile.mkdtemp(prefix="terrafold-")
        sc.setCheckpointDir(named)
        named = sc.getCheckpointDir()
    return named.rstrip("/")


def delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def _sweep() -> None:
    while _tables:
        path, spark = _tables.popitem()
        try:
            delete(spark, path)
        except Exception:  # noqa: BLE001  the session may be gone
            return


atexit.register(_sweep)


def new_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/terrafold-{name}-{uuid.uuid4().hex}"
    _tables[path] = spark
    if (made := _scope.get()) is not None:
        made.append(path)
    return path


def stored(df: DataFrame, name: str, **options: str) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read back: cuts lineage, survives executors."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.options(**options).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._terrafold_path = path
    return out


def drop_stored(df: DataFrame | None) -> None:
    """Deletes a table made by :func:`stored`; for rounds of a loop that nothing reads any more."""
    path = getattr(df, "_terrafold_path", None)
    if path:
        delete(df.sparkSession, path)
        _tables.pop(path, None)


@contextlib.contextmanager
def scope() -> Iterator[list[DataFrame]]:
    """Tables that this thread makes inside are deleted at its end, but for those put into the list it gives."""
    made, keep = [], []
    token = _scope.set(made)
    try:
        yield keep
    finally:
        _scope.reset(token)
        kept = {getattr(df, "_terrafold_path", None) for df in keep}
        for path in made:
            if path in kept:
                if (outer := _scope.get()) is not None:
                    outer.append(path)
            elif path in _tables:
                delete(_tables.pop(path), path)
