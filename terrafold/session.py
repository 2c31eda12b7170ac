"""Makes the package importable in the Python workers of whatever session a query is given."""

from __future__ import annotations

import functools
import os
import tempfile
import zipfile
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

ROOT = Path(__file__).resolve().parent.parent
_sent: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Sends the package to the workers once per application, unless their path already has it."""
    app = spark.sparkContext.applicationId
    if app in _sent:
        return
    _sent.add(app)
    if str(ROOT) in os.environ.get("PYTHONPATH", "").split(os.pathsep):
        return
    target = Path(tempfile.mkdtemp(prefix="terrafold-zip-")) / "terrafold_pkg.zip"
    with zipfile.ZipFile(target, "w") as z:
        for p in [*(ROOT / "terrafold").rglob("*.py"), *ROOT.glob("corpus_pipeline.py")]:
            z.write(p, p.relative_to(ROOT))
    spark.sparkContext.addPyFile(str(target))


def shipped(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    @functools.wraps(f)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship(spark)
        return f(spark, sf_dir)

    return run
