"""Session settings that the library relies on."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Give the executors this package, once for an application, wherever they run."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    root = Path(__file__).resolve().parent.parent
    archive = Path(tempfile.mkdtemp(prefix="lexifold-")) / "lexifold.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for p in sorted([*(root / "lexifold").rglob("*.py"), *root.glob("corpus_pipeline.py")]):
            z.write(p, p.relative_to(root))
    spark.sparkContext.addPyFile(str(archive))
    _shipped.add(app)


_roots: dict[str, str] = {}


def shared_root(spark: SparkSession) -> str:
    """The folder that the driver and all executors share, from spark.checkpoint.dir; on a single machine without that setting a
    temporary one, the same for the whole session."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if not base and app not in _roots:
        _roots[app] = tempfile.mkdtemp(prefix="lexifold-")
    return base or _roots[app]


def shared_place(spark: SparkSession, name: str) -> str:
    """A new place in the shared folder."""
    return f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"


def configured(builder: SparkSession.Builder) -> SparkSession.Builder:
    """UTC, adaptive execution with skew handling, and large partitions split; sizes stay the cluster's own choice."""
    return builder.config(
        map={
            "spark.sql.session.timeZone": "UTC",
            "spark.sql.adaptive.enabled": "true",
            "spark.sql.adaptive.skewJoin.enabled": "true",
            "spark.sql.execution.arrow.pyspark.enabled": "true",
        }
    )
