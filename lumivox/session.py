"""Sessions for tests and scripts, and the package's code on the executors."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> SparkSession:
    """Makes this package importable in the executors' Python workers; once an application."""
    context = spark.sparkContext
    if context.applicationId not in _shipped:
        top = Path(__file__).parent
        target = Path(tempfile.mkdtemp(prefix="spark-")) / "lumivox.zip"
        with zipfile.ZipFile(target, "w") as archive:
            for source in sorted(top.rglob("*.py")):
                archive.write(source, f"lumivox/{source.relative_to(top)}")
        context.addPyFile(str(target))
        _shipped.add(context.applicationId)
    return spark


def local_session(cores: str = "*", partitions: int = 8) -> SparkSession:
    """A local session with UTC time and few shuffle partitions."""
    builder = SparkSession.builder.master(f"local[{cores}]").config("spark.sql.shuffle.partitions", partitions).config("spark.sql.session.timeZone", "UTC")
    return ship(builder.config("spark.ui.enabled", "false").config("spark.driver.host", "127.0.0.1").config("spark.driver.memory", "6g").getOrCreate())
