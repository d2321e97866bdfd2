"""Session settings, and the package's way to the Python workers."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
}


def local_session(cores: int | str = "*", partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A session for tests and the benchmark; a cluster brings its own."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName("palimpsest").config("spark.driver.memory", memory).config("spark.sql.shuffle.partitions", str(partitions))
    spark = builder.config(map=CONF).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return ship(spark)


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> SparkSession:
    """Give the Python workers this package, once an application, wherever it is installed."""
    context = spark.sparkContext
    if context.applicationId not in _SHIPPED:
        top = Path(__file__).resolve().parent
        path = Path(tempfile.mkdtemp(prefix="palimpsest-")) / "palimpsest.zip"
        with zipfile.ZipFile(path, "w") as z:
            for f in sorted(top.rglob("*.py")):
                z.write(f, f.relative_to(top.parent))
        context.addPyFile(str(path))
        _SHIPPED.add(context.applicationId)
    return spark
