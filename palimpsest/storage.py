"""Intermediate tables in the folder that driver and executors share, and how many pieces an exchange of them takes."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: By application: the temporary folder of a run on one machine, and the tables stored so far.
_LOCAL: dict[str, str] = {}
_STORED: dict[str, list[str]] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir; a temporary one, removed at exit, only where none is named and all runs on one machine (tests)."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path.rstrip("/")
    context = spark.sparkContext
    if not context.master.startswith("local[") and context.master != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    if context.applicationId not in _LOCAL:
        _LOCAL[context.applicationId] = tempfile.mkdtemp(prefix="palimpsest-")
        atexit.register(shutil.rmtree, _LOCAL[context.applicationId], ignore_errors=True)
    return _LOCAL[context.applicationId]


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stored(df: DataFrame, name: str, heavy: bool = False) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: lineage ends here.

    ``heavy``: made of the bytes of files; written more densely, and its shuffle files go as soon as it is written.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/palimpsest-{name}-{uuid.uuid4().hex}"
    if heavy:
        before = spark.conf.get(_CLEANUP, "false")
        spark.conf.set(_CLEANUP, "true")
        try:
            df.write.parquet(path, compression="zstd")
        finally:
            spark.conf.set(_CLEANUP, before)
    else:
        df.write.parquet(path)
    _STORED.setdefault(spark.sparkContext.applicationId, []).append(path)
    return spark.read.schema(df.schema).parquet(path)


def clear(spark: SparkSession) -> int:
    """Remove the tables that this application has stored, and say how many: for when the results that read them are written."""
    paths = _STORED.pop(spark.sparkContext.applicationId, [])
    for path in paths:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
    return len(paths)


def checkpointed(df: DataFrame) -> DataFrame:
    """Reliable checkpoint of a small table."""
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_dir(spark))
    return df.checkpoint()


def bucket_count(df: DataFrame, bytes_each: int = 24 << 20) -> int:
    """Buckets for an exchange whose size follows the input: the session's setting, or more for large inputs."""
    spark = df.sparkSession
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    wanted = min(1 << 17, size // bytes_each) if size < 1 << 60 else 0  # larger: Spark does not know
    return max(int(spark.conf.get("spark.sql.shuffle.partitions", "200")), wanted)
