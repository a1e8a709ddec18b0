"""Makes this package importable by the Python workers of a session."""

from __future__ import annotations

import ctypes
import gc
import os
import re
import tempfile
import uuid
import zipfile
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

_shipped: set[str] = set()

#: Beyond this share of its most, the heap of the driver's JVM is collected between stages.
HEAP_SHARE = 0.5


def ship(spark: SparkSession) -> None:
    """Send the package to all executors, once for each application."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    top = Path(__file__).resolve().parent
    at = os.path.join(os.path.realpath(tempfile.mkdtemp(prefix="strandlake-")), "strandlake-src.zip")
    with zipfile.ZipFile(at, "w", zipfile.ZIP_DEFLATED) as z:
        for f in sorted(top.rglob("*.py")):
            z.write(f, f.relative_to(top.parent))
    spark.sparkContext.addPyFile(at)
    _shipped.add(app)


def give_back(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of results that nothing refers to any more."""
    gc.collect()
    spark._jvm.System.gc()
    spark.range(1).collect()  # Spark's threads hold on to the last job until there is another
    spark._jvm.System.gc()


def spare_driver(spark: SparkSession) -> None:
    """Collect the garbage of the driver's JVM once its heap has grown beyond a share of its most.

    Plans and broadcast tables of many short jobs are garbage soon, but the JVM rather grows
    to its most than looks for them.  A collection makes the heap smaller again and lets Spark
    drop broadcast tables, here and on executors, and shuffle files that nothing refers to.
    """
    heap = spark._jvm.java.lang.Runtime.getRuntime()
    if heap.totalMemory() > HEAP_SHARE * heap.maxMemory():
        gc.collect()  # what Python refers to stays
        heap.gc()


def trim() -> None:
    """Give memory that this process has freed back to the system, where the C library can."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError, TypeError):
        pass


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the folder that driver and executors share, removed with the application.

    A folder of this machine stands in for it only where the executors are threads of it.
    """
    top = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not top:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        top = "file://" + tempfile.mkdtemp(prefix="strandlake-")
        spark.sparkContext.setCheckpointDir(top)
    path = f"{top.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(at)
    return path


def spread(df: DataFrame, least_bytes: int = 64 << 20) -> DataFrame:
    """``df`` over all cores if it has fewer partitions than there are, or too few bytes and files for them.

    Partitions of a small file may share one row group, which a single task would explode.
    A large input has partitions enough and is not shuffled; its files aren't listed here.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    plan = df._jdf.queryExecution()
    small = int(str(plan.optimizedPlan().stats().sizeInBytes())) < cores * least_bytes
    small = small and len(df.inputFiles()) < cores
    return df.repartition(cores) if small or plan.toRdd().getNumPartitions() < cores else df
