"""Make this package importable in Python workers.

Arrow functions are pickled by reference, so executors need the package.
``ship`` sends it once per Spark context through Spark's own file server
(``addPyFile``), which works whether or not the driver shares folders with
the executors.
"""

from __future__ import annotations

import contextlib
import gc
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_SHIPPED: set[str] = set()

#: Bytes of an Arrow batch, so that long texts do not fill a worker's memory by the thousand.
BATCH_BYTES = 4 << 20
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"
#: Rows that a Parquet reader decodes at once; Spark's 4,096 are tens of megabytes of long texts for each task.
READ_ROWS = 512
_READ = "spark.sql.parquet.columnarReaderBatchSize"


def ship(spark: SparkSession) -> None:
    """Send the package to the executors of this context, once; make batches of texts smaller where the session leaves them at Spark's defaults."""
    sc = spark.sparkContext
    if spark.conf.get(_BATCH, "64m").rstrip("bB") in ("64m", str(64 << 20)):
        spark.conf.set(_BATCH, str(BATCH_BYTES))
    if spark.conf.get(_READ, "4096") == "4096":
        spark.conf.set(_READ, str(READ_ROWS))
    if sc.applicationId in _SHIPPED:
        return
    top = Path(__file__).resolve().parent.parent
    out = Path(tempfile.mkdtemp(prefix="millrace-")) / "millrace.zip"
    with zipfile.ZipFile(out, "w") as z:
        for p in sorted(top.rglob("*.py")):
            z.write(p, p.relative_to(top.parent).as_posix())
    sc.addPyFile(str(out))
    _SHIPPED.add(sc.applicationId)


def shared_folder(spark: SparkSession) -> None:
    """Make sure that ``checkpoint()`` has a folder: the cluster's own, or one for tests."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        # A path without scheme is taken in the cluster's default file system.
        sc.setCheckpointDir(spark.conf.get("spark.checkpoint.dir", "/tmp/checkpoints"))


def release(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files (and, where it is set to, the checkpoints) of frames that nobody holds any more.

    It does so when the driver's garbage is collected, which in a job of many rounds may be long after.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()  # noqa: SLF001


def tidy() -> None:
    """In a worker, at the end of a task: give memory that is free back, for the worker lives on."""
    import ctypes
    import pyarrow

    gc.collect()
    pyarrow.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only where the C library has it
        ctypes.CDLL(None).malloc_trim(0)
