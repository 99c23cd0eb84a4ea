"""A Spark session with the settings that this package is tuned for, and its scratch space."""

from __future__ import annotations

import os
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

#: Adaptive plans split skewed joins and merge small partitions; the rest keeps partitions at a size that fits a task.
SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}
#: Rows that Python workers get at a time.
BATCH, BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch", 1_000


def prepare(spark: SparkSession) -> None:
    """Let Python workers import this package where the driver found it, and hand them texts in small batches.

    The usual ten thousand rows of long texts would take an executor's memory several
    times over (in the JVM, on the way and in Python).  A size set by the user stays.
    """
    if spark.conf.get(BATCH, "10000") == "10000":
        spark.conf.set(BATCH, str(BATCH_ROWS))
    root, env = str(Path(__file__).resolve().parents[1]), spark.sparkContext.environment
    if root not in (env.get("PYTHONPATH") or os.environ.get("PYTHONPATH") or "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (root, env.get("PYTHONPATH")) if x)


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder: spark.checkpoint.dir.

    Where that is unset and Spark runs on this machine alone, a temporary folder is made
    and removed at exit; on a cluster it would be a different folder for every machine.
    """
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or os.environ.get("GLYPHRAKE_SCRATCH")
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        import atexit

        found = os.environ["GLYPHRAKE_SCRATCH"] = tempfile.mkdtemp(prefix="glyphrake-")
        atexit.register(shutil.rmtree, found, ignore_errors=True)
    return found.rstrip("/")


#: The tables that the innermost passing() block of this thread has written.
_WRITTEN: ContextVar[list[str] | None] = ContextVar("written", default=None)


#: Shuffle files go when their query ends, not when the driver happens to collect its garbage.
TIDY = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def passing(spark: SparkSession, step: bool = False) -> Iterator[Callable[[DataFrame, str], DataFrame]]:
    """For work whose result is written as a table: what it writes on the way is removed at its end, also if it fails.

    The block gets a function like checkpoint(), whose tables stay.  Tables of other threads
    are not touched, nor those that a block inside this one keeps.  A step is part of the
    work of the block around it, which removes what the step keeps.  Shuffle files don't
    outlast their query either.
    """
    own: list[str] = []
    around = _WRITTEN.get() if step else None
    outer, tidy = _WRITTEN.set(own), spark.conf.get(TIDY, "false")
    spark.conf.set(TIDY, "true")

    def keep(df: DataFrame, label: str, options: dict[str, str] | None = None) -> DataFrame:
        inner = _WRITTEN.set(around)
        try:
            return checkpoint(df, label, options)
        finally:
            _WRITTEN.reset(inner)

    try:
        yield keep
    finally:
        _WRITTEN.reset(outer)
        spark.conf.set(TIDY, tidy)
        for name in own:
            path = spark._jvm.org.apache.hadoop.fs.Path(name)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def checkpoint(df: DataFrame, label: str, options: dict[str, str] | None = None) -> DataFrame:
    """Write df as a Parquet table in the shared folder and read it back: lineage ends there.

    A lost executor costs a reread of the table, never the passes before it.
    """
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/glyphrake/{label}-{uuid.uuid4().hex}"
    if (written := _WRITTEN.get()) is not None:
        written.append(path)  # a failed write leaves a folder, too
    df.write.options(**options or {}).parquet(path)
    return spark.read.schema(df.schema).parquet(path)
