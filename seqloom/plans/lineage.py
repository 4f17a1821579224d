"""Lineage cuts in the folder that all executors share."""

from __future__ import annotations

import atexit
import gc
import shutil
import tempfile
import time

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The checkpoint folder, from ``spark.checkpoint.dir``.

    Where that is unset, a temporary folder serves a local session and goes with it; executors on other
    machines could not see such a folder, so there it is an error.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        place = spark.conf.get("spark.checkpoint.dir", None)
        if place is None:
            if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
                raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            place = tempfile.mkdtemp(prefix="seqloom-")
            atexit.register(shutil.rmtree, place, ignore_errors=True)
        sc.setCheckpointDir(place)
    return sc.getCheckpointDir()


#: Seconds from one asking for garbage collection to the next.
TIDY_S = 2
#: Seconds that Python's references take to reach the JVM, and files to go after a collection.
SETTLE_S = 0.4
_tidied = 0.0


def tidy(spark: SparkSession, now: bool = False) -> None:
    """Have Spark remove the shuffle files and checkpoints of frames that nothing refers to any more.

    It does so only when the driver collects its garbage, which a driver of a small heap hardly needs to
    while the executors' disks fill. ``now``: also of frames let go of a moment ago, which takes a wait.
    """
    global _tidied
    if now or time.monotonic() - _tidied >= TIDY_S:
        gc.collect()
        if now:  # references of Python's are dropped by a thread of their own
            time.sleep(SETTLE_S)
        spark._jvm.System.gc()
        if now:
            time.sleep(SETTLE_S)
        _tidied = time.monotonic()


def cut(df: DataFrame) -> DataFrame:
    """Compute once; later plans start from the stored rows, and a lost executor loses none of them.

    Spark removes the stored rows with the frame if ``spark.cleaner.referenceTracking.cleanCheckpoints`` is on.
    """
    shared_dir(df.sparkSession)
    tidy(df.sparkSession)
    return df.checkpoint(eager=True)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder that nothing reads any more, wherever Spark can write."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def stamp(spark: SparkSession, path: str) -> int:
    """A number that changes when something directly in a folder does: a hash of names, times and lengths."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = at.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(at)
    return hash(tuple(sorted((x.getPath().getName(), x.getModificationTime(), x.getLen()) for x in files)))
