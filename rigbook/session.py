"""Session settings and the shared working folder."""

import contextvars
import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Settings the library relies on. On a cluster, pass them to spark-submit or the session builder.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.parquet.filterPushdown": "true",
    # Java never compiles a method of over 8000 bytecodes. Past that size Spark had better not fuse a
    # stage into one method; its default is eight times as much.
    "spark.sql.codegen.hugeMethodLimit": "8000",
}


def configure(spark: SparkSession) -> SparkSession:
    """Put the settings on a session that already runs; all of them may change at run time."""
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def small_scans(spark: SparkSession) -> None:
    """For folds of wide rows, whose rows each task sorts by key before it folds them: of Spark's default, 128 MB of
    Parquet, a task makes more rows than its memory holds, and writes them to disk for the sort."""
    spark.conf.set("spark.sql.files.maxPartitionBytes", "16m")


@contextmanager
def scans_of(spark: SparkSession, size: str) -> Iterator[None]:
    """Tables written or collected inside are read by tasks of at most this size; then the setting is as before."""
    key = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(key, None)
    spark.conf.set(key, size)
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


_FREEING = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_FREEING_LOCK = threading.Lock()
_freeing = {"inside": 0, "before": None}


@contextmanager
def freeing_shuffles(spark: SparkSession) -> Iterator[None]:
    """What a query that begins inside has shuffled is removed when it ends, and not when the driver happens to collect
    its garbage. For writes: a plan that is run again would have to shuffle again. Several threads may be inside; the
    last one to leave puts the setting back."""
    with _FREEING_LOCK:
        if not _freeing["inside"]:
            _freeing["before"] = spark.conf.get(_FREEING, None)
            spark.conf.set(_FREEING, "true")
        _freeing["inside"] += 1
    try:
        yield
    finally:
        with _FREEING_LOCK:
            _freeing["inside"] -= 1
            if not _freeing["inside"]:
                before = _freeing["before"]
                spark.conf.unset(_FREEING) if before is None else spark.conf.set(_FREEING, before)


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors can reach, as the cluster names it in ``spark.checkpoint.dir``.

    Only a local session, which has no other machine, may do without the setting.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
        folder = tempfile.mkdtemp(prefix="run-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


#: The folder of the run that is under way, if there is one.
_RUN: contextvars.ContextVar[str | None] = contextvars.ContextVar("run", default=None)


@contextmanager
def scratch_run(spark: SparkSession) -> Iterator[None]:
    """All scratch paths handed out inside lie in one folder, which is removed in the end, also after a failure.

    Only for runs whose results are stored elsewhere when they end: a DataFrame that still reads scratch tables
    would lose them. A run inside another one belongs to that.
    """
    if _RUN.get() is not None:
        yield
        return
    folder = f"{shared_folder(spark)}/run-{uuid.uuid4().hex}"
    token = _RUN.set(folder)
    try:
        yield
    finally:
        _RUN.reset(token)
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new, unused path below the shared folder, and in the folder of the run if one is under way."""
    return f"{_RUN.get() or shared_folder(spark)}/{label}-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write a DataFrame to the shared folder and go on from there, so that later steps neither compute
    it again nor grow their plans, and lost executors cost nothing that was done before.

    A Parquet table does this better than a checkpoint of rows: later steps read only the columns they
    need, and the planner knows the true size, on which the choice of a broadcast rests.
    """
    path = scratch_path(df.sparkSession, "cut")
    with freeing_shuffles(df.sparkSession):
        df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
