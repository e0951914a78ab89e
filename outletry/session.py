"""Session set-up and staging of intermediate tables."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_LOCAL: dict[str, str] = {}
_STAGED: dict[str, list[str]] = {}
_WRITERS = "spark.sql.maxConcurrentOutputFileWriters"
_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
OPEN_FILES = 12
_LOCK = threading.Lock()
_WRITING: dict[str, tuple[int, dict[str, str]]] = {}


def build_session(name: str = "outletry", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings this library is written for.

    ``forceOptimizeSkewedJoin`` lets adaptive execution split a hot join key even when that
    costs one more exchange; everything else is a Spark default stated for clarity.
    """
    builder = SparkSession.builder.appName(name)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
        # Methods beyond 8,000 bytecodes are never compiled by the JVM; split those instead.
        "spark.sql.codegen.hugeMethodLimit": "8000",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """Folder that every executor can reach, named by the cluster in ``spark.checkpoint.dir``.

    A local session without that setting gets a folder of its own, which goes when the process ends.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    if "folder" not in _LOCAL:
        _LOCAL["folder"] = tempfile.mkdtemp(prefix="outletry-")
        atexit.register(shutil.rmtree, _LOCAL["folder"], ignore_errors=True)
    return _LOCAL["folder"]


@contextmanager
def _write_settings(spark: SparkSession) -> Iterator[None]:
    """Settings of staged writes; several threads may write, and the last to end restores those of the session."""
    app = spark.sparkContext.applicationId
    with _LOCK:
        n, before = _WRITING.get(app, (0, {}))
        if not n:
            before = {key: spark.conf.get(key) for key in (_CLEAN, _WRITERS)}
            spark.conf.set(_CLEAN, "true")
            spark.conf.set(_WRITERS, str(max(int(before[_WRITERS]), OPEN_FILES)))
        _WRITING[app] = (n + 1, before)
    try:
        yield
    finally:
        with _LOCK:
            n, before = _WRITING.pop(app)
            if n > 1:
                _WRITING[app] = (n - 1, before)
            else:
                for key, value in before.items():
                    spark.conf.set(key, value)


def stage(df: DataFrame, name: str = "stage", partition_by: list[str] | None = None) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back.

    This cuts the lineage in a place that outlives an executor, and the reread table carries real
    sizes, so the optimiser picks broadcast or sort-merge joins from facts. ``partition_by`` is for columns of few
    values: every task then keeps a file open for each, up to ``OPEN_FILES``, instead of sorting its rows by them.
    The shuffle files behind the table are deleted when it is written, not when the driver next collects garbage.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    _STAGED.setdefault(spark.sparkContext.applicationId, []).append(path)
    with _write_settings(spark):
        df.write.parquet(path, partitionBy=partition_by)
    return spark.read.schema(df.schema).parquet(path).select(*[f"`{c}`" for c in df.columns])


def drop_staged(spark: SparkSession) -> None:
    """Delete every table this application has staged; for the end of a run, when results are written."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    for path in _STAGED.pop(spark.sparkContext.applicationId, []):
        at = hadoop(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
