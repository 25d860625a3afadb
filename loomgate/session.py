"""Session defaults and durable intermediates.

Lineage is cut with tables in the shared folder named by
``spark.checkpoint.dir``.  Only where that setting is absent (tests, a laptop)
does the engine pick a folder of its own.
"""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own_dirs: dict[str, str] = {}
_cleaned: set[str] = set()


def get_session(cpus: int | None = None, app: str = "loomgate") -> SparkSession:
    """A local session; on a cluster the caller brings its own."""
    n = cpus or int(os.environ.get("BENCH_CPUS", "8"))
    return (
        SparkSession.builder.master(f"local[{n}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(n))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", os.environ.get("LOOMGATE_DRIVER_MEMORY", "8g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def checkpoint_dir(spark: SparkSession) -> str:
    """The cluster's shared folder, or a temporary one where none is set."""
    conf = spark.sparkContext.getConf()
    named = conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    app = spark.sparkContext.applicationId
    if app not in _own_dirs:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a shared folder on a cluster")
        _own_dirs[app] = tempfile.mkdtemp(prefix="loomgate-")
        atexit.register(shutil.rmtree, _own_dirs[app], True)
    return f"file://{_own_dirs[app]}"


def _app_dir(spark: SparkSession) -> str:
    """The application's own part of the shared folder; it is deleted when the driver ends."""
    app = spark.sparkContext.applicationId
    path = f"{checkpoint_dir(spark)}/loomgate-{app}"
    if app not in _cleaned:
        _cleaned.add(app)
        atexit.register(_remove, spark, path)
    return path


def _remove(spark: SparkSession, path: str) -> None:
    try:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # the session has been stopped: the folder bears the application's name
        pass


def durable(df: DataFrame, name: str = "t") -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back.

    The result has no lineage, survives lost executors and is computed once.
    """
    spark = df.sparkSession
    path = f"{_app_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._loomgate_path = path
    return out


def discard(df: DataFrame) -> None:
    """Delete the table behind a ``durable`` frame that is no longer read."""
    path = getattr(df, "_loomgate_path", None)
    if path:
        _remove(df.sparkSession, path)
