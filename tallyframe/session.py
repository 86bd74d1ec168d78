"""Session settings the operators assume."""

from __future__ import annotations

import atexit
import contextlib
import re
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(master: str | None = None, app_name: str = "tallyframe", **conf: str) -> SparkSession:
    """A session with UTC time, AQE and skew handling on.

    Cluster sizing (executors, shuffle partitions, checkpoint folder) is left to
    the caller or to spark-defaults; only semantics are pinned here.
    """
    builder = (
        SparkSession.builder.appName(app_name)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.parquet.filterPushdown", "true")
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder for checkpoints and intermediate tables.

    A cluster names it in ``spark.checkpoint.dir``. Only where that is unset and all
    tasks run in this process, as in tests, a private temporary folder is made; on a
    cluster executors could not see it, so there the setting is required.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    import tempfile

    path = tempfile.mkdtemp(prefix="tallyframe-")
    spark.conf.set("spark.checkpoint.dir", path)
    return path


def fresh_dir(spark: SparkSession, name: str) -> str:
    """A folder of its own under the shared folder; removed when the driver program ends."""
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    context = spark.sparkContext
    atexit.register(_remove, context._jvm, context._jsc.hadoopConfiguration(), path)
    return path


def _remove(jvm, configuration, path: str) -> None:
    """Delete a folder with what it holds, in whatever store it is; at exit nobody can act on a failure."""
    with contextlib.suppress(Exception):
        place = jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(configuration).delete(place, True)


def remove_dir(spark: SparkSession, path: str) -> None:
    """Delete an intermediate folder that nothing reads any more."""
    _remove(spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration(), path)


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a folder is there, in whatever store it is."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place)


@contextlib.contextmanager
def shuffles_removed(spark: SparkSession):
    """Within it, the shuffle files of a frame made here are removed when its query ends, where Spark can do so (4.1)."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    if before is not None:
        spark.conf.set(key, "true")
    try:
        yield
    finally:
        if before is not None:
            spark.conf.set(key, before)


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write once, read back: for a costly input that one plan reads several times.

    The table lies in the shared folder, so a lost executor re-reads it instead of
    running the lineage again. The shuffle files of the job go when it ends.
    """
    path = fresh_dir(df.sparkSession, name)
    with shuffles_removed(df.sparkSession):
        df.select("*").write.parquet(path)  # a frame takes the setting of the time it is made
    return df.sparkSession.read.schema(df.schema).parquet(path)
