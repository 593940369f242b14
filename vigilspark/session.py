"""Session helpers: a UTC session for local work, and lineage cuts that survive executor loss."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(name: str = "vigilspark", cores: int | str = "*", **conf: str) -> SparkSession:
    """A local session for tests and the bench; on a cluster pass your own session instead."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(name)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.minPartitionSize", "128k")  # small local data keep all cores
        .config("spark.driver.memory", "8g")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")  # no call-site capture per column expression
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    session = builder.getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    return session


_LOCAL_DIRS: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The shared folder for checkpoints and state: the session's ``spark.checkpoint.dir``.

    Only a local session may fall back to a temporary folder of this machine.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors can reach")
    application = spark.sparkContext.applicationId
    if application not in _LOCAL_DIRS:
        _LOCAL_DIRS[application] = tempfile.mkdtemp(prefix="vigilspark-")
    return _LOCAL_DIRS[application]


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` once as a table in the shared folder and read it from there: the lineage ends, a lost
    executor costs no recomputation, and later reads still prune columns."""
    path = f"{shared_dir(df.sparkSession).rstrip('/')}/tables/{uuid.uuid4().hex}"
    df.write.parquet(path)
    table = df.sparkSession.read.schema(df.schema).parquet(path)
    table.folder = path
    return table


def _file_system(spark: SparkSession, path: str):
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()), target


def remove(spark: SparkSession, path: str) -> None:
    """Remove a file or folder of the shared file system, if it is there."""
    files, target = _file_system(spark, path)
    files.delete(target, True)


def children(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder of the shared file system; none if it isn't there."""
    files, target = _file_system(spark, path)
    return sorted(f.getPath().getName() for f in files.listStatus(target)) if files.exists(target) else []


def discard(*tables: DataFrame) -> None:
    """Remove tables that ``materialize`` wrote, once nothing that is still to run reads them."""
    for table in tables:
        remove(table.sparkSession, table.folder)
