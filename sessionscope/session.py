"""Spark session defaults shared by the library, the tests and the bench."""

from __future__ import annotations

import os
import tempfile
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from pyspark import inheritable_thread_target
from pyspark.sql import SparkSession

# Settings every query relies on: epoch-microsecond text and all bucket labels
# are defined in UTC, and AQE re-plans joins/partition counts at runtime.
REQUIRED_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
    # Every join carries the partition column tenant_id, and no side of it is a small filtered
    # dimension: pruning subqueries would only repeat whole subtrees of the plan.
    "spark.sql.optimizer.dynamicPartitionPruning.enabled": "false",
}


def build_session(master: str | None = None, app: str = "sessionscope",
                  shuffle_partitions: int | None = None,
                  extra: dict[str, str] | None = None) -> SparkSession:
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    conf = dict(REQUIRED_CONF)
    conf["spark.ui.enabled"] = "false"
    conf["spark.ui.showConsoleProgress"] = "false"
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    apply_required_conf(spark)
    return spark


def apply_required_conf(spark: SparkSession) -> None:
    """Pin the runtime settings the query semantics depend on (idempotent). They hold for the whole session that is handed over, also for
    its other queries: among them that dynamic partition pruning is off. Hand over ``spark.newSession()`` to keep them apart."""
    for k, v in REQUIRED_CONF.items():
        if spark.conf.get(k, None) != v:
            spark.conf.set(k, v)


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by ``spark.checkpoint.dir``.

    On a cluster this setting names a shared (distributed) folder; it is used as
    given, and must be set. Only on a local master, where driver and tasks are one
    process, an unset folder falls back to one stable folder of this machine, so that a
    warehouse built by one local session is reused by the next.
    """
    d = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get(
        "spark.checkpoint.dir", None)
    if not d:
        if not _one_process(spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        d = os.path.join(tempfile.gettempdir(), "sessionscope-checkpoints")
        spark.conf.set("spark.checkpoint.dir", d)
    spark.sparkContext.setCheckpointDir(d)
    return d


def _one_process(master: str) -> bool:
    return master == "local" or master.startswith("local[")


def scratch_dir(spark: SparkSession, name: str, temporary: bool = False) -> str:
    """A sub-folder of the shared checkpoint folder for written intermediate tables;
    a ``temporary`` one is deleted when the application ends."""
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}"
    if temporary:
        fs, p = file_system(spark, path)
        fs.deleteOnExit(p)
    return path


def side_by_side(spark: SparkSession, work: dict[str, Callable[[], object]]) -> dict[str, Exception]:
    """Run independent jobs at the same time, one thread each, so that their many short stages fill the cluster; the exceptions by name."""
    def run(name: str):
        try:
            work[name]()
        except Exception as error:  # handed to the caller, who knows which ones to expect
            return error
        return None

    with ThreadPoolExecutor(max(1, len(work))) as pool:
        found = dict(zip(work, pool.map(inheritable_thread_target(spark)(run), work), strict=True))
    return {name: error for name, error in found.items() if error is not None}


def file_system(spark: SparkSession, path: str):
    """(Hadoop FileSystem, Path) of any path that Spark can read or write."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def children(spark: SparkSession, path: str) -> list:
    """Sorted (name, length, modification time) of a folder's entries (length -1: a folder); empty if there is
    no such folder. Any other storage error is raised."""
    fs, p = file_system(spark, path)
    if not fs.exists(p):
        return []
    return sorted((x.getPath().getName(), -1 if x.isDirectory() else x.getLen(), x.getModificationTime()) for x in fs.listStatus(p))


def delete_path(spark: SparkSession, path: str) -> None:
    fs, p = file_system(spark, path)
    fs.delete(p, True)


def rename_path(spark: SparkSession, src: str, dst: str) -> bool:
    """Atomic publish of a written folder (Hadoop FileSystem rename; False if ``dst`` exists)."""
    fs, d = file_system(spark, dst)
    if fs.exists(d):
        return False
    fs.mkdirs(d.getParent())
    return bool(fs.rename(file_system(spark, src)[1], d))


def path_exists(spark: SparkSession, path: str) -> bool:
    fs, p = file_system(spark, path)
    return bool(fs.exists(p))
