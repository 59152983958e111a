"""Session settings and the shared work folder.

Everything in the library takes a ``SparkSession`` argument; nothing keeps a
global session. ``build_session`` is for tests, the bench and local runs; on a
cluster the caller brings its own session and only ``work_dir`` is used.
"""

from __future__ import annotations

import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession

# Settings the operators rely on (NULL/NaN rules assume ANSI mode, which is
# the Spark 4 default; day boundaries assume UTC). HotSpot never compiles a
# method of more than 8,000 bytes: a longer generated stage (the flight
# projection with its lookups) would be interpreted for every row.
REQUIRED_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.codegen.hugeMethodLimit": "8000",
}


_work_dirs: list[str] = []
_open = threading.local()


def build_session(master: str = "local[8]", shuffle_partitions: int = 8,
                  app_name: str = "tarmac", driver_memory: str = "16g") -> SparkSession:
    builder = (
        SparkSession.builder.master(master)
        .appName(app_name)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.driver.memory", driver_memory)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.sql.ansi.enabled", "true")
        .config("spark.python.unix.domain.socket.enabled", "true")     # shorter waits between the JVM and Python workers
    )
    for k, v in REQUIRED_CONF.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    apply_conf(spark)
    return spark


def apply_conf(spark: SparkSession) -> None:
    """Pin the settings the operators need on a session built elsewhere."""
    for k, v in REQUIRED_CONF.items():
        spark.conf.set(k, v)


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder the cluster names in ``spark.checkpoint.dir``.

    Only when the session has none (local tests, the bench) a fresh local
    folder is created and registered, so ``DataFrame.checkpoint()`` works too.
    """
    sc = spark.sparkContext
    root = None
    try:
        root = spark.conf.get("spark.checkpoint.dir", None)
    except Exception:  # pragma: no cover - conf API differences
        root = None
    if not root:
        root = sc.getConf().get("spark.checkpoint.dir", None)
    if not root:
        jdir = sc._jsc.sc().getCheckpointDir()
        if jdir.isDefined():
            root = jdir.get()
    if not root:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        root = tempfile.mkdtemp(prefix="tarmac-ckpt-")
        spark.conf.set("spark.checkpoint.dir", root)
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(root)
    return root.rstrip("/")


def work_dir(spark: SparkSession, name: str) -> str:
    """A new, unique sub-folder of the checkpoint root for one run's tables.
    ``remove_work_dirs`` removes all that this process asked for."""
    path = f"{checkpoint_root(spark)}/{name}-{uuid.uuid4().hex[:12]}"
    _work_dirs.append(path)
    for made in getattr(_open, "stack", ()):
        made.append(path)
    return path


@contextmanager
def noted_work_dirs() -> Iterator[list[str]]:
    """The folders that this thread asks ``work_dir`` for inside the block."""
    made: list[str] = []
    _open.stack = [*getattr(_open, "stack", ()), made]
    try:
        yield made
    finally:
        _open.stack = [m for m in _open.stack if m is not made]


def remove_work_dirs(spark: SparkSession, paths: list[str] | None = None) -> int:
    """Delete folders that ``work_dir`` named in this process (``paths``, or
    all of them), for when no DataFrame over them is needed any more; returns
    how many existed."""
    conf, path = spark.sparkContext._jsc.hadoopConfiguration(), spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    gone = 0
    for name in list(_work_dirs) if paths is None else paths:
        if name in _work_dirs:
            _work_dirs.remove(name)
            p = path(name)
            gone += bool(p.getFileSystem(conf).delete(p, True))
    return gone


def ensure_parent(spark: SparkSession, path: str) -> None:
    """Create the parent folder of an output path, on the path's own file
    system (a path without a scheme means the default file system)."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    parent = p.getParent()
    if parent is not None:
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).mkdirs(parent)


def input_bytes(spark: SparkSession, path: str) -> int:
    """Total size of the files under ``path`` (Hadoop file system summary)."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return int(fs.getContentSummary(p).getLength())


def size_shuffles(spark: SparkSession, data_bytes: int, target_bytes: int = 256 << 20) -> int:
    """Initial shuffle partitions ~ data / target (AQE coalesces small ones
    and splits skewed ones around the same advisory size). Returns the count."""
    import math
    n = max(spark.sparkContext.defaultParallelism, math.ceil(data_bytes / max(1, target_bytes)))
    spark.conf.set("spark.sql.shuffle.partitions", str(n))
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", str(target_bytes))
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(min(target_bytes, 512 << 20)))
    return n
