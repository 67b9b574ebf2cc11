"""Session construction and the shared scratch folder.

On a cluster the scratch folder is the shared directory named by
``spark.checkpoint.dir``; without one only a local session goes on, with a
folder under the temp dir.
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession

# Settings every plan in this package assumes.  AQE re-plans joins from
# runtime sizes (a size-checked broadcast with sort-merge as the fallback)
# and splits skewed shuffle partitions.
DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # prompts carry whole source files: keep Arrow batches to the scorer small
    "spark.sql.execution.arrow.maxRecordsPerBatch": "1024",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def get_session(master: str | None = None, shuffle_partitions: int | None = None,
                app_name: str = "binscore", extra: dict | None = None) -> SparkSession:
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    conf = dict(DEFAULT_CONF)
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The session's checkpoint folder.  Where it is unset, a local session
    gets a temporary one; on a cluster this is an error, as no folder of one
    machine reaches the others."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = sc.getConf().get("spark.checkpoint.dir", None)
    if not configured:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        configured = tempfile.mkdtemp(prefix="binscore-ckpt-")
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir() or configured


def scratch_dir(spark: SparkSession, name: str) -> str:
    """A fresh sub-folder of the shared checkpoint folder for one job."""
    root = checkpoint_dir(spark)
    if root.startswith("file:"):
        root = root[len("file:"):]
    return os.path.join(root, "binscore", f"{name}-{uuid.uuid4().hex[:12]}")


def clear_scratch(spark: SparkSession) -> bool:
    """Delete this session's staged folders (all ``scratch_dir`` gave out, and
    tables staged beside them), by the engine's file API.  For the end of a job:
    DataFrames that read them no longer work afterwards.  True if there were any."""
    root = spark._jvm.org.apache.hadoop.fs.Path(checkpoint_dir(spark))
    store = root.getFileSystem(spark._jsc.hadoopConfiguration())
    found = [s.getPath() for s in store.listStatus(root) if s.getPath().getName() == "binscore" or s.getPath().getName().startswith("llm-")]
    return any([store.delete(path, True) for path in found])


def cut_lineage(df):
    """Materialise ``df`` in the shared checkpoint folder and return a
    DataFrame that reads it back: later consumers (and recomputation after
    a lost executor) start from the written files, not from the sources.
    Used for small derived tables that several statistics consume."""
    from pyspark import StorageLevel
    checkpoint_dir(df.sparkSession)
    # an eager checkpoint runs one job to compute and another to write the
    # files; persisting first makes the second read the first's blocks
    cached = df.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        return cached.checkpoint(eager=True)
    finally:
        cached.unpersist()


def release_shuffles(spark: SparkSession) -> None:
    """Have the files of shuffles that nothing refers to any more deleted.  Spark
    does so when the driver's JVM next collects garbage, which may be long after
    the next large shuffle, and it refers to the last query until another ends."""
    import gc
    gc.collect()
    spark.range(1).count()
    spark._jvm.java.lang.System.gc()


_SHIPPED: set = set()


def ship_package(spark: SparkSession) -> None:
    """Make ``binscore`` importable by the Python workers (pandas UDFs and
    ``mapInPandas`` functions are pickled by reference): zip the package
    once and add it with ``addPyFile``, once per SparkContext."""
    import zipfile
    sc = spark.sparkContext
    key = sc.applicationId
    if key in _SHIPPED:
        return
    pkg = os.path.dirname(os.path.abspath(__file__))
    root = os.path.dirname(pkg)
    out = os.path.join(tempfile.mkdtemp(prefix="binscore-pkg-"), "binscore.zip")
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as zf:
        for folder, _, names in os.walk(pkg):
            for n in names:
                if n.endswith(".py"):
                    full = os.path.join(folder, n)
                    zf.write(full, os.path.relpath(full, root))
    sc.addPyFile(out)
    _SHIPPED.add(key)
