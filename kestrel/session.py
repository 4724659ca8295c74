"""Session helpers: building a local session for tests/bench, and a shared scratch folder.

Library code never sets cluster sizing knobs; it only reads the session.  Scratch data
(round trips through CSV, materialised indexes, streaming sources and sinks) goes under
the shared folder named by ``spark.checkpoint.dir`` so that it survives executor loss and
is visible to every executor.  Where that setting is unset, a session of one machine (master
``local[...]``) gets a folder of its own, removed when the process ends; on a cluster the missing
setting is an error, since executors would write to disks that nobody else can read.
"""

from __future__ import annotations

import atexit
import os
import shutil
import uuid

from pyspark.sql import SparkSession


def local_session(cpus: int | str = 8, shuffle_partitions: int | None = None, app: str = "kestrel") -> SparkSession:
    """A local session configured the way the tests and the benchmark expect."""
    parts = shuffle_partitions or (int(cpus) if str(cpus).isdigit() else 8)
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(parts))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "16g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return prepare(spark)


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder; a private one only for a session of a single machine."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if configured:
        sc.setCheckpointDir(configured)
    elif sc.master.startswith("local") and not sc.master.startswith("local-cluster"):
        own = f"/tmp/kestrel-scratch/{sc.applicationId}-{uuid.uuid4().hex[:8]}"
        atexit.register(shutil.rmtree, own, ignore_errors=True)
        sc.setCheckpointDir(own)
    else:
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return sc.getCheckpointDir()


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Make ``kestrel`` importable in every Python worker (pandas UDFs, ``mapInPandas`` and
    ``applyInPandas`` functions are pickled by reference to this package).

    The package is zipped once per application and registered with ``addPyFile`` -- the
    same mechanism as ``--py-files`` -- so executors on other machines fetch it from the
    driver.  The zip is written to the shared checkpoint folder when that is a local-style
    path, otherwise beside the process, in its working directory (Spark distributes it).
    """
    import zipfile

    sc = spark.sparkContext
    app = sc.applicationId
    if app in _SHIPPED:
        return
    pkg_dir = os.path.dirname(os.path.abspath(__file__))
    base = ensure_checkpoint_dir(spark)
    local_base = base[len("file:"):] if base.startswith("file:") else (base if base.startswith("/") else None)
    target_dir = os.path.join(local_base or os.getcwd(), ".kestrel-pkg")
    os.makedirs(target_dir, exist_ok=True)
    target = os.path.join(target_dir, f"kestrel-{uuid.uuid4().hex[:8]}.zip")
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        for root, _dirs, files in os.walk(pkg_dir):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(root, f)
                    z.write(full, os.path.join("kestrel", os.path.relpath(full, pkg_dir)))
    sc.addPyFile(target)
    _SHIPPED.add(app)


def prepare(spark: SparkSession) -> SparkSession:
    """Checkpoint folder plus package shipping: call once before running library queries."""
    ensure_checkpoint_dir(spark)
    ship_package(spark)
    return spark


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh, unique path under the shared checkpoint folder."""
    return f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def scratch_root(spark: SparkSession) -> str:
    """This application's part of the shared scratch folder."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/kestrel/{spark.sparkContext.applicationId}"


def release_scratch(spark: SparkSession) -> None:
    """Remove everything the application has materialised.  Call it when no result that was
    returned before is read any more (the end of a job, or between the queries of one)."""
    path = spark._jvm.org.apache.hadoop.fs.Path(scratch_root(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def materialize(df, name: str):
    """Write ``df`` once as a Parquet table under the shared scratch folder and read it back.

    For results that several branches of a plan read (so they are computed once) and to cut
    lineage: a lost executor re-reads the table instead of recomputing its whole history.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.mode("overwrite").parquet(path)
    stored = df.sparkSession.read.parquet(path)
    stored.stored_at = path
    return stored


_TIDY = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def settle(df, name: str):
    """``materialize``, for large steps of one query: the shuffle files of the writing job are removed when it ends, not when
    the driver happens to collect its garbage."""
    spark = df.sparkSession
    before = spark.conf.get(_TIDY, None)
    spark.conf.set(_TIDY, "true")
    try:
        return materialize(df, name)
    finally:
        spark.conf.unset(_TIDY) if before is None else spark.conf.set(_TIDY, before)


def discard(stored) -> None:
    """Remove the files of a frame from ``materialize`` or ``settle`` that nothing reads any more."""
    path = stored.sparkSession._jvm.org.apache.hadoop.fs.Path(stored.stored_at)
    path.getFileSystem(stored.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


#: Rows of an Arrow batch handed to Python.  Whole texts travel in these batches, so Spark's default of
#: 10,000 rows would be gigabytes for long documents.
ARROW_ROWS = 256
#: And their bytes, for batches of very long texts (a batch holds one row at least).
ARROW_BYTES = 8 << 20


def bounded_batches(spark: SparkSession) -> None:
    """Lower the session's Arrow batch length to ``ARROW_ROWS`` and ``ARROW_BYTES`` unless it already has lower ones.

    The setting stays: it is read when a returned (lazy) result is computed."""
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", ARROW_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", ARROW_BYTES)):
        now = spark.conf.get(key).removesuffix("b")
        if not (now.isdigit() and 0 < int(now) <= most):
            spark.conf.set(key, str(most))


def table_path(sf_dir: str, name: str) -> str:
    return os.path.join(sf_dir, f"{name}.parquet")


# Scans smaller than this are left alone even when they have few partitions.
SPREAD_MIN_BYTES = 4 * 1024 * 1024


def spread(df, key: str | None = None):
    """Deal a sizable scan that has fewer partitions than the cluster has cores evenly over them.

    Big inputs already arrive in many file splits, so this is a no-op at scale; it only
    matters for a few large files (a single-file table scans into one task per row group),
    where the text-heavy narrow stages that follow would otherwise use a few cores.
    The size comes from the optimizer's statistics (file sizes), no job is run.
    """
    spark = df.sparkSession
    parallelism = spark.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() >= parallelism:
        return df
    try:
        size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    except Exception:  # statistics not reachable (e.g. a remote session): leave the scan as it is
        return df
    if size < SPREAD_MIN_BYTES:
        return df
    return df.repartition(parallelism, key) if key else df.repartition(parallelism)


# Bytes of a partition that ``gather`` makes out of those of small files.
GATHER_BYTES = 32 * 1024 * 1024


def gather(df, scan):
    """Join the partitions of ``df``, narrow columns of a scan of many small files, which Spark fills as if each file had megabytes.

    Their rows stay where they are read (no shuffle).  Four partitions a core are left, or as many as have
    ``GATHER_BYTES`` of the files each; the size of ``scan`` comes from the optimizer's statistics, as in ``spread``.
    """
    least = 4 * df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() <= least:
        return df
    size = int(str(scan._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.coalesce(max(least, size // GATHER_BYTES))


def read_table(spark: SparkSession, sf_dir: str, name: str, spread_small_scans: bool = True):
    df = spark.read.parquet(table_path(sf_dir, name))
    return spread(df) if spread_small_scans else df
