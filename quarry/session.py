"""Session construction and shared-folder handling.

On a cluster the session comes from the launcher; ``get_session`` only fills in
settings that are still unset.  Materialised intermediate tables (index,
collections, lineage cuts) go under ``spark.checkpoint.dir`` -- the shared
folder the cluster names.  Only when that setting is absent (local tests) do we
create one of our own.
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession

DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def get_session(master: str | None = None, shuffle_partitions: int | None = None,
                app_name: str = "quarry", extra: dict | None = None) -> SparkSession:
    """A session; of a running one only settings that have no value are filled in."""
    conf = dict(DEFAULTS)
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    spark = SparkSession.getActiveSession()
    if spark is not None:
        for k, v in conf.items():
            if spark.conf.get(k, None) is None:
                spark.conf.set(k, v)
    else:
        builder = SparkSession.builder.appName(app_name)
        if master:
            builder = builder.master(master)
        for k, v in conf.items():
            builder = builder.config(k, v)
        spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    ship_package(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder, creating a local one only if unset."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get(
        "spark.checkpoint.dir", None)
    if not configured:      # unset: local runs and tests only
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and "
                             "all executors share")
        configured = tempfile.mkdtemp(prefix="quarry-ckpt-")
        spark.conf.set("spark.checkpoint.dir", configured)
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir() or configured


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh, unique path under the shared checkpoint folder."""
    base = ensure_checkpoint_dir(spark)
    return os.path.join(base, f"{name}-{uuid.uuid4().hex[:12]}")


def materialize(df, name: str, compression: str | None = None):
    """Write ``df`` as parquet under the shared folder and read it back: cuts the
    lineage (a lost executor re-reads files instead of recomputing the plan) and
    lets several consumers share one computation."""
    path = shared_path(df.sparkSession, name)
    writer = df.write.mode("overwrite")
    (writer.option("compression", compression) if compression else writer).parquet(path)
    return df.sparkSession.read.parquet(path)


def index_dir(spark: SparkSession) -> str:
    """Folder of the indexes that outlive a session: ``spark.quarry.indexDir``, else a folder of
    its own under the shared checkpoint folder (which is the same for every application)."""
    ensure_checkpoint_dir(spark)
    named = spark.conf.get("spark.quarry.indexDir", None)
    return named or os.path.join(spark.conf.get("spark.checkpoint.dir"), "quarry-index")


def is_complete(spark: SparkSession, path: str) -> bool:
    """Whether ``mark_complete`` was reached for what is stored at ``path``."""
    from pyspark.errors import AnalysisException
    try:
        spark.read.schema("done int").parquet(f"{path}/manifest").first()
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return False
    return True


def mark_complete(spark: SparkSession, path: str) -> None:
    """Written last, so a part of an index is never taken for the whole."""
    spark.createDataFrame([(1,)], "done int").coalesce(1).write.mode("overwrite").parquet(f"{path}/manifest")


_FINGERPRINTS: dict = {}


def input_signature(df) -> tuple:
    """Number and hash of (path, length, modification time) of the files the plan reads, from the
    ``binaryFile`` source with only metadata columns selected: one row to the driver."""
    from pyspark.sql import functions as F
    files = sorted(df.inputFiles())
    if not files:
        return ()
    meta = df.sparkSession.read.format("binaryFile").load(files)
    one = F.xxhash64("path", "length", "modificationTime").cast("decimal(38,0)")
    r = meta.agg(F.count(F.lit(1)), F.sum(one), F.sum("length")).first()
    return tuple(map(str, r))


def memo_fingerprint(df, compute):
    """A content fingerprint, computed once per session for the same plan over the same
    unchanged files; a plan that reads no files is computed every time."""
    signature = input_signature(df)
    if not signature:
        return compute()
    key = (df.semanticHash(), signature)
    if key not in _FINGERPRINTS:
        _FINGERPRINTS[key] = compute()
    return _FINGERPRINTS[key]


_SHIPPED: set = set()


def ship_package(spark: SparkSession) -> None:
    """Make ``quarry`` importable on every executor's Python workers (the Arrow
    kernels and the streaming state function are shipped by reference): zip the
    package once per application into the shared folder and ``addPyFile`` it."""
    import zipfile

    sc = spark.sparkContext
    app = sc.applicationId
    if app in _SHIPPED:
        return
    pkg_dir = os.path.dirname(os.path.abspath(__file__))
    root = os.path.dirname(pkg_dir)
    target = shared_path(spark, "quarry-pkg") + ".zip"
    local_target = target[len("file:"):] if target.startswith("file:") else target
    if "://" in local_target:
        # non-local shared storage: build locally, let Spark distribute it
        local_target = os.path.join(tempfile.mkdtemp(prefix="quarry-pkg-"), "quarry.zip")
    os.makedirs(os.path.dirname(local_target), exist_ok=True)
    with zipfile.ZipFile(local_target, "w", zipfile.ZIP_DEFLATED) as zf:
        for base, _, names in os.walk(pkg_dir):
            for n in names:
                if n.endswith(".py"):
                    full = os.path.join(base, n)
                    zf.write(full, os.path.relpath(full, root))
    sc.addPyFile(local_target)
    _SHIPPED.add(app)
