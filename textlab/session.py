"""Spark session defaults and shared-storage helpers."""

from __future__ import annotations

import contextlib
import contextvars
import os
import re
import tempfile
import uuid

from pyspark.sql import SparkSession


def get_spark(master: str | None = None, shuffle_partitions: int | None = None,
              app_name: str = "textlab") -> SparkSession:
    """Session with the settings the library assumes.

    On a cluster the master, memory and checkpoint directory come from the
    submit configuration; only unset values are filled in here.
    """
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    n = shuffle_partitions or os.environ.get("TEXTLAB_SHUFFLE_PARTITIONS") or (8 if (master or "").startswith("local") else None)
    if n:       # else the cluster's own value holds
        builder = builder.config("spark.sql.shuffle.partitions", str(n))
    builder = (
        builder
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    if master and master.startswith("local"):
        builder = builder.config("spark.driver.memory", os.environ.get("TEXTLAB_DRIVER_MEM", "16g"))
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint directory named by the cluster.

    ``spark.checkpoint.dir`` is read from the session. Where it is unset, a
    run in one process (local mode, tests) gets a private scratch directory;
    a cluster gets an error, as its executors do not share such a directory.
    """
    sc = spark.sparkContext
    d = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if not d:
        if not re.match(r"local($|\[)", sc.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        d = _SCRATCH.setdefault(sc.applicationId, None) or tempfile.mkdtemp(prefix="textlab-ckpt-")
        _SCRATCH[sc.applicationId] = d
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(d)
    return d


def materialize(df, name: str = "t", compression: str | None = None):
    """Write ``df`` as parquet under the shared checkpoint directory and read it back.

    Cuts the lineage (later passes and retried tasks read files, not the
    upstream plan) and runs the upstream plan exactly once -- unlike an eager
    ``Dataset.checkpoint``, which evaluates it twice when not cached.
    """
    spark = df.sparkSession
    base = ensure_checkpoint_dir(spark).rstrip("/")
    path = f"{base}/tables/{name}-{uuid.uuid4().hex}"
    df.write.mode("overwrite").option("parquet.compression.codec.zstd.level", "1").parquet(path, compression=compression)
    _WRITTEN.setdefault(spark.sparkContext.applicationId, []).append(path)
    scope = _SCOPE.get()
    if scope is not None:
        scope.append(path)
    out = spark.read.parquet(path)
    out.written_path = path
    return out


_WRITTEN: dict = {}
_SCRATCH: dict = {}
_SCOPE: contextvars.ContextVar = contextvars.ContextVar("textlab_tables", default=None)


@contextlib.contextmanager
def table_scope():
    """The paths of the tables that ``materialize`` writes inside the block, as a list that fills up."""
    made: list[str] = []
    outer = _SCOPE.set(made)
    try:
        yield made
    finally:
        _SCOPE.reset(outer)
        if _SCOPE.get() is not None:
            _SCOPE.get().extend(made)


def drop_tables(spark, paths) -> int:
    """Delete written tables, which nothing may read any more; returns how many there were."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    known = _WRITTEN.get(spark.sparkContext.applicationId, [])
    n = 0
    for p in list(paths):
        path = jvm.org.apache.hadoop.fs.Path(p)
        n += bool(path.getFileSystem(conf).delete(path, True))
        if p in known:
            known.remove(p)
    return n


def release(*tables) -> None:
    """Delete the files behind results of ``materialize`` once whatever was computed from them is written too."""
    for t in tables:
        path = getattr(t, "written_path", None)
        if path is not None:
            drop_tables(t.sparkSession, [path])


def drop_written_tables(spark) -> int:
    """Delete the tables this application wrote under the checkpoint directory
    (through the Hadoop FileSystem API, so it works on any shared store)."""
    app = spark.sparkContext.applicationId
    n = drop_tables(spark, _WRITTEN.get(app, []))
    for k in [k for k in _STAGES if k[0] == app]:
        _STAGES.pop(k, None)
    return n


_STAGES: dict = {}


def stage_table(spark, key: str, build):
    """Session-scoped stage table: ``build()`` is written once (see ``materialize``)
    and every later request for ``key`` reads the written files.

    Used for pipeline stage outputs (e.g. the cleaned corpus) that several
    reports read; it also keeps the optimizer from pushing filters below an
    expensive projection and re-evaluating it inside the filter.
    """
    k = (spark.sparkContext.applicationId, key)
    if k not in _STAGES:
        # texts and ids: the codec that takes less room
        _STAGES[k] = materialize(build(), key.replace("/", "_").replace(":", "_")[-60:], "zstd")
    return _STAGES[k]


def has_stage(spark, key: str) -> bool:
    """Whether the stage table ``key`` is written already."""
    return (spark.sparkContext.applicationId, key) in _STAGES


_SHIPPED: set = set()


def ship_package(spark) -> None:
    """Make ``textlab`` importable on executors (UDFs are pickled by module
    reference): zip the package once per application and ``addPyFile`` it."""
    import zipfile

    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    ensure_checkpoint_dir(spark)
    root = os.path.dirname(os.path.abspath(__file__))
    base = os.path.dirname(root)
    out = os.path.join(tempfile.mkdtemp(prefix="textlab-py-"), "textlab.zip")
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for d, _, files in os.walk(root):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(d, f)
                    z.write(full, os.path.relpath(full, base))
    spark.sparkContext.addPyFile(out)
    _SHIPPED.add(app)


class conf_override:
    """Temporarily set SQL confs on the session (restored on exit), e.g. AQE off
    for an iterative loop of many tiny jobs where re-planning only adds latency."""

    def __init__(self, spark, confs: dict):
        self.spark, self.confs, self.prev = spark, dict(confs), {}

    def __enter__(self):
        for k, v in self.confs.items():
            self.prev[k] = self.spark.conf.get(k, None)
            self.spark.conf.set(k, v)
        return self

    def __exit__(self, *exc):
        for k, v in self.prev.items():
            if v is None:
                self.spark.conf.unset(k)
            else:
                self.spark.conf.set(k, v)
        return False


def partitions_for(spark, n_rows: int, rows_per_partition: int) -> int:
    """Partitions for a CPU-bound table: by row count, rounded up to a multiple
    of the cores so no stage ends with a half-empty extra wave."""
    cores = max(1, spark.sparkContext.defaultParallelism)
    need = max(1, -(-n_rows // rows_per_partition))
    return -(-need // cores) * cores
