"""Session defaults, worker import path and the shared scratch folder."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

ARROW_BATCH, ARROW_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch", 2000
ARROW_SIZE, ARROW_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", str(8 << 20)
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: so that Python workers return freed memory to the system
WORKER_ENV = {"MALLOC_ARENA_MAX": "2", "MALLOC_MMAP_THRESHOLD_": "2097152", "MALLOC_TRIM_THRESHOLD_": "4194304", "ARROW_DEFAULT_MEMORY_POOL": "system"}
ROOT = str(Path(__file__).resolve().parent.parent)


def session(app: str = "tessera", cores: str = "*", **conf: str) -> SparkSession:
    """A local session with the defaults that the operators expect (UTC, AQE)."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def ship(spark: SparkSession) -> None:
    """Prepare a session for operators with Python stages.

    Workers that run beside this checkout can import the package (on a cluster it comes
    with ``--py-files`` or the image; the extra path entry is harmless there). Where the
    session does not say how many rows and bytes an Arrow batch has, it is at most
    ``ARROW_ROWS`` and about ``ARROW_BYTES``: rows hold whole texts or packed arrays, and a
    batch stands in the memory of both processes.
    """
    for key, value in ((ARROW_BATCH, str(ARROW_ROWS)), (ARROW_SIZE, ARROW_BYTES)):
        if spark.conf.get(key, None) is None:
            spark.conf.set(key, value)
    env = spark.sparkContext.environment
    for key, value in WORKER_ENV.items():
        env.setdefault(key, value)
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if ROOT not in paths:
        env["PYTHONPATH"] = os.pathsep.join([ROOT, *paths])


def scratch_dir(spark: SparkSession) -> str:
    """The folder for written tables: ``spark.checkpoint.dir``, shared by all.

    Only where that is unset and the session runs in one process, as in tests, a
    temporary folder is made and set as the checkpoint directory; on a cluster the setting
    is required, since its machines do not share such a folder.
    """
    sc = spark.sparkContext
    base = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        base = sc.getCheckpointDir()
    if not base:
        if not (sc.master == "local" or sc.master.startswith("local[")):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        own = tempfile.mkdtemp(prefix="tessera-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
        base = f"file://{own}"
        sc.setCheckpointDir(base)
    return f"{base.rstrip('/')}/tessera-{sc.applicationId}"


_registered: set[str] = set()


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # the session may be gone already; the folder is only scratch
        pass


def release(spark: SparkSession) -> None:
    """Delete every table that :func:`materialize` wrote in this application."""
    _remove(spark, scratch_dir(spark))


def new_table_path(spark: SparkSession, name: str) -> str:
    base = scratch_dir(spark)
    if base not in _registered:
        _registered.add(base)
        atexit.register(_remove, spark, base)
    return f"{base}/{name}-{uuid.uuid4().hex[:12]}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: the lineage is
    cut, and a lost executor costs a file read, not a recomputation. The shuffle files of
    the write have served then, and Spark removes them."""
    spark = df.sparkSession
    path = new_table_path(spark, name)
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    table = spark.read.schema(df.schema).parquet(path)
    table._written_to = path
    return table


def drop(table: DataFrame) -> None:
    """Delete the files of a table that :func:`materialize` returned and nothing reads any more."""
    _remove(table.sparkSession, table._written_to)


def _file(spark: SparkSession, path: str) -> tuple:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def read_text(spark: SparkSession, path: str) -> str | None:
    """A small text file of any file system that Spark reaches; None where there is none."""
    fs, p = _file(spark, path)
    if not fs.exists(p):
        return None
    stream = fs.open(p)
    try:
        return spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def _put(spark: SparkSession, path: str, text: str, replace: bool) -> bool:
    """Write a file beside its place and put it there in one step: no reader sees a part,
    and a writer that dies leaves what was there."""
    fs, p = _file(spark, path)
    part = p.getParent().suffix(f"/.{p.getName()}.{uuid.uuid4().hex[:8]}")
    fs.mkdirs(p.getParent())
    stream = fs.create(part, True)
    try:
        stream.write(bytearray(text, "utf-8"))
    finally:
        stream.close()
    try:
        if fs.getScheme() == "file":
            try:
                (os.replace if replace else os.link)(part.toUri().getPath(), p.toUri().getPath())
            except FileExistsError:
                return False
            return True
        jvm = spark.sparkContext._jvm
        options = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
        options[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE if replace else jvm.org.apache.hadoop.fs.Options.Rename.NONE
        try:
            jvm.org.apache.hadoop.fs.FileContext.getFileContext(p.toUri(), spark.sparkContext._jsc.hadoopConfiguration()).rename(part, p, options)
        except Exception as failure:
            if not replace and fs.exists(p):
                return False
            raise OSError(f"cannot write {path}") from failure
        return True
    finally:
        fs.delete(part, False)


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """Write a small text file, in place of one that is there."""
    _put(spark, path, text, True)


def put_if_absent(spark: SparkSession, path: str, text: str) -> bool:
    """Write a small text file where none is; False where one is already."""
    return _put(spark, path, text, False)


def list_names(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder; none where there is no folder."""
    fs, p = _file(spark, path)
    return sorted(x.getPath().getName() for x in fs.listStatus(p)) if fs.exists(p) else []
