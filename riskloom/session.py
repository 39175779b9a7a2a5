"""Session set-up and the shared folder that cuts lineage."""

from __future__ import annotations

import re
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_WRITTEN: ContextVar[list[str] | None] = ContextVar("written", default=None)


def local_session(cores: int | str = "*", partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A session for tests and benches; on a cluster the caller brings its own."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("riskloom")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    ship_package(spark)
    return spark


def ship_package(spark: SparkSession) -> None:
    """Send this package to the Python workers, which needn't have it installed or on their path."""
    context, name = spark.sparkContext, f"{__package__}-shipped.zip"
    if name in context._python_includes:
        return
    root = Path(__file__).resolve().parent
    path = Path(tempfile.mkdtemp(prefix="riskloom-")) / name
    with zipfile.ZipFile(path, "w") as archive:
        for file in sorted(root.rglob("*.py")):
            archive.write(file, file.relative_to(root.parent))
    context.addPyFile(str(path))


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor can reach, as the session names it.

    A local session without one gets a temporary folder; a cluster session without
    one is an error, since a machine-local path would not survive a lost executor.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder:
        return folder
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):  # local-cluster has executors of its own
        raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
    # The setting can't be changed once the session runs, so the context keeps the folder.
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="riskloom-"))
    return spark.sparkContext.getCheckpointDir()


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/riskloom-{name}-{uuid.uuid4().hex}"


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Delete the copies that ``write_out`` makes in this block when it ends.

    For runs whose results no longer read them: scores, models, collected tables.
    """
    paths: list[str] = []
    before = _WRITTEN.set(paths)
    try:
        yield
    finally:
        _WRITTEN.reset(before)
        for path in paths:
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def write_out(df: DataFrame, name: str = "stage", keep: bool = False) -> DataFrame:
    """Materialise ``df`` once as Parquet in the shared folder and read it back.

    Cuts the lineage, fixes anything a re-run could change (range boundaries), and
    lets later passes prune columns and filter at the scan. ``keep`` outlives ``scratch``.
    """
    path = fresh_path(df.sparkSession, name)
    if not keep and _WRITTEN.get() is not None:
        _WRITTEN.get().append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
