"""Session helpers: defaults for a local session, and tables written to the cluster's shared folder."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

#: Defaults of local_session(); a cluster's own settings are never overridden.
LOCAL_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.sql.shuffle.partitions": "8",
    "spark.driver.memory": "8g",
}


def local_session(cores: int | str = "*", **conf: str) -> SparkSession:
    """A local session for tests, the bench and interactive use."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName("textloom")
    for key, value in (LOCAL_CONF | conf).items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ship_package(spark: SparkSession) -> None:
    """Send the package to the workers where they can't import it from their path or working folder."""
    root = Path(__file__).resolve().parents[1]
    paths = [Path(p).resolve() for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p]
    app = spark.sparkContext.applicationId
    if root in paths or Path.cwd() == root or app in _shipped:
        return
    _shipped.add(app)
    folder = tempfile.mkdtemp(prefix="textloom-zip-")
    atexit.register(shutil.rmtree, folder, True)
    with zipfile.ZipFile(f"{folder}/textloom.zip", "w") as z:
        for f in [*root.glob("textloom/**/*.py"), *root.glob("corpus_pipeline.py")]:
            z.write(f, f.relative_to(root))
    spark.sparkContext.addPyFile(f"{folder}/textloom.zip")


_shipped: set[str] = set()


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a temporary one where it is unset and the session is local."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        path = _local_default(spark)
    return path.rstrip("/")


_defaults: dict[str, str] = {}


def _local_default(spark: SparkSession) -> str:
    context = spark.sparkContext
    if not context.master.startswith("local") or context.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    app = context.applicationId
    if app not in _defaults:
        made = tempfile.mkdtemp(prefix="textloom-")
        atexit.register(shutil.rmtree, made, True)
        _defaults[app] = f"file://{made}"
    return _defaults[app]


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing else uses."""
    return f"{shared_dir(spark)}/textloom/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str, stays: bool = False) -> DataFrame:
    """Cut the lineage: write df as a table in the shared folder and read it back.

    Any executor can read the result again after another is lost, and what follows doesn't recompute df. In a block of
    temporary() the table is deleted with the block, unless it stays.
    """
    spark = df.sparkSession
    path = fresh_path(spark, name)
    tables = _tables.get()
    if tables is not None and not stays:
        tables.append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def scratch(df: DataFrame, name: str) -> Iterator[DataFrame]:
    """materialise() whose table is deleted at the end of the block: what is used later must be written within it."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.parquet(path)
    try:
        yield spark.read.schema(df.schema).parquet(path)
    finally:
        _delete(spark, path)


_tables: ContextVar[list[str] | None] = ContextVar("tables", default=None)


@contextmanager
def temporary(spark: SparkSession) -> Iterator[None]:
    """The tables that materialise() writes within the block are deleted at its end, but those that stay."""
    tables: list[str] = []
    before = _tables.set(tables)
    try:
        yield
    finally:
        _tables.reset(before)
        for path in tables:
            _delete(spark, path)


def _delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
