"""The shared folder: where intermediate tables and files go so that any executor can read them again."""

from __future__ import annotations

import atexit
import contextlib
import os
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}
#: Folders that this process has made in the shared folder and not yet removed.
made: list[str] = []
_shipped: set[str] = set()


def _in_one_process(spark: SparkSession) -> bool:
    master = spark.sparkContext.master
    return master.startswith("local") and not master.startswith("local-cluster")


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session. Where it is unset, a folder of our own, in local mode only."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not _in_one_process(spark):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own:
        made = tempfile.mkdtemp(prefix="wardcraft-")
        atexit.register(shutil.rmtree, made, ignore_errors=True)
        _own[app] = f"file://{made}"
    return _own[app]


def new_folder(spark: SparkSession, name: str) -> str:
    """A folder name in the shared folder that nothing else uses. It goes when this process ends, unless it was removed before."""
    if not made:
        conf, path = spark.sparkContext._jsc.hadoopConfiguration(), spark._jvm.org.apache.hadoop.fs.Path
        atexit.register(_remove_made, conf, path)
    folder = f"{shared_dir(spark)}/wardcraft/{name}-{uuid.uuid4().hex}"
    made.append(folder)
    return folder


def _remove_made(conf, path) -> None:
    with contextlib.suppress(Exception):  # the JVM may have gone before
        for folder in made:
            where = path(folder)
            where.getFileSystem(conf).delete(where, True)
    made.clear()


def ship_code(spark: SparkSession) -> None:
    """Give the executors this package, for clusters on which it isn't installed. Once per application."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    _shipped.add(app)
    root = Path(__file__).resolve().parent.parent
    made = os.path.join(tempfile.mkdtemp(prefix="wardcraft-code-"), "wardcraft.zip")
    atexit.register(shutil.rmtree, os.path.dirname(made), ignore_errors=True)
    with zipfile.ZipFile(made, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
    spark.sparkContext.addPyFile(made)


def materialise(spark: SparkSession, df: DataFrame, name: str) -> DataFrame:
    """Write df once as a Parquet table in the shared folder and read it back: lineage ends here."""
    folder = new_folder(spark, name)
    df.write.option("compression", "zstd").parquet(folder)
    out = spark.read.schema(df.schema).parquet(folder)
    out._wardcraft_folder = folder
    return out


def remove(spark: SparkSession, *tables: DataFrame | str) -> None:
    """Delete folders, or the tables that materialise returned, once nothing will read them again."""
    for table in tables:
        folder = table if isinstance(table, str) else table._wardcraft_folder
        if folder in made:
            made.remove(folder)
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
