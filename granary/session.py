"""Session defaults, the shared working folder, and tables written into it."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession



def local_session(cores: int | str = "*", shuffle_partitions: int = 8, app: str = "granary") -> SparkSession:
    """A session for tests and benches on one machine. Clusters bring their own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``; where it is unset, a temporary one on a local master and an error on a cluster."""
    context = spark.sparkContext
    named = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    current = context._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return str(current.get()).rstrip("/")
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    made = "file://" + tempfile.mkdtemp(prefix="granary-")
    context.setCheckpointDir(made)
    return made


def materialize(df: DataFrame, what: str = "table", partition_by: list[str] | None = None) -> DataFrame:
    """Write ``df`` once into the shared folder and read it back.

    It cuts the lineage and survives the loss of executors. The table is Parquet, so
    later reads prune columns and know the size. It goes when the application ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/granary/{what}-{uuid.uuid4().hex}"
    writer = df.write.mode("overwrite")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    _file_system(spark, path)[0].deleteOnExit(_file_system(spark, path)[1])
    return spark.read.schema(df.schema).parquet(path)


def drop_materialized(spark: SparkSession) -> None:
    """Delete the tables :func:`materialize` has written below the shared folder."""
    system, path = _file_system(spark, f"{shared_dir(spark)}/granary")
    system.delete(path, True)


def _file_system(spark: SparkSession, path: str):
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), hadoop


# Small files beside tables, wherever the paths lead -------------------------------------------


def _plain(spark: SparkSession, path: str):
    """The file system without checksum files beside what is written: small files may be edited by hand."""
    system, target = _file_system(spark, path)
    return (system.getRawFileSystem() if system.getScheme() == "file" else system), target


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """Write a small file whole or not at all: under another name first, then renamed."""
    system, target = _plain(spark, path)
    system.mkdirs(target.getParent())
    part = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}.{uuid.uuid4().hex[:8]}")
    out = system.create(part, True)
    out.write(bytearray(text.encode()))
    out.close()
    if system.exists(target):
        system.delete(target, False)
    if not system.rename(part, target):
        raise OSError(f"cannot write {path}")


def read_text(spark: SparkSession, path: str) -> str:
    system, target = _plain(spark, path)
    if not system.exists(target):
        raise FileNotFoundError(path)
    stream = system.open(target)
    try:
        return spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def names_in(spark: SparkSession, path: str) -> list[str]:
    """Names of what lies in a folder, in order; none if there is no folder."""
    system, target = _plain(spark, path)
    if not system.exists(target) or not system.getFileStatus(target).isDirectory():
        return []
    return sorted(x.getPath().getName() for x in system.listStatus(target))


def newest_change(spark: SparkSession, path: str) -> float | None:
    """When the last file of a folder, hidden ones aside, was written, in seconds since 1970."""
    system, target = _file_system(spark, path)
    files = [x for x in system.listStatus(target) if x.getPath().getName()[0] not in "._"] if system.exists(target) else []
    return max((x.getModificationTime() / 1000 for x in files), default=None)


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Give the Python workers this package, wherever they run; once per application."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    root = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="granary-")) / "granary.zip"
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f.relative_to(root.parent))
    context.addPyFile(str(archive))
    _shipped.add(context.applicationId)


def read(spark: SparkSession, folder: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{table}.parquet")
