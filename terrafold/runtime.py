"""Session helpers shared by every subpackage: shipping code, shared scratch tables."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

#: Bytes of an Arrow batch: it is held once in the JVM and once in Python.
BATCH_BYTES = "8m"
#: Bytes of a row group of written tables: an open writer holds one.
ROW_GROUP_BYTES = 16 << 20

_PACKAGE = Path(__file__).resolve().parent
_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers, once for each application.

    Executors need not have the repository on their path. Batches of texts stay
    small: the default of Spark is set to BATCH_BYTES where nobody changed it.
    """
    limit = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(limit, None) == "67108864b":
        spark.conf.set(limit, BATCH_BYTES)
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    archive = os.path.join(tempfile.mkdtemp(prefix="terrafold-"), "terrafold.zip")
    with zipfile.ZipFile(archive, "w") as z:
        for p in sorted(_PACKAGE.rglob("*.py")):
            z.write(p, p.relative_to(_PACKAGE.parent).as_posix())
    spark.sparkContext.addPyFile(archive)
    _shipped.add(app)


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir``.

    Only where that is unset on a local master, as in tests, a temporary one is made.
    """
    own = spark.conf.get("spark.checkpoint.dir", None)
    if not own:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        own = tempfile.mkdtemp(prefix="terrafold-shared-")
        spark.conf.set("spark.checkpoint.dir", own)
    return own.rstrip("/")


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it again.

    Cuts the lineage; survives the loss of executors. The files go when
    ``release`` is called or the application ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/terrafold/{name}-{uuid.uuid4().hex}"
    df.write.option("parquet.block.size", ROW_GROUP_BYTES).parquet(path)
    where, files = _path(spark, path)
    files.deleteOnExit(where)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_to = path
    return out


def _path(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark._jsc.hadoopConfiguration())


def release(*tables: DataFrame) -> None:
    """Delete tables that ``materialise`` wrote; others are left alone. Nothing may read them afterwards."""
    for df in tables:
        if path := getattr(df, "written_to", None):
            where, files = _path(df.sparkSession, path)
            files.delete(where, True)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
