"""What every module needs of the session: shared folder, table loading, shipping of the package."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession

_PACKAGE = os.path.dirname(os.path.abspath(__file__))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The driver table ``name`` under ``sf_dir``, through Spark's own reader."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir``, or one of our own where that is unset."""
    sc = spark.sparkContext
    set_dir = spark.conf.get("spark.checkpoint.dir", None)
    if set_dir is None and sc._jsc.sc().getCheckpointDir().isEmpty():
        own = tempfile.mkdtemp(prefix="pagelore-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
        sc.setCheckpointDir(f"file://{own}")
    elif sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(set_dir)
    return sc._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """``df`` computed once and written to the shared folder; partitions and their order stay as they are."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


#: A table that is known to be small is written in files of about so many rows, not in one for each partition.
FILE_ROWS = 250_000


def stored(df: DataFrame, name: str = "t", at_most: int | None = None) -> DataFrame:
    """``df`` written as a Parquet table in the shared folder and read again: narrow scans, known sizes.
    at_most: a known bound of its rows, which are narrow and come out of a shuffle; it sets the number of files."""
    spark = df.sparkSession
    df = df if at_most is None else df.coalesce(1 + at_most // FILE_ROWS)
    path = f"{shared_dir(spark)}/tables/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Arrow batches are cut at this size, so that a worker holds few long texts at a time.
BATCH_BYTES = ("spark.sql.execution.arrow.maxBytesPerBatch", "67108864b", "4194304b")


def ship(spark: SparkSession) -> None:
    """Give executors this package, once per context, as a zip that Spark serves to them; lower the size
    of Arrow batches unless the session sets one."""
    sc = spark.sparkContext
    if spark.conf.get(BATCH_BYTES[0], BATCH_BYTES[1]) == BATCH_BYTES[1]:
        spark.conf.set(BATCH_BYTES[0], BATCH_BYTES[2])
    if getattr(sc, "_pagelore_shipped", False):
        return
    folder = tempfile.mkdtemp(prefix="pagelore-zip-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    path = os.path.join(folder, "pagelore_pkg.zip")
    with zipfile.ZipFile(path, "w") as z:
        for at, _, names in os.walk(_PACKAGE):
            for n in names:
                if n.endswith(".py"):
                    full = os.path.join(at, n)
                    z.write(full, os.path.join("pagelore", os.path.relpath(full, _PACKAGE)))
    sc.addPyFile(path)
    sc._pagelore_shipped = True
