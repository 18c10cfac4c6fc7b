"""The folder that driver and executors share, and tables written there to cut lineage."""

from __future__ import annotations

import tempfile
import uuid
from weakref import WeakKeyDictionary

from pyspark.sql import DataFrame, SparkSession

#: Where the tables of this session lie that ``materialise`` wrote and nobody has given back.
_written: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir, or a folder of our own where that is unset and the session is local (tests)."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        where = "file://" + tempfile.mkdtemp(prefix="sparkloom-")
        spark.conf.set("spark.checkpoint.dir", where)
    return f"{where}/{spark.sparkContext.applicationId}"


def materialise(df: DataFrame, name: str, instead_of: tuple[DataFrame, ...] = ()) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: the lineage ends there and a lost executor loses nothing before it.

    Tables that the new one takes the place of (``instead_of``) are deleted once it stands.
    """
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    _written[out] = path
    release(*instead_of)
    return out


def release(*tables: DataFrame) -> None:
    """Delete tables that ``materialise`` wrote and that no plan reads any more; other DataFrames are left alone."""
    for df in tables:
        if (path := _written.pop(df, None)) is not None:
            delete_folder(df.sparkSession, path)


def move_folder(spark: SparkSession, source: str, target: str) -> bool:
    """Rename a file or folder, if it is there, on any file system that Spark can write to."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    where = hadoop.Path(source)
    files = where.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(where):
        return False
    if not files.rename(where, hadoop.Path(target)):
        raise OSError(f"{source} could not be renamed to {target}")
    return True


def exists(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def list_folder(spark: SparkSession, path: str) -> list[str]:
    """Names of what lies in a folder on any file system that Spark can write to; none if there is no such folder."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = where.getFileSystem(spark._jsc.hadoopConfiguration())
    return sorted(x.getPath().getName() for x in files.listStatus(where)) if files.exists(where) else []


def delete_folder(spark: SparkSession, path: str) -> None:
    """Delete a folder on any file system that Spark can write to."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
