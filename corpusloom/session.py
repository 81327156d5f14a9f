"""Session helpers shared by every layer: reading tables, cutting lineage, sizing broadcasts."""

from __future__ import annotations

import atexit
import io
import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession, functions as F

#: Rows times bytes above which a side is never hinted as a broadcast.
BROADCAST_BYTES = 32 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table; a single file or a folder of part files."""
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ship(spark: SparkSession) -> None:
    """Gives the package to the executors, once a session, as a zip in the shared folder; without it their Python workers find it only by chance."""
    sc = spark.sparkContext
    if getattr(sc, "_corpusloom_shipped", False):
        return
    here = os.path.dirname(os.path.abspath(__file__))
    if os.path.isdir(here):  # else it came as a zip itself
        packed = io.BytesIO()
        with zipfile.ZipFile(packed, "w", zipfile.ZIP_DEFLATED) as z:
            for folder, _, names in sorted(os.walk(here)):
                for n in sorted(names):
                    if n.endswith(".py"):
                        full = os.path.join(folder, n)
                        z.write(full, os.path.relpath(full, os.path.dirname(here)))
        path = f"{shared_dir(spark).rstrip('/')}/corpusloom-{sc.applicationId}.zip"
        target = sc._jvm.org.apache.hadoop.fs.Path(path)
        out = target.getFileSystem(sc._jsc.hadoopConfiguration()).create(target, True)
        out.write(bytearray(packed.getvalue()))
        out.close()
        sc.addPyFile(path)
    sc._corpusloom_shipped = True


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, as the cluster names it in spark.checkpoint.dir.

    Only where the setting is absent (tests, local runs) a temporary folder is set for this session.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    jvm_dir = spark.sparkContext._jsc.sc().getCheckpointDir()
    if jvm_dir.isDefined():
        return jvm_dir.get()
    local = "file://" + tempfile.mkdtemp(prefix="corpusloom-")
    spark.sparkContext.setCheckpointDir(local)
    return local


def cut(df: DataFrame, eager: bool = True) -> DataFrame:
    """Cut lineage with a reliable checkpoint in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager)


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder of the shared file system; one that is not there is no error."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def written_at(df: DataFrame, *by: str) -> str:
    """Writes a table to the shared folder, in folders by some columns, and gives its path. It is removed when the process ends."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/table-{uuid.uuid4().hex}"
    df.write.partitionBy(*by).parquet(path)
    atexit.register(_removed_at_end, spark, path)
    return path


def written(df: DataFrame) -> DataFrame:
    """Cut lineage with a written table in the shared folder: compressed, unlike a checkpoint, and read by column. It is removed when the process ends."""
    return df.sparkSession.read.schema(df.schema).parquet(written_at(df))


def arrow_uri(path: str) -> str:
    """A Hadoop path as Arrow names it: schemes of S3 are s3, a mounted dbfs is a file."""
    for scheme, own in (("s3a://", "s3://"), ("s3n://", "s3://"), ("dbfs:/", "file:///dbfs/")):
        if path.startswith(scheme):
            return own + path[len(scheme) :].lstrip("/")
    return path


def arrow_files(path: str) -> tuple:
    """Arrow's file system and the sorted names of a written table's files."""
    from pyarrow import fs

    at, root = fs.FileSystem.from_uri(arrow_uri(path))
    return at, sorted(x.path for x in at.get_file_info(fs.FileSelector(root, recursive=True)) if x.path.endswith(".parquet"))


def _removed_at_end(spark: SparkSession, path: str) -> None:
    try:
        remove(spark, path)
    except Exception:  # the session ended before the process
        pass


def maybe_broadcast(df: DataFrame, rows: int, row_bytes: int, limit: int = BROADCAST_BYTES) -> DataFrame:
    """Hint a broadcast only if the counted rows fit the bound; beyond it the join shuffles."""
    return F.broadcast(df) if rows * row_bytes <= limit else df
