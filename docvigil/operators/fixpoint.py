"""Folders and tables that are written between the rounds of an iteration."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster shares, as ``spark.checkpoint.dir`` names it. Only on a local master a
    folder of this machine stands in for it; executors elsewhere would each write to their own disk."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    """A folder that does not exist yet on the storage that the cluster shares."""
    return f"{shared_folder(spark)}/docvigil-{name}-{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    """``df`` as Parquet on the folder that the cluster shares, read again: short lineage, one result."""
    path = new_folder(df.sparkSession, "round")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Rows that a task of a dealt table holds, on average.
SHARE = 250_000


def dealt(df: DataFrame, *keys: str, rows: int | None = None, share: int | None = None) -> DataFrame:
    """``df`` dealt out by ``keys`` to as many partitions as keep each at about ``share`` (``SHARE``) rows.

    Spark sizes partitions by their compressed bytes, but sorts hold whole rows, of which well compressed ones
    may be ten or thirty times as large; so what a task holds would grow with the table up to that size.
    ``rows``: how many there are, where the caller knows; else they are counted.
    """
    n = df.count() if rows is None else rows
    return df.repartition(max(df.sparkSession.sparkContext.defaultParallelism, -(-n // (share or SHARE))), *keys)


def forget(*tables: DataFrame) -> None:
    """Delete the folders of written tables that nothing reads any more; other tables stay."""
    for t in tables:
        jvm, conf = t.sparkSession._jvm, t.sparkSession._jsparkSession.sessionState().newHadoopConf()
        for folder in {f.rsplit("/", 1)[0] for f in t.inputFiles()}:
            if folder.rsplit("/", 1)[-1].startswith("docvigil-"):
                path = jvm.org.apache.hadoop.fs.Path(folder)
                path.getFileSystem(conf).delete(path, True)
