"""Intermediate tables in the folder that driver and executors share."""
from __future__ import annotations

import gc
import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes of an Arrow batch: rows hold whole texts, and a task keeps a few batches in memory.
BATCH_ROWS, BATCH_BYTES = 500, 8 << 20


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session; a scratch folder only in local mode."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    from seqlab.session import checkpoint_dir
    return checkpoint_dir(spark).rstrip("/")


def written_at(df: DataFrame, label: str) -> tuple[DataFrame, str]:
    """Write ``df`` to the shared folder; the table as read back, and its path."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/llm-{spark.sparkContext.applicationId}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def written(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage, and survives lost executors."""
    return written_at(df, label)[0]


def dropped(spark: SparkSession, path: str) -> None:
    """Remove a table made by ``written_at`` that nothing reads any more."""
    if "/llm-" not in path:
        raise ValueError(f"not a table of this library: {path}")
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def collected(spark: SparkSession) -> None:
    """Let Spark remove the shuffle files of earlier steps: it does so when the driver collects what refers to them."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def bounded_batches(spark: SparkSession) -> None:
    """Lower the session's Arrow batches to ``BATCH_ROWS`` rows and ``BATCH_BYTES`` bytes, if they are larger."""
    rows = int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", "10000"))
    if not 0 < rows <= BATCH_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def with_text(df: DataFrame, keep: list[str], text: str) -> tuple[DataFrame, int]:
    """The kept columns and the text (once, if it is kept as well), and the text's place among them."""
    bounded_batches(df.sparkSession)
    if text in keep:
        return df.select(*keep), keep.index(text)
    return df.select(*keep, F.col(text).alias("__text")), len(keep)
