"""The index of a folder's documents, as an engine keeps it: built once a session, then read by every query.

Tables lie in the folder that driver and executors share (``spark.checkpoint.dir``; a local session without one uses /tmp). A
table is built again when the documents' files have changed.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

_BUILT: dict[tuple, str] = {}


def shared_folder(spark: SparkSession) -> str:
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = "file:///tmp/checkpoints"
    return root.rstrip("/")


def _stamp(spark: SparkSession, path: str) -> tuple:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = p.getFileSystem(spark._jsc.hadoopConfiguration())
    total = files.getContentSummary(p)
    return total.getLength(), total.getFileCount(), files.getFileStatus(p).getModificationTime()


def pieces(spark: SparkSession, source: str, size: int = 1 << 22) -> int:
    """Parts of about ``size`` bytes of the files of ``source``, for rows that grow after they are dealt out."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), _stamp(spark, source)[0] // size + 1)


def stored(spark: SparkSession, source: str, name: str, build: Callable[[], DataFrame]) -> DataFrame:
    """The table ``name`` made from the files of ``source``."""
    key = (spark.sparkContext.applicationId, source, name, _stamp(spark, source))
    if key not in _BUILT:
        path = f"{shared_folder(spark)}/docloom-index/{name}-{uuid.uuid4().hex}"
        build().write.parquet(path)
        _BUILT[key] = path
    return spark.read.parquet(_BUILT[key])


def spread(df: DataFrame) -> DataFrame:
    """``df`` over all cores where its files give fewer tasks than there are; texts are costly to tokenise, and one small
    file is one task. Larger inputs stay as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df._jdf.rdd().getNumPartitions() < cores else df
