"""Session set-up and the one shared working folder.

Jobs here never use localCheckpoint or a machine-local folder on a cluster: an
executor that is lost takes both with it. Lineage is cut with ``checkpoint()`` or
a written table inside the folder named by ``spark.checkpoint.dir``.
"""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import NullType

#: Largest k of a top-k per group that Spark cuts below the shuffle; larger ones use a distributed sort.
HEAD_LIMIT = 10_000

#: Settings the operators rely on. Only run-time (not static) options, so they can be
#: applied to a session somebody else created.
RUNTIME_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.optimizer.windowGroupLimitThreshold": str(HEAD_LIMIT),
    # what a Python worker is given at once: without, ten thousand texts or pages of any length
    "spark.sql.execution.arrow.maxRecordsPerBatch": "1000",
    "spark.sql.execution.arrow.maxBytesPerBatch": "4m",
}


def configure(spark: SparkSession) -> SparkSession:
    """Apply the run-time settings to ``spark`` and return it."""
    for key, value in RUNTIME_CONF.items():
        spark.conf.set(key, value)
    return spark


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach: ``spark.checkpoint.dir`` where the cluster names
    one. A temporary folder is used only for a local master, as in tests."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not named:
        current = sc.getCheckpointDir()
        if current:
            return current
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
        named = tempfile.mkdtemp(prefix="newsweave-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(named)
    return named


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path inside the shared folder for a table one job writes and reads back."""
    path = f"{shared_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"
    _WRITTEN.append(path)
    return path


#: Scratch paths that this process has given out and not removed.
_WRITTEN: list[str] = []


@contextmanager
def scratch_removed(spark: SparkSession):
    """Remove the scratch tables that are made inside, at its end. Results must be written by then: they may be read from such tables.

        with scratch_removed(spark):
            feeds.personalized_digest(t).write.parquet(target)
    """
    before = len(_WRITTEN)
    try:
        yield
    finally:
        for path in _WRITTEN[before:]:
            folder = spark._jvm.org.apache.hadoop.fs.Path(path)
            folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
        del _WRITTEN[before:]


def cut_lineage(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder and read again. Unlike ``checkpoint()``, which computes a plan once to count and once to write,
    this computes it once."""
    if any(isinstance(f.dataType, NullType) for f in df.schema) or len(set(df.columns)) < len(df.columns):
        shared_dir(df.sparkSession)
        return df.checkpoint(eager=True)
    path = scratch_path(df.sparkSession, "cut")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
