"""Intermediate tables in the cluster's shared folder (``spark.checkpoint.dir``).

They cut lineage and survive lost executors.  A table is deleted when the session
ends (Hadoop's delete-on-exit), or earlier with :func:`release`.
"""

from __future__ import annotations

import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

from tabulon.llm.batches import SLICE_BYTES
from tabulon.session import ensure_checkpoint_dir

#: Shuffle files of a finished write are of no further use; Spark deletes them at once.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: For a write whose tasks read texts: by rows alone an Arrow batch would hold 64 MB of them, in
#: the executor and again in its worker.
TEXT_BATCHES = {"spark__sql__execution__arrow__maxBytesPerBatch": str(SLICE_BYTES)}


def shared_path(spark: SparkSession, name: str) -> str:
    base = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{base}/tabulon-llm-{name}-{uuid.uuid4().hex[:12]}"


def _file_system(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


@contextmanager
def session_settings(spark: SparkSession, wanted: dict[str, str]):
    """Session settings for the queries planned inside."""
    before = {k: spark.conf.get(k, None) for k in wanted}
    try:
        for k, v in wanted.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


def materialise(df: DataFrame, name: str, **settings: str) -> DataFrame:
    """Write ``df`` to the shared folder and return the written table.  ``settings``:
    session settings for this write (dots as double underscores)."""
    spark = df.sparkSession
    path = shared_path(spark, name)
    with session_settings(spark, {_CLEANUP: "true"} | {k.replace("__", "."): v for k, v in settings.items()}):
        df.write.mode("error").parquet(path)
    fs, p = _file_system(spark, path)
    fs.deleteOnExit(p)
    out = spark.read.schema(df.schema).parquet(path)
    out._tabulon_path = path
    return out


def release(*tables: DataFrame) -> None:
    """Delete written tables that no later step reads."""
    for t in tables:
        path = getattr(t, "_tabulon_path", None)
        if path:
            fs, p = _file_system(t.sparkSession, path)
            fs.delete(p, True)
