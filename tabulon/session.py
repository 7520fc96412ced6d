"""Spark session helper.

On a cluster the session already exists and carries the cluster's settings;
``get_spark`` only fills in what is unset, so tests and local runs get sane
defaults without overriding production configuration.
"""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

_DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def get_spark(master: str | None = None, shuffle_partitions: int | None = None,
              app_name: str = "tabulon") -> SparkSession:
    """Return the active session, or build a local one with our defaults."""
    active = SparkSession.getActiveSession()
    if active is not None:
        ensure_checkpoint_dir(active)
        return active
    master = master or os.environ.get("TABULON_MASTER", "local[8]")
    builder = SparkSession.builder.master(master).appName(app_name)
    for k, v in _DEFAULTS.items():
        builder = builder.config(k, v)
    builder = builder.config("spark.driver.memory", os.environ.get("TABULON_DRIVER_MEM", "16g"))
    builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions or 8))
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Use the cluster's shared ``spark.checkpoint.dir``; when it is unset, a local run
    (driver and executors in one process) gets a fresh scratch folder and any other
    master raises, because no folder of one machine is seen by the others."""
    conf_dir = spark.conf.get("spark.checkpoint.dir", None)
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    if conf_dir:
        sc.setCheckpointDir(conf_dir)
        return conf_dir
    if not is_local(sc.master):
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    local = tempfile.mkdtemp(prefix="tabulon-ckpt-", dir="/tmp")
    delete_on_exit(spark, f"file://{local}")
    spark.conf.set("spark.checkpoint.dir", local)
    sc.setCheckpointDir(local)
    return local


def is_local(master: str) -> bool:
    """One process for driver and executors (``local-cluster`` is not)."""
    return master == "local" or master.startswith("local[")


def delete_on_exit(spark: SparkSession, path: str) -> None:
    """Have ``path`` deleted when the session's JVM ends."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(p)


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new path under the shared checkpoint folder, deleted when the session ends."""
    import uuid
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/tabulon-{name}-{uuid.uuid4().hex[:12]}"
    delete_on_exit(spark, path)
    return path


def reliable_checkpoint(df):
    """Checkpoint to the shared checkpoint folder, computing the plan once.

    ``Dataset.checkpoint`` evaluates its plan twice (once to count, once to
    write) unless the data is cached, so cache for the duration of the write."""
    from pyspark import StorageLevel
    ensure_checkpoint_dir(df.sparkSession)
    df.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        return df.checkpoint(eager=True)
    finally:
        df.unpersist()


def shared_table(df, name: str = "table"):
    """Write ``df`` as Parquet under the shared checkpoint folder and read it
    back: the lineage is cut like a checkpoint, and later passes that need a
    few columns read only those (column pruning, vectorised reader) instead
    of deserialising whole rows."""
    if "void" in df.schema.simpleString():
        # Parquet cannot hold an untyped all-null column.
        return reliable_checkpoint(df)
    path = shared_folder(df.sparkSession, name)
    df.write.mode("error").parquet(path)
    return df.sparkSession.read.parquet(path)


def small_frame(df):
    """Materialise a result known to be tiny (one row per column or per
    group of a few) as a local relation: one job, no recomputation later."""
    return local_frame(df.sparkSession, df.collect(), df.schema)


def local_frame(spark, rows, schema):
    """A small driver-side table as a JVM local relation (Arrow path), so
    later jobs that read it start no Python workers."""
    import pandas as pd
    from pyspark.sql.types import StructType
    if isinstance(schema, str):
        schema = StructType.fromDDL(schema)
    rows = [tuple(r) for r in rows]
    if not rows:
        return spark.createDataFrame([], schema)
    if spark.conf.get("spark.sql.execution.arrow.pyspark.enabled", "false").lower() != "true":
        return spark.createDataFrame(rows, schema)
    pdf = pd.DataFrame({f.name: pd.Series([r[i] for r in rows], dtype=object)
                        for i, f in enumerate(schema.fields)})
    from pyspark.sql import types as T
    nullable = {T.DoubleType: "Float64", T.FloatType: "Float32", T.LongType: "Int64",
                T.IntegerType: "Int32", T.ShortType: "Int16", T.BooleanType: "boolean"}
    for f in schema.fields:
        kind = nullable.get(type(f.dataType))
        if kind:
            # Nullable pandas dtypes keep None as null (not NaN) through Arrow.
            pdf[f.name] = pd.array([None if v is None else v for v in pdf[f.name].tolist()], dtype=kind)
        elif pdf[f.name].isna().all():
            pdf[f.name] = pd.Series([None] * len(pdf), dtype=object)
    return spark.createDataFrame(pdf, schema)
