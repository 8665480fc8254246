"""Session construction for scripts and tests, and the checkpoint folder."""

from __future__ import annotations

import gc
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "linegrain", cpus: int | None = None) -> SparkSession:
    """A local session. On a cluster, pass in the session that spark-submit made."""
    n = cpus or os.cpu_count() or 4
    return (
        SparkSession.builder.master(f"local[{n}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(n))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named in spark.checkpoint.dir.

    Only a local session may fall back to a temporary folder: on a cluster a
    machine-local folder would be lost with its machine.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    named = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        named = tempfile.mkdtemp(prefix="linegrain-checkpoint-")
    sc.setCheckpointDir(named)
    return named


def cut(df: DataFrame) -> DataFrame:
    """Materialize ``df`` in the checkpoint folder and continue from there.

    Shuffle files of what lies before go once the driver drops what refers to
    them, hence the collection of garbage.
    """
    spark = df.sparkSession
    checkpoint_dir(spark)
    back = df.checkpoint(eager=True)
    del df
    gc.collect()
    spark.sparkContext._jvm.System.gc()
    return back


def stored(df: DataFrame) -> DataFrame:
    """The same as :func:`cut` for rows that hold long texts: compressed Parquet below the checkpoint folder.

    A checkpoint holds rows as they are in memory; and of files Spark knows the
    size when it plans a join.
    """
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark)}/stored-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    del df
    gc.collect()
    spark.sparkContext._jvm.System.gc()
    return back


def released(df: DataFrame) -> None:
    """Takes the files of :func:`stored` rows away, once all that reads them is stored itself."""
    spark = df.sparkSession
    folders = {f.rsplit("/", 1)[0] for f in df.inputFiles()}
    for folder in folders:
        if not folder.rsplit("/", 1)[-1].startswith("stored-"):
            raise ValueError(f"{folder} does not come from stored()")
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
