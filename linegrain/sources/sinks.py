"""Writers: one folder per table, one partition per run; summaries as JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_table(
    df: DataFrame, root: str, name: str, run_id: str, columns: list[str] | None = None,
    fmt: str = "parquet",
) -> str:
    """Write ``df`` as the ``run_id`` partition of table ``name``; a rerun replaces only that.

    The partition folder is written by itself, so an empty result replaces an
    older one too and keeps its schema.
    """
    shaped = df.select(*columns) if columns else df.drop("run_id")
    target = f"{root.rstrip('/')}/{name}"
    writer = shaped.write.mode("overwrite").format(fmt)
    if fmt == "csv":
        writer = writer.option("header", True)
    writer.save(f"{target}/run_id={run_id}")
    return target


def write_summary(summary: DataFrame, root: str, run_id: str) -> str:
    """The one-row summary of a run as JSON."""
    return write_table(summary.coalesce(1), root, "run_summary", run_id, fmt="json")


def read_table(spark: SparkSession, root: str, name: str, run_id: str | None = None) -> DataFrame:
    """All runs of a table, or one; only the folder of that run is read."""
    target = f"{root.rstrip('/')}/{name}"
    if run_id is None:
        return spark.read.parquet(target).withColumn("run_id", F.col("run_id").cast("string"))
    one = spark.read.option("basePath", target).parquet(f"{target}/run_id={run_id}")
    return one.withColumn("run_id", F.lit(run_id))


def latest_run(runs: DataFrame) -> DataFrame:
    """The rows of the last run in stamp order; the maximum is one row by construction."""
    return runs.where(F.col("run_id") == runs.select(F.max("run_id")).scalar())
