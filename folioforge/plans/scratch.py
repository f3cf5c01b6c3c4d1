"""Intermediate tables in the folder that driver and executors share.

A plan that is read more than once, or that closes an iteration, is written as
Parquet under ``spark.checkpoint.dir`` and read again. That cuts the lineage, and
an executor that is lost later costs no recomputation of what was written.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

SETTING = "spark.checkpoint.dir"


def base_dir(spark: SparkSession) -> str:
    """The shared folder the cluster names; in a local session without one, a new temporary folder.

    Raises ``ValueError`` where the setting is missing on a cluster, as a folder of one machine
    would not be seen by the others.
    """
    named = spark.conf.get(SETTING, None) or spark.sparkContext.getConf().get(SETTING)
    if named:
        return named.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError(f"{SETTING} must name a folder that all executors share")
    own = tempfile.mkdtemp(prefix="folioforge-")
    spark.conf.set(SETTING, f"file://{own}")
    return f"file://{own}"


def new_dir(spark: SparkSession, label: str) -> str:
    return f"{base_dir(spark)}/folioforge/{label}-{uuid.uuid4().hex}"


def written(df: DataFrame, label: str, **options: str) -> DataFrame:
    """Write ``df`` to the shared folder, with options of the Parquet writer, and return the table read back."""
    spark = df.sparkSession
    path = new_dir(spark, label)
    schema = df.schema
    df.write.options(**options).parquet(path)
    return spark.read.schema(schema).parquet(path)


def drop_all(spark: SparkSession) -> None:
    """Delete every table that this module has written below the shared folder."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(f"{base_dir(spark)}/folioforge")
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
