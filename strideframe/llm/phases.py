"""Writing a phase's result to the shared folder, and letting go of what made it.

A job that fails half-way leaves its tables in the shared folder; whoever clears that folder clears them.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame

from ..session import shared_folder

CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def settled(df: DataFrame) -> DataFrame:
    """`df` as a compressed table in the folder that all executors share. Spark drops the shuffle files of this
    execution when it ends; the session's own setting is put back."""
    spark = df.sparkSession
    before = spark.conf.get(CLEANUP, "false")
    path = f"{shared_folder(spark)}/phase-{uuid.uuid4().hex}"
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    table = spark.read.schema(df.schema).parquet(path)
    table._settled_at = path
    return table


def released(*tables: DataFrame) -> None:
    """Delete settled tables that no result is still to read."""
    for table in tables:
        jvm = table.sparkSession._jvm
        path = jvm.org.apache.hadoop.fs.Path(table._settled_at)
        path.getFileSystem(table.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)
