"""Intermediate tables in the folder that driver and executors share; iterative operators cut their lineage there."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def stage(df: DataFrame) -> DataFrame:
    spark = df.sparkSession
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or getattr(spark.sparkContext, "_tarnwork_dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = spark.sparkContext._tarnwork_dir = tempfile.mkdtemp(prefix="tarnwork-shared-")
    path = f"{folder.rstrip('/')}/tarnwork-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def numbered(df: DataFrame, name: str, *order) -> DataFrame:
    """``df`` with a column that numbers its rows from 0 in the order given: sorted by ranges, counted by range, never in one task."""
    within = F.monotonically_increasing_id()
    rows = stage(df.orderBy(*order).withColumn("_at", within))
    rows = rows.withColumn("_part", F.shiftright("_at", 33)).withColumn("_at", F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)))
    counts = rows.groupBy("_part").agg(F.count("*").alias("_n"))
    # A row a range of the sort.
    before = counts.select(F.col("_part"), (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"))
    return rows.join(before, "_part").withColumn(name, F.col("_before") + F.col("_at")).drop("_part", "_at", "_before")
