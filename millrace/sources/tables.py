"""Parquet tables of a data folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Bytes of files for each core below which a scan leaves cores idle: row groups are as large or larger.
SCAN_BYTES = 8 << 20
#: Tables of long texts, whose rows cost more to work on than to move.
TEXTS = frozenset({"documents"})


def spread(df: DataFrame) -> DataFrame:
    """``df`` dealt over the cores where its files are too small for that by themselves; a large table is left as it is scanned.

    A file of one row group is read by one task whatever its splits, so a small table of texts would be
    worked on by one core. Filters and column choices still reach the scan.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(cores) if size < cores * SCAN_BYTES else df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spread(df) if name in TEXTS else df
