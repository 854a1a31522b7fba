"""Readers and writers of file formats; schemas are given, not inferred, wherever that costs a pass."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def read(spark: SparkSession, path: str, fmt: str = "parquet", schema: str | None = None, **options: str) -> DataFrame:
    reader = spark.read.format(fmt).options(**options)
    return (reader.schema(schema) if schema else reader).load(path)


def write(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "errorifexists", partition_by: tuple[str, ...] = (), sort_by: tuple[str, ...] = ()) -> None:
    """Rows sorted within files make row-group statistics selective for point and range lookups."""
    out = df.repartitionByRange(*sort_by).sortWithinPartitions(*sort_by) if sort_by else df
    writer = out.write.format(fmt).mode(mode)
    (writer.partitionBy(*partition_by) if partition_by else writer).save(path)


def register(spark: SparkSession, folder: str, names: tuple[str, ...], fmt: str = "parquet") -> None:
    """Temporary views over ``folder/<name>.<fmt>``."""
    for name in names:
        read(spark, f"{folder}/{name}.{fmt}", fmt).createOrReplaceTempView(name)
