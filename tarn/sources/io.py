"""Reading and writing files."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from tarn.plans.lineage import checkpoint_dir


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the folder that all executors share."""
    return f"{checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


def read_columns(spark: SparkSession, paths: str | list[str], columns: list[str]) -> DataFrame:
    """The named columns of one or more Parquet files, folders or globs; the scan reads no others."""
    return spark.read.parquet(*([paths] if isinstance(paths, str) else paths)).select(*columns)


def schema_of(spark: SparkSession, path: str) -> StructType:
    """The schema, from file footers alone."""
    return spark.read.parquet(path).schema


def read_csv(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """CSV with a header; types are given, or else inferred by one more scan."""
    reader = spark.read.option("header", True)
    return (reader.schema(schema) if schema else reader.option("inferSchema", True)).csv(path)


def write_csv(df: DataFrame, path: str) -> str:
    df.write.mode("overwrite").option("header", True).csv(path)
    return path


def write_json(df: DataFrame, path: str) -> str:
    df.write.mode("overwrite").json(path)
    return path


def write_parquet(df: DataFrame, path: str, row_group_bytes: int = 128 << 20, partition_by: list[str] | None = None) -> str:
    """Zstandard Parquet. Partitions that df holds replace those of the same key, others stay, so a repeated run changes nothing."""
    writer = df.write.mode("overwrite").option("compression", "zstd").option("parquet.block.size", row_group_bytes)
    if partition_by:
        writer = writer.partitionBy(*partition_by).option("partitionOverwriteMode", "dynamic")
    writer.parquet(path)
    return path


def write_clustered(df: DataFrame, path: str, keys: list[str]) -> str:
    """Parquet in ranges of keys, sorted inside the files, so that filters on keys skip row groups."""
    return write_parquet(df.repartitionByRange(*keys).sortWithinPartitions(*keys), path)


def _fs(spark: SparkSession, path: str):
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def finished(spark: SparkSession, path: str) -> bool:
    """True if a write to the path has been completed."""
    fs, p = _fs(spark, f"{path}/_SUCCESS")
    return fs.exists(p)


def modified(spark: SparkSession, path: str) -> int:
    """Time of the last change in milliseconds, 0 if the path doesn't exist."""
    fs, p = _fs(spark, path)
    return fs.getFileStatus(p).getModificationTime() if fs.exists(p) else 0


def write_once(df: DataFrame, path: str, inputs: list[str] = []) -> bool:
    """Writes unless the path holds a finished result newer than its inputs; True if it wrote."""
    spark = df.sparkSession
    if finished(spark, path) and all(modified(spark, i) <= modified(spark, f"{path}/_SUCCESS") for i in inputs):
        return False
    write_parquet(df, path)
    return True


def write_metadata(spark: SparkSession, path: str, values: dict) -> str:
    """A small JSON side file, such as thresholds."""
    spark.createDataFrame([(json.dumps(values, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(path)
    return path


def read_metadata(spark: SparkSession, path: str) -> dict:
    return json.loads(spark.read.text(path).first()["value"])
