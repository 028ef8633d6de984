"""File sources and sinks: format round trips, reader options, tables, JDBC and
the optional Avro/Protobuf column codecs (gated on their packages)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write(df: DataFrame, path: str, fmt: str, mode: str = "overwrite", partition_by=None, **options) -> None:
    w = df.write.mode(mode).format(fmt).options(**options)
    if partition_by:
        w = w.partitionBy(*([partition_by] if isinstance(partition_by, str) else partition_by))
    w.save(path)


def read(spark: SparkSession, path: str, fmt: str, schema=None, **options) -> DataFrame:
    r = spark.read.format(fmt).options(**options)
    if schema is not None:
        r = r.schema(schema)
    return r.load(path)


def save_table(df: DataFrame, name: str, path: str, fmt: str = "parquet", partition_by=None,
               bucket_by: tuple[int, list[str]] | None = None, sort_by=None, mode: str = "overwrite") -> None:
    """An external catalog table at `path` (a shared folder, not the local warehouse)."""
    w = df.write.mode(mode).format(fmt).option("path", path)
    if partition_by:
        w = w.partitionBy(*partition_by)
    if bucket_by:
        w = w.bucketBy(bucket_by[0], *bucket_by[1])
    if sort_by:
        w = w.sortBy(*sort_by)
    w.saveAsTable(name)


def jdbc_table(spark: SparkSession, url: str, table: str, partition_column: str, lower: int, upper: int,
               num_partitions: int, **props) -> DataFrame:
    """A JDBC table read in num_partitions range slices of partition_column.
    (No database is reachable here; this is the reader call a user makes.)"""
    return spark.read.jdbc(url, table, column=partition_column, lowerBound=lower, upperBound=upper,
                           numPartitions=num_partitions, properties=props)


def has_data_source(spark: SparkSession, class_name: str) -> bool:
    try:
        spark.sparkContext._jvm.java.lang.Class.forName(class_name)
        return True
    except Exception:  # noqa: BLE001
        return False


def avro_round_trip(df: DataFrame, col: str, json_schema: str) -> DataFrame:
    """to_avro then from_avro of one column; needs the spark-avro package."""
    from pyspark.sql.avro.functions import from_avro, to_avro
    return df.select(from_avro(to_avro(F.col(col)), json_schema).alias(col))


def protobuf_round_trip(df: DataFrame, col: str, message: str, desc_file: str) -> DataFrame:
    """to_protobuf then from_protobuf of a struct column; needs spark-protobuf."""
    from pyspark.sql.protobuf.functions import from_protobuf, to_protobuf
    return df.select(from_protobuf(to_protobuf(F.col(col), message, desc_file), message, desc_file).alias(col))
