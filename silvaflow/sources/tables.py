"""Where tables come from and where models go: names, DataFrames, and the file formats Spark reads and writes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..plans.schema import MODEL_COLUMNS

FORMATS = ("parquet", "orc", "json", "csv", "avro")


def resolve(table: DataFrame | str, spark: SparkSession | None = None) -> DataFrame:
    """A DataFrame as it is, or the table or view of that name."""
    if isinstance(table, DataFrame):
        return table
    spark = spark or SparkSession.getActiveSession()
    if spark is None:
        raise ValueError("a table name needs a Spark session")
    return spark.table(table)


def read_table(spark: SparkSession, path: str, fmt: str = "parquet", **options) -> DataFrame:
    if fmt not in FORMATS:
        raise ValueError(f"fmt must be one of {', '.join(FORMATS)}, got {fmt!r}")
    return spark.read.format(fmt).options(**options).load(path)


def save_model(model: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Writes a model as parquet; batches of trees can be added with mode='append'."""
    model.select(*MODEL_COLUMNS).write.mode(mode).parquet(path)


def load_model(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).select(*MODEL_COLUMNS)
