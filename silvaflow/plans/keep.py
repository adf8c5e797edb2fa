"""Computing a DataFrame once."""

from __future__ import annotations

import tempfile

import pyarrow as pa
from pyspark.sql import DataFrame

#: Tables with so many rows at most are collected and sent back out with the next plan, and are joined by broadcast.
FEW = 50_000


def cut(df: DataFrame) -> DataFrame:
    """df, computed once and kept in the folder that all executors share (spark.checkpoint.dir; in tests, where that is unset,
    one of our own), without its lineage."""
    context = df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        context.setCheckpointDir(df.sparkSession.conf.get("spark.checkpoint.dir", None) or tempfile.mkdtemp(prefix="silvaflow-"))
    return df.checkpoint()


def settle(df: DataFrame, at_most: int) -> tuple[DataFrame, pa.Table | None]:
    """df, computed once; at_most is a proven bound of its rows. Few rows go by way of the driver, which keeps them too."""
    if at_most > FEW:
        return cut(df), None
    rows = df.toArrow()
    return df.sparkSession.createDataFrame(rows, df.schema), rows
