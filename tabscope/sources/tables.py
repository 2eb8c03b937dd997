"""Table arguments, result sinks, caching."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabscope.session import together
from tabscope.sources.csv import read_csv


def load(spark: SparkSession, path: str | None = None, df: DataFrame | None = None) -> DataFrame:
    """The given table, or the one at ``path`` (CSV, or parquet by suffix)."""
    if df is not None:
        return df
    if path is None:
        raise ValueError("give a path or a table")
    return spark.read.parquet(path) if path.rstrip("/").endswith(".parquet") else read_csv(spark, path)


def write_results(tables: dict[str, DataFrame], output: str, dataset: str, target: str) -> dict[str, str]:
    """One parquet table per result; a repeated run replaces its own (dataset, target) partition only."""
    paths = {name: f"{output.rstrip('/')}/{name}" for name in tables}

    def write(name: str) -> None:
        placed = tables[name].withColumns({"dataset": F.lit(dataset), "target": F.lit(target)})
        (placed.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
         .partitionBy("dataset", "target").parquet(paths[name]))

    spark = next(iter(tables.values())).sparkSession
    together(spark, [partial(write, name) for name in tables], len(tables))  # small tables in folders of their own
    return paths


@contextmanager
def cached(df: DataFrame) -> Iterator[DataFrame]:
    """Keep a table in memory or on local disk over several passes; nothing may depend on it for correctness."""
    df.persist()
    try:
        yield df
    finally:
        df.unpersist()
