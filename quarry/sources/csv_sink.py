"""CSV exports: a header, quoted cells, one folder of part files (one file only where the caller says it is small)."""

from __future__ import annotations

from pyspark.sql import DataFrame


def write(df: DataFrame, path: str, files: int | None = None) -> None:
    out = df.coalesce(files) if files else df
    out.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def read(spark, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("header", True).option("escape", '"').option("multiLine", True).csv(path)
