"""Tables from files, by their suffix."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SUFFIXES = ("csv", "json", "xml", "xlsx", "parquet", "orc", "jsonl")


def read_csv(spark: SparkSession, path: str, schema: str | None = None, **options: str) -> DataFrame:
    reader = spark.read.options(**({"header": "true"} | options))
    return (reader.schema(schema) if schema else reader.option("inferSchema", "true")).csv(path)


def read_json(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """Documents of the form {"schema": ..., "data": [row, ...]}, or plain arrays of rows."""
    df = (spark.read.schema(schema) if schema else spark.read).option("multiLine", "true").json(path)
    if "data" in df.columns and dict(df.dtypes)["data"].startswith("array<struct"):
        return df.select(F.explode("data").alias("row")).select("row.*")
    return df


def read_xml(spark: SparkSession, path: str, row_tag: str = "row", schema: str | None = None) -> DataFrame:
    reader = spark.read.format("xml").option("rowTag", row_tag)
    return (reader.schema(schema) if schema else reader).load(path)


def read_xlsx(spark: SparkSession, path: str) -> DataFrame:
    """The first sheet; needs openpyxl, which Spark has no reader of its own for."""
    try:
        import openpyxl  # noqa: F401
    except ImportError as missing:
        raise NotImplementedError("reading xlsx needs openpyxl") from missing
    import pandas as pd

    return spark.createDataFrame(pd.read_excel(path))


def table_of(spark: SparkSession, source: object = None, path: str | None = None, columns: list[str] | None = None) -> DataFrame:
    """A table from whatever there is: a DataFrame, a pandas or Arrow table, a
    NumPy array, rows, or a function (of the session, or of nothing) that gives
    one of these; else the file or folder at path."""
    import inspect

    import numpy as np
    import pandas as pd
    import pyarrow as pa

    if callable(source) and not isinstance(source, DataFrame):
        source = source(spark) if inspect.signature(source).parameters else source()
    if source is None:
        if path is None:
            raise ValueError("neither data nor a path")
        df = read_table(spark, path)
    elif isinstance(source, DataFrame):
        df = source
    elif isinstance(source, np.ndarray):
        source = source.reshape(len(source), -1)
        df = spark.createDataFrame(pd.DataFrame(source, columns=columns or [f"att_{i}" for i in range(source.shape[1])]))
    elif isinstance(source, (pd.DataFrame, pa.Table)):
        df = spark.createDataFrame(source)
    else:
        df = spark.createDataFrame(source, columns)
    return df.select(*columns) if columns else df


def read_table(spark: SparkSession, path: str, **options) -> DataFrame:
    """A file or folder of files of one suffix, below it or in its subfolders."""
    suffix = path.rstrip("/").rpartition(".")[2].lower()
    if suffix not in SUFFIXES:
        for suffix in SUFFIXES:
            found = _below(spark, path, suffix)
            if found:
                path = found
                break
        else:
            raise ValueError(f"no file of {', '.join(SUFFIXES)} at {path}")
    if suffix in ("parquet", "orc"):
        return spark.read.format(suffix).load(path)
    if suffix == "jsonl":
        return spark.read.json(path)
    return {"csv": read_csv, "json": read_json, "xml": read_xml, "xlsx": read_xlsx}[suffix](spark, path, **options)


def _below(spark: SparkSession, path: str, suffix: str) -> str | None:
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    fs = hadoop.Path(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for pattern in (f"{path}/*.{suffix}", f"{path}/*/*.{suffix}"):
        found = fs.globStatus(hadoop.Path(pattern))
        if found is not None and len(found):
            return pattern
    return None
