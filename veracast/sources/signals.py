"""Waveforms with text headers.

A header's first line is "record signals frequency samples"; a line for each
signal follows ("file format gain ... lead"), then comments "# Key: value".
Signals of one data file are interleaved by time, from a byte offset that the
format names ("16x1+24"). Formats 8-bit (80), 12-bit (212), 16-bit of either
byte order (16, 61), 24-bit (24) and 32-bit (32) are read, others refused.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_headers(spark: SparkSession, path: str) -> DataFrame:
    """record, n_sig, fs, n_samples, leads, files, offset, gains, baselines,
    formats, age, sex and dx of each header file below path."""
    text = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.hea").text(path, wholetext=True)
    lines = F.split(F.col("value"), r"\r?\n")
    head = F.split(F.get(lines, F.lit(0)), r"\s+")
    n = F.get(head, F.lit(1)).cast("int")
    own = F.filter(F.slice(lines, F.lit(2), n), lambda x: x != "")
    part = lambda i: F.transform("own", lambda x: F.get(F.split(x, r"\s+"), F.lit(i)))
    comment = lambda key: F.nullif(F.regexp_extract("value", rf"(?m)^#\s*{key}:[ \t]*(.*?)\s*$", 1), F.lit(""))
    df = text.withColumn("own", own).select(
        F.get(head, F.lit(0)).alias("record"), n.alias("n_sig"), F.get(head, F.lit(2)).cast("double").cast("int").alias("fs"), F.get(head, F.lit(3)).cast("int").alias("n_samples"),
        F.transform("own", lambda x: F.element_at(F.split(x, r"\s+"), -1)).alias("leads"), part(0).alias("files"),
        F.coalesce(F.nullif(F.regexp_extract(F.get(part(1), F.lit(0)), r"\+(\d+)", 1), F.lit("")).cast("int"), F.lit(0)).alias("offset"),
        F.transform(part(1), lambda f: F.regexp_extract(f, r"^(\d+)", 1).try_cast("int")).alias("formats"),
        F.transform(part(2), lambda g: F.regexp_extract(g, r"^([0-9.]+)", 1).try_cast("double")).alias("gains"),
        F.transform(part(2), lambda g: F.coalesce(F.regexp_extract(g, r"\((-?\d+)\)", 1).try_cast("double"), F.lit(0.0))).alias("baselines"),
        comment("Age").try_cast("int").alias("age"), comment("Sex").alias("sex"), F.split(comment("Dx"), ",").alias("dx"),
    )
    return df


def samples(content: bytes, kind: int) -> np.ndarray:
    """The integers of a data file in one of the formats."""
    if kind in (16, 61):
        size, order = 2, "<i2" if kind == 16 else ">i2"
    elif kind == 32:
        size, order = 4, "<i4"
    elif kind == 80:
        return np.frombuffer(content, np.uint8).astype(np.int64) - 128
    elif kind == 24:
        b = np.frombuffer(content[: len(content) // 3 * 3], np.uint8).reshape(-1, 3).astype(np.int64)
        x = b[:, 0] | (b[:, 1] << 8) | (b[:, 2] << 16)
        return x - ((x >> 23) << 24)
    elif kind == 212:  # two numbers in three bytes
        b = np.frombuffer(content + b"\0" * (-len(content) % 3), np.uint8).reshape(-1, 3).astype(np.int64)
        x = np.stack([b[:, 0] | ((b[:, 1] & 15) << 8), b[:, 2] | ((b[:, 1] >> 4) << 8)], axis=1).ravel()
        return (x - ((x >> 11) << 12))[: len(content) * 2 // 3]
    else:
        raise ValueError(f"samples of format {kind} can't be read")
    return np.frombuffer(content[: len(content) // size * size], order).astype(np.int64)


def read_signals(spark: SparkSession, path: str) -> DataFrame:
    """signal, channel, t and v (in the header's unit) of all records below
    path whose data files are there. Files are decoded whole, one at a time; the formats of a
    file's signals must agree."""
    heads = read_headers(spark, path).select(F.explode(F.array_distinct("files")).alias("file"), "files", "record", "offset", "formats", "gains", "baselines")
    data = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.{mat,dat}").load(path).select(F.regexp_extract("path", r"([^/]+)$", 1).alias("name"), "content")
    both = data.join(heads, F.col("name") == F.col("file")).select("record", "name", "files", "offset", "formats", "gains", "baselines", "content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                own = [i for i, f in enumerate(r["files"]) if f == r["name"]]
                kinds = {r["formats"][i] for i in own}
                if len(kinds) > 1:
                    raise ValueError(f"{r['name']} has signals of formats {kinds}")
                x = samples(r["content"][r["offset"] :], kinds.pop())
                x = x[: len(x) // len(own) * len(own)].reshape(-1, len(own)).astype(float)
                x = (x - np.array([r["baselines"][i] for i in own])) / np.array([r["gains"][i] or 200.0 for i in own])
                t, c = np.divmod(np.arange(x.size), len(own))
                yield pa.RecordBatch.from_arrays([pa.array([r["record"]] * x.size), pa.array(np.array(own, np.int32)[c]), pa.array(t), pa.array(x.ravel())], ["signal", "channel", "t", "v"])

    return both.mapInArrow(run, "signal string, channel int, t long, v double")
