"""Vectors of pictures by a function that the user supplies.

A factory is called once a task and gives the function; this takes a batch of
pictures of one size, (n, height, width, 3) of float32 from -1 to 1, and gives
(n, d) numbers. Where the model comes from, and on which device it runs, is the
factory's business: "package.module:factory" names one for the command line.
"""

from __future__ import annotations

import importlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veracast.operators.images import resized

Extractor = Callable[[np.ndarray], np.ndarray]


def named(text: str) -> Callable[[], Extractor]:
    """The factory that "module:name" stands for; it is imported in the tasks."""
    module, _, name = text.partition(":")
    if not module or not name:
        raise ValueError(f"{text} isn't of the form module:name")
    return lambda: getattr(importlib.import_module(module), name)()


def standard(x: np.ndarray, size: tuple[int, int]) -> np.ndarray:
    """A picture of bytes at ``size``, from -1 to 1."""
    return (resized(x, *size) if x.shape[:2] != size else x).astype(np.float32) / 127.5 - 1


def extracted(pictures: DataFrame, factory: Callable[[], Extractor], size: tuple[int, int] = (224, 224), batch: int = 32) -> DataFrame:
    """id (a hash of the name), image and v of (image, height, width, data) rows.
    Pictures without data have no vector. Nothing is shuffled, and a task holds
    one batch of pictures."""
    own = pictures.where("data is not null and length(data) > 0").select("image", "height", "width", "data")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        function = None
        for rows in batches:
            for k in range(0, rows.num_rows, batch):
                part = rows.slice(k, batch)
                some = [np.frombuffer(x, np.uint8).reshape(h, w, -1)[..., :3] for x, h, w in zip(*(part.column(c).to_pylist() for c in ("data", "height", "width")))]
                function = function or factory()
                got = np.asarray(function(np.stack([standard(x, size) for x in some])), np.float64).reshape(len(some), -1)
                yield pa.RecordBatch.from_arrays([part.column("image").cast(pa.string()), pa.array(list(got), pa.list_(pa.float64()))], ["image", "v"])

    return own.mapInArrow(run, "image string, v array<double>").select(F.xxhash64("image").alias("id"), "image", "v")
