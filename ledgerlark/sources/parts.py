"""Files parsed in Python, a bounded number at a time."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.types import struct

_ARROW = {"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "double": pa.float64(), "boolean": pa.bool_()}


def in_parts(files: DataFrame, file: str, text: str, parse: Callable[[str | None], list[dict]], /, most: int = 64, **fields: str) -> DataFrame:
    """``file, position`` and ``fields`` of each item that ``parse`` finds in a text.

    A worker holds the items of ``most`` files, whatever an Arrow batch holds.
    """
    base = files.select(F.col(file).alias("file"), F.col(text).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for s in range(0, b.num_rows, most):
                part = b.slice(s, most)
                found = [parse(x) for x in part.column(1).to_pylist()]
                sizes = [len(items) for items in found]
                at = pa.array(np.repeat(np.arange(len(sizes)), sizes))
                position = pa.array([i for n in sizes for i in range(n)], pa.int32())
                values = [pa.array([x[k] for items in found for x in items], _ARROW[kind]) for k, kind in fields.items()]
                yield pa.RecordBatch.from_arrays([part.column(0).take(at), position, *values], names=["file", "position", *fields])

    return base.mapInArrow(run, T.StructType([base.schema["file"], T.StructField("position", T.IntegerType()), *struct(**fields).fields]))
