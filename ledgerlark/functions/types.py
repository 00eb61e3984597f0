"""Types of vectorised functions, built without a session so workers can import them."""

from __future__ import annotations

from pyspark.sql import types as T

_SIMPLE = {"string": T.StringType(), "double": T.DoubleType(), "int": T.IntegerType(), "long": T.LongType(), "boolean": T.BooleanType()}


def struct(**fields: str) -> T.StructType:
    return T.StructType([T.StructField(k, _SIMPLE[v]) for k, v in fields.items()])


def array_of(**fields: str) -> T.ArrayType:
    return T.ArrayType(struct(**fields))


STRINGS = T.ArrayType(T.StringType())
