"""Small tables written out once for both engines."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

_SQL_TYPES = {"string": "VARCHAR", "bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "boolean": "BOOLEAN"}


def _sql_type(t: T.DataType) -> str:
    if isinstance(t, T.ArrayType):
        return f"{_sql_type(t.elementType)}[]"
    if isinstance(t, T.MapType):
        return f"MAP({_sql_type(t.keyType)}, {_sql_type(t.valueType)})"
    if isinstance(t, T.StructType):
        return "STRUCT(" + ", ".join(f'"{f.name}" {_sql_type(f.dataType)}' for f in t.fields) + ")"
    return _SQL_TYPES[t.simpleString()]


def _sql(v: object, t: T.DataType) -> str:
    if v is None:
        return "NULL"
    if isinstance(t, T.ArrayType):
        return "[" + ", ".join(_sql(x, t.elementType) for x in v) + "]"
    if isinstance(t, T.MapType):
        return "MAP {" + ", ".join(f"{_sql(k, t.keyType)}: {_sql(x, t.valueType)}" for k, x in v.items()) + "}"
    if isinstance(t, T.StructType):
        return "{" + ", ".join(f"'{f.name}': {_sql(x, f.dataType)}" for f, x in zip(t.fields, v)) + "}"
    if isinstance(v, str):
        return "'" + v.replace("'", "''") + "'"
    if isinstance(v, float):
        return f"'{v}'::DOUBLE"
    return str(v)


class Relation:
    """Rows that a query builds inline, and the same rows as SQL."""

    def __init__(self, schema: str, rows: list[tuple]):
        self.schema, self.rows = schema, rows

    def df(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.rows, self.schema)

    @property
    def sql(self) -> str:
        fields = _fields(self.schema)
        rows = ", ".join("(" + ", ".join(f"CAST({_sql(v, f.dataType)} AS {_sql_type(f.dataType)})" for v, f in zip(r, fields)) + ")" for r in self.rows)
        return f"(SELECT * FROM (VALUES {rows}) AS t(" + ", ".join(f'"{f.name}"' for f in fields) + "))"


def _fields(schema: str) -> list[T.StructField]:
    """The fields of a schema text, without a session."""
    parts, depth, at = [], 0, 0
    for i, c in enumerate(schema):
        depth += (c == "<") - (c == ">")
        if c == "," and depth == 0:
            parts.append(schema[at:i])
            at = i + 1
    parts.append(schema[at:])
    return [T.StructField(n, _type(t)) for n, t in (re.match(r"\s*(\S+)\s+(.+?)\s*$", p).groups() for p in parts)]


def _type(text: str) -> T.DataType:
    m = re.fullmatch(r"(array|map|struct)<(.*)>", text)
    if not m:
        return {"string": T.StringType(), "bigint": T.LongType(), "int": T.IntegerType(), "double": T.DoubleType(), "boolean": T.BooleanType()}[text]
    if m[1] == "array":
        return T.ArrayType(_type(m[2]))
    if m[1] == "map":
        k, v = m[2].split(",", 1)
        return T.MapType(_type(k.strip()), _type(v.strip()))
    return T.StructType([T.StructField(f.name, f.dataType) for f in _fields(re.sub(r"(\w+):", r"\1 ", m[2]))])
