"""Type families of the dialect, their Spark types, and strict coercion on write."""

from __future__ import annotations

import datetime as dt
import decimal
import json

from pyspark.sql import types as T

from ..errors import TypeMismatchError
from ..plans.nodes import Column

SPARK = {
    "int": T.LongType(), "float": T.DoubleType(), "text": T.StringType(), "bool": T.BooleanType(), "date": T.DateType(),
    "datetime": T.TimestampNTZType(), "decimal": T.DecimalType(38, 18), "blob": T.BinaryType(), "json": T.StringType(), "null": T.NullType(),
}
#: Names that a schema listing shows.
TAGS = {"int": "Int", "float": "Float", "text": "Text", "bool": "Bool", "date": "Date", "time": "Time", "datetime": "Datetime", "decimal": "Decimal", "blob": "Blob", "json": "Json"}


def spark_type(family: str, size: tuple[int, ...] = ()) -> T.DataType:
    if family == "time":
        return T.TimeType(6)
    if family == "decimal" and size:
        return T.DecimalType(size[0], size[1] if len(size) > 1 else 0)
    return SPARK[family]


def field(c: Column) -> T.StructField:
    return T.StructField(c.name, spark_type(c.family, c.size), True, {"family": c.family})


def family_of(f: T.StructField) -> str:
    """The family of a column, of this engine's tables and of any registered DataFrame."""
    if f.metadata.get("family"):
        return f.metadata["family"]
    kinds = (
        ((T.ByteType, T.ShortType, T.IntegerType, T.LongType), "int"), ((T.FloatType, T.DoubleType), "float"), ((T.StringType,), "text"), ((T.BooleanType,), "bool"),
        ((T.DateType,), "date"), ((T.TimestampType, T.TimestampNTZType), "datetime"), ((T.DecimalType,), "decimal"), ((T.BinaryType,), "blob"), ((T.NullType,), "null"),
    )
    for types, family in kinds:
        if isinstance(f.dataType, types):
            return family
    return "time" if type(f.dataType).__name__ == "TimeType" else "other"


def canonical(value) -> str | None:
    """JSON text with sorted keys: equal values are equal strings."""
    return None if value is None else json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def coerced(value, column: Column):
    """value as the column stores it; TypeMismatchError where the type does not take it."""
    if value is None:
        return None
    family, kind = column.family, type(value)
    if family == "int" and kind is not bool and (kind is int or kind is float and value.is_integer()):
        if not -(1 << 63) <= int(value) < 1 << 63:
            raise OverflowError(f"{value} is out of range for {column.name}")
        return int(value)
    if family == "float" and kind in (int, float):
        return float(value)
    if family == "text" and kind is str or family == "bool" and kind is bool or family == "date" and kind is dt.date or family == "time" and isinstance(value, dt.time):
        return value
    if family == "datetime" and isinstance(value, dt.datetime):
        return value.astimezone(dt.UTC).replace(tzinfo=None) if value.tzinfo else value
    if family == "decimal" and kind in (int, decimal.Decimal):
        t, value = spark_type(family, column.size), decimal.Decimal(value)
        try:
            fits = value.is_finite() and value == (q := value.quantize(decimal.Decimal(1).scaleb(-t.scale), context=decimal.Context(prec=t.precision)))
        except decimal.InvalidOperation:
            fits = False
        if not fits:
            raise TypeMismatchError(f"{value} does not fit {t.simpleString()} of {column.name}")
        return q
    if family == "blob" and isinstance(value, bytes | bytearray):
        return bytearray(value)
    if family == "json":
        try:
            return canonical(value)
        except (TypeError, ValueError) as e:
            raise TypeMismatchError(f"{column.name}: {e}") from e
    raise TypeMismatchError(f"{column.name} is {TAGS[family]} and does not take {kind.__name__}")

