"""Avro records as bytes, for Spark without its Avro package: the binary encoding of a struct, in Arrow batches."""

from __future__ import annotations

import datetime
import decimal
import io
import json
import struct
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

_PLAIN = {T.BooleanType: "boolean", T.IntegerType: "int", T.ShortType: "int", T.ByteType: "int", T.LongType: "long", T.FloatType: "float", T.DoubleType: "double", T.StringType: "string", T.BinaryType: "bytes"}
_EPOCH = datetime.datetime(1970, 1, 1)
_DAY0 = datetime.date(1970, 1, 1)


def schema_of(kind: T.DataType, name: str = "row") -> object:
    """The Avro schema of a type; a nullable field is a union with null, which comes first."""
    if isinstance(kind, T.StructType):
        return {"type": "record", "name": name, "fields": [{"name": f.name, "type": ["null", schema_of(f.dataType, f.name)] if f.nullable else schema_of(f.dataType, f.name)} for f in kind]}
    if isinstance(kind, T.ArrayType):
        return {"type": "array", "items": ["null", schema_of(kind.elementType, name)]}
    if isinstance(kind, T.MapType):
        return {"type": "map", "values": ["null", schema_of(kind.valueType, name)]}
    if isinstance(kind, T.DecimalType):
        return {"type": "bytes", "logicalType": "decimal", "precision": kind.precision, "scale": kind.scale}
    if isinstance(kind, T.DateType):
        return {"type": "int", "logicalType": "date"}
    if isinstance(kind, T.TimestampNTZType):
        return {"type": "long", "logicalType": "local-timestamp-micros"}
    if isinstance(kind, T.TimestampType):
        return {"type": "long", "logicalType": "timestamp-micros"}
    return _PLAIN[type(kind)]


def _put_long(out: io.BytesIO, n: int) -> None:
    n = n << 1 if n >= 0 else (-n << 1) - 1
    while n > 127:
        out.write(bytes([n & 127 | 128]))
        n >>= 7
    out.write(bytes([n]))


def _get_long(data: io.BytesIO) -> int:
    n, shift = 0, 0
    while True:
        b = data.read(1)[0]
        n |= (b & 127) << shift
        if b < 128:
            return n >> 1 if not n & 1 else -((n + 1) >> 1)
        shift += 7


def _put_bytes(out: io.BytesIO, b: bytes) -> None:
    _put_long(out, len(b))
    out.write(b)


def _micros(x: datetime.datetime) -> int:
    if x.tzinfo is not None:
        x = x.astimezone(datetime.UTC).replace(tzinfo=None)
    return (x - _EPOCH) // datetime.timedelta(microseconds=1)


def writer(kind: T.DataType) -> Callable[[io.BytesIO, object], None]:
    if isinstance(kind, T.StructType):
        parts = [(f.name, f.nullable, writer(f.dataType)) for f in kind]

        def record(out, row):
            for name, nullable, put in parts:
                x = row[name]
                if nullable:
                    _put_long(out, 0 if x is None else 1)
                elif x is None:
                    raise ValueError(f"missing value of {name}")
                if x is not None:
                    put(out, x)

        return record
    if isinstance(kind, (T.ArrayType, T.MapType)):
        put = writer(kind.elementType if isinstance(kind, T.ArrayType) else kind.valueType)

        def many(out, xs):
            if xs:
                _put_long(out, len(xs))
                for x in xs:
                    if isinstance(kind, T.MapType):
                        _put_bytes(out, x[0].encode())
                        x = x[1]
                    _put_long(out, 0 if x is None else 1)
                    if x is not None:
                        put(out, x)
            _put_long(out, 0)

        return many
    if isinstance(kind, T.DecimalType):

        def number(out, x):
            n = int(x.scaleb(kind.scale, decimal.Context(prec=80)))
            _put_bytes(out, n.to_bytes((n if n >= 0 else ~n).bit_length() // 8 + 1, "big", signed=True))

        return number
    if isinstance(kind, T.DateType):
        return lambda out, x: _put_long(out, (x - _DAY0).days)
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return lambda out, x: _put_long(out, _micros(x))
    return {
        "boolean": lambda out, x: out.write(b"\x01" if x else b"\x00"),
        "int": lambda out, x: _put_long(out, x),
        "long": lambda out, x: _put_long(out, x),
        "float": lambda out, x: out.write(struct.pack("<f", x)),
        "double": lambda out, x: out.write(struct.pack("<d", x)),
        "string": lambda out, x: _put_bytes(out, x.encode()),
        "bytes": lambda out, x: _put_bytes(out, x),
    }[_PLAIN[type(kind)]]


def reader(kind: T.DataType) -> Callable[[io.BytesIO], object]:
    if isinstance(kind, T.StructType):
        parts = [(f.name, f.nullable, reader(f.dataType)) for f in kind]
        return lambda data: {name: get(data) if not nullable or _get_long(data) else None for name, nullable, get in parts}
    if isinstance(kind, (T.ArrayType, T.MapType)):
        get = reader(kind.elementType if isinstance(kind, T.ArrayType) else kind.valueType)

        def many(data):
            out = []
            while n := _get_long(data):
                if n < 0:  # a block with its size
                    n = -n
                    _get_long(data)
                for _ in range(n):
                    key = data.read(_get_long(data)).decode() if isinstance(kind, T.MapType) else None
                    x = get(data) if _get_long(data) else None
                    out.append((key, x) if isinstance(kind, T.MapType) else x)
            return out

        return many
    if isinstance(kind, T.DecimalType):
        return lambda data: decimal.Decimal(int.from_bytes(data.read(_get_long(data)), "big", signed=True)).scaleb(-kind.scale, decimal.Context(prec=80))
    if isinstance(kind, T.DateType):
        return lambda data: _DAY0 + datetime.timedelta(days=_get_long(data))
    if isinstance(kind, T.TimestampNTZType):
        return lambda data: _EPOCH + datetime.timedelta(microseconds=_get_long(data))
    if isinstance(kind, T.TimestampType):
        return lambda data: (_EPOCH + datetime.timedelta(microseconds=_get_long(data))).replace(tzinfo=datetime.UTC)
    return {
        "boolean": lambda data: data.read(1) == b"\x01",
        "int": _get_long,
        "long": _get_long,
        "float": lambda data: struct.unpack("<f", data.read(4))[0],
        "double": lambda data: struct.unpack("<d", data.read(8))[0],
        "string": lambda data: data.read(_get_long(data)).decode(),
        "bytes": lambda data: data.read(_get_long(data)),
    }[_PLAIN[type(kind)]]


def encode(df: DataFrame, schema_id: int = 0) -> DataFrame:
    """One column value: each row after a zero byte and the four of its schema's number, as a registry frames it."""
    kind, frame = df.schema, b"\x00" + schema_id.to_bytes(4, "big")

    def run(batches):
        put = writer(kind)
        for b in batches:
            found = []
            for row in b.to_pylist():
                out = io.BytesIO()
                out.write(frame)
                put(out, row)
                found.append(out.getvalue())
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.binary())], ["value"])

    return df.mapInArrow(run, "value binary")


def decode(df: DataFrame, schema: T.StructType, column: str = "value") -> DataFrame:
    """The records of a column of framed bytes; null ones are left out."""
    from pyspark.sql.pandas.types import to_arrow_schema

    def run(batches):
        get, arrow = reader(schema), to_arrow_schema(schema)
        for b in batches:
            rows = [get(io.BytesIO(x[5:])) for x in b.column(0).to_pylist() if x is not None]
            yield pa.RecordBatch.from_pylist(rows, schema=arrow)

    return df.select(column).mapInArrow(run, schema)


def schema_json(schema: T.StructType) -> str:
    return json.dumps(schema_of(schema))
