"""Record formats of connectors: JSON, CSV, raw bytes, Debezium and Avro."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.changelog import debezium
from . import avro

#: Times keep their microseconds.
_TIMES = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}
FORMATS = ("json", "csv", "raw", "debezium", "avro")


class FormatError(ValueError):
    """A format that can't be read here."""


def decode(df: DataFrame, fmt: str, schema: T.StructType | None, column: str = "value", options: dict[str, str] | None = None, keep: list[str] | None = None) -> DataFrame:
    """The records of a column of strings or bytes. A missing field that is declared NOT NULL fails the query. keep: other columns, with raw bytes."""
    options = options or {}
    text = F.col(column).cast("string")
    if fmt == "raw":
        return df.select(*(keep or []), F.col(column).cast("binary").alias("value"))
    if schema is None:
        raise FormatError(f"{fmt} needs a declared schema")
    if fmt == "json":
        rows = df.select(F.from_json(text, _nullable(schema), {"mode": "FAILFAST"} | _TIMES).alias("r"))
    elif fmt == "csv":
        rows = df.select(F.from_csv(text, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema), {"sep": options.get("delimiter", ","), "mode": "FAILFAST"} | _TIMES).alias("r"))
    elif fmt == "debezium":
        return debezium(df.select(text.alias("__j")), "__j", schema)
    elif fmt == "avro":
        return avro.decode(df, schema, column)
    else:
        raise FormatError(f"unknown format: {fmt}")
    rows = rows.select("r.*")
    for f in schema:
        if not f.nullable:
            rows = rows.withColumn(f.name, F.when(F.col(f.name).isNull(), F.raise_error(F.lit(f"missing value of {f.name}")).cast(f.dataType)).otherwise(F.col(f.name)))
    return rows


def _nullable(schema: T.StructType) -> T.StructType:
    return T.StructType([T.StructField(f.name, f.dataType, True) for f in schema])


def encode(df: DataFrame, fmt: str) -> DataFrame:
    """One column `value` with each row as a record."""
    row = F.struct(*(F.col(f"`{c}`") for c in df.columns))
    if fmt == "json":
        return df.select(F.to_json(row, {"ignoreNullFields": "false"} | _TIMES).alias("value"))
    if fmt == "csv":
        return df.select(F.to_csv(row, _TIMES).alias("value"))
    if fmt == "avro":
        return avro.encode(df)
    raise FormatError(f"can't write {fmt}")
