"""Dataset contracts: columns, grain, partitioning and order of a stored table."""

from __future__ import annotations

import hashlib
import json
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickloom.functions import codes

# Text forms the typed cast accepts.
TRUE_WORDS = ("true", "1", "yes")
FALSE_WORDS = ("false", "0", "no")
DATE_PATTERN = "^([0-9]{8}|[0-9]{1,4}-[0-9]{1,2}-[0-9]{1,2}( .*)?)$"
TYPE_NAMES = {
    "string": "string", "date32": "date", "bool": "boolean", "int8": "tinyint", "int32": "int", "int64": "bigint",
    "float64": "double", "timestamp": "timestamp", "timestamp_ntz": "timestamp_ntz", "time32": "string",
}


@dataclass(frozen=True)
class Column:
    name: str
    type: str
    nullable: bool = True
    kind: str | None = None  # contract type where the Spark type does not tell, e.g. time32


@dataclass(frozen=True)
class DatasetContract:
    """What a stored dataset promises."""

    name: str
    fields: tuple[Column, ...]
    grain: tuple[str, ...] = ()
    partition: str | None = None
    order_by: tuple[str, ...] = ()
    allow_empty: bool = False

    def schema(self) -> T.StructType:
        return T.StructType([T.StructField(f.name, parse_type(f.type), f.nullable) for f in self.fields])

    def fingerprint(self) -> str:
        """SHA-256 of the column list, independent of the dataset name."""
        body = [[f.name, f.type, f.nullable] for f in self.fields]
        return hashlib.sha256(json.dumps(body).encode()).hexdigest()


def parse_type(name: str) -> T.DataType:
    return T._parse_datatype_string(name)


def contract_of(df: DataFrame, name: str, **settings) -> DatasetContract:
    """Contract with the columns a frame has."""
    fields = tuple(Column(f.name, f.dataType.simpleString(), f.nullable) for f in df.schema.fields)
    return DatasetContract(name, fields, **settings)


def typed(column: str, kind: str, strict: bool = True):
    """Text to a contract type by its declared rules; a blank is NULL.

    A value no rule accepts fails the job in strict mode and is NULL otherwise.
    """
    text = F.nullif(F.trim(F.col(column).cast("string")), F.lit(""))
    lower = F.lower(text)
    if kind == "date32":
        digits = F.when(text.rlike("^[0-9]{8}$"), F.to_date(F.try_to_timestamp(text, F.lit("yyyyMMdd"))))
        dashed = F.when(
            text.rlike("^[0-9]{1,4}-[0-9]{1,2}-[0-9]{1,2}( .*)?$"), F.split_part(text, F.lit(" "), F.lit(1)).try_cast("date")
        )
        value = F.coalesce(digits, dashed)
    elif kind == "bool":
        value = F.when(lower.isin(*TRUE_WORDS), True).when(lower.isin(*FALSE_WORDS), False)
    elif kind == "timestamp":
        number = F.when(text.rlike("^[0-9]+$"), text.try_cast("bigint"))
        value = F.coalesce(
            F.when(F.length(text) >= 13, F.timestamp_millis(number)).otherwise(F.timestamp_seconds(number)),
            F.when(~text.rlike("^[0-9]+$"), text.try_cast("timestamp")),
        )
    elif kind == "time32":
        good = text.rlike("^([01]?[0-9]|2[0-3]):[0-5]?[0-9]:[0-5]?[0-9]$")
        part = lambda n: F.lpad(F.split_part(text, F.lit(":"), F.lit(n)), 2, "0")
        value = F.when(good, F.concat_ws(":", part(1), part(2), part(3)))
    elif kind == "string":
        value = F.col(column).cast("string")
        text = value
    else:
        value = text.try_cast(TYPE_NAMES[kind])
    if not strict:
        return value
    bad = F.raise_error(F.concat(F.lit(f"{column} is not {kind}: "), text)).cast(TYPE_NAMES[kind])
    return F.when(value.isNotNull() | text.isNull(), value).otherwise(bad)


def to_typed(df: DataFrame, kinds: dict[str, str], strict: bool = True, lenient: tuple[str, ...] = ()) -> DataFrame:
    """Text columns to contract types (R05); ``lenient`` columns turn bad values into NULL."""
    return df.select(
        *[
            typed(c, kinds[c], strict and c not in lenient).alias(c) if c in kinds else F.col(c)
            for c in df.columns
        ]
    )


def reconcile_schema(df: DataFrame, contract: DatasetContract) -> DataFrame:
    """Columns in contract order and type, changed types cast (S08); a missing column is an error."""
    missing = [f.name for f in contract.fields if f.name not in df.columns]
    if missing:
        raise ValueError(f"{contract.name}: missing columns {missing}")
    return df.select(*[F.col(f.name).cast(parse_type(f.type)).alias(f.name) for f in contract.fields])


CODE_FORMATS = {
    "canonical": codes.CANONICAL_PATTERN,
    "prefix": "^(sh|sz|bj)\\.[0-9]{6}$",
    "local": "^[0-9]{6}$",
}
