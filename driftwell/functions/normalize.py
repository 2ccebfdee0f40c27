"""Canonical text of values, row hashes and origins."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: What a block without rows hashes to in compat mode, and how fields and rows are joined (fixed values).
EMPTY_BLOCK, JOINER = "EMPTY_BLOCK", "|"
_NULL = "\x00"


def check_identifier(name: str) -> str:
    """Schema, table and key names that go into SQL text."""
    if not re.fullmatch(r"[a-zA-Z_][a-zA-Z0-9_]*", name):
        raise ValueError(f"invalid identifier: {name!r}")
    return name


def trim_scale(number: Column) -> Column:
    """The text of a decimal without trailing zeros of its fraction."""
    text = number.cast("string")
    return F.when(F.instr(text, ".") > 0, F.rtrim(F.rtrim(text, F.lit("0")), F.lit("."))).otherwise(text)


def _exact(c: Column, kind: T.DataType) -> Column:
    """A value by a text, or for nested ones by texts in the same nesting, that depend on the value alone."""
    if isinstance(kind, T.DecimalType):
        return trim_scale(c)
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        return (c + F.lit(0).cast(kind)).cast("string")
    if isinstance(kind, T.TimestampType):
        return F.unix_micros(c).cast("string")
    if isinstance(kind, T.BinaryType):
        return F.lower(F.hex(c))
    if isinstance(kind, T.StructType):
        return F.when(c.isNotNull(), F.struct(*[_exact(c[f.name], f.dataType).alias(f.name) for f in kind]))
    if isinstance(kind, T.ArrayType):
        return F.transform(c, lambda x: _exact(x, kind.elementType))
    if isinstance(kind, T.MapType):
        entries = F.transform(F.map_entries(c), lambda e: F.struct(_exact(e["key"], kind.keyType).alias("key"), _exact(e["value"], kind.valueType).alias("value")))
        return F.array_sort(entries)
    if isinstance(kind, T.VariantType):
        return F.to_json(c)
    return c.cast("string")


def canonical(df: DataFrame, name: str) -> Column:
    """A column as the text by which it is hashed: decimals without trailing zeros, binary as hex, timestamps as
    microseconds since 1970, so that neither the session's zone nor a clock change matters, and nested values as JSON of such
    texts, maps as sorted entries. A double has the text that gives back exactly its value; as in comparisons,
    both zeros are one value and so are all NaN."""
    kind, c = df.schema[name].dataType, F.col(f"`{name}`")
    text = _exact(c, kind)
    return F.to_json(text) if isinstance(kind, (T.ArrayType, T.MapType, T.StructType)) else text


def row_text(df: DataFrame, columns: list[str], mode: str = "strict") -> Column:
    """The text of a row. ``compat`` joins values with a bar and writes NULL as the empty text, so both
    can hide a difference; ``strict`` writes the length of each value and a mark for NULL."""
    values = [canonical(df, c) for c in columns]
    if mode == "compat":
        return F.concat_ws(JOINER, *[F.coalesce(v, F.lit("")) for v in values])
    if mode != "strict":
        raise ValueError(f"unknown hash mode {mode!r}")
    return F.concat(*[F.coalesce(F.concat(F.length(v).cast("string"), F.lit(":"), v), F.lit(_NULL)) for v in values])


def row_hash(df: DataFrame, columns: list[str], mode: str = "strict") -> Column:
    return F.sha2(row_text(df, columns, mode), 256)


def origin_name(origin: Column, names: dict[str, str]) -> Column:
    """Null and '' are no origin, '0' is this node, known ids get their names, others stay."""
    out = F.when(origin.isNull() | (origin == ""), F.lit(None).cast("string")).when(origin == "0", F.lit("local"))
    for k, name in names.items():
        out = out.when(origin == k, F.lit(name))
    return out.otherwise(origin)


def epoch_timestamp(number: Column) -> Column:
    """A timestamp from an epoch in seconds, milli-, micro- or nanoseconds, told by its magnitude."""
    n, size = number.cast("decimal(38,0)"), F.abs(number.cast("decimal(38,0)"))
    micros = F.when(size < 10**11, n * 10**6).when(size < 10**14, n * 1000).when(size < 10**17, n).otherwise(F.floor(n / 1000))
    return F.timestamp_micros(micros.cast("long"))


def lsn_number(text: Column) -> Column:
    """A log position 'HIGH/LOW' in hex as a number."""
    parts = F.split(text, "/")
    return F.conv(parts[0], 16, 10).cast("decimal(20,0)") * F.lit(2**32).cast("decimal(20,0)") + F.conv(parts[1], 16, 10).cast("decimal(20,0)")


def lsn_text(number: Column) -> Column:
    high = F.floor(number / F.lit(2**32)).cast("long")
    return F.concat(F.hex(high), F.lit("/"), F.hex((number - high * F.lit(2**32)).cast("long")))


def parsed_timestamp(text: Column) -> Column:
    """A timestamp from text in ISO form, with or without a zone, 'T' or a blank between date and time, and
    up to nine digits of a fraction; anything else is null. Without a zone, the session's counts."""
    iso = F.regexp_replace(F.trim(text), r"^(\d{4,}-\d\d-\d\d)[Tt ](\d\d:\d\d)", "$1 $2")
    short = F.regexp_replace(iso, r"(\.\d{6})\d+", "$1")
    zone = F.regexp_replace(short, r"([+-]\d\d)(\d\d)?$", "$1:$2")
    fixed = F.when(short.rlike(r"\d\d:\d\d(:\d\d(\.\d+)?)?[+-]\d\d(\d\d)?$"), F.regexp_replace(zone, ":$", ":00")).otherwise(short)
    return F.when(iso.rlike(r"^\d{4,}-\d\d-\d\d( |$)"), fixed.try_cast("timestamp"))


def time_micros(text: Column) -> Column:
    """Microseconds since midnight from 'HH:MM[:SS[.fraction]]'; anything else is null. 24:00 is a day."""
    part = lambda k: F.regexp_extract(F.trim(text), r"^(\d{1,2}):(\d\d)(?::(\d\d)(?:\.(\d{1,9}))?)?$", k)
    number = lambda k: F.when(part(k) == "", 0).otherwise(part(k)).cast("long")
    micros = F.substring(F.rpad(part(4), 6, "0"), 1, 6).cast("long")
    whole = ((number(1) * 60 + number(2)) * 60 + number(3)) * 1_000_000 + F.coalesce(micros, F.lit(0))
    return F.when((part(1) != "") & (number(2) < 60) & (number(3) < 60) & (whole <= 86_400_000_000), whole)


def decoded_bytes(text: Column) -> Column:
    """Bytes from text: hex behind '\\x' or '0x', else base64; text that is neither is null."""
    digits = F.regexp_extract(text, r"^(?:\\x|0x)((?:[0-9A-Fa-f]{2})*)$", 1)
    return F.when(text.rlike(r"^(\\x|0x)"), F.when(text.rlike(r"^(\\x|0x)([0-9A-Fa-f]{2})*$"), F.unhex(digits))).otherwise(F.try_to_binary(text, F.lit("base64")))
