"""JSON columns: decoding with rejects instead of errors, and packing."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

COLUMN_LIST = "array<struct<Name:string,Type:string,Comment:string>>"
DESCRIPTOR = f"struct<Columns:{COLUMN_LIST},Location:string>"


def decoded(text: Column) -> Column:
    """JSON text to a VARIANT; empty text and text that is not JSON give null."""
    return F.try_parse_json(F.nullif(text, F.lit("")))


def is_rejected(text: Column) -> Column:
    """True where there is text but it is not JSON."""
    return F.coalesce(text != "", F.lit(False)) & decoded(text).isNull()


def text_field(text: Column, field: str) -> Column:
    """A string member of a JSON object; null when absent or when the text is no object."""
    return F.try_variant_get(decoded(text), f'$["{field}"]', "string")


def is_json_string(value: Column) -> Column:
    """True for VARIANT strings only, so numbers are not turned into text."""
    return F.coalesce(F.schema_of_variant(value) == "STRING", F.lit(False))


def is_json_object(value: Column) -> Column:
    return F.try_variant_get(value, "$", "map<string,variant>").isNotNull()


def packed(columns: Sequence[str], json_columns: Sequence[str]) -> Column:
    """Columns as one JSON document; JSON columns are nested, nulls are kept."""
    fields = [
        (decoded(F.col(name)) if name in json_columns else F.col(name)).alias(name)
        for name in columns
    ]
    return F.to_json(F.struct(*fields), {"ignoreNullFields": "false"})


def column_list(text: Column) -> Column:
    """Partition keys text to an array of (Name, Type, Comment), never null."""
    return F.coalesce(F.from_json(text, COLUMN_LIST), F.array().cast(COLUMN_LIST))


def descriptor(text: Column) -> Column:
    return F.from_json(text, DESCRIPTOR)


def descriptor_columns(text: Column) -> Column:
    return F.coalesce(descriptor(text)["Columns"], F.array().cast(COLUMN_LIST))


def named(columns: Column) -> Column:
    """Keep the entries that have a non-empty name."""
    return F.filter(columns, lambda c: F.coalesce(c["Name"] != "", F.lit(False)))


def partition_names(text: Column) -> Column:
    """Partition column names in declaration order."""
    return F.transform(named(column_list(text)), lambda c: c["Name"])
