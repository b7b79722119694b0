"""Typed access to JSON documents held as ``variant``.

``from_json`` turns a number into text without a word; the payload rules refuse that, so types are looked at
before values are taken.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, functions as F


def member(doc: Column, name: str) -> Column:
    """The field (or dotted path) as a variant: NULL when absent, a variant null when the JSON says null."""
    return F.try_variant_get(doc, f"$.{name}", "variant")


def json_type(value: Column) -> Column:
    """STRING, BIGINT, VOID, ARRAY<...>, ...; NULL when absent."""
    return F.schema_of_variant(value)


def is_text(value: Column) -> Column:
    return F.coalesce(json_type(value) == "STRING", F.lit(False))


def absent_or_null(value: Column) -> Column:
    return value.isNull() | F.is_variant_null(value)


def text_of(value: Column) -> Column:
    """Text of a JSON string, NULL for everything else."""
    return F.when(is_text(value), F.try_variant_get(value, "$", "string"))


def either(doc: Column, alias: str, name: str) -> Column:
    """A field that may come under its alias or its own name; the alias counts when both are there."""
    return F.coalesce(member(doc, alias), member(doc, name))


def items(value: Column) -> Column:
    """Elements of a JSON array as variants, NULL when it is not an array."""
    return F.try_variant_get(value, "$", "array<variant>")


def whole_number_ok(value: Column) -> Column:
    """Absent, null, or something a whole number can be read from."""
    kind = json_type(value)
    number = F.try_variant_get(value, "$", "double")
    written = F.try_variant_get(value, "$", "string")
    numeric = F.regexp_like(kind, F.lit("^(TINYINT|SMALLINT|INT|BIGINT|DECIMAL.*|DOUBLE|FLOAT)$"))
    return (
        absent_or_null(value)
        | F.coalesce(kind == "BOOLEAN", F.lit(False))
        | F.coalesce(numeric & (number == F.floor(number)), F.lit(False))
        | F.coalesce((kind == "STRING") & F.regexp_like(written, F.lit(r"^\s*[+-]?\d+(\.0*)?\s*$")), F.lit(False))
    )


def members(doc: Column, name: str, fields: Sequence[str]) -> Column:
    """Fields of the object at ``name`` as variants, in one pass over it; NULL when there is no object."""
    return F.try_variant_get(doc, f"$.{name}", f"struct<{', '.join(f'{field}: variant' for field in fields)}>")


def text_list_ok(value: Column, may_hold_null: Column) -> Column:
    """Absent (the default is an empty list) or an array holding only strings.

    The type of an array of texts does not tell whether it holds nulls too. Its elements are read for that, which costs more than
    all the rest, only where ``may_hold_null``: False must mean that there is no null in it.
    """
    kind = json_type(value)
    elements = F.try_variant_get(value, "$", "array<string>")
    full = (kind == "ARRAY<STRING>") & (~may_hold_null | F.forall(elements, lambda item: item.isNotNull()))
    none = (kind == "ARRAY<VOID>") & (F.size(elements) == 0)
    return F.when(value.isNull(), True).otherwise(F.coalesce(full | none, F.lit(False)))


def text_list(value: Column) -> Column:
    return F.coalesce(F.transform(items(value), text_of), F.array().cast("array<string>"))
