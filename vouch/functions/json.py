"""Reading values of changing name and type out of VARIANT columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F

from vouch.functions.text import let, or_null

# How a number, flag, list or object that counts as "no value"
# reads as text.
_FALSY_TEXT = ("0", "false", "[]", "{}")


def field(value: Column, key: str, type_: str = "string") -> Column:
    return F.try_variant_get(value, f"$.{key}", type_)


def pick(value: Column, *keys: str, default: str | None = None) -> Column:
    """First field that is present, non-null and not ``""``."""
    found = [or_null(field(value, key)) for key in keys]
    return F.coalesce(*found, F.lit(default).cast("string"))


def _is_text(value: Column, key: str) -> Column:
    return F.schema_of_variant(field(value, key, "variant")) == "STRING"


def truthy(value: Column, key: str) -> Column:
    """The field as text, NULL when it is empty, zero, false or an empty container."""
    text = or_null(field(value, key))
    return F.when(text.isin(*_FALSY_TEXT) & ~_is_text(value, key), None).otherwise(text)


def first_truthy(value: Column, *keys: str) -> Column:
    return F.coalesce(*[truthy(value, key) for key in keys])


def number(value: Column, type_: str, *keys: str) -> Column:
    """First truthy field, else the last one, as a number; NULL if it is not one."""
    last = field(value, keys[-1], type_)
    return reduce(
        lambda rest, key: F.when(truthy(value, key).isNotNull(), field(value, key, type_)).otherwise(rest),
        reversed(keys[:-1]),
        last,
    )


def is_object(value: Column) -> Column:
    return F.coalesce(F.schema_of_variant(value).startswith("OBJECT"), F.lit(False))


def strict_parse(text: Column) -> Column:
    """A list of the one JSON value in ``text``; NULL when it is broken or more follows.

    The parser stops after the first complete value, so text such as ``{"a": 1} x`` would
    pass.  Inside brackets the rest makes it fail.
    """
    wrapped = F.try_parse_json(F.concat(F.lit("["), text, F.lit("]")))
    return let(
        F.try_variant_get(wrapped, "$", "array<variant>"),
        lambda values: F.when(F.size(values) == 1, values),
    )
