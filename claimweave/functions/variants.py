"""Access to VARIANT payloads."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def text_at(payload: Column, path: str) -> Column:
    """Text at a dotted path; JSON null, a missing path and a NULL payload all give NULL."""
    return F.try_variant_get(payload, f"$.{path}", "string")


def texts_at(payload: Column, path: str) -> Column:
    """Array of texts at a dotted path, with NULL for anything that is no array."""
    return F.try_variant_get(payload, f"$.{path}", "array<string>")


def fields_at(payload: Column, names: list[str]) -> Column:
    """A struct of the texts under some names of an object, read in one pass; NULL for what is no object. Each is like `text_at`."""
    return F.try_variant_get(payload, "$", f"struct<{', '.join(f'`{name}`:string' for name in names)}>")


def parts_at(payload: Column, names: list[str]) -> Column:
    """A struct of the VARIANTs under some names of an object, read in one pass; NULL for what is no object. JSON null stays a VARIANT."""
    return F.try_variant_get(payload, "$", f"struct<{', '.join(f'`{name}`:variant' for name in names)}>")


def null_as_null(value: Column) -> Column:
    """A VARIANT with JSON null turned into NULL. Give a column, for it is looked at twice."""
    return F.when(~F.is_variant_null(value), value)


def value_at(payload: Column, path: str) -> Column:
    """VARIANT at a dotted path, with JSON null turned into NULL."""
    value = F.try_variant_get(payload, f"$.{path}", "variant")
    return F.when(~F.is_variant_null(value), value)


def is_object(value: Column) -> Column:
    """Only objects can be read as a struct; unlike deriving the schema, this does not walk through the whole value."""
    return F.try_variant_get(value, "$", "struct<any:string>").isNotNull()


def wrapped(field: str, value: Column) -> Column:
    """VARIANT object with one field."""
    return F.to_variant_object(F.struct(value.alias(field)))


def entries(rows: DataFrame, payload: str) -> DataFrame:
    """One row per key of an object, with the columns pos, key and value added."""
    return rows.lateralJoin(rows.sparkSession.tvf.variant_explode(F.col(payload).outer()))
