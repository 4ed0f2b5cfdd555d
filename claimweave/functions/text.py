"""Text expressions shared by all operators."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def name_key(value: Column) -> Column:
    """Comparison key of a person or medicine name: upper case, ASCII letters and digits only."""
    return F.regexp_replace(F.upper(value), "[^A-Z0-9]", "")


def blank_to_null(value: Column) -> Column:
    trimmed = F.trim(value)
    return F.when(trimmed != "", trimmed)


def is_blank(value: Column) -> Column:
    """True for NULL, empty and white-space-only text."""
    return F.coalesce(value, F.lit("")).rlike(r"^\s*$")


def sanitize_name(value: Column) -> Column:
    """Folder- or file-safe form of a text."""
    return F.regexp_replace(F.regexp_replace(value, "[^A-Za-z0-9._-]+", "_"), "^[._-]+|[._-]+$", "")


def normalize_folder(path: Column) -> Column:
    return F.regexp_replace(F.trim(path), "/+$", "")


def stable_id(*parts: Column) -> Column:
    """Id that stays the same when a batch is replayed."""
    return F.sha2(F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]), 256)
