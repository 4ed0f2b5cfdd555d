"""Newest row per key."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def newest_first(timestamp: str, tie_break: str) -> list[Column]:
    """Order that puts the newest row first; a missing timestamp counts as newest, ties go to the smallest id."""
    return [F.col(timestamp).desc_nulls_first(), F.col(tie_break).asc()]


def newest_per_key(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """First row of every key in the given order.

    Spark limits each group to one row on the map side as well (WindowGroupLimit), so a key with very many versions sends
    one row per map task through the shuffle.
    """
    position = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return rows.withColumn("_position", position).filter(F.col("_position") == 1).drop("_position")


def latest_extractions(extractions: DataFrame) -> DataFrame:
    """Newest successful extraction of every document; newer failed attempts do not hide it."""
    done = extractions.filter(F.col("extraction_status") == "EXTRACTED")
    return newest_per_key(done, ["claim_id", "document_id"], newest_first("extracted_at", "extraction_id"))


def current_documents(documents: DataFrame) -> DataFrame:
    """Newest document row per path."""
    return newest_per_key(documents, ["relative_path"], newest_first("uploaded_at", "document_id"))
