"""Pages of ordered rows: by offset, and after a key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.errors import INPUT_INVALID, RecordError
from palimpsest.plans.requests import Page


def ordered_page(df: DataFrame, order: list[Column], page: Page) -> DataFrame:
    """The rows of one page, in order; a limit of 0 or less means all. Runs as a top-k, not a full sort."""
    out = df.orderBy(*order)
    if page.limit > 0:
        out = out.limit(page.offset + page.limit)
    return out.offset(page.offset) if page.offset else out


def next_cursor(df: DataFrame, page: Page) -> str:
    """The cursor of the page after this one, or nothing if no row is left."""
    if page.limit <= 0:
        return ""
    end = page.offset + page.limit
    return f"offset:{end}" if df.offset(end).limit(1).count() else ""


def key_cursor(score: float, kind: str, record_id: str) -> str:
    return f"key:{score:.17g}:{kind}:{record_id}"


def after_key(df: DataFrame, cursor: str) -> DataFrame:
    """Rows (score, hit_type, record_id) that come after the cursor's in the order score desc, type, id."""
    if not cursor:
        return df
    try:
        head, score, kind, record_id = cursor.split(":", 3)
        value = float(score)
    except ValueError:
        head, value = "", 0.0
    if head != "key":
        raise RecordError(INPUT_INVALID, "cursor is not of the form key:score:type:id", cursor=cursor)
    same = F.col("score") == value
    later = (F.col("score") < value) | (same & (F.col("hit_type") > kind)) | (same & (F.col("hit_type") == kind) & (F.col("record_id") > record_id))
    if df.where(same & (F.col("hit_type") == kind) & (F.col("record_id") == record_id)).isEmpty():
        raise RecordError(INPUT_INVALID, "cursor_invalid", cursor=cursor)
    return df.where(later)
