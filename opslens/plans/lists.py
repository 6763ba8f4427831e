"""Delimited lists and formatted times."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from opslens.functions import dates

# The style codes and pictures shown.
SHOWN_STYLES = [101, 102, 103, 104, 108, 111, 112, 120, 126]
SHOWN_PICTURES = {
    "month_year": "MMMM, yyyy",
    "short_month": "MMM-yyyy",
    "weekday": "EEEE MMMM d",
    "arrows": "yyyy -> MM -> dd",
    "hours_minutes": "h'h', m'm'",
}


def split_list(df: DataFrame, column: str, separator: str = ",") -> DataFrame:
    """Delimited text to one row per item with its position from 1; the text itself is dropped."""
    items = F.posexplode(F.split(column, "\\Q" + separator + "\\E"))
    others = [c for c in df.columns if c != column]
    return df.select(*others, items.alias("_position", "item")).select(
        *others, (F.col("_position") + 1).cast("long").alias("item_no"), "item")


def timestamp_formats(df: DataFrame, column: str) -> DataFrame:
    """A time in every style and picture."""
    c: Column = F.col(column)
    return df.select(
        "*", *[dates.style_text(c, s).alias(f"style_{s}") for s in SHOWN_STYLES],
        *[F.date_format(c, p).alias(name) for name, p in SHOWN_PICTURES.items()])
