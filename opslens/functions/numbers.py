"""Numeric semantics: truncating division, unit conversion, zero-safe ratios."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

PAGES_PER_MB = 128
MB = 1024 * 1024
GB = 1024 * MB


def int_div(a: Column, b: Column | int) -> Column:
    """Integer division that truncates."""
    return F.call_function("div", a.cast("long"), b if isinstance(b, Column) else F.lit(b))


def int_avg(c: Column) -> Column:
    """Average of integers that truncates, as an aggregate."""
    return F.call_function("div", F.sum(c.cast("long")), F.count(c))


def decimal(c: Column, precision: int, scale: int) -> Column:
    return c.cast(f"decimal({precision},{scale})")


def exact_div(a: Column, b: Column | int, scale: int) -> Column:
    """Decimal quotient of two integers at a fixed scale; null for a zero divisor."""
    b = b if isinstance(b, Column) else F.lit(b)
    quotient = a.cast("decimal(20,0)") / F.nullif(b.cast("decimal(20,0)"), F.lit(0).cast("decimal(20,0)"))
    return F.round(quotient, scale).cast(f"decimal(30,{scale})")


def bytes_to_gb(c: Column, precision: int = 20, scale: int = 4) -> Column:
    """Bytes to GB; wide enough that no fleet total overflows."""
    return decimal(c / GB, precision, scale)


def pages_to_mb(c: Column) -> Column:
    """8 KB pages to MB with two decimals; exact because a page is 1/128 MB."""
    return decimal(c.cast("decimal(20,0)") / F.lit(PAGES_PER_MB).cast("decimal(4,0)"), 30, 2)


def whole_gb(bytes_: Column) -> Column:
    """Bytes to whole GB, truncating at MB and again at GB."""
    return int_div(int_div(bytes_, MB), 1024)


def target_free_add(total_gb: Column, free_gb: Column, target_percent: float) -> Column:
    """GB to add so that ``target_percent`` of the grown volume is free."""
    share = target_percent / 100
    return (total_gb * F.lit(share) - free_gb) / F.nullif(F.lit(1 - share), F.lit(0.0))


def next_growth_mb(size_pages: Column, growth: Column, is_percent: Column) -> Column:
    """Size of the next automatic growth in MB."""
    percent = size_pages.cast("decimal(20,0)") * growth.cast("decimal(10,0)") / F.lit(100 * PAGES_PER_MB)
    fixed = growth.cast("decimal(20,0)") / F.lit(PAGES_PER_MB)
    return decimal(F.when(is_percent, percent).otherwise(fixed), 20, 2)


def system_reserve_gb(memory_gb: Column) -> Column:
    """Memory to leave to the operating system, in GB, as a piecewise linear rule."""
    return (
        F.when(memory_gb <= 2, F.lit(0.5))
        .when(memory_gb < 4, F.lit(2.0))
        .when(memory_gb <= 16, 1.0 + memory_gb / 4.0)
        .otherwise(5.0 + (memory_gb - 16.0) / 8.0)
    )
