"""Calendar helpers."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def parse_log_date(text: Column) -> Column:
    """``y-m-d`` text to DATE, unpadded parts allowed; NULL for anything else."""
    return F.try_to_timestamp(text, F.lit("y-M-d")).cast("date")


def days_between(first: Column, last: Column) -> Column:
    """Every date from first to last, both included; empty when first is later."""
    return F.when(
        first <= last, F.sequence(first, last, F.expr("interval 1 day"))
    ).otherwise(F.array().cast("array<date>"))
