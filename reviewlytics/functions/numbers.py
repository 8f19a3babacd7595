"""Rounding and means that do not depend on summation order."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def round_half_up(value: Column, places: int = 2) -> Column:
    """SQL ``ROUND``. Goes through a decimal first: a binary double near a tie rounds wrongly."""
    return F.round(value.cast("decimal(18,8)"), places).cast("double")


def round_half_even(value: Column, places: int = 2) -> Column:
    """Banker's rounding, the client-side default of the result models."""
    return F.bround(value.cast("decimal(18,8)"), places).cast("double")


def scaled(value: Column, places: int) -> Column:
    """Fixed-point value as a long, so that sums are exact whatever their order."""
    return F.round(value * F.lit(10**places), 0).cast("bigint")


def exact_sum(value: Column, places: int) -> Column:
    return F.sum(scaled(value, places))


def exact_mean(value: Column, places: int) -> Column:
    """Mean of fixed-point numbers: long sum, one division at the end. NULL without rows.

    A decimal sum would overflow its precision at some 10^11 rows, and a double sum depends
    on the order in which partial results arrive.
    """
    total = exact_sum(value, places).cast("double")
    return F.when(F.count(value) > 0, total / (F.lit(float(10**places)) * F.count(value)))
