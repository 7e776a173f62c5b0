"""Scalar expressions of the campaign model.

They are safe under ANSI mode: text is parsed with the ``try_`` forms and every
division is guarded, so one dirty row cannot fail a job that reads many others.
None of them is a Python UDF; all stay inside whole-stage code generation.
"""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from adlake import spec as S


def safe_div(numerator: Column, denominator: Column) -> Column:
    """Ratio as double; 0 where the denominator is 0 or null."""
    undefined = denominator.isNull() | (denominator == 0)
    return F.when(undefined, F.lit(0.0)).otherwise(numerator / denominator)


def parse_currency(text: Column) -> Column:
    """``"$16,174.00"`` → 16174.0. Missing text is 0, unreadable text is null."""
    digits = F.translate(text, "$,", "")
    return F.when(text.isNull(), F.lit(0.0)).otherwise(digits.try_cast("double"))


def parse_date(text: Column, formats: Iterable[str] = S.DATE_FORMATS) -> Column:
    """First of ``formats`` that reads the text, else null."""
    return F.coalesce(*(F.try_to_date(text, fmt) for fmt in formats))


def ctr(clicks: Column, impressions: Column) -> Column:
    """Click-through rate; 0 without impressions, null without a click count."""
    return safe_div(clicks, impressions)


def ctr_when_served(clicks: Column, impressions: Column) -> Column:
    """Click-through rate that is 0 unless impressions are positive."""
    return F.when(impressions > 0, clicks / impressions).otherwise(F.lit(0.0))


def conversion_category(rate: Column) -> Column:
    """High, Medium or Low performance; a missing rate is Low."""
    return (
        F.when(rate > S.HIGH_CONVERSION_ABOVE, F.lit("High"))
        .when(rate >= S.MEDIUM_CONVERSION_FROM, F.lit("Medium"))
        .otherwise(F.lit("Low"))
    )


def adjusted_roi(roi: Column) -> Column:
    """ROI clamped to the allowed band; null stays null.

    ``least``/``greatest`` skip nulls, hence the guard around them.
    """
    capped = F.least(roi, F.lit(S.ROI_CEILING))
    return F.when(roi.isNotNull(), F.greatest(capped, F.lit(S.ROI_FLOOR)))


def roi_risk(roi: Column) -> Column:
    """Risk level by ROI; a missing ROI is High Risk."""
    return (
        F.when(roi >= S.LOW_RISK_FROM, F.lit("Low Risk"))
        .when(roi >= S.MEDIUM_RISK_FROM, F.lit("Medium Risk"))
        .otherwise(F.lit("High Risk"))
    )


def is_negative(value: Column) -> Column:
    return value < 0


def any_negative(values: Iterable[Column]) -> Column:
    """True if one of the numeric columns is below zero."""
    return reduce(or_, (is_negative(value) for value in values))


def outside_unit_range(value: Column) -> Column:
    """True outside [0, 1]; null for null."""
    return ~value.between(0, 1)
