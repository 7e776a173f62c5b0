"""Column → Column building blocks, all of them JVM-side built-ins."""

from adlake.functions.expressions import (
    adjusted_roi,
    any_negative,
    conversion_category,
    ctr,
    ctr_when_served,
    is_negative,
    outside_unit_range,
    parse_currency,
    parse_date,
    roi_risk,
    safe_div,
)

__all__ = [
    "adjusted_roi",
    "any_negative",
    "conversion_category",
    "ctr",
    "ctr_when_served",
    "is_negative",
    "outside_unit_range",
    "parse_currency",
    "parse_date",
    "roi_risk",
    "safe_div",
]
