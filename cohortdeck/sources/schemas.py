"""Declared schemas of the stored summaries."""

from __future__ import annotations

from pyspark.sql.types import DateType, DecimalType, IntegerType, LongType, StringType, StructField, StructType


def _rows(*fields: tuple[str, object]) -> StructType:
    return StructType([StructField(name, kind, True) for name, kind in fields])


def conversion_funnel_schema(dims: dict[str, object] | None = None, rate: DecimalType | None = None) -> StructType:
    """The conversion funnel; ``dims`` are its group columns, ``rate`` the scale of rates."""
    rate = rate or DecimalType(18, 4)
    return _rows(
        *(dims or {"cohort": StringType()}).items(),
        ("viewers", LongType()),
        ("payment_viewers", LongType()),
        ("subs", LongType()),
        ("view_to_payment", rate),
        ("payment_to_sub", rate),
        ("view_to_sub", rate),
        ("total_cash", rate),
        ("arpu", rate),
        ("resignations", LongType()),
        ("resign_rate", rate),
    )


ONBOARDING_STEPS = ("users", "created", "submitted", "approved", "photo_approved", "viewers", "subs")
ONBOARDING_RATES = (
    "created_rate",
    "submitted_rate",
    "approved_rate",
    "photo_approved_rate",
    "viewer_rate",
    "subs_rate",
    "subs_per_viewer",
)

ONBOARDING_FUNNEL = _rows(
    ("cohort", StringType()),
    *[(step, LongType()) for step in ONBOARDING_STEPS],
    *[(rate, DecimalType(18, 4)) for rate in ONBOARDING_RATES],
)

MERGED_METRICS = _rows(
    ("metric_date", DateType()),
    ("created", IntegerType()),
    ("presented", IntegerType()),
    ("clicked", IntegerType()),
)
