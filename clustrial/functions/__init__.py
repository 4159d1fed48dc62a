"""Column functions; all of them work on batch and streaming frames alike."""

from clustrial.functions.missing import (
    cap_at,
    has_keys,
    nan_as_missing,
    indicator,
    quoted,
    ratio,
    sum_or_zero,
    text,
)
from clustrial.functions.orgs import alert_org_type, org_id, org_type
from clustrial.functions.periods import (
    ALERT_WINDOW,
    PAGE_VIEW_WINDOW,
    Periods,
    Window,
    classify_period,
    date_text,
    days_between,
    event_window,
    month_range,
    parse_compact_date,
    parse_iso_date,
    parse_visit_date,
)

__all__ = [
    "ALERT_WINDOW",
    "PAGE_VIEW_WINDOW",
    "Periods",
    "Window",
    "alert_org_type",
    "cap_at",
    "classify_period",
    "date_text",
    "days_between",
    "event_window",
    "has_keys",
    "nan_as_missing",
    "indicator",
    "month_range",
    "org_id",
    "org_type",
    "parse_compact_date",
    "parse_iso_date",
    "parse_visit_date",
    "quoted",
    "ratio",
    "sum_or_zero",
    "text",
]
