"""Organisation ids and types from page paths and alert records."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def org_type(page: Column | str, literal: bool = False) -> Column:
    """``ccg`` for region pages, else ``practice``.

    ``literal`` calls any path with ``ccg`` anywhere in it a region page, so
    ``/practice/A81001/?from=ccg`` counts as one; the default looks at the start only.
    """
    page = F.col(page) if isinstance(page, str) else page
    region = page.contains("ccg") if literal else page.startswith("/ccg/")
    return F.when(region, "ccg").otherwise("practice")


def org_id(page: Column | str, literal: bool = False) -> Column:
    """The region or practice code in a page path.

    ``literal`` drops the prefix and takes the first 3 or 6 characters; the default
    takes the path segment behind the prefix and gives null for other paths.
    """
    page = F.col(page) if isinstance(page, str) else page
    if literal:
        region = F.substring(F.replace(page, F.lit("/ccg/"), F.lit("")), 1, 3)
        practice = F.substring(F.replace(page, F.lit("/practice/"), F.lit("")), 1, 6)
        return F.when(page.contains("ccg"), region).otherwise(practice)
    return F.nullif(F.regexp_extract(page, "^/(?:ccg|practice)/([^/?#]+)", 1), F.lit(""))


def alert_org_type(
    region: Column | str,
    practice: Column | str,
    region_length: int = 3,
    practice_length: int | None = 6,
) -> Column:
    """``ccg``, ``practice`` or ``none``, told by the length of the ids.

    ``practice_length=None`` takes any practice id, for code schemes of other lengths.
    """
    practice = F.col(practice) if isinstance(practice, str) else practice
    is_practice = (
        practice.isNotNull() if practice_length is None else F.length(practice) == practice_length
    )
    return (
        F.when(F.length(region) == region_length, "ccg")
        .when(is_practice, "practice")
        .otherwise("none")
    )
