"""Explicit schemas of the trial's input files and warehouse tables.

Nothing is inferred: ids such as ``01F`` or ``00D`` look like Java doubles to
CSV inference, and the same column is an integer in one file and a float in
another.
"""

from __future__ import annotations

# Column names and types of the inputs.
SCHEMAS: dict[str, str] = {
    "allocation": (
        "_idx INT, joint_id STRING, numerator DOUBLE, denominator DOUBLE, baseline DOUBLE, "
        "baseline_ranking DOUBLE, rand_num DOUBLE, allocation_ranking DOUBLE, "
        "allocation_code DOUBLE, allocation STRING, name STRING, joint_team STRING, "
        "CCGs_included DOUBLE"
    ),
    "teams": "ccg_id STRING, joint_team STRING",
    "visited_clusters": (
        "_idx INT, joint_id STRING, name STRING, joint_team STRING, CCGs_included DOUBLE"
    ),
    "visit_timetable": "joint_id STRING, date STRING",
    "populations": "_idx INT, pct_id STRING, over_65 DOUBLE, total_list_size DOUBLE",
    "list_sizes": "_idx INT, pct_id STRING, list_size BIGINT",
    "code_list": "bnf_code STRING, name STRING",
    "prescribing": (
        "month DATE, practice STRING, bnf_code STRING, items BIGINT, actual_cost DOUBLE"
    ),
    "practice_statistics": (
        "month DATE, practice STRING, total_list_size BIGINT, male_65_74 BIGINT, "
        "male_75_plus BIGINT, female_65_74 BIGINT, female_75_plus BIGINT"
    ),
    "practices": "code STRING, ccg_id STRING, setting INT, status_code STRING",
    "region_measure": "month DATE, pct_id STRING, numerator DOUBLE, denominator DOUBLE",
    "regions": "code STRING, name STRING, org_type STRING",
    "measure_data": (
        "_idx INT, month DATE, pct_id STRING, items BIGINT, cost DOUBLE, "
        "denominator DOUBLE, measure STRING"
    ),
    "page_views": "Page STRING, Date STRING, Pageviews BIGINT, `Unique Pageviews` BIGINT",
    "practice_regions": "_idx INT, ccg_id STRING, code STRING",
    "alerts": (
        "created_at STRING, approved STRING, pct_id STRING, practice_id STRING, user_id STRING"
    ),
}
