"""The SQL each query is checked with, on the same tables in another engine.

Written from the definitions of the outcomes, not from the Spark code: rules and
cut-offs are repeated here as SQL.
"""

from __future__ import annotations

from collections.abc import Sequence

KINDS = ("ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD")
# Measure and rule: each kind of part in three ranges of size, and two sets of brands.
REGISTRY = {f"{kind.lower()}_s": f"p_type = '{kind}' AND p_size <= 16" for kind in KINDS}
REGISTRY |= {f"{kind.lower()}_m": f"p_type = '{kind}' AND p_size BETWEEN 17 AND 33" for kind in KINDS}
REGISTRY |= {f"{kind.lower()}_l": f"p_type = '{kind}' AND p_size > 33" for kind in KINDS}
REGISTRY |= {
    "brand_7": "p_brand = 'Brand#7'",
    "brand_1x": "p_brand = 'Brand#11' OR p_brand = 'Brand#12' OR p_brand = 'Brand#13'",
}
BASELINE, MID, FOLLOW_UP, AFTER = "1997-04-01", "1997-10-01", "1998-04-01", "1998-10-01"
EXCLUDED = "('01A', '02B', '03F')"

# Named pieces; each may use the ones before it.
PIECES: dict[str, str] = {
    "practices": """
        SELECT c_custkey AS code, 'P' || printf('%05d', c_custkey) AS code_text,
               lpad(CAST(c_nationkey AS VARCHAR), 2, '0') || substr(c_mktsegment, 1, 1) AS pct_id,
               CASE WHEN c_acctbal >= 0 THEN 4 ELSE 1 END AS setting,
               CASE WHEN c_acctbal >= 9500 THEN 'C' ELSE 'A' END AS status_code
        FROM customer""",
    "stats": """
        SELECT o_custkey AS practice, CAST(date_trunc('month', o_orderdate) AS DATE) AS month,
               CAST(o_totalprice AS DECIMAL(18, 2)) AS list_size,
               CASE WHEN o_orderpriority = '1-URGENT' THEN CAST(o_totalprice AS DECIMAL(18, 2))
                    ELSE 0 END AS over_65
        FROM orders""",
    "grid": f"""
        SELECT month, pct_id, CAST(sum(list_size) AS DOUBLE) / 1000 AS denominator
        FROM stats JOIN practices ON practice = code
        WHERE setting = 4 AND month BETWEEN DATE '{BASELINE}' AND DATE '{AFTER}'
        GROUP BY month, pct_id""",
    "lines": f"""
        SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS month, pct_id, l_partkey AS part,
               CAST(l_quantity AS BIGINT) AS items,
               CAST(l_extendedprice * (1 - l_discount) AS DECIMAL(18, 4)) AS cost
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN practices ON o_custkey = code
        WHERE setting = 4
          AND CAST(date_trunc('month', o_orderdate) AS DATE)
              BETWEEN DATE '{BASELINE}' AND DATE '{AFTER}'""",
    "rules": " UNION ALL ".join(
        f"SELECT p_partkey AS part, '{name}' AS measure FROM part WHERE {rule}"
        for name, rule in REGISTRY.items()
    ),
    "names": "SELECT unnest(["
    + ", ".join(f"'{name}'" for name in REGISTRY)
    + "]) AS measure",
    "numerators": """
        SELECT month, pct_id, measure, sum(items) AS items, sum(cost) AS cost
        FROM lines JOIN rules USING (part) GROUP BY month, pct_id, measure""",
    "monthly": """
        SELECT month, pct_id, measure, CAST(coalesce(items, 0) AS BIGINT) AS items,
               CAST(coalesce(cost, 0) AS DECIMAL(28, 4)) AS cost, denominator
        FROM grid CROSS JOIN names LEFT JOIN numerators USING (month, pct_id, measure)""",
    "combined": """
        SELECT pct_id, month, CAST(sum(items) AS BIGINT) AS items, sum(cost) AS cost,
               max(denominator) AS denominator
        FROM monthly GROUP BY pct_id, month""",
    "teams": """
        SELECT lpad(CAST(n_nationkey AS VARCHAR), 2, '0') || letter AS ccg_id,
               'TEAM ' || n_name AS joint_team
        FROM nation, (VALUES ('A'), ('B')) AS letters(letter) WHERE n_regionkey = 0""",
    "reps": """
        SELECT joint_team, count(*) AS CCGs_included, max(ccg_id) AS joint_id
        FROM teams GROUP BY joint_team""",
    "region_rates": f"""
        SELECT pct_id, CAST(sum(cost) AS DOUBLE) AS numerator, sum(denominator) AS denominator
        FROM combined WHERE month >= DATE '{BASELINE}' AND month < DATE '{MID}'
        GROUP BY pct_id""",
    "clusters": """
        SELECT joint_id, sum(numerator) AS numerator, sum(denominator) AS denominator,
               sum(numerator) / nullif(sum(denominator), 0) AS baseline
        FROM (SELECT coalesce(joint_id, pct_id) AS joint_id, numerator, denominator
              FROM region_rates LEFT JOIN teams ON pct_id = ccg_id
              LEFT JOIN reps USING (joint_team))
        GROUP BY joint_id""",
    "ranked": """
        SELECT joint_id, baseline,
               CASE WHEN baseline IS NOT NULL
                    THEN rank() OVER (ORDER BY baseline NULLS LAST) / count(baseline) OVER ()
               END AS baseline_ranking
        FROM clusters""",
    "chosen": f"""
        SELECT * FROM ranked WHERE joint_id NOT IN {EXCLUDED}
        ORDER BY baseline_ranking DESC NULLS LAST, joint_id LIMIT 40""",
    "allocation": """
        SELECT *, CASE WHEN allocation_code = 0 THEN 'con' ELSE 'I' END AS allocation
        FROM (SELECT *, allocation_ranking % 2 AS allocation_code
              FROM (SELECT *, CAST(row_number() OVER (ORDER BY draw) AS DOUBLE)
                              AS allocation_ranking
                    FROM (SELECT *, md5('321:' || joint_id) AS draw FROM chosen)))""",
    "members": """
        SELECT a.joint_id, allocation, coalesce(ccg_id, a.joint_id) AS pct_id,
               CASE allocation WHEN 'con' THEN 0 WHEN 'I' THEN 1 END AS intervention
        FROM allocation a
        LEFT JOIN reps r ON a.joint_id = r.joint_id AND allocation = 'I'
        LEFT JOIN teams t ON t.joint_team = r.joint_team""",
    "labelled": f"""
        SELECT *, CASE WHEN month >= DATE '{FOLLOW_UP}' THEN 'follow-up' ELSE 'baseline' END
                  AS period
        FROM monthly
        WHERE (month >= DATE '{BASELINE}' AND month < DATE '{MID}')
           OR (month >= DATE '{FOLLOW_UP}' AND month < DATE '{AFTER}')""",
    "totals_by_measure": """
        SELECT pct_id, measure, period, CAST(sum(items) AS DOUBLE) AS items,
               CAST(sum(cost) AS DOUBLE) AS cost, avg(denominator) AS denominator
        FROM labelled GROUP BY pct_id, measure, period""",
    "totals": """
        SELECT pct_id, period, CAST(sum(items) AS DOUBLE) AS items,
               CAST(sum(cost) AS DOUBLE) AS cost, avg(denominator) AS denominator
        FROM (SELECT pct_id, period, month, sum(items) AS items, sum(cost) AS cost,
                     max(denominator) AS denominator
              FROM labelled GROUP BY pct_id, period, month)
        GROUP BY pct_id, period""",
}


def _wide(source: str, extra: str = "") -> str:
    cells = ", ".join(
        f"sum({value}) FILTER (period = '{period}') AS {value}_{suffix}"
        for value in ("items", "cost", "denominator")
        for period, suffix in (("baseline", "baseline"), ("follow-up", "follow_up"))
    )
    return f"""
        SELECT *, cost_baseline / nullif(denominator_baseline, 0) AS baseline_calc_value,
               cost_follow_up / nullif(denominator_follow_up, 0) AS follow_up_calc_value,
               items_baseline / nullif(denominator_baseline, 0) AS baseline_items_thou,
               items_follow_up / nullif(denominator_follow_up, 0) AS follow_up_items_thou
        FROM (SELECT joint_id, allocation, intervention{extra}, {cells}
              FROM members JOIN {source} USING (pct_id)
              GROUP BY joint_id, allocation, intervention{extra})"""


PIECES |= {
    "outcomes": _wide("totals"),
    "by_measure": _wide("totals_by_measure", ", measure"),
    "top3": """
        SELECT * FROM (
          SELECT *, rank() OVER (PARTITION BY joint_id, baseline_calc_value IS NULL
                                 ORDER BY baseline_calc_value DESC)
                    + (count(*) OVER (PARTITION BY joint_id, baseline_calc_value) - 1) / 2.0
                    AS measure_rank
          FROM by_measure)
        WHERE baseline_calc_value IS NOT NULL AND measure_rank <= 3""",
    "top_rate": """
        SELECT *, cost_baseline / nullif(denominator_baseline, 0) AS baseline_calc_value,
               cost_follow_up / nullif(denominator_follow_up, 0) AS follow_up_calc_value
        FROM (SELECT joint_id, allocation, intervention,
                     coalesce(sum(cost_baseline), 0) AS cost_baseline,
                     coalesce(sum(cost_follow_up), 0) AS cost_follow_up,
                     avg(denominator_baseline) AS denominator_baseline,
                     avg(denominator_follow_up) AS denominator_follow_up
              FROM top3 GROUP BY joint_id, allocation, intervention)""",
    "timetable": """
        SELECT joint_id,
               CASE WHEN n_regionkey <> 3
                    THEN DATE '2024-01-08' + CAST(floor(n_nationkey / 2) AS INTEGER) END AS date
        FROM allocation JOIN nation
          ON lpad(CAST(n_nationkey AS VARCHAR), 2, '0') = substr(joint_id, 1, 2)
        WHERE allocation = 'I'""",
    "flagged": """
        SELECT o.*, CASE WHEN v.date IS NOT NULL THEN 1 ELSE 0 END AS flag
        FROM outcomes o LEFT JOIN timetable v USING (joint_id)""",
    "list_sizes": f"""
        SELECT pct_id, avg(size) AS list_size
        FROM (SELECT pct_id, month, CAST(sum(list_size) AS DOUBLE) AS size
              FROM stats LEFT JOIN practices ON practice = code
              WHERE month BETWEEN DATE '{BASELINE}' AND DATE '{AFTER}'
              GROUP BY pct_id, month)
        GROUP BY pct_id""",
    "sized": """
        SELECT joint_id, allocation, intervention, date, coalesce(sum(list_size), 0) AS list_size
        FROM members LEFT JOIN list_sizes USING (pct_id) LEFT JOIN timetable USING (joint_id)
        GROUP BY joint_id, allocation, intervention, date""",
    "size_ranked": """
        SELECT *, rank() OVER (PARTITION BY allocation ORDER BY list_size)
                  + (count(*) OVER (PARTITION BY allocation, list_size) - 1) / 2.0 AS size_rank
        FROM sized""",
    "units": """
        SELECT u.joint_id, u.allocation, u.intervention, u.list_size, u.size_rank,
               i.date AS date_int
        FROM size_ranked u
        LEFT JOIN (SELECT size_rank, date FROM size_ranked WHERE allocation = 'I') i
          USING (size_rank)""",
    "trial_practices": """
        SELECT DISTINCT pct_id AS ccg_id, code_text AS code FROM practices
        WHERE setting = 4 AND status_code <> 'C' AND pct_id IN (SELECT pct_id FROM members)""",
    "org_events": """
        SELECT CAST(ts AS DATE) AS day, event_type, value, code_text, pct_id AS region, ts,
               json_extract_string(props, '$.k') AS k
        FROM events JOIN practices ON user_id = code""",
    "views": """
        SELECT CASE WHEN event_type = 'view' THEN '/ccg/' || region || '/lp' || k
                    ELSE '/practice/' || code_text || '/lp' || k END AS Page,
               CASE WHEN event_type = 'view' THEN 'ccg' ELSE 'practice' END AS org_type,
               CASE WHEN event_type = 'view' THEN region ELSE code_text END AS org_id,
               day, CAST(1 + floor(value / 100) AS BIGINT) AS views
        FROM org_events WHERE event_type IN ('view', 'click')""",
    "trial_views": """
        SELECT joint_id, intervention, list_size, org_type, Page, views,
               CASE WHEN day - date_int BETWEEN 1 AND 7 THEN 'after'
                    WHEN day - date_int BETWEEN -7 AND -1 THEN 'before' ELSE 'none' END AS timing
        FROM (SELECT v.*, CASE WHEN org_type = 'ccg' THEN org_id ELSE ccg_id END AS pct_id
              FROM views v LEFT JOIN trial_practices ON org_id = code)
        JOIN members m USING (pct_id)
        JOIN (SELECT joint_id, list_size, date_int FROM units) USING (joint_id)""",
    "view_grid": """
        SELECT joint_id, intervention, list_size, org_type,
               CAST(coalesce(sum(views) FILTER (timing = 'before'), 0) AS BIGINT) AS views_before,
               CAST(coalesce(sum(views) FILTER (timing = 'after'), 0) AS BIGINT) AS views_after,
               count(DISTINCT Page) FILTER (timing = 'before') AS pages_before,
               count(DISTINCT Page) FILTER (timing = 'after') AS pages_after
        FROM (SELECT DISTINCT joint_id, intervention, list_size FROM trial_views)
        CROSS JOIN (SELECT DISTINCT org_type FROM trial_views)
        LEFT JOIN trial_views USING (joint_id, intervention, list_size, org_type)
        GROUP BY joint_id, intervention, list_size, org_type""",
    "capped": """
        SELECT *, CASE WHEN views_before < cap_before THEN views_before ELSE cap_before END
                  AS proxy_views_before,
               CASE WHEN views_after < cap_after THEN views_after ELSE cap_after END
                  AS proxy_views_after
        FROM view_grid JOIN (
          SELECT org_type, quantile_cont(CAST(views_before AS DOUBLE), 0.95) AS cap_before,
                 quantile_cont(CAST(views_after AS DOUBLE), 0.95) AS cap_after
          FROM view_grid GROUP BY org_type) USING (org_type)""",
    "signups": """
        SELECT day, k AS user, CASE WHEN value >= 60 THEN 'ccg' ELSE 'practice' END AS org_type,
               CASE WHEN value >= 60 THEN region END AS pct,
               CASE WHEN value < 60 THEN code_text END AS practice
        FROM org_events WHERE event_type = 'signup' AND value >= 20""",
    "trial_signups": """
        SELECT joint_id, org_type, user,
               CASE WHEN day - date_int < 0 THEN 'before'
                    WHEN day - date_int BETWEEN 0 AND 10 THEN 'after' ELSE 'none' END AS timing
        FROM (SELECT s.*, coalesce(ccg_id, pct) AS pct_id
              FROM signups s LEFT JOIN trial_practices ON practice = code)
        JOIN members USING (pct_id) JOIN (SELECT joint_id, date_int FROM units) USING (joint_id)""",
    "alert_counts": "SELECT intervention, joint_id, list_size / 100000 AS list_size_100k, "
    + ", ".join(
        f"count(DISTINCT user) FILTER (org_type = '{kind}' AND timing = '{when}') "
        f"AS alerts_{kind}_{when}"
        for kind in ("ccg", "practice")
        for when in ("after", "before")
    )
    + """
        FROM (SELECT DISTINCT intervention, joint_id, list_size FROM units)
        LEFT JOIN trial_signups USING (joint_id) GROUP BY intervention, joint_id, list_size""",
}


def _with(final: str, *extra: tuple[str, str]) -> str:
    """``final`` behind the pieces it needs, found by name."""
    pieces = {**PIECES, **dict(extra)}
    names = list(pieces)
    needed: set[str] = set()
    pending = [final]
    while pending:
        words = set("".join(c if c.isalnum() or c == "_" else " " for c in pending.pop()).split())
        for name in words & set(names) - needed:
            needed.add(name)
            pending.append(pieces[name])
    body = ", ".join(f"{n} AS MATERIALIZED ({pieces[n]})" for n in names if n in needed)
    return f"WITH RECURSIVE {body} {final}" if body else final


def _r(expression: str, places: int = 6, name: str | None = None) -> str:
    name = name or expression.split(".")[-1]
    return f"round(CAST({expression} AS DOUBLE), {places}) + 0.0 AS {name}"


def _rs(columns: str, places: int = 6) -> str:
    return ", ".join(_r(c, places) for c in columns.split())


# --- regression -----------------------------------------------------------------------


def _det(cells: list[list[str]]) -> str:
    if len(cells) == 1:
        return f"({cells[0][0]})"
    terms = []
    for j, cell in enumerate(cells[0]):
        minor = [row[:j] + row[j + 1 :] for row in cells[1:]]
        terms.append(f"{'-' if j % 2 else '+'} ({cell}) * {_det(minor)}")
    return "(" + " ".join(terms) + ")"


def _inverse(k: int) -> dict[tuple[int, int], str]:
    """Cells of the inverse covariance matrix of x1..xk, by cofactors."""
    cov = [[f"s_{min(i, j)}_{max(i, j)}" for j in range(1, k + 1)] for i in range(1, k + 1)]
    det = _det(cov)
    cells = {}
    for i in range(k):
        for j in range(k):
            minor = [[c for b, c in enumerate(row) if b != i] for a, row in enumerate(cov) if a != j]
            cofactor = _det(minor) if minor else "1.0"
            cells[i + 1, j + 1] = f"(({'-' if (i + j) % 2 else ''}1.0 * {cofactor}) / {det})"
    return cells


def ols_pieces(source: str, y: str, x: Sequence[str], by: str = "") -> list[tuple[str, str]]:
    """Pieces ``ols_in`` (clean rows), ``ols_fit`` (one row per group, closed form)."""
    k = len(x)
    group = f"{by}, " if by else ""
    grouping = f"GROUP BY {by}" if by else ""
    variables = [f"CAST({y} AS DOUBLE) AS v0"] + [
        f"CAST({c} AS DOUBLE) AS v{i}" for i, c in enumerate(x, 1)
    ]
    ready = " AND ".join(f"{c} IS NOT NULL" for c in [y, *x, *([by] if by else [])])
    rows = f"SELECT *, {', '.join(variables)} FROM {source} WHERE {ready}"
    means = ", ".join(f"avg(v{i}) AS m{i}" for i in range(k + 1))
    covariances = ", ".join(
        f"covar_samp(v{i}, v{j}) AS s_{i}_{j}" for i in range(k + 1) for j in range(i, k + 1)
    )
    moments = f"SELECT {group}count(*) AS n, {means}, {covariances} FROM ols_in {grouping}"
    inverse = _inverse(k)
    slopes = ", ".join(
        " + ".join(f"{inverse[i, j]} * s_0_{j}" for j in range(1, k + 1)) + f" AS b{i}"
        for i in range(1, k + 1)
    )
    diagonal = ", ".join(f"{inverse[i, i]} / (n - 1) AS d{i}" for i in range(1, k + 1))
    quadratic = " + ".join(
        f"m{i} * m{j} * {inverse[i, j]}" for i in range(1, k + 1) for j in range(1, k + 1)
    )
    solved = (
        f"SELECT *, {slopes}, {diagonal}, 1.0 / n + ({quadratic}) / (n - 1) AS d0 FROM ols_moments"
    )
    fitted = " - ".join(f"b{i} * m{i}" for i in range(1, k + 1))
    predicted = " + ".join(f"b{i} * v{i}" for i in range(1, k + 1))
    join = f"JOIN ols_solved USING ({by})" if by else "CROSS JOIN ols_solved"
    errors = (
        f"SELECT ols_in.*, v0 - (m0 - {fitted} + {predicted}) AS e FROM ols_in {join}"
    )
    sse_join = f"JOIN ols_sse USING ({by})" if by else "CROSS JOIN ols_sse"
    sse = "CASE WHEN s_0_0 = 0 OR raw <= 1e-24 * s_0_0 * (n - 1) THEN 0 ELSE raw END"
    fit = (
        f"SELECT *, m0 - {fitted} AS b0, n - {k + 1} AS df, {sse} AS sse, "
        f"({sse}) / (n - {k + 1}) AS s2 FROM ols_solved {sse_join}"
    )
    return [
        ("ols_in", rows),
        ("ols_moments", moments),
        ("ols_solved", solved),
        ("ols_errors", errors),
        ("ols_sse", f"SELECT {group}sum(e * e) AS raw FROM ols_errors {grouping}"),
        ("ols_fit", fit),
    ]


def _terms(x: Sequence[str], by: str = "") -> str:
    group = f"{by}, " if by else ""
    return " UNION ALL ".join(
        f"SELECT {group}'{term}' AS term, b{i} AS coef, sqrt(s2 * d{i}) AS std_err, "
        f"b{i} / nullif(sqrt(s2 * d{i}), 0) AS t, df FROM ols_fit"
        for i, term in enumerate(["Intercept", *x])
    )


def ols_sql(source: str, y: str, x: Sequence[str], by: str = "", places: int = 5) -> str:
    pieces = [*ols_pieces(source, y, x, by), ("ols_terms", _terms(x, by))]
    group = f"{by}, " if by else ""
    return _with(f"SELECT {group}term, {_rs('coef std_err t', places)} FROM ols_terms", *pieces)


def _inside(t: str, df: str) -> str:
    """The share of a t distribution with whole df between -t and t, as a finite sum."""
    angle = f"atan(abs({t}) / sqrt({df}))"
    odd_sum = (
        f"list_sum(list_transform(range(0, CAST(({df} - 1) // 2 AS BIGINT)), lambda j: "
        f"exp(lgamma(j + 1) + lgamma(1.5) - lgamma(j + 1.5)) * pow(cos({angle}), 2 * j + 1)))"
    )
    even_sum = (
        f"list_sum(list_transform(range(0, CAST({df} // 2 AS BIGINT)), lambda j: "
        f"exp(lgamma(j + 0.5) - lgamma(0.5) - lgamma(j + 1)) * pow(cos({angle}), 2 * j)))"
    )
    return (
        f"CASE WHEN {df} % 2 = 1 "
        f"THEN 2 / pi() * ({angle} + sin({angle}) * coalesce({odd_sum}, 0)) "
        f"ELSE sin({angle}) * coalesce({even_sum}, 0) END"
    )


def _pvalues() -> str:
    x = ["baseline_calc_value", "intervention"]
    pieces = [
        *ols_pieces("outcomes", "follow_up_calc_value", x),
        ("ols_terms", _terms(x)),
        (
            # The critical t by halving an interval 60 times.
            "halving",
            "SELECT 0 AS step, CAST(0 AS DOUBLE) AS low, CAST(1000 AS DOUBLE) AS high, df "
            "FROM ols_fit UNION ALL "
            "SELECT step + 1, CASE WHEN share < 0.95 THEN middle ELSE low END, "
            "CASE WHEN share < 0.95 THEN high ELSE middle END, df FROM ("
            f"SELECT *, {_inside('middle', 'df')} AS share FROM ("
            "SELECT *, (low + high) / 2 AS middle FROM halving WHERE step < 60))",
        ),
    ]
    sql = (
        f"SELECT term, {_r('t', 5)}, {_r('1 - (' + _inside('t', 'o.df') + ')', 5, 'p_value')}, "
        f"{_r('coef - high * std_err', 5, 'ci_low')}, {_r('coef + high * std_err', 5, 'ci_high')} "
        "FROM ols_terms o JOIN (SELECT df, high FROM halving WHERE step = 60) h ON h.df = o.df"
    )
    return _with(sql, *pieces).replace("halving AS MATERIALIZED", "halving AS")


def _model() -> str:
    x = ["baseline_calc_value", "intervention"]
    pieces = [
        *ols_pieces("by_measure", "follow_up_calc_value", x, by="measure"),
        (
            "steps",
            "SELECT measure, e, e - lag(e) OVER (PARTITION BY measure ORDER BY joint_id) AS step "
            "FROM ols_errors",
        ),
        (
            "tests",
            "SELECT measure, sum(step * step) / nullif(sum(e * e), 0) AS dw, "
            "avg(e * e) AS c2, avg(e * e * e) AS c3, avg(e * e * e * e) AS c4 "
            "FROM steps GROUP BY measure",
        ),
        (
            "scores",
            "SELECT *, c3 / nullif(pow(c2, 1.5), 0) AS skew, c4 / nullif(c2 * c2, 0) AS kurtosis, "
            "1 - sse / nullif(s_0_0 * (n - 1), 0) AS r2, CAST(n AS DOUBLE) AS c "
            "FROM ols_fit JOIN tests USING (measure)",
        ),
        (
            "z1",
            "SELECT *, skew * sqrt((c + 1) * (c + 3) / (6 * (c - 2))) AS yy, "
            "sqrt(2 * (3 * (c * c + 27 * c - 70) * (c + 1) * (c + 3) "
            "/ ((c - 2) * (c + 5) * (c + 7) * (c + 9)) - 1)) - 1 AS w2, "
            "(kurtosis - 3 * (c - 1) / (c + 1)) / sqrt(24 * c * (c - 2) * (c - 3) "
            "/ (pow(c + 1, 2) * (c + 3) * (c + 5))) AS xx, "
            "6 * (c * c - 5 * c + 2) / ((c + 7) * (c + 9)) "
            "* sqrt(6 * (c + 3) * (c + 5) / (c * (c - 2) * (c - 3))) AS sb FROM scores",
        ),
        (
            "z2",
            "SELECT *, 6 + 8 / sb * (2 / sb + sqrt(1 + 4 / (sb * sb))) AS a, "
            "asinh(yy / sqrt(2 / (w2 - 1))) / sqrt(0.5 * ln(w2)) AS zs FROM z1",
        ),
        ("z3", "SELECT *, 1 + xx * sqrt(2 / (a - 4)) AS dd FROM z2"),
        (
            "z4",
            "SELECT *, (1 - 2 / (9 * a) - sign(dd) * pow((1 - 2 / a) / abs(dd), 1.0 / 3)) "
            "/ sqrt(2 / (9 * a)) AS zk, "
            "c / 6 * (skew * skew + (kurtosis - 3) * (kurtosis - 3) / 4) AS jb, "
            "r2 / 2 / nullif((1 - r2) / df, 0) AS f, "
            "-c / 2 * (ln(2 * pi()) + ln(sse / c) + 1) AS llf FROM z3",
        ),
    ]
    rounded = ", ".join(
        _r(expression, 5, name)
        for name, expression in {
            "r2": "r2",
            "adj_r2": "1 - (1 - r2) * (n - 1) / df",
            "f": "f",
            "f_pvalue": "pow(1 + 2 * f / df, -df / 2.0)",
            "llf": "llf",
            "aic": "-2 * llf + 6",
            "bic": "-2 * llf + 3 * ln(c)",
            "omnibus": "zs * zs + zk * zk",
            "omnibus_p": "exp(-(zs * zs + zk * zk) / 2)",
            "skew": "skew",
            "kurtosis": "kurtosis",
            "jb": "jb",
            "jb_p": "exp(-jb / 2)",
            "durbin_watson": "dw",
        }.items()
    )
    return _with(
        f"SELECT measure, n, 2 AS df_model, df AS df_resid, {rounded} FROM z4", *pieces
    )


# --- summaries --------------------------------------------------------------------------


def _summary(source: str, arm: str, before: str, after: str, names: bool = True) -> str:
    b, a = (before, after) if names else ("before", "after")
    return (
        f"{arm}, count(DISTINCT joint_id) AS units, "
        + ", ".join(
            [
                _r(f"avg({before})", 6, f"{b}_mean"),
                _r(f"stddev_samp({before})", 6, f"{b}_std"),
                _r(f"avg({after})", 6, f"{a}_mean"),
                _r(f"stddev_samp({after})", 6, f"{a}_std"),
                _r(f"avg({after}) - avg({before})", 6, "change"),
            ]
        )
        + f" FROM {source}"
    )


SHARES = {"p10": 0.1, "p25": 0.25, "p50": 0.5, "p75": 0.75, "p80": 0.8, "p85": 0.85, "p90": 0.9}
QUARTERS = {"p25": 0.25, "p50": 0.5, "p75": 0.75}


def _describe(
    source: str, columns: Sequence[str], places: int, shares: dict[str, float] = SHARES
) -> str:
    parts = []
    for column in columns:
        quantiles = ", ".join(
            _r(f"quantile_cont({column}, {p})", places, name) for name, p in shares.items()
        )
        parts.append(
            f"SELECT '{column}' AS variable, count({column}) AS count, "
            f"{_r(f'avg({column})', places, 'mean')}, "
            f"{_r(f'stddev_samp({column})', places, 'std')}, {_r(f'min({column})', places, 'min')}, "
            f"{quantiles}, {_r(f'max({column})', places, 'max')} FROM {source}"
        )
    return _with(" UNION ALL ".join(parts))


def _histogram(source: str, column: str, places: int) -> str:
    bins = (
        f"SELECT CAST(least(floor(({column} - low) / ((high - low) / 10)), 9) AS INTEGER) AS bin "
        f"FROM {source}, span"
    )
    return _with(
        f"SELECT CAST(b.bin AS INTEGER) AS bin, "
        f"{_r('low + b.bin * ((high - low) / 10)', places, 'lower')}, "
        f"{_r('low + (b.bin + 1) * ((high - low) / 10)', places, 'upper')}, "
        "(SELECT count(*) FROM bins WHERE bins.bin = b.bin) AS n FROM range(10) b(bin), span",
        ("span", f"SELECT min({column}) AS low, max({column}) AS high FROM {source}"),
        ("bins", bins),
    )


def _trimming_histograms() -> str:
    trimmed = "(SELECT * FROM capped WHERE org_type = 'ccg')"
    parts = []
    for form in ("views_before", "views_after", "proxy_views_before", "proxy_views_after"):
        span = f"(SELECT min({form}) AS low, max({form}) AS high FROM {trimmed})"
        bin_of = f"least(floor(({form} - low) / ((high - low) / 10)), 9)"
        parts.append(
            f"SELECT '{form}' AS variable, CAST(b.bin AS INTEGER) AS bin, "
            f"{_r('low + b.bin * ((high - low) / 10)', 6, 'lower')}, "
            f"{_r('low + (b.bin + 1) * ((high - low) / 10)', 6, 'upper')}, "
            f"(SELECT count(*) FROM {trimmed}, {span} WHERE {bin_of} = b.bin) AS n "
            f"FROM range(10) b(bin), {span}"
        )
    return _with(" UNION ALL ".join(parts))


def _one_measure(tag: str, where: str, with_name: bool) -> str:
    name = f"'{tag}' AS measure, " if with_name else ""
    return _with(
        f"SELECT month, pct_id, {name}CAST(coalesce(i, 0) AS BIGINT) AS items, "
        f"{_r('coalesce(c, 0)', 4, 'cost')}, {_r('denominator')} FROM grid LEFT JOIN ("
        f"SELECT month, pct_id, sum(items) AS i, sum(cost) AS c FROM lines "
        f"WHERE part IN (SELECT p_partkey FROM part WHERE {where}) GROUP BY month, pct_id) "
        "USING (month, pct_id)"
    )


RATES = "baseline_calc_value follow_up_calc_value baseline_items_thou follow_up_items_thou"

_reports = """
    SELECT CAST(ts AS DATE) AS day, json_extract_string(props, '$.k') AS k, event_type,
           count(*) AS hits, CAST(sum(CAST(value AS DECIMAL(18, 2))) AS DOUBLE) AS amount,
           count(*) FILTER (hour(ts) >= 12) AS late_hits,
           CAST(sum(CAST(value AS DECIMAL(18, 2))) FILTER (hour(ts) >= 12) AS DOUBLE) AS late_amount
    FROM events GROUP BY ALL"""

# Why a row of the faulty reports does not fit: page 95 is cut, 96 has words for 1, 97 wrong dates, 98 double kinds.
_misfit = """CASE WHEN k = '95' THEN 'not a report' WHEN k = '96' AND (hits = 1 OR late_hits = 1) THEN 'number'
                  WHEN k = '97' THEN 'date' WHEN k = '98' AND event_type = 'click' THEN 'dimensions' ELSE 'none' END"""

ORACLES: dict[str, str] = {
    "measure_region_month": _one_measure("promo_s", "p_type = 'PROMO' AND p_size < 17", False),
    "measure_all_single_scan": _with(
        f"SELECT month, pct_id, measure, items, {_r('cost', 4)}, {_r('denominator')} FROM monthly"
    ),
    "measure_code_list": _one_measure("code_list", "p_brand = 'Brand#1'", True),
    "measure_from_catalog": _with(
        f"SELECT month, pct_id, measure, items, {_r('cost', 4)}, {_r('denominator')} FROM monthly"
    ),
    "measure_incremental": _with(
        f"SELECT month, pct_id, measure, items, {_r('cost', 4)}, {_r('denominator')} FROM monthly"
    ),
    "measure_prefix_rules": """
        WITH rules AS (
          SELECT 'rule_' || CAST(id % 250 AS VARCHAR) AS measure, id % 7 = 0 AS exclude,
                 lpad(CAST(id * 37 % 10000 AS VARCHAR), CAST(2 + id % 3 AS INTEGER), '0') AS prefix
          FROM range(2000) r(id)),
        codes AS (SELECT p_partkey, reverse(lpad(CAST(p_partkey AS VARCHAR), 9, '0')) AS code FROM part),
        members AS (
          SELECT p_partkey, measure FROM codes JOIN rules ON starts_with(code, prefix)
          GROUP BY p_partkey, measure HAVING NOT bool_or(exclude)),
        sold AS (
          SELECT l_partkey, count(*) AS n, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS q
          FROM lineitem GROUP BY l_partkey)
        SELECT measure, CAST(sum(n) AS BIGINT) AS lines, CAST(sum(q) AS BIGINT) AS items, count(*) AS codes
        FROM members JOIN sold ON p_partkey = l_partkey GROUP BY measure""",
    "measure_reused": _with(
        f"SELECT pct_id, month, items, {_r('cost', 4)}, {_r('denominator')}, "
        f"{_r('CAST(cost AS DOUBLE) / nullif(denominator, 0)', 6, 'calc_value')} FROM combined"
    ),
    "measures_combined": _with(
        f"SELECT pct_id, month, items, {_r('cost', 4)}, {_r('denominator')}, "
        f"{_r('CAST(cost AS DOUBLE) / nullif(denominator, 0)', 6, 'calc_value')} FROM combined"
    ),
    "classify_months": _with(
        f"""SELECT CASE WHEN month < DATE '{BASELINE}' THEN 'before'
                        WHEN month < DATE '{MID}' THEN 'baseline'
                        WHEN month < DATE '{FOLLOW_UP}' THEN 'mid'
                        WHEN month < DATE '{AFTER}' THEN 'follow-up'
                        WHEN month >= DATE '{AFTER}' THEN 'after' ELSE '0' END AS period,
                   count(*) AS orders, min(month) AS first, max(month) AS last
            FROM stats GROUP BY period"""
    ),
    "period_region_rates": _with(
        f"SELECT pct_id, period, {_r('items')}, {_r('cost', 4)}, {_r('denominator', 8)}, "
        f"{_r('cost / nullif(denominator, 0)', 6, 'rate')} FROM totals"
    ),
    "period_measure_rates": _with(
        f"SELECT pct_id, measure, period, {_r('items')}, {_r('cost', 4)}, {_r('denominator', 8)}, "
        f"{_r('cost / nullif(denominator, 0)', 6, 'rate')} FROM totals_by_measure"
    ),
    "team_list": _with("SELECT joint_team, CCGs_included, joint_id FROM reps"),
    "team_rollup": _with(
        f"SELECT joint_id, {_r('numerator', 4)}, {_r('denominator')}, {_r('baseline')} "
        "FROM clusters"
    ),
    "pct_rank_min": _with(
        f"SELECT joint_id, {_r('baseline')}, {_r('baseline_ranking')} FROM ranked"
    ),
    "avg_rank_by_group": _with(
        """SELECT code, pct_id, orders, CASE WHEN orders IS NOT NULL THEN
             rank() OVER (PARTITION BY pct_id, orders IS NULL ORDER BY orders)
             + (count(orders) OVER (PARTITION BY pct_id, orders) - 1) / 2.0 END AS orders_rank
           FROM practices LEFT JOIN (
             SELECT o_custkey AS code, count(*) AS orders FROM orders GROUP BY o_custkey)
           USING (code)"""
    ),
    "top_units_after_exclusion": _with(
        f"SELECT pct_id, {_r('numerator', 4)}, {_r('denominator')}, {_r('baseline')} FROM ("
        "SELECT *, numerator / nullif(denominator, 0) AS baseline FROM region_rates "
        f"WHERE pct_id NOT IN {EXCLUDED} ORDER BY baseline DESC NULLS LAST, pct_id LIMIT 50)"
    ),
    "allocate_seeded": _with(
        f"SELECT joint_id, {_rs('baseline baseline_ranking')}, draw, "
        f"{_rs('allocation_ranking allocation_code')}, allocation FROM allocation"
    ),
    "allocate_all_practices": _with(
        """SELECT joint_id, r AS allocation_ranking,
                  CASE WHEN r % 2 = 0 THEN 'con' ELSE 'I' END AS allocation
           FROM (SELECT code_text AS joint_id,
                        CAST(rank() OVER (ORDER BY md5('321:' || code_text)) AS DOUBLE) AS r
                 FROM practices)"""
    ),
    "allocate_stored_draw": """
        SELECT c_custkey, r AS allocation_ranking, r % 2 AS allocation_code,
               CASE WHEN r % 2 = 0 THEN 'con' ELSE 'I' END AS allocation
        FROM (SELECT c_custkey, CAST(rank() OVER (ORDER BY c_acctbal)
                     + (count(*) OVER (PARTITION BY c_acctbal) - 1) / 2.0 AS DOUBLE) AS r
              FROM customer)""",
    "arm_report": _with(
        "SELECT allocation, count(*) AS clusters, round_even(avg(baseline), 0) AS mean, "
        "round_even(stddev_samp(baseline), 0) AS sd FROM allocation GROUP BY allocation"
    ),
    "visit_list": _with(
        """SELECT a.joint_id, n.name, r.joint_team, r.CCGs_included
           FROM allocation a LEFT JOIN reps r USING (joint_id)
           LEFT JOIN (SELECT DISTINCT lpad(CAST(c_nationkey AS VARCHAR), 2, '0')
                                      || substr(c_mktsegment, 1, 1) AS joint_id,
                             n_name || ' ' || c_mktsegment AS name
                      FROM customer JOIN nation ON c_nationkey = n_nationkey) n USING (joint_id)
           WHERE allocation = 'I'"""
    ),
    "trial_roster": _with("SELECT joint_id, allocation, pct_id, intervention FROM members"),
    "trial_roster_by_representative": _with(
        """SELECT joint_id, allocation, coalesce(ccg_id, joint_id) AS pct_id,
                  CASE allocation WHEN 'con' THEN 0 ELSE 1 END AS intervention
           FROM allocation LEFT JOIN reps USING (joint_id) LEFT JOIN teams USING (joint_team)"""
    ),
    "trial_practices": _with("SELECT ccg_id, code FROM trial_practices"),
    "period_pivot": _with(
        "SELECT joint_id, allocation, intervention, "
        f"{_rs('items_baseline items_follow_up')}, "
        f"{_rs('denominator_baseline denominator_follow_up', 8)}, "
        f"{_rs('cost_baseline cost_follow_up', 4)}, {_rs(RATES)} FROM outcomes"
    ),
    "arm_summary_change": _with(
        "SELECT 'cost' AS outcome, "
        + _summary("outcomes", "allocation", "baseline_calc_value", "follow_up_calc_value", False)
        + " GROUP BY allocation UNION ALL SELECT 'items' AS outcome, "
        + _summary("outcomes", "allocation", "baseline_items_thou", "follow_up_items_thou", False)
        + " GROUP BY allocation"
    ),
    "secondary_arm_summary": _with(
        "SELECT 'top3' AS outcome, "
        + _summary("top_rate", "intervention", "baseline_calc_value", "follow_up_calc_value", False)
        + " GROUP BY intervention UNION ALL "
        + " UNION ALL ".join(
            f"SELECT '{name}' AS outcome, "
            + _summary(
                "by_measure", "intervention", "baseline_items_thou", "follow_up_items_thou", False
            )
            + f" WHERE measure = '{name}' GROUP BY intervention"
            for name in ("promo_m", "large_s")
        )
    ),
    "top3_measures": _with(
        f"SELECT joint_id, measure, {_rs('baseline_calc_value measure_rank')} FROM top3"
    ),
    "top3_per_cluster_rate": _with(
        f"SELECT joint_id, allocation, intervention, {_rs('cost_baseline cost_follow_up', 4)}, "
        f"{_rs('denominator_baseline denominator_follow_up', 8)}, "
        f"{_rs('baseline_calc_value follow_up_calc_value')} FROM top_rate"
    ),
    "nested_avg_population": _with(
        f"""SELECT pct_id, {_r('avg(o) / 1000', 4, 'over_65')}, {_r('avg(s)', 4, 'total_list_size')}
            FROM (SELECT pct_id, month, CAST(sum(over_65) AS DOUBLE) AS o,
                         CAST(sum(list_size) AS DOUBLE) AS s
                  FROM stats LEFT JOIN practices ON practice = code
                  WHERE month BETWEEN DATE '{BASELINE}' AND DATE '{MID}'
                  GROUP BY pct_id, month)
            GROUP BY pct_id"""
    ),
    "baseline_characteristics": _with(
        "SELECT allocation, count(*) AS units, "
        + ", ".join(
            f"round_even({f}({c}), 1) AS {c}_{s}"
            for c in ("percent_over_65", "denominator", "items_thou", "calc_value")
            for f, s in (("avg", "mean"), ("stddev_samp", "std"))
        )
        + f""" FROM (
            SELECT joint_id, allocation, sum(denominator) AS denominator,
                   sum(items) / nullif(sum(denominator), 0) AS items_thou,
                   sum(cost) / nullif(sum(denominator), 0) AS calc_value,
                   100 * (sum(over_65) / nullif(sum(denominator), 0)) AS percent_over_65
            FROM members JOIN totals USING (pct_id) JOIN (
              SELECT pct_id, avg(o) / 1000 AS over_65
              FROM (SELECT pct_id, month, CAST(sum(over_65) AS DOUBLE) AS o
                    FROM stats LEFT JOIN practices ON practice = code
                    WHERE month BETWEEN DATE '{BASELINE}' AND DATE '{MID}'
                    GROUP BY pct_id, month)
              GROUP BY pct_id) USING (pct_id)
            WHERE period = 'baseline' GROUP BY joint_id, allocation)
            GROUP BY allocation"""
    ),
    "ols_primary_cost": ols_sql(
        "outcomes", "follow_up_calc_value", ["baseline_calc_value", "intervention"]
    ),
    "ols_primary_items": ols_sql(
        "outcomes", "follow_up_items_thou", ["baseline_items_thou", "intervention"]
    ),
    "ols_top3": ols_sql(
        "top_rate", "follow_up_calc_value", ["baseline_calc_value", "intervention"]
    ),
    "ols_single_measure": ols_sql(
        "(SELECT * FROM by_measure WHERE measure = 'promo_m')",
        "follow_up_items_thou",
        ["baseline_items_thou", "intervention"],
    ),
    "ols_by_measure": ols_sql(
        "by_measure",
        "follow_up_items_thou",
        ["baseline_items_thou", "intervention"],
        by="measure",
    ),
    "ols_model": _model(),
    "ols_pvalues": _pvalues(),
    "ols_order_lines": ols_sql(
        "lineitem",
        "l_extendedprice",
        ["l_quantity", "l_discount", "l_tax"],
        by="l_returnflag",
        places=3,
    ),
    "ols_order_lines_qr": ols_sql(
        "lineitem",
        "l_extendedprice",
        ["l_quantity", "l_discount", "l_tax"],
        by="l_returnflag",
        places=6,
    ),
    "sensitivity_flag": _with(
        "SELECT "
        + _summary("flagged", "flag", "baseline_calc_value", "follow_up_calc_value")
        + " GROUP BY flag"
    ),
    "sensitivity_flag_items": _with(
        "SELECT "
        + _summary("flagged", "flag", "baseline_items_thou", "follow_up_items_thou")
        + " GROUP BY flag"
    ),
    "ols_sensitivity_cost": ols_sql(
        "flagged", "follow_up_calc_value", ["baseline_calc_value", "flag"]
    ),
    "ols_sensitivity_items": ols_sql(
        "flagged", "follow_up_items_thou", ["baseline_items_thou", "flag"]
    ),
    "describe_clusters": _describe("clusters", ["baseline"], 6),
    "describe_selected": _describe(
        "allocation", ["baseline", "baseline_ranking", "allocation_ranking", "allocation_code"], 6
    ),
    "describe_percentiles": _describe("lineitem", ["l_extendedprice", "l_quantity"], 4),
    "histogram_bins": _histogram("orders", "o_totalprice", 4),
    "winsorise_upper": _with(
        "SELECT joint_id, views_before, views_after, "
        f"{_rs('proxy_views_before proxy_views_after')} FROM capped WHERE org_type = 'practice'"
    ),
    "trimmed_arm_means": _with(
        f"SELECT intervention, {_r('avg(proxy_views_before)', 6, 'proxy_views_before')}, "
        f"{_r('avg(proxy_views_after)', 6, 'proxy_views_after')} "
        "FROM capped WHERE org_type = 'ccg' GROUP BY intervention"
    ),
    "trimming_describe": _describe(
        "(SELECT * FROM capped WHERE org_type = 'ccg')",
        ["views_before", "views_after", "proxy_views_before", "proxy_views_after"],
        6,
        QUARTERS,
    ),
    "trimming_histogram": _histogram(
        "(SELECT * FROM capped WHERE org_type = 'ccg')", "proxy_views_before", 6
    ),
    "trimming_histograms": _trimming_histograms(),
    "winsorise_lines": f"""
        WITH caps AS (
          SELECT quantile_cont(l_extendedprice, 0.95) AS p, quantile_cont(l_quantity, 0.95) AS q FROM lineitem)
        SELECT l_returnflag, {_r('max(least(l_extendedprice, p))', 4, 'price_cap')},
               count(*) FILTER (l_extendedprice > p) AS capped,
               {_r('avg(least(l_extendedprice, p))', 4, 'price_mean')},
               {_r('max(least(l_quantity, q))', 4, 'quantity_cap')},
               {_r('avg(least(l_quantity, q))', 4, 'quantity_mean')}
        FROM lineitem, caps GROUP BY l_returnflag""",
    "parse_dates": """
        SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS iso_text,
               CAST(o_orderdate AS DATE) AS iso_date, CAST(o_orderdate AS DATE) AS compact_date,
               CAST(o_orderdate AS DATE) AS day_first,
               CAST(CASE WHEN day(o_orderdate) <= 12
                    THEN make_date(year(o_orderdate), day(o_orderdate), month(o_orderdate))
                    ELSE o_orderdate END AS DATE) AS guessed,
               CAST(try_strptime(o_orderpriority, '%d/%m/%Y') AS DATE) AS not_a_date
        FROM orders""",
    "event_org_parse": _with(
        """SELECT org_id, org_type,
                  CASE WHEN page LIKE '%ccg%' THEN substr(replace(page, '/ccg/', ''), 1, 3)
                       ELSE substr(replace(page, '/practice/', ''), 1, 6) END AS literal_id,
                  CASE WHEN page LIKE '%ccg%' THEN 'ccg' ELSE 'practice' END AS literal_type,
                  CAST(sum(views) AS BIGINT) AS views
           FROM (SELECT org_id, org_type, views,
                        Page || CASE WHEN day(day) = 15 THEN '?from=ccg' ELSE '' END AS page
                 FROM views)
           GROUP BY ALL"""
    ),
    "matched_pair_dates": _with(
        f"SELECT joint_id, allocation, intervention, {_r('list_size', 7)}, {_r('size_rank', 2)}, "
        "date_int FROM units"
    ),
    "event_window_views": _with(
        f"SELECT joint_id, intervention, {_r('list_size', 7)}, org_type, views_before, "
        "views_after, pages_before, pages_after FROM view_grid"
    ),
    "event_window_views_keep_empty": _with(
        f"SELECT joint_id, intervention, {_r('list_size', 7)}, org_type, "
        + ", ".join(
            f"coalesce({c}, 0) AS {c}"
            for c in ("views_before", "views_after", "pages_before", "pages_after")
        )
        + """ FROM (SELECT DISTINCT joint_id, intervention, list_size FROM units)
             CROSS JOIN (SELECT DISTINCT org_type FROM trial_views)
             LEFT JOIN view_grid USING (joint_id, intervention, list_size, org_type)"""
    ),
    "event_window_alerts": _with(
        f"SELECT intervention, joint_id, {_r('list_size_100k')}, alerts_ccg_after, "
        "alerts_ccg_before, alerts_practice_after, alerts_practice_before FROM alert_counts"
    ),
    "page_view_summary": _with(
        "SELECT org_type, CAST(sum(views_before) AS BIGINT) AS views_before_sum, "
        "CAST(sum(views_after) AS BIGINT) AS views_after_sum, "
        + _summary("view_grid", "intervention", "views_before", "views_after")
        + " GROUP BY org_type, intervention"
    ),
    "event_window_alerts_by_length": _with(
        f"SELECT intervention, joint_id, {_r('list_size_100k')}, alerts_ccg_after, "
        "alerts_ccg_before, alerts_practice_after, alerts_practice_before FROM alert_counts",
        (
            "signups",
            """SELECT day, k AS user, CASE WHEN value >= 60 AND length(region) = 3 THEN 'ccg'
                      WHEN value < 60 AND length(code_text) = 6 THEN 'practice' ELSE 'none' END AS org_type,
                      CASE WHEN value >= 60 THEN region END AS pct,
                      CASE WHEN value < 60 THEN code_text END AS practice
               FROM org_events WHERE event_type = 'signup' AND value >= 20""",
        ),
    ),
    "alerts_in_two_windows": _with(
        " UNION ALL ".join(
            f"SELECT {wide} AS wide, intervention, joint_id, {_r('list_size_100k')}, alerts_ccg_after, "
            f"alerts_ccg_before, alerts_practice_after, alerts_practice_before FROM {counts}"
            for wide, counts in (("false", "alert_counts"), ("true", "wide_counts"))
        ),
        (
            "wide_signups",
            """SELECT joint_id, org_type, user,
                      CASE WHEN day - date_int BETWEEN -30 AND -1 THEN 'before'
                           WHEN day - date_int BETWEEN 0 AND 30 THEN 'after' ELSE 'none' END AS timing
               FROM (SELECT s.*, coalesce(ccg_id, pct) AS pct_id
                     FROM signups s LEFT JOIN trial_practices ON practice = code)
               JOIN members USING (pct_id) JOIN (SELECT joint_id, date_int FROM units) USING (joint_id)""",
        ),
        ("wide_counts", PIECES["alert_counts"].replace("trial_signups", "wide_signups")),
    ),
    "alert_summary_sizes": _with(
        " UNION ALL ".join(
            f"SELECT '{kind}' AS org_type, {_r('avg(list_size_100k)', 6, 'size_mean')}, "
            f"{_r('stddev_samp(list_size_100k)', 6, 'size_std')}, "
            + _summary("alert_counts", "intervention", f"alerts_{kind}_before", f"alerts_{kind}_after", False)
            + " GROUP BY intervention"
            for kind in ("ccg", "practice")
        )
    ),
    "alert_summary": _with(
        " UNION ALL ".join(
            f"SELECT '{kind}' AS org_type, "
            + _summary(
                "alert_counts",
                "intervention",
                f"alerts_{kind}_before",
                f"alerts_{kind}_after",
                False,
            )
            + " GROUP BY intervention"
            for kind in ("ccg", "practice")
        )
    ),
    **{
        f"ols_views_{kind}": ols_sql(
            f"(SELECT * FROM capped WHERE org_type = '{kind}')",
            "proxy_views_after",
            ["proxy_views_before", "intervention"],
        )
        for kind in ("ccg", "practice")
    },
    **{
        f"ols_size_adjusted_{kind}": ols_sql(
            "alert_counts",
            f"alerts_{kind}_after",
            [f"alerts_{kind}_before", "list_size_100k", "intervention"],
        )
        for kind in ("ccg", "practice")
    },
    "csv_roundtrip": """
        SELECT c_custkey, '"' || c_name || '", x' AS c_name, c_nationkey, c_acctbal, c_mktsegment
        FROM customer""",
    "csv_subset": _with("SELECT code_text AS code, status_code FROM practices"),
    "report_flatten": _with(
        "SELECT day, event_type, hits, amount FROM cells", ("cells", _reports)
    ),
    "report_flatten_ranges": _with(
        "SELECT day, event_type, hits AS hits_0, amount AS amount_0, late_hits AS hits_1, "
        "late_amount AS amount_1 FROM cells, range(4)",
        ("cells", _reports),
    ),
    "report_sampling": """
        SELECT CAST(ts AS DATE) AS day, json_extract_string(props, '$.k') AS k,
               CAST(round_even(3.0 / count(*) * 100, 0) AS INTEGER) AS sampled_percent
        FROM events GROUP BY day, k HAVING count(*) > 3""",
    "report_pages": """
        SELECT CAST(ts AS DATE) AS day, count(DISTINCT json_extract_string(props, '$.k')) AS pages,
               max(CASE WHEN json_extract_string(props, '$.k') = '99' THEN 1 ELSE 0 END) = 1
                 AS complete
        FROM events GROUP BY day""",
    "report_flatten_mixed": _with(
        "SELECT day, event_type, CAST(hits AS DOUBLE) AS hits_0, amount AS amount_0, "
        "CAST(late_hits AS DOUBLE) AS hits_1, late_amount AS amount_1, hits / 2 AS hits_2, "
        "CAST(NULL AS DOUBLE) AS amount_2 FROM cells",
        ("cells", _reports),
    ),
    "report_by_header": _with(
        "SELECT day, event_type, CAST(hits AS DOUBLE) AS hits_0, amount AS amount_0, "
        "CAST(late_hits AS DOUBLE) AS hits_1, late_amount AS amount_1, hits / 2 AS hits_2, "
        f"CAST(NULL AS DOUBLE) AS amount_2 FROM cells WHERE ({_misfit}) = 'none'",
        ("cells", _reports),
    ),
    "report_rejected": _with(
        f"""SELECT day, k, reason, count(*) AS n
            FROM (SELECT DISTINCT day, k, CASE WHEN k = '95' THEN '' ELSE event_type END, {_misfit} AS reason FROM cells)
            WHERE reason <> 'none' GROUP BY day, k, reason""",
        ("cells", _reports),
    ),
    "ols_nearly_collinear": """
        WITH m AS (
          SELECT l_returnflag, count(*) AS n, avg(u) AS mu, avg(q) AS mq, avg(y) AS my,
                 var_pop(u) * count(*) AS suu, var_pop(q) * count(*) AS sqq, var_pop(y) * count(*) AS syy,
                 covar_pop(u, q) * count(*) AS suq, covar_pop(u, y) * count(*) AS suy, covar_pop(q, y) * count(*) AS sqy
          FROM (SELECT l_returnflag, CAST(l_partkey AS DOUBLE) AS u, CAST(l_quantity AS DOUBLE) AS q,
                       l_extendedprice / 1000 AS y FROM lineitem)
          GROUP BY l_returnflag),
        f AS (
          SELECT *, suu * sqq - suq * suq AS det, (suy * sqq - sqy * suq) / (suu * sqq - suq * suq) AS a,
                 (sqy * suu - suy * suq) / (suu * sqq - suq * suq) AS b FROM m),
        v AS (SELECT *, (syy - a * suy - b * sqy) / (n - 3) / det AS s FROM f)
        SELECT l_returnflag, 'Intercept' AS term, round(my - a * mu - b * mq, 6) AS coef,
               round(sqrt(s * (det / n + mu * mu * sqq - 2 * mu * mq * suq + mq * mq * suu)), 6) AS std_err FROM v
        UNION ALL
        SELECT l_returnflag, 'part_far', round(a / 65536 - b, 6),
               round(sqrt(s * (sqq / 65536 / 65536 + suu + 2 * suq / 65536)), 6) FROM v
        UNION ALL
        SELECT l_returnflag, 'part_near', round(b, 6), round(sqrt(s * suu), 6) FROM v""",
    "ols_lines_by_e": """
        WITH lines AS (
          SELECT l_returnflag AS e, l_orderkey, l_linenumber, l_extendedprice AS y, l_quantity AS x
          FROM lineitem),
        fits AS (
          SELECT e, regr_slope(y, x) AS b, regr_intercept(y, x) AS a, regr_r2(y, x) AS r2, count(*) AS n,
                 sum(x) AS sx, sum(x * x) AS sxx FROM lines GROUP BY e),
        left_over AS (
          SELECT e, y - a - b * x AS r,
                 lag(y - a - b * x) OVER (PARTITION BY e ORDER BY l_orderkey, l_linenumber, y, x) AS before
          FROM lines JOIN fits USING (e)),
        steps AS (
          SELECT e, sum((r - before) * (r - before)) / sum(r * r) AS dw FROM left_over GROUP BY e)
        SELECT e, n, round(r2, 6) AS r2, round(dw, 6) AS durbin_watson,
               round(sqrt((n + sxx + sqrt((n + sxx) * (n + sxx) - 4 * (n * sxx - sx * sx)))
                 / (n + sxx - sqrt((n + sxx) * (n + sxx) - 4 * (n * sxx - sx * sx)))), 4) AS cond_no
        FROM fits JOIN steps USING (e)""",
    "describe_with_nan": """
        WITH v AS (
          SELECT CASE WHEN l_linenumber % 3 <> 0 THEN l_extendedprice END AS price FROM lineitem)
        SELECT 'price' AS variable, count(price) AS count, round(avg(price), 4) AS mean,
               round(stddev_samp(price), 4) AS std, round(min(price), 4) AS min,
               round(quantile_cont(price, 0.25), 4) AS p25, round(quantile_cont(price, 0.5), 4) AS p50,
               round(quantile_cont(price, 0.75), 4) AS p75, round(max(price), 4) AS max
        FROM v""",
}
