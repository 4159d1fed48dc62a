"""One query per operator or analysis; each takes a session and a table folder."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from datetime import date
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clustrial.checks import tables as t
from clustrial.functions import (
    Window,
    classify_period,
    date_text,
    org_id,
    org_type,
    parse_compact_date,
    parse_iso_date,
    parse_visit_date,
    ratio,
)
from clustrial.operators.allocation import allocate
from clustrial.operators.clusters import expand_roster, team_representatives
from clustrial.operators.measures import (
    combine_measures,
    extend_month_table,
    in_code_list,
    practice_month_facts,
    prefix_measures,
    region_month_measures,
)
from clustrial.operators.ols import fit_ols
from clustrial.operators.positions import add_rank
from clustrial.operators.robust import describe, group_means, histogram, trimming_report, winsorise
from clustrial.operators.selection import top_per_group, top_units
from clustrial.operators.summary import arm_summary
from clustrial.plans import engagement, trial
from clustrial.plans.study import Study
from clustrial.sources import (
    TableStore,
    append_all,
    flatten_report,
    open_report,
    read_csv,
    sampling_notice,
    save_bucketed,
    shared_folder,
    store,
    unread_pages,
    write_csv,
)
from clustrial.sources.schemas import SCHEMAS


def rounded(df: DataFrame, places: int = 6, **special: int) -> DataFrame:
    """Doubles and decimals as doubles of so many places, other columns as they are."""

    def column(name: str, kind: str) -> str:
        if kind == "double" or kind.startswith("decimal"):
            digits = special.get(name, special.get(name.split("_")[0], places))
            # Adding 0 turns a negative zero into a plain one.
            return f"round(CAST({name} AS DOUBLE), {digits}) + 0D AS {name}"
        return name

    return df.selectExpr(*[column(name, kind) for name, kind in df.dtypes])


class Trial(Study):
    """The study of the checks' tables."""

    def __init__(self, spark: SparkSession, sf_dir: str, tables: TableStore | None = None):
        super().__init__(
            prescribing=t.prescriptions(spark, sf_dir).join(t.parts_by_measure(spark, sf_dir), "part"),
            statistics=t.statistics(spark, sf_dir),
            practices=t.practices(spark, sf_dir),
            teams=t.teams(spark, sf_dir),
            measures=t.MEASURES,
            periods=t.PERIODS,
            first=t.FIRST,
            last=t.LAST,
            excluded=t.EXCLUDED,
            size=t.TRIAL_SIZE,
            seed=t.SEED,
            timetable_of=lambda allocation: t.visit_timetable(spark, sf_dir, allocation),
            # Web paths hold the text code.
            practice_codes=lambda practices: practices.withColumn("code", F.col("code_text")),
            tables=tables,
        )
        self.views, self.sign_ups = t.page_views(spark, sf_dir), t.alerts(spark, sf_dir)

    def all_measures(self) -> DataFrame:
        return self.month_table(self.prescribing, self.measures)

    @cached_property
    def page_view_grid(self) -> DataFrame:
        return self.page_views(self.views, t.PAGE_WINDOW)

    @cached_property
    def alert_counts(self) -> DataFrame:
        return store(self.alerts(self.sign_ups, t.SIGNUP_WINDOW, practice_length=None), "alerts")


# --- measure tables -------------------------------------------------------------


def measure_region_month(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = "promo_s"
    tagged = t.prescriptions(spark, sf_dir).join(
        t.parts_by_measure(spark, sf_dir, {name: t.REGISTRY[name]}), "part"
    )
    return rounded(Trial(spark, sf_dir).month_table(tagged, [name]).drop("measure"), cost=4)


def measure_all_single_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(Trial(spark, sf_dir).all_measures(), cost=4)


BUCKETS = 16


def catalog_tables(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Facts, list sizes and practices as catalog tables in buckets by practice."""
    study, mark = Trial(spark, sf_dir), uuid.uuid4().hex
    sizes = study.statistics.groupBy("practice", "month").agg(F.sum("total_list_size").alias("total_list_size"))
    return (
        save_bucketed(practice_month_facts(study.prescribing), f"facts_{mark}", ["practice"], BUCKETS),
        save_bucketed(sizes, f"sizes_{mark}", ["practice"], BUCKETS),
        save_bucketed(study.practices, f"practices_{mark}", ["code"], BUCKETS),
    )


def measure_from_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All measures from bucketed catalog tables: facts and practices meet without a shuffle."""
    return rounded(region_month_measures(*catalog_tables(spark, sf_dir), t.MEASURES, t.FIRST, t.LAST), cost=4)


def measure_code_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    codes = t.table(spark, sf_dir, "part", "p_partkey", "p_brand").where(
        F.col("p_brand") == t.CODE_LIST_BRAND
    )
    tagged = in_code_list(t.prescriptions(spark, sf_dir), codes, "part", "p_partkey").withColumn(
        "measure", F.lit("code_list")
    )
    return rounded(Trial(spark, sf_dir).month_table(tagged, ["code_list"]), cost=4)


RULES = 2_000


def _prefix_rules(spark: SparkSession) -> DataFrame:
    """``measure, prefix, exclude``: numbers as prefixes of two to four digits, every seventh taking out."""
    return spark.range(RULES).selectExpr(
        "concat('rule_', id % 250) AS measure",
        "lpad(cast(id * 37 % 10000 AS STRING), cast(2 + id % 3 AS INT), '0') AS prefix",
        "id % 7 = 0 AS exclude",
    )


def _part_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part numbers read from the last digit on, so that prefixes differ within any range."""
    parts = t.table(spark, sf_dir, "part", "p_partkey")
    return parts.selectExpr("p_partkey", "reverse(lpad(cast(p_partkey AS STRING), 9, '0')) AS code")


def measure_prefix_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quantities sold by measure, the measures given by 2,000 rules on how codes begin."""
    codes = _part_codes(spark, sf_dir)
    measures = codes.join(prefix_measures(codes, _prefix_rules(spark), "code"), "code").select("p_partkey", "measure")
    sold = t.table(spark, sf_dir, "lineitem", "l_partkey", "l_quantity").groupBy("l_partkey").agg(
        F.count(F.lit(1)).alias("lines"), F.expr("sum(cast(l_quantity AS BIGINT))").alias("items")
    )
    return sold.join(measures, sold.l_partkey == measures.p_partkey).groupBy("measure").agg(
        F.sum("lines").alias("lines"), F.sum("items").alias("items"), F.count(F.lit(1)).alias("codes")
    )


def measure_incremental(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The month table of all measures, first up to the follow-up period, then extended."""
    parts, practices = t.parts_by_measure(spark, sf_dir), t.practices(spark, sf_dir)
    path = f"{shared_folder(spark)}/clustrial/months-{uuid.uuid4().hex}"

    def build(first: date, last: date) -> DataFrame:
        tagged = t.prescriptions(spark, sf_dir, first, last).join(parts, "part")
        return region_month_measures(tagged, t.statistics(spark, sf_dir, first, last), practices, t.MEASURES, first, last)

    extend_month_table(spark, path, build, t.FIRST, t.PERIODS.mid)
    return rounded(extend_month_table(spark, path, build, t.FIRST, t.LAST), cost=4)


def measure_reused(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Combined measures of a second study, which reads the month table the first one stored."""
    folder = f"{shared_folder(spark)}/clustrial/reused-{uuid.uuid4().hex}"
    Trial(spark, sf_dir, TableStore(spark, folder, keep=True)).monthly
    study = Trial(spark, sf_dir, TableStore(spark, folder, keep=True))
    return rounded(combine_measures(study.monthly).withColumn("calc_value", ratio("cost", "denominator")), cost=4)


def measures_combined(spark: SparkSession, sf_dir: str) -> DataFrame:
    combined = combine_measures(Trial(spark, sf_dir).all_measures())
    return rounded(combined.withColumn("calc_value", ratio("cost", "denominator")), cost=4)


def classify_months(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = t.table(spark, sf_dir, "orders", "o_orderdate", "o_orderstatus").select(
        F.trunc("o_orderdate", "month").alias("month")
    )
    return (
        orders.withColumn("period", classify_period("month", t.PERIODS))
        .groupBy("period")
        .agg(
            F.count(F.lit(1)).alias("orders"),
            F.min("month").alias("first"),
            F.max("month").alias("last"),
        )
    )


def period_region_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    combined = combine_measures(Trial(spark, sf_dir).all_measures())
    totals = trial.period_totals(combined, t.PERIODS, ["pct_id"])
    return rounded(totals.withColumn("rate", ratio("cost", "denominator")), cost=4, denominator=8)


def period_measure_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    totals = trial.period_totals(
        Trial(spark, sf_dir).all_measures(), t.PERIODS, ["pct_id", "measure"]
    )
    return rounded(totals.withColumn("rate", ratio("cost", "denominator")), cost=4, denominator=8)


# --- clusters, ranks, allocation ----------------------------------------------------


def team_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return team_representatives(t.teams(spark, sf_dir))


def team_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(Trial(spark, sf_dir).clusters, numerator=4)


def pct_rank_min(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranked = trial.rank_clusters(Trial(spark, sf_dir).clusters)
    return rounded(ranked.select("joint_id", "baseline", "baseline_ranking"))


def avg_rank_by_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Practices ranked by number of orders within their region: many ties."""
    orders = (
        t.table(spark, sf_dir, "orders", "o_custkey")
        .groupBy("o_custkey")
        .agg(F.count(F.lit(1)).alias("orders"))
    )
    sized = (
        t.practices(spark, sf_dir)
        .select("code", F.col("ccg_id").alias("pct_id"))
        .join(orders, F.col("code") == F.col("o_custkey"), "left")
        .select("code", "pct_id", "orders")
    )
    return rounded(add_rank(sized, "orders", "orders_rank", ["pct_id"]))


def top_units_after_exclusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    rates = trial.baseline_rates(combine_measures(Trial(spark, sf_dir).all_measures()), t.PERIODS)
    top = top_units(rates, "baseline", "pct_id", 50, t.EXCLUDED)
    return rounded(top, numerator=4)


def allocate_seeded(spark: SparkSession, sf_dir: str) -> DataFrame:
    allocation = Trial(spark, sf_dir).allocation
    return rounded(
        allocation.select(
            "joint_id",
            "baseline",
            "baseline_ranking",
            "draw",
            "allocation_ranking",
            "allocation_code",
            "allocation",
        )
    )


def allocate_all_practices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every practice randomised, at whatever number: the distributed rank."""
    units = t.practices(spark, sf_dir).select(F.col("code_text").alias("joint_id"))
    return allocate(units, seed=t.SEED).select("joint_id", "allocation_ranking", "allocation")


def allocate_stored_draw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Draws kept in a column - here the account balance, with possible ties."""
    units = t.table(spark, sf_dir, "customer", "c_custkey", "c_acctbal")
    return allocate(units, unit="c_custkey", draw="c_acctbal").select(
        "c_custkey", "allocation_ranking", "allocation_code", "allocation"
    )


def arm_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Trial(spark, sf_dir).arm_report()


def visit_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    study = Trial(spark, sf_dir)
    return trial.visit_list(study.allocation, t.region_names(spark, sf_dir), study.teams)


def trial_roster(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Trial(spark, sf_dir).members


def trial_roster_by_representative(spark: SparkSession, sf_dir: str) -> DataFrame:
    study = Trial(spark, sf_dir)
    return expand_roster(study.allocation, study.teams, expand_by="joint_id")


def trial_practices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Trial(spark, sf_dir).trial_practices


# --- outcomes ---------------------------------------------------------------------


def period_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(Trial(spark, sf_dir).outcomes, cost=4, denominator=8)


def arm_summary_change(spark: SparkSession, sf_dir: str) -> DataFrame:
    outcomes = Trial(spark, sf_dir).outcomes
    cost, items = (
        arm_summary(outcomes, "allocation", before, after)
        .toDF("allocation", "units", "before_mean", "before_std", "after_mean", "after_std", "change")
        .withColumn("outcome", F.lit(name))
        for name, before, after in (
            ("cost", "baseline_calc_value", "follow_up_calc_value"),
            ("items", "baseline_items_thou", "follow_up_items_thou"),
        )
    )
    return rounded(append_all([cost, items]))


def secondary_arm_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Top-3 cost, and items of two single measures, by arm."""
    by_measure = Trial(spark, sf_dir).outcomes_by_measure
    parts = [
        arm_summary(
            trial.top_measures(by_measure),
            "intervention",
            "baseline_calc_value",
            "follow_up_calc_value",
        ),
        *[
            arm_summary(
                by_measure.where(F.col("measure") == name),
                "intervention",
                "baseline_items_thou",
                "follow_up_items_thou",
            )
            for name in ("promo_m", "large_s")
        ],
    ]
    return rounded(
        append_all(
            part.toDF(
                "intervention",
                "units",
                "before_mean",
                "before_std",
                "after_mean",
                "after_std",
                "change",
            ).withColumn("outcome", F.lit(outcome))
            for outcome, part in zip(("top3", "promo_m", "large_s"), parts)
        )
    )


def top3_measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    by_measure = Trial(spark, sf_dir).outcomes_by_measure
    top = top_per_group(
        by_measure, ["joint_id"], "baseline_calc_value", 3, "measure_rank"
    )
    return rounded(top.select("joint_id", "measure", "baseline_calc_value", "measure_rank"))


def top3_per_cluster_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    top = trial.top_measures(Trial(spark, sf_dir).outcomes_by_measure)
    return rounded(top, cost=4, denominator=8)


def nested_avg_population(spark: SparkSession, sf_dir: str) -> DataFrame:
    populations = trial.region_populations(
        t.statistics(spark, sf_dir, t.PERIODS.baseline, t.PERIODS.mid),
        t.practices(spark, sf_dir),
        t.PERIODS.baseline,
        t.PERIODS.mid,
        {"over_65": "over_65", "total_list_size": "total_list_size"},
    )
    return rounded(populations.withColumn("over_65", F.col("over_65") / 1000), 4)


def baseline_characteristics(spark: SparkSession, sf_dir: str) -> DataFrame:
    study = Trial(spark, sf_dir)
    populations = trial.region_populations(
        t.statistics(spark, sf_dir, t.PERIODS.baseline, t.PERIODS.mid),
        study.practices,
        t.PERIODS.baseline,
        t.PERIODS.mid,
        {"over_65": "over_65"},
    ).withColumn("over_65", F.col("over_65") / 1000)
    totals = trial.period_totals(combine_measures(study.monthly), t.PERIODS, ["pct_id"])
    return trial.baseline_characteristics(study.members, totals, populations)


def _coefficients(fit) -> DataFrame:
    return rounded(fit.coefficients.select("term", "coef", "std_err", "t"), 5)


def _compare(clusters: DataFrame, before: str, after: str, arm: str = "intervention", adjust=()):
    return _coefficients(trial.compare_arms(clusters, before, after, arm, adjust)[1])


def ols_primary_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _compare(
        Trial(spark, sf_dir).outcomes, "baseline_calc_value", "follow_up_calc_value"
    )


def ols_primary_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _compare(
        Trial(spark, sf_dir).outcomes, "baseline_items_thou", "follow_up_items_thou"
    )


def ols_top3(spark: SparkSession, sf_dir: str) -> DataFrame:
    top = trial.top_measures(Trial(spark, sf_dir).outcomes_by_measure)
    return _compare(top, "baseline_calc_value", "follow_up_calc_value")


def ols_single_measure(spark: SparkSession, sf_dir: str) -> DataFrame:
    one = Trial(spark, sf_dir).outcomes_by_measure.where(F.col("measure") == "promo_m")
    return _compare(one, "baseline_items_thou", "follow_up_items_thou")


def ols_by_measure(spark: SparkSession, sf_dir: str) -> DataFrame:
    fit = fit_ols(
        Trial(spark, sf_dir).outcomes_by_measure,
        "follow_up_items_thou",
        ["baseline_items_thou", "intervention"],
        by=["measure"],
        order_by=["joint_id"],
    )
    return rounded(fit.coefficients.select("measure", "term", "coef", "std_err", "t"), 5)


def ols_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The model line of each measure's regression, residual tests included."""
    fit = fit_ols(
        Trial(spark, sf_dir).outcomes_by_measure,
        "follow_up_calc_value",
        ["baseline_calc_value", "intervention"],
        by=["measure"],
        order_by=["joint_id"],
    )
    return rounded(fit.model.drop("cond_no"), 5)


def ols_lines_by_e(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Model lines over all order lines in order, grouped by a column called ``e``."""
    lines = t.table(
        spark, sf_dir, "lineitem",
        "l_returnflag", "l_orderkey", "l_linenumber", "l_extendedprice", "l_quantity",
    ).withColumnRenamed("l_returnflag", "e")
    fit = fit_ols(
        lines, "l_extendedprice", ["l_quantity"], by=["e"], order_by=["l_orderkey", "l_linenumber"]
    )
    return rounded(fit.model.select("e", "n", "r2", "durbin_watson", "cond_no"), 6, cond=4)


def describe_with_nan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every third line's price is NaN, and counts as missing."""
    lines = t.table(spark, sf_dir, "lineitem", "l_linenumber", "l_extendedprice")
    price = F.when(F.col("l_linenumber") % 3 == 0, F.lit(float("nan"))).otherwise(F.col("l_extendedprice").cast("double"))
    return rounded(describe(lines.select(price.alias("price")), ["price"]), 4)


def ols_pvalues(spark: SparkSession, sf_dir: str) -> DataFrame:
    fit = trial.compare_arms(
        Trial(spark, sf_dir).outcomes, "baseline_calc_value", "follow_up_calc_value"
    )[1]
    return rounded(fit.coefficients.select("term", "t", "p_value", "ci_low", "ci_high"), 5)


def ols_order_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Price on quantity, discount and tax over every order line, by return flag."""
    lines = t.table(
        spark,
        sf_dir,
        "lineitem",
        "l_orderkey",
        "l_linenumber",
        "l_returnflag",
        "l_extendedprice",
        "l_quantity",
        "l_discount",
        "l_tax",
    )
    fit = fit_ols(
        lines, "l_extendedprice", ["l_quantity", "l_discount", "l_tax"], by=["l_returnflag"]
    )
    return rounded(fit.coefficients.select("l_returnflag", "term", "coef", "std_err", "t"), 3)


def ols_order_lines_qr(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The regression of ``ols_order_lines`` from triangular factors, to six places."""
    lines = t.table(
        spark, sf_dir, "lineitem", "l_returnflag", "l_extendedprice", "l_quantity", "l_discount", "l_tax"
    )
    x = ["l_quantity", "l_discount", "l_tax"]
    fit = fit_ols(lines, "l_extendedprice", x, by=["l_returnflag"], solver="qr")
    return rounded(fit.coefficients.select("l_returnflag", "term", "coef", "std_err", "t"), 6)


def ols_nearly_collinear(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two predictors that differ by a part in a million, which covariances cannot tell apart."""
    lines = t.table(spark, sf_dir, "lineitem", "l_returnflag", "l_partkey", "l_quantity", "l_extendedprice").selectExpr(
        "l_returnflag",
        "l_extendedprice / 1000 AS price",
        "l_partkey * 65536D AS part_far",
        "l_partkey * 65536D + l_quantity AS part_near",
    )
    fit = fit_ols(lines, "price", ["part_far", "part_near"], by=["l_returnflag"], solver="qr")
    return rounded(fit.coefficients.select("l_returnflag", "term", "coef", "std_err"))


def _flagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Trial(spark, sf_dir).flagged


def sensitivity_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    flagged = _flagged(spark, sf_dir)
    return rounded(arm_summary(flagged, "flag", "baseline_calc_value", "follow_up_calc_value"))


def sensitivity_flag_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    flagged = _flagged(spark, sf_dir)
    return rounded(arm_summary(flagged, "flag", "baseline_items_thou", "follow_up_items_thou"))


def ols_sensitivity_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _compare(
        _flagged(spark, sf_dir), "baseline_calc_value", "follow_up_calc_value", "flag"
    )


def ols_sensitivity_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _compare(
        _flagged(spark, sf_dir), "baseline_items_thou", "follow_up_items_thou", "flag"
    )


# --- descriptions -------------------------------------------------------------------

PERCENTILES = {"p10": 0.1, "p25": 0.25, "p50": 0.5, "p75": 0.75, "p80": 0.8, "p85": 0.85, "p90": 0.9}


def describe_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    clusters = Trial(spark, sf_dir).clusters
    return rounded(describe(clusters, ["baseline"], PERCENTILES))


def describe_selected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All numbers of the selected clusters."""
    numbers = ["baseline", "baseline_ranking", "allocation_ranking", "allocation_code"]
    return rounded(describe(Trial(spark, sf_dir).allocation, numbers, PERCENTILES))


def describe_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order values and line quantities of the whole tables."""
    lines = t.table(spark, sf_dir, "lineitem", "l_extendedprice", "l_quantity")
    return rounded(describe(lines, ["l_extendedprice", "l_quantity"], PERCENTILES), 4)


def histogram_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = t.table(spark, sf_dir, "orders", "o_totalprice")
    return rounded(histogram(orders, "o_totalprice"), 4)


def winsorise_upper(spark: SparkSession, sf_dir: str) -> DataFrame:
    grid = Trial(spark, sf_dir).page_view_grid
    trimmed = engagement.trimmed_page_views(grid, "practice")
    return rounded(
        trimmed.select(
            "joint_id", "views_before", "views_after", "proxy_views_before", "proxy_views_after"
        )
    )


def trimmed_arm_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    grid = Trial(spark, sf_dir).page_view_grid
    trimmed = engagement.trimmed_page_views(grid, "ccg")
    return rounded(
        group_means(trimmed, "intervention", ["proxy_views_before", "proxy_views_after"])
    )


def _trimmed_ccg(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    trimmed = engagement.trimmed_page_views(Trial(spark, sf_dir).page_view_grid, "ccg")
    return trimming_report(
        trimmed,
        {"views_before": "proxy_views_before", "views_after": "proxy_views_after"},
        arm="intervention",
    )


def trimming_describe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_trimmed_ccg(spark, sf_dir)["describe"])


def trimming_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    bins = _trimmed_ccg(spark, sf_dir)["histograms"]
    return rounded(bins.where("variable = 'proxy_views_before'").drop("variable"))


def trimming_histograms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Page views before and after, as they are and trimmed."""
    return rounded(_trimmed_ccg(spark, sf_dir)["histograms"])


def winsorise_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prices and quantities of all order lines, each capped at its own 95th percentile."""
    lines = t.table(spark, sf_dir, "lineitem", "l_returnflag", "l_extendedprice", "l_quantity")
    capped = winsorise(lines, {"l_extendedprice": "price", "l_quantity": "quantity"})
    return rounded(
        capped.groupBy("l_returnflag").agg(
            F.max("price").alias("price_cap"), F.count_if(F.col("price") < F.col("l_extendedprice")).alias("capped"),
            F.avg("price").alias("price_mean"), F.max("quantity").alias("quantity_cap"), F.avg("quantity").alias("quantity_mean"),
        ),
        4,
    )


# --- engagement -----------------------------------------------------------------------


def parse_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = t.table(spark, sf_dir, "orders", "o_orderkey", "o_orderdate", "o_orderpriority")
    return orders.select(
        "o_orderkey",
        date_text("o_orderdate").alias("iso_text"),
        parse_iso_date(date_text("o_orderdate")).alias("iso_date"),
        parse_compact_date(F.date_format("o_orderdate", "yyyyMMdd")).alias("compact_date"),
        parse_visit_date(F.date_format("o_orderdate", "dd/MM/yyyy")).alias("day_first"),
        parse_visit_date(F.date_format("o_orderdate", "dd/MM/yyyy"), True).alias("guessed"),
        parse_visit_date("o_orderpriority").alias("not_a_date"),
    )


def event_org_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Org id and type of every page, by path start and by the looser literal rule."""
    views = t.page_views(spark, sf_dir).withColumn(
        "Page",
        F.when(F.dayofmonth("Date") == 15, F.concat("Page", F.lit("?from=ccg"))).otherwise(
            F.col("Page")
        ),
    )
    return (
        views.select(
            org_id("Page").alias("org_id"),
            org_type("Page").alias("org_type"),
            org_id("Page", literal=True).alias("literal_id"),
            org_type("Page", literal=True).alias("literal_type"),
            "views",
        )
        .groupBy("org_id", "org_type", "literal_id", "literal_type")
        .agg(F.sum("views").alias("views"))
    )


def matched_pair_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(Trial(spark, sf_dir).units, 2, list=7)


def event_window_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(Trial(spark, sf_dir).page_view_grid, list=7)


def event_window_views_keep_empty(spark: SparkSession, sf_dir: str) -> DataFrame:
    study = Trial(spark, sf_dir)
    return rounded(study.page_views(study.views, t.PAGE_WINDOW, keep_empty=True), list=7)


def event_window_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(Trial(spark, sf_dir).alert_counts)


def event_window_alerts_by_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With the rule that a practice id has six characters."""
    study = Trial(spark, sf_dir)
    return rounded(study.alerts(study.sign_ups, t.SIGNUP_WINDOW))


WIDE_WINDOW = Window(before=(-30, -1), after=(0, 30))


def alerts_in_two_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct users in two windows, both from one stored table of bitmaps."""
    study = Trial(spark, sf_dir)
    bitmaps = store(engagement.alert_bitmaps(study.sign_ups, study.trial_practices, practice_length=None), "alert-bitmaps")
    return rounded(
        append_all(
            engagement.cluster_alerts_in(bitmaps, study.members, study.units, window).withColumn("wide", F.lit(wide))
            for wide, window in ((False, t.SIGNUP_WINDOW), (True, WIDE_WINDOW))
        )
    )


def page_view_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    grid = Trial(spark, sf_dir).page_view_grid
    parts = [
        arm_summary(
            grid.where(F.col("org_type") == kind),
            "intervention",
            "views_before",
            "views_after",
            sums=True,
        ).withColumn("org_type", F.lit(kind))
        for kind in engagement.ORG_TYPES
    ]
    return rounded(append_all(parts))


def alert_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = Trial(spark, sf_dir).alert_counts
    parts = [
        arm_summary(counts, "intervention", f"alerts_{kind}_before", f"alerts_{kind}_after")
        .toDF("intervention", "units", "before_mean", "before_std", "after_mean", "after_std", "change")
        .withColumn("org_type", F.lit(kind))
        for kind in engagement.ORG_TYPES
    ]
    return rounded(append_all(parts))


def alert_summary_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With mean and SD of the clusters' list sizes."""
    counts = Trial(spark, sf_dir).alert_counts
    return rounded(
        append_all(
            engagement.alert_summary(counts, kind).withColumn("org_type", F.lit(kind))
            for kind in engagement.ORG_TYPES
        )
    )


def _ols_views(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    trimmed = engagement.trimmed_page_views(Trial(spark, sf_dir).page_view_grid, kind)
    return _compare(trimmed, "proxy_views_before", "proxy_views_after")


def ols_views_ccg(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ols_views(spark, sf_dir, "ccg")


def ols_views_practice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ols_views(spark, sf_dir, "practice")


def _ols_alerts(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    counts = Trial(spark, sf_dir).alert_counts
    return _compare(
        counts, f"alerts_{kind}_before", f"alerts_{kind}_after", adjust=("list_size_100k",)
    )


def ols_size_adjusted_ccg(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ols_alerts(spark, sf_dir, "ccg")


def ols_size_adjusted_practice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ols_alerts(spark, sf_dir, "practice")


# --- files and reports ------------------------------------------------------------------


def csv_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    customer = t.table(spark, sf_dir, "customer")
    quoted = customer.withColumn("c_name", F.concat(F.lit('"'), "c_name", F.lit('", x')))
    path = f"{shared_folder(spark)}/clustrial/csv-{uuid.uuid4().hex}"
    write_csv(quoted, path)
    return read_csv(spark, path, quoted.schema)


def csv_subset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two columns of a practice file, read with its schema."""
    practices = t.practices(spark, sf_dir).selectExpr("code_text AS code", "ccg_id", "setting", "status_code")
    path = f"{shared_folder(spark)}/clustrial/csv-{uuid.uuid4().hex}"
    write_csv(practices, path)
    return read_csv(spark, path, SCHEMAS["practices"], ["code", "status_code"])


def reports(spark: SparkSession, sf_dir: str, ranges: int = 1) -> DataFrame:
    """Nested reports of the events: one page per day and key, one row per event type.

    A second date range repeats the metrics for the preceding day's hour window: here
    the afternoon against the whole day.
    """
    events = t.table(spark, sf_dir, "events", "ts", "event_type", "value", "props").select(
        F.to_date("ts").alias("day"),
        F.get_json_object("props", "$.k").alias("k"),
        "event_type",
        (F.hour("ts") >= 12).alias("afternoon"),
        F.col("value").cast("decimal(18,2)").alias("value"),
    )
    cells = events.groupBy("day", "k", "event_type").agg(
        F.count(F.lit(1)).alias("hits"),
        F.sum("value").alias("amount"),
        F.count_if("afternoon").alias("late_hits"),
        F.sum(F.when(F.col("afternoon"), F.col("value"))).alias("late_amount"),
    )
    whole = F.struct(F.array(F.col("hits").cast("string"), F.col("amount").cast("string")).alias("values"))
    late = F.struct(
        F.array(
            F.col("late_hits").cast("string"),
            F.coalesce(F.col("late_amount").cast("string"), F.lit("")),
        ).alias("values")
    )
    half = F.struct(
        F.array((F.col("hits") / 2).cast("string"), F.lit("")).alias("values")
    )
    metrics = F.array(*[whole, late, half][:ranges])
    row = F.struct(
        F.array(F.date_format("day", "yyyyMMdd"), F.col("event_type")).alias("dimensions"),
        metrics.alias("metrics"),
    )
    # A page holds one row per event type, so the list below stays short.
    pages = cells.groupBy("day", "k").agg(
        F.sort_array(F.collect_list(row)).alias("rows"), F.sum("hits").alias("hits")
    )
    header = F.struct(
        F.array(F.lit("ga:date"), F.lit("ga:eventCategory")).alias("dimensions"),
        F.struct(
            F.array(
                F.struct(F.lit("ga:hits").alias("name")), F.struct(F.lit("ga:amount").alias("name"))
            ).alias("metricHeaderEntries")
        ).alias("metricHeader"),
    )
    data = F.struct(
        "rows",
        F.when(F.col("hits") > 3, F.array(F.lit("3"))).alias("samplesReadCounts"),
        F.when(F.col("hits") > 3, F.array(F.col("hits").cast("string"))).alias(
            "samplingSpaceSizes"
        ),
    )
    return pages.select(
        "day",
        "k",
        F.to_json(
            F.struct(
                header.alias("columnHeader"),
                data.alias("data"),
                F.when(F.col("k") != "99", F.col("k")).alias("nextPageToken"),
            )
        ).alias("report"),
    )


DIMENSIONS = ["ga:date", "ga:eventCategory"]
METRICS = {"ga:hits": "bigint", "ga:amount": "double"}


def report_flatten(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flatten_report(
        reports(spark, sf_dir),
        DIMENSIONS,
        METRICS,
        names=["day", "event_type", "hits", "amount"],
    )


def report_flatten_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two date ranges, with every row repeated per metric and range."""
    return flatten_report(
        reports(spark, sf_dir, ranges=2),
        DIMENSIONS,
        METRICS,
        ranges=2,
        names=["day", "event_type", "hits_0", "amount_0", "hits_1", "amount_1"],
        dedupe=False,
    )


def report_flatten_mixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three date ranges, the last with halves in a metric that is whole in the others."""
    names = [f"{name}_{i}" for i in range(3) for name in ("hits", "amount")]
    return flatten_report(
        reports(spark, sf_dir, ranges=3),
        DIMENSIONS,
        dict.fromkeys(METRICS, "double"),
        ranges=3,
        names=["day", "event_type", *names],
    )


def _faulty_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The reports with faults in some pages: cut texts, words for numbers, dates and dimensions too many."""
    report = """CASE k WHEN '95' THEN left(report, 40)
                       WHEN '96' THEN replace(report, '["1","', '["one","')
                       WHEN '97' THEN regexp_replace(report, '"dimensions":\\\\["[0-9]{8}",', '"dimensions":["20189999",')
                       WHEN '98' THEN replace(report, '"click"]', '"click","twice"]') ELSE report END"""
    return reports(spark, sf_dir, ranges=3).withColumn("report", F.expr(report))


def report_by_header(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Columns and their types as the reports' own headers and values have them."""
    names = [f"{name}_{i}" for i in range(3) for name in ("hits", "amount")]
    return open_report(_faulty_reports(spark, sf_dir)).rows.toDF("day", "event_type", *names)


def report_rejected(spark: SparkSession, sf_dir: str) -> DataFrame:
    return open_report(_faulty_reports(spark, sf_dir)).rejected.groupBy("day", "k", "reason").agg(
        F.count(F.lit(1)).alias("n")
    )


def report_sampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling_notice(reports(spark, sf_dir))


def report_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return unread_pages(reports(spark, sf_dir), ["day"])


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    query.__name__: query
    for query in (
        measure_region_month,
        measure_all_single_scan,
        measure_code_list,
        measure_from_catalog,
        measures_combined,
        measure_prefix_rules,
        measure_incremental,
        measure_reused,
        classify_months,
        period_region_rates,
        period_measure_rates,
        team_list,
        team_rollup,
        pct_rank_min,
        avg_rank_by_group,
        top_units_after_exclusion,
        allocate_seeded,
        allocate_all_practices,
        allocate_stored_draw,
        arm_report,
        visit_list,
        trial_roster,
        trial_roster_by_representative,
        trial_practices,
        period_pivot,
        arm_summary_change,
        secondary_arm_summary,
        top3_measures,
        top3_per_cluster_rate,
        nested_avg_population,
        baseline_characteristics,
        ols_primary_cost,
        ols_primary_items,
        ols_top3,
        ols_single_measure,
        ols_by_measure,
        ols_model,
        ols_pvalues,
        ols_lines_by_e,
        describe_with_nan,
        ols_order_lines,
        ols_order_lines_qr,
        ols_nearly_collinear,
        sensitivity_flag,
        sensitivity_flag_items,
        ols_sensitivity_cost,
        ols_sensitivity_items,
        describe_clusters,
        describe_selected,
        describe_percentiles,
        histogram_bins,
        winsorise_upper,
        trimmed_arm_means,
        trimming_describe,
        trimming_histogram,
        trimming_histograms,
        winsorise_lines,
        parse_dates,
        event_org_parse,
        matched_pair_dates,
        event_window_views,
        event_window_views_keep_empty,
        event_window_alerts,
        page_view_summary,
        alert_summary,
        alert_summary_sizes,
        event_window_alerts_by_length,
        alerts_in_two_windows,
        ols_views_ccg,
        ols_views_practice,
        ols_size_adjusted_ccg,
        ols_size_adjusted_practice,
        csv_roundtrip,
        csv_subset,
        report_flatten,
        report_flatten_ranges,
        report_flatten_mixed,
        report_by_header,
        report_rejected,
        report_sampling,
        report_pages,
    )
}
