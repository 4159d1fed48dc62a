"""One trial from its tables to its outcomes; what several analyses use is stored once."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from datetime import date
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clustrial.functions import ALERT_WINDOW, PAGE_VIEW_WINDOW, Periods, Window, parse_visit_date
from clustrial.operators.clusters import roster_practices
from clustrial.operators.measures import combine_measures, region_month_measures
from clustrial.operators.summary import arm_report
from clustrial.plans import engagement, trial
from clustrial.sources.tables import TableStore, store


@dataclass
class Study:
    """The tables and choices of a trial, and its analyses as properties.

    ``prescribing`` has ``practice, month, measure, items, cost``; ``statistics`` and
    ``practices`` are those of ``region_month_measures``, ``teams`` has ``ccg_id,
    joint_team``. ``timetable`` makes ``joint_id, date`` (day-first text) from the
    allocation. ``practice_codes`` adapts the practices' codes to those in web paths.

    Three small tables are stored when first needed, as several analyses start from each:
    the month table of all measures, the allocated clusters and their paired visit dates.
    With a ``tables`` owner they are named by what they hold, so a second study over the
    same inputs reads them, and they are deleted with their owner.
    """

    prescribing: DataFrame
    statistics: DataFrame
    practices: DataFrame
    teams: DataFrame
    measures: Sequence[str]
    periods: Periods
    first: date
    last: date
    excluded: Sequence[str]
    size: int
    seed: int
    timetable_of: Callable[[DataFrame], DataFrame]
    practice_codes: Callable[[DataFrame], DataFrame] = lambda practices: practices
    tables: TableStore | None = None

    def _stored(self, df: DataFrame, label: str) -> DataFrame:
        return self.tables.reuse(df, label) if self.tables else store(df, label)

    @cached_property
    def monthly(self) -> DataFrame:
        """Every measure by month and region."""
        return self._stored(self.month_table(self.prescribing, self.measures), "measures")

    def month_table(self, prescribing: DataFrame, measures: Sequence[str]) -> DataFrame:
        return region_month_measures(
            prescribing, self.statistics, self.practices, list(measures), self.first, self.last
        )

    @cached_property
    def clusters(self) -> DataFrame:
        """Baseline rate of every cluster."""
        rates = trial.baseline_rates(combine_measures(self.monthly), self.periods)
        return trial.cluster_baselines(rates, self.teams)

    @cached_property
    def allocation(self) -> DataFrame:
        """The selected clusters and their arms, at most ``size`` rows."""
        chosen = trial.select_and_allocate(self.clusters, list(self.excluded), self.size, self.seed)
        return self._stored(chosen, "allocation")

    def arm_report(self) -> DataFrame:
        return arm_report(self.allocation, "baseline")

    @cached_property
    def members(self) -> DataFrame:
        """Member regions of the allocated clusters."""
        return trial.trial_members(self.allocation, self.teams)

    @cached_property
    def outcomes(self) -> DataFrame:
        """Cost and items of all measures together, by cluster."""
        return trial.combined_outcomes(self.monthly, self.members, self.periods)

    @cached_property
    def outcomes_by_measure(self) -> DataFrame:
        return trial.outcomes_by_measure(self.monthly, self.members, self.periods)

    @cached_property
    def timetable(self) -> DataFrame:
        return self.timetable_of(self.allocation)

    @cached_property
    def flagged(self) -> DataFrame:
        """Outcomes with the flag of a visit that took place, for the sensitivity analysis."""
        return trial.visited_flag(self.outcomes, self.timetable)

    @cached_property
    def list_sizes(self) -> DataFrame:
        """Mean list size of every region over the months fetched."""
        populations = trial.region_populations(
            self.statistics, self.practices, self.first, self.last, {"total_list_size": "list_size"}
        )
        return populations.where(F.col("pct_id").isNotNull())

    @cached_property
    def units(self) -> DataFrame:
        """The clusters with list size and their own or their partner's visit date."""
        dates = self.timetable.select("joint_id", parse_visit_date("date").alias("date"))
        sizes = engagement.cluster_list_sizes(self.members, self.list_sizes)
        return self._stored(engagement.pair_visit_dates(self.members, dates, sizes), "visit-dates")

    @cached_property
    def trial_practices(self) -> DataFrame:
        """Practices of the trial's regions."""
        return roster_practices(self.members, self.practice_codes(self.practices))

    def page_views(
        self, views: DataFrame, window: Window = PAGE_VIEW_WINDOW, keep_empty: bool = False
    ) -> DataFrame:
        """Views and pages of every cluster before and after its visit, from ``Page, Date, views``."""
        return engagement.cluster_page_views(
            engagement.parse_page_views(views), self.members, self.trial_practices, self.units, window, keep_empty
        )

    def alerts(
        self, alerts: DataFrame, window: Window = ALERT_WINDOW, practice_length: int | None = 6
    ) -> DataFrame:
        """Users with approved alerts of every cluster before and after its visit."""
        return engagement.cluster_alerts(
            alerts, self.members, self.trial_practices, self.units, window, practice_length
        )
