"""The six batch reports."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clicktrail import operators as op
from clicktrail.params import VisitCondition
from clicktrail.schemas import REPORT_COLUMNS
from clicktrail.sources import append_sink, replace_parts
from clicktrail.sources.shared import work_folder

Sink = Callable[[str, DataFrame], None]


class OfflineReports:
    """Reports over one filtered visit log, with the columns of the report tables.

    Every method returns a lazy frame. ``write`` runs them and hands each to a sink.
    """

    def __init__(
        self, visits: DataFrame, users: DataFrame, cities: DataFrame, products: DataFrame,
        condition: VisitCondition, task_id: str | None = None, sample: int = 1000, seed: int = 0,
    ):
        self.all_visits, self.cities, self.products = visits, cities, products
        self.condition, self.sample, self.seed = condition, sample, seed
        self.task_id = task_id or str(uuid.uuid4())
        self.visits = op.filter_visits(visits, users, condition)
        self._top: DataFrame | None = None
        self._staged = False

    def stage(self, path: str) -> "OfflineReports":
        """Write the filtered visits and the leading categories once to a folder all nodes
        see, and report from there: the log is filtered and joined once for five reports.
        """
        self.visits = self._kept(self.visits, f"{path}/visits")
        self._top = self._kept(op.category_top(self.visits), f"{path}/categories")
        self._staged = True
        return self

    @staticmethod
    def _kept(df: DataFrame, path: str) -> DataFrame:
        df.write.mode("overwrite").parquet(path)
        return df.sparkSession.read.schema(df.schema).parquet(path)

    def _category_top(self) -> DataFrame:
        return self._top if self._top is not None else op.category_top(self.visits)

    def _report(self, name: str, df: DataFrame) -> DataFrame:
        """Columns by position under the report table's names, after the task id."""
        names = REPORT_COLUMNS[name]
        if names[0] != "taskId":
            return df.toDF(*names)
        return df.select(F.lit(self.task_id), "*").toDF(*names)

    def session_stat_info(self) -> DataFrame:
        stats = op.session_stats(self.visits)
        with_condition = stats.select(F.lit(self.condition.to_json()).alias("condition"), "*")
        return self._report("session_stat_info", with_condition)

    def random_session_info(self) -> DataFrame:
        drawn = op.session_hourly_sample(self.visits, self.sample, self.seed)
        return self._report("random_session_info", drawn)

    def category_top10(self) -> DataFrame:
        return self._report("category_top10", self._category_top())

    def category_top10_session_count(self) -> DataFrame:
        top = op.category_session_top(self.visits, self._category_top())
        return self._report("category_top10_session_count", top)

    def page_convert_rate(self) -> DataFrame:
        rates = op.page_conversion(self.visits, self.condition.target_page_flow)
        return self._report("page_convert_rate", rates.select("page_flow", "ratio"))

    def area_product_top3(self) -> DataFrame:
        """Over the whole log: this report does not apply the condition."""
        top = op.area_product_top(self.all_visits, self.cities, self.products)
        return self._report("area_product_top3", top)

    def all(self) -> dict[str, DataFrame]:
        return {name: getattr(self, name)() for name in REPORT_COLUMNS}

    def write(self, sink: Sink, folder: str | None = None, only: Iterable[str] = ()) -> None:
        """Hand every report, or those in ``only``, to the sink.

        Stages in ``folder`` first, or in one under the shared folder. A single report is
        read from the log directly.
        """
        names = list(only) or list(REPORT_COLUMNS)
        if not self._staged and len(names) > 1:
            self.stage(folder or work_folder(self.visits.sparkSession, "visits"))
        for name in names:
            sink(name, getattr(self, name)())

    def write_jdbc(self, url: str, **options) -> None:
        """Append every report to the database table of its name."""
        self.write(lambda name, df: append_sink(df, "jdbc", url=url, dbtable=name, **options))

    def write_files(self, folder: str) -> None:
        """Write every report under ``folder`` by task id: a write tried again leaves one copy."""
        self.write(lambda name, df: replace_parts(df.withColumn("taskId", F.lit(self.task_id)), f"{folder}/{name}", "taskId"))
