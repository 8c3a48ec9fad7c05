"""Tables that many queries share, written once per application to the shared folder.

The order lines are read once; every later step works on daily demand or on the processed panel.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, functions as F

from tallycast.functions.names import HORIZON
from tallycast.operators.coldstart import coldstart_cutoff_day, coldstart_sample
from tallycast.operators.global_forecast import GlobalModel, fit_global, forecast_global, load_global, save_global
from tallycast.operators.features import add_lag_features, engineer_features, feature_state
from tallycast.operators.ingest import build_panel
from tallycast.operators.metrics import volume_segment
from tallycast.operators.origins import last_day
from tallycast.operators.reshape import future_rows
from tallycast.operators.sampling import stratified_sample
from tallycast.session import scratch_path
from tallycast.sources import demand
from tallycast.sources.tables import bucket_count, write_panel_table

_written: dict[tuple, str] = {}


class Workspace:
    """The shared tables of one data folder in one Spark application."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, str(sf_dir).rstrip("/")

    def _once(self, name: str, write) -> str:
        key = (self.spark.sparkContext.applicationId, self.sf_dir, name)
        if key not in _written:
            _written[key] = write(scratch_path(self.spark, re.sub(r"\W", "_", name)))
        return _written[key]

    def daily(self, grain: str) -> DataFrame:
        def write(path):
            if grain == "fine":
                demand.daily_demand(self.spark, self.sf_dir).write.parquet(path)
            else:
                demand.coarse_demand(self.daily("fine")).write.parquet(path)
            return path

        return self.spark.read.parquet(self._once(f"daily_{grain}", write))

    def calendar(self) -> DataFrame:
        return demand.calendar_dim(self.daily("coarse"))

    def prices(self, grain: str) -> DataFrame:
        return demand.sell_prices(self.daily(grain))

    def long(self, grain: str) -> DataFrame:
        return demand.demand_panel(self.daily(grain))

    def build(self, grain: str) -> DataFrame:
        """The processed panel as a plan. A day with a sale has a price, so daily demand knows the last day."""
        return build_panel(self.long(grain), self.calendar(), self.prices(grain), self.days()["test"])

    def panel(self, grain: str) -> DataFrame:
        """The processed panel, bucketed by series and partitioned by split."""

        def write(path):
            table = path.rsplit("/", 1)[-1].replace("-", "_")
            write_panel_table(self.build(grain), table, path, self.buckets(grain))
            return table

        return self.spark.table(self._once(f"panel_{grain}", write))

    def buckets(self, grain: str) -> int:
        return bucket_count(self.daily(grain).select("id").distinct().count(), self.days()["test"])

    def trainval(self, grain: str) -> DataFrame:
        return self.panel(grain).where("split <> 'test'")

    def days(self) -> dict[str, int]:
        """Last day of train, val and test."""
        end = int(self._once("last_day", lambda _: str(last_day(self.daily("coarse")))))
        return {"train": end - 2 * HORIZON, "val": end - HORIZON, "test": end}

    def with_future(self, grain: str) -> DataFrame:
        """The panel followed by the covariate rows of the days after it."""
        end = self.days()["test"]
        ahead = future_rows(self.panel(grain), self.calendar(), self.prices(grain), end + 1, end + HORIZON)
        return self.panel(grain).unionByName(ahead.withColumn("split", F.lit("future")))

    def engineered(self) -> DataFrame:
        """Features and lags of every series, from the first day to the end of the known covariates.

        Features only look back, so the rows up to any origin are the same as if later rows did not exist.
        """

        def write(path):
            rows = add_lag_features(engineer_features(self.with_future("fine")))
            table = path.rsplit("/", 1)[-1].replace("-", "_")
            write_panel_table(rows, table, path, self.buckets("fine"))
            return table

        return self.spark.table(self._once("engineered", write))

    def _sample(self, name: str, draw) -> DataFrame:
        """A sample of series is drawn once; every step that uses it sees the same written set."""

        def write(path):
            draw().write.parquet(path)
            return path

        return self.spark.read.parquet(self._once(name, write))

    def fit_series(self) -> DataFrame:
        """The series whose windows the global model is fitted on: up to 2000, stratified by category. It forecasts all."""
        train = self.panel("fine").where("split = 'train'")
        return self._sample("fit_series", lambda: stratified_sample(train, 2000, 43))

    def dozen(self) -> DataFrame:
        """A given set of series: a stratified dozen."""
        return self._sample("dozen", lambda: stratified_sample(self.panel("coarse"), 12, 42))

    def coarse_features(self) -> DataFrame:
        """Features and lags of the coarse panel up to the end of val, written once for every origin that reads them."""
        return self._sample("coarse_features", lambda: add_lag_features(engineer_features(self.trainval("coarse"))))

    def train_features(self, grain: str) -> DataFrame:
        """Features and lags of the train days, as the run of an earlier day left them."""
        train = self.panel(grain).where("split = 'train'")
        return self._sample(f"train_features_{grain}", lambda: add_lag_features(engineer_features(train)))

    def feature_state(self, grain: str) -> DataFrame:
        """What the days after train need of it."""
        train = self.panel(grain).where("split = 'train'").drop("split")
        return self._sample(f"feature_state_{grain}", lambda: feature_state(train))

    def segments(self, grain: str) -> DataFrame:
        """The volume segment of every series, from the train days."""
        train = self.panel(grain).where("split = 'train'")
        return self._sample(f"segments_{grain}", lambda: volume_segment(train, self.days()["train"]))

    def cold(self, grain: str, frac: float) -> DataFrame:
        """The cold-start holdout."""
        train = self.panel(grain).where("split = 'train'")
        return self._sample(f"cold_{grain}_{frac}", lambda: coldstart_sample(train, frac))

    def global_model(self) -> GlobalModel:
        """The global model at the end of train: fitted once, then loaded wherever it is needed."""

        def write(path):
            save_global(fit_global(self.engineered(), self.days()["train"], fit_ids=self.fit_series()), path)
            return path

        return load_global(self.spark, self._once("global_model", write))

    def cold_forecast(self) -> DataFrame:
        """The global model retrained without lags on the panel whose cold series lost their history."""

        def write(path):
            origin = self.days()["train"]
            chain = engineer_features(
                self.trainval("fine"), cold_ids=self.cold("fine", 0.05), cutoff_day=coldstart_cutoff_day(origin),
            )
            engineered = self._sample("cold_features", lambda: chain)
            model = fit_global(engineered, origin, use_lags=False, fit_ids=self.fit_series())
            forecast_global(model, engineered, origin).write.parquet(path)
            return path

        return self.spark.read.parquet(self._once("cold_forecast", write))
