"""From a series on a grid to a trained predictor and its predictions: load, tasks, train, predict."""

from __future__ import annotations

import math
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridspark.functions import calendar
from gridspark.operators import clean, climatology, fields, normalize, tasks
from gridspark.operators.sampling import Sampling, sample
from gridspark.plans import metrics, readout, runs, training
from gridspark.plans.predictors import Kernel, Predictor, SetConv, predictor_of, store
from gridspark.sources import tables


@dataclass
class Flow:
    """One variable on a grid; static has cell_id, lat, lon and any layers (mask, depth).

    load() sets `series` (time, date, cell_id, x1, x2, y in model space), `scaling` (how it got there) and `cells`
    (cell_id, x1, x2). Nothing is computed before train(), predict() or an action, but the check of validity and the
    fit of the scaling.
    """

    spark: SparkSession
    static: DataFrame
    value: str = "sst"
    layers: tuple[str, ...] = ()
    series: DataFrame | None = None
    cells: DataFrame | None = None
    scaling: dict[str, tuple[str, float, float]] = field(default_factory=dict)
    is_stored: bool = False

    def load(self, obs: DataFrame | str, start_year: int = 2007, end_year: int = 2022, anomaly_start: str = "2007-01-01", anomaly_end: str = "2016-12-31", use_anomalies: bool = True, stored: DataFrame | None = None, fit_start: str | None = None, fit_end: str | None = None, scale: int | None = None, fill: float | None = clean.FILL) -> Flow:
        """obs: time, cell_id and the value, or the template of yearly files ({date}; the end year is left out).

        Missing values are filled. With anomalies, those of all years loaded are taken and then cut to the window;
        with a stored climatology they are not cut. The scaling is fitted on fit_start..fit_end (all rows without).
        """
        raw = tables.read_years(self.spark, obs, start_year, end_year) if isinstance(obs, str) else obs
        fields.require_names(raw, "time", "cell_id", self.value)
        clean.require_valid(raw, self.value)
        filled = clean.fill(raw.select("time", "cell_id", self.value), self.value, with_=fill)
        if stored is not None:
            values = climatology.anomalies(filled, self.value, ("cell_id",), clim=stored).withColumn(self.value, F.col("anom"))
        elif use_anomalies:
            values = climatology.anomalies(filled, self.value, ("cell_id",), start=anomaly_start, end=anomaly_end, scale=scale).withColumn(self.value, F.col("anom"))
        else:
            values = filled
        window = values if fit_start is None else fields.time_slice(values, fit_start, fit_end)
        self.scaling = normalize.params(normalize.fit(window, (self.value,))) | normalize.params(normalize.fit(self.static, ("lat", "lon"), "unit"))
        if self.layers:
            self.scaling |= normalize.params(normalize.fit(self.static, self.layers, "min_max"))
        self.cells = normalize.apply(self.static.select("cell_id", "lat", "lon"), {c: self.scaling[c] for c in ("lat", "lon")}).select("cell_id", F.col("lat").alias("x1"), F.col("lon").alias("x2"))
        y = normalize.transform(F.col(self.value), *self.scaling[self.value])
        self.series = values.join(self.cells, "cell_id").select("time", F.to_date("time").alias("date"), "cell_id", "x1", "x2", y.alias("y"))
        self.is_stored = False
        return self

    def dates(self, start: str, end: str, every: int = 1) -> DataFrame:
        """Every so manieth date from start to end; those that the series lacks give no task."""
        return calendar.dates(self.spark, start, end, every)

    def layer_frames(self) -> list[DataFrame]:
        at = self.static.join(self.cells, "cell_id")
        return [at.select("cell_id", "x1", "x2", normalize.transform(F.col(c).cast("double"), *self.scaling[c]).alias("y")) for c in self.layers]

    def generate_tasks(self, dates: DataFrame, n_range: tuple[int, int] | int | None = (0, 500), seed: int = 0, mask: DataFrame | None = None) -> DataFrame:
        """Task points: a sampled context (a number from n_range, its end left out, for each date), layers, all targets."""
        how = Sampling(seed=seed) if n_range is None else Sampling(n=n_range, seed=seed) if isinstance(n_range, int) else Sampling(low=n_range[0], high=n_range[1], seed=seed)
        dated = self.series.select("date", "cell_id", "x1", "x2", "y")
        return tasks.build([(dated, how), *((frame, Sampling()) for frame in self.layer_frames())], (dated, Sampling()), dates, mask, repeat_static=False)

    def predicted(self, predictor: Predictor, points: DataFrame) -> DataFrame:
        """date, cell_id, mean, std at the targets of the tasks, in units of the series; tasks without context have the prior."""
        return self._in_units(self._at_targets(predictor, points)).withColumnRenamed("target_id", "cell_id")

    def _at_targets(self, predictor: Predictor, points: DataFrame) -> DataFrame:
        """Only cells with a truth are predicted."""
        context, targets = self._meetings(points)
        return predictor.predict(context, targets.drop("y"), self.layer_frames())

    def _in_units(self, pred: DataFrame) -> DataFrame:
        how = self.scaling[self.value]
        return pred.select("date", "target_id", normalize.inverse(F.col("mean"), *how).alias("mean"), normalize.scale(F.col("std"), *how).alias("std"))

    def truth(self, points: DataFrame) -> DataFrame:
        return points.where("role = 'target'").select("date", "cell_id", normalize.inverse(F.col("y"), *self.scaling[self.value]).alias("y"))

    def validation_rmse(self, predictor: Predictor, points: DataFrame) -> float | None:
        """Root mean square over all targets of all tasks together, in units of the series; null without a pair."""
        return metrics.rmse(self.predicted(predictor, points), self.truth(points), ["date", "cell_id"]).first()["rmse"]

    def training_loss(self, predictor: Predictor, points: DataFrame) -> float | None:
        """The mean over tasks of each task's mean square error, in model space."""
        pred = self._at_targets(predictor, points).withColumnRenamed("target_id", "cell_id")
        error = F.col("mean") - F.col("y")
        each = pred.join(points.where("role = 'target'").select("date", "cell_id", "y"), ["date", "cell_id"]).groupBy("date").agg(F.avg(error * error).alias("loss"))
        return each.agg(F.avg("loss")).first()[0]

    def train(self, output: str | None, candidates: list[Predictor], train: tuple[str, str] = ("2007-01-01", "2014-12-31"), val: tuple[str, str] = ("2015-01-01", "2016-12-31"), every: int = 5, n_range: tuple[int, int] | int | None = (0, 500), run_id: str = "run") -> DataFrame:
        """epoch, loss, val_rmse, is_best: an epoch for each candidate, on training tasks drawn anew (seed: the epoch).

        Validation tasks are drawn once (seed 0) and kept. With an output folder, the metrics are appended there, the
        scaling is stored, and each best candidate so far under its epoch. Epochs follow one another, as their tasks
        differ; each is two jobs over all its dates.
        """
        self.store(output)
        val_points = tables.stored(self.generate_tasks(self.dates(*val, every), n_range, seed=0))
        best, rows = float("inf"), []
        for epoch, predictor in enumerate(candidates, 1):
            loss = self.training_loss(predictor, self.generate_tasks(self.dates(*train, every), n_range, seed=epoch))
            error = self.validation_rmse(predictor, val_points)
            is_best = error is not None and error < best
            best = error if is_best else best
            rows.append((epoch, loss, error, is_best))
            if output:
                runs.save_if_best(store(self.spark, predictor), f"{output}/predictor", epoch, is_best)
        found = self.spark.createDataFrame(rows, "epoch int, loss double, val_rmse double, is_best boolean")
        if output:
            runs.log_metrics(found, f"{output}/metrics", run_id)
            self.save_scaling(f"{output}/scaling")
        return found

    def store(self, output: str | None = None) -> None:
        """Write the series once, dates together and in order, and go on from the table: each epoch reads it twice.

        Its size is that of the observations; reads of some dates skip the row groups of the others.
        """
        if self.series is not None and not self.is_stored:
            ordered = self.series.repartitionByRange("date").sortWithinPartitions("date", "cell_id")
            self.series = tables.stored(ordered, None if output is None else f"{output}/series")
            self.is_stored = True

    def fit(self, output: str | None, start: Kernel, epochs: int = 25, learning_rate: float = 0.05, batch_size: int | None = None, train: tuple[str, str] = ("2007-01-01", "2014-12-31"), val: tuple[str, str] = ("2015-01-01", "2016-12-31"), every: int = 5, n_range: tuple[int, int] | int | None = (0, 500), run_id: str = "run") -> DataFrame:
        """epoch, loss, val_rmse, is_best and the parameters after each epoch: gradient descent from `start`.

        As train(), but the predictor learns: each epoch draws its tasks anew and takes a step for each batch of
        batch_size tasks (all at once without one, which is one job an epoch). With an output folder the state is stored
        after each epoch, and a run over the same folder goes on from there; `epochs` counts from the first.
        """
        self.store(output)
        val_points = tables.stored(self.generate_tasks(self.dates(*val, every), n_range, seed=0))
        state, rows = training.load(self.spark, output, start), []
        for epoch in range(state.epoch + 1, epochs + 1):
            points = tables.stored(self.generate_tasks(self.dates(*train, every), n_range, seed=epoch))
            losses = []
            for batch in training.batches(points, batch_size):
                found = training.gradient(*self._meetings(batch), state.kernel(start.reach))
                losses.append((found[0], found[1]))
                state = training.step(state, found[2:], learning_rate)
            error = self.validation_rmse(state.kernel(start.reach), val_points)
            is_best = error is not None and error < state.best
            state = replace(state, epoch=epoch, best=error if is_best else state.best)
            n = sum(k for k, _ in losses)
            rows.append((epoch, sum(k * x for k, x in losses if k) / n if n else None, error, is_best, *map(math.exp, state.log)))
            if output:
                runs.save_if_best(store(self.spark, state.kernel(start.reach)), f"{output}/predictor", epoch, is_best)
                training.save(self.spark, state, output)
        found = self.spark.createDataFrame(rows, "epoch int, loss double, val_rmse double, is_best boolean, length1 double, length2 double, prior double")
        if output and rows:
            runs.log_metrics(found, f"{output}/metrics", run_id)
            self.save_scaling(f"{output}/scaling")
        return found

    def fit_readout(self, kernel: Kernel, train: tuple[str, str] = ("2007-01-01", "2014-12-31"), every: int = 5, n_range: tuple[int, int] | int | None = (0, 500), seed: int = 1, ridge: float = 1e-3) -> readout.LayerReadout:
        """A predictor that uses all context sets: the sampled context and the layers of the flow."""
        context, targets = self._meetings(self.generate_tasks(self.dates(*train, every), n_range, seed=seed))
        return readout.fit(context, targets, kernel, self.layer_frames(), ridge)

    def _meetings(self, points: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Context (date, x1, x2, y) and targets (date, target_id, x1, x2, y) of tasks."""
        context = points.where("role = 'context' and set_idx = 0").select("date", "x1", "x2", "y")
        return context, points.where("role = 'target'").select("date", F.col("cell_id").alias("target_id"), "x1", "x2", "y")

    def save_scaling(self, path: str) -> None:
        runs.save(self.spark.createDataFrame([(v, *p) for v, p in sorted(self.scaling.items())], "var_id string, method string, p1 double, p2 double"), path)

    def load_scaling(self, path: str) -> None:
        self.scaling = normalize.params(runs.load(self.spark, path))

    def best(self, output: str) -> Predictor:
        """The last candidate that train() stored."""
        return predictor_of(runs.load_best(self.spark, f"{output}/predictor"))

    def predict(self, predictor: Predictor, dates: DataFrame, targets: DataFrame | None = None, how: Sampling = Sampling()) -> DataFrame:  # noqa: B008
        """date, target_id, lat, lon, mean, std in units of the series, on all cells or at the targets (target_id, lat, lon)."""
        places = self.static.select(F.col("cell_id").alias("target_id"), "lat", "lon") if targets is None else targets.select("target_id", "lat", "lon")
        in_space = normalize.apply(places, {c: self.scaling[c] for c in ("lat", "lon")}).select("target_id", F.col("lat").alias("x1"), F.col("lon").alias("x2"))
        dated = self.series.join(dates, "date", "left_semi")
        context = sample(dated, how).select("date", "x1", "x2", "y")
        wanted = dated.select("date").distinct().crossJoin(in_space)  # what is asked for: every place on every date
        return self._in_units(predictor.predict(context, wanted, self.layer_frames())).join(places, "target_id").select("date", "target_id", "lat", "lon", "mean", "std")


def lengths(values: list[float], reach: float | None = 8.0) -> list[Predictor]:
    """A kernel predictor for each length, over sampled context within so many lengths (beyond 8, weights are under 2e-14).

    Without a reach they take context of any size, in two passes along the axes.
    """
    return [SetConv(v, None if reach is None else reach * v) for v in values]
