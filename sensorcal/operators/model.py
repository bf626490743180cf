"""Regression models on MLlib, their evaluation and their explanation."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import partial, reduce

from pyspark.ml import PipelineModel
from pyspark.ml.feature import SQLTransformer, VectorAssembler
from pyspark.ml.regression import GBTRegressor, RandomForestRegressor
from pyspark.sql import Column, DataFrame, functions as F

from ..functions import stats
from ..runtime import checkpointed, materialize, run_together
from .bijection import permuted
from .clean import q
from .ordering import global_row_number
from .quantiles import exact_medians, exact_quantiles
from .ridge import Additive, Design, fit_additive, pipeline

_VECTOR = "_features"
#: Rows of a tree model's training set that one task holds, about; MLlib keeps them as objects, some 260 bytes each with boosting.
TASK_ROWS = 500_000
#: Trees of a forest that one fit of MLlib grows; larger forests are grown in batches side by side.
BATCH_TREES = 75


def _filled(name: str, median: float | None) -> str:
    return f"coalesce(CAST(`{name}` AS DOUBLE), {float(median or 0.0)!r}D)"


def _medians(df: DataFrame, cols: Sequence[str]) -> dict[str, float | None]:
    """One row of medians to the driver: as many numbers as features."""
    row = exact_medians(df.select(*map(q, cols)), cols).first()
    return dict(zip(cols, row, strict=True))


def _prepare(exprs: Sequence[str]) -> tuple[SQLTransformer, VectorAssembler]:
    """Feature expressions into a vector."""
    names = [f"_f{i}" for i in range(len(exprs))]
    listed = ", ".join(f"{e} AS {n}" for e, n in zip(exprs, names, strict=True))
    return (
        SQLTransformer(statement=f"SELECT *, {listed} FROM __THIS__"),
        VectorAssembler(inputCols=names, outputCol=_VECTOR),
    )


@dataclass(frozen=True)
class Fitted:
    """A fitted pipeline; ``transform`` adds ``prediction``."""

    pipeline: PipelineModel
    features: tuple[str, ...]
    name: str

    def transform(self, df: DataFrame) -> DataFrame:
        out = self.pipeline.transform(df)
        return out.drop(*[c for c in out.columns if c == _VECTOR or (c[:2] in ("_f", "_p") and c[2:].isdigit())])


@dataclass(frozen=True)
class FittedSum(Fitted):
    """A fitted model that is a sum over its features."""

    parts: Additive


@dataclass(frozen=True)
class RidgeSpline:
    """Ridge regression on standardized features: cubic spline columns of some features, the others as they are."""

    spline: tuple[str, ...]
    numeric: tuple[str, ...]
    alpha: float = 2.0
    knots: int = 6
    name: str = "ridge_spline"

    @property
    def features(self) -> tuple[str, ...]:
        return (*self.spline, *self.numeric)

    def fit(self, df: DataFrame, label: str) -> Fitted:
        found = self.fit_many(df.withColumn("_fit", F.lit(0)), label, [0])
        if not found:
            raise ValueError(f"no rows with {label}")
        return found[0]

    def fit_many(self, df: DataFrame, label: str, fits: Sequence[int]) -> dict[int, Fitted]:
        """A model per value of the column ``_fit`` that has labelled rows, all from the same passes over the rows."""
        models = fit_additive(df, dict.fromkeys(fits, Design(self.spline, self.numeric, self.knots)), label, "_fit", self.alpha)
        return {i: FittedSum(pipeline(m), self.features, self.name, m) for i, m in models.items()}


def _spread(rows: DataFrame) -> DataFrame:
    """More rows than one task should hold are dealt evenly; few stay where they are."""
    n = rows.count()
    if n <= TASK_ROWS:
        return rows
    return rows.repartition(max(-(-n // TASK_ROWS), rows.sparkSession.sparkContext.defaultParallelism))


def _fit_tree(estimators: Sequence[GBTRegressor | RandomForestRegressor], df: DataFrame, label: str, features: tuple[str, ...], name: str) -> Fitted:
    """One estimator gives the prediction; several are forests, and the prediction is the mean over all their trees."""
    checkpointed(df.sparkSession)  # else the lineage grows with every iteration
    df = df.where(q(label).isNotNull())
    med = _medians(df, features)
    select, assemble = _prepare([_filled(c, med[c]) for c in features])
    rows = assemble.transform(select.transform(_spread(df.select(*map(q, dict.fromkeys((*features, label))))))).select(_VECTOR, label)
    jobs = [partial(e.setFeaturesCol(_VECTOR).setLabelCol(label).fit, rows) for e in estimators]
    models = run_together(df.sparkSession, jobs, len(jobs))
    if len(models) == 1:
        return Fitted(PipelineModel([select, assemble, *models]), features, name)
    parts = [x.setPredictionCol(f"_p{i}") for i, x in enumerate(models)]
    total = " + ".join(f"_p{i} * {x.getNumTrees}" for i, x in enumerate(parts))
    mean = SQLTransformer(statement=f"SELECT *, ({total}) / {sum(x.getNumTrees for x in parts)} AS prediction FROM __THIS__")
    return Fitted(PipelineModel([select, assemble, *parts, mean]), features, name)


@dataclass(frozen=True)
class Boosted:
    """Gradient-boosted trees."""

    features: tuple[str, ...]
    iterations: int = 800
    depth: int = 4
    rate: float = 0.06
    min_leaf: int = 20
    seed: int = 0
    name: str = "boosted"

    def fit(self, df: DataFrame, label: str) -> Fitted:
        gbt = GBTRegressor(
            maxIter=self.iterations,
            maxDepth=self.depth,
            stepSize=self.rate,
            maxBins=255,
            minInstancesPerNode=self.min_leaf,
            seed=self.seed,
        )
        return _fit_tree([gbt], df, label, self.features, self.name)


@dataclass(frozen=True)
class Forest:
    """Random forest."""

    features: tuple[str, ...]
    trees: int = 600
    depth: int = 30
    min_leaf: int = 2
    seed: int = 0
    name: str = "forest"

    def fit(self, df: DataFrame, label: str) -> Fitted:
        # Seeds lie far apart, as MLlib adds the number of a partition to them.
        batches = [
            RandomForestRegressor(
                numTrees=min(BATCH_TREES, self.trees - first),
                maxDepth=self.depth,
                minInstancesPerNode=self.min_leaf,
                featureSubsetStrategy="sqrt",
                cacheNodeIds=True,
                seed=self.seed + first * 1_000_003,
            )
            for first in range(0, self.trees, BATCH_TREES)
        ]
        return _fit_tree(batches, df, label, self.features, self.name)


Estimator = RidgeSpline | Boosted | Forest


def _folds_apart(est: Estimator, df: DataFrame, label: str, k: int) -> DataFrame:
    """Predictions of every fold from a model of its own, fitted side by side."""

    def fold(i: int) -> DataFrame:
        model = est.fit(df.where(F.col("fold") < i), label)
        return model.transform(df.where(F.col("fold") == i)).select("fold", q(label).alias("_y"), "prediction")

    return reduce(DataFrame.unionByName, run_together(df.sparkSession, [partial(fold, i) for i in range(1, k + 1)], k))


def _folds_together(est: RidgeSpline, df: DataFrame, label: str, k: int) -> DataFrame:
    """As :func:`_folds_apart`: a row stands once for each fold that it trains, and all folds are fitted in the same passes."""
    rows = df.where(q(label).isNotNull()).select("fold", *map(q, dict.fromkeys((*est.features, label))))
    training = rows.where(F.col("fold") < k).withColumn("_fit", F.explode(F.sequence(F.col("fold") + 1, F.lit(k))))
    models = est.fit_many(training, label, range(1, k + 1))
    if len(models) < k:
        raise ValueError(f"no training rows for folds {sorted(set(range(1, k + 1)) - set(models))}")
    places = {n: F.expr(e) for i, m in models.items() for n, e in m.parts.places(f"_p{i}_").items()}
    by_fold = " ".join(f"WHEN {i} THEN {m.parts.prediction(f'_p{i}_')}" for i, m in models.items())
    tested = rows.where(F.col("fold") >= 1).withColumns(places)
    return tested.select("fold", q(label).alias("_y"), F.expr(f"CASE fold {by_fold} END").alias("prediction"))


def cv_evaluate(est: Estimator, df: DataFrame, label: str, k: int) -> DataFrame:
    """Mean RMSE, MAE and R² over expanding folds; ``df`` carries ``fold`` (see ``time_series_folds``)."""

    scored = _folds_together(est, df, label, k) if isinstance(est, RidgeSpline) else _folds_apart(est, df, label, k)
    y, p = F.col("_y"), F.col("prediction")
    per_fold = scored.groupBy("fold").agg(
        stats.rmse(y, p).alias("rmse"), stats.mae(y, p).alias("mae"), stats.r_squared(y, p).alias("r2")
    )
    return per_fold.agg(
        F.lit(est.name).alias("model"),
        F.avg("rmse").alias("cv_rmse"),
        F.avg("mae").alias("cv_mae"),
        F.avg("r2").alias("cv_r2"),
    )


def model_select(candidates: Sequence[Estimator], df: DataFrame, label: str, k: int) -> tuple[Estimator, Mapping[str, dict]]:
    """The candidate with the smallest cross-validated RMSE (the earlier one on ties), and all their scores."""
    found = {r[0] for r in df.where(q(label).isNotNull()).select("fold").distinct().collect()}  # k + 1 at most
    missing = sorted(set(range(k + 1)) - found)
    if missing:
        raise ValueError(f"cross-validation with {k} folds needs labelled rows in folds 0 to {k}; none in {missing}")
    scores = {c.name: cv_evaluate(c, df, label, k).first().asDict() for c in candidates}
    best = min(candidates, key=lambda c: scores[c.name]["cv_rmse"])
    return best, scores


def holdout_predictions(model: Fitted, test: DataFrame, keep: Sequence[str], label: str) -> DataFrame:
    return model.transform(test).select(
        *map(q, dict.fromkeys((*keep, label, *model.features))),
        "prediction",
        (q(label) - F.col("prediction")).alias("residual"),
    )


def _with_replaced(df: DataFrame, features: Sequence[str], which: Column, value: Column) -> DataFrame:
    return df.withColumns({c: F.when(which == i, value).otherwise(q(c)) for i, c in enumerate(features)})


def permutation_importance(
    model: Fitted,
    df: DataFrame,
    label: str,
    id_cols: Sequence[str],
    repeats: int = 20,
    seed: int = 0,
    delivered: Column | None = None,
) -> DataFrame:
    """Increase of RMSE when one feature is permuted: mean and population deviation over the repeats.

    Rows are numbered by ``id_cols`` (which must be unique); ``_i`` counts from 0. A repeat gives row ``perm(i)`` the
    values of row i, by a keyed permutation (see ``bijection``), the same one for every feature, so one row of values
    per row and repeat is shuffled. A model that is a sum over its features needs what each adds only, and scores all
    features in one aggregation; others predict once per feature. ``delivered`` turns the raw prediction into the
    delivered value (default: the prediction itself), so that a model of a difference is scored on the level.
    """
    feats = list(model.features)
    rows = df.where(q(label).isNotNull()).withColumns({c: q(c).cast("double") for c in feats})
    additive = isinstance(model, FittedSum) and delivered is None
    if additive:
        placed = rows.withColumns({n: F.expr(e) for n, e in model.parts.places("_importance_").items()})
        adds = [F.expr(e) for e in model.parts.values("_importance_").values()]
        rows = placed.select(*map(q, id_cols), (q(label) - F.expr(model.parts.prediction("_importance_"))).alias("_rest"), F.array(*adds).alias("_own"))
    numbered = materialize(global_row_number(rows, [*map(q, id_cols)], "_rn").withColumn("_i", F.col("_rn") - 1), "numbered")
    n = max(1, numbered.count())  # without rows the result has none either
    own = F.col("_own") if additive else F.array(*map(q, feats))
    repeated = numbered.select("_i", own.alias("_moved"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(repeats - 1).cast("long"))).alias("_r"))
    moved = permuted(repeated.withColumn("_key", F.col("_r") + 1000 * seed), "_i", "_key", n, "_to").select(F.col("_to").alias("_i"), "_r", "_moved")
    # Spark takes an exploded table for no larger than its source and might send all repeats to every task.
    moved = moved.hint("merge")
    names = F.array(*[F.lit(c) for c in feats])
    if additive:
        met = numbered.select("_i", "_rest", "_own").join(moved, "_i")
        gaps = [F.col("_rest") + F.get("_own", F.lit(i)) - F.get("_moved", F.lit(i)) for i in range(len(feats))]
        wide = met.groupBy("_r").agg(F.array(*[F.sqrt(F.avg(g * g)) for g in gaps]).alias("_all"))
        per_repeat = wide.select("_r", F.posexplode("_all").alias("_c", "rmse"))
        base = numbered.agg(F.sqrt(F.avg(F.col("_rest") * F.col("_rest"))).alias("b")).scalar()
    else:
        y, delivered = q(label), F.col("prediction") if delivered is None else delivered
        met = numbered.join(moved, "_i").select("*", F.posexplode("_moved").alias("_c", "_v"))
        per_repeat = model.transform(_with_replaced(met, feats, F.col("_c"), F.col("_v"))).groupBy("_c", "_r").agg(stats.rmse(y, delivered).alias("rmse"))
        base = model.transform(numbered).agg(stats.rmse(y, delivered).alias("b")).scalar()
    return (
        per_repeat.groupBy("_c")
        .agg(F.avg("rmse").alias("_m"), F.stddev_pop("rmse").alias("importance_std"))
        .select(F.get(names, F.col("_c")).alias("feature"), (F.col("_m") - base).alias("importance_mean"), "importance_std")
    )


def _grid(df: DataFrame, col: str, points: int) -> list[float]:
    """At most ``points`` values: the distinct values when they are few, else evenly spaced from the 5 % to the 95 % quantile."""
    few = df.select(q(col).cast("double").alias("v")).where("v is not null").distinct().limit(points + 1).collect()
    if len(few) < points:
        return sorted(r[0] for r in few)
    lo, hi = exact_quantiles(df, [col], [0.05, 0.95]).first()[0]
    return [lo + (hi - lo) * i / (points - 1) for i in range(points)]


def partial_dependence(model: Fitted, df: DataFrame, cols: Sequence[str], points: int = 100) -> DataFrame:
    """Average prediction over all rows with one feature set to each value of its grid.

    For a model that is a sum over its features that is the mean prediction, less what the feature adds on average,
    plus what it adds at the value: one aggregation, whatever the grid. Other models score rows × grid.
    """
    feats = list(model.features)
    entries = [(feats.index(c), v) for c in cols for v in _grid(df, c, points)]
    names = F.array(*[F.lit(c) for c in feats])
    if isinstance(model, FittedSum):
        rows = df.withColumns({n: F.expr(e) for n, e in model.parts.places("_pd_").items()})
        adds = model.parts.values("_pd_")
        means = rows.agg(F.avg(F.expr(model.parts.prediction("_pd_"))), *[F.avg(F.expr(adds[c])) for c in cols]).first()
        if means[0] is None:
            return df.sparkSession.createDataFrame([], "feature string, value double, mean_prediction double")
        rest = {c: means[0] - m for c, m in zip(cols, means[1:])}
        grid = df.sparkSession.createDataFrame([(feats[i], v, rest[feats[i]]) for i, v in entries], "feature string, value double, _rest double")
        grid = grid.withColumns({c: F.when(F.col("feature") == c, F.col("value")) for c in feats})
        grid = grid.withColumns({n: F.expr(e) for n, e in model.parts.places("_pd_").items()})
        added = F.coalesce(*[F.when(F.col("feature") == c, F.expr(adds[c])) for c in cols])
        return grid.select("feature", "value", (F.col("_rest") + added).alias("mean_prediction"))
    listed = ", ".join(f"named_struct('c', {i}, 'v', {v!r}D)" for i, v in entries)
    rows = df.withColumns({c: q(c).cast("double") for c in feats}).withColumn("_g", F.explode(F.expr(f"array({listed})")))
    scored = model.transform(_with_replaced(rows, feats, F.col("_g.c"), F.col("_g.v")))
    return (
        scored.groupBy(names[F.col("_g.c")].alias("feature"), F.col("_g.v").alias("value"))
        .agg(F.avg("prediction").alias("mean_prediction"))
    )
