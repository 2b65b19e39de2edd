"""Price models: baselines, fits, grid search on a fixed fold, sweeps and comparison."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark import SparkContext
from pyspark.ml import Estimator, Model, Pipeline, PipelineModel
from pyspark.ml.feature import (
    Bucketizer, ImputerModel, MaxAbsScalerModel, MinMaxScalerModel, OneHotEncoderModel, StandardScalerModel, StringIndexerModel, VectorAssembler,
)
from pyspark.ml.functions import vector_to_array
from pyspark.ml.param import Param
from pyspark.ml.regression import GBTRegressionModel, GBTRegressor, LinearRegression, LinearRegressionModel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .aggregates import error_metrics
from .sorting import exact_quantiles, sample_n

#: Stages that treat each input column by itself; with a linear model behind them a prediction is a sum over columns.
BY_COLUMN = (ImputerModel, MaxAbsScalerModel, MinMaxScalerModel, OneHotEncoderModel, StandardScalerModel, StringIndexerModel, VectorAssembler)


def mean_baseline(df: DataFrame, target: str, split: str = "split") -> DataFrame:
    """Every row predicted by the mean target of the train split."""
    mean = df.where(F.col(split) == "train").agg(F.avg(target)).scalar()
    return df.withColumn("pred", mean)


def robust_linear(features: str = "features", target: str = "target", **params) -> LinearRegression:
    """Linear fit with a robust loss, the stand-in for a linear support-vector regressor."""
    settings = {"maxIter": 50, "epsilon": 1.35, **params}
    return LinearRegression(featuresCol=features, labelCol=target, predictionCol="pred", loss="huber", **settings)


def least_squares(features: str = "features", target: str = "target", **params) -> LinearRegression:
    """Ordinary least squares (or ridge, by regParam) from the normal equations: one pass over the data."""
    return LinearRegression(featuresCol=features, labelCol=target, predictionCol="pred", solver="normal", **params)


def boosted_trees(features: str = "features", target: str = "target", **params) -> GBTRegressor:
    settings = {"maxIter": 20, "maxDepth": 5, "seed": 42, **params}
    return GBTRegressor(featuresCol=features, labelCol=target, predictionCol="pred", **settings)


_READS = ("inputCol", "inputCols", "featuresCol", "labelCol", "weightCol", "validationIndicatorCol", "offsetCol", "censorCol")


#: Rows of a task of an iterative fit: such a fit keeps its rows in memory, some 100 to 350 bytes each, and reads them each round.
ROWS_PER_TASK = 500_000


def _narrow(df: DataFrame, stages: list) -> DataFrame:
    """`df` with the columns that the stages read, where all of them say so."""
    named = [{p: s.getOrDefault(p) for p in _READS if s.hasParam(p) and s.isDefined(p)} for s in stages]
    if all(any(p in names for p in ("inputCol", "inputCols", "featuresCol")) for names in named):
        read = {c for names in named for value in names.values() for c in ([value] if isinstance(value, str) else value)}
        df = df.select(*[c for c in df.columns if c in read])
    return df


def _stored(df: DataFrame, stages: list) -> DataFrame:
    """`df` written once with the columns that the stages read: each stage is fitted by passes of its own over them."""
    return materialize(_narrow(df, stages), "train")


def _iterates(stage) -> bool:
    """Whether a stage learns a target in rounds over rows that it keeps; normal equations take one pass."""
    return stage.hasParam("labelCol") and not (stage.hasParam("solver") and stage.getOrDefault("solver") == "normal")


def _fit_stored(stages: list, train: DataFrame) -> PipelineModel:
    """Fit the stages in turn; an iterative last stage gets its rows in tasks of bounded size.

    A scan packs compressed files up to a number of bytes, so its tasks hold more rows the larger the table is.
    Boosted trees get one weighted row for all rows that no split can tell apart.
    """
    rows = train.count() if stages and _iterates(stages[-1]) else 0
    if rows <= ROWS_PER_TASK:
        return Pipeline(stages=stages).fit(train)
    first = Pipeline(stages=stages[:-1]).fit(train)
    model = _fit_cells(stages[-1], first, train, rows) if isinstance(stages[-1], GBTRegressor) else None
    if model is None:
        model = stages[-1].fit(_dealt(_narrow(first.transform(train), stages[-1:]), rows))
    return PipelineModel([*first.stages, model])


def _dealt(df: DataFrame, rows: int) -> DataFrame:
    return df.repartition(max(math.ceil(rows / ROWS_PER_TASK), df.sparkSession.sparkContext.defaultParallelism))


#: Features up to which rows are worth grouping by the bins of all of them.
CELL_FEATURES = 64


def _by_cells(stage: GBTRegressor, df: DataFrame) -> bool:
    """Whether a fit depends on the rows of a cell only through their number and mean target."""
    plain = stage.getLossType() == "squared" and stage.getSubsamplingRate() == 1.0 and stage.getMinInstancesPerNode() == 1 and stage.getMaxBins() <= 256
    extra = any(stage.isDefined(p) for p in (stage.weightCol, stage.validationIndicatorCol))
    kinds = df.schema[stage.getFeaturesCol()].metadata.get("ml_attr", {}).get("attrs", {})
    return plain and not extra and not {"nominal", "binary"} & set(kinds)  # those would be split by category


def _thresholds(values: np.ndarray, most: int) -> np.ndarray:
    """At most about `most` thresholds that cut the values evenly, midway between neighbours; the rule of Spark's trees."""
    points, counts = np.unique(values, return_counts=True)
    midway = (points[:-1] + points[1:]) / 2.0
    if len(midway) <= most:
        return midway
    stride = len(values) / (most + 1)
    found, seen, goal = [], int(counts[0]), stride
    for i, count in enumerate(counts[1:]):
        if abs(seen - goal) < abs(seen + int(count) - goal):
            found.append(midway[i])
            goal += stride
        seen += int(count)
    return np.array(found)


def _fit_cells(stage: GBTRegressor, first: PipelineModel, train: DataFrame, rows: int) -> GBTRegressionModel | None:
    """Boosted trees fitted on one row per cell, with the mean target of the cell's rows and their number as weight.

    A split is only looked for at a feature's thresholds, found as Spark finds them (from all rows or some
    maxBins ** 2, at least 10,000). Rows between the same thresholds in all features are a cell: they go down each tree together
    and get the same prediction, so with squared loss sums over cells are sums over rows, and gains and leaves come
    out the same (impurities lack the spread inside cells). The rounds then read cells, whose number is bounded by
    the bins however many rows there are. None where this does not hold; the caller then fits on the rows.
    """
    x, y = stage.getFeaturesCol(), stage.getLabelCol()
    vectors = lambda df: _narrow(first.transform(df), [stage])
    if not _by_cells(stage, vectors(train)):
        return None
    wanted = max(stage.getMaxBins() ** 2, 10_000)
    some = train if rows <= wanted else train.sample(wanted / rows, seed=stage.getSeed())
    array = vector_to_array(x)
    sample = vectors(some).where(F.size(array) <= CELL_FEATURES).select(array.alias("x")).toPandas()["x"]
    if not len(sample) or len(set(map(len, sample))) > 1 or not np.isfinite(np.stack(sample)).all():
        return None
    found = [_thresholds(column, min(stage.getMaxBins(), rows) - 1) for column in np.stack(sample).T]
    cut = [i for i, t in enumerate(found) if len(t)]
    if not cut:
        return None

    # A value at a threshold goes left, but a bucket holds its lower end.
    edges = [[-math.inf, *np.unique(np.nextafter(found[i], math.inf)).tolist(), math.inf] for i in cut]
    bins = Bucketizer(splitsArray=edges, inputCols=[f"_v{i}" for i in cut], outputCols=[f"_b{i}" for i in cut], handleInvalid="keep")
    keys, places = [], {}  # numbers of bins as digits of as few integers as hold them
    size = 1 << 63
    for i, edge in zip(cut, edges):
        if size * (len(edge) - 1) >= 1 << 62:
            keys.append([])
            size = 1
        keys[-1].append(i)
        places[i] = (f"_k{len(keys) - 1}", size, len(edge) - 1)
        size *= len(edge) - 1
    values = vectors(train).select(array.alias("_x"), F.col(y).cast("double").alias("_y"))
    finite = lambda c: F.coalesce(F.abs(c) < math.inf, F.lit(False))
    whole = finite(F.col("_y")) & F.coalesce(F.forall("_x", finite), F.lit(False)) & (F.size("_x") == len(found))
    cells = bins.transform(values.select("_y", whole.alias("_whole"), *[F.get("_x", F.lit(i)).alias(f"_v{i}") for i in cut]))
    digit = lambda i: F.col(f"_b{i}").cast("bigint") * F.lit(places[i][1]).cast("bigint")
    cells = cells.select("_y", *[F.when(F.col("_whole"), sum((digit(i) for i in key[1:]), digit(key[0]))).alias(f"_k{n}") for n, key in enumerate(keys)])
    names = [f"_k{n}" for n in range(len(keys))]
    cells = materialize(cells.groupBy(*names).agg(F.count(F.lit(1)).cast("double").alias("_n"), F.avg("_y").alias(y)), "cells")
    n_cells, odd = cells.agg(F.count(F.lit(1)), F.count_if(F.col("_k0").isNull())).first()
    if odd:  # a null or non-finite entry, which the fit itself reports
        return None
    at = [F.expr(f"cast(({places[i][0]} div {places[i][1]}) % {places[i][2]} as double)") if i in places else F.lit(0.0) for i in range(len(found))]
    inputs = [f"_b{i}" for i in range(len(found))]
    cells = VectorAssembler(inputCols=inputs, outputCol=x).transform(cells.select("_n", y, *[c.alias(b) for c, b in zip(at, inputs)]))
    # With so many bins allowed, the fit takes its thresholds from all cells: one between any two numbers of bins.
    every = max(stage.getMaxBins(), math.isqrt(n_cells) + 1)
    over = stage.copy({stage.weightCol: "_n", stage.maxBins: every})
    return _over_values(stage, over.fit(_dealt(cells.select("_n", x, y), n_cells)), found)


def _over_values(stage: GBTRegressor, model: GBTRegressionModel, thresholds: list[np.ndarray]) -> GBTRegressionModel:
    """A model over numbers of bins as the same trees over the values themselves."""
    sc = SparkContext._active_spark_context
    ml = sc._jvm.org.apache.spark.ml

    def node(old):
        if not old.subtreeDepth():
            return old
        i = old.split().featureIndex()
        split = ml.tree.ContinuousSplit(i, float(thresholds[i][int(old.split().threshold())]))
        return ml.tree.InternalNode(
            old.prediction(), old.impurity(), old.gain(), node(old.leftChild()), node(old.rightChild()), split, old.impurityStats()
        )

    old = list(model._java_obj.trees())
    kind = ml.regression.DecisionTreeRegressionModel
    trees, weights = sc._gateway.new_array(kind, len(old)), sc._gateway.new_array(sc._jvm.double, len(old))
    for n, (tree, weight) in enumerate(zip(old, model.treeWeights)):
        trees[n], weights[n] = kind(tree.uid(), node(tree.rootNode()), tree.numFeatures()), float(weight)
    made = ml.regression.GBTRegressionModel(model.uid, trees, weights, model.numFeatures)
    return stage._copyValues(GBTRegressionModel(made))


def fit(stages: list, train: DataFrame) -> PipelineModel:
    return _fit_stored(stages, _stored(train, stages))


def grid_search(
    estimator: Estimator, grid: list[dict[Param, object]], train: DataFrame, valid: DataFrame, target: str = "target"
) -> tuple[list[tuple[dict[str, object], float]], Model]:
    """Fit each setting on train, rank by RMSE on the fixed validation rows, return the best fit.

    Models stay fitted on the train split only. Leading stages of a pipeline that no setting touches are fitted
    once, and their output is written once for all settings.
    """
    stages = estimator.getStages() if isinstance(estimator, Pipeline) else [estimator]
    touched = {p.parent for setting in grid for p in setting}
    free = next((i for i, stage in enumerate(stages) if stage.uid in touched or isinstance(stage, Pipeline)), 0)
    if estimator.uid in touched:
        free = 0
    kept = fit(stages[:free], train) if free else None
    if kept is not None:
        train, valid, estimator = kept.transform(train), kept.transform(valid), Pipeline(stages=stages[free:])
    train, valid = _stored(train, stages[free:]), materialize(valid, "valid")
    results, best, best_rmse = [], None, None
    for setting in grid:
        set_to = estimator.copy(setting)
        model = _fit_stored(set_to.getStages(), train) if isinstance(set_to, Pipeline) else _fit_stored([set_to], train).stages[0]
        rmse = error_metrics(model.transform(valid), target, "pred").first()["rmse"]
        results.append(({p.name: v for p, v in setting.items()}, rmse))
        if best_rmse is None or rmse < best_rmse:
            best, best_rmse = model, rmse
    if kept is not None and best is not None:
        best = PipelineModel([*kept.stages, *best.stages])
    return results, best


def ridge_grid(
    df: DataFrame, penalties: list[float], features: str = "features", target: str = "target", split: str = "split"
) -> tuple[list[tuple[float, float | None]], dict[float, np.ndarray]]:
    """Validation RMSE and weights (intercept first) of a ridge fit for each penalty, from one pass over the data.

    The sums of products of features and target, per split, hold all that any penalty needs: the fit comes
    from those of the train rows, the error from those of the valid rows. Each task adds up its rows and the
    sums meet entry by entry; the driver gets one square matrix a split, (features + 2) wide. A fit minimises
    half the mean squared error plus half the penalty times the squared weights without the intercept. Rows with a null or non-finite entry do not count. Without train rows there are no fits, without valid rows no errors.
    """

    def products(batches):
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for name, part in batch.groupby("name"):
                if len(part):
                    rows = np.column_stack([np.ones(len(part)), np.stack(part["x"]), part["y"].to_numpy()])
                    rows = rows[np.isfinite(rows).all(axis=1)]
                    sums[name] = sums.get(name, 0.0) + rows.T @ rows
        if sums:
            yield pd.DataFrame({"name": list(sums), "sums": [m.ravel() for m in sums.values()]})

    rows = df.select(F.col(split).alias("name"), vector_to_array(features).alias("x"), F.col(target).cast("double").alias("y"))
    rows = rows.where(F.col("name").isin("train", "valid")).na.drop()
    entries = rows.mapInPandas(products, "name string, sums array<double>").select("name", F.posexplode("sums").alias("at", "part"))
    found: dict[str, list] = {}
    for name, _, value in entries.groupBy("name", "at").agg(F.sum("part")).orderBy("name", "at").collect():
        found.setdefault(name, []).append(value)
    square = {name: np.array(values).reshape(math.isqrt(len(values)), -1) for name, values in found.items()}
    if "train" not in square or not square["train"][0, 0]:
        return [], {}
    results, weights, train = [], {}, square["train"]
    for penalty in penalties:
        system = train[:-1, :-1] / train[0, 0] + np.diag([0.0] + [float(penalty)] * (len(train) - 2))
        weights[penalty] = np.linalg.lstsq(system, train[:-1, -1] / train[0, 0], rcond=None)[0]
        residual = np.append(-weights[penalty], 1.0)  # target minus prediction, as weights of the products
        valid = square.get("valid")
        seen = valid is not None and valid[0, 0] > 0
        results.append((penalty, math.sqrt(max(residual @ valid @ residual, 0.0) / valid[0, 0]) if seen else None))
    return results, weights


def linear_prediction(weights: np.ndarray, features: str = "features") -> Column:
    """Prediction of a fit of `ridge_grid`, as a column."""
    terms = F.zip_with(vector_to_array(features), F.array(*[F.lit(float(w)) for w in weights[1:]]), lambda x, w: x * w)
    return F.aggregate(terms, F.lit(float(weights[0])), lambda total, x: total + x)


def score_batch(model: Model, df: DataFrame, placeholder: str | None = None) -> DataFrame:
    """One prediction per row; a missing target column is filled with 0."""
    if placeholder and placeholder not in df.columns:
        df = df.withColumn(placeholder, F.lit(0.0))
    return model.transform(df)


def by_columns(model: Model) -> bool:
    """Whether the model's prediction is known to be a sum of parts that each depend on one input column."""
    stages = model.stages if isinstance(model, PipelineModel) else [model]
    return isinstance(stages[-1], LinearRegressionModel) and all(isinstance(s, BY_COLUMN) for s in stages[:-1])


def _effects(base: DataFrame, column: str, points: list, model: Model) -> list[float] | None:
    """What each grid value adds to a prediction at the first one, read off one row; None if no row can be scored.

    `base` holds predictions at the first value.
    """
    row = base.where(F.col("pred").isNotNull() & ~F.isnan("pred")).drop("pred").limit(1)
    kind = base.schema[column].dataType
    grid = row.withColumn("_at", F.explode(F.sequence(F.lit(0), F.lit(len(points) - 1))))
    values = F.array(*[F.lit(p).cast(kind) for p in points])
    scored = model.transform(grid.withColumn(column, F.get(values, F.col("_at")))).select("_at", "pred").orderBy("_at").collect()
    return [r.pred - scored[0].pred for r in scored] if len(scored) == len(points) else None


def sweep(df: DataFrame, column: str, values: Column, model: Model | None = None, additive: bool | None = None) -> DataFrame:
    """Each row repeated with every value of one feature, with `pred` if a model is given.

    Where the prediction is a sum over columns (`additive`; default: as `by_columns` tells), a row is scored
    once, at the first value, and every other value adds what it adds to any row. Otherwise the repeated rows
    are scored where they lie. A grid is a constant array.
    """
    kind = df.schema[column].dataType.simpleString()
    repeated = df.withColumn(column, F.explode(values.cast(f"array<{kind}>")))
    if model is None:
        return repeated
    if by_columns(model) if additive is None else additive:
        points = df.sparkSession.range(1).select(values.cast(f"array<{kind}>")).first()[0]
        if points and None not in points:
            base = model.transform(df.withColumn(column, F.lit(points[0]).cast(kind))).select(*df.columns, "pred")
            effects = _effects(base, column, points, model)
            if effects is not None:
                grid = F.array(*[F.struct(F.lit(p).cast(kind).alias("v"), F.lit(float(e)).alias("e")) for p, e in zip(points, effects)])
                spread = base.withColumn("_grid", F.explode(grid))
                return spread.select(*[F.col("_grid.v").alias(c) if c == column else F.col(c) for c in df.columns], (F.col("pred") + F.col("_grid.e")).alias("pred"))
    return model.transform(repeated).select(*df.columns, "pred")


def age_grid() -> Column:
    return F.sequence(F.lit(0), F.lit(2900), F.lit(100))


def january_grid(first: int = 2010, last: int = 2029) -> Column:
    return F.transform(F.sequence(F.lit(first), F.lit(last)), lambda y: F.make_date(y, F.lit(1), F.lit(1)))


def month_grid(year: int = 2022) -> Column:
    return F.transform(F.sequence(F.lit(1), F.lit(12)), lambda m: F.make_date(F.lit(year), m, F.lit(1)))


def partial_dependence(
    df: DataFrame, model: Model, columns: list[str], key: str, resolution: int = 10, sample: int | None = 10_000, seed: int = 42,
    additive: bool | None = None,
) -> DataFrame:
    """Mean prediction per grid point of one or more features, over a repeatable sample (None: over all rows).

    The grid runs evenly between the exact 5 % and 95 % quantiles. Where the prediction is a sum over columns
    (see `sweep`), rows are scored once and the grid points add their parts to the mean; otherwise each
    row is scored at each point, so keep the sample then. Columns without values give no rows.
    """
    edges = exact_quantiles(df, columns, [0.05, 0.95])
    if any(edge is None for pair in edges.values() for edge in pair):
        return df.sparkSession.createDataFrame([], ", ".join(f"`{c}` double" for c in columns) + ", mean_pred double")
    grids = {c: sorted({low + (high - low) * i / max(resolution - 1, 1) for i in range(resolution)}) for c, (low, high) in edges.items()}
    rows = df if sample is None else sample_n(df, key, sample, seed)
    rows = rows.withColumns({c: F.col(c).cast("double") for c in columns})
    if by_columns(model) if additive is None else additive:
        base = model.transform(rows.withColumns({c: F.lit(grids[c][0]) for c in columns})).select(*rows.columns, "pred")
        effects = {c: _effects(base, c, grids[c], model) for c in columns}
        if None not in effects.values():
            means = base.agg(F.avg("pred").alias("mean_pred"))  # one row, spread over the points of the grid
            for c in columns:
                points = [F.struct(F.lit(float(p)).alias("v"), F.lit(float(e)).alias("e")) for p, e in zip(grids[c], effects[c])]
                means = means.withColumn("_p", F.explode(F.array(*points)))
                means = means.withColumns({c: F.col("_p.v"), "mean_pred": F.col("mean_pred") + F.col("_p.e")}).drop("_p")
            return means.select(*columns, "mean_pred")
    for c in columns:
        rows = sweep(rows, c, F.array(*[F.lit(float(p)) for p in grids[c]]))
    return model.transform(rows).groupBy(*columns).agg(F.avg("pred").alias("mean_pred"))


def inspection_set(scored: DataFrame, target: str, pred: str = "pred") -> DataFrame:
    """Predictions with residuals beside the original columns (they travel in the same row)."""
    return scored.withColumn("resid", F.col(target) - F.col(pred))


def attach_predictions(df: DataFrame, predictions: DataFrame, key: str, name: str) -> DataFrame:
    return df.join(predictions.select(key, F.col("pred").alias(name)), key)


def coefficients(model, names: list[str], spark) -> DataFrame:
    """(feature, importance) of a linear model; as many rows as features."""
    values = [float(v) for v in model.coefficients]
    return spark.createDataFrame(list(zip(names, values)), "feature string, importance double")
