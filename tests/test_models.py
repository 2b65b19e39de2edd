import re

import numpy as np
import pytest
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.regression import GBTRegressor, LinearRegression
from pyspark.ml.tuning import ParamGridBuilder
from pyspark.sql import functions as F

from marketloom.operators import aggregates, features, models, outliers
from marketloom.session import shared_folder

from .conftest import rows


@pytest.fixture
def priced(spark):
    rng = np.random.default_rng(1)
    data = [(i, float(a), float(b), 3.0 * float(a) - 2.0 * float(b) + 10 + float(e)) for i, (a, b, e) in enumerate(rng.normal(size=(400, 3)) * [10, 5, 0.1])]
    return spark.createDataFrame(data, "key long, a double, b double, target double").withColumn("split", features.split_column("key"))


def test_split_shares_and_stability(spark):
    df = spark.range(20_000).withColumnRenamed("id", "key")
    one = df.repartition(1).withColumn("split", features.split_column("key"))
    other = df.repartition(9).withColumn("split", features.split_column("key"))
    assert one.exceptAll(other).count() == 0
    share = {r.split: r["count"] / 20_000 for r in one.groupBy("split").count().collect()}
    assert share["train"] == pytest.approx(0.70, abs=0.02) and share["valid"] == pytest.approx(0.15, abs=0.02)


def test_tokens_follow_the_pattern(frame):
    """The first alternative stops at a dot, so numbers split in front of it."""
    df = frame([("Fork 27.5 x. End",)], "t string")
    assert df.select(features.tokens("t")).first()[0] == ["fork", "27", ".5", "x", ".", "end"]
    pairs = ["fork 27", "27 .5", ".5 x", "x .", ". end"]
    triples = ["fork 27 .5", "27 .5 x", ".5 x .", "x . end"]
    assert df.select(features.tokens("t", 2, 3)).first()[0] == pairs + triples


def test_tfidf_against_numpy(frame):
    texts = ["a b b c", "a c", "d", "", "b"]
    df = frame(list(enumerate(texts)), "k int, t string")
    got = {(r.k, r.term): r.weight for r in features.tfidf(df, "k", "t").collect()}
    docs = [t.split() for t in texts]
    for k, words in enumerate(docs):
        raw = {w: words.count(w) * (np.log((1 + len(docs)) / (1 + sum(w in d for d in docs))) + 1) for w in set(words)}
        norm = np.sqrt(sum(v * v for v in raw.values()))
        for w, v in raw.items():
            assert got.pop((k, w)) == pytest.approx(v / norm)
    assert not got
    assert {r.term for r in features.tfidf(df, "k", "t", max_features=1).collect()} == {"b"}


def test_tfidf_tasks_follow_the_size_of_the_texts(frame, monkeypatch):
    monkeypatch.setattr(features, "TEXT_BYTES_PER_TASK", 100, raising=False)
    df = frame([(i, "some words of text " * 5) for i in range(30)] + [(None, None)], "k int, t string")
    out = features.tfidf(df, "k", "t")
    assert re.search(r"hashpartitioning\(k#\d+, 29\)", out._jdf.queryExecution().executedPlan().toString())
    assert out.count() == 120


def test_target_encoding_shrinks(frame):
    df = frame([("x", 1.0), ("x", 3.0), ("y", 10.0), (None, 6.0)], "c string, t double")
    got = {r.c: r.encoding for r in features.target_encoding(df, "c", "t").collect()}
    var = np.var([1.0, 3.0, 10.0, 6.0])
    share = var * 2 / (var * 2 + 1.0)
    assert got["x"] == pytest.approx(share * 2.0 + (1 - share) * 5.0)
    assert got["y"] == pytest.approx(10.0)
    encoded = features.target_encode(frame([("x",), ("new",)], "c string"), features.target_encoding(df, "c", "t"), "c", 5.0, "e")
    assert dict(rows(encoded))["new"] == 5.0


def test_impute_and_scale(frame):
    df = frame([(1.0, -4.0, 0.0), (None, 2.0, 0.0), (3.0, None, 0.0), (float("nan"), 1.0, 0.0)], "a double, b double, z double")
    filled = features.impute(df, {"a": 2.0, "b": 1.0})
    assert [r.a for r in filled.collect()] == [1.0, 2.0, 3.0, 2.0]
    assert [r.b for r in features.max_abs_scale(filled, ["b", "z"]).collect()] == [-1.0, 0.5, 0.25, 0.25]


def test_grid_search_fits_on_train_only(priced):
    estimator = models.robust_linear(maxIter=30)
    stages = [*features.assemble_stages(["a", "b"]), estimator]
    grid = ParamGridBuilder().addGrid(estimator.regParam, [100.0, 0.0]).build()
    train, valid = priced.where("split = 'train'"), priced.where("split = 'valid'")
    results, best = models.grid_search(Pipeline(stages=stages), grid, train, valid)
    assert results[1][1] < results[0][1]
    assert aggregates.error_metrics(best.transform(valid), "target", "pred").first().rmse < 0.5


def test_boosting_beats_the_mean(priced):
    stages = [*features.assemble_stages(["a", "b"], scale=False), models.boosted_trees(maxIter=3)]
    model = models.fit(stages, priced.where("split = 'train'"))
    valid = priced.where("split = 'valid'")
    boosted = aggregates.error_metrics(models.score_batch(model, valid), "target", "pred").first().rmse
    base = aggregates.error_metrics(models.mean_baseline(priced, "target").where("split = 'valid'"), "target", "pred").first().rmse
    assert boosted < base


def test_iterative_fits_get_tasks_of_bounded_size(priced, monkeypatch):
    most = []

    def spy(kind):
        plain = kind._fit
        count = lambda df: most.append(max(r["count"] for r in df.groupBy(F.spark_partition_id()).count().collect()))
        monkeypatch.setattr(kind, "_fit", lambda self, df: count(df) or plain(self, df))

    monkeypatch.setattr(models, "ROWS_PER_TASK", 20, raising=False)
    spy(GBTRegressor)
    spy(LinearRegression)
    stages = features.assemble_stages(["a", "b"])
    model = models.fit([*stages, models.boosted_trees(maxIter=2)], priced.coalesce(1))
    assert model.transform(priced).where("pred is not null").count() == priced.count()
    linear = models.robust_linear()
    grid = ParamGridBuilder().addGrid(linear.regParam, [0.0, 1.0]).build()
    models.grid_search(Pipeline(stages=[*stages, linear]), grid, priced.coalesce(1), priced)
    models.grid_search(linear, grid, models.fit(stages, priced).transform(priced).coalesce(1), models.fit(stages, priced).transform(priced))
    assert len(most) == 5 and max(most) <= 40


def _cellular(spark, repeats):
    """Few distinct cells; `c` has more values than bins."""
    rng = np.random.default_rng(3)
    data = [(float(a), float(b) / 4, float(c), k) for a, b, c, k in zip(rng.integers(0, 9, 300), rng.integers(-3, 3, 300), np.round(rng.normal(size=300), 3), rng.choice(list("xyz"), 300))]
    rows_ = [(i * 300 + j, a, b, c, k, 3 * a - b * b + 5 * c + 7 * (k == "x") + float(rng.normal())) for i in range(repeats) for j, (a, b, c, k) in enumerate(data)]
    return spark.createDataFrame(rows_, "key long, a double, b double, c double, kind string, target double")


def test_boosted_trees_read_cells_and_predict_as_from_rows(spark, monkeypatch):
    fitted = []
    plain_fit = GBTRegressor._fit
    monkeypatch.setattr(GBTRegressor, "_fit", lambda self, df: fitted.append(df.count()) or plain_fit(self, df))
    df = _cellular(spark, 12)
    stages = [*features.one_hot_stages(["kind"]), *features.assemble_stages(["a", "b", "c", "kind_onehot"]), models.boosted_trees(maxIter=3)]
    rows_model = models.fit(stages, df)
    monkeypatch.setattr(models, "ROWS_PER_TASK", 100)
    cells_model = models.fit(stages, df)
    assert fitted[0] == 3600 and fitted[1] <= 300
    both = rows_model.transform(df).select("key", F.col("pred").alias("other")).join(cells_model.transform(df), "key").collect()
    assert len(both) == 3600 and [r.pred for r in both] == pytest.approx([r.other for r in both], abs=1e-9)
    at = cells_model.stages[-1]
    assert at.explainParams() == rows_model.stages[-1].explainParams() and at.uid == stages[-1].uid
    assert list(at.featureImportances) == pytest.approx(list(rows_model.stages[-1].featureImportances), abs=0.01)  # equal gains may go to another feature
    path = shared_folder(spark, "model")
    cells_model.write().save(path)
    assert PipelineModel.load(path).transform(df).exceptAll(cells_model.transform(df)).count() == 0


def test_boosted_trees_read_rows_where_cells_do_not_tell_all(spark, monkeypatch):
    fitted = []
    plain_fit = GBTRegressor._fit
    monkeypatch.setattr(GBTRegressor, "_fit", lambda self, df: fitted.append(df.count()) or plain_fit(self, df))
    monkeypatch.setattr(models, "ROWS_PER_TASK", 100)
    df = _cellular(spark, 2)
    numbers = features.assemble_stages(["a", "b", "c"])
    for params in ({"lossType": "absolute"}, {"subsamplingRate": 0.5}, {"minInstancesPerNode": 5}, {"weightCol": "b"}):
        models.fit([*numbers, models.boosted_trees(maxIter=1, **params)], df.withColumn("b", F.abs("b") + 1))
    coded = [*features.one_hot_stages(["kind"]), *features.assemble_stages(["a", "kind_onehot"], scale=False)]
    models.fit([*coded, models.boosted_trees(maxIter=1)], df)  # columns of 0 and 1 are categories there
    assert fitted == [600] * 5
    for odd in (df.withColumn("a", F.when(F.col("key") != 7, F.col("a"))), df.withColumn("target", F.when(F.col("key") != 7, F.col("target")))):
        with pytest.raises(Exception, match="(?i)nan"):
            models.fit([*numbers, models.boosted_trees(maxIter=1)], odd)


@pytest.mark.parametrize("most", [3, 31, 200])
def test_thresholds_are_those_of_spark(spark, most):
    from pyspark.ml.regression import DecisionTreeRegressor

    rng = np.random.default_rng(8)
    values = np.round(rng.normal(size=900), 1)
    df = spark.createDataFrame([(float(v), float(np.sin(40 * v))) for v in values], "a double, target double")
    rows_ = features.assemble_stages(["a"], scale=False)[0].transform(df)
    tree = DecisionTreeRegressor(labelCol="target", maxDepth=10, maxBins=most + 1).fit(rows_)
    used = {float(x) for x in re.findall(r"<= (\S+?)\)", tree.toDebugString)}
    found = models._thresholds(values, most)
    assert used and used <= {float(x) for x in found} and len(found) <= most


def test_sweep_and_partial_dependence(priced):
    model = models.fit([*features.assemble_stages(["a", "b"]), models.robust_linear()], priced)
    swept = models.sweep(priced.limit(2), "a", F.array(F.lit(0), F.lit(1)), model)
    by_row = {}
    for r in swept.collect():
        by_row.setdefault(r.key, {})[r.a] = r.pred
    assert all(v[1.0] - v[0.0] == pytest.approx(3.0, abs=0.1) for v in by_row.values())
    curve = models.partial_dependence(priced, model, ["a"], "key").orderBy("a").collect()
    assert len(curve) == 10 and curve[-1].mean_pred > curve[0].mean_pred


def test_sweep_by_effects_equals_scoring_every_row(priced):
    rows_with = priced.withColumn("kind", F.when(F.col("key") % 3 == 0, "x").when(F.col("key") % 3 == 1, "y").otherwise("z")).withColumn("target", F.col("target") + F.length("kind") * 2 + F.when(F.col("kind") == "y", 7).otherwise(0))
    stages = [*features.one_hot_stages(["kind"]), *features.assemble_stages(["a", "b", "kind_onehot"])]
    linear = models.fit([*stages, models.robust_linear()], rows_with)
    trees = models.fit([*stages, models.boosted_trees(maxIter=2)], rows_with)
    assert models.by_columns(linear) and not models.by_columns(trees)
    some = rows_with.where("key < 20").select("key", "kind", "a", "b")
    for column, grid in [("a", F.array(F.lit(-4.0), F.lit(0.0), F.lit(12.5))), ("kind", F.array(F.lit("z"), F.lit("x"), F.lit("new")))]:
        quick = models.sweep(some, column, grid, linear)
        plain = models.sweep(some, column, grid, linear, additive=False)
        assert quick.columns == plain.columns == ["key", "kind", "a", "b", "pred"] and quick.count() == 60
        order = ["key", "kind", "a", "b"]
        assert [r.pred for r in quick.orderBy(*order).collect()] == pytest.approx([r.pred for r in plain.orderBy(*order).collect()])
    assert models.sweep(some, "a", F.array(F.lit(0.0)), trees).count() == 20
    assert models.sweep(some.limit(0), "a", F.array(F.lit(0.0)), linear).count() == 0


def test_partial_dependence_by_effects(priced):
    linear = models.fit([*features.assemble_stages(["a", "b"]), models.robust_linear()], priced)
    for sample in (50, None):
        quick, plain = (models.partial_dependence(priced, linear, ["a", "b"], "key", 4, sample, additive=how).orderBy("a", "b").collect() for how in (None, False))
        assert len(quick) == 16 and [(r.a, r.b) for r in quick] == [(r.a, r.b) for r in plain]
        assert [r.mean_pred for r in quick] == pytest.approx([r.mean_pred for r in plain])
    assert models.partial_dependence(priced.limit(0), linear, ["a"], "key").count() == 0


def test_ridge_grid_equals_single_fits(priced):
    ready = models.fit(features.assemble_stages(["a", "b"], scale=False), priced).transform(priced)
    broken = ready.limit(1).withColumn("target", F.lit(float("nan"))).unionByName(ready.limit(1).withColumn("target", F.lit(None).cast("double")))
    results, weights = models.ridge_grid(ready.unionByName(broken).repartition(5), [0.0, 2.0, 50.0])
    assert [p for p, _ in results] == [0.0, 2.0, 50.0]
    train = np.array([(r.a, r.b, r.target) for r in ready.where("split = 'train'").collect()])
    x, y = train[:, :2], train[:, 2]
    centred = x - x.mean(axis=0)
    valid = ready.where("split = 'valid'")
    for penalty, rmse in results:
        slope = np.linalg.solve(centred.T @ centred / len(x) + penalty * np.eye(2), centred.T @ (y - y.mean()) / len(x))
        assert list(weights[penalty]) == pytest.approx([y.mean() - x.mean(axis=0) @ slope, *slope])
        ours = valid.withColumn("pred", models.linear_prediction(weights[penalty]))
        assert rmse == pytest.approx(aggregates.error_metrics(ours, "target", "pred").first().rmse, rel=1e-6)
    assert models.ridge_grid(ready.limit(0), [1.0]) == ([], {})
    assert models.ridge_grid(ready.where("split = 'train'"), [1.0])[0] == [(1.0, None)]


def test_saved_pipeline_scores_raw_listings(spark, frame):
    ads = frame([("2018 Trek", "d", "2020-05-01", "Calgary, Canada", 100.0), ("2015 Norco", "d", "2019-05-01", "Denver, United States", 300.0)], "ad_title string, description string, original_post_date string, location string, price_cpi_adjusted_CAD double")
    ads = ads.withColumn("original_post_date", F.col("original_post_date").cast("timestamp"))
    stages = [features.ListingFeatures(), *features.one_hot_stages(["post_month", "country"]), *features.assemble_stages(["age_at_post", "country_onehot"]), models.robust_linear()]
    path = shared_folder(spark, "model")
    models.fit(stages, ads).write().save(path)
    scored = models.score_batch(PipelineModel.load(path), ads.drop("price_cpi_adjusted_CAD"), "price_cpi_adjusted_CAD")
    assert scored.select("pred").na.drop().count() == 2


def test_isolation_forest_finds_the_odd_row(spark):
    rng = np.random.default_rng(0)
    data = [(i, *map(float, v)) for i, v in enumerate(rng.normal(size=(500, 2)))] + [(500, 30.0, -30.0)]
    df = spark.createDataFrame(data, "key long, a double, b double")
    out = outliers.outlier_scores(df, "key", ["a", "b"], trees=50, samples=64).cache()
    assert out.orderBy("outlier_score").first().key == 500
    flagged = out.where("outlier_flag = -1").count()
    assert 1 <= flagged <= 10
    again = outliers.outlier_scores(df.repartition(7), "key", ["a", "b"], trees=50, samples=64)
    assert rows(out.select("key", F.round("outlier_score", 9))) == rows(again.select("key", F.round("outlier_score", 9)))


def test_tree_samples_are_full_and_bounded(spark):
    df = spark.range(1000).withColumnRenamed("id", "key")
    sizes = [r["count"] for r in outliers.tree_samples(df, "key", 20, 100).groupBy("tree").count().collect()]
    assert len(sizes) == 20 and max(sizes) <= 100 and min(sizes) > 80


def test_trees_of_a_forest_end_where_their_rows_end():
    rng = np.random.default_rng(1)
    data = np.round(rng.normal(size=(300, 3)), 1)
    data[:40] = 0.5  # equal rows cannot be parted
    feature, lower, cut = outliers._grow_tree(data, 6, np.random.default_rng(2))

    ends, depths = [], []
    for row in data:
        node, depth = 0, 0
        while feature[node] >= 0:
            node, depth = int(lower[node] + (row[feature[node]] > cut[node])), depth + 1
        ends.append(node)
        depths.append(depth)
    assert set(ends) == set(np.flatnonzero(feature < 0)) and max(depths) <= 6
    counts = {node: ends.count(node) for node in set(ends)}
    for node, depth in zip(ends, depths):
        assert cut[node] == pytest.approx(depth + float(outliers._path_length(counts[node])))
    walked = outliers._path_sums(data, [(feature, lower, cut)] * 2)
    assert walked == pytest.approx([2 * cut[node] for node in ends])


def test_forest_in_groups_equals_forest_in_one_place(spark, monkeypatch):
    monkeypatch.setattr(outliers, "BLOCKS_PER_SLOT", 1)  # some slots get no block
    rng = np.random.default_rng(3)
    data = [(i, *map(float, v), "x") for i, v in enumerate(rng.normal(size=(400, 2)))]
    data += [(400, 25.0, -25.0, "odd"), (400, 25.0, -25.0, "odd"), (401, None, float("nan"), None), (402, float("inf"), float("-inf"), "far")]
    df = spark.createDataFrame(data, "key long, a double, b double, block string").repartition(9)
    whole = outliers.outlier_scores(df, "key", ["a", "b"], trees=30, samples=100)
    parted = outliers.outlier_scores(df, "key", ["a", "b"], trees=30, samples=100, group_bytes=4 * 2 * 100 * 14)
    assert whole.columns == parted.columns == [*df.columns, "outlier_score", "outlier_flag"]
    picked = lambda out: rows(out.select("key", "block", F.round("outlier_score", 9), "outlier_flag"))
    assert picked(whole) == picked(parted) and whole.count() == 404
    odd = {r.key for r in parted.orderBy("outlier_score").limit(3).collect()}
    assert odd == {400, 402}


def test_forest_groups_are_bounded(spark):
    df = spark.range(300).select("id", F.rand(1).alias("a"))
    forest = outliers.grow(outliers.tree_samples(df, "id", 12, 50), ["a"], 50)
    groups = outliers.tree_groups(forest, 50, 5 * 2 * 50 * 14).collect()
    assert sorted((g.group, [t.tree for t in g.trees]) for g in groups) == [(0, [0, 1, 2, 3, 4]), (1, [5, 6, 7, 8, 9]), (2, [10, 11])]
    assert all(sum(len(t.feature) + len(t.lower) + len(t.cut) for t in g.trees) <= 5 * 2 * 50 * 14 for g in groups)


def test_outliers_of_an_empty_table(spark):
    out = outliers.outlier_scores(spark.createDataFrame([], "key long, a double"), "key", ["a"], trees=3, samples=8)
    assert out.count() == 0 and out.columns == ["key", "a", "outlier_score", "outlier_flag"]


def test_fits_read_their_rows_once(frame, monkeypatch):
    """The rows of a fit are written once, with the columns that its stages read; so is the output of stages outside a grid."""
    written = []
    monkeypatch.setattr(models, "materialize", lambda df, purpose: written.append((purpose, df.columns)) or df.localCheckpoint())
    df = frame([(i, str(i), "ab"[i % 2], float(i), 2.0 * i + i % 2) for i in range(40)], "k int, note string, c string, x double, target double")
    linear = models.least_squares()
    stages = [*features.one_hot_stages(["c"]), *features.assemble_stages(["x", "c_onehot"]), linear]
    models.fit(stages, df)
    assert written == [("train", ["c", "x", "target"])]
    written.clear()
    grid = ParamGridBuilder().addGrid(linear.regParam, [0.0, 10.0]).build()
    results, best = models.grid_search(Pipeline(stages=stages), grid, df.where("k < 30"), df.where("k >= 30"))
    assert [purpose for purpose, _ in written] == ["train", "train", "valid"] and len(best.stages) == len(stages)
    assert results[0][1] < 1e-6 < results[1][1] and best.transform(df).count() == 40


def test_path_sums_walk_all_trees_alike(monkeypatch):
    monkeypatch.setattr(outliers, "ROWS_IN_CACHE", 7)
    rng = np.random.default_rng(4)
    data = rng.normal(size=(50, 3))
    trees = [outliers._grow_tree(rng.normal(size=(n, 3)), 5, rng) for n in (1, 2, 40)]

    def walk(row, tree):
        at, (feature, lower, cut) = 0, tree
        while feature[at] >= 0:
            at = lower[at] + int(row[feature[at]] > cut[at])
        return cut[at]

    assert outliers._path_sums(data, trees).tolist() == [walk(r, trees[0]) + walk(r, trees[1]) + walk(r, trees[2]) for r in data]
