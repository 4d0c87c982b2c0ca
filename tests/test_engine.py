"""Whole training runs: invariants and round trips on small synthetic rows."""

import copy
import math
import pickle

import numpy as np
import pytest
from pyspark.sql import functions as F

import arborframe as A
from arborframe.functions import metrics, objectives
from arborframe.operators import binning, losses, splits
from arborframe.operators.sampling import Lcg, Mersenne, jump
from arborframe.sources.matrix import from_dense

N = 1500


def arrays(seed=0):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(N, 5))
    x[:, 0] = np.round(x[:, 0], 1)
    x[rng.random(N) < 0.1, 1] = np.nan
    x[rng.random(N) < 0.3, 2] = 0.0
    x[:, 3] = rng.integers(0, 12, N)
    f = 2 * np.tanh(x[:, 0]) + 0.5 * np.nan_to_num(x[:, 1]) + (x[:, 3] % 3 == 1) - 0.3 * x[:, 2] * (x[:, 0] > 0)
    return x, f + rng.normal(0, 0.3, N)


@pytest.fixture(scope="module")
def frame(spark):
    x, y = arrays()
    names = [f"f{i}" for i in range(5)]
    rng = np.random.default_rng(1)
    df = from_dense(spark, x, names, y=y, b=(y > 0).astype(float), k=np.digitize(y, [-0.7, 0.9]).astype(float), w=rng.uniform(0.2, 3, N), q=np.arange(N) // 20, rel=np.digitize(y, [-1, 0, 1]).astype(float), pos=np.arange(N) % 5, id=np.arange(N)).repartition(3).cache()
    df.count()
    return df


FEATS = [f"f{i}" for i in range(5)]


def fit(df, params, label="y", rounds=5, **roles):
    return A.train({"num_leaves": 8, "min_data_in_leaf": 10, "verbosity": -1, **params}, A.Dataset(df, label, feature_name=FEATS, **roles), rounds)


def trees(b):
    return [(t.feature, t.threshold, t.left, t.right, t.count, np.round(t.value, 9).tolist()) for t in b.trees]


def test_regression_learns_and_round_trips(frame, tmp_path):
    b = fit(frame, {"categorical_feature": ["f3"]}, rounds=20)
    mse = b.predict(frame).agg(F.avg((F.col("prediction") - F.col("y")) ** 2)).first()[0]
    var = frame.agg(F.var_pop("y")).first()[0]
    assert mse < 0.45 * var
    path = str(tmp_path / "m.txt")
    b.save_model(path)
    again = A.Booster(model_file=path)
    rows = frame.select("id", *FEATS)
    want = {r.id: r.prediction for r in b.predict(rows).collect()}
    for c in (again, pickle.loads(pickle.dumps(b)), copy.deepcopy(b)):
        for compiled in (True, False):
            for r in c.predict(rows, compiled=compiled).collect():
                assert math.isclose(r.prediction, want[r.id], rel_tol=1e-9, abs_tol=1e-12)


def test_trees_do_not_depend_on_partitions(frame):
    first = trees(fit(frame.coalesce(1), {}))
    assert trees(fit(frame.repartition(7), {})) == first


def test_shapley_values_sum_to_the_prediction(frame):
    b = fit(frame, {"categorical_feature": ["f3"]})
    rows = b.predict(b.predict(frame.limit(100), pred_contrib=True, prediction="c"), raw_score=True).collect()
    for r in rows:
        assert math.isclose(sum(r.c), r.prediction, rel_tol=1e-9, abs_tol=1e-9)


def test_mersenne_twister():
    assert Mersenne(5489).words(10_000)[-1] == 4123659995  # the number that the C++ standard names
    a, b = Mersenne(7).words(2000).astype(object), Mersenne(7).uniform(1000)
    assert [float((low + high * 2**32) / 2**64) for low, high in zip(a[::2], a[1::2], strict=True)] == pytest.approx(list(b), abs=1e-15)
    assert 0.0 <= b.min() and b.max() < 1.0 and abs(b.mean() - 0.5) < 0.03


@pytest.mark.parametrize("objective,label", [("binary", "b"), ("regression_l1", "y"), ("huber", "y"), ("fair", "y"), ("quantile", "y"), ("cross_entropy", "b"), ("mape", "y")])
def test_objectives_improve(frame, objective, label):
    hist = {}
    d = A.Dataset(frame, label, feature_name=FEATS)
    b = A.train({"objective": objective, "num_leaves": 6, "is_provide_training_metric": True}, d, 6, callbacks=[A.record_evaluation(hist)])
    values = next(iter(hist["training"].values()))
    assert values[-1] < values[0] and b.num_trees() == 6


def test_multiclass_and_estimator(frame):
    m = A.TreeClassifier(labelCol="k", featuresCol=FEATS, n_estimators=5, num_leaves=6).fit(frame)
    out = m.predict(frame)
    assert out.where("prediction = k").count() > 0.6 * N
    assert all(abs(sum(r.probability) - 1) < 1e-9 for r in out.limit(20).collect())


def test_string_labels_and_pipeline(frame):
    from pyspark.ml import Pipeline

    df = frame.withColumn("name", F.when(F.col("b") > 0, "yes").otherwise("no"))
    model = Pipeline(stages=[A.TreeClassifier(labelCol="name", featuresCol=FEATS, n_estimators=5, class_weight="balanced")]).fit(df)
    assert model.transform(df).where("prediction = name").count() > 0.75 * N


def test_ranking(frame):
    hist = {}
    d = A.Dataset(frame, "rel", feature_name=FEATS, group="q", position="pos")
    A.train({"objective": "lambdarank", "num_leaves": 6, "eval_at": (5,), "is_provide_training_metric": True}, d, 5, callbacks=[A.record_evaluation(hist)])
    values = hist["training"]["ndcg@5"]
    assert values[-1] > values[0] or values[-1] > 0.8
    assert A.TreeRanker(labelCol="rel", featuresCol=FEATS, groupCol="q", n_estimators=2).fit(frame).predict(frame).count() == N


@pytest.mark.parametrize("params", [{"boosting": "dart", "skip_drop": 0.0, "drop_rate": 0.5}, {"boosting": "rf", "bagging_freq": 1, "bagging_fraction": 0.6}, {"data_sample_strategy": "goss", "learning_rate": 0.5}, {"linear_tree": True}, {"use_quantized_grad": True, "quant_train_renew_leaf": True}, {"extra_trees": True, "feature_fraction": 0.8, "feature_fraction_bynode": 0.8}, {"path_smooth": 5.0, "max_delta_step": 1.0}, {"cegb_penalty_split": 1e-6, "cegb_penalty_feature_coupled": [0.1] * 5}])
def test_variants_agree_with_their_training_scores(frame, params):
    """The score that training kept for each row is what the model predicts."""
    d = A.Dataset(frame, "y", feature_name=FEATS)
    b = A.train({"num_leaves": 8, "metric": "l2", "is_provide_training_metric": True, **params}, d, 12, keep_training_booster=True)
    kept = b.eval_train()[0].value
    mse = b.predict(frame, raw_score=True).agg(F.avg((F.col("prediction") - F.col("y").cast("float")) ** 2)).first()[0]
    assert math.isclose(kept, mse, rel_tol=1e-4)
    b.free_dataset()


@pytest.mark.parametrize("params", [{}, {"uniform_drop": True}, {"max_drop": 2}, {"xgboost_dart_mode": True, "skip_drop": 0.3}])
def test_dart_draws_by_weight(frame, params):
    """The weighted dropping rule and its weights, written out."""
    p = {"skip_drop": 0.0, "drop_rate": 0.5, "max_drop": 50, "uniform_drop": False, "xgboost_dart_mode": False, **params}
    b = A.train({"boosting": "dart", "num_leaves": 4, "learning_rate": 0.3, **p}, A.Dataset(frame, "y", feature_name=FEATS), 1, keep_training_booster=True)
    rng, weights, total, drops = Lcg(4), [], 0.0, []
    for it in range(10):
        if it:
            b.update()
        drop = []
        if rng.next_float() >= p["skip_drop"]:
            mean = len(weights) / total if weights else 0.0
            rate = p["drop_rate"]
            if weights:
                rate = min(rate, p["max_drop"] / it if p["uniform_drop"] else p["max_drop"] * mean / total)
            for i in range(it):
                if rng.next_float() < (rate if p["uniform_drop"] else rate * weights[i] * mean):
                    drop.append(i)
                    if len(drop) >= p["max_drop"]:
                        break
        k = len(drop)
        den = k + (0.3 if p["xgboost_dart_mode"] else 1.0)
        for i in drop:
            total -= weights[i] / den
            weights[i] *= k / den
        weights.append(0.3 / den if k else 0.3)
        total += weights[-1]
        drops.append(drop)
        assert b._dropped_iterations == drop
    assert any(drops)
    b.free_dataset()


def test_monotone_predictions(spark, frame):
    b = fit(frame, {"monotone_constraints": [1, 0, 0, 0, 0]}, rounds=8)
    grid = from_dense(spark, np.column_stack([np.linspace(-3, 3, 50), *[np.zeros(50)] * 4]), FEATS)
    p = [r.prediction for r in b.predict(grid).orderBy("f0").collect()]
    assert all(x <= y + 1e-12 for x, y in zip(p, p[1:]))


def test_interaction_sets(frame):
    b = fit(frame, {"interaction_constraints": [["f0", "f1"], ["f2", "f3", "f4"]]})
    for t in b.trees:
        def walk(i, path):
            if i < 0:
                assert path <= {0, 1} or path <= {2, 3, 4}
                return
            walk(t.left[i], path | {t.feature[i]})
            walk(t.right[i], path | {t.feature[i]})

        walk(0, set())


def test_forced_splits(frame, tmp_path):
    p = tmp_path / "f.json"
    p.write_text('{"feature": 4, "threshold": 0.0, "left": {"feature": 0, "threshold": 0.5}}')
    t = fit(frame, {"forcedsplits_filename": str(p)}, rounds=1).trees[0]
    assert t.feature[0] == 4 and 0 in t.feature


def test_early_stopping_continuation_and_rollback(frame):
    tr, va = frame.where("id % 3 <> 0"), frame.where("id % 3 = 0")
    d = A.Dataset(tr, "y", feature_name=FEATS)
    b = A.train({"num_leaves": 31, "min_data_in_leaf": 3, "learning_rate": 0.9}, d, 25, valid_sets=[d.create_valid(va)], callbacks=[A.early_stopping(2)])
    assert 0 < b.best_iteration < 25
    more = A.train({"num_leaves": 8}, A.Dataset(tr, "y", feature_name=FEATS), 2, init_model=b)
    assert more.num_trees() == b.num_trees() + 2
    d2 = A.Dataset(tr, "y", feature_name=FEATS)
    c = A.train({"num_leaves": 8, "metric": "l2", "is_provide_training_metric": True}, d2, 3, keep_training_booster=True)
    before = c.eval_train()[0].value
    c.update()
    c.rollback_one_iter()
    assert math.isclose(c.eval_train()[0].value, before, rel_tol=1e-9)


def test_cv_refit_and_custom_objective(frame):
    h = A.cv({"objective": "binary", "num_leaves": 6}, A.Dataset(frame, "b", feature_name=FEATS), 3, nfold=3)
    assert len(h["valid binary_logloss-mean"]) == 3 and h["valid binary_logloss-mean"][-1] < h["valid binary_logloss-mean"][0]
    b = fit(frame, {})
    assert b.refit(frame, "y").num_trees() == b.num_trees()

    def squared(score, label, weight, bounds):
        return score - label, np.ones_like(score)

    own = fit(frame, {"objective": squared, "metric": "l2"})
    same = fit(frame, {"objective": "regression", "boost_from_average": False})
    assert [t.feature for t in own.trees] == [t.feature for t in same.trees]


def test_weights_equal_repeated_rows(frame):
    twice = frame.unionAll(frame)
    a = fit(frame.withColumn("two", F.lit(2.0)), {"min_data_in_leaf": 1, "min_sum_hessian_in_leaf": 20}, weight="two")
    b = fit(twice, {"min_data_in_leaf": 1, "min_sum_hessian_in_leaf": 20})
    assert [t.feature for t in a.trees] == [t.feature for t in b.trees]


def test_dataset_fields_and_persistence(spark, frame, tmp_path):
    d = A.Dataset(frame, "y", weight="w", feature_name=FEATS)
    assert d.num_data() == N and d.num_feature() == 5 and d.feature_num_bin("f3") >= 12
    assert d.get_label().columns == ["y"] and d.get_weight().columns == ["w"] and d.get_init_score() is None
    assert d.binned().count() == N
    d.save_binary(str(tmp_path / "d"))
    again = A.Dataset.load_binary(spark, str(tmp_path / "d"))
    assert trees(A.train({"num_leaves": 6}, again, 2)) == trees(A.train({"num_leaves": 6}, A.Dataset(frame, "y", weight="w", feature_name=FEATS), 2))
    with pytest.raises(Exception):
        d.save_binary(str(tmp_path / "d"))
    sub = d.subset(frame.where("id < 100").select("id"), "id")
    assert sub.num_data() == 100 and sub.reference is d
    with pytest.raises(ValueError):
        d.add_features_from(sub)


def test_model_tables_and_plots(spark, frame):
    b = fit(frame, {"categorical_feature": ["f3"]})
    t = b.trees_to_dataframe()
    assert len(t) == sum(2 * x.leaves - 1 for x in b.trees)
    assert b.trees_to_dataframe(spark).count() == len(t)
    j = b.dump_model()
    assert len(j["tree_info"]) == 5 and b.feature_importance().sum() == sum(len(x.feature) for x in b.trees)
    from arborframe.plans import plotting

    dot = plotting.create_tree_digraph(b, 0, ("internal_count", "leaf_count"), {"f0": 1.0})
    assert dot.startswith("digraph") and "penwidth" in dot
    assert plotting.importance_data(b)
    hist, edges = b.get_split_value_histogram("f0")
    assert hist.sum() > 0 and b.lower_bound() < b.upper_bound()


def test_empty_and_degenerate(spark, frame):
    one = frame.where("id < 30").withColumn("c", F.lit(3.0))
    b = A.train({}, A.Dataset(one, "c", feature_name=FEATS), 3)
    assert abs(b.predict(one).first().prediction - 3.0) < 1e-9
    nul = frame.withColumn("f0", F.lit(None).cast("double"))
    assert fit(nul, {}, rounds=1).predict(nul).where("prediction is null").count() == 0


def test_parameters():
    from arborframe.plans.config import resolve

    assert resolve({"eta": 0.3, "learning_rate": 0.2})["learning_rate"] == 0.2
    assert resolve({"max_depth": 3})["num_leaves"] == 8
    for bad in ({"num_leaves": 1}, {"objective": "nope"}, {"objective": "multiclass"}, {"boosting": "rf"}, {"machines": "x"}, {"bagging_fraction": 2}):
        with pytest.raises(ValueError):
            resolve(bad)
    assert resolve({"seed": 7})["bagging_seed"] != 3


def test_generator_jump():
    r = Lcg(12345)
    for k in range(1, 50):
        r._next()
        a, c = jump(k)
        assert (a * 12345 + c) % 2**32 == r.x
    s = Lcg(5).sample(100, 30)
    assert s == sorted(set(s)) and len(s) == 30 and len(Lcg(5).sample(1000, 3)) == 3


def test_bins_cover_values():
    rng = np.random.default_rng(3)
    for v in (rng.normal(size=5000), rng.standard_cauchy(5000), rng.integers(0, 6, 5000).astype(float), np.where(rng.random(5000) < 0.2, np.nan, rng.normal(size=5000)), np.zeros(10)):
        m = binning.find_mapper(0, "f", v, len(v), max_bin=63, pre_filter=False)
        assert m.num_bin <= 63
        if m.bounds:
            b = m.bins(v)
            assert b.min() >= 0 and b.max() < m.num_bin
            ok = ~np.isnan(v)
            order = np.argsort(v[ok])
            assert (np.diff(b[ok][order]) >= 0).all()


def test_bin_sample_keeps_values(spark):
    """A sample of rows, not of values: few values all stay, in about their shares."""
    df = spark.range(300_000).selectExpr("cast(id % 50 as double) as a", "cast(if(id % 3 = 0, null, id % 7) as double) as b", "id % 5 as k")
    a, b, k = binning.find_mappers(df, ["a", "b", "k"], {"k"}, sample=20_000)
    assert len(a.bounds) == 50 and len(b.bounds) == 7 and b.missing == "nan" and sorted(k.cats) == [0, 1, 2, 3, 4]
    drawn = {r.f0: r["count"] for r in binning._sampled(df.select(F.col("a").alias("f0")), 1 / 15, 1).groupBy("f0").count().collect()}
    assert set(drawn) == set(map(float, range(50))) and all(300 < n < 500 for n in drawn.values())
    everything = binning.find_mappers(df, ["a", "b", "k"], {"k"}, sample=None)
    assert everything == binning.find_mappers(df, ["a", "b", "k"], {"k"}, sample=1_000_000) and everything[0].bounds == a.bounds


def test_other_names_and_unknown_ones():
    from arborframe.plans import config

    with pytest.warns(UserWarning, match="no_such_parameter"):
        p = config.resolve({"min_data": 5, "lambda": 3.0, "num_trees": 7, "sub_row": 0.5, "unbalance": True, "no_such_parameter": 1})
    assert (p["min_data_in_leaf"], p["lambda_l2"], p["num_iterations"], p["bagging_fraction"], p["is_unbalance"]) == (5, 3.0, 7, 0.5, True)
    with pytest.warns(UserWarning, match="basic"):
        config.resolve({"mc": [1], "mc_method": "advanced"})


def test_gains_and_weights_of_metrics(spark, frame):
    df = frame.select("q", "id", F.col("f0").alias("s"), "rel", "k", F.array("y", F.col("f0"), F.col("f2")).alias("v"))
    own = [0.0, 1.0, 3.0, 7.0]
    plain, given = ({r.k: r.value for r in metrics.ndcg(df, "q", "s", "rel", "id", gains=g).collect()} for g in (None, own))
    assert all(math.isclose(plain[k], given[k]) for k in plain)
    other = {r.k: r.value for r in metrics.ndcg(df, "q", "s", "rel", "id", gains=[0.0, 0.0, 0.0, 5.0]).collect()}
    assert other != plain
    m = [[0.0, 1.0, 2.0], [1.0, 0.0, 1.0], [2.0, 1.0, 0.0]]
    a, b = (metrics.auc_mu(df, "v", "k", 3, matrix=x).first().value for x in (m, sum(m, [])))
    assert a == b


def test_columns_that_are_not_there(frame):
    b = fit(frame, {}, rounds=2)
    with pytest.raises(ValueError):
        b.predict(frame.drop("f1"))
    got = b.predict(frame.drop("f1"), predict_disable_shape_check=True)
    assert got.columns == [*frame.drop("f1").columns, "prediction"]
    zero = b.predict(frame.withColumn("f1", F.lit(0.0)))
    assert got.select("id", "prediction").exceptAll(zero.select("id", "prediction")).count() == 0


def test_percentiles(spark):
    rng = np.random.default_rng(2)
    v, w, by = np.round(rng.normal(size=3000), 1), rng.uniform(0, 3, 3000), rng.integers(0, 3, 3000)
    df = spark.createDataFrame([(float(x), float(z), int(k), i) for i, (x, z, k) in enumerate(zip(v, w, by))] + [(float("nan"), 1.0, 0, -1), (None, 1.0, 0, -2)], "v double, w double, k int, id long").repartition(3)
    for alpha in (0.0, 0.3, 0.5, 0.9, 1.0):
        assert math.isclose(objectives.percentile(df, "v", alpha).first().result, np.quantile(v, alpha), abs_tol=1e-12)
        for r in objectives.percentile(df, "v", alpha, ["k"]).collect():
            assert math.isclose(r.result, np.quantile(v[by == r.k], alpha), abs_tol=1e-12)
    for alpha in (0.1, 0.5, 0.77):
        for r in objectives.weighted_percentile(df, "v", "w", alpha, ["k"], "id").collect():
            own = by == r.k
            order = np.lexsort((np.arange(3000)[own], v[own]))
            x, c = v[own][order], np.cumsum(w[own][order])
            i = int(np.searchsorted(c, alpha * c[-1], "right"))
            step = c[i] - c[i - 1]
            want = x[i - 1] + (alpha * c[-1] - c[i - 1]) / step * (x[i] - x[i - 1]) if step >= 1 else x[i - 1]
            assert math.isclose(r.result, want, abs_tol=1e-9)
    assert objectives.percentile(df.where("k > 5"), "v", 0.5).count() == 0


def test_split_matches_brute_force():
    rng = np.random.default_rng(4)
    m = binning.BinMapper(0, "f", bounds=[*range(9), math.inf], num_bin=10, trivial=False)
    for _ in range(50):
        h = np.stack([rng.normal(size=10), rng.uniform(0.5, 2, 10)], axis=1) * 10
        g, hh = h.sum(axis=0)
        s = splits.numeric_split(m, h, g, hh, 1000, splits.Rules(min_data=0, min_hessian=0), 0.0, g * g / hh)
        gains = [h[: t + 1, 0].sum() ** 2 / h[: t + 1, 1].sum() + h[t + 1 :, 0].sum() ** 2 / h[t + 1 :, 1].sum() for t in range(9)]
        assert s.bin == int(np.argmax(gains))


def test_gradients_by_finite_differences():
    s, e = np.linspace(-2, 2, 9), 1e-6
    y = np.linspace(0.1, 0.9, 9)
    for name, loss in {"regression": lambda s: (s - y) ** 2 / 2, "poisson": lambda s: np.exp(s) - y * s, "gamma": lambda s: y * np.exp(-s) + s, "cross_entropy": lambda s: np.log1p(np.exp(s)) - y * s}.items():
        g, _ = losses.pointwise(name, s, y, None, {})
        assert np.allclose(g, (loss(s + e) - loss(s - e)) / (2 * e), atol=1e-4)


def test_grouped_losses(frame):
    """The softmax of a group against its label shares; its gradient equals that of the listwise formula."""
    from arborframe.operators import grouped

    def listwise(s, y, w):
        p = np.exp(s - s.max())
        p /= p.sum()
        return p * y.sum() - y, (np.diag(p) - np.outer(p, p)) * y.sum()

    got = grouped.gradients(frame, "q", "id", "y", "rel", listwise).collect()
    assert len(got) == N and abs(sum(r.g for r in got)) < 1e-6 and all(r.h >= 0 for r in got)
    b = A.train({"objective": grouped.objective(listwise), "num_leaves": 4}, A.Dataset(frame, "rel", feature_name=FEATS, group="q"), 2)
    assert b.num_trees() == 2
    m = np.array([[2.0, -1.0], [-1.0, 2.0]])
    assert grouped.diagonal(m).tolist() == [2, 2] and grouped.diagonal(m, "gershgorin").tolist() == [3, 3]
    with pytest.raises(ValueError):
        grouped.diagonal(m, "exact")
