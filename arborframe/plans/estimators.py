"""Estimators on DataFrames: fit(df) and predict(df), with get_params and set_params, and as stages of pyspark.ml pipelines."""

from __future__ import annotations

from pyspark import keyword_only  # noqa: F401
from pyspark.ml import Estimator, Model
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import engine

_DEFAULTS = {
    "boosting_type": "gbdt", "num_leaves": 31, "max_depth": -1, "learning_rate": 0.1, "n_estimators": 100, "subsample_for_bin": 200000, "objective": None, "class_weight": None, "min_split_gain": 0.0, "min_child_weight": 1e-3,
    "min_child_samples": 20, "subsample": 1.0, "subsample_freq": 0, "colsample_bytree": 1.0, "reg_alpha": 0.0, "reg_lambda": 0.0, "random_state": None, "n_jobs": None, "importance_type": "split",
}


class TreeModel(Estimator):
    """Base: any objective."""

    _objective = "regression"

    def __init__(self, *, labelCol: str = "label", featuresCol: list[str] | None = None, weightCol: str | None = None, groupCol: str | None = None, initScoreCol: str | None = None, predictionCol: str = "prediction", **params):
        super().__init__()
        self.label, self.features, self.weight, self.group, self.init_score, self.prediction = labelCol, featuresCol, weightCol, groupCol, initScoreCol, predictionCol
        self._own = {**_DEFAULTS, **params}

    def get_params(self, deep: bool = True) -> dict:
        return dict(self._own)

    def set_params(self, **params) -> TreeModel:
        self._own.update(params)
        return self

    def _engine_params(self) -> dict:
        p = {k: v for k, v in self._own.items() if v is not None and k not in ("class_weight", "importance_type", "n_estimators")}
        p.setdefault("objective", self._objective)
        return p

    def _dataset(self, df: DataFrame, reference=None) -> engine.Dataset:
        roles = {"weight": self.weight, "group": self.group, "init_score": self.init_score}
        return engine.Dataset(df, self.label, reference=reference, feature_name=self.features or "auto", **roles)

    def _prepared(self, df: DataFrame) -> DataFrame:
        return df

    def fit(self, dataset: DataFrame, params=None, eval_set: list[DataFrame] | None = None, eval_names: list[str] | None = None, eval_metric=None, callbacks=None, init_model=None):
        if params:
            self.set_params(**params)
        df = self._prepared(dataset)
        p = self._engine_params()
        if callable(eval_metric):
            feval = eval_metric
        else:
            feval = None
            if eval_metric:
                p["metric"] = eval_metric
        train = self._dataset(df)
        valid = [self._dataset(self._prepared(v), train) for v in eval_set or []]
        history: dict = {}
        from .callbacks import record_evaluation

        self.booster_ = engine.train(p, train, self._own["n_estimators"], valid, eval_names, feval=feval, init_model=init_model, callbacks=[record_evaluation(history), *(callbacks or [])])
        self.evals_result_ = history
        return self._model()

    def _fit(self, dataset):
        return self.fit(dataset)

    def _model(self):
        return FittedModel(self.booster_, self)

    # properties of a fitted estimator
    n_features_ = property(lambda self: self.booster_.num_feature())
    n_features_in_ = n_features_
    best_score_ = property(lambda self: self.booster_.best_score)
    best_iteration_ = property(lambda self: self.booster_.best_iteration)
    objective_ = property(lambda self: self.booster_.params["objective"])
    n_estimators_ = property(lambda self: self.booster_.best_iteration if self.booster_.best_iteration > 0 else self.booster_.current_iteration())
    n_iter_ = n_estimators_
    feature_name_ = property(lambda self: self.booster_.feature_name())
    feature_names_in_ = feature_name_
    feature_importances_ = property(lambda self: self.booster_.feature_importance(self._own["importance_type"]))

    def predict(self, df: DataFrame, **kwargs) -> DataFrame:
        return self._model().predict(df, **kwargs)


class FittedModel(Model):
    def __init__(self, booster, estimator):
        super().__init__()
        self.booster, self.estimator = booster, estimator

    def predict(self, df: DataFrame, **kwargs) -> DataFrame:
        return self.booster.predict(df, prediction=self.estimator.prediction, **kwargs)

    def transform(self, dataset, params=None):
        return self._transform(dataset)

    def _transform(self, dataset):
        return self.predict(dataset)


class TreeRegressor(TreeModel):
    _objective = "regression"


class TreeRanker(TreeModel):
    _objective = "lambdarank"

    def fit(self, dataset, params=None, eval_at=(1, 2, 3, 4, 5), **kwargs):
        if not self.group:
            raise ValueError("ranking needs groupCol")
        self._own["eval_at"] = tuple(eval_at)
        return super().fit(dataset, params, **kwargs)


class TreeClassifier(TreeModel):
    """Labels of any type; classes_ holds them in order."""

    def _prepared(self, df: DataFrame) -> DataFrame:
        if not hasattr(self, "classes_"):
            self.classes_ = [r[0] for r in df.select(self.label).distinct().orderBy(self.label).limit(10_001).collect()]
            if len(self.classes_) > 10_000:
                raise ValueError("too many classes")
        self.n_classes_ = len(self.classes_)
        codes = F.create_map(*[x for i, c in enumerate(self.classes_) for x in (F.lit(c), F.lit(float(i)))])
        df = df.withColumn("_class", F.element_at(codes, F.col(self.label)))
        cw = self._own.get("class_weight")
        if cw is not None:
            if cw == "balanced":
                n = {r["_class"]: r["count"] for r in df.groupBy("_class").count().collect()}
                total = sum(n.values())
                cw = {self.classes_[int(k)]: total / (len(n) * v) for k, v in n.items()}
            w = F.coalesce(F.element_at(F.create_map(*[x for c, v in cw.items() for x in (F.lit(c), F.lit(float(v)))]), F.col(self.label)), F.lit(1.0))
            df = df.withColumn("_weight", w * (F.col(self.weight) if self._given_weight else F.lit(1.0)))
            self.weight = "_weight"
        return df

    def _dataset(self, df, reference=None):
        feats = self.features or [c for c, t in df.dtypes if c not in (self.label, "_class", "_weight", self.weight, self.init_score) and t in ("tinyint", "smallint", "int", "bigint", "float", "double", "boolean")]
        return engine.Dataset(df, "_class", reference=reference, weight=self.weight, init_score=self.init_score, feature_name=feats)

    def fit(self, dataset, params=None, **kwargs):
        self._given_weight = self.weight if self.weight != "_weight" else None
        if hasattr(self, "classes_"):
            del self.classes_
        return super().fit(dataset, params, **kwargs)

    def _engine_params(self):
        p = super()._engine_params()
        if self.n_classes_ > 2:
            p["objective"] = p["objective"] if p["objective"] in ("multiclass", "multiclassova") else "multiclass"
            p["num_class"] = self.n_classes_
        elif p["objective"] == "regression":
            p["objective"] = "binary"
        return p

    def _model(self):
        return FittedClassifier(self.booster_, self)

    def predict_proba(self, df, **kwargs):
        return self._model().predict_proba(df, **kwargs)

    def decision_function(self, df, **kwargs):
        return self.booster_.predict(df, raw_score=True, prediction="rawPrediction", **kwargs)


class FittedClassifier(FittedModel):
    def predict_proba(self, df: DataFrame, **kwargs) -> DataFrame:
        """df with probability: an array with a number for each class."""
        out = self.booster.predict(df, prediction="_p", **kwargs)
        p = F.col("_p") if self.booster.classes > 1 else F.array(1.0 - F.col("_p"), F.col("_p"))
        return out.withColumn("probability", p).drop("_p")

    def predict(self, df: DataFrame, **kwargs) -> DataFrame:
        if any(kwargs.get(k) for k in ("raw_score", "pred_leaf", "pred_contrib")):
            return super().predict(df, **kwargs)
        out = self.predict_proba(df, **kwargs)
        p = F.col("probability")
        best = F.array_position(p, F.array_max(p)).cast("int")
        names = F.array(*[F.lit(c) for c in self.estimator.classes_])
        return out.withColumn(self.estimator.prediction, F.element_at(names, best))
