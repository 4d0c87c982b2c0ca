"""Scoring: small models become expressions (which also run in Structured Streaming), larger ones are applied to Arrow batches."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import objectives
from ..operators import losses
from ..operators.binning import ZERO

#: Nodes up to which a model is compiled into expressions.
COMPILED = 150


def _raw(booster, trees, names):
    """One expression per class: the sum of its trees."""
    out = []
    for k in range(booster.classes):
        own = [t.column(names) for c, t in trees if c == k]
        total = sum(own, F.lit(0.0))
        if booster.average_output and own:
            total = total / len(own)
        out.append(total)
    return out


def _check(booster, data: DataFrame) -> None:
    missing = [f for f in booster.features if f not in data.columns]
    if missing:
        raise ValueError(f"the model needs columns {missing[:5]}")


def predict(booster, data: DataFrame, *args, prediction="prediction", validate_features=False, **kwargs) -> DataFrame:
    """data with the prediction as a further column; see `_predict`. With predict_disable_shape_check a column that isn't there counts as 0."""
    given = [c for c in data.columns if c != prediction]
    if validate_features or not {**booster.params, **kwargs}.get("predict_disable_shape_check"):
        _check(booster, data)
    data = data.withColumns({f: F.lit(0.0) for f in booster.features if f not in data.columns})
    return _predict(booster, data, *args, prediction=prediction, **kwargs).select(*[F.col(f"`{c}`") for c in given], prediction)


def _predict(booster, data: DataFrame, start_iteration=0, num_iteration=None, raw_score=False, pred_leaf=False, pred_contrib=False, prediction="prediction", sparse_contrib=False, compiled: bool | None = None, **kwargs) -> DataFrame:
    """Contributions beat leaves, leaves beat raw scores. Null and NaN are missing values."""
    p = {**booster.params, **kwargs}
    trees = booster._window(start_iteration, num_iteration)
    names, classes, objective = booster.features, booster.classes, booster.objective
    scalars = {k: v for k, v in p.items() if k in ("sigmoid", "reg_sqrt")}
    early = p.get("pred_early_stop") and not pred_leaf and not pred_contrib and objective in ("binary", "multiclass", "multiclassova", "lambdarank", "rank_xendcg")
    nodes = sum(len(t.feature) for _, t in trees)
    if compiled is None:
        compiled = nodes <= COMPILED and not any(t.linear for _, t in trees)
    if compiled and not pred_contrib and not early:
        if pred_leaf:
            return data.withColumn(prediction, F.array(*[t.column(names, "leaf").cast("int") for _, t in trees]))
        raw = [F.when(F.abs(x) <= ZERO, 0.0).otherwise(x) for x in _raw(booster, trees, names)]
        score = raw[0] if classes == 1 else F.array(*raw)
        if not raw_score and objective not in ("custom", "lambdarank", "rank_xendcg"):
            score = objectives.transform(objective, score, **scalars)
        return data.withColumn(prediction, score)
    if pred_contrib and any(t.linear for _, t in trees):
        raise ValueError("contributions of linear trees are not supported")
    average = booster.average_output
    types = dict(data.dtypes)
    kind = "map<int,double>" if pred_contrib and sparse_contrib else "array<double>" if pred_contrib or (classes > 1 and not pred_leaf) else "array<int>" if pred_leaf else "double"
    margin, freq = float(p.get("pred_early_stop_margin", 10.0)), int(p.get("pred_early_stop_freq", 10))
    width = len(names)

    def run(batches):
        for batch in batches:
            cols = []
            for f in names:
                c = batch.column(batch.schema.get_field_index(f))
                cols.append(np.asarray(c.cast(pa.float64()).fill_null(float("nan")), np.float64))
            x = np.stack(cols, axis=1) if cols else np.zeros((batch.num_rows, 0))
            n = len(x)
            if pred_contrib:
                out = np.zeros((classes, n, width + 1))
                for k, t in trees:
                    t.contributions(x, out[k])
                if average and trees:
                    out /= len(trees) / classes
                flat = out.transpose(1, 0, 2).reshape(n, -1)
                if sparse_contrib:
                    got = pa.array([[(j, v) for j, v in enumerate(r.tolist()) if v != 0 or j % (width + 1) == width] for r in flat], pa.map_(pa.int32(), pa.float64()))
                else:
                    got = pa.array(flat.tolist(), pa.list_(pa.float64()))
            elif pred_leaf:
                leaves = [t.leaf_of_raw(x) for _, t in trees]
                got = pa.array(np.stack(leaves, axis=1).tolist() if leaves else [[]] * n, pa.list_(pa.int32()))
            else:
                s = np.zeros((classes, n))
                live = np.arange(n)
                for i, (k, t) in enumerate(trees):
                    own = x if len(live) == n else x[live]
                    s[k, live] += t.outputs(t.leaf_of_raw(own), own)
                    if early and k == classes - 1 and (i // classes + 1) % freq == 0:
                        if classes == 1:
                            far = 2 * np.abs(s[0, live]) > margin
                        else:
                            two = np.sort(s[:, live], axis=0)[-2:]
                            far = two[1] - two[0] > margin
                        live = live[~far]
                        if not len(live):
                            break
                if average and trees:
                    s /= len(trees) / classes
                s[np.abs(s) <= ZERO] = 0.0
                if not raw_score and objective not in ("custom", "lambdarank", "rank_xendcg"):
                    s = losses.output(objective, s, scalars)
                got = pa.array(s[0]) if classes == 1 else pa.array(s.T.tolist(), pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([*batch.columns, got], [*batch.schema.names, prediction])

    data = data.drop(prediction)
    schema = ", ".join(f"`{c}` {types[c]}" for c in data.columns) + f", `{prediction}` {kind}"
    return data.mapInArrow(run, schema)


def predict_file(booster, spark, source: str, target: str, header: bool = False, **kwargs) -> None:
    """Scores of a text file's rows as tab-separated text; with a header, columns are matched by name."""
    from ..sources import text

    rows = text.read(spark, source, header=header, label=kwargs.pop("label_column", None), names=None if header else booster.features, num_features=len(booster.features))
    out = predict(booster, rows.drop("label") if "label" not in booster.features else rows, **kwargs)
    t = dict(out.dtypes)["prediction"]
    one = F.col("prediction").cast("string") if t == "double" else F.array_join(F.transform("prediction", lambda v: v.cast("string")), "\t")
    out.select(one.alias("value")).write.mode("error").text(target)
