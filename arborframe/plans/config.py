"""Training parameters: names, defaults, checks and derived seeds."""

from __future__ import annotations

import warnings
from typing import Any

from ..functions import objectives
from ..operators.sampling import Lcg

DEFAULTS: dict[str, Any] = {
    # core
    "objective": "regression", "boosting": "gbdt", "num_iterations": 100, "learning_rate": 0.1, "num_leaves": 31, "max_depth": -1, "seed": None, "metric": None,
    # leaves and gains
    "min_data_in_leaf": 20, "min_sum_hessian_in_leaf": 1e-3, "lambda_l1": 0.0, "lambda_l2": 0.0, "min_gain_to_split": 0.0, "max_delta_step": 0.0, "path_smooth": 0.0, "feature_contri": None,
    "linear_tree": False, "linear_lambda": 0.0, "extra_trees": False,
    # bins
    "max_bin": 255, "max_bin_by_feature": None, "min_data_in_bin": 3, "bin_construct_sample_cnt": 200_000, "use_missing": True, "zero_as_missing": False, "feature_pre_filter": True, "forcedbins_filename": "", "data_random_seed": 1,
    # sampling
    "bagging_fraction": 1.0, "bagging_freq": 0, "pos_bagging_fraction": 1.0, "neg_bagging_fraction": 1.0, "bagging_by_query": False, "bagging_seed": 3, "data_sample_strategy": "bagging", "top_rate": 0.2, "other_rate": 0.1,
    "feature_fraction": 1.0, "feature_fraction_bynode": 1.0, "feature_fraction_seed": 2, "extra_seed": 6,
    # dart
    "drop_rate": 0.1, "max_drop": 50, "skip_drop": 0.5, "xgboost_dart_mode": False, "uniform_drop": False, "drop_seed": 4,
    # categories
    "categorical_feature": None, "max_cat_to_onehot": 4, "max_cat_threshold": 32, "cat_l2": 10.0, "cat_smooth": 10.0, "min_data_per_group": 100,
    # constraints
    "monotone_constraints": None, "monotone_constraints_method": "basic", "monotone_penalty": 0.0, "interaction_constraints": None, "forcedsplits_filename": "", "cegb_tradeoff": 1.0, "cegb_penalty_split": 0.0,
    "cegb_penalty_feature_lazy": None, "cegb_penalty_feature_coupled": None,
    # objective
    "sigmoid": 1.0, "is_unbalance": False, "scale_pos_weight": 1.0, "alpha": 0.9, "fair_c": 1.0, "poisson_max_delta_step": 0.7, "tweedie_variance_power": 1.5, "reg_sqrt": False, "boost_from_average": True, "num_class": 1,
    "objective_seed": 5, "label_gain": None, "lambdarank_truncation_level": 30, "lambdarank_norm": True, "lambdarank_position_bias_regularization": 0.0,
    # metric
    "eval_at": (1, 2, 3, 4, 5), "multi_error_top_k": 1, "auc_mu_weights": None, "first_metric_only": False, "early_stopping_round": 0, "early_stopping_min_delta": 0.0, "is_provide_training_metric": False,
    # quantised gradients
    "use_quantized_grad": False, "num_grad_quant_bins": 4, "quant_train_renew_leaf": False, "stochastic_rounding": True,
    # prediction
    "start_iteration_predict": 0, "num_iteration_predict": -1, "predict_raw_score": False, "predict_leaf_index": False, "predict_disable_shape_check": False, "pred_early_stop": False, "pred_early_stop_freq": 10,
    "pred_early_stop_margin": 10.0, "refit_decay_rate": 0.9,
    # files
    "header": False, "label_column": "", "weight_column": "", "group_column": "", "ignore_column": "", "two_round": False, "precise_float_parser": False,
    # no effect on results
    "num_threads": 0, "force_col_wise": False, "force_row_wise": False, "deterministic": False, "enable_bundle": True, "is_enable_sparse": True, "verbosity": 1,
}
#: The other names of each parameter.
_NAMES = {
    "objective": "objective_type app application loss", "boosting": "boosting_type boost", "num_iterations": "num_iteration n_iter num_tree num_trees num_round num_rounds nrounds num_boost_round n_estimators max_iter",
    "learning_rate": "shrinkage_rate eta", "num_leaves": "num_leaf max_leaves max_leaf max_leaf_nodes", "num_threads": "num_thread nthread nthreads n_jobs", "seed": "random_seed random_state",
    "min_data_in_leaf": "min_data_per_leaf min_data min_child_samples min_samples_leaf", "min_sum_hessian_in_leaf": "min_sum_hessian_per_leaf min_sum_hessian min_hessian min_child_weight",
    "bagging_fraction": "sub_row subsample bagging", "pos_bagging_fraction": "pos_sub_row pos_subsample pos_bagging", "neg_bagging_fraction": "neg_sub_row neg_subsample neg_bagging", "bagging_freq": "subsample_freq", "bagging_seed": "bagging_fraction_seed",
    "feature_fraction": "sub_feature colsample_bytree", "feature_fraction_bynode": "sub_feature_bynode colsample_bynode", "extra_trees": "extra_tree", "early_stopping_round": "early_stopping_rounds early_stopping n_iter_no_change",
    "max_delta_step": "max_tree_output max_leaf_output", "lambda_l1": "reg_alpha l1_regularization", "lambda_l2": "reg_lambda lambda l2_regularization", "min_gain_to_split": "min_split_gain", "drop_rate": "rate_drop",
    "monotone_constraints": "mc monotone_constraint monotonic_cst", "monotone_constraints_method": "monotone_constraining_method mc_method", "monotone_penalty": "monotone_splits_penalty ms_penalty mc_penalty",
    "feature_contri": "feature_contrib fc fp feature_penalty", "forcedsplits_filename": "fs forced_splits_filename forced_splits_file forced_splits", "verbosity": "verbose", "max_bin": "max_bins",
    "bin_construct_sample_cnt": "subsample_for_bin", "data_random_seed": "data_seed", "is_enable_sparse": "is_sparse enable_sparse sparse", "enable_bundle": "is_enable_bundle bundle", "two_round": "two_round_loading use_two_round_loading",
    "header": "has_header", "label_column": "label", "weight_column": "weight", "group_column": "group group_id query_column query query_id", "ignore_column": "ignore_feature blacklist",
    "categorical_feature": "cat_feature categorical_column cat_column categorical_features", "linear_tree": "linear_trees", "predict_raw_score": "is_predict_raw_score predict_rawscore raw_score",
    "predict_leaf_index": "is_predict_leaf_index leaf_index", "num_class": "num_classes", "is_unbalance": "unbalance unbalanced_sets", "metric": "metrics metric_types", "is_provide_training_metric": "training_metric is_training_metric train_metric",
    "eval_at": "ndcg_eval_at ndcg_at map_eval_at map_at",
}
ALIASES = {alias: name for name, others in _NAMES.items() for alias in others.split()}
DATASET = ("max_bin", "max_bin_by_feature", "min_data_in_bin", "bin_construct_sample_cnt", "use_missing", "zero_as_missing", "feature_pre_filter", "forcedbins_filename", "data_random_seed", "categorical_feature", "linear_tree")
_RANGES = {
    "num_leaves": (2, 131072), "learning_rate": (0.0, None), "min_data_in_leaf": (0, None), "min_sum_hessian_in_leaf": (0.0, None), "lambda_l1": (0.0, None), "lambda_l2": (0.0, None), "min_gain_to_split": (0.0, None),
    "bagging_fraction": (0.0, 1.0), "feature_fraction": (0.0, 1.0), "feature_fraction_bynode": (0.0, 1.0), "pos_bagging_fraction": (0.0, 1.0), "neg_bagging_fraction": (0.0, 1.0), "top_rate": (0.0, 1.0), "other_rate": (0.0, 1.0),
    "drop_rate": (0.0, 1.0), "skip_drop": (0.0, 1.0), "max_bin": (2, 65535), "min_data_in_bin": (1, None), "path_smooth": (0.0, None), "cat_smooth": (0.0, None), "cat_l2": (0.0, None), "max_cat_threshold": (1, None),
    "sigmoid": (1e-300, None), "alpha": (0.0, None), "fair_c": (0.0, None), "poisson_max_delta_step": (0.0, None), "tweedie_variance_power": (1.0, 2.0), "num_class": (1, None), "refit_decay_rate": (0.0, 1.0), "monotone_penalty": (0.0, None),
}
#: Names that estimators and datasets keep among the parameters.
_OWN = ("forced_bins", "class_weight", "positive_weight", "negative_weight", "importance_type")
_UNSUPPORTED = ("machines", "num_machines", "local_listen_port", "device_type", "gpu_platform_id")


def _typed(key: str, value: Any, default: Any) -> Any:
    if isinstance(default, bool):
        if isinstance(value, str):
            if value.lower() in ("true", "+", "1"):
                return True
            if value.lower() in ("false", "-", "0"):
                return False
            raise ValueError(f"{key}: {value!r} is neither true nor false")
        return bool(value)
    if isinstance(default, int) and not isinstance(default, bool):
        if float(value) != int(float(value)):
            raise ValueError(f"{key}: {value!r} isn't an integer")
        return int(float(value))
    if isinstance(default, float):
        return float(value)
    return value


def resolve(params: dict[str, Any] | None) -> dict[str, Any]:
    """All parameters with canonical names and types. The canonical name beats its aliases, the shortest alias the longer ones."""
    params = dict(params or {})
    out = dict(DEFAULTS)
    given: dict[str, tuple[tuple, Any]] = {}
    for key, value in params.items():
        name = ALIASES.get(key, key)
        rank = (key != name, len(key), key)
        if name not in given or rank < given[name][0]:
            given[name] = (rank, value)
    boosting = given.get("boosting", (None, "gbdt"))[1]
    if boosting == "goss":
        given["boosting"], given["data_sample_strategy"] = (None, "gbdt"), (None, "goss")
    for name, (_, value) in given.items():
        if name in _UNSUPPORTED:
            raise ValueError(f"{name} is not supported: Spark distributes the work")
        if name not in DEFAULTS:
            if name not in _OWN:
                warnings.warn(f"unknown parameter {name!r}", stacklevel=2)
            out[name] = value
            continue
        out[name] = value if value is None or callable(value) else _typed(name, value, DEFAULTS[name])
    for name, (lo, hi) in _RANGES.items():
        v = out[name]
        if v is not None and ((lo is not None and v < lo) or (hi is not None and v > hi)):
            raise ValueError(f"{name} = {v} is outside [{lo}, {hi}]")
    if not callable(out["objective"]):
        out["objective"] = objectives.canonical(out["objective"] or "custom")
    if out["boosting"] not in ("gbdt", "gbrt", "dart", "rf", "random_forest"):
        raise ValueError(f"unknown boosting {out['boosting']!r}")
    out["boosting"] = {"gbrt": "gbdt", "random_forest": "rf"}.get(out["boosting"], out["boosting"])
    if out["objective"] in ("multiclass", "multiclassova") and out["num_class"] < 2:
        raise ValueError("num_class must be at least 2 for multiclass objectives")
    if not callable(out["objective"]) and out["objective"] not in ("multiclass", "multiclassova", "custom") and out["num_class"] != 1:
        raise ValueError("num_class must be 1 for this objective")
    if out["boosting"] == "rf" and not ((out["bagging_freq"] > 0 and 0 < out["bagging_fraction"] < 1) or 0 < out["feature_fraction"] < 1):
        raise ValueError("random forests need bagging or feature_fraction below 1")
    if out["monotone_constraints_method"] != "basic" and out["monotone_constraints"]:
        warnings.warn(f"monotone_constraints_method {out['monotone_constraints_method']!r}: the basic method is used", stacklevel=2)
    if out["is_unbalance"] and out["scale_pos_weight"] != 1.0:
        raise ValueError("is_unbalance and scale_pos_weight exclude each other")
    if out["data_sample_strategy"] == "goss" and out["top_rate"] + out["other_rate"] > 1:
        raise ValueError("top_rate + other_rate must not be above 1")
    if out["linear_tree"] and out["objective"] == "regression_l1":
        raise ValueError("linear trees are not supported with regression_l1")
    if out["max_depth"] > 0 and "num_leaves" not in given:
        out["num_leaves"] = min(out["num_leaves"], 1 << min(out["max_depth"], 30))
    if out["seed"] is not None:
        rng = Lcg(int(out["seed"]))
        for key in ("data_random_seed", "bagging_seed", "drop_seed", "feature_fraction_seed", "objective_seed", "extra_seed"):
            n = rng.next_short(0, 32767)
            if key not in given:
                out[key] = n
    return out


def guard_dataset_params(old: dict, new: dict) -> None:
    """Raises if a parameter that shaped the bins would change."""
    for key in DATASET:
        if key in new and new[key] != old.get(key, DEFAULTS[key]):
            raise ValueError(f"{key} can't change after the dataset was made")
