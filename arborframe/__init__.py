"""arborframe: gradient-boosted trees as Spark DataFrame queries."""

import importlib

__version__ = "0.1.0"
_WHERE = {
    **dict.fromkeys(("Booster", "CVBooster", "Dataset", "cv", "train"), "plans.engine"),
    **dict.fromkeys(("early_stopping", "log_evaluation", "record_evaluation", "register_logger", "reset_parameter"), "plans.callbacks"),
    **dict.fromkeys(("TreeClassifier", "TreeModel", "TreeRanker", "TreeRegressor"), "plans.estimators"),
}
__all__ = sorted(_WHERE)


def __getattr__(name: str):  # loaded when asked for: Python workers import the package for each small function
    if name in _WHERE:
        return getattr(importlib.import_module(f"{__name__}.{_WHERE[name]}"), name)
    raise AttributeError(name)
