"""Data of the plots, and the plots where matplotlib or graphviz is there."""

from __future__ import annotations

from .model_io import digraph


def importance_data(booster, importance_type: str = "split", max_num_features: int | None = None, ignore_zero: bool = True) -> list[tuple[str, float]]:
    got = [(f, float(v)) for f, v in zip(booster.features, booster.feature_importance(importance_type), strict=True) if v > 0 or not ignore_zero]
    got.sort(key=lambda x: x[1])
    return got[-max_num_features:] if max_num_features else got


def metric_data(history: dict, metric: str | None = None) -> dict[str, list[float]]:
    """dataset -> values per round, of a history that record_evaluation filled."""
    out = {}
    for name, own in history.items():
        m = metric or next(iter(own))
        if m not in own:
            raise KeyError(f"no metric {m!r} for {name!r}")
        out[name] = own[m]
    return out


def _axes(ax):
    if ax is None:
        import matplotlib.pyplot as plt

        _, ax = plt.subplots()
    return ax


def plot_importance(booster, ax=None, **kwargs):
    names, values = zip(*importance_data(booster, **kwargs), strict=True)
    ax = _axes(ax)
    ax.barh(range(len(values)), values)
    ax.set_yticks(range(len(names)), names)
    return ax


def plot_metric(history: dict, metric: str | None = None, ax=None):
    ax = _axes(ax)
    for name, values in metric_data(history, metric).items():
        ax.plot(range(len(values)), values, label=name)
    ax.legend()
    return ax


def plot_split_value_histogram(booster, feature, bins=None, ax=None):
    hist, edges = booster.get_split_value_histogram(feature, bins)
    ax = _axes(ax)
    ax.bar((edges[:-1] + edges[1:]) / 2, hist, width=0.8 * (edges[1] - edges[0]))
    return ax


def create_tree_digraph(booster, tree_index: int = 0, show_info=(), example_case: dict | None = None) -> str:
    return digraph(booster, tree_index, tuple(show_info), example_case)


def plot_tree(booster, tree_index: int = 0, **kwargs):
    import graphviz

    return graphviz.Source(create_tree_digraph(booster, tree_index, **kwargs))
