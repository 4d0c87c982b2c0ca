"""Models as text, JSON and tables."""

from __future__ import annotations

import json

import numpy as np

from ..operators.tree import Tree
from . import config

_NODE_SQL = "tree_index int, node_depth int, node_index string, left_child string, right_child string, parent_index string, split_feature string, split_gain double, threshold string, decision_type string, missing_direction string, missing_type string, value double, weight double, count long"


def _objective_text(b) -> str:
    p, o = b.params, b.objective
    extra = {"binary": f" sigmoid:{p['sigmoid']:g}", "multiclass": f" num_class:{p['num_class']}", "multiclassova": f" num_class:{p['num_class']} sigmoid:{p['sigmoid']:g}", "quantile": f" alpha:{p['alpha']:g}", "huber": f" alpha:{p['alpha']:g}", "fair": f" fair_c:{p['fair_c']:g}", "poisson": f" max_delta_step:{p['poisson_max_delta_step']:g}", "tweedie": f" tweedie_variance_power:{p['tweedie_variance_power']:g}"}.get(o, "")
    return o + extra + (" sqrt" if p["reg_sqrt"] and o == "regression" else "")


def to_text(b, num_iteration=None, start_iteration=0, importance_type="split") -> str:
    trees = [t.to_text(i) for i, (_, t) in enumerate(b._window(start_iteration, num_iteration))]
    head = ["tree", "version=v4", f"num_class={b.classes}", f"num_tree_per_iteration={b.classes}", "label_index=0", f"max_feature_idx={len(b.features) - 1}", f"objective={_objective_text(b)}"]
    if b.average_output:
        head.append("average_output")
    head.append("feature_names=" + " ".join(f.replace(" ", "_") for f in b.features))
    if b.params["monotone_constraints"]:
        m = b._per_feature(b.params["monotone_constraints"])
        head.append("monotone_constraints=" + " ".join(str(m.get(i, 0)) for i in range(len(b.features))))
    head += ["feature_infos=" + " ".join(b.infos), "tree_sizes=" + " ".join(str(len(t.encode()) + 1) for t in trees), "", ""]
    imp = b.feature_importance(importance_type, num_iteration)
    order = sorted((i for i in range(len(imp)) if imp[i] > 0), key=lambda i: -imp[i])
    tail = ["end of trees", "", "feature_importances:", *(f"{b.features[i]}={imp[i]:g}" for i in order), "", "parameters:"]
    tail += [f"[{k}: {v}]" for k, v in b.params.items() if not callable(v) and v is not None]
    return "\n".join(head) + "".join(t + "\n" for t in trees) + "\n".join([*tail, "end of parameters", "", "pandas_categorical:null", ""])


def from_text(b, text: str) -> None:
    if not text.startswith("tree\n"):
        raise ValueError("model text must start with 'tree'")
    head, _, rest = text.partition("\nTree=")
    kv, flags = {}, set()
    for line in head.splitlines()[1:]:
        if "=" in line:
            k, v = line.split("=", 1)
            kv[k] = v
        elif line:
            flags.add(line)
    for k in ("num_class", "max_feature_idx", "feature_names"):
        if k not in kv:
            raise ValueError(f"model text has no {k}")
    body, _, tail = rest.partition("end of trees")
    parts = ["Tree=" + x for x in body.split("\nTree=")] if rest else []
    trees = [Tree.from_text(x) for x in parts if x.strip() != "Tree="]
    sizes = kv.get("tree_sizes", "").split()
    if len(sizes) != len(trees):
        raise ValueError("tree_sizes doesn't fit the trees")
    params = {}
    for line in tail.partition("parameters:\n")[2].partition("\nend of parameters")[0].splitlines():
        k, _, v = line.strip("[]").partition(": ")
        if k in config.DEFAULTS and k not in ("label_gain", "eval_at") and not v.startswith(("{", "[", "(")):
            params[k] = v
    objective, *extra = kv.get("objective", "custom").split()
    params = {k: v for k, v in params.items() if not isinstance(config.DEFAULTS[k], (list, tuple)) and v != "None"}
    params |= {"objective": objective, "num_class": kv["num_class"]}
    for x in extra:
        k, _, v = x.partition(":")
        if k in ("sigmoid", "alpha", "fair_c", "tweedie_variance_power", "num_class"):
            params[k] = v
        elif k == "sqrt":
            params["reg_sqrt"] = True
    if "average_output" in flags:
        params |= {"boosting": "rf", "bagging_freq": params.get("bagging_freq", 1), "bagging_fraction": params.get("bagging_fraction", 0.5)}
        if float(params["bagging_fraction"]) >= 1 or int(params["bagging_freq"]) < 1:
            params |= {"bagging_freq": 1, "bagging_fraction": 0.5}
    b.params = config.resolve(params)
    b.average_output = "average_output" in flags
    b.features = kv["feature_names"].split()
    b.infos = kv.get("feature_infos", "").split()
    b.trees = trees
    b._pre = 0
    b.fobj = None


def to_json(b, num_iteration=None, start_iteration=0, importance_type="split", object_hook=None) -> dict:
    imp = b.feature_importance(importance_type, num_iteration)
    trees = [t.to_json(i) for i, (_, t) in enumerate(b._window(start_iteration, num_iteration))]
    out = {
        "name": "tree", "version": "v4", "num_class": b.classes, "num_tree_per_iteration": b.classes, "label_index": 0, "max_feature_idx": len(b.features) - 1, "objective": _objective_text(b), "average_output": b.average_output,
        "feature_names": b.features, "monotone_constraints": [], "feature_infos": {f: i for f, i in zip(b.features, b.infos, strict=False) if i != "none"}, "tree_info": trees,
        "feature_importances": {b.features[i]: float(imp[i]) for i in range(len(imp)) if imp[i] > 0},
    }
    return json.loads(json.dumps(out), object_hook=object_hook)


def node_rows(b) -> list[tuple]:
    out = []
    for n, t in enumerate(b.trees):
        name = lambda i, n=n: f"{n}-L{~i}" if i < 0 else f"{n}-S{i}"
        stack = [(0 if t.feature else ~0, 1, None)]
        while stack:
            i, depth, parent = stack.pop()
            if i < 0:
                out.append((n, depth, name(i), None, None, parent, None, None, None, None, None, None, t.value[~i], t.weight[~i] if t.feature else None, t.count[~i]))
                continue
            cat = t.cats[i] is not None
            th = "||".join(map(str, t.cats[i])) if cat else repr(t.threshold[i])
            out.append((n, depth, name(i), name(t.left[i]), name(t.right[i]), parent, b.features[t.feature[i]], t.gain[i], th, "==" if cat else "<=", "left" if t.default_left[i] else "right", {"none": "None", "zero": "Zero", "nan": "NaN"}[t.missing[i]], t.node_value[i], t.node_weight[i], t.node_count[i]))
            stack += [(t.right[i], depth + 1, name(i)), (t.left[i], depth + 1, name(i))]
    return out


def trees_table(b, spark=None):
    rows = [tuple(v.item() if isinstance(v, np.generic) else v for v in r) for r in node_rows(b)]
    if spark is not None:
        return spark.createDataFrame(rows, _NODE_SQL)
    import pandas as pd

    return pd.DataFrame(rows, columns=[c.split()[0] for c in _NODE_SQL.split(", ")])


def digraph(b, tree_index: int = 0, show_info: tuple[str, ...] = (), example: dict | None = None) -> str:
    """The tree in the DOT language; an example's path is drawn bold."""
    t = b.trees[tree_index]
    path: set[int] = set()
    if example is not None and t.feature:
        x = np.array([[float("nan") if example.get(f) is None else float(example[f]) for f in b.features]])
        i = 0
        while i >= 0:
            path.add(i)
            i = t.left[i] if t._goes_left(i, x)[0] else t.right[i]
        path.add(i)
    lines = ["digraph {", "rankdir=LR"]
    known = {"split_gain": lambda i: t.gain[i], "internal_value": lambda i: t.node_value[i], "internal_weight": lambda i: t.node_weight[i], "internal_count": lambda i: t.node_count[i], "leaf_count": lambda i: t.count[~i], "leaf_weight": lambda i: t.weight[~i]}

    def add(i):
        bold = " penwidth=3" if i in path else ""
        if i < 0:
            info = "".join(f"\\n{k}: {known[k](i):g}" for k in show_info if k.startswith("leaf"))
            lines.append(f'leaf{~i} [label="leaf {~i}: {t.value[~i]:g}{info}"{bold}]')
            return f"leaf{~i}"
        info = "".join(f"\\n{k}: {known[k](i):g}" for k in show_info if not k.startswith("leaf"))
        sign = "=" if t.cats[i] is not None else "<="
        lines.append(f'split{i} [label="{b.features[t.feature[i]]} {sign} {"||".join(map(str, t.cats[i])) if t.cats[i] is not None else format(t.threshold[i], "g")}{info}" shape=rectangle{bold}]')
        for c, word in ((t.left[i], "yes"), (t.right[i], "no")):
            lines.append(f'split{i} -> {add(c)} [label="{word}"]')
        return f"split{i}"

    add(0 if t.feature else ~0)
    return "\n".join([*lines, "}"])
