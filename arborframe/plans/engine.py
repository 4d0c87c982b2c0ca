"""Dataset, Booster, train and cv."""

from __future__ import annotations

import heapq
import json
import math
import os
import tempfile
import uuid
from collections.abc import Callable
from typing import Any, NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

from ..functions import metrics, objectives
from ..operators import binning, losses, splits
from ..operators.sampling import Lcg
from ..operators.tree import Tree
from . import blocks as B
from . import config

#: Trees that may wait before they go into the blocks' scores.
PENDING = 8
#: Such merges after which the blocks are written to the shared folder, to cut their lineage.
MERGES = 6


class EvalResult(NamedTuple):
    dataset: str
    metric: str
    value: float
    higher_better: bool
    std: float | None = None


def shared_folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names. Where none is set, a temporary one on a single machine; a cluster must name one."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not at:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        at = "file://" + tempfile.mkdtemp(prefix="arborframe-")
        spark.sparkContext.setCheckpointDir(at)
    return at.rstrip("/")


class Dataset:
    """A DataFrame with roles for its columns, and the bins of its features once it is constructed."""

    def __init__(self, data: DataFrame, label: str | None = None, reference: Dataset | None = None, weight: str | None = None, group: str | None = None, init_score: str | list[str] | None = None, feature_name: list[str] | str = "auto", categorical_feature: list[str] | str = "auto", params: dict | None = None, position: str | None = None):
        self.data, self.label, self.reference, self.weight, self.group, self.init_score, self.position = data, label, reference, weight, group, init_score, position
        self.params = dict(params or {})
        self._given = feature_name
        self.categorical_feature = categorical_feature
        self.mappers: list[binning.BinMapper] | None = None
        self.blocks: DataFrame | None = None
        self.rows: int | None = None
        self.dealt = False  # whether rows of a query are in several blocks
        self.whole = False  # whether they must not be
        if feature_name == "auto":
            init = init_score if isinstance(init_score, list) else [init_score]
            used = {label, weight, group, position, *init}
            if reference is not None:
                self.features = list(reference.features)
            else:
                numeric = ("byte", "short", "int", "bigint", "smallint", "tinyint", "float", "double", "boolean")
                self.features = [c for c, t in data.dtypes if c not in used and (t in numeric or t.startswith("decimal"))]
        else:
            self.features = list(feature_name)
        for name in self.features:
            if any(ch in name for ch in '",:[]{}'):
                raise ValueError(f"feature name {name!r} has a character that JSON doesn't allow in names")
        if len(set(self.features)) != len(self.features):
            raise ValueError("feature names must be distinct")

    # ---- construction

    def _categorical(self) -> set[str]:
        c = self.params.get("categorical_feature") if self.categorical_feature == "auto" else self.categorical_feature
        if not c or c == "auto":
            return set()
        return {self.features[x] if isinstance(x, int) else x for x in (c.split(",") if isinstance(c, str) else c)}

    def construct(self, classes: int = 1) -> Dataset:
        if self.blocks is not None:
            return self
        p = config.resolve({k: v for k, v in self.params.items() if k in config.DATASET or config.ALIASES.get(k) in config.DATASET})
        if self.reference is not None:
            self.reference.construct(classes)
            if len(self.features) != len(self.reference.features):
                raise ValueError("the number of features differs from the reference's")
            self.mappers, self.linear = self.reference.mappers, self.reference.linear
        else:
            self.linear = bool(p["linear_tree"])
            if p["forcedbins_filename"]:
                p["forced_bins"] = binning.read_forced_bins(self.data.sparkSession, p["forcedbins_filename"])
            if p["max_bin_by_feature"] and len(p["max_bin_by_feature"]) != len(self.features):
                raise ValueError("max_bin_by_feature must have a number for each feature")
            p["min_data_in_leaf"] = self.params.get("min_data_in_leaf", 20)
            self.rows = self.data.count()
            self.mappers = binning.find_mappers(self.data, self.features, self._categorical(), self.rows, p["bin_construct_sample_cnt"], p)
        self.used = [m for m in self.mappers if not m.trivial]
        roles = {"weight": self.weight, "group": self.group, "init_score": self.init_score, "position": self.position}
        nan = F.lit(float("nan"))
        want = range(len(self.features)) if self.linear else [m.feature for m in self.used]
        cols = [F.coalesce(F.col(f"`{self.features[i]}`").cast("double"), nan).alias(f"f{i}") for i in want]
        num = lambda c: (F.coalesce(F.col(f"`{c}`").cast("double"), F.lit(0.0)) if c else F.lit(0.0))
        init = self.init_score
        init = F.array(*[num(c) for c in init]) if isinstance(init, list) else F.col(f"`{init}`").cast("array<double>") if init and dict(self.data.dtypes)[init].startswith("array") else F.array(num(init))
        rows = self.data.select(*cols, num(self.label).alias("label"), num(self.weight).alias("weight"), init.alias("init"), (F.xxhash64(F.col(f"`{self.group}`")) if self.group else F.lit(0).cast("long")).alias("query"), (F.col(f"`{self.position}`").cast("long") if self.position else F.lit(0).cast("long")).alias("position"))
        self.dealt = False
        packed = lambda rows, dealt=False: rows.mapInArrow(B.pack(self.used, roles, classes, len(self.features) if self.linear else 0, dealt), B.SQL)
        if self.group:  # whole queries in one partition, next to each other
            # in the order that they came in, whichever order the shuffle brings them in: a lost block is made again alike
            long, rows = self._long_queries(rows), rows.withColumn("_o", F.monotonically_increasing_id())
            self.dealt = long is not None
            own = rows.join(F.broadcast(long), "query", "left_anti") if self.dealt else rows
            blocks = packed(own.repartition("query").sortWithinPartitions("query", "_o").drop("_o"))
            if self.dealt:
                beside = rows.join(F.broadcast(long), "query").withColumn("_p", F.shiftright("_o", 33)).persist(StorageLevel.MEMORY_AND_DISK)  # _o in one way only
                blocks = blocks.union(packed(_pieces(beside), True))
            packed = blocks
        else:
            packed = packed(rows)
        cores = self.data.sparkSession.sparkContext.defaultParallelism
        if packed.rdd.getNumPartitions() < cores:  # few large files: blocks (compact, and named by where they were made) are dealt to all cores
            packed = packed.repartition(cores)
        self.blocks = packed.persist(StorageLevel.MEMORY_AND_DISK)
        if self.dealt:
            self.blocks.select("n").count()
            beside.unpersist()
        self.classes = classes
        return self

    def _long_queries(self, rows: DataFrame) -> DataFrame | None:
        """(query, _k) of the queries with so many rows that these are dealt out; None if there are none. The driver gets one id for each, so one for B.WIDE rows at most."""
        of = self.params.get("objective")
        if self.whole or callable(of) or (of and objectives.canonical(of) == "custom") or self.num_data() <= B.WIDE:
            return None
        ids = sorted(r.query for r in rows.groupBy("query").count().where(F.col("count") > B.WIDE).select("query").collect())
        return self.data.sparkSession.createDataFrame(list(zip(ids, range(len(ids)), strict=True)), "query long, _k long") if ids else None

    def create_valid(self, data: DataFrame, label: str | None = None, **roles) -> Dataset:
        own = {"weight": self.weight, "group": self.group, "init_score": None, "position": self.position} | roles
        return Dataset(data, label or self.label, reference=self, feature_name=self.features, params=self.params, **own)

    def set_reference(self, reference: Dataset) -> Dataset:
        self.reference, self.blocks, self.features = reference, None, list(reference.features)
        return self

    def subset(self, ids: DataFrame, key: str) -> Dataset:
        """The rows whose key is in ids (a column of that name); shares the bins."""
        return self._like(self.data.join(ids.select(key).distinct(), key, "left_semi"))

    def _like(self, data: DataFrame) -> Dataset:
        return Dataset(data, self.label, reference=self.reference or self, weight=self.weight, group=self.group, init_score=self.init_score, feature_name=self.features, params=self.params, position=self.position)

    # ---- fields

    _ROLES = ("label", "weight", "group", "init_score", "position")

    def set_field(self, name: str, column: str | None) -> Dataset:
        if name not in self._ROLES:
            raise ValueError(f"unknown field {name!r}")
        setattr(self, name, column)
        self.blocks = None
        return self

    def get_field(self, name: str) -> DataFrame | None:
        if name not in self._ROLES:
            raise ValueError(f"unknown field {name!r}")
        c = getattr(self, name)
        return None if c is None else self.data.select(*(c if isinstance(c, list) else [c]))

    def set_label(self, c): return self.set_field("label", c)  # noqa: E704
    def set_weight(self, c): return self.set_field("weight", c)  # noqa: E704
    def set_group(self, c): return self.set_field("group", c)  # noqa: E704
    def set_init_score(self, c): return self.set_field("init_score", c)  # noqa: E704
    def set_position(self, c): return self.set_field("position", c)  # noqa: E704
    def get_label(self): return self.get_field("label")  # noqa: E704
    def get_weight(self): return self.get_field("weight")  # noqa: E704
    def get_init_score(self): return self.get_field("init_score")  # noqa: E704
    def get_position(self): return self.get_field("position")  # noqa: E704

    def get_group(self) -> DataFrame | None:
        """Rows of each query."""
        return None if self.group is None else self.data.groupBy(self.group).count()

    def set_feature_name(self, names: list[str]) -> Dataset:
        if len(names) != len(self.features):
            raise ValueError("the number of names differs from the number of features")
        self.data = self.data.select(*[F.col(f"`{c}`").alias(dict(zip(self.features, names, strict=True)).get(c, c)) for c in self.data.columns])
        self.features, self.blocks = list(names), None
        return self

    def set_categorical_feature(self, names) -> Dataset:
        if self.blocks is not None and self.reference is None:
            self.blocks, self.mappers = None, None
        self.categorical_feature = names
        return self

    def get_data(self) -> DataFrame:
        return self.data

    def get_feature_name(self) -> list[str]:
        return list(self.features)

    def get_params(self) -> dict:
        return dict(self.params)

    def get_ref_chain(self, limit: int = 100) -> set[Dataset]:
        out, d = set(), self
        while d is not None and len(out) < limit:
            out.add(d)
            d = d.reference
        return out

    def num_data(self) -> int:
        if self.rows is None:
            self.rows = self.data.count()
        return self.rows

    def num_feature(self) -> int:
        return len(self.features)

    def feature_num_bin(self, feature: int | str) -> int:
        self.construct()
        return self.mappers[self.features.index(feature) if isinstance(feature, str) else feature].num_bin

    def binned(self) -> DataFrame:
        """The bins of every used feature as columns."""
        self.construct()
        return self.data.select(*[m.column(F.col(f"`{m.name}`")).alias(m.name) for m in self.used])

    def save_binary(self, path: str) -> Dataset:
        """The rows' used columns and the bins, as Parquet; refuses to overwrite."""
        self.construct()
        roles = [c for r in ("label", "weight", "group") if (c := getattr(self, r))]
        self.data.select(*self.features, *roles).write.mode("error").parquet(f"{path}/rows")
        spark = self.data.sparkSession
        meta = json.dumps({"mappers": [m.__dict__ for m in self.mappers], "features": self.features, "label": self.label, "weight": self.weight, "group": self.group, "params": {k: v for k, v in self.params.items() if not callable(v)}})
        spark.createDataFrame([(meta,)], "meta string").write.mode("error").json(f"{path}/meta")
        return self

    @classmethod
    def load_binary(cls, spark: SparkSession, path: str) -> Dataset:
        meta = json.loads(spark.read.schema("meta string").json(f"{path}/meta").first().meta)
        d = cls(spark.read.parquet(f"{path}/rows"), meta["label"], weight=meta["weight"], group=meta["group"], feature_name=meta["features"], params=meta["params"])
        like = cls(d.data, meta["label"], feature_name=meta["features"], params=meta["params"])
        like.mappers, like.linear, like.blocks = [binning.BinMapper(**m) for m in meta["mappers"]], bool(meta["params"].get("linear_tree")), d.data
        like.construct = lambda classes=1: like
        d.reference = like
        return d

    def add_features_from(self, other: Dataset) -> Dataset:
        raise ValueError("add_features_from is not supported: join the DataFrames by a key")


def _pieces(rows: DataFrame) -> DataFrame:
    """Rows of long queries (_k: the query's number; _o: the order, in which the parts _p follow each other) with the number of their block, which has
    the next B.BLOCK rows of one query. Places are counted inside the parts, then over them, so no task sees a whole query."""
    spark = rows.sparkSession
    inside = rows.withColumn("_i", F.row_number().over(Window.partitionBy("_k", "_p").orderBy("_o")) - 1)
    counts = rows.groupBy("_k", "_p").agg(F.count("*").alias("_c"))
    before = counts.select("_k", "_p", F.coalesce(F.sum("_c").over(Window.partitionBy("_k").orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_b"))
    block = F.lit(1 << 62) + F.shiftleft(F.col("_k"), 32) + F.floor((F.col("_i") + F.col("_b")) / B.BLOCK).cast("long")
    placed = inside.join(before, ["_k", "_p"]).withColumn("piece", block)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return placed.repartition(n, "piece").sortWithinPartitions("piece", "_o").drop("_k", "_p", "_o", "_i", "_b")


class Booster:
    """A model: trees on the driver, and while it trains, the blocks of its training rows."""

    def __init__(self, params: dict | None = None, train_set: Dataset | None = None, model_file: str | None = None, model_str: str | None = None):
        self.params = config.resolve(params)
        self.trees: list[Tree] = []
        self.best_iteration = -1
        self.best_score: dict = {}
        self.train_name = "training"
        self.valid: list[tuple[str, Dataset, dict]] = []
        self.train_set: Dataset | None = None
        self.features: list[str] = []
        self.infos: list[str] = []
        self.average_output = self.params["boosting"] == "rf"
        self._pre = 0  # trees that came with init_model
        self._tree_weight: list[float] = []  # of each own iteration, for DART's draw
        self._sum_weight = 0.0
        if model_file is not None:
            with open(model_file) as f:
                model_str = f.read()
        if model_str is not None:
            self.model_from_string(model_str)
        elif train_set is not None:
            self._attach(train_set)

    # ---- set-up

    @property
    def classes(self) -> int:
        return self.params["num_class"]

    @property
    def objective(self) -> str:
        return "custom" if callable(self.params["objective"]) else self.params["objective"]

    def _attach(self, d: Dataset) -> None:
        p = self.params
        d.params = {**p, **d.params} if not d.blocks else d.params
        d.construct(self.classes)
        self.train_set, self.features = d, list(d.features)
        self.mappers = d.mappers
        self.infos = [m.info() for m in d.mappers]
        self.spark = d.data.sparkSession
        if self.objective in ("lambdarank", "rank_xendcg") and not d.group:
            raise ValueError("ranking needs a group column")
        self.state = {"blocks": d.blocks, "pending": [], "merges": 0, "owned": False}
        self.parts = d.blocks.rdd.getNumPartitions()
        self.constant = [0.0] * self.classes
        self.fobj = p["objective"] if callable(p["objective"]) else None
        self._bias: dict[int, float] | None = {} if d.position and self.objective == "lambdarank" else None
        extra = {}
        lab = d.label
        if self.objective not in ("custom", "lambdarank", "rank_xendcg", "multiclass", "multiclassova", "regression", "regression_l1", "huber", "fair", "quantile", "mape"):
            objectives.check_labels(d.data, self.objective, lab)
        if self.objective == "binary":
            extra = objectives.class_weights(d.data, lab, p["is_unbalance"], p["scale_pos_weight"])
        self.loss_params = {**p, **extra}
        self.loss_params = {k: v for k, v in self.loss_params.items() if k != "objective" and not callable(v)}
        self._lcg_feature = Lcg(p["feature_fraction_seed"])
        self._lcg_extra = Lcg(p["extra_seed"])
        self._lcg_drop = Lcg(p["drop_seed"])
        self._used_features: set[int] = set()
        self.forced = None
        if p["forcedsplits_filename"]:
            with open(p["forcedsplits_filename"]) as f:
                self.forced = json.load(f)
        self.monotone = self._per_feature(p["monotone_constraints"])
        if p["monotone_constraints_method"] not in ("basic", "intermediate", "advanced"):
            raise ValueError("unknown monotone_constraints_method")
        self.contri = self._per_feature(p["feature_contri"])
        self.interaction = self._interaction(p["interaction_constraints"])
        self._started = False
        self._finished = False
        self._now, self._beside = None, []

    def _per_feature(self, v) -> dict[int, Any] | None:
        if not v:
            return None
        if isinstance(v, dict):
            return {self.features.index(k) if isinstance(k, str) else k: x for k, x in v.items()}
        if len(v) != len(self.features):
            raise ValueError("a per-feature parameter must have a value for each feature")
        return dict(enumerate(v))

    def _interaction(self, v) -> list[set[int]] | None:
        if not v:
            return None
        return [{self.features.index(x) if isinstance(x, str) else x for x in s} for s in v]

    def _job(self, state: dict, iteration: int | None = None) -> B.Job:
        it = self.current_iteration() if iteration is None else iteration
        return B.Job(self.train_set.used, self.objective, self.loss_params, self.classes, list(state["pending"]), list(state.get("constant", [0.0] * self.classes)), it, {}, (30, 30), self.fobj, self._bias)

    def _graded(self, job: B.Job) -> None:
        """The blocks that this iteration's passes read: with a ranking loss' gradients, which cost more than a pass, or as they are."""
        self._now = self.state["blocks"]
        if self.objective in B.RANKING and self.fobj is None:
            self._now, self._beside = B.graded(self._now, job, self.train_set.dealt)

    def _ungraded(self) -> None:
        if self._now is not self.state["blocks"]:
            self._now.unpersist()
        self._now = None

    # ---- one iteration

    def _start(self) -> None:
        """The scores to start from."""
        self._started = True
        d, p = self.train_set, self.params
        self._n = d.num_data()
        if d.init_score or self.trees or not p["boost_from_average"] or self.objective in ("custom", "lambdarank", "rank_xendcg"):
            return
        y = F.col(f"`{d.label}`").cast("double")
        if p["reg_sqrt"] and self.objective in ("regression", "regression_l1", "huber", "fair", "quantile", "mape"):
            y = objectives.sgn(y) * F.sqrt(F.abs(y))
        w = F.col(f"`{d.weight}`").cast("double") if d.weight else None
        if self.objective in ("multiclass", "multiclassova"):
            start = objectives.class_start_scores(d.data, f"`{d.label}`", self.classes, f"`{d.weight}`" if d.weight else None)
            if self.objective == "multiclassova":
                s = [min(max(math.exp(x), 1e-15), 1 - 1e-15) for x in start]
                start = [math.log(x / (1 - x)) / p["sigmoid"] for x in s]
        else:
            r = objectives.start_value(d.data, self.objective, y, w, **self.loss_params)
            start = [float(r) if r is not None else 0.0]
        self.constant = start
        for s in [self.state, *(v[2] for v in self.valid)]:
            s["constant"] = list(start)

    def _sampling(self, job: B.Job, iteration: int) -> dict:
        p = self.params
        if p["data_sample_strategy"] == "goss":
            if p["learning_rate"] > 0 and iteration < int(1 / p["learning_rate"]):
                return {}
            t = B.goss_threshold(self._now, job, p["top_rate"], self._n)
            rest = 1 - p["top_rate"]
            return {"kind": "goss", "threshold": t, "rate": p["other_rate"] / rest if rest else 0.0, "factor": rest / p["other_rate"] if p["other_rate"] else 0.0, "seed": p["bagging_seed"] + 104729 * iteration}
        freq = p["bagging_freq"]
        if freq <= 0:
            return {}
        seed = p["bagging_seed"] + 104729 * (iteration // freq)
        if self.objective == "binary" and (p["pos_bagging_fraction"] < 1 or p["neg_bagging_fraction"] < 1):
            return {"kind": "balanced", "positive": p["pos_bagging_fraction"], "negative": p["neg_bagging_fraction"], "seed": seed}
        if p["bagging_fraction"] >= 1:
            return {}
        return {"kind": "query" if p["bagging_by_query"] else "row", "fraction": p["bagging_fraction"], "seed": seed}

    def update(self, train_set: Dataset | None = None, fobj: Callable | None = None) -> bool:
        """One iteration. True if no tree could be split any more. fobj(scores, label, weight, query bounds) -> (grad, hess), on numpy blocks."""
        if train_set is not None and train_set is not self.train_set:
            trees = self.trees
            self._attach(train_set)
            self.trees = trees
            self.state["pending"] = [(i % self.classes, t) for i, t in enumerate(trees)]
        if fobj is not None:
            self.fobj = fobj
        if not self._started:
            self._start()
        p, it = self.params, self.current_iteration()
        rf, dart = p["boosting"] == "rf", p["boosting"] == "dart"
        dropped = self._drop(it) if dart else []
        job = self._job(self.state)
        if dropped:
            job.pending = job.pending + [(k, _scaled(t, -1.0)) for k, t in dropped]
        if rf:
            job.fixed, job.pending = list(self.state.get("constant", self.constant)), []
        self._graded(job)
        stats = B.summary(self._now, job)
        for x in self._beside:
            x.unpersist()
        self._n = stats["n"]
        job.sampling = self._sampling(job, it)
        factor = job.sampling.get("factor", 1.0) or 1.0
        room = 62 - max(1, math.ceil(math.log2(max(self._n, 2))))
        bits = lambda top: int(min(36, room, 52 - 21) - math.ceil(math.log2(max(top * max(factor, 1.0), 1e-20))))
        job.bits = (bits(stats["g"]), bits(stats["h"]))
        if p["use_quantized_grad"] and stats["g"] > 0:
            q = p["num_grad_quant_bins"]
            job.params = {**job.params, "quant_scale": (stats["g"] / (q / 2), max(stats["h"] / q, 1e-30))}
        grown = [self._grow(job, k, it) for k in range(self.classes)]
        stump = all(t.leaves == 1 for t in grown)
        if stump and self.trees:
            self._ungraded()
            self._finished = True  # dropped trees were taken out of this iteration's gradients alone: nothing is to be put back
            return True
        rate = 1.0 if rf else p["learning_rate"]
        self._renew(job, grown)
        if p["linear_tree"]:
            for k, t in enumerate(grown):
                self._fit_linear(job, t, k)
        self._ungraded()
        if dart:
            rate = self._normalise(dropped, rate)
            self._tree_weight.append(rate)
            self._sum_weight += rate
        for k, t in enumerate(grown):
            t.shrink(rate)
            for f in t.feature:
                self._used_features.add(f)
            for s in [self.state, *(v[2] for v in self.valid)]:
                s["pending"].append((k, t))
        if not self.trees or rf:
            for k, t in enumerate(grown):
                c = self.constant[k]
                if c:  # the model has the start in its first tree; the blocks have it as a constant
                    own = _scaled(t, 1.0)
                    own.add_bias(c)
                    self.trees.append(own)
                else:
                    self.trees.append(t)
        else:
            self.trees += grown
        if self._bias is not None:
            self._update_bias(it)
        self._merge()
        return stump

    def _grow(self, job: B.Job, k: int, it: int) -> Tree:
        """Leaf-wise growth. Rounds evaluate all leaves that may be split soon in one pass; best-first order is then replayed over what is known, so the tree is the one that one split at a time gives."""
        p, used = self.params, self.train_set.used
        tree = Tree()
        if not used:
            return tree
        by = {m.feature: m for m in used}
        rules = splits.Rules(p["lambda_l1"], p["lambda_l2"], p["max_delta_step"], p["path_smooth"], p["min_data_in_leaf"], p["min_sum_hessian_in_leaf"], p["min_gain_to_split"], p["max_cat_to_onehot"], p["max_cat_threshold"], p["cat_l2"], p["cat_smooth"], p["min_data_per_group"])
        feats = [m.feature for m in used]
        if p["feature_fraction"] < 1:
            feats = [feats[i] for i in self._lcg_feature.sample(len(feats), max(1, round(len(feats) * p["feature_fraction"])))]
        spec = Tree()  # everything tried so far
        scale = np.array([2.0 ** -job.bits[0], 2.0 ** -job.bits[1], 1.0])
        blocks = self._now
        first = B.histograms(blocks, job, [(k, Tree(), [0])], self.parts)[k, 0]
        info: dict[int, dict] = {}
        self._evaluate(info, 0, first, scale, used, rules, set(feats), 0, 0.0, -math.inf, math.inf, frozenset(), by)
        tree.value[0] = spec.value[0] = info[0]["out"] if p["boosting"] == "rf" or not self.trees else 0.0
        tree.weight[0], tree.count[0] = info[0]["total"][1], info[0]["total"][2]
        spec.weight[0], spec.count[0] = tree.weight[0], tree.count[0]
        if self.forced:
            self._force(job, k, self.forced, spec, info, scale, used, rules, set(feats), by)
        kids: dict[int, tuple[int, int]] = info.get("kids", {})  # node id in info -> ids of its children
        leaf_of: dict[int, int] = info.get("leaf_of", {0: 0})  # id -> leaf of spec
        ids = [max(leaf_of)] if not kids else [max(max(c) for c in kids.values())]
        while True:
            order, done = self._replay(info, kids, p["num_leaves"])
            if done:
                break
            want, plan = [], []
            for i in order:
                s = info[i]["best"]
                leaf = leaf_of[i]
                right = spec.split(leaf, s, by[s.feature])
                a, b = ids[0] + 1, ids[0] + 2
                ids[0] += 2
                kids[i] = (a, b)
                leaf_of[a], leaf_of[b] = leaf, right
                left_n = info[i]["left_n"]
                small_left = left_n < info[i]["total"][2] - left_n
                plan.append((i, a, b, small_left))
                want.append(leaf if small_left else right)
            got = B.histograms(blocks, job, [(k, spec, want)], self.parts)
            for (i, a, b, small_left), leaf in zip(plan, want, strict=True):
                small = got[k, leaf]
                large = info[i]["hist"] - small
                s, here = info[i]["best"], info[i]
                lo, hi = here["lo"], here["hi"]
                (llo, lhi), (rlo, rhi) = _bounds(s, lo, hi)
                path = here["path"] | {s.feature}
                for child, hist, out, x, y in ((a, small if small_left else large, s.left_out, llo, lhi), (b, large if small_left else small, s.right_out, rlo, rhi)):
                    self._evaluate(info, child, hist, scale, used, rules, set(feats), here["depth"] + 1, out, x, y, path, by)
                del here["hist"]
        return self._final(tree, info, kids, p["num_leaves"], by)

    def _evaluate(self, info, i, hist, scale, used, rules, feats, depth, out, lo, hi, path, by) -> None:
        p = self.params
        x = hist * scale
        g, h = float(x[0, :, 0].sum()), float(x[0, :, 1].sum())
        n = int(hist[0, :, 2].sum())
        if i == 0:
            out = float(splits.leaf_output(g, h + 2 * splits.EPS, rules))
        allowed = set(feats)
        if p["feature_fraction_bynode"] < 1:
            f = sorted(allowed)
            allowed = {f[j] for j in self._lcg_feature.sample(len(f), max(1, round(len(f) * p["feature_fraction_bynode"])))}
        if self.interaction is not None:
            ok = set(path)
            for s in self.interaction:
                if path <= s:
                    ok |= s
            allowed &= ok
        rand = None
        if p["extra_trees"]:
            rand = {m.feature: self._lcg_extra.next_int(0, max(m.num_bin - 2, 1)) if not m.categorical else self._lcg_extra.next_int(1, max(m.num_bin, 2)) for m in used if m.num_bin > 2}
        depth_penalty = splits.monotone_depth_penalty(depth, p["monotone_penalty"]) if p["monotone_penalty"] and self.monotone else 1.0
        best = None
        if p["max_depth"] <= 0 or depth < p["max_depth"]:
            best = splits.best_split(used, x[:, :, :2], (g, h, n), rules, out, lo, hi, allowed, self.monotone, self.contri, self._cegb(n), depth_penalty, rand)
        left_n = 0
        if best is not None:
            left_n = self._left_count(best, hist[[m.feature for m in used].index(best.feature)][:, 2], by[best.feature])
            if left_n == 0 or left_n == n:
                best = None
            else:
                best.left_n, best.right_n = left_n, n - left_n
        info[i] = {"hist": hist, "total": (g, h, n), "depth": depth, "out": out, "lo": lo, "hi": hi, "path": frozenset(path), "best": best, "left_n": left_n}

    @staticmethod
    def _left_count(s: splits.Split, counts: np.ndarray, m: binning.BinMapper) -> int:
        if s.cat_bins is not None:
            return int(counts[s.cat_bins].sum())
        left = np.arange(len(counts)) <= s.bin
        if m.missing == "nan":
            left[m.num_bin - 1] = s.default_left
        elif m.missing == "zero":
            left[m.default_bin] = s.default_left
        return int(counts[left].sum())

    def _cegb(self, n: int):
        p = self.params
        one, coupled, lazy = p["cegb_penalty_split"], self._per_feature(p["cegb_penalty_feature_coupled"]), self._per_feature(p["cegb_penalty_feature_lazy"])
        if not one and not coupled and not lazy:
            return None
        t, used = p["cegb_tradeoff"], self._used_features
        return lambda f: t * (one * n + ((coupled or {}).get(f, 0.0) if f not in used else 0.0) + ((lazy or {}).get(f, 0.0) * n if f not in used else 0.0))

    @staticmethod
    def _replay(info, kids, num_leaves) -> tuple[list[int], bool]:
        """Leaves whose children are wanted next, and whether the tree is finished with what is known.

        Best-first growth is replayed over what is known. A leaf with unknown children is wanted; the replay goes on without
        them, so that a pass answers for all leaves that may still be split, not for the next one alone.
        """
        forced = info.get("forced", [])
        start = [c for i in forced for c in kids[i] if c not in forced] if forced else [0] if 0 in info else []
        heap = [(-info[c]["best"].gain, c) for c in start if info[c]["best"] is not None]
        heapq.heapify(heap)
        left, want = num_leaves - 1 - len(forced), []
        while heap and left > 0:
            _, i = heapq.heappop(heap)
            left -= 1
            if i not in kids:
                want.append(i)
                continue
            for c in kids[i]:
                if info[c]["best"] is not None:
                    heapq.heappush(heap, (-info[c]["best"].gain, c))
        return want, not want

    @staticmethod
    def _final(tree: Tree, info, kids, num_leaves, by) -> Tree:
        leaf, left = {0: 0}, num_leaves - 1
        heap: list[tuple[float, int]] = []
        forced = info.get("forced", [])

        def open_(i):
            if info[i]["best"] is not None and i not in forced:
                heapq.heappush(heap, (-info[i]["best"].gain, i))

        def split(i):
            s = info[i]["best"]
            a, b = kids[i]
            leaf[b] = tree.split(leaf[i], s, by[s.feature])
            leaf[a] = leaf[i]
            for c in (a, b):
                tree.count[leaf[c]] = info[c]["total"][2]
                tree.weight[leaf[c]] = info[c]["total"][1]
            return a, b

        open_(0)
        for i in forced:
            left -= 1
            for c in split(i):
                open_(c)
        while heap and left > 0:
            _, i = heapq.heappop(heap)
            if i not in kids:
                break
            left -= 1
            for c in split(i):
                open_(c)
        return tree

    def _force(self, job, k, spec_json, spec, info, scale, used, rules, feats, by) -> None:
        """Splits from the JSON come first, breadth first; a branch ends where its split has no gain."""
        info["forced"], info["kids"], info["leaf_of"] = [], {}, {0: 0}
        queue, next_id = [(0, spec_json)], 0
        at = {m.feature: j for j, m in enumerate(used)}
        while queue:
            i, node = queue.pop(0)
            f = int(node["feature"])
            if f not in by or len(info["forced"]) >= self.params["num_leaves"] - 1:
                continue
            m, here = by[f], info[i]
            g, h, n = here["total"]
            x = here["hist"] * scale
            free = splits.Rules(rules.l1, rules.l2, rules.max_delta_step, rules.path_smooth, 1, 0.0, 0.0)
            shift = float(splits.leaf_gain(g, h + 2 * splits.EPS, rules))
            b = int(m.bins(np.array([float(node["threshold"])]))[0])
            if m.categorical:
                s = splits.categorical_split(m, x[at[f], :, :2], g, h + 2 * splits.EPS, n, splits.Rules(l1=rules.l1, l2=rules.l2, min_data=1, min_hessian=0.0, max_cat_to_onehot=1 << 30), here["out"], shift, only=b)
            else:
                s = splits.numeric_split(m, x[at[f], :, :2], g, h + 2 * splits.EPS, n, free, here["out"], shift, only=min(b, m.num_bin - 2))
            if s is None or s.gain <= 0:
                continue
            left_n = self._left_count(s, here["hist"][at[f], :, 2], m)
            if left_n in (0, n):
                continue
            s.left_n, s.right_n = left_n, n - left_n
            here["best"], here["left_n"] = s, left_n
            leaf = info["leaf_of"][i]
            right = spec.split(leaf, s, m)
            a, c = next_id + 1, next_id + 2
            next_id += 2
            info["kids"][i], info["leaf_of"][a], info["leaf_of"][c] = (a, c), leaf, right
            info["forced"].append(i)
            got = B.histograms(self._now, job, [(k, spec, [leaf])], self.parts)[k, leaf]
            (llo, lhi), (rlo, rhi) = _bounds(s, here["lo"], here["hi"])
            for child, hist, out, lo, hi, key in ((a, got, s.left_out, llo, lhi, "left"), (c, here["hist"] - got, s.right_out, rlo, rhi, "right")):
                self._evaluate(info, child, hist, scale, used, rules, feats, here["depth"] + 1, out, lo, hi, here["path"] | {f}, by)
                if isinstance(node.get(key), dict) and "feature" in node[key]:
                    queue.append((child, node[key]))

    # ---- after growth

    def _renew(self, job: B.Job, grown: list[Tree]) -> None:
        """Leaf values of losses whose best constant is a percentile."""
        name = self.objective
        if name not in ("regression_l1", "quantile", "mape") and not (self.params["quant_train_renew_leaf"] and self.params["use_quantized_grad"]):
            return
        if name not in ("regression_l1", "quantile", "mape"):
            exact = B.Job(**{**{f: getattr(job, f) for f in job.__dataclass_fields__}, "params": {k: v for k, v in job.params.items() if k != "quant_scale"}})
            for k, t in enumerate(grown):
                s = B.leaf_sums(self._now, exact, t, k)
                for i in range(t.leaves):
                    if s[i, 2]:
                        t.value[i] = float(-s[i, 0] / (s[i, 1] + self.params["lambda_l2"]))
            return
        alpha = self.params["alpha"] if name == "quantile" else 0.5
        rows = B.leaf_values(self._now, job, [(k, t) for k, t in enumerate(grown) if t.leaves > 1])
        if name == "mape" or self.train_set.weight:
            got = objectives.weighted_percentile(rows.withColumn("row_id", F.monotonically_increasing_id()), "r", "w", alpha, ["k", "leaf"]).collect()
        else:
            got = objectives.percentile(rows, "r", alpha, ["k", "leaf"]).collect()
        for r in got:
            grown[r.k].value[r.leaf] = float(r.result)

    def _fit_linear(self, job: B.Job, t: Tree, k: int) -> None:
        paths = []
        for i in range(t.leaves):
            f, node = set(), t.parent[i]
            parent_of = {c: n for n in range(len(t.feature)) for c in (t.left[n], t.right[n]) if c >= 0}
            while node >= 0:
                if t.cats[node] is None:
                    f.add(t.feature[node])
                node = parent_of.get(node, -1)
            paths.append(sorted(f) if self.trees else [])  # the first tree is constant
        sums = B.linear_sums(self._now, job, t, k, paths)
        t.linear = []
        for i, f in enumerate(paths):
            a, b, n = sums[i]
            coef = None
            if f and n > len(f):
                a = a + np.diag([self.params["linear_lambda"]] * len(f) + [0.0])
                try:
                    coef = -np.linalg.solve(a, b)
                except np.linalg.LinAlgError:
                    coef = None
            if coef is None or not np.isfinite(coef).all():
                t.linear.append((t.value[i], [], []))
            else:
                keep = [j for j in range(len(f)) if abs(coef[j]) > binning.ZERO]
                t.linear.append((float(coef[-1]), [f[j] for j in keep], [float(coef[j]) for j in keep]))

    def _drop(self, it: int) -> list[tuple[int, Tree]]:
        p, rng = self.params, self._lcg_drop
        self._dropped_iterations: list[int] = []
        if rng.next_float() < p["skip_drop"]:
            return []
        done, rate, most = (len(self.trees) - self._pre) // self.classes, p["drop_rate"], p["max_drop"]
        if p["uniform_drop"]:
            rates = [min(rate, most / max(done, 1)) if most > 0 else rate] * done
        elif self._sum_weight:
            inverse = len(self._tree_weight) / self._sum_weight
            rate = min(rate, most * inverse / self._sum_weight) if most > 0 else rate
            rates = [rate * w * inverse for w in self._tree_weight[:done]]
        else:
            rates = [0.0] * done
        for i, r in enumerate(rates):
            if rng.next_float() < r:
                self._dropped_iterations.append(i)
                if 0 <= most <= len(self._dropped_iterations):
                    break
        first = self._pre
        out = []
        for i in self._dropped_iterations:
            for k in range(self.classes):
                t = self.trees[first + i * self.classes + k]
                if i == 0 and self.constant[k]:
                    t = _scaled(t, 1.0)
                    t.add_bias(-self.constant[k])
                out.append((k, t))
        return out

    def _normalise(self, dropped: list[tuple[int, Tree]], rate: float) -> float:
        """Weights of the new and the dropped trees; the blocks get the difference as a further pending tree."""
        n = len(self._dropped_iterations)
        if not n:
            return rate
        xgb = self.params["xgboost_dart_mode"]
        keep = n / (n + rate) if xgb else n / (n + 1.0)
        new = rate / (n + rate) if xgb else rate / (n + 1.0)
        for j, (k, t) in enumerate(dropped):
            change = _scaled(t, keep - 1.0)
            for s in [self.state, *(v[2] for v in self.valid)]:
                s["pending"].append((k, change))
            i = self._pre + self._dropped_iterations[j // self.classes] * self.classes + k
            own = _scaled(t, keep)
            own.shrinkage = t.shrinkage * keep
            if self._dropped_iterations[j // self.classes] == 0 and self.constant[k]:
                own.add_bias(self.constant[k])
            self.trees[i] = own
        for i in self._dropped_iterations:
            self._sum_weight -= self._tree_weight[i] / (n + (rate if xgb else 1.0))
            self._tree_weight[i] *= keep
        return new

    def _update_bias(self, it: int) -> None:
        """One Newton step per display position on the summed gradients."""
        reg, rate = self.params["lambdarank_position_bias_regularization"], self.params["learning_rate"]
        job = self._job(self.state)
        self._graded(job)
        for pos, (g, h, n) in B.position_sums(self._now, job).items():
            b = self._bias.get(pos, 0.0)
            self._bias[pos] = b + rate * (-g - b * reg * n) / (h + reg * n + 0.001)
        for x in self._beside:
            x.unpersist()
        self._ungraded()

    def _merge(self) -> None:
        for s in [self.state, *(v[2] for v in self.valid)]:
            if len(s["pending"]) < PENDING * self.classes:
                continue
            old = s["blocks"]
            new = B.advanced(old, B.Job(self.train_set.used, self.objective, self.loss_params, self.classes, list(s["pending"])))
            s["merges"] += 1
            if s["merges"] % MERGES == 0:
                at = f"{shared_folder(self.spark)}/blocks-{uuid.uuid4().hex}"
                new.write.parquet(at)
                new = self.spark.read.schema(new.schema).parquet(at)
            new = new.persist(StorageLevel.MEMORY_AND_DISK)
            new.count()
            if s["owned"]:
                old.unpersist()
            s.update(blocks=new, pending=[], owned=True)

    # ---- validation

    def add_valid(self, data: Dataset, name: str) -> Booster:
        data.reference = data.reference or self.train_set
        if self.train_set not in data.get_ref_chain():
            data.set_reference(self.train_set)
        data.construct(self.classes)
        s = {"blocks": data.blocks, "pending": [(i % self.classes, t) for i, t in enumerate(self.trees)], "merges": 0, "owned": False, "constant": [0.0] * self.classes}
        self.valid.append((name, data, s))
        return self

    def set_train_data_name(self, name: str) -> Booster:
        self.train_name = name
        return self

    def metric_names(self) -> list[str]:
        m = self.params["metric"]
        if m in ("None", "none", "na", "null", "custom"):
            return []
        if not m:
            m = [] if self.objective == "custom" else [self.objective]
        m = m.split(",") if isinstance(m, str) else list(m)
        out = []
        for x in m:
            x = metrics.canonical(objectives.NAMES.get(x, x) if x not in metrics.METRICS else x)
            if x not in out:
                out.append(x)
        return out

    def _scores(self, which) -> DataFrame:
        s = self.state if which is None else which[2]
        job = B.Job(self.train_set.used, self.objective, self.loss_params, self.classes, list(s["pending"]), list(s.get("constant", [0.0] * self.classes)))
        rows = B.scored(s["blocks"], job)
        if self.average_output and self.current_iteration() > 1:
            it = self.current_iteration()
            base = s.get("constant", [0.0] * self.classes)
            rows = rows.withColumn("score", F.transform("score", lambda x, i: (x - F.element_at(F.array(*map(F.lit, base)), i + 1)) / it + F.element_at(F.array(*map(F.lit, base)), i + 1)))
        return rows

    def _evaluate_rows(self, rows: DataFrame, name: str, weighted: bool, feval=None) -> list[EvalResult]:
        p, out = self.params, []
        q = {k: v for k, v in self.loss_params.items() if k in ("alpha", "fair_c", "tweedie_variance_power", "sigmoid", "reg_sqrt")}
        obj = self.objective if self.objective != "custom" else "regression"
        multi = self.classes > 1
        raw = F.col("score")[0]
        pred = objectives.transform(obj, F.col("score") if multi else raw, **q) if obj not in ("lambdarank", "rank_xendcg") else raw
        w = F.col("weight") if weighted else None
        names = self.metric_names()
        aggs = {}
        for m in names:
            if m in ("multi_logloss", "multi_error"):
                prob = pred if obj in ("multiclass", "multiclassova") else F.col("score")
                aggs[m] = metrics.multi_logloss(prob, F.col("label"), w) if m == "multi_logloss" else metrics.multi_error(prob, F.col("label"), w, p["multi_error_top_k"])
            elif m == "r2":
                aggs[m] = metrics.r2(pred, F.col("label"), w)
            elif m == "cross_entropy_lambda":
                aggs[m] = metrics.cross_entropy_lambda(raw, F.col("label"), w)
            elif m not in ("auc", "average_precision", "auc_mu", "ndcg", "map"):
                aggs[m] = metrics.pointwise(m, pred, F.col("label"), w, **q)
        got = rows.agg(*(a.alias(m) for m, a in aggs.items())).first().asDict() if aggs else {}
        wcol = "weight" if weighted else None
        flat = rows.withColumn("s", raw)
        for m in names:
            if m in got:
                out.append(EvalResult(name, m, float(got[m]) if got[m] is not None else float("nan"), m in metrics.HIGHER))
            elif m in ("auc", "average_precision"):
                out.append(EvalResult(name, m, float((metrics.auc if m == "auc" else metrics.average_precision)(flat, "s", "label", wcol).first().value), True))
            elif m == "auc_mu":
                out.append(EvalResult(name, m, float(metrics.auc_mu(rows, "score", "label", self.classes, wcol, p["auc_mu_weights"]).first().value), True))
            elif m in ("ndcg", "map"):
                ks = tuple(p["eval_at"])
                r = (metrics.ndcg if m == "ndcg" else metrics.mean_average_precision)(flat, "query", "s", "label", "row", ks, wcol, **({"gains": p["label_gain"]} if m == "ndcg" and p["label_gain"] else {})).collect()
                by = {x.k: x.value for x in r}
                out += [EvalResult(name, f"{m}@{k}", float(by[k]), True) for k in ks if k in by]
            else:
                raise ValueError(f"unknown metric {m!r}")
        for f in feval if isinstance(feval, (list, tuple)) else [feval] if feval else []:
            r = f(rows, name)
            out += [EvalResult(name, *x) for x in (r if isinstance(r, list) else [r])]
        return out

    def eval_train(self, feval=None) -> list[EvalResult]:
        return self._evaluate_rows(self._scores(None), self.train_name, bool(self.train_set.weight), feval)

    def eval_valid(self, feval=None) -> list[EvalResult]:
        return [r for v in self.valid for r in self._evaluate_rows(self._scores(v), v[0], bool(v[1].weight), feval)]

    def eval(self, data: Dataset, name: str, feval=None) -> list[EvalResult]:
        if data is self.train_set:
            return self._evaluate_rows(self._scores(None), name, bool(data.weight), feval)
        for v in self.valid:
            if v[1] is data:
                return self._evaluate_rows(self._scores(v), name, bool(data.weight), feval)
        raise ValueError("only training and validation data can be evaluated")

    # ---- model

    def current_iteration(self) -> int:
        return len(self.trees) // max(self.classes, 1)

    def num_model_per_iteration(self) -> int:
        return self.classes

    def num_trees(self) -> int:
        return len(self.trees)

    def num_feature(self) -> int:
        return len(self.features)

    def feature_name(self) -> list[str]:
        return list(self.features)

    def reset_parameter(self, params: dict) -> Booster:
        new = {config.ALIASES.get(k, k): v for k, v in params.items()}
        for k in ("num_class", "boosting", "metric"):
            if k in new and new[k] != self.params[k]:
                raise ValueError(f"{k} can't change during training")
        config.guard_dataset_params(self.params, new)
        self.params = config.resolve({**{k: v for k, v in self.params.items() if v != config.DEFAULTS.get(k)}, **new})
        if self.train_set is not None:
            self.loss_params |= {k: v for k, v in self.params.items() if k not in ("objective",) and not callable(v)}
        return self

    def rollback_one_iter(self) -> Booster:
        if self.current_iteration() <= self._pre // max(self.classes, 1):
            return self
        gone = self.trees[-self.classes :]
        first = self.current_iteration() == 1
        self.trees = self.trees[: -self.classes]
        if self.train_set is not None:
            for k, t in enumerate(gone):
                back = _scaled(t, -1.0)
                if first and self.constant[k] and not self._pre:
                    back.add_bias(self.constant[k])
                for s in [self.state, *(v[2] for v in self.valid)]:
                    s["pending"].append((k, back))
        return self

    def free_dataset(self) -> Booster:
        if self.train_set is not None:
            for s in [self.state, *(v[2] for v in self.valid)]:
                s["blocks"].unpersist()
            self.train_set.blocks = None
        self.train_set, self.valid = None, []
        return self

    def free_network(self) -> Booster:
        return self

    def set_network(self, *args, **kwargs) -> Booster:
        raise ValueError("set_network is not supported: Spark distributes the work")

    def shuffle_models(self, *args, **kwargs) -> Booster:
        raise ValueError("shuffle_models is not supported")

    def _window(self, start: int, num: int | None) -> list[tuple[int, Tree]]:
        n = self.current_iteration()
        start = min(max(start, 0), n)
        if num is None:
            num = self.best_iteration if self.best_iteration > 0 else -1
        end = n if num <= 0 else min(n, start + num)
        return [(i % self.classes, t) for i, t in enumerate(self.trees)][start * self.classes : end * self.classes]

    def predict(self, data: DataFrame, start_iteration: int = 0, num_iteration: int | None = None, raw_score: bool = False, pred_leaf: bool = False, pred_contrib: bool = False, validate_features: bool = False, prediction: str = "prediction", sparse_contrib: bool = False, **kwargs) -> DataFrame:
        """data with a column more: a double, or an array for several classes, leaves or contributions."""
        from . import predict as P

        return P.predict(self, data, start_iteration, num_iteration, raw_score, pred_leaf, pred_contrib, prediction=prediction, validate_features=validate_features, sparse_contrib=sparse_contrib, **kwargs)

    def get_leaf_output(self, tree_id: int, leaf_id: int) -> float:
        return self.trees[tree_id].value[leaf_id]

    def feature_importance(self, importance_type: str = "split", iteration: int | None = None) -> np.ndarray:
        out = np.zeros(len(self.features))
        for _, t in self._window(0, iteration):
            for f, g in zip(t.feature, t.gain, strict=True):
                if g > 0:
                    out[f] += 1 if importance_type == "split" else g
        return out.astype(np.int32) if importance_type == "split" else out

    def lower_bound(self) -> float:
        return float(sum(min(t.value) for t in self.trees))

    def upper_bound(self) -> float:
        return float(sum(max(t.value) for t in self.trees))

    def get_split_value_histogram(self, feature: int | str, bins=None, xgboost_style: bool = False):
        f = self.features.index(feature) if isinstance(feature, str) else feature
        values = [t.threshold[i] for t in self.trees for i in range(len(t.feature)) if t.feature[i] == f and t.cats[i] is None]
        if any(t.feature[i] == f and t.cats[i] is not None for t in self.trees for i in range(len(t.feature))):
            raise ValueError("no split value histogram of a categorical feature")
        n = len(np.unique(values))
        if bins is None or (isinstance(bins, int) and xgboost_style):
            bins = max(min(n, bins) if bins is not None else n, 1)
        hist, edges = np.histogram(values, bins=bins)
        if not xgboost_style:
            return hist, edges
        import pandas as pd

        keep = hist > 0
        return pd.DataFrame({"SplitValue": edges[1:][keep], "Count": hist[keep]})

    def trees_to_dataframe(self, spark: SparkSession | None = None):
        """One row per node; a Spark DataFrame if a session is given, else pandas."""
        from . import model_io

        return model_io.trees_table(self, spark)

    def model_to_string(self, num_iteration: int | None = None, start_iteration: int = 0, importance_type: str = "split") -> str:
        from . import model_io

        return model_io.to_text(self, num_iteration, start_iteration, importance_type)

    def save_model(self, filename: str, num_iteration: int | None = None, start_iteration: int = 0, importance_type: str = "split") -> Booster:
        with open(filename, "w") as f:
            f.write(self.model_to_string(num_iteration, start_iteration, importance_type))
        return self

    def model_from_string(self, text: str) -> Booster:
        from . import model_io

        model_io.from_text(self, text)
        return self

    def dump_model(self, num_iteration: int | None = None, start_iteration: int = 0, importance_type: str = "split", object_hook=None) -> dict:
        from . import model_io

        return model_io.to_json(self, num_iteration, start_iteration, importance_type, object_hook)

    def refit(self, data: DataFrame, label: str, decay_rate: float | None = None, **roles) -> Booster:
        """A copy whose leaves are fitted to new rows: decay * old + (1 - decay) * new, tree after tree."""
        decay = self.params["refit_decay_rate"] if decay_rate is None else decay_rate
        new = Booster(model_str=self.model_to_string(num_iteration=-1))
        new.params = {**self.params, "linear_tree": False}
        d = Dataset(data, label, feature_name=self.features, params={"linear_tree": True, "feature_pre_filter": False, "verbosity": -1}, **roles)
        d.construct(self.classes)
        p = {k: v for k, v in self.params.items() if k != "objective" and not callable(v)}
        done: list[tuple[int, Tree]] = []
        for i, t in enumerate(new.trees):
            k = i % self.classes
            job = _RawJob(d.used, self.objective, p, self.classes, [x for x in done if x[1] is not None][: (i // self.classes) * self.classes])
            ranking = self.objective in B.RANKING
            blocks, beside = B.graded(d.blocks, job, d.dealt) if ranking else (d.blocks, [])
            s = B.leaf_sums(blocks, job, t, k)
            for x in [*beside, *([blocks] if ranking else [])]:
                x.unpersist()
            for j in range(t.leaves):
                g, h, n = s[j]
                t.value[j] = refitted(t.value[j], g, h, n, t.shrinkage, decay, splits.Rules(l1=p["lambda_l1"], l2=p["lambda_l2"], max_delta_step=p["max_delta_step"]))
                t.count[j] = int(n)
            done.append((k, t))
        d.blocks.unpersist()
        return new

    def __getstate__(self):
        return {"text": self.model_to_string(num_iteration=-1), "best_iteration": self.best_iteration, "best_score": self.best_score, "params": {k: v for k, v in self.params.items() if not callable(v)}}

    def __setstate__(self, s):
        self.__init__(s["params"], model_str=s["text"])
        self.best_iteration, self.best_score = s["best_iteration"], s["best_score"]

    def __deepcopy__(self, memo):
        new = Booster.__new__(Booster)
        new.__setstate__(self.__getstate__())
        return new


class _RawJob(B.Job):
    """Pending trees are applied to raw values (trees that were read from text have no bins)."""

    def open(self, row):
        rows = super().open(row)
        rows.leaves = lambda t: t.leaf_of_raw(rows.x)
        return rows


def refitted(old: float, g: float, h: float, rows: int, shrinkage: float, decay: float, rules: splits.Rules) -> float:
    """A leaf's value after new rows with these sums came to it."""
    out = float(splits.leaf_output(g, h + splits.EPS, rules)) if rows else 0.0
    return decay * old + (1 - decay) * out * shrinkage


def _scaled(t: Tree, f: float) -> Tree:
    new = Tree(**{k: list(v) if isinstance(v, list) else v for k, v in t.__dict__.items() if k in Tree.__dataclass_fields__})
    new.value = [v * f for v in t.value]
    new.node_value = [v * f for v in t.node_value]
    if t.linear:
        new.linear = [(c * f, a, [x * f for x in k]) for c, a, k in t.linear]
    return new


def _bounds(s: splits.Split, lo: float, hi: float):
    """Limits of the children's outputs: a monotone split parts them at the middle."""
    if not s.monotone:
        return (lo, hi), (lo, hi)
    mid = (s.left_out + s.right_out) / 2
    return ((lo, min(hi, mid)), (max(lo, mid), hi)) if s.monotone > 0 else ((max(lo, mid), hi), (lo, min(hi, mid)))


# ---- training loops


def train(params: dict, train_set: Dataset, num_boost_round: int = 100, valid_sets: list[Dataset] | None = None, valid_names: list[str] | None = None, feval=None, init_model: Booster | str | None = None, keep_training_booster: bool = False, callbacks: list | None = None, fobj: Callable | None = None) -> Booster:
    from . import callbacks as C

    p = config.resolve(params)
    rounds = p["num_iterations"] if any(config.ALIASES.get(k, k) == "num_iterations" for k in params) else num_boost_round
    pre = Booster(model_file=init_model) if isinstance(init_model, str) else init_model
    train_set.params = {**params, **train_set.params}
    if pre is not None:
        train_set = _with_init(train_set, pre)
        valid_sets = [_with_init(v, pre) for v in valid_sets or []]
    train_set.whole = train_set.whole or fobj is not None
    booster = Booster(params, train_set)
    for i, v in enumerate(valid_sets or []):
        name = valid_names[i] if valid_names and i < len(valid_names) else f"valid_{i}"
        if v is train_set:
            booster.set_train_data_name(name)
            booster.params["is_provide_training_metric"] = True
        else:
            booster.add_valid(v, name)
    callbacks = list(callbacks or [])
    if p["early_stopping_round"] > 0 and not any(isinstance(c, C.EarlyStopping) for c in callbacks):
        callbacks.append(C.early_stopping(p["early_stopping_round"], p["first_metric_only"], min_delta=p["early_stopping_min_delta"]))
    callbacks.sort(key=lambda c: getattr(c, "order", 0))
    for it in range(rounds):
        for c in callbacks:
            if getattr(c, "before_iteration", False):
                c(C.Env(booster, booster.params, it, 0, rounds, None))
        done = booster.update(fobj=fobj)
        results: list[EvalResult] = []
        if booster.valid or booster.params["is_provide_training_metric"] or feval:
            if booster.params["is_provide_training_metric"] or (feval and not booster.valid):
                results += booster.eval_train(feval)
            results += booster.eval_valid(feval)
        try:
            for c in callbacks:
                if not getattr(c, "before_iteration", False):
                    c(C.Env(booster, booster.params, it, 0, rounds, results))
        except C.EarlyStop as e:
            booster.best_iteration = e.best_iteration + 1
            for r in e.best_score:
                booster.best_score.setdefault(r.dataset, {})[r.metric] = r.value
            break
        if done:
            break
    if not booster.best_score:
        for r in results if rounds else []:
            booster.best_score.setdefault(r.dataset, {})[r.metric] = r.value
    if pre is not None:
        booster.trees = [*pre.trees, *booster.trees]
        booster._pre = len(pre.trees)
    if not keep_training_booster:
        booster.free_dataset()
    return booster


def _with_init(d: Dataset, pre: Booster) -> Dataset:
    """The dataset with the model's raw scores as initial scores."""
    scored = pre.predict(d.data, raw_score=True, prediction="_init")
    new = Dataset(scored, d.label, reference=d.reference, weight=d.weight, group=d.group, init_score="_init", feature_name=d.features, categorical_feature=d.categorical_feature, params=d.params, position=d.position)
    return new


class CVBooster:
    """The boosters of all folds; a method call goes to each."""

    def __init__(self, model_file: str | None = None):
        self.boosters: list[Booster] = []
        self.best_iteration = -1
        if model_file:
            with open(model_file) as f:
                self.model_from_string(f.read())

    def __getattr__(self, name):
        if name.startswith("__"):
            raise AttributeError(name)
        return lambda *a, **k: [getattr(b, name)(*a, **k) for b in self.boosters]

    def model_to_string(self, num_iteration=None, start_iteration=0, importance_type="split") -> str:
        return json.dumps({"boosters": [b.model_to_string(num_iteration, start_iteration, importance_type) for b in self.boosters], "best_iteration": self.best_iteration})

    def model_from_string(self, text: str) -> CVBooster:
        x = json.loads(text)
        self.best_iteration = x["best_iteration"]
        self.boosters = [Booster(model_str=s) for s in x["boosters"]]
        return self

    def save_model(self, filename, num_iteration=None, start_iteration=0, importance_type="split") -> CVBooster:
        with open(filename, "w") as f:
            f.write(self.model_to_string(num_iteration, start_iteration, importance_type))
        return self


def cv(params: dict, train_set: Dataset, num_boost_round: int = 100, folds=None, nfold: int = 5, stratified: bool = True, shuffle: bool = True, metrics: str | list | None = None, feval=None, fpreproc=None, seed: int = 0, callbacks: list | None = None, eval_train_metric: bool = False, return_cvbooster: bool = False) -> dict:
    """Mean and population deviation of each metric per round. All folds share the bins of all rows. folds: a column with fold numbers, or None."""
    from . import callbacks as C

    p = dict(params)
    if metrics:
        p["metric"] = metrics
    train_set.params = {**p, **train_set.params}
    resolved = config.resolve(p)
    train_set.construct(resolved["num_class"])
    df = train_set.data
    if isinstance(folds, str):
        df = df.withColumn("_fold", F.col(folds).cast("int"))
        nfold = df.agg(F.max("_fold")).first()[0] + 1
    elif folds is not None:
        raise TypeError("folds: the name of a column with fold numbers is expected; rows of a DataFrame have no positions")
    else:
        h = F.xxhash64(F.col(f"`{train_set.group}`") if train_set.group else F.monotonically_increasing_id(), F.lit(seed))
        if stratified and not train_set.group and resolved["objective"] in ("binary", "multiclass", "multiclassova"):
            from pyspark.sql import Window

            place = F.row_number().over(Window.partitionBy(f"`{train_set.label}`", F.pmod(h, F.lit(64))).orderBy(h))
            df = df.withColumn("_fold", F.pmod(place + F.pmod(h, F.lit(64)), F.lit(nfold)).cast("int"))
        else:
            df = df.withColumn("_fold", F.pmod(h, F.lit(nfold)).cast("int"))
    df = df.persist(StorageLevel.MEMORY_AND_DISK)
    out = CVBooster()
    for i in range(nfold):
        a, b = train_set._like(df.where(F.col("_fold") != i).drop("_fold")), train_set._like(df.where(F.col("_fold") == i).drop("_fold"))
        own = dict(p)
        if fpreproc is not None:
            a, b, own = fpreproc(a, b, own)
        booster = Booster(own, a)
        booster.add_valid(b, "valid")
        out.boosters.append(booster)
    callbacks = list(callbacks or [])
    if resolved["early_stopping_round"] > 0:
        callbacks.append(C.early_stopping(resolved["early_stopping_round"], resolved["first_metric_only"], min_delta=resolved["early_stopping_min_delta"]))
    callbacks.sort(key=lambda c: getattr(c, "order", 0))
    history: dict[str, list[float]] = {}
    for it in range(num_boost_round):
        per: dict[tuple[str, str, bool], list[float]] = {}
        for booster in out.boosters:
            for c in callbacks:
                if getattr(c, "before_iteration", False):
                    c(C.Env(booster, booster.params, it, 0, num_boost_round, None))
            booster.update()
            for r in (booster.eval_train(feval) if eval_train_metric else []) + booster.eval_valid(feval):
                per.setdefault(("train" if r.dataset == booster.train_name else "valid", r.metric, r.higher_better), []).append(r.value)
        results = [EvalResult(d, m, float(np.mean(v)), hb, float(np.std(v))) for (d, m, hb), v in per.items()]
        for r in results:
            history.setdefault(f"{r.dataset} {r.metric}-mean", []).append(r.value)
            history.setdefault(f"{r.dataset} {r.metric}-stdv", []).append(r.std)
        try:
            for c in callbacks:
                if not getattr(c, "before_iteration", False):
                    c(C.Env(out, p, it, 0, num_boost_round, results))
        except C.EarlyStop as e:
            out.best_iteration = e.best_iteration + 1
            history = {k: v[: out.best_iteration] for k, v in history.items()}
            break
    df.unpersist()
    return history | ({"cvbooster": out} if return_cvbooster else {})
