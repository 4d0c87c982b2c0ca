"""One query per operator on the driver's tables, each with the SQL that gives the same rows."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import metrics as M
from .functions import objectives as O
from .operators import binning, histogram, ranking, routing, sampling, splits

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


# ---- rows that losses and metrics work on: id, positive target y, score s, weight w, binary b, unit interval u, class k

P_SQL = """p as (select o_orderkey as id, o_totalprice / 50000e0 as y, (o_custkey % 100) / 50e0 as s, 0.5e0 + (o_orderkey % 5) / 4e0 as w,
  case when o_orderpriority = '1-URGENT' then 1e0 else 0e0 end as b, (o_orderkey % 11) / 10e0 as u, cast(o_orderkey % 3 as int) as k,
  (o_custkey % 7) / 5e0 as s0, (o_orderkey % 13) / 9e0 as s1, (o_custkey % 5) / 3e0 as s2, o_custkey % 97 as q, cast(o_orderkey % 5 as int) as rel from orders)"""


def rows(spark: SparkSession, d: str) -> DataFrame:
    o = spark.read.parquet(f"{d}/orders.parquet")
    key, cust = F.col("o_orderkey"), F.col("o_custkey")
    return o.select(
        key.alias("id"), (F.col("o_totalprice") / 50000.0).alias("y"), (cust % 100 / 50.0).alias("s"), (0.5 + key % 5 / 4.0).alias("w"), (F.col("o_orderpriority") == "1-URGENT").cast("double").alias("b"), (key % 11 / 10.0).alias("u"),
        (key % 3).cast("int").alias("k"), (cust % 7 / 5.0).alias("s0"), (key % 13 / 9.0).alias("s1"), (cust % 5 / 3.0).alias("s2"), (cust % 97).alias("q"), (key % 5).cast("int").alias("rel"),
    )


def r6(c: Column, n: int = 6) -> Column:
    return F.round(c.cast("double"), n)


SGN = "case when s > y then 1e0 when s < y then -1e0 else 0e0 end"
_GRADS = {  # objective: (target, gradient, hessian, weighted)
    "l2": ("regression", "y", "(s - y) * w", "w", True),
    "l1": ("regression_l1", "y", f"({SGN}) * w", "w", True),
    "huber": ("huber", "y", f"(case when abs(s - y) <= 0.9e0 then s - y else ({SGN}) * 0.9e0 end) * w", "w", True),
    "fair": ("fair", "y", "((s - y) / (abs(s - y) + 1e0)) * w", "(1e0 / ((abs(s - y) + 1e0) * (abs(s - y) + 1e0))) * w", True),
    "poisson": ("poisson", "y", "(exp(s) - y) * w", "exp(s + 0.7e0) * w", True),
    "quantile": ("quantile", "y", "(case when cast(s - y as float) >= 0 then 1e0 - 0.9e0 else -0.9e0 end) * w", "w", True),
    "mape": ("mape", "y", f"({SGN}) * cast(cast((1e0 / greatest(1e0, abs(y))) * w as float) as double)", "w", True),
    "gamma": ("gamma", "y", "(1e0 - y * exp(-s)) * w", "y * exp(-s) * w", True),
    "tweedie": ("tweedie", "y", "(-y * exp(-0.5e0 * s) + exp(0.5e0 * s)) * w", "(0.5e0 * y * exp(-0.5e0 * s) + 0.5e0 * exp(0.5e0 * s)) * w", True),
    "binary": ("binary", "b", "(case when b > 0 then -1e0 / (1e0 + exp(s)) else 1e0 / (1e0 + exp(-s)) end) * w", "(1e0 / (1e0 + exp(s))) * (1e0 - 1e0 / (1e0 + exp(s))) * w", True),
    "xent": ("cross_entropy", "u", "(((1e0 - u) - u * exp(-s)) / (1e0 + exp(-s))) * w", "(exp(-s) / ((1e0 + exp(-s)) * (1e0 + exp(-s)))) * w", True),
    "xentlambda": ("cross_entropy_lambda", "u", "1e0 / (1e0 + exp(-s)) - u", "(1e0 / (1e0 + exp(-s))) * (1e0 - 1e0 / (1e0 + exp(-s)))", False),
}


def _grad(objective, target, weighted):
    def run(spark, d):
        g, h = O.gradients(objective, F.col("s"), F.col(target), F.col("w") if weighted else None)
        return rows(spark, d).select("id", r6(g).alias("g"), r6(h).alias("h"))

    return run


for _n, (_o, _t, _g, _h, _w) in _GRADS.items():
    query(f"grad_{_n}", f"with {P_SQL} select id, round(cast(cast({_g} as float) as double), 6) as g, round(cast(cast({_h} as float) as double), 6) as h from p")(_grad(_o, _t, _w))

_SOFT = "greatest(s0, s1, s2) as top from p), e as (select *, exp(s0 - top) as e0, exp(s1 - top) as e1, exp(s2 - top) as e2 from t), f as (select *, (case k when 0 then e0 when 1 then e1 else e2 end) as ek, e0 + e1 + e2 as z from e)"


@query("grad_softmax", f"with {P_SQL}, t as (select *, {_SOFT} select id, " + ", ".join(f"round(cast(cast(e{i} / z - (case when k = {i} then 1 else 0 end) as float) as double), 6) as g{i}, round(cast(cast(1.5e0 * (e{i} / z) * (1e0 - e{i} / z) as float) as double), 6) as h{i}" for i in range(3)) + " from f")
def grad_softmax(spark, d):
    gh = O.multiclass_gradients(F.array("s0", "s1", "s2"), F.col("k"), 3)
    return rows(spark, d).select("id", *(r6(x).alias(f"{n}{i}") for i, p in enumerate(gh) for n, x in zip("gh", p, strict=True)))


@query("grad_ova", f"with {P_SQL} select id, " + ", ".join(f"round(cast(cast((case when k = {i} then -1e0 / (1e0 + exp(s{i})) else 1e0 / (1e0 + exp(-s{i})) end) as float) as double), 6) as g{i}" for i in range(3)) + " from p")
def grad_ova(spark, d):
    gh = O.multiclass_gradients(F.array("s0", "s1", "s2"), F.col("k"), 3, one_vs_all=True)
    return rows(spark, d).select("id", *(r6(g).alias(f"g{i}") for i, (g, _) in enumerate(gh)))


# ---- scores to start from, transforms

for _n, (_o, _t, _w, _sql) in {
    "mean": ("regression", "y", True, "sum(y * w) / sum(w)"), "median": ("regression_l1", "y", False, "quantile_cont(y, 0.5)"), "quantile": ("quantile", "y", False, "quantile_cont(y, 0.9)"),
    "logit": ("binary", "b", True, "ln((sum(b * w) / sum(w)) / (1e0 - sum(b * w) / sum(w)))"), "logmean": ("poisson", "y", True, "ln(sum(y * w) / sum(w))"), "logexpm1": ("cross_entropy_lambda", "u", False, "ln(exp(avg(u)) - 1e0)"),
}.items():
    query(f"init_{_n}", f"with {P_SQL} select round({_sql}, 6) as value from p")(lambda spark, d, o=_o, t=_t, w=_w: spark.createDataFrame([(round(O.start_value(rows(spark, d), o, F.col(t), F.col("w") if w else None), 6),)], "value double"))


@query("init_class_shares", f"with {P_SQL} select k as class, round(ln(count(*) / (select count(*)::double from p)), 6) as value from p group by k")
def init_class_shares(spark, d):
    t = rows(spark, d)
    return spark.createDataFrame([(i, round(v, 6)) for i, v in enumerate(O.class_start_scores(t, "k", 3))], "class int, value double")


@query("init_weighted_median", f"""with {P_SQL}, r as (select y as v, sum(w) over (order by y, id) as c, row_number() over (order by y, id) as n from p),
l as (select *, lag(c) over (order by n) as cb, lag(v) over (order by n) as vb, max(c) over () as t from r), h as (select * from l where c > 0.5e0 * t order by n limit 1)
select round(case when cb is null then v when c - cb >= 1e0 then vb + (0.5e0 * t - cb) / (c - cb) * (v - vb) else vb end, 6) as value from h""")
def init_weighted_median(spark, d):
    return spark.createDataFrame([(round(O.start_value(rows(spark, d), "regression_l1", F.col("y"), F.col("w"), F.col("id")), 6),)], "value double")


@query("output_transforms", f"with {P_SQL} select id, round(exp(s), 6) as e, round(1e0 / (1e0 + exp(-s)), 6) as sig, round(ln(1e0 + exp(s)), 6) as softplus, round(s * s, 6) as sq from p")
def output_transforms(spark, d):
    s = F.col("s")
    return rows(spark, d).select("id", r6(O.transform("poisson", s)).alias("e"), r6(O.transform("binary", s)).alias("sig"), r6(O.transform("cross_entropy_lambda", s)).alias("softplus"), r6(O.transform("regression", s, reg_sqrt=True)).alias("sq"))


@query("label_clamp", f"with {P_SQL}, t as (select id, case when id % 4 = 0 then 1e39 when id % 4 = 1 then -1e300 when id % 4 = 2 then null else y end as v from p) select id, greatest(least(coalesce(v, 0e0), 1e38), -1e38) as v from t")
def label_clamp(spark, d):
    v = F.when(F.col("id") % 4 == 0, 1e39).when(F.col("id") % 4 == 1, -1e300).when(F.col("id") % 4 == 2, F.lit(None)).otherwise(F.col("y"))
    return rows(spark, d).select("id", O.clamped(v).alias("v"))


@query("class_weights", f"with {P_SQL}, c as (select sum(b) as p, count(*) - sum(b) as n from p) select round(case when n > p then n / p else 1e0 end, 6) as positive_weight, round(case when p > n then p / n else 1e0 end, 6) as negative_weight from c")
def class_weights(spark, d):
    w = O.class_weights(rows(spark, d), "b", is_unbalance=True)
    return spark.createDataFrame([(round(w["positive_weight"], 6), round(w["negative_weight"], 6))], "positive_weight double, negative_weight double")


# ---- metrics: s is the raw score, e = exp(s) and o = sigmoid(s) are outputs

_X = f"with {P_SQL}, x as (select *, exp(s) as e, 1e0 / (1e0 + exp(-s)) as o from p)"
_METRICS = {  # name: (output, label, loss)
    "l2": ("s", "y", "(y - s) * (y - s)"), "l1": ("s", "y", "abs(y - s)"), "quantile": ("s", "y", "case when y - s < 0 then (0.9e0 - 1e0) * (y - s) else 0.9e0 * (y - s) end"),
    "huber": ("s", "y", "case when abs(y - s) <= 0.9e0 then 0.5e0 * (y - s) * (y - s) else 0.9e0 * (abs(y - s) - 0.45e0) end"), "fair": ("s", "y", "abs(y - s) - ln(1e0 + abs(y - s))"), "poisson": ("e", "y", "e - y * ln(e)"),
    "mape": ("s", "y", "abs(y - s) / greatest(1e0, abs(y))"), "gamma": ("e", "y", "y / e + ln(e)"), "tweedie": ("e", "y", "2e0 * y * exp(-0.5e0 * ln(e)) + 2e0 * exp(0.5e0 * ln(e))"),
    "binary_logloss": ("o", "b", "-ln(case when b > 0 then o else 1e0 - o end)"), "binary_error": ("o", "b", "case when (o > 0.5e0) <> (b > 0) then 1e0 else 0e0 end"), "cross_entropy": ("o", "u", "-(u * ln(o) + (1e0 - u) * ln(1e0 - o))"),
    "kullback_leibler": ("o", "u", "-(u * ln(o) + (1e0 - u) * ln(1e0 - o)) + case when u > 0 then u * ln(u) else 0e0 end + case when u < 1 then (1e0 - u) * ln(1e0 - u) else 0e0 end"),
}


def outputs(spark, d):
    return rows(spark, d).withColumns({"e": F.exp("s"), "o": O.sigmoid(F.col("s"))})


for _n, (_p, _y, _sql) in _METRICS.items():
    query(f"metric_{_n}", f"{_X} select round(sum(({_sql}) * w) / sum(w), 6) as value from x")(lambda spark, d, n=_n, p=_p, y=_y: outputs(spark, d).agg(r6(M.pointwise(n, F.col(p), F.col(y), F.col("w"))).alias("value")))
query("metric_rmse", f"{_X} select round(sqrt(sum((y - s) * (y - s) * w) / sum(w)), 6) as value from x")(lambda spark, d: outputs(spark, d).agg(r6(M.pointwise("rmse", F.col("s"), F.col("y"), F.col("w"))).alias("value")))
query("metric_gamma_deviance", f"{_X} select round(2e0 * sum(y / (e + 1e-9) - ln(y / (e + 1e-9)) - 1e0), 4) as value from x")(lambda spark, d: outputs(spark, d).agg(r6(M.pointwise("gamma_deviance", F.col("e"), F.col("y")), 4).alias("value")))
query("metric_cross_entropy_lambda", f"{_X} select round(avg(-(u * ln(1e0 - exp(-w * ln(1e0 + e))) + (1e0 - u) * (-w * ln(1e0 + e)))), 6) as value from x")(lambda spark, d: outputs(spark, d).agg(r6(M.cross_entropy_lambda(F.col("s"), F.col("u"), F.col("w"))).alias("value")))
query("metric_r2", f"{_X} select round(1e0 - sum(w * (y - s) * (y - s)) / (sum(w * y * y) - sum(w * y) * sum(w * y) / sum(w)), 6) as value from x")(lambda spark, d: outputs(spark, d).agg(r6(M.r2(F.col("s"), F.col("y"), F.col("w"))).alias("value")))
_G = "g as (select s, sum(b * w) as pos, sum((1e0 - b) * w) as neg from p group by s), a as (select *, coalesce(sum(pos) over (order by s desc rows between unbounded preceding and 1 preceding), 0) as pa, coalesce(sum(neg) over (order by s desc rows between unbounded preceding and 1 preceding), 0) as na from g)"
query("metric_auc", f"with {P_SQL}, {_G} select round(sum(neg * (pos / 2e0 + pa)) / (sum(pos) * sum(neg)), 6) as value from a")(lambda spark, d: M.auc(rows(spark, d), "s", "b", "w").select(r6(F.col("value")).alias("value")))
query("metric_average_precision", f"with {P_SQL}, {_G} select round(sum(pos * (pos + pa) / (pos + pa + neg + na)) / sum(pos), 6) as value from a")(lambda spark, d: M.average_precision(rows(spark, d), "s", "b", "w").select(r6(F.col("value")).alias("value")))
query("metric_multi_logloss", f"with {P_SQL}, t as (select *, {_SOFT} select round(sum(-ln(ek / z) * w) / sum(w), 6) as value from f")(lambda spark, d: rows(spark, d).agg(r6(M.multi_logloss(O.softmax(F.array("s0", "s1", "s2")), F.col("k"), F.col("w"))).alias("value")))
query("metric_multi_error", f"with {P_SQL}, t as (select *, case k when 0 then s0 when 1 then s1 else s2 end as own from p) select round(avg(case when (s0 >= own)::int + (s1 >= own)::int + (s2 >= own)::int > 1 then 1e0 else 0e0 end), 6) as value from t")(lambda spark, d: rows(spark, d).agg(r6(M.multi_error(F.array("s0", "s1", "s2"), F.col("k"))).alias("value")))
query("metric_multi_error_top2", f"with {P_SQL}, t as (select *, case k when 0 then s0 when 1 then s1 else s2 end as own from p) select round(avg(case when (s0 >= own)::int + (s1 >= own)::int + (s2 >= own)::int > 2 then 1e0 else 0e0 end), 6) as value from t")(lambda spark, d: rows(spark, d).agg(r6(M.multi_error(F.array("s0", "s1", "s2"), F.col("k"), top_k=2)).alias("value")))


def _auc_mu_sql():
    parts = []
    for i in range(3):
        for j in range(i + 1, 3):
            # the default matrix gives the partition vector -1 at i, 1 at j, so the projection is 2 * (s_i - s_j)
            parts.append(f"select round(-2e0 * (s{j} - s{i}), 12) as s, case when k = {i} then 1e0 else 0e0 end as b, {i}{j} as pair from p where k in ({i}, {j})")
    return f"with {P_SQL}, d as ({' union all '.join(parts)}), g as (select pair, s, sum(b) as pos, sum(1e0 - b) as neg from d group by all), a as (select *, coalesce(sum(pos) over (partition by pair order by s desc rows between unbounded preceding and 1 preceding), 0) as pa from g), v as (select pair, sum(neg * (pos / 2e0 + pa)) / (sum(pos) * sum(neg)) as x from a group by pair) select round(avg(x), 6) as value from v"


query("metric_auc_mu", _auc_mu_sql())(lambda spark, d: M.auc_mu(rows(spark, d).withColumn("ss", F.array("s0", "s1", "s2")), "ss", "k", 3).select(r6(F.col("value")).alias("value")))
_RANKED = f"with {P_SQL}, r as (select *, row_number() over (partition by q order by s1 desc, id) - 1 as rank, row_number() over (partition by q order by rel desc, id) - 1 as ideal from p)"
_KS = "unnest([1, 2, 3, 4, 5]) as k"


@query("metric_ndcg", f"{_RANKED}, j as (select *, unnest([1, 2, 3, 4, 5]) as n from r), t as (select q, n, sum(case when rank < n then (pow(2, rel) - 1) / log2(rank + 2e0) else 0 end) as dcg, sum(case when ideal < n then (pow(2, rel) - 1) / log2(ideal + 2e0) else 0 end) as best, avg(w) as w from j group by all) select n as k, round(sum((case when best > 0 then dcg / best else 1e0 end) * w) / sum(w), 6) as value from t group by n")
def metric_ndcg(spark, d):
    return M.ndcg(rows(spark, d), "q", "s1", "rel", "id", weight="w").select("k", r6(F.col("value")).alias("value"))


@query("metric_map", f"{_RANKED}, t as (select *, case when rel > 0.5 then 1e0 else 0e0 end as hit from r), c as (select *, sum(hit) over (partition by q order by rank) as hits from t), j as (select *, unnest([1, 2, 3, 4, 5]) as n from c), v as (select q, n, sum(hit) as pos, sum(case when rank < n and hit > 0 then hits / (rank + 1e0) else 0e0 end) as x from j group by all) select n as k, round(avg(case when pos > 0 then x / least(pos, n::double) else 1e0 end), 6) as value from v group by n")
def metric_map(spark, d):
    return M.mean_average_precision(rows(spark, d), "q", "s1", "rel", "id").select("k", r6(F.col("value")).alias("value"))


# ---- binning

MAPPER = binning.BinMapper(0, "l_discount", bounds=[0.005, 0.015, 0.035, 0.065, float("inf")], missing="nan", num_bin=6, trivial=False)
_B = "case when v is null then 5 when v <= 0.005 then 0 when v <= 0.015 then 1 when v <= 0.035 then 2 when v <= 0.065 then 3 else 4 end"


def lines(spark, d) -> DataFrame:
    t = spark.read.parquet(f"{d}/lineitem.parquet")
    return t.withColumn("v", F.nullif("l_discount", F.lit(0.0)))


@query("value_to_bin", f"select l_orderkey, l_partkey, l_linenumber, {_B} as bin from (select *, nullif(l_discount, 0e0) as v from lineitem)")
def value_to_bin(spark, d):
    return lines(spark, d).select("l_orderkey", "l_partkey", "l_linenumber", MAPPER.column(F.col("v")).alias("bin"))


@query("bin_counts", f"select {_B} as bin, count(*) as n from (select *, nullif(l_discount, 0e0) as v from lineitem) group by all")
def bin_counts(spark, d):
    return binning.bin_counts(lines(spark, d), MAPPER, F.col("v"))


@query("most_freq_bin", f"with c as (select {_B} as bin, count(*) as n from (select *, nullif(l_discount, 0e0) as v from lineitem) group by all) select bin, n from c order by n desc, bin limit 1")
def most_freq_bin(spark, d):
    return binning.most_frequent(bin_counts(spark, d))


@query("distinct_value_counts", "select l_quantity as value, count(*) as n from lineitem group by all")
def distinct_value_counts(spark, d):
    return binning.value_counts(lines(spark, d).select(F.col("l_quantity").cast("double").alias("f0"))).select(F.col("v").alias("value"), F.col("c").alias("n"))


@query("bin_bounds_few_values", "with v as (select distinct l_quantity as x from lineitem), n as (select x, lead(x) over (order by x) as y from v) select round((x + y) / 2, 6) as bound from n where y is not null union all select 1e-35")
def bin_bounds_few_values(spark, d):
    m = binning.find_mappers(lines(spark, d).select("l_quantity"), ["l_quantity"], sample=None)[0]
    return spark.createDataFrame([(round(b, 6) if b > 1e-30 else b,) for b in m.bounds if b != float("inf")], "bound double")


@query("categorical_bins", "with c as (select cast(l_suppkey % 30 as int) as cat, count(*) as n from lineitem group by all) select cat, n, row_number() over (order by n desc, cat) as bin from c")
def categorical_bins(spark, d):
    t = lines(spark, d).select((F.col("l_suppkey") % 30).cast("double").alias("cat"))
    m = binning.find_mappers(t, ["cat"], {"cat"}, sample=None)[0]
    bins = spark.createDataFrame([(c, i + 1) for i, c in enumerate(m.cats)], "cat int, bin long")
    return binning.bin_counts(t, m, F.col("cat")).withColumn("bin", F.col("bin").cast("long")).join(bins, "bin").select("cat", "n", "bin")


@query("trivial_filter", "with c as (select 'l_linenumber' as f, l_linenumber::double as v from lineitem union all select 'constant', 3e0 from lineitem union all select 'rare', case when l_orderkey = 0 then 1e0 else 0e0 end from lineitem), n as (select f, v, count(*) as n from c group by all), r as (select f, sum(n) over (partition by f order by v) as l, sum(n) over (partition by f) as t from n) select f as feature, max(case when l >= 20 and t - l >= 20 then 1 else 0 end) = 0 as trivial from r group by f")
def trivial_filter(spark, d):
    t = lines(spark, d).select(F.col("l_linenumber").cast("double"), F.lit(3.0).alias("constant"), (F.col("l_orderkey") == 0).cast("double").alias("rare"))
    found = binning.find_mappers(t, t.columns, sample=None, params={"min_data_in_leaf": 20})
    return spark.createDataFrame([(m.name, bool(m.trivial)) for m in found], "feature string, trivial boolean")


# ---- histograms and split search: gradients as longs

H_SQL = "h as (select *, cast(round((32000e0 - l_extendedprice) * 1024e0) as bigint) as g, cast(1024 as bigint) as hs, cast(trunc(l_quantity) as int) as b0, cast(round(l_discount * 100) as int) as b1, cast(round(l_tax * 100) as int) as b2 from lineitem)"
LONG_SQL = f"{H_SQL}, l as (select 0 as feature, b0 as bin, g, hs, l_linestatus from h union all select 1, b1, g, hs, l_linestatus from h union all select 2, b2, g, hs, l_linestatus from h)"
HIST_SQL = f"{LONG_SQL}, t as (select feature, bin, cast(sum(g) as bigint) as g, cast(sum(hs) as bigint) as h, count(*) as n from l group by all)"


def hrows(spark, d) -> DataFrame:
    t = spark.read.parquet(f"{d}/lineitem.parquet")
    g = histogram.fixed_point(F.lit(32000.0) - F.col("l_extendedprice"), 10)
    return t.select(g.alias("g"), F.lit(1024).cast("long").alias("hs"), F.col("l_quantity").cast("int").alias("b0"), F.round(F.col("l_discount") * 100).cast("int").alias("b1"), F.round(F.col("l_tax") * 100).cast("int").alias("b2"), (F.col("l_linestatus") == "F").cast("int").alias("leaf"), "l_returnflag")


def hist(spark, d) -> DataFrame:
    return histogram.histogram(hrows(spark, d), ["b0", "b1", "b2"], "g", "hs")


query("hist_long", f"with {HIST_SQL} select * from t")(hist)
query("hist_total", f"with {H_SQL} select cast(sum(g) as bigint) as g, cast(sum(hs) as bigint) as h, count(*) as n from h")(lambda spark, d: histogram.totals(hrows(spark, d), "g", "hs"))


@query("hist_by_leaf", f"with {LONG_SQL} select case when l_linestatus = 'F' then 1 else 0 end as leaf, feature, bin, cast(sum(g) as bigint) as g, cast(sum(hs) as bigint) as h, count(*) as n from l group by all")
def hist_by_leaf(spark, d):
    return histogram.histogram(hrows(spark, d), ["b0", "b1", "b2"], "g", "hs", "leaf")


@query("hist_subtract", f"with {LONG_SQL} select feature, bin, cast(sum(g) as bigint) as g, cast(sum(hs) as bigint) as h, count(*) as n from l where l_linestatus <> 'F' group by all")
def hist_subtract(spark, d):
    t = hrows(spark, d)
    small = histogram.histogram(t.where("leaf = 1"), ["b0", "b1", "b2"], "g", "hs")
    return histogram.subtract(histogram.histogram(t, ["b0", "b1", "b2"], "g", "hs"), small)


@query("hist_most_freq_fixup", f"with {HIST_SQL} select feature, bin, g, n from t where feature = 0 and bin = 1")
def hist_most_freq_fixup(spark, d):
    t = hrows(spark, d)
    return histogram.with_bin(histogram.histogram(t.where("b0 <> 1"), ["b0"], "g", "hs"), histogram.totals(t, "g", "hs"), 1).where("bin = 1").select("feature", "bin", "g", "n")


def _split_sql(l1=0.0, l2=0.0, min_data=1, missing="-1", monotone=0, source=HIST_SQL):
    t = lambda x: f"(sign({x}) * greatest(abs({x}) - {l1}e0, 0e0))"
    score = lambda x, h: f"{t(x)} * {t(x)} / ({h} + {l2}e0)"
    mono = "" if not monotone else f" and -{t('lg::double')} / (lh + {l2}e0) {'<=' if monotone > 0 else '>='} -{t('(tg - lg)::double')} / (th - lh + {l2}e0)"
    return f"""with {source}, c as (select feature, bin, bin = {missing} as m, sum(case when bin = {missing} then 0 else g end) over (partition by feature order by bin) as cg, sum(case when bin = {missing} then 0 else h end) over (partition by feature order by bin) as ch, sum(case when bin = {missing} then 0 else n end) over (partition by feature order by bin) as cn,
  sum(case when bin = {missing} then g else 0 end) over (partition by feature) as mg, sum(case when bin = {missing} then h else 0 end) over (partition by feature) as mh, sum(case when bin = {missing} then n else 0 end) over (partition by feature) as mn, sum(g) over (partition by feature) as tg, sum(h) over (partition by feature) as th, sum(n) over (partition by feature) as tn from t),
s as (select feature, bin, true as default_left, cg + mg as lg, ch + mh as lh, cn + mn as ln, tg, th, tn from c where not m union all select feature, bin, false, cg, ch, cn, tg, th, tn from c where not m and mn > 0),
v as (select feature, bin, default_left, {score('lg::double', 'lh')} + {score('(tg - lg)::double', '(th - lh)')} - {score('tg::double', 'th')} as gain, cast(ln as bigint) as left_n from s where ln >= {min_data} and tn - ln >= {min_data}{mono}),
r as (select *, row_number() over (partition by feature order by gain desc, default_left desc, case when default_left then -bin else bin end) as k from v)
select feature, bin, default_left, round(gain, 3) as gain, left_n from r where k = 1"""


def _best(h: DataFrame, **kw) -> DataFrame:
    return histogram.best_threshold(h, **kw).withColumn("gain", F.round("gain", 3))


query("best_split_numeric", _split_sql())(lambda spark, d: _best(hist(spark, d)))
query("best_split_regularised", _split_sql(l1=5000.0, l2=100000.0))(lambda spark, d: _best(hist(spark, d), l1=5000.0, l2=100000.0))
query("best_split_min_data", _split_sql(min_data=9000))(lambda spark, d: _best(hist(spark, d), min_data=9000))
query("best_split_monotone", _split_sql(monotone=1))(lambda spark, d: _best(hist(spark, d), monotone=1))
query("best_split_missing_dir", _split_sql(missing="0"))(lambda spark, d: _best(hist(spark, d).withColumn("miss", F.lit(0)), missing_bin="miss"))
CAT_SQL = f"{H_SQL}, t as (select case l_returnflag when 'A' then 1 when 'N' then 2 else 3 end as bin, sum(g) as g, sum(hs) as h, count(*) as n from h group by all), w as (select *, sum(g) over () as tg, sum(h) over () as th, sum(n) over () as tn from t)"


@query("best_split_cat_onehot", f"with {CAT_SQL}, v as (select bin, g::double * g / h + (tg - g)::double * (tg - g) / (th - h) - tg::double * tg / th as gain, n from w) select bin, round(gain, 3) as gain, cast(n as bigint) as left_n from v order by gain desc, bin limit 1")
def best_split_cat_onehot(spark, d):
    c = F.when(F.col("l_returnflag") == "A", 1).when(F.col("l_returnflag") == "N", 2).otherwise(3)
    x = _cat_split(hrows(spark, d).withColumn("c", c), 3)
    return spark.createDataFrame([(x.cat_bins[0], round(float(x.gain), 3), x.left_n)], "bin int, gain double, left_n long")


def _cat_split(t: DataFrame, cats: int) -> splits.Split:
    """What training's search finds in the histogram of the category c (1, 2, ...)."""
    hist = np.zeros((cats + 1, 3))
    for r in histogram.histogram(t, ["c"], "g", "hs").collect():
        hist[r.bin] = r.g, r.h, r.n
    m = binning.BinMapper(0, "c", True, cats=list(range(cats)), num_bin=cats + 1, trivial=False)
    g, h, n = hist.sum(axis=0)
    return splits.categorical_split(m, hist[:, :2], g, h, int(n), splits.Rules(), 0.0, g * g / h)


@query("best_split_cat_sorted", f"""with {H_SQL}, t as (select cast(l_suppkey % 12 as int) + 1 as bin, cast(sum(g) as double) as g, cast(sum(hs) as double) as h, count(*) as n from h group by all),
o as (select *, row_number() over (order by g / (h + 10e0), bin) as up, row_number() over (order by g / (h + 10e0) desc, bin desc) as down, sum(g) over () as tg, sum(h) over () as th, sum(n) over () as tn from t),
b as (select true as ascending, up as i, * from o union all select false, down, * from o),
c as (select ascending, i, sum(g) over w as lg, sum(h) over w as lh, cast(sum(n) over w as bigint) as ln, tg, th, tn from b window w as (partition by ascending order by i))
select cast(i as int) as categories, ln as left_n, round(lg * lg / (lh + 10e0) + (tg - lg) * (tg - lg) / (th - lh + 10e0) - tg * tg / th, 3) as gain from c where i <= (select (count(*) + 1) // 2 from t) order by gain desc, ascending desc, i limit 1""")
def best_split_cat_sorted(spark, d):
    t = spark.read.parquet(f"{d}/lineitem.parquet")
    g = histogram.fixed_point(F.lit(32000.0) - F.col("l_extendedprice"), 10)
    x = _cat_split(t.select(((F.col("l_suppkey") % 12).cast("int") + 1).alias("c"), g.alias("g"), F.lit(1024).cast("long").alias("hs")), 12)
    return spark.createDataFrame([(len(x.cat_bins), x.left_n, round(float(x.gain), 3))], "categories int, left_n long, gain double")


# ---- routing

_LK = "l_orderkey, l_partkey, l_linenumber"
query("route_numeric", f"select {_LK}, l_discount <= 0.04 as goes_left from lineitem")(lambda spark, d: lines(spark, d).select("l_orderkey", "l_partkey", "l_linenumber", routing.by_value(F.col("l_discount"), 0.04).alias("goes_left")))
query("route_missing", f"select {_LK}, case when l_discount = 0 then false else l_discount <= 0.04 end as goes_left from lineitem")(lambda spark, d: lines(spark, d).select("l_orderkey", "l_partkey", "l_linenumber", routing.by_value(F.col("v"), 0.04, "nan", False).alias("goes_left")))
query("route_zero_missing", f"select {_LK}, case when l_discount = 0 then false else l_discount <= 0.04 end as goes_left from lineitem")(lambda spark, d: lines(spark, d).select("l_orderkey", "l_partkey", "l_linenumber", routing.by_value(F.col("l_discount"), 0.04, "zero", False).alias("goes_left")))
query("route_categorical", f"select {_LK}, l_suppkey % 9 in (1, 4, 7) as goes_left from lineitem")(lambda spark, d: lines(spark, d).select("l_orderkey", "l_partkey", "l_linenumber", routing.by_category(F.col("l_suppkey") % 9, [1, 4, 7]).alias("goes_left")))
query("route_bins", f"select {_LK}, case when l_linenumber = 7 then true else l_linenumber <= 3 end as goes_left, l_linenumber in (2, 5) as in_set from lineitem")(lambda spark, d: lines(spark, d).select("l_orderkey", "l_partkey", "l_linenumber", routing.by_bin(F.col("l_linenumber"), 3, 7, True).alias("goes_left"), routing.by_bins(F.col("l_linenumber"), [0, 2, 5]).alias("in_set")))


@query("leaf_assign_depth2", f"select {_LK}, case when l_discount <= 0.04 then (case when l_quantity <= 20 then 0 else 2 end) else (case when l_tax <= 0.03 then 1 else 3 end) end as leaf from lineitem")
def leaf_assign_depth2(spark, d):
    leaf = routing.children(F.lit(0), 0, 1, routing.by_value(F.col("l_discount"), 0.04))
    leaf = routing.children(leaf, 0, 2, routing.by_value(F.col("l_quantity"), 20.0))
    leaf = routing.children(leaf, 1, 3, routing.by_value(F.col("l_tax"), 0.03))
    return lines(spark, d).select("l_orderkey", "l_partkey", "l_linenumber", leaf.alias("leaf"))


# ---- sampling


def _lcg_sql(bag: int) -> str:
    """The generator's states by recursion, from the seed of each block of 1024 rows."""
    return f"""with recursive n as (select count(*) as n from orders), b as (select distinct o_orderkey // 1024 as block from orders), z as (select block, least(1024, (select n from n) - block * 1024) as size from b),
r(block, step, x, size) as (select block, 0, (3 + block)::ubigint, size from z union all select block, step + 1, (x * 214013 + 2531011) % 4294967296, size from r where step < {bag + 1} * size)
select o_orderkey as id, ((r.x >> 16) & 32767) / 32768e0 < 0.6 as kept from orders join r on r.block = o_orderkey // 1024 and r.step = {bag} * r.size + o_orderkey % 1024 + 1"""


@query("bagging_mask", _lcg_sql(0))
def bagging_mask(spark, d):
    t = rows(spark, d)
    return t.select("id", sampling.bagging_mask(F.col("id"), 3, t.count(), 0.6).alias("kept"))


@query("bagging_mask_second_bag", _lcg_sql(1))
def bagging_mask_second_bag(spark, d):
    t = rows(spark, d)
    return t.select("id", sampling.bagging_mask(F.col("id"), 3, t.count(), 0.6, bag=1).alias("kept"))


@query("balanced_bagging", _lcg_sql(0).replace("select o_orderkey as id, ((r.x >> 16) & 32767) / 32768e0 < 0.6 as kept", "select o_orderkey as id, ((r.x >> 16) & 32767) / 32768e0 < case when o_orderpriority = '1-URGENT' then 0.9 else 0.3 end as kept"))
def balanced_bagging(spark, d):
    t = rows(spark, d)
    return t.select("id", sampling.bagging_mask(F.col("id"), 3, t.count(), 1.0, label=F.col("b"), positive=0.9, negative=0.3).alias("kept"))


@query("goss_top", f"with {P_SQL}, x as (select id, abs(s - y) as size from p), t as (select quantile_cont(size, 0.8) as t from x) select id from x, t where size >= t")
def goss_top(spark, d):
    t = rows(spark, d).withColumn("size", F.abs(F.col("s") - F.col("y")))
    return sampling.goss(t, F.col("size"), "id", 0.2, 0.1, 3).where("factor = 1.0 and sampled").select("id")


query("goss_sample")(lambda spark, d: sampling.goss(rows(spark, d), F.abs(F.col("s") - F.col("y")), "id", 0.2, 0.1, 3).where("sampled").select("id", "factor"))
query("folds", f"with {P_SQL} select cast(id % 5 as int) as fold, count(*) as n, round(sum(w), 4) as w from p group by all")(lambda spark, d: rows(spark, d).withColumn("fold", (F.col("id") % 5).cast("int")).groupBy("fold").agg(F.count("*").alias("n"), r6(F.sum("w"), 4).alias("w")))
query("fold_hash")(lambda spark, d: sampling.folds(rows(spark, d), 5, F.col("id"), by="q").groupBy("fold").agg(F.countDistinct("q").alias("queries"), F.count("*").alias("n")))


@query("row_subset", f"with {P_SQL} select id, y from p where id in (select o_orderkey from orders where o_orderstatus = 'F')")
def row_subset(spark, d):
    from .plans.engine import Dataset

    ids = spark.read.parquet(f"{d}/orders.parquet").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("id"))
    return Dataset(rows(spark, d), "y").subset(ids, "id").get_data().select("id", "y")


# ---- ranking

_Q = "e as (select user_id as q, event_id as id, value as s, case event_type when 'purchase' then 3 when 'click' then 2 when 'view' then 1 else 0 end as y from events)"


def events(spark, d) -> DataFrame:
    t = spark.read.parquet(f"{d}/events.parquet")
    y = F.when(F.col("event_type") == "purchase", 3).when(F.col("event_type") == "click", 2).when(F.col("event_type") == "view", 1).otherwise(0)
    return t.select(F.col("user_id").alias("q"), F.col("event_id").alias("id"), F.col("value").alias("s"), y.alias("y"))


@query("lambdarank_pairs", f"""with {_Q}, r as (select *, row_number() over (partition by q order by s desc, id) - 1 as r, row_number() over (partition by q order by y desc, id) - 1 as i, max(s) over (partition by q) as hi, min(s) over (partition by q) as lo from e),
m as (select q, sum((pow(2, y) - 1) / log2(i + 2e0)) as best from r where i < 30 group by q),
p as (select a.q, a.id as ia, b.id as ib, a.y > b.y as up, case when a.y > b.y then a.s - b.s else b.s - a.s end as ds, abs(pow(2, a.y) - pow(2, b.y)) * abs(1 / log2(a.r + 2e0) - 1 / log2(b.r + 2e0)) / m.best as delta, a.hi <> a.lo as spread from r a join r b on a.q = b.q and b.r > a.r and a.r < 30 and a.y <> b.y join m on m.q = a.q where m.best > 0),
d as (select q, ia, ib, up, case when spread then delta / (0.01e0 + abs(ds)) else delta end as delta, 1 / (1 + exp(greatest(least(ds, 50e0), -50e0))) as x from p),
l as (select q, ia as id, case when up then -delta * x else delta * x end as l, delta * x * (1 - x) as h, delta * x as a from d union all select q, ib, case when up then delta * x else -delta * x end, delta * x * (1 - x), delta * x from d),
u as (select q, id, sum(l) as l, sum(h) as h, sum(a) as a from l group by all), t as (select *, sum(a) over (partition by q) as t from u)
select e.q, e.id, round(coalesce(l * log2(1 + t) / t, 0), 6) + 0e0 as g, round(coalesce(h * log2(1 + t) / t, 0), 6) as h from e left join t on t.q = e.q and t.id = e.id""")
def lambdarank_pairs(spark, d):
    return ranking.lambdarank(events(spark, d), "q", "s", "y", "id").select("q", "id", (r6(F.col("g")) + 0.0).alias("g"), r6(F.col("h")).alias("h"))


query("stable_rank", f"with {_Q} select q, id, row_number() over (partition by q order by s desc, id) - 1 as rank from e")(lambda spark, d: ranking.places(events(spark, d), "q", "s", "id").select("q", "id", F.col("rank").cast("long").alias("rank")))
query("max_dcg", f"with {_Q}, r as (select *, row_number() over (partition by q order by y desc, id) - 1 as i from e) select q, round(sum((pow(2, y) - 1) / log2(i + 2e0)), 6) as max_dcg from r where i < 10 group by q")(lambda spark, d: ranking.max_dcg(events(spark, d), "q", "y", "id", 10).select("q", r6(F.col("max_dcg")).alias("max_dcg")))
query("dcg_at_k", f"with {_Q}, r as (select *, row_number() over (partition by q order by s desc, id) - 1 as i from e) select q, round(sum((pow(2, y) - 1) / log2(i + 2e0)), 6) as dcg from r where i < 10 group by q")(lambda spark, d: ranking.dcg(events(spark, d), "q", "s", "y", "id", 10).select("q", r6(F.col("dcg")).alias("dcg")))
query("position_bias_sums", f"with {_Q}, r as (select *, row_number() over (partition by q order by s desc, id) - 1 as pos from e) select cast(pos as bigint) as pos, round(sum(s - y), 4) as g, cast(sum(y) as bigint) as h, count(*) as n from r group by all")(lambda spark, d: ranking.position_sums(ranking.places(events(spark, d), "q", "s", "id", "pos").withColumn("pos", F.col("pos").cast("long")).withColumn("g", F.col("s") - F.col("y")), "pos", "g", "y").select("pos", r6(F.col("g"), 4).alias("g"), F.col("h").cast("long").alias("h"), "n"))
query("query_weights", f"with {P_SQL} select q, round(avg(w), 6) as w, count(*) as n from p group by q")(lambda spark, d: ranking.query_weights(rows(spark, d), "q", "w").withColumn("w", r6(F.col("w"))))
query("query_label_counts", f"with {_Q} select q, y, count(*) as n from e group by all")(lambda spark, d: ranking.label_counts(events(spark, d), "q", "y"))


@query("query_boundaries", "with e as (select event_id as id, event_type as q, lag(event_type) over (order by event_id) as l from events), r as (select *, sum(case when l is null or l <> q then 1 else 0 end) over (order by id) as run from e) select cast(run as bigint) as run, min(q) as query, min(id) as first, count(*) as n from r group by run")
def query_boundaries(spark, d):
    return ranking.query_boundaries(spark.read.parquet(f"{d}/events.parquet"), "event_type", "event_id")


# ---- leaves and small trees


@query("leaf_output_l1l2", f"with {H_SQL}, s as (select case when l_linestatus = 'F' then 1 else 0 end as leaf, sum(g)::double as g, sum(hs)::double as h from h group by all) select leaf, round(greatest(least(-(sign(g) * greatest(abs(g) - 1000e0, 0e0)) / (h + 500e0), 20e0), -20e0), 6) as value from s")
def leaf_output_l1l2(spark, d):
    t = histogram.totals(hrows(spark, d), "g", "hs", "leaf")
    rules = splits.Rules(l1=1000.0, l2=500.0, max_delta_step=20.0)
    return spark.createDataFrame([(r.leaf, round(float(splits.leaf_output(float(r.g), float(r.h), rules)), 6)) for r in t.collect()], "leaf int, value double")


_LEAF = "case when w <= 1 then 0 else 1 end as leaf"


def _leaves(spark, d) -> DataFrame:
    return rows(spark, d).withColumn("leaf", F.when(F.col("w") <= 1, 0).otherwise(1))


for _n, _a in (("median", 0.5), ("quantile", 0.9)):
    query(f"leaf_renew_{_n}", f"with {P_SQL} select {_LEAF}, round(quantile_cont(y - s, {_a}), 6) as value from p group by all")(lambda spark, d, a=_a: O.percentile(_leaves(spark, d).withColumn("r", F.col("y") - F.col("s")), "r", a, ["leaf"]).select("leaf", r6(F.col("result")).alias("value")))


@query("refit_leaves", f"with {P_SQL} select {_LEAF}, round(0.9e0 * 0.5e0 + (1e0 - 0.9e0) * (-sum((s - y) * w) / sum(w)) * 0.1e0, 6) as value from p group by all")
def refit_leaves(spark, d):
    from .plans.engine import refitted

    g, h = O.gradients("regression", F.col("s"), F.col("y"), F.col("w"))
    sums = _leaves(spark, d).groupBy("leaf").agg(F.sum(g.cast("double")).alias("g"), F.sum(h.cast("double")).alias("h"), F.count("*").alias("n"))
    return spark.createDataFrame([(r.leaf, round(refitted(0.5, r.g, r.h, r.n, 0.1, 0.9, splits.Rules()), 6)) for r in sums.collect()], "leaf int, value double")


query("linear_leaf_sums", f"with {P_SQL} select {_LEAF}, round(sum(s0 * s0 * w), 4) as a00, round(sum(s0 * s1 * w), 4) as a01, round(sum(s1 * s1 * w), 4) as a11, round(sum(s0 * (s - y) * w), 4) as b0, round(sum(s1 * (s - y) * w), 4) as b1, count(*) as n from p group by all")(
    lambda spark, d: rows(spark, d).withColumn("g", (F.col("s") - F.col("y")) * F.col("w")).groupBy(F.when(F.col("w") <= 1, 0).otherwise(1).alias("leaf")).agg(r6(F.sum(F.col("s0") * F.col("s0") * F.col("w")), 4).alias("a00"), r6(F.sum(F.col("s0") * F.col("s1") * F.col("w")), 4).alias("a01"), r6(F.sum(F.col("s1") * F.col("s1") * F.col("w")), 4).alias("a11"), r6(F.sum(F.col("s0") * F.col("g")), 4).alias("b0"), r6(F.sum(F.col("s1") * F.col("g")), 4).alias("b1"), F.count("*").alias("n"))
)
query("quantise_gradients", f"with {P_SQL}, m as (select max(abs(s - y)) / 2e0 as g from p) select id, cast(trunc((s - y) / g + case when s >= y then 0.5e0 else -0.5e0 end) as bigint) as q from p, m")(lambda spark, d: (lambda t, m: t.select("id", ((F.col("s") - F.col("y")) / m + F.when(F.col("s") >= F.col("y"), 0.5).otherwise(-0.5)).cast("long").alias("q")))(rows(spark, d), rows(spark, d).agg(F.max(F.abs(F.col("s") - F.col("y"))) / 2.0).first()[0]))

_STUMP = """g as (select cast(trunc(l_quantity) as int) as bin, count(*) as n, sum(cast(round(l_extendedprice * 100) as bigint)) as c from lineitem group by all), c as (select bin, sum(n) over (order by bin) as ln, sum(c) over (order by bin)::double / 100 as ls, sum(n) over () as tn, sum(c) over ()::double / 100 as ts from g),
v as (select bin, ln, ls / ln as lm, (ts - ls) / (tn - ln) as rm, ts / tn as m, (ls - ln * ts / tn) * (ls - ln * ts / tn) / ln + (ls - ln * ts / tn) * (ls - ln * ts / tn) / (tn - ln) as gain from c where ln >= 20 and tn - ln >= 20), b as (select * from v order by gain desc, bin desc limit 1)"""


def _stump(spark, d, rounds=1, leaves=2, rate=0.1):
    from .plans.engine import Dataset, train

    t = spark.read.parquet(f"{d}/lineitem.parquet").select("l_quantity", "l_extendedprice")
    return t, train({"objective": "regression", "num_leaves": leaves, "learning_rate": rate}, Dataset(t, "l_extendedprice", feature_name=["l_quantity"]), rounds)


@query("stump_train", f"with {_STUMP} select bin + 0.5 as threshold, cast(ln as bigint) as left_n, round(m + 0.1e0 * (lm - m), 1) as left_value, round(m + 0.1e0 * (rm - m), 1) as right_value from b")
def stump_train(spark, d):
    _, b = _stump(spark, d)
    t = b.trees[0]
    return spark.createDataFrame([(round(t.threshold[0], 6), t.count[0], round(t.value[0], 1), round(t.value[1], 1))], "threshold double, left_n long, left_value double, right_value double")


@query("score_stump", f"with {_STUMP} select l_orderkey, l_partkey, l_linenumber, round(case when l_quantity <= bin + 0.5 then m + 0.1e0 * (lm - m) else m + 0.1e0 * (rm - m) end, 0) as prediction from lineitem, b")
def score_stump(spark, d):
    t, b = _stump(spark, d)
    return b.predict(spark.read.parquet(f"{d}/lineitem.parquet")).select("l_orderkey", "l_partkey", "l_linenumber", F.round("prediction", 0).alias("prediction"))


FOREST = "tree\nversion=v4\nnum_class=1\nnum_tree_per_iteration=1\nlabel_index=0\nmax_feature_idx=2\nobjective=binary sigmoid:1\nfeature_names=l_quantity l_discount l_tax\nfeature_infos=[1:50] [0:0.1] [0:0.08]\ntree_sizes=1 1\n\nTree=0\nnum_leaves=3\nnum_cat=0\nsplit_feature=0 1\nsplit_gain=9 4\nthreshold=25.5 0.045\ndecision_type=2 2\nleft_child=-1 -2\nright_child=1 -3\nleaf_value=-0.25 0.125 0.5\nleaf_weight=1 1 1\nleaf_count=30 20 10\ninternal_value=0 0.25\ninternal_weight=3 2\ninternal_count=60 30\nis_linear=0\nshrinkage=1\n\n\nTree=1\nnum_leaves=2\nnum_cat=1\nsplit_feature=0\nsplit_gain=2\nthreshold=0\ndecision_type=1\nleft_child=-1\nright_child=-2\nleaf_value=0.0625 -0.03125\nleaf_weight=1 1\nleaf_count=6 54\ninternal_value=0\ninternal_weight=2\ninternal_count=60\ncat_boundaries=0 1\ncat_threshold=1048610\nis_linear=0\nshrinkage=0.5\n\n\nend of trees\n\nparameters:\nend of parameters\n"
_T0 = "case when l_quantity <= 25.5 then -0.25 when l_discount <= 0.045 then 0.125 else 0.5 end"
_T1 = "case when l_quantity in (1, 5, 20) then 0.0625 else -0.03125 end"


def forest():
    from .plans.engine import Booster

    return Booster(model_str=FOREST)


def _predicted(spark, d, **kw):
    return forest().predict(spark.read.parquet(f"{d}/lineitem.parquet"), **kw)


query("score_forest", f"select {_LK}, round({_T0}::double + {_T1}::double, 6) as raw, round(1e0 / (1e0 + exp(-({_T0}::double + {_T1}::double))), 6) as prediction from lineitem")(lambda spark, d: forest().predict(_predicted(spark, d, raw_score=True, prediction="raw")).select("l_orderkey", "l_partkey", "l_linenumber", r6(F.col("raw")).alias("raw"), r6(F.col("prediction")).alias("prediction")))
query("score_forest_arrow", f"select {_LK}, round(1e0 / (1e0 + exp(-({_T0}::double + {_T1}::double))), 6) as prediction from lineitem")(lambda spark, d: _predicted(spark, d, compiled=False).select("l_orderkey", "l_partkey", "l_linenumber", r6(F.col("prediction")).alias("prediction")))
query("leaf_index", f"select {_LK}, case when l_quantity <= 25.5 then 0 when l_discount <= 0.045 then 1 else 2 end as leaf0, case when l_quantity in (1, 5, 20) then 0 else 1 end as leaf1 from lineitem")(lambda spark, d: _predicted(spark, d, pred_leaf=True).select("l_orderkey", "l_partkey", "l_linenumber", F.col("prediction")[0].alias("leaf0"), F.col("prediction")[1].alias("leaf1")))
query("prediction_window", f"select {_LK}, round({_T1}::double, 6) as raw from lineitem")(lambda spark, d: _predicted(spark, d, raw_score=True, start_iteration=1, num_iteration=1).select("l_orderkey", "l_partkey", "l_linenumber", r6(F.col("prediction")).alias("raw")))
query("prediction_margin_stop", f"select {_LK}, round(case when 2 * abs({_T0}) > 0.3 then {_T0}::double else {_T0}::double + {_T1}::double end, 6) as raw from lineitem")(lambda spark, d: _predicted(spark, d, raw_score=True, pred_early_stop=True, pred_early_stop_freq=1, pred_early_stop_margin=0.3).select("l_orderkey", "l_partkey", "l_linenumber", r6(F.col("prediction")).alias("raw")))
query("shap_sums", f"select {_LK}, round({_T0}::double + {_T1}::double, 6) as total, round(-0.25e0 / 2 + 0.125e0 / 3 + 0.5e0 / 6 + 0.0625e0 / 10 - 0.03125e0 * 0.9, 6) as expected from lineitem")(lambda spark, d: _predicted(spark, d, pred_contrib=True).select("l_orderkey", "l_partkey", "l_linenumber", r6(F.aggregate("prediction", F.lit(0.0), lambda a, x: a + x)).alias("total"), r6(F.element_at("prediction", -1)).alias("expected")))
query("model_nodes", "select * from (values (0, '0-S0', 'l_quantity', 9e0, 60), (0, '0-S1', 'l_discount', 4e0, 30), (1, '1-S0', 'l_quantity', 2e0, 60)) t(tree_index, node_index, split_feature, split_gain, count)")(lambda spark, d: forest().trees_to_dataframe(spark).where("split_feature is not null").select("tree_index", "node_index", "split_feature", "split_gain", F.col("count").cast("int").alias("count")))


@query("model_importance", "select * from (values ('l_quantity', 2, 11e0), ('l_discount', 1, 4e0), ('l_tax', 0, 0e0)) t(feature, splits, gain)")
def model_importance(spark, d):
    b = forest()
    return spark.createDataFrame([(f, int(n), float(g)) for f, n, g in zip(b.feature_name(), b.feature_importance("split"), b.feature_importance("gain"), strict=True)], "feature string, splits int, gain double")


query("model_bounds", "select -0.25e0 - 0.03125e0 as lower, 0.5e0 + 0.0625e0 as upper")(lambda spark, d: spark.createDataFrame([(forest().lower_bound(), forest().upper_bound())], "lower double, upper double"))


@query("threshold_histogram", "select i as bucket, case when 0.045e0 between 0.045e0 - 0.5e0 + i / 3e0 and 0.045e0 - 0.5e0 + (i + 1) / 3e0 then 1 else 0 end as n, round(0.045e0 - 0.5e0 + (i + 1) / 3e0, 6) as edge from (values (0), (1), (2)) t(i)")
def threshold_histogram(spark, d):
    """Of the one numeric threshold of l_discount, over three bins."""
    n, edges = forest().get_split_value_histogram("l_discount", bins=3)
    return spark.createDataFrame([(i, int(k), round(float(e), 6)) for i, (k, e) in enumerate(zip(n, edges[1:], strict=True))], "bucket int, n int, edge double")


@query("sparse_rows", "select l_orderkey as row_id, 0 as feature, count(*) as n from lineitem where l_discount > 0 group by all union all select l_orderkey, 1, count(*) from lineitem where l_tax > 0 group by all")
def sparse_rows(spark, d):
    from .sources.matrix import to_long

    long = to_long(spark.read.parquet(f"{d}/lineitem.parquet"), "l_orderkey", ["l_discount", "l_tax"])
    return long.groupBy(F.col("l_orderkey").alias("row_id"), "feature").agg(F.count("*").alias("n"))


# ---- whole training runs: rows only


def _model_rows(spark, d, params, label="y", rounds=5, **roles):
    from .plans.engine import Dataset, train

    t = rows(spark, d)
    feats = ["s", "s0", "s1", "s2"]
    b = train(params, Dataset(t, label, feature_name=feats, **roles), rounds)
    return b.predict(t).select("id", "prediction")


for _n, (_p, _l, _r) in {
    "train_regression": ({"objective": "regression"}, "y", {}), "train_binary_weighted": ({"objective": "binary"}, "b", {"weight": "w"}), "train_multiclass": ({"objective": "multiclass", "num_class": 3}, "k", {}), "train_quantile": ({"objective": "quantile"}, "y", {}),
    "train_goss": ({"data_sample_strategy": "goss", "learning_rate": 0.5}, "y", {}), "train_dart": ({"boosting": "dart", "skip_drop": 0.0, "drop_rate": 0.4}, "y", {}), "train_forest": ({"boosting": "rf", "bagging_freq": 1, "bagging_fraction": 0.7}, "y", {}),
    "train_ranking": ({"objective": "lambdarank"}, "rel", {"group": "q"}), "train_linear_trees": ({"linear_tree": True}, "y", {}), "train_monotone": ({"monotone_constraints": [1, 0, 0, 0]}, "y", {}),
}.items():
    query(_n)(lambda spark, d, p=_p, l=_l, r=_r: _model_rows(spark, d, {**p, "num_leaves": 7}, l, 3, **r))
