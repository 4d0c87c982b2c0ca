"""Mixing sources to target weights by iterative proportional fitting.

Documents fall into cells (source, language, topic). Token totals per cell are raked until their marginals over each of
the three equal the targets; a cell's weight is its raked total over its actual one. Documents are then drawn with
probability min(1, c * weight), where c is such that the expected number of tokens is the budget (solved exactly). The
draw compares the probability with a hash of the doc_id, so it doesn't depend on partitions and can be repeated.

Documents' rows meet the cells by a join on the three names, so no doc_id is shuffled. The raking works on the cells alone,
on the driver up to MOST_CELLS of them and as DataFrame steps beyond; both give the same weights.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._store import files_for, removed, written

MARGINS = ("source", "lang", "topic")
MOST_CELLS = 200_000
#: Cells whose weights are broadcast, at most (some 100 bytes each).
SENT_CELLS = 50_000
ROUNDS = 50
#: Target shares are the actual ones raised to this power (1: as they are, 0: all equal), per margin.
TEMPER = {"source": 0.7, "lang": 0.7, "topic": 0.9}
#: Share of all tokens that is kept.
BUDGET = 0.8
SEED = 17


def topic() -> Column:
    """What a text consists of, as far as its marks tell."""
    t = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return F.when(t.contains(" | "), "table").when(t.contains("://"), "links").when(t.contains("\n"), "prose").otherwise("short")


def n_tokens() -> Column:
    """Words of a text between ASCII white space."""
    bare = F.btrim(F.coalesce(F.col("text").cast("string"), F.lit("")), F.lit(" \t\n\x0b\x0c\r"))
    return F.when(bare == "", F.lit(0)).otherwise(F.regexp_count(bare, F.lit("[\\x20\\x09-\\x0D]+")) + 1).cast("long")


def tempered(totals: dict, power: float) -> dict:
    """Shares in proportion to the totals raised to a power; what has no tokens has no share."""
    up = {k: float(v) ** power for k, v in totals.items() if v}
    s = sum(up.values())
    return {k: up[k] / s if k in up else 0.0 for k in totals}


def rake(codes: np.ndarray, totals: np.ndarray, targets: list[np.ndarray], rounds: int = ROUNDS, within: float = 1e-9) -> np.ndarray:
    """Raked totals of cells. codes: cells x margins; targets: for each margin the share of each code. They sum to the sum of totals."""
    x = totals.astype(float)
    goal = x.sum()
    for _ in range(rounds):
        off = 0.0
        for m, share in enumerate(targets):
            now = np.bincount(codes[:, m], x, len(share))
            f = np.divide(share * goal, now, out=np.ones(len(share)), where=now > 0)
            off = max(off, float(np.abs(now - share * goal).max(initial=0.0)))
            x = x * f[codes[:, m]]
        if off <= within * max(goal, 1):
            break
    return x


def rake_frame(cells: DataFrame, targets: dict[str, dict], rounds: int = ROUNDS, within: float = 1e-9) -> DataFrame:
    """The same for cells (the margins, tokens, raked) that are too many for the driver: each step is a sum per name and a join with it."""
    spark = cells.sparkSession
    goal = cells.agg(F.sum("tokens")).first()[0] or 0
    shares = {}
    for m in MARGINS:  # of the names that there are
        share = spark.createDataFrame([(k, float(v)) for k, v in targets[m].items()], f"{m} string, share double")
        share = cells.select(m).distinct().join(share, m, "left").select(m, F.coalesce("share", F.lit(0.0)).alias("share"))
        total = share.agg(F.sum("share")).first()[0] or 1.0
        shares[m] = written(share.withColumn("share", F.col("share") / F.lit(total)))
    first = cells
    for _ in range(rounds):
        off = 0.0
        for m in MARGINS:
            now = written(cells.groupBy(m).agg(F.sum("raked").alias("now")).join(shares[m], m))
            off = max(off, now.agg(F.max(F.abs(F.col("now") - F.col("share") * goal))).first()[0] or 0.0)
            f = now.select(m, F.when(F.col("now") > 0, F.col("share") * goal / F.col("now")).otherwise(1.0).alias("f"))
            old, cells = cells, written(cells.join(f, m).withColumn("raked", F.col("raked") * F.col("f")).drop("f"))  # used twice by the next step
            removed(now, *([old] if old is not first else []))
        if off <= within * max(goal, 1):
            break
    removed(*shares.values())
    return cells


def scale_for(weights: np.ndarray, tokens: np.ndarray, budget: float) -> float:
    """c such that sum(tokens * min(1, c * weight)) = budget; infinity if all tokens don't reach it."""
    order = np.argsort(-weights)
    w, t = weights[order], tokens[order].astype(float)
    full = np.concatenate([[0.0], np.cumsum(t)])  # the k largest weights are capped
    rest = np.append(np.cumsum((w * t)[::-1])[::-1], 0.0)
    if budget >= full[-1]:
        return float("inf")
    for k in range(len(w)):
        if rest[k] > 0:
            c = (budget - full[k]) / rest[k]
            if c * w[k] <= 1:
                return max(c, 0.0)
    return float("inf")


def mix(docs: DataFrame, targets: dict[str, dict] | None = None, budget: float = BUDGET, seed: int = SEED, topic: Column | None = None, most_cells: int = MOST_CELLS, carry: list[str] | None = None) -> DataFrame:
    """(doc_id, source, lang, topic, n_tokens, weight, probability, selected[, row]) for each row of docs (doc_id, text, source, lang; further columns don't matter).

    targets: for each margin, name -> share (names left out: 0; shares count relative to those of the names that have rows);
    by default the actual shares, tempered. Null names count as ''. Where targets and data exclude each other (a share for
    a name without tokens) raking comes as near as it gets. Cells without tokens have weight 1. Rows that repeat a doc_id
    are drawn together; rows without one are drawn by their text (null: empty), equal ones together. An empty table gives an empty one.
    row: the columns that carry names, as a struct.
    """
    spark = docs.sparkSession
    name = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    id_, text = F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit(""))
    draw = F.shiftrightunsigned(F.xxhash64(F.coalesce(id_, F.xxhash64(text)), F.lit(seed)), 11) / F.lit(float(2**53))
    more = [F.struct(*[F.col(f"`{c}`") for c in carry]).alias("row")] if carry else []
    rows = written(docs.select(id_.alias("doc_id"), draw.alias("draw"), name("source").alias("source"), name("lang").alias("lang"), (globals()["topic"]() if topic is None else topic).alias("topic"), n_tokens().alias("n_tokens"), *more), files_for(docs, 16 << 20))
    cells = written(rows.groupBy(*MARGINS).agg(F.sum("n_tokens").alias("tokens")), files_for(docs, 256 << 20))
    shares = targets or {}
    for m in MARGINS:
        if m not in shares:  # as many as names; the cells' bound holds for them too
            totals = {r[m]: r.t for r in cells.groupBy(m).agg(F.sum("tokens").alias("t")).toLocalIterator()}
            shares = shares | {m: tempered(totals, TEMPER[m])}
    n = cells.count()
    if n <= most_cells:
        got = cells.orderBy(*MARGINS).toPandas()
        codes, goals = [], []
        for m in MARGINS:
            names = sorted(set(got[m]))
            at = {x: i for i, x in enumerate(names)}
            codes.append([at[x] for x in got[m]])
            share = np.array([shares[m].get(x, 0.0) for x in names])
            goals.append(share / share.sum() if share.sum() else share)
        tokens = got["tokens"].to_numpy(np.float64)
        raked = rake(np.array(codes, np.int64).reshape(3, -1).T, tokens, goals)
        weight = np.divide(raked, tokens, out=np.ones(len(tokens)), where=tokens > 0)
        c = scale_for(weight, tokens, budget * tokens.sum())
        table = [(*x, float(w)) for x, w in zip(got[list(MARGINS)].itertuples(index=False), weight, strict=True)]
        weights = spark.createDataFrame(table, "source string, lang string, topic string, weight double")
    else:
        r = rake_frame(cells.withColumn("raked", F.col("tokens").cast("double")), shares)
        weights = written(r.select(*MARGINS, "tokens", F.when(F.col("tokens") > 0, F.col("raked") / F.col("tokens")).otherwise(1.0).alias("weight")))
        c = _scale_frame(weights, budget)
        weights = weights.drop("tokens")
    weights = F.broadcast(weights) if n <= SENT_CELLS else weights
    p = F.lit(1.0) if c == float("inf") else F.least(F.lit(1.0), F.col("weight") * F.lit(c))
    out = rows.join(weights, list(MARGINS)).withColumn("probability", p)
    return out.select("doc_id", *MARGINS, "n_tokens", "weight", "probability", (F.col("draw") < F.col("probability")).alias("selected"), *(["row"] if carry else []))


def _scale_frame(weights: DataFrame, budget: float) -> float:
    """c by bisection, one aggregate a step."""
    total = weights.agg(F.sum("tokens")).first()[0] or 0
    if budget >= 1:
        return float("inf")
    lo, hi = 0.0, 1.0
    kept = lambda c: weights.agg(F.sum(F.col("tokens") * F.least(F.lit(1.0), F.col("weight") * F.lit(c)))).first()[0] or 0.0
    while kept(hi) < budget * total and hi < 1e12:
        lo, hi = hi, hi * 2
    for _ in range(50):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if kept(mid) < budget * total else (lo, mid)
    return hi


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the rows that are drawn, with all their columns, whatever their names. Rows that repeat a doc_id are
    drawn together, and rows without one by their text; null and empty texts have no tokens and are drawn like others of their cell. An empty table gives an empty one."""
    return mix(docs, carry=docs.columns).where("selected").select(*[F.col("row")[c].alias(c) for c in docs.columns])
