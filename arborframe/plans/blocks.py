"""Training rows as blocks: one DataFrame row holds some thousands of rows' bins, labels and scores as byte arrays.

A training job is one pass of mapInArrow over the cached blocks. Each partition adds its blocks' histograms, as integers,
into one array per (class, leaf); where all of them together are small they go to the driver as they are, else they are summed by
an aggregation first. Gradients, bagging and leaf membership are worked out again in each pass from the scores and the
trees since: cheaper than writing them, and there is no state that a lost executor could lose. Ranking losses are the exception:
their gradients, which cost more than a pass, are worked out once an iteration and cached with the bins (`graded`).

A query is in one block, unless it has over WIDE rows: then its rows are dealt out in blocks that have no other query's, and its gradients
come from the places of its rows, found by a sort over all tasks, and from sums over its blocks.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

from ..operators import losses
from ..operators.binning import BinMapper
from ..operators.sampling import Mersenne
from ..operators.tree import Tree

BLOCK = 1 << 15
#: Bytes of partial histograms that may go to the driver unsummed.
DIRECT = 64 << 20
#: A query of more rows is dealt out.
WIDE = 8 * BLOCK
#: wide: the id of the query of which the block has some rows (else null); rank: their places in it; g, h: gradients, where they are kept.
SQL = "block long, n int, bins binary, y binary, w binary, s binary, q binary, pos binary, raw binary, wide long, rank binary, g binary, h binary"
_NAMES = ["block", "n", "bins", "y", "w", "s", "q", "pos", "raw", "wide", "rank", "g", "h"]
_TYPES = [pa.int64(), pa.int32(), *[pa.binary()] * 7, pa.int64(), *[pa.binary()] * 3]
RANKING = ("lambdarank", "rank_xendcg")


def pack(mappers: list[BinMapper], roles: dict, classes: int, raw: int, dealt: bool = False):
    """Rows (f0, f1, ..., label, weight, init, query, position) to blocks. Rows of a query must be consecutive; a block has whole queries or, if
    they are dealt out, those rows of one query that have the block's number as their last column, piece."""
    wide = any(m.num_bin > 256 for m in mappers)
    cell = max(8 * classes, len(mappers) * (2 if wide else 1), 8 * raw)  # bytes that a row adds to a block's largest array

    def flush(parts: list[pa.RecordBatch], block: int) -> pa.RecordBatch:
        t = pa.Table.from_batches(parts).combine_chunks()
        get = lambda c: np.asarray(t.column(c).combine_chunks().fill_null(float("nan")), np.float64)
        values = [get(f"f{m.feature}") for m in mappers]
        bins = np.stack([m.bins(v) for m, v in zip(mappers, values, strict=True)]) if mappers else np.zeros((0, t.num_rows))
        out = [block, t.num_rows, bins.astype(np.uint16 if wide else np.uint8).tobytes()]
        safe = lambda x, top: np.clip(np.nan_to_num(x, nan=0.0, posinf=top, neginf=-top), -top, top)
        out.append(safe(get("label"), 1e38).astype(np.float32).tobytes())
        out.append(safe(get("weight"), 1e38).astype(np.float32).tobytes() if roles.get("weight") else None)
        s = np.zeros((classes, t.num_rows))
        if roles.get("init_score"):
            init = np.array(t.column("init").to_pylist(), np.float64).reshape(t.num_rows, -1).T
            s = np.clip(np.nan_to_num(init, nan=0.0), -1e300, 1e300) + s
        out.append(s.tobytes())
        if roles.get("group"):
            ids = np.asarray(t.column("query").combine_chunks())
            out.append(np.append(np.flatnonzero(np.concatenate([[True], ids[1:] != ids[:-1]])), len(ids)).astype(np.int64).tobytes())
        else:
            out.append(None)
        out.append(np.asarray(t.column("position").combine_chunks()).astype(np.int64).tobytes() if roles.get("position") else None)
        if raw:
            width = raw
            x = np.stack([get(f"f{i}") for i in range(width)], axis=1)
            out.append(x.tobytes())
        else:
            out.append(None)
        out += [int(ids[0]) if dealt else None, None, None, None]
        return pa.RecordBatch.from_arrays([pa.array([v], ty) for v, ty in zip(out, _TYPES, strict=True)], _NAMES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        base, number = TaskContext.get().partitionId() << 32, 0
        by = "piece" if dealt else "query"
        name = lambda: held[0].column(held[0].schema.get_field_index(by))[0].as_py() if dealt else base + number
        held: list[pa.RecordBatch] = []
        rows = 0
        for batch in batches:
            while batch.num_rows:
                cut = max(BLOCK - rows, 0)
                if roles.get("group"):  # to the end of the query, which may have begun in an earlier batch
                    ids = np.asarray(batch.column(batch.schema.get_field_index(by)))
                    last = held[-1].column(held[-1].schema.get_field_index(by))[-1].as_py() if held else ids[0]
                    cut = 0 if dealt else cut
                    ends = np.flatnonzero(ids[cut:] != np.append(last, ids[:-1])[cut:])
                    cut = cut + int(ends[0]) if len(ends) else batch.num_rows + 1
                if batch.num_rows < cut:
                    held.append(batch)
                    rows += batch.num_rows
                    if rows * cell >= 1 << 31:
                        raise ValueError("a query has too many rows for one block, which a custom objective needs")
                    break
                if cut:
                    held.append(batch[:cut])
                yield flush(held, name())
                held, rows, number, batch = [], 0, number + 1, batch[cut:]
        if rows:
            yield flush(held, name())

    return run


@dataclass
class Job:
    """What a pass needs to know."""

    mappers: list[BinMapper]
    objective: str
    params: dict
    classes: int
    pending: list[tuple[int, Tree]] = field(default_factory=list)  # (class, tree) not yet in the blocks' scores
    constant: list[float] = field(default_factory=list)  # added to the scores
    iteration: int = 0
    sampling: dict = field(default_factory=dict)
    bits: tuple[int, int] = (30, 30)
    fobj: object = None
    bias: dict | None = None  # position -> score bias
    fixed: list[float] | None = None  # scores at which gradients are taken (random forest)
    heads: dict | None = None  # query that is dealt out -> what its blocks must know of it

    def __post_init__(self):
        self.at = {m.feature: i for i, m in enumerate(self.mappers)}
        self.by_feature = {m.feature: m for m in self.mappers}

    def open(self, row: dict) -> Rows:
        return Rows(self, row)


class Rows:
    """One block, opened."""

    def __init__(self, job: Job, row: dict):
        self.job, self.n, self.block = job, row["n"], row["block"]
        f = len(job.mappers)
        raw = row["bins"]
        self.bins = np.frombuffer(raw, np.uint16 if f and len(raw) == 2 * f * self.n else np.uint8).reshape(f, self.n)
        self.y = np.frombuffer(row["y"], np.float32)
        self.w = np.frombuffer(row["w"], np.float32) if row["w"] is not None else None
        self.q = np.frombuffer(row["q"], np.int64) if row["q"] is not None else None
        self.pos = np.frombuffer(row["pos"], np.int64) if row["pos"] is not None else None
        self.x = np.frombuffer(row["raw"], np.float64).reshape(self.n, -1) if row["raw"] is not None else None
        self.base = np.frombuffer(row["s"], np.float64).reshape(job.classes, self.n) if row["s"] is not None else None
        self.wide = row["wide"]
        self.rank = np.frombuffer(row["rank"], np.int64) if row["rank"] is not None else None
        self.kept = tuple(np.frombuffer(row[c], np.float32).reshape(job.classes, self.n) for c in "gh") if row["g"] is not None else None
        self.ids = np.int64((self.block * 0x9E3779B97F4A7C15 + 2**63) % 2**64 - 2**63) + np.arange(self.n)  # blocks of any number of partitions keep apart

    def scores(self) -> np.ndarray:
        s = self.base.copy()
        if self.job.constant:
            s += np.array(self.job.constant)[:, None]
        for k, t in self.job.pending:
            s[k] += t.outputs(self.leaves(t), self.x)
        return s

    def leaves(self, tree: Tree) -> np.ndarray:
        return tree.leaf_of_bins(self.bins, self.job.by_feature, self.job.at)

    def current(self) -> np.ndarray:
        """The scores at which gradients are taken."""
        j = self.job
        return np.repeat(np.array(j.fixed)[:, None], self.n, axis=1) if j.fixed is not None else self.scores()

    def bias(self) -> np.ndarray | None:
        j = self.job
        return None if j.bias is None or self.pos is None else np.array([j.bias.get(int(p), 0.0) for p in self.pos])

    def queries(self) -> np.ndarray:
        """A number for each query: its first row's, or its id if it is dealt out."""
        return self.ids[self.q[:-1]] if self.wide is None else np.array([self.wide])

    def gradients(self) -> tuple[np.ndarray, np.ndarray]:
        if self.kept is not None:
            return self.kept
        j = self.job
        if self.wide is not None and j.fobj is not None:
            raise ValueError("a custom objective needs whole queries: construct the Dataset with objective='custom' in its params")
        if self.wide is not None and losses.canonical(j.objective) in RANKING:
            g, h = self.part(j.heads[self.wide])
            if self.w is not None:
                g, h = g * self.w, h * self.w
            return g[None].astype(np.float32), h[None].astype(np.float32)
        s = self.current()
        if j.fobj is not None:
            g, h = j.fobj(s if j.classes > 1 else s[0], self.y, self.w, self.q)
            return np.asarray(g, np.float32).reshape(j.classes, self.n), np.asarray(h, np.float32).reshape(j.classes, self.n)
        y = self.y.astype(np.float64)
        if j.params.get("reg_sqrt") and j.objective in ("regression", "regression_l1", "huber", "fair", "quantile", "mape"):
            y = losses.sgn(y) * np.sqrt(np.abs(y))
        return losses.gradients(j.objective, s, y, self.w, j.params, self.q, self.ids, j.iteration, self.bias())

    def ranked(self) -> np.ndarray:
        """The scores that a ranking loss compares."""
        s, bias = self.current()[0], self.bias()
        return (s if bias is None else s + bias) + 0.0  # no -0.0, which a sort may put behind 0.0

    def part(self, head):
        """A ranking loss on rows of one query that has others in other blocks."""
        j = self.job
        if losses.canonical(j.objective) == "lambdarank":
            return losses.lambdarank_part(self.ranked(), self.y, self.rank, head, j.params)
        return losses.xendcg_part(self.ranked(), self.y, losses.uniform(self.ids, losses.draw(j.params, j.iteration)), head)

    def sampled(self, g: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray | None]:
        """Gradients and hessians with the sampling's factors, and which rows are in (None: all)."""
        p = self.job.sampling
        if not p:
            return g, h, None
        if p["kind"] == "goss":
            size = np.abs(g * h).sum(axis=0)
            top = size >= p["threshold"]
            other = ~top & (losses.uniform(self.ids, p["seed"]) < p["rate"])
            f = np.where(top, 1.0, p["factor"]).astype(np.float32)
            return g * f, h * f, top | other
        if p["kind"] == "query" and self.q is not None:
            keep = np.repeat(losses.uniform(self.queries(), p["seed"]) < p["fraction"], np.diff(self.q))
        elif p["kind"] == "balanced":
            keep = losses.uniform(self.ids, p["seed"]) < np.where(self.y > 0, p["positive"], p["negative"])
        else:
            keep = losses.uniform(self.ids, p["seed"]) < p["fraction"]
        return g, h, keep


def _opened(job: Job, batches: Iterator[pa.RecordBatch]) -> Iterator[Rows]:
    for batch in batches:
        for row in batch.to_pylist():
            yield job.open(row)


def quantised(job: Job, g: np.ndarray, h: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gradients in a few integer steps (use_quantized_grad), if the job asks for it."""
    q = job.params.get("quant_scale")
    if not q:
        return g, h
    gs, hs = q
    if job.params.get("stochastic_rounding", True):
        # a generator for each block, named by its first row, and iteration: the same draws in each pass and when a block is made again
        first = int(losses.uniform(ids[:1], 99991 + job.iteration)[0] * 2**32) if len(ids) else 0
        u, v = Mersenne(first).uniform(2 * len(ids)).reshape(2, -1)
        return ((np.trunc(g / gs + np.where(g >= 0, u, -u))) * gs).astype(np.float32), ((np.floor(h / hs + v)) * hs).astype(np.float32)
    return (np.rint(g / gs) * gs).astype(np.float32), (np.rint(h / hs) * hs).astype(np.float32)


def histograms(blocks: DataFrame, job: Job, wanted: list[tuple[int, Tree, list[int]]], parts: int) -> dict[tuple[int, int], np.ndarray]:
    """{(class, leaf): features x bins x (g, h, count)}, for each (class, tree so far, leaves)."""
    f, b = len(job.mappers), max([m.num_bin for m in job.mappers], default=1)
    keys = [(k, leaf) for k, _, leaves in wanted for leaf in leaves]
    size = f * b * 3 * 8 * len(keys)

    def run(batches):
        total = np.zeros((len(keys), f, b, 3), np.int64)
        any_ = False
        gb, hb = 2.0 ** job.bits[0], 2.0 ** job.bits[1]
        for rows in _opened(job, batches):
            any_ = True
            g, h, keep = rows.sampled(*rows.gradients())
            g, h = quantised(job, g, h, rows.ids)
            base = 0
            for k, tree, leaves in wanted:
                slot, own = None, None if keep is None else np.flatnonzero(keep)
                if tree.feature:  # the place of each row's leaf among those wanted
                    place = np.full(tree.leaves, -1, np.int64)
                    place[leaves] = np.arange(len(leaves))
                    slot = place[rows.leaves(tree)]
                    own = np.flatnonzero(slot >= 0 if keep is None else (slot >= 0) & keep)
                    slot = slot[own] * b
                gi, hi = np.rint(g[k] * gb), np.rint(h[k] * hb)
                gi, hi = (gi, hi) if own is None else (gi[own], hi[own])
                t, n = total[base : base + len(leaves)], len(leaves) * b
                for i in range(f):  # all leaves in one count
                    c = rows.bins[i] if own is None else rows.bins[i][own]
                    c = c if slot is None else slot + c
                    t[:, i, :, 0] += np.bincount(c, gi, n).astype(np.int64).reshape(-1, b)
                    t[:, i, :, 1] += np.bincount(c, hi, n).astype(np.int64).reshape(-1, b)
                    t[:, i, :, 2] += np.bincount(c, minlength=n).reshape(-1, b)
                base += len(leaves)
        if any_:
            ks, xs = zip(*keys, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(ks, pa.int32()), pa.array(xs, pa.int32()), pa.array([v.tobytes() for v in total], pa.binary())], ["k", "leaf", "v"])

    out = blocks.mapInArrow(run, "k int, leaf int, v binary")
    if size * parts > DIRECT:

        def add(table: pa.Table) -> pa.Table:
            v = sum(np.frombuffer(x.as_py(), np.int64) for x in table.column("v"))
            return pa.table({"k": table.column("k")[:1], "leaf": table.column("leaf")[:1], "v": pa.array([v.tobytes()], pa.binary())})

        groups = max(2, int(parts**0.5))
        out = out.withColumn("p", F.pmod(F.xxhash64("v"), F.lit(groups))).groupBy("p", "k", "leaf").applyInArrow(add, "k int, leaf int, v binary")
    got: dict[tuple[int, int], np.ndarray] = {}
    for r in out.collect():
        v = np.frombuffer(r.v, np.int64).reshape(f, b, 3)
        key = (r.k, r.leaf)
        got[key] = got[key] + v if key in got else v
    return {key: got.get(key, np.zeros((f, b, 3), np.int64)) for key in keys}


def _one(**cells) -> pa.RecordBatch:
    """A row of (type, value) cells."""
    return pa.RecordBatch.from_arrays([pa.array([v], ty) for ty, v in cells.values()], list(cells))


_LONG, _DOUBLE, _DOUBLES = pa.int64(), pa.float64(), pa.list_(pa.float64())


def _merged(parts: DataFrame, add, schema: str) -> DataFrame:
    """One row for each query from those of its blocks, in the blocks' order."""
    return parts.groupBy("wide").applyInArrow(lambda t: pa.Table.from_batches([add(t.sort_by("block").to_pylist())]), schema)


def _places(wide: DataFrame, job: Job) -> tuple[DataFrame, list[DataFrame]]:
    """The blocks with the places of their rows in their queries, by descending score, and what is cached for that. A sort over all tasks; the driver
    gets the number of rows of each query in each range."""

    def rows(batches):
        for r in _opened(job, batches):
            yield pa.RecordBatch.from_arrays([pa.array(np.full(r.n, r.wide)), pa.array(r.ranked()), pa.array(np.full(r.n, r.block)), pa.array(np.arange(r.n, dtype=np.int32))], ["wide", "s", "block", "i"])

    order = ["wide", F.col("s").desc(), "block", "i"]
    n = int(wide.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranges = wide.mapInArrow(rows, "wide long, s double, block long, i int").repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("p", F.spark_partition_id()).persist(StorageLevel.MEMORY_AND_DISK)
    before, start = {}, {}
    for r in sorted(ranges.groupBy("p", "wide").agg(F.count("*").alias("rows")).collect(), key=lambda r: r.p):
        start[r.p, r.wide] = before.get(r.wide, 0)
        before[r.wide] = start[r.p, r.wide] + r.rows

    def number(batches):
        at = {}
        for batch in batches:
            p, q = (np.asarray(batch.column(batch.schema.get_field_index(c))) for c in ("p", "wide"))
            edges = np.append(np.flatnonzero(np.append(True, (p[1:] != p[:-1]) | (q[1:] != q[:-1]))), len(p))
            rank = np.empty(len(p), np.int64)
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                key = (int(p[a]), int(q[a]))
                first = at.get(key, start[key])
                rank[a:b] = np.arange(first, first + b - a)
                at[key] = first + b - a
            yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index("block")), batch.column(batch.schema.get_field_index("i")), pa.array(rank)], ["block", "i", "rank"])

    def collected(t: pa.Table) -> pa.Table:
        rank = np.empty(t.num_rows, np.int64)
        rank[np.asarray(t.column("i").combine_chunks())] = np.asarray(t.column("rank").combine_chunks())
        return pa.table({"block": t.column("block")[:1], "rank": pa.array([rank.tobytes()], pa.binary())})

    ranks = ranges.mapInArrow(number, "block long, i int, rank long").groupBy("block").applyInArrow(collected, "block long, rank binary")
    out = wide.drop("rank").join(ranks, "block").select(*_NAMES).persist(StorageLevel.MEMORY_AND_DISK)
    return out, [ranges, out]


def _lambdarank_heads(wide: DataFrame, job: Job) -> dict:
    """For each query its first rows, the greatest DCG and the sums that its first rows get from all blocks: some KB a query."""
    cut, norm = job.params.get("lambdarank_truncation_level", 30), job.params.get("lambdarank_norm", True)
    gains = losses.label_gains(job.params)

    def tops(batches):
        for r in _opened(job, batches):
            s, gain = r.ranked(), np.sort(gains[r.y.astype(np.int64)])[::-1][:cut]
            own = np.flatnonzero(r.rank < cut)
            yield _one(wide=(_LONG, r.wide), block=(_LONG, r.block), rank=(_DOUBLES, r.rank[own].astype(float)), s=(_DOUBLES, s[own]), y=(_DOUBLES, r.y[own].astype(float)), gain=(_DOUBLES, gain), low=(_DOUBLE, s.min()))

    def first(parts: list[dict]) -> pa.RecordBatch:
        rank, s, y, gain = (np.concatenate([x[c] for x in parts]) for c in ("rank", "s", "y", "gain"))
        order, best = np.argsort(rank), np.sort(gain)[::-1][:cut]
        s, y = s[order], y[order]
        best = float((best * losses._discount(np.arange(len(best)))).sum())
        return _one(wide=(_LONG, parts[0]["wide"]), s=(_DOUBLES, s), y=(_DOUBLES, y), best=(_DOUBLE, best), spread=(pa.bool_(), bool(norm and len(s) and s[0] != min(x["low"] for x in parts))))

    r = _merged(wide.mapInArrow(tops, "wide long, block long, rank array<double>, s array<double>, y array<double>, gain array<double>, low double"), first, "wide long, s array<double>, y array<double>, best double, spread boolean").collect()
    heads = {x.wide: {"s": np.array(x.s), "y": np.array(x.y, np.float32), "best": x.best, "spread": x.spread} for x in r}
    known = replace(job, heads=heads)

    def sums(batches):
        for r in _opened(known, batches):
            g, h, total = r.part(heads[r.wide])
            yield _one(wide=(_LONG, r.wide), block=(_LONG, r.block), g=(_DOUBLES, g), h=(_DOUBLES, h), total=(_DOUBLE, total))

    def add(parts: list[dict]) -> pa.RecordBatch:
        return _one(wide=(_LONG, parts[0]["wide"]), **{c: (_DOUBLES, np.sum([x[c] for x in parts], axis=0)) for c in "gh"}, total=(_DOUBLE, sum(x["total"] for x in parts)))

    for x in _merged(wide.mapInArrow(sums, "wide long, block long, g array<double>, h array<double>, total double"), add, "wide long, g array<double>, h array<double>, total double").collect():
        heads[x.wide] |= {"g": np.array(x.g), "h": np.array(x.h), "total": x.total}
    return heads


def _xendcg_heads(wide: DataFrame, job: Job) -> dict:
    """For each query the five numbers that its rows' gradients need, in four passes."""
    heads: dict[int, list[float]] = {}
    for i in range(4):

        def sums(batches):
            for r in _opened(job, batches):
                yield _one(wide=(_LONG, r.wide), block=(_LONG, r.block), v=(_DOUBLES, r.part(heads.get(r.wide, []))))

        def add(parts: list[dict], greatest: bool = i == 0) -> pa.RecordBatch:
            return _one(wide=(_LONG, parts[0]["wide"]), v=(_DOUBLES, (np.max if greatest else np.sum)([x["v"] for x in parts], axis=0)))

        for x in _merged(wide.mapInArrow(sums, "wide long, block long, v array<double>"), add, "wide long, v array<double>").collect():
            heads[x.wide] = [*heads.get(x.wide, []), *x.v]
    return heads


def graded(blocks: DataFrame, job: Job, dealt: bool) -> tuple[DataFrame, list[DataFrame]]:
    """The blocks with gradients and hessians of a ranking loss in the place of scores, cached, and what else is cached until they are there. dealt: whether queries are dealt out."""

    def grade(job):
        def run(batches):
            for batch in batches:
                got = [job.open(r).gradients() for r in batch.to_pylist()]
                new = {"g": [g.tobytes() for g, _ in got], "h": [h.tobytes() for _, h in got], "s": [None] * len(got), "rank": [None] * len(got)}
                for c, v in new.items():
                    batch = batch.set_column(batch.schema.get_field_index(c), c, pa.array(v, pa.binary()))
                yield batch

        return run

    own, temporary = blocks, []
    if dealt:
        wide = blocks.where("wide is not null")
        own = blocks.where("wide is null")
        if losses.canonical(job.objective) == "lambdarank":
            wide, temporary = _places(wide, job)
        heads = (_lambdarank_heads if losses.canonical(job.objective) == "lambdarank" else _xendcg_heads)(wide, job)
    out = own.mapInArrow(grade(job), SQL)
    if dealt:
        out = out.union(wide.mapInArrow(grade(replace(job, heads=heads)), SQL))
    return out.persist(StorageLevel.MEMORY_AND_DISK), temporary


def summary(blocks: DataFrame, job: Job) -> dict:
    """Largest gradient and hessian, their sums per class, rows; one row per partition goes to the driver."""

    def run(batches):
        n, g0, h0 = 0, np.zeros(job.classes), np.zeros(job.classes)
        gs, hs = np.zeros(job.classes), np.zeros(job.classes)
        for rows in _opened(job, batches):
            g, h = rows.gradients()
            n += rows.n
            g0, h0 = np.maximum(g0, np.abs(g).max(axis=1, initial=0)), np.maximum(h0, np.abs(h).max(axis=1, initial=0))
            gs, hs = gs + g.sum(axis=1, dtype=np.float64), hs + h.sum(axis=1, dtype=np.float64)
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), *(pa.array([x.tolist()], pa.list_(pa.float64())) for x in (g0, h0, gs, hs))], ["n", "g", "h", "gs", "hs"])

    r = blocks.mapInArrow(run, "n long, g array<double>, h array<double>, gs array<double>, hs array<double>").collect()
    stack = lambda c: np.array([x[c] for x in r]).reshape(len(r), job.classes)
    return {"n": sum(x["n"] for x in r), "g": float(stack("g").max(initial=0)), "h": float(stack("h").max(initial=0)), "gs": stack("gs").sum(axis=0), "hs": stack("hs").sum(axis=0)}


def goss_threshold(blocks: DataFrame, job: Job, share: float, n: int) -> float:
    """A value that the `share` of rows with the largest sum of |g h| reach, from the counts of the upper 16 bits of the floats: all rows in the last bucket are in."""

    def run(batches):
        counts = np.zeros(1 << 16, np.int64)
        for rows in _opened(job, batches):
            g, h = rows.gradients()
            counts += np.bincount(np.abs(g * h).sum(axis=0).astype(np.float32).view(np.uint32) >> 16, minlength=1 << 16)
        b = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(b.astype(np.int32)), pa.array(counts[b])], ["b", "c"])

    total = np.zeros(1 << 16, np.int64)
    for r in blocks.mapInArrow(run, "b int, c long").groupBy("b").agg(F.sum("c").alias("c")).collect():  # 65,536 rows at most
        total[r.b] = r.c
    above = np.cumsum(total[::-1])[::-1]
    i = int(np.flatnonzero(above >= max(1, int(share * n)))[-1])
    return float(np.array([i << 16], np.uint32).view(np.float32)[0])


def leaf_values(blocks: DataFrame, job: Job, trees: list[tuple[int, Tree]]) -> DataFrame:
    """(k, leaf, r, w) for each in-bag row: residual y - score and weight, for leaf renewal by percentiles."""

    def run(batches):
        for rows in _opened(job, batches):
            g, h = rows.gradients()
            _, _, keep = rows.sampled(g, h)
            s = rows.scores() if job.fixed is None else np.repeat(np.array(job.fixed)[:, None], rows.n, axis=1)
            y = rows.y.astype(np.float64)
            if job.params.get("reg_sqrt"):
                y = losses.sgn(y) * np.sqrt(np.abs(y))
            w = np.ones(rows.n) if rows.w is None else rows.w.astype(np.float64)
            if job.objective == "mape":
                w = w / np.maximum(1.0, np.abs(y))
            for k, t in trees:
                own = np.arange(rows.n) if keep is None else np.flatnonzero(keep)
                leaf = rows.leaves(t)[own]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(own), k), pa.int32()), pa.array(leaf, pa.int32()), pa.array((y - s[k])[own]), pa.array(w[own])], ["k", "leaf", "r", "w"])

    return blocks.mapInArrow(run, "k int, leaf int, r double, w double")


def advanced(blocks: DataFrame, job: Job) -> DataFrame:
    """The blocks with the pending trees in their scores."""

    def run(batches):
        for batch in batches:
            rows = batch.to_pylist()
            s = [job.open(r).scores().tobytes() for r in rows]
            yield batch.set_column(batch.schema.get_field_index("s"), "s", pa.array(s, pa.binary()))

    return blocks.mapInArrow(run, SQL)


def scored(blocks: DataFrame, job: Job) -> DataFrame:
    """(row, label, weight, query, score array): one row each, for metrics."""

    def run(batches):
        for rows in _opened(job, batches):
            s = rows.scores()
            q = np.repeat(rows.queries(), np.diff(rows.q)) if rows.q is not None else np.zeros(rows.n, np.int64)
            flat = pa.ListArray.from_arrays(pa.array(np.arange(rows.n + 1) * job.classes, pa.int32()), pa.array(s.T.ravel()))
            w = np.ones(rows.n) if rows.w is None else rows.w.astype(np.float64)
            yield pa.RecordBatch.from_arrays([pa.array(rows.ids), pa.array(rows.y.astype(np.float64)), pa.array(w), pa.array(q), flat], ["row", "label", "weight", "query", "score"])

    return blocks.mapInArrow(run, "row long, label double, weight double, query long, score array<double>")


def linear_sums(blocks: DataFrame, job: Job, tree: Tree, k: int, paths: list[list[int]]) -> dict[int, tuple[np.ndarray, np.ndarray, int]]:
    """For each leaf X'HX, X'g over its in-bag rows without missing path features (the last column of X is 1), and their number."""

    def run(batches):
        sums = {i: [np.zeros((len(f) + 1, len(f) + 1)), np.zeros(len(f) + 1), 0] for i, f in enumerate(paths)}
        for rows in _opened(job, batches):
            g, h, keep = rows.sampled(*rows.gradients())
            leaf = rows.leaves(tree)
            for i, f in enumerate(paths):
                own = np.flatnonzero((leaf == i) if keep is None else (leaf == i) & keep)
                x = np.column_stack([rows.x[np.ix_(own, f)], np.ones(len(own))]) if f else np.ones((len(own), 1))
                ok = np.isfinite(x).all(axis=1)
                x, own = x[ok], own[ok]
                sums[i][0] += (x * h[k][own, None]).T @ x
                sums[i][1] += x.T @ g[k][own]
                sums[i][2] += len(own)
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([s[0].tobytes() for s in sums.values()], pa.binary()), pa.array([s[1].tobytes() for s in sums.values()], pa.binary()), pa.array([s[2] for s in sums.values()], pa.int64())], ["leaf", "a", "b", "n"])

    out = {i: [np.zeros((len(f) + 1, len(f) + 1)), np.zeros(len(f) + 1), 0] for i, f in enumerate(paths)}
    for r in blocks.mapInArrow(run, "leaf int, a binary, b binary, n long").toArrow().to_pylist():
        d = len(paths[r["leaf"]]) + 1
        o = out[r["leaf"]]
        o[0] = o[0] + np.frombuffer(r["a"]).reshape(d, d)
        o[1] = o[1] + np.frombuffer(r["b"])
        o[2] += r["n"]
    return {i: tuple(o) for i, o in out.items()}


def leaf_sums(blocks: DataFrame, job: Job, tree: Tree, k: int) -> np.ndarray:
    """Leaves x (g, h, rows), for refitting."""

    def run(batches):
        total = np.zeros((3, tree.leaves))
        for rows in _opened(job, batches):
            g, h = rows.gradients()
            leaf = rows.leaves(tree) if rows.x is None else tree.leaf_of_raw(rows.x)
            total += np.stack([np.bincount(leaf, g[k], tree.leaves), np.bincount(leaf, h[k], tree.leaves), np.bincount(leaf, minlength=tree.leaves)])
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["t"])

    got = [np.frombuffer(r["t"]).reshape(3, -1) for r in blocks.mapInArrow(run, "t binary").toArrow().to_pylist()]
    return np.sum(got, axis=0).T if got else np.zeros((tree.leaves, 3))


def position_sums(blocks: DataFrame, job: Job) -> dict[int, tuple[float, float, int]]:
    """Sums of gradients and hessians, and rows, per display position."""

    def run(batches):
        for rows in _opened(job, batches):
            g, h = rows.gradients()
            p, back = np.unique(rows.pos, return_inverse=True)
            yield pa.RecordBatch.from_arrays([pa.array(p), pa.array(np.bincount(back, g[0])), pa.array(np.bincount(back, h[0])), pa.array(np.bincount(back))], ["p", "g", "h", "n"])

    r = blocks.mapInArrow(run, "p long, g double, h double, n long").groupBy("p").agg(F.sum("g").alias("g"), F.sum("h").alias("h"), F.sum("n").alias("n"))
    return {x.p: (x.g, x.h, x.n) for x in r.collect()}
