"""Mixture-controlled packing by deficit round-robin.

Each source is a queue of tokens, its documents one after the other. Every window of 4096 tokens takes from each queue its
share, and the fraction of a token that is left over is the queue's deficit, carried to the next window. The deficits have
a closed form: after w windows, queues 1 to j together have given floor(4096 w C_j / K), where C_j is the sum of their
integer weights and K that of all. So any partition can work out which windows its documents fall into, without the
others. When a queue can't fill its share any more, one window takes all it has left and a new phase goes on with the
others; a schedule has at most two phases a queue, and it is all that the partitions are sent.

Sources that would give a window just a few tokens share one of these queues, in which they are taken in runs of RUN
tokens: run r of a source is due at time (r + its phase) / its weight, and all runs follow each other by time. So each has
given its share of the queue at any place, but for about a run. A run's place is the sum of what is due before it.

Texts are tokenised once, into a table in the shared folder. A row notes how many tokens its partition has from its
source before it; the sums per (source, partition) give each partition's place in the queue. No token is shuffled.

The tokenizer is asked once per distinct piece of text between white space (and between an ASCII letter and a plain
punctuation mark, where its pre-tokenizer always splits), and the ids are put together from these.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._bytes import LOWER, SPACE, buffer, chunks, column, hashes, lean, mix, ranges
from ._store import files_for, written

SIZE = 4096
END = 2
TOKENIZER = "word_bpe_49k.json"
#: Sources with a smaller share of the tokens share a queue and are taken in runs, so that no window takes just a few tokens of one.
LEAST_SHARE = 1 / 128
#: Tokens of a run; with over 32 * RUN sources in the shared queue more, so that the work for a token is bounded.
RUN = 32
#: Run times x sources that a worker compares at once.
CELLS = 1 << 20
#: Weights are integers that sum to about this.
SCALE = 1 << 20
#: Bytes of text whose ids a worker holds at once.
SLICE = 4 << 20
#: Distinct pieces of text that a worker remembers.
REMEMBERED = 600_000
_LETTER = np.zeros(256, bool)
_LETTER[97:123] = True
_MARK = np.zeros(256, bool)
_MARK[list(b'.,;:!?()[]{}"/-+=*#$%&@')] = True


class Encoder:
    """Token ids of whole texts; remembers those of pieces."""

    def __init__(self, tokenizer: str, end: int = END):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import public_tokenizers
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(tokenizer if os.path.isabs(tokenizer) else public_tokenizers.path(tokenizer))
        self.special = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.end = end
        self.forget()

    def forget(self) -> None:
        self.pool, self.used = np.zeros(1 << 16, np.uint32), 1
        self.pool[0] = self.end  # slot 0: the id that ends a document
        self.start, self.length, self.slots = np.zeros(1 << 14, np.int64), np.ones(1 << 14, np.int32), 1
        self.known, self.known_slot = np.zeros(0, np.uint64), np.zeros(0, np.int64)  # sorted
        self.recent: dict[int, int] = {}

    def _settle(self) -> None:
        """Moves the recent keys into the sorted arrays, which need a tenth of a dict's memory."""
        keys = np.concatenate([self.known, np.fromiter(self.recent.keys(), np.uint64, len(self.recent))])
        slots = np.concatenate([self.known_slot, np.fromiter(self.recent.values(), np.int64, len(self.recent))])
        order = np.argsort(keys, kind="stable")
        self.known, self.known_slot, self.recent = keys[order], slots[order], {}

    def _learn(self, pieces: list[str]) -> np.ndarray:
        """Slots of new pieces."""
        first = self.slots
        for i in range(0, len(pieces), 4096):
            got = [e.ids for e in self.tokenizer.encode_batch_fast(pieces[i : i + 4096], add_special_tokens=False)]
            n = np.fromiter(map(len, got), np.int32, len(got))
            flat = np.fromiter((x for ids in got for x in ids), np.uint32, int(n.sum()))
            while self.used + len(flat) > len(self.pool):
                self.pool = np.concatenate([self.pool, np.zeros_like(self.pool)])
            while self.slots + len(n) > len(self.start):
                self.start, self.length = np.concatenate([self.start, self.start]), np.concatenate([self.length, self.length])
            self.pool[self.used : self.used + len(flat)] = flat
            self.start[self.slots : self.slots + len(n)] = self.used + np.cumsum(n) - n
            self.length[self.slots : self.slots + len(n)] = n
            self.used, self.slots = self.used + len(flat), self.slots + len(n)
        return np.arange(first, self.slots)

    def _slots(self, distinct: np.ndarray, at: np.ndarray, low: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
        if self.slots + len(distinct) > REMEMBERED:
            self.forget()
        out = np.full(len(distinct), -1, np.int64)
        if len(self.known):
            i = np.minimum(np.searchsorted(self.known, distinct), len(self.known) - 1)
            hit = self.known[i] == distinct
            out[hit] = self.known_slot[i[hit]]
        for i in np.flatnonzero(out < 0).tolist():
            out[i] = self.recent.get(int(distinct[i]), -1)
        new = np.flatnonzero(out < 0)
        if len(new):
            raw = low.tobytes()
            a, b = s[at[new]].tolist(), e[at[new]].tolist()
            out[new] = self._learn([raw[x:y].decode() for x, y in zip(a, b, strict=True)])
            self.recent.update(zip(distinct[new].tolist(), out[new].tolist(), strict=True))
            if len(self.recent) > 60_000:
                self._settle()
        return out

    def encode(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of each row, the end id included, one row after the other, and how many each row has."""
        low = LOWER[data]
        n = len(data)
        first = np.zeros(n + 1, bool)
        first[off] = True
        inside = np.zeros(n + 2, bool)
        inside[1:-1] = ~SPACE[data]
        turn = np.zeros(n + 1, bool)
        if n > 1:
            turn[1:-1] = (_LETTER[low[:-1]] & _MARK[low[1:]]) | (_MARK[low[:-1]] & _LETTER[low[1:]])
        cut = first | turn
        s = np.flatnonzero(inside[1:] & (~inside[:-1] | cut))
        s = s[s < n]
        e = np.flatnonzero(inside[:-1] & (~inside[1:] | cut))
        h = mix(hashes(low, s, e) ^ (e - s).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
        distinct, at, back = np.unique(h, return_index=True, return_inverse=True)
        slots = self._slots(distinct, at, low, s, e)[back]
        words = np.searchsorted(s, off)
        slots = np.insert(slots, words[1:], 0)
        length = self.length[slots].astype(np.int64)
        ids = self.pool[ranges(self.start[slots], length)]
        sums = np.concatenate([[0], np.cumsum(length)])
        to = words + np.arange(len(words))
        return ids, sums[to[1:]] - sums[to[:-1]]

    def texts(self, data: np.ndarray, off: np.ndarray) -> Iterator[np.ndarray]:
        """Ids of each row. A text with one of the tokenizer's special tokens is encoded as it stands."""
        for _, _, d, o in chunks(data, off):
            raw = d.tobytes()
            if any(t in raw for t in self.special):
                for i in range(len(o) - 1):
                    yield np.array([*self.tokenizer.encode(raw[o[i] : o[i + 1]].decode(), add_special_tokens=False).ids, self.end], np.uint32)
                continue
            ids, n = self.encode(d, o)
            to = np.concatenate([[0], np.cumsum(n)])
            for i in range(len(n)):
                yield ids[to[i] : to[i + 1]]


_ENCODERS: dict[str, Encoder] = {}


def encoder(tokenizer: str) -> Encoder:
    """One per worker process."""
    if tokenizer not in _ENCODERS:
        _ENCODERS[tokenizer] = Encoder(tokenizer)
    return _ENCODERS[tokenizer]


_TOKENS_SQL = "doc_id long, source string, part int, before long, n long, ids binary"


def _tokenise(tokenizer: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seen, enc = TaskContext.get().partitionId(), {}, encoder(tokenizer)
        for batch in batches:
            text, docs, sources = buffer(column(batch, "text")), column(batch, "doc_id"), column(batch, "source")
            for i, j, data, off in chunks(*text, SLICE):
                ids = list(enc.texts(data, off))
                before = []
                for s, x in zip(sources[i:j].to_pylist(), ids, strict=True):
                    before.append(seen.get(s, 0))
                    seen[s] = before[-1] + len(x)
                small = [x.astype(np.uint16 if x.max() < 65536 else np.uint32).tobytes() for x in ids]
                yield pa.RecordBatch.from_arrays(
                    [docs[i:j], sources[i:j], pa.array([part] * len(small), pa.int32()), pa.array(before, pa.int64()), pa.array([len(x) for x in ids], pa.int64()), pa.array(small, pa.binary())],
                    ["doc_id", "source", "part", "before", "n", "ids"],
                )

    return run


class Schedule:
    """Which window takes which tokens of which queue."""

    def __init__(self, totals: list[int], weights: list[int], size: int = SIZE):
        self.size, self.totals = size, totals
        left = list(totals)
        self.windows = 0
        self.phases: list[tuple[int, int, np.ndarray, list[int], list[int] | None]] = []  # from window, to window, given before, weight sums, amounts of a single window
        base = np.zeros(len(totals), np.int64)
        while any(left):
            w = [k if n else 0 for k, n in zip(weights, left, strict=True)]
            sums = [0]
            for k in w:
                sums.append(sums[-1] + k)

            def given(n, sums=sums):
                b = [self._cut(n, c, sums[-1]) for c in sums]
                return [y - x for x, y in zip(b[:-1], b[1:], strict=True)]

            lo, hi = 0, sum(left) // size
            while lo < hi:
                mid = (lo + hi + 1) // 2
                lo, hi = (mid, hi) if all(g <= n for g, n in zip(given(mid), left, strict=True)) else (lo, mid - 1)
            if lo:
                self._add(lo, base, sums, None)
                g = given(lo)
                base, left = base + np.array(g), [n - x for n, x in zip(left, g, strict=True)]
            if any(left):  # a window that takes all that is left of the queues that run out
                room, amounts, open_ = min(size, sum(left)), [0] * len(left), [i for i, n in enumerate(left) if n]
                while room:
                    k = sum(weights[i] for i in open_)
                    short = [i for i in open_ if left[i] - amounts[i] <= room * weights[i] // k]
                    if short:
                        for i in short:
                            room -= left[i] - amounts[i]
                            amounts[i] = left[i]
                            open_.remove(i)
                        continue
                    done, was = 0, 0
                    for i in open_:
                        was += weights[i]
                        now = room * was // k
                        amounts[i], done = amounts[i] + now - done, now
                    room = 0
                self._add(1, base, sums, amounts)
                base, left = base + np.array(amounts), [n - x for n, x in zip(left, amounts, strict=True)]

    def _add(self, windows: int, base: np.ndarray, sums: list[int], amounts: list[int] | None) -> None:
        self.phases.append((self.windows, self.windows + windows, base, sums, amounts))
        self.windows += windows

    def _cut(self, windows, c: int, k: int):
        """floor(windows * size * c / k) without overflow."""
        q, r = np.divmod(np.multiply(windows, self.size), k) if isinstance(windows, np.ndarray) else divmod(windows * self.size, k)
        return q * c + r * c // k

    def pieces(self, queue: int, start: int, length: int) -> list[tuple[int, int, int, int]]:
        """(window, offset there, start in the queue, length) of the tokens start, start + 1, ... of a queue."""
        out = []
        end = start + length
        for w0, w1, base, sums, amounts in self.phases[max(0, self._phase(queue, start)) :]:
            b = int(base[queue])
            if b >= end:
                break
            if amounts is not None:
                lo, hi = max(start, b), min(end, b + amounts[queue])
                if lo < hi:
                    out.append((w0, sum(amounts[:queue]) + lo - b, lo, hi - lo))
                continue
            c0, c1, k = sums[queue], sums[queue + 1], sums[-1]
            if c0 == c1:
                continue

            def given(w, b=b, c0=c0, c1=c1, k=k):
                return b + self._cut(w, c1, k) - self._cut(w, c0, k)

            most = given(w1 - w0)
            if start >= most:
                continue
            x, share = max(start, b) - b, self.size * (c1 - c0) / k
            w = max(0, min(w1 - w0 - 1, int(x / share)))
            while w and given(w) > max(start, b):
                w -= 1
            while given(w + 1) <= max(start, b):
                w += 1
            at = max(start, b)
            while at < min(end, most):
                lo, hi = given(w), given(w + 1)
                stop = min(hi, end)
                if stop > at:
                    out.append((w0 + w, self._cut(w + 1, c0, k) - self._cut(w, c0, k) + at - lo, at, stop - at))
                    at = stop
                w += 1
        return out

    def _phase(self, queue: int, start: int) -> int:
        if not hasattr(self, "bases"):
            self.bases = np.array([p[2] for p in self.phases]).reshape(len(self.phases), -1)
        return int(np.searchsorted(self.bases[:, queue], start, "right")) - 1


class Runs:
    """The order in which the sources of the shared queue give their tokens."""

    def __init__(self, names: list[str], totals: list[int], weights: list[float], run: int = RUN):
        self.at = {s: i for i, s in enumerate(names)}
        self.totals, self.weights = np.array(totals, np.int64), np.array(weights, np.float64)
        self.run = max(run, len(names) // 32)
        self.runs = -(-self.totals // self.run)
        self.phase = (0.5 + np.arange(len(names)) * 0.6180339887498949) % 1.0

    def _before(self, own: int, r: np.ndarray) -> np.ndarray:
        """Place of the first token of the runs r of a source: the tokens of all runs with an earlier time; at equal times the source's number decides."""
        time = ((r + self.phase[own]) / self.weights[own])[:, None]
        first = np.arange(len(self.runs)) < own
        due = lambda k: ((t := (k + self.phase) / self.weights) < time) | ((t == time) & first)
        n = np.clip(np.floor(time * self.weights - self.phase), 0, self.runs).astype(np.int64)
        while (more := due(n) & (n < self.runs)).any():  # the guess is rounded
            n += more
        while (less := (n > 0) & ~due(n - 1)).any():
            n -= less
        n[:, own] = r
        return np.minimum(n * self.run, self.totals).sum(axis=1)

    def places(self, source: str, start: int, length: int) -> list[tuple[int, int, int]]:
        """(place in the shared queue, start in the source, length) of a source's tokens start, start + 1, ..."""
        own, out = self.at[source], []
        step = max(1, CELLS // len(self.runs))
        for i in range(start // self.run, -(-(start + length) // self.run), step):
            r = np.arange(i, min(i + step, -(-(start + length) // self.run)))
            lo, hi = np.maximum(r * self.run, start), np.minimum((r + 1) * self.run, start + length)
            for p, a, b in zip((self._before(own, r) + lo - r * self.run).tolist(), lo.tolist(), hi.tolist(), strict=True):
                if out and out[-1][0] + out[-1][2] == p:
                    out[-1] = (*out[-1][:2], out[-1][2] + b - a)
                else:
                    out.append((p, a, b - a))
        return out


_PIECES_SQL = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, source string"


def _cut_pieces(schedule: Schedule, shared: int, runs: Runs, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "source", "ids"]
        types = [pa.int64()] * 7 + [pa.string(), pa.binary()]
        k = 9 if with_ids else 8
        for batch in batches:
            for first in range(0, batch.num_rows, 500):
                cols = [column(batch, c)[first : first + 500].to_pylist() for c in ("doc_id", "queue", "place", "n", "ids", "source")]
                out = []
                for doc, queue, place, n, raw, source in zip(*cols, strict=True):
                    ids = np.frombuffer(raw, np.uint16 if len(raw) == 2 * n else np.uint32).astype("<u4").tobytes()
                    for to, start, some in runs.places(source, place, n) if queue == shared else [(place, place, n)]:
                        for w, offset, at, length in schedule.pieces(queue, to, some):
                            s = at - to + start - place
                            own = ids[4 * s : 4 * (s + length)]
                            out.append((doc, s, length, zlib.crc32(own), n, w, offset, source, own if with_ids else None))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*out, strict=True))[:k], types[:k], strict=True)], names[:k])

    return run


def pack(docs: DataFrame, targets: dict[str, float] | None = None, tokenizer: str = TOKENIZER, size: int = SIZE, with_ids: bool = False, least_share: float = LEAST_SHARE) -> DataFrame:
    """Pieces (doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, source[, ids]) of docs (doc_id, text, source; further columns don't matter).

    Every id of every row is in one piece. All sequences but the last hold `size` ids, so at most size - 1 places of the
    whole corpus are padding. targets: share of each source in a window; by default its share of all tokens, so that all
    queues end together. Sources without a target, or with less than least_share, share one queue, which has the sum of
    their shares (a source without a target: its share of all tokens) and takes each by its own. A target of 0 comes last
    in it. A null or empty text is its end id alone; rows without a source are a source; repeated rows are packed once
    each. An empty table has no pieces. The driver and each worker hold one number per source.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("source"))
    if files := files_for(docs, 16 << 20):
        rows = rows.coalesce(files)  # before ids are made: each task is a part
    tokens = written(rows.mapInArrow(lean(_tokenise(tokenizer), "text"), _TOKENS_SQL))
    own = written(tokens.groupBy("source", "part").agg(F.sum("n").alias("n")), files_for(docs, 256 << 20))
    total = own.agg(F.sum("n")).first()[0] or 0
    have = {r.source: r.n for r in own.groupBy("source").agg(F.sum("n").alias("n")).collect()}
    if targets is None:
        weight = dict(have)
    else:
        weight = {s: max(float(targets[s]), 0.0) if s in targets else n / total for s, n in have.items()}
    least = max(least_share, 1 / size) * sum(weight.values())  # a queue in the middle needs a token a window at least
    names = sorted(s for s, p in weight.items() if p >= least > 0 and (targets is None or s in targets))
    small = sorted(set(have) - set(names))
    totals = [*(have[s] for s in names), sum(have[s] for s in small)]
    weights = [*(weight[s] for s in names), sum(weight[s] for s in small)]
    if targets is not None:
        weights = [max(1, round(SCALE * p)) for p in weights]
    schedule = Schedule(totals, weights, size)
    runs = Runs(small, [have[s] for s in small], [max(weight[s], 1e-12) for s in small])
    shared = F.lit(len(names))
    queue = F.coalesce(F.element_at(F.create_map(*[x for i, s in enumerate(names) for x in (F.lit(s), F.lit(i))]), F.col("source")), shared) if names else shared
    line = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    places = own.select("source", "part", queue.alias("queue"), F.coalesce(F.sum("n").over(line), F.lit(0)).alias("base"))
    placed = tokens.join(places, ["source", "part"]).select("doc_id", "queue", (F.col("base") + F.col("before")).alias("place"), "n", "ids", "source")
    return placed.mapInArrow(lean(_cut_pieces(schedule, len(names), runs, with_ids)), _PIECES_SQL + ", ids binary" * with_ids)


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the pieces of all rows, in the columns that `pack` names; further columns of any name are dropped.

    A row without a doc_id has pieces with a null doc_id; null and empty texts are their end id alone; repeated rows are
    packed once each. An empty table gives an empty one."""
    return pack(docs)
