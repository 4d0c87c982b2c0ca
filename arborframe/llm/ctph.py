"""Context-triggered piecewise hashing.

A rolling hash over 7 bytes ends a chunk where it is one less than a multiple of the block size 3 * 2^k. Boundaries of
2^(k+1) are boundaries of 2^k too, so one pass gives all sizes. A text takes the smallest size with at most 64 chunks;
its fingerprint has one base-64 character (6 bits of the chunk's hash) per chunk at that size and at the next. Two
fingerprints are compared at the block sizes they share, by 1 - edit distance / length of the longer signature.

A document's neighbour in descending doc_id is found by one range shuffle. Each partition is read as a stream that holds
one row back; only the first and the last row of a partition, which need another partition, are joined afterwards.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._bytes import PrefixHash, column, lean, mix
from ._store import partitions, written

ROLL = 7
MOST = 64
_LETTERS = np.frombuffer(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", np.uint8)
_CODE = np.zeros(256, np.int64)
_CODE[_LETTERS] = np.arange(64)


def _chunks(p: PrefixHash, ends: np.ndarray, n: int) -> str:
    ends = ends if len(ends) and ends[-1] == n else np.append(ends, n)
    starts = np.concatenate([[0], ends[:-1]])
    return _LETTERS[(mix(p.of(starts, ends)) >> np.uint64(58)).astype(np.int64)].tobytes().decode()


def fingerprint(raw: bytes) -> str:
    n = len(raw)
    if not n:
        return "3::"
    p = PrefixHash(np.frombuffer(raw, np.uint8))
    end = np.arange(1, n + 1)
    start = np.maximum(end - ROLL, 0)
    t = (mix(p.of(start, end)) >> np.uint64(32)) + np.uint64(1)
    at = np.flatnonzero(t % np.uint64(3) == 0)
    x = t[at] // np.uint64(3)
    level = np.bitwise_count((x & (~x + np.uint64(1))) - np.uint64(1)).astype(np.int64)
    count = np.cumsum(np.bincount(level, minlength=34)[::-1])[::-1]  # boundaries at each level
    k = int(np.argmax(count <= MOST - 1))
    return f"{3 << k}:{_chunks(p, at[level >= k] + 1, n)}:{_chunks(p, at[level > k] + 1, n)}"


def edit_distances(a: list[str], b: list[str]) -> np.ndarray:
    """Levenshtein distances of pairs of strings of up to 64 base-64 characters, all pairs at once (Myers' bit vectors)."""
    n = len(a)
    la, lb = (np.fromiter(map(len, x), np.int64, n) for x in (a, b))
    ca, cb = (_CODE[np.frombuffer("".join(s.ljust(MOST, "A") for s in x).encode(), np.uint8)].reshape(n, MOST) if n else np.zeros((0, MOST), np.int64) for x in (a, b))
    rows, one = np.arange(n), np.uint64(1)
    eq = np.zeros((n, 64), np.uint64)
    for j in range(MOST):
        r = rows[j < la]
        eq[r, ca[r, j]] |= one << np.uint64(j)
    up, down = np.full(n, ~np.uint64(0)), np.zeros(n, np.uint64)
    score, top = la.copy(), np.maximum(la - 1, 0).astype(np.uint64)
    for j in range(int(lb.max(initial=0))):
        r = rows[(j < lb) & (la > 0)]
        pv, mv, e = up[r], down[r], eq[r, cb[r, j]]
        xv = e | mv
        xh = (((e & pv) + pv) ^ pv) | e
        ph, mh = mv | ~(xh | pv), pv & xh
        score[r] += (ph >> top[r] & one).astype(np.int64) - (mh >> top[r] & one).astype(np.int64)
        ph, mh = ph << one | one, mh << one
        up[r], down[r] = mh | ~(xv | ph), ph & xv
    return np.where(la == 0, lb, score)


def likeness(a: list[str], b: list[str]) -> np.ndarray:
    """0 to 1 for each pair of fingerprints; 0 if they share no block size, 1 if they are equal."""
    pairs: list[tuple[int, str, str]] = []
    for i, (x, y) in enumerate(zip(a, b, strict=True)):
        if x != y:
            (bx, x1, x2), (by, y1, y2) = x.split(":"), y.split(":")
            bx, by = int(bx), int(by)
            if bx == by:
                pairs += [(i, x1, y1), (i, x2, y2)]
            elif bx == 2 * by:
                pairs.append((i, x1, y2))
            elif by == 2 * bx:
                pairs.append((i, x2, y1))
    out = np.array([float(x == y) for x, y in zip(a, b, strict=True)])
    if pairs:
        at, x, y = zip(*pairs, strict=True)
        longer = np.maximum(np.fromiter(map(len, x), np.int64), np.fromiter(map(len, y), np.int64))
        np.maximum.at(out, np.array(at), 1 - edit_distances(list(x), list(y)) / np.maximum(longer, 1))
    return out


_COLS = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
_SQL = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _rows(ids: list, texts: list[str], prints: list[str], nexts: list[str], next_prints: list[str]) -> list[pa.Array]:
    half = [len(t) // 2 for t in texts]
    edited = [(t[: len(t) - k] + x[:k]).encode() for t, k, x in zip(texts, half, nexts, strict=True)]
    other = [fingerprint(e) for e in edited]
    return [
        *(pa.array(ids, pa.int64()), pa.array([len(t) for t in texts], pa.int64()), pa.array([hashlib.sha256(e).hexdigest() for e in edited], pa.string())),
        *(pa.array(prints, pa.string()), pa.array(other, pa.string()), pa.array(likeness(prints, other)), pa.array(likeness(prints, next_prints))),
    ]


def _stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows whose neighbour is in the partition; of its first and last row the text, for the join with other partitions."""
    part = TaskContext.get().partitionId()
    names = [*_COLS, "part", "first", "text"]
    held, lead = None, None

    def batch_of(cols, n, first, text):
        return pa.RecordBatch.from_arrays([*cols, pa.array([part] * n, pa.int32()), pa.array([first] * n, pa.bool_()), pa.array([text] * n, pa.string())], names)

    def edge(row, first):
        empty = [pa.nulls(1, t) for t in (pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64())]
        empty[2] = pa.array([row[2]], pa.string())
        return batch_of([pa.array([row[0]], pa.int64()), *empty], 1, first, row[1])

    for batch in batches:
        ids, texts = column(batch, "doc_id").to_pylist(), [t or "" for t in column(batch, "text").to_pylist()]
        rows = [(i, t, fingerprint(t.encode())) for i, t in zip(ids, texts, strict=True)]
        if rows and lead is None:
            lead = rows[0]
        if held is not None:
            rows.insert(0, held)
        if rows:
            held = rows[-1]
        if len(rows) > 1:
            i, t, p = (list(x) for x in zip(*rows, strict=True))
            yield batch_of(_rows(i[:-1], t[:-1], p[:-1], t[1:], p[1:]), len(i) - 1, None, None)
    if held is not None:
        yield edge(lead, True)
        yield edge(held, False)


def _edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        x = {c: column(batch, c).to_pylist() for c in ("doc_id", "text", "fingerprint", "next_text", "next_fingerprint")}
        yield pa.RecordBatch.from_arrays(_rows(x["doc_id"], x["text"], x["fingerprint"], x["next_text"], x["next_fingerprint"]), _COLS)


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) for each row of docs
    (doc_id, text; further columns don't matter).

    The edited text has its last floor(n_chars / 2) characters replaced by the first as many (or all) of the next
    document: descending doc_id (null last), rows of one doc_id by descending text, after the last the first. A null text is empty. A
    single row is its own neighbour.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    order = [F.col("doc_id").desc_nulls_last(), F.col("text").desc()]
    dealt = rows.repartitionByRange(partitions(spark), order[0]).sortWithinPartitions(*order)
    done = written(dealt.mapInArrow(lean(_stream, "text"), _SQL + ", part int, first boolean, text string"))
    first = done.where("first").select("part", F.col("text").alias("next_text"), F.col("fingerprint").alias("next_fingerprint"))
    parts = sorted(r.part for r in first.select("part").collect())  # as many as partitions at most
    follow = spark.createDataFrame([(a, b) for a, b in zip(parts, parts[1:] + parts[:1], strict=True)], "part int, next int")
    last = done.where("not first").select("doc_id", "text", "fingerprint", "part").join(follow, "part").join(first.withColumnRenamed("part", "next"), "next")
    return done.where("first is null").select(_COLS).union(last.mapInArrow(lean(_edges, "text"), _SQL))


def op4_ctph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(spark.read.parquet(f"{sf_dir}/documents.parquet"))
