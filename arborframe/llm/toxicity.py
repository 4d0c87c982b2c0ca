"""Toxicity by subword-bag embeddings.

A word is the bag of its hashed character n-grams and itself. The embeddings of a passage's subwords are averaged into a
linear softmax; embeddings and softmax are trained together by mini-batch Adagrad in numpy. A misspelt word that training
never saw shares most n-gram vectors with the word it stands for. A text is as toxic as its worst passage: averaged over
thousands of words, a few insults would vanish. The first epoch trains on whole texts, later ones on each text's worst
passage so far, for both labels, so that the threshold allows for long texts having more passages.

Training uses a bounded sample of labelled rows (TRAIN_ROWS, those with the least hash of their doc_id). Since everything
after the average is linear, a model is one number per subword and class difference, and scoring adds one number per
word; the model that goes to the executors has a fixed size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._bytes import buffer, chunks, column, lean, mix, ranges
from ._grams import distinct, fold, grams, letter_words

TRAIN_ROWS = 7000
#: Bytes of text that go to the driver for training, at most.
TRAIN_BYTES = 64 << 20
BUCKETS = 1 << 17
SIZES = (3, 4, 5, 6)
DIM = 8
EPOCHS = 6
BATCH = 64
#: Few rows are gone over more often, up to so many batches.
BATCHES = 300
RATE = 0.5
FOLDS = 5
#: Words of a passage, and from one passage to the next.
PASSAGE, STEP = 12, 6


def held_out(doc_id: str = "doc_id") -> Column:
    return F.crc32(F.col(doc_id).cast("string")) % FOLDS == 0


class Bags:
    """Words and subwords of some texts: word x of text i is distinct word which[first[i] + x], with subwords bucket[to[w]:to[w + 1]]."""

    def __init__(self, data: np.ndarray, off: np.ndarray):
        low = fold(data)
        s, e, self.first = letter_words(low, off)
        _, at, self.which = distinct(low, s, e) if len(s) else (None, np.zeros(0, np.int64), np.zeros(0, np.int64))
        word, bucket = grams(low, s[at], e[at], SIZES, BUCKETS, True) if len(s) else (np.zeros(0, np.int64), np.zeros(0, np.int64))
        order = np.argsort(word, kind="stable")
        self.bucket = bucket[order].astype(np.int32)
        self.to = np.concatenate([[0], np.cumsum(np.bincount(word, minlength=len(at)))])
        n = np.diff(self.first)
        k = np.maximum(1, -(-(n - STEP) // STEP))
        self.row = np.repeat(np.arange(len(n)), k)
        inside = ranges(np.zeros(len(k), np.int64), k) * STEP
        self.a = self.first[self.row] + inside
        self.b = np.minimum(self.a + PASSAGE, self.first[self.row + 1])

    def values(self, value: np.ndarray) -> np.ndarray:
        """Mean subword value of each passage; 0 without words."""
        total = np.add.reduceat(value[self.bucket], self.to[:-1]) if len(self.to) > 1 else np.zeros(0)  # each word has a subword: itself
        s = np.concatenate([[0.0], np.cumsum(total[self.which])])
        c = np.concatenate([[0.0], np.cumsum(np.diff(self.to)[self.which])])
        return (s[self.b] - s[self.a]) / np.maximum(c[self.b] - c[self.a], 1)

    def worst(self, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Largest value of each text's passages, and the passage."""
        v = self.values(value)
        edge = np.flatnonzero(np.concatenate([[True], self.row[1:] != self.row[:-1]])) if len(self.row) else np.zeros(0, np.int64)
        top = np.maximum.reduceat(v, edge) if len(edge) else v
        at = np.flatnonzero(v == top[self.row])
        return top, at[np.concatenate([[True], self.row[at][1:] != self.row[at][:-1]])] if len(at) else at

    def subwords(self, words: np.ndarray) -> np.ndarray:
        return self.bucket[ranges(self.to[words], self.to[words + 1] - self.to[words])]


class Model:
    def __init__(self, value: np.ndarray, bias: float):
        self.value, self.bias = value, bias

    def scores(self, text: pa.Array) -> np.ndarray:
        out = [Bags(d, o).worst(self.value)[0] for _, _, d, o in chunks(*buffer(text))]
        z = np.concatenate(out) + self.bias if out else np.zeros(0)
        return 1 / (1 + np.exp(-np.clip(z, -60, 60)))


def train(texts: pa.Array | list[str | None], labels: np.ndarray, epochs: int = EPOCHS, dim: int = DIM, rate: float = RATE, seed: int = 7) -> Model:
    """Fits a model to whole texts. With one class only, or none, the score is that class's smoothed share everywhere."""
    y = np.asarray(labels, np.int64)
    share = (y.sum() + 1) / (len(y) + 2)
    if not len(y) or y.min() == y.max():
        return Model(np.zeros(BUCKETS), float(np.log(share / (1 - share))))
    epochs = max(epochs, BATCHES // -(-len(y) // BATCH))
    texts = pa.array(texts, pa.large_string()) if isinstance(texts, list) else texts
    parts = [Bags(d, o) for _, _, d, o in chunks(*buffer(texts))]
    rng = np.random.default_rng(seed)
    e = rng.normal(0, 0.1, (BUCKETS, dim)).astype(np.float32)
    w = rng.normal(0, 0.5, (dim, 2)).astype(np.float32)
    b = np.log(np.array([1 - share, share], np.float32))
    ge, gw, gb = np.full_like(e, 1e-6), np.full_like(w, 1e-6), np.full_like(b, 1e-6)
    for epoch in range(epochs):
        each = []
        for p in parts:
            if epoch:
                _, at = p.worst((e @ (w[:, 1] - w[:, 0])).astype(np.float64))
                each += [(p, p.which[i:j]) for i, j in zip(p.a[at].tolist(), p.b[at].tolist(), strict=True)]
            else:
                each += [(p, np.unique(p.which[i:j])) for i, j in zip(p.first[:-1].tolist(), p.first[1:].tolist(), strict=True)]
        use = np.flatnonzero([len(words) for _, words in each])
        now = rate * (1 - epoch / epochs)
        rng.shuffle(use)
        for i in range(0, len(use), BATCH):
            docs = use[i : i + BATCH]
            own = [each[j][0].subwords(each[j][1]) for j in docs]
            n = np.array([len(x) for x in own])
            idx = np.concatenate(own)
            h = np.add.reduceat(e[idx], np.cumsum(n) - n, axis=0) / n[:, None]
            z = h @ w + b
            p = np.exp(z - z.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            p[np.arange(len(docs)), y[docs]] -= 1
            dw, db = h.T @ p, p.sum(axis=0)
            dh = (p @ w.T) / n[:, None]
            ids, back = np.unique(idx, return_inverse=True)
            row = np.repeat(np.arange(len(docs)), n)
            de = np.stack([np.bincount(back, dh[row, k], len(ids)) for k in range(dim)], axis=1).astype(np.float32)
            ge[ids] += de * de
            e[ids] -= now * de / np.sqrt(ge[ids])
            gw += dw * dw
            w -= now * dw / np.sqrt(gw)
            gb += db * db
            b -= 0.1 * now * db / np.sqrt(gb)
    return Model((e @ (w[:, 1] - w[:, 0])).astype(np.float64), float(b[1] - b[0]))


def _score(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = model.scores(column(batch, "text"))
            yield pa.RecordBatch.from_arrays([column(batch, "doc_id"), column(batch, "held_out"), pa.array(p), pa.array((p >= 0.5).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    return run


def sample(rows: DataFrame, most: int) -> pa.Table:
    """Rows with a text, in the order of their doc_ids' hashes up to `most` bytes of text in all, then sorted by doc_id. A row whose text doesn't fit in what is left is passed over."""
    size = rows.select("doc_id", F.octet_length("text").alias("size")).toArrow().to_pylist()  # as many as may be trained on
    order = np.argsort(mix(np.array([r["doc_id"] for r in size], np.int64).view(np.uint64)), kind="stable")
    keep, left = [], most
    for i in order.tolist():
        if (some := size[i]["size"] or 0) <= left:
            keep.append(size[i]["doc_id"])
            left -= some
    if len(keep) < len(size):
        rows = rows.join(F.broadcast(rows.sparkSession.createDataFrame([(x,) for x in keep], "doc_id long")), "doc_id")
    return rows.toArrow().sort_by("doc_id")


def score_toxicity(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS, train_bytes: int = TRAIN_BYTES) -> DataFrame:
    """(doc_id, held_out, score, predicted) for each row of docs (doc_id, text); labels: (doc_id, toxic); further columns don't matter.

    Rows without a doc_id are scored and never trained on; null and empty texts get the score of no subwords. Labels that
    are null, or contradict each other for one doc_id, are left out. Without labels of both classes all scores are equal.
    Training takes train_rows doc_ids at most, one text of each (the least), and train_bytes of text in all.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    known = labels.where("toxic is not null and doc_id is not null").where(~held_out()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("toxic").alias("y"), F.max("toxic").alias("z")).where("y = z")
    few = known.select("doc_id", "y").orderBy(F.xxhash64("doc_id"), "doc_id").limit(train_rows)
    got = sample(rows.join(F.broadcast(few), "doc_id").groupBy("doc_id").agg(F.first("y").alias("y"), F.min("text").alias("text")), train_bytes)
    model = train(got.column("text").combine_chunks(), np.array(got.column("y").to_pylist(), np.int64))
    return rows.withColumn("held_out", F.coalesce(held_out(), F.lit(False))).mapInArrow(lean(_score(model), "text"), "doc_id long, held_out boolean, score double, predicted int")


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_toxicity(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
