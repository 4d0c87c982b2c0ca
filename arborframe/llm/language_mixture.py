"""Language ID by multilingual mixture inference.

Each language is a distribution over hashed character n-grams, counted in a bounded sample of documents of known language
(TRAIN_ROWS of each). A document is a mixture of languages: every word was drawn from one of them. Expectation-maximisation
estimates the proportions from the words' likelihoods, first over all languages; the languages are then ordered by
proportion, and the set of the first m that has the greatest likelihood less PENALTY * (m - 1) * ln(words) is selected, for
any m up to the number of languages. A size isn't tried for a row in which it can't win: no mixture has a likelihood above that
of the first estimate plus words * ln(max D), D being by how much a round of it would multiply each language's proportion.
The predicted language is the one with the largest proportion in it.

All documents of a chunk are estimated at once; a chunk needs words x languages floats.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._bytes import buffer, chunks, column, lean
from ._grams import distinct, fold, grams, letter_words
from .toxicity import TRAIN_BYTES, held_out, sample

TRAIN_ROWS = 1500
BUCKETS = 1 << 16
SIZES = (2, 3)
SMOOTHING = 0.1
ROUNDS = 8
#: Per further language; 0.5 would be the Bayesian information criterion for one parameter.
PENALTY = 2.0
_LETTER = re.compile(r"[^\W\d_]")


class Model:
    def __init__(self, languages: list[str], logs: np.ndarray):
        self.languages, self.logs = languages, logs  # logs: bucket x language

    def mixtures(self, data: np.ndarray, off: np.ndarray) -> Iterator[np.ndarray]:
        """Rows x languages: proportions, 0 outside the selected set; all 0 for a row without words."""
        for _, _, d, o in chunks(data, off):
            low = fold(d)
            s, e, first = letter_words(low, o)
            n = np.diff(first)
            if not len(s):
                yield np.zeros((len(n), len(self.languages)))
                continue
            _, at, which = distinct(low, s, e)
            word, bucket = grams(low, s[at], e[at], SIZES, BUCKETS, False)
            order = np.argsort(word, kind="stable")
            to = np.searchsorted(word[order], np.arange(len(at)))
            each = np.add.reduceat(self.logs[bucket[order]], to, axis=0)
            top = each.max(axis=1, keepdims=True)
            yield select(np.exp(each - top).astype(np.float32)[which], top[which, 0], n)


def _em(like: np.ndarray, row: np.ndarray, cut: np.ndarray, n: np.ndarray, mix: np.ndarray, rounds: int) -> tuple[np.ndarray, np.ndarray]:
    for _ in range(rounds):
        part = like * mix[row]
        part /= part.sum(axis=1, keepdims=True) + np.float32(1e-30)
        mix = np.add.reduceat(part, cut, axis=0) / n[:, None]
    fit = np.add.reduceat(np.log((like * mix[row]).sum(axis=1) + np.float32(1e-30)).astype(np.float64), cut)
    return mix.astype(np.float32), fit


def select(like: np.ndarray, top: np.ndarray, n: np.ndarray) -> np.ndarray:
    """like: likelihoods of the words (rows one after the other, each row's n words) divided by their largest, whose logarithm is top."""
    k = like.shape[1]
    have = np.flatnonzero(n)
    m = n[have]
    cut, row = np.cumsum(m) - m, np.repeat(np.arange(len(m)), m)
    base = np.add.reduceat(top.astype(np.float64), cut)
    full, _ = _em(like, row, cut, m, np.full((len(m), k), 1 / k, np.float32), ROUNDS)
    rank = np.argsort(np.argsort(-full, axis=1, kind="stable"), axis=1)
    seen = (like * full[row]).sum(axis=1, keepdims=True) + np.float32(1e-30)
    most = np.add.reduceat(like / seen, cut, axis=0).max(axis=1) / m
    # a word's likelihood is at most 1; the slack is for rounding
    limit = base + np.minimum(np.add.reduceat(np.log(seen[:, 0]).astype(np.float64), cut) + m * np.log(most.astype(np.float64)), 0) + 1e-4 * m + 0.01
    best, score = np.zeros((len(m), k)), np.full(len(m), -np.inf)
    left = np.arange(len(m))
    for size in range(1, k + 1):
        go = limit[left] - PENALTY * (size - 1) * np.log(m[left] + 1) > score[left]
        if not go.all():
            like, left = like[np.repeat(go, m[left])], left[go]
            if not len(left):
                break
            cut, row = np.cumsum(m[left]) - m[left], np.repeat(np.arange(len(left)), m[left])
        start = np.where(rank[left] < size, full[left] + 1e-6, 0).astype(np.float32)
        mix, fit = _em(like, row, cut, m[left], start / start.sum(axis=1, keepdims=True), ROUNDS if size > 1 else 0)
        now = fit + base[left] - PENALTY * (size - 1) * np.log(m[left] + 1)
        better = now > score[left]
        best[left[better]], score[left[better]] = mix[better], now[better]
    out = np.zeros((len(n), k))
    out[have] = best
    return out


def train(texts: list[str], languages: list[str]) -> Model:
    names = sorted(set(languages))
    counts = np.full((BUCKETS, max(len(names), 1)), SMOOTHING)
    for i, name in enumerate(names):
        own = pa.array([t for t, x in zip(texts, languages, strict=True) if x == name], pa.large_string())
        for _, _, d, o in chunks(*buffer(own)):
            low = fold(d)
            s, e, _ = letter_words(low, o)
            if len(s):
                _, at, which = distinct(low, s, e)
                word, bucket = grams(low, s[at], e[at], SIZES, BUCKETS, False)
                counts[:, i] += np.bincount(bucket, np.bincount(which, minlength=len(at))[word], BUCKETS)
    return Model(names, np.log(counts / counts.sum(axis=0)).astype(np.float32))


def _predict(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [*model.languages, "und"]
        for batch in batches:
            text = column(batch, "text")
            mix = [m for m in model.mixtures(*buffer(text))] if model.languages else []
            mix = np.concatenate(mix) if mix else np.zeros((batch.num_rows, 1))
            best = mix.argmax(axis=1)
            score = mix[np.arange(len(mix)), best]
            known = np.fromiter((bool(t and _LETTER.search(t)) for t in text.to_pylist()), bool, len(text)) & (score > 0)
            lang = [names[i] if ok else "und" for i, ok in zip(best, known, strict=True)]
            mixed = [[f"{names[j]}:{m[j]:.3f}" for j in np.argsort(-m, kind="stable") if m[j] > 0.0005] if ok else [] for m, ok in zip(mix, known, strict=True)]
            yield pa.RecordBatch.from_arrays([column(batch, "doc_id"), column(batch, "held_out"), pa.array(lang, pa.string()), pa.array(np.where(known, np.clip(score, 0, 1), 0.0)), pa.array([",".join(x) for x in mixed], pa.string())], ["doc_id", "held_out", "lang_pred", "score", "mixture"])

    return run


def identify(docs: DataFrame, train_rows: int = TRAIN_ROWS, train_bytes: int = TRAIN_BYTES) -> DataFrame:
    """(doc_id, held_out, lang_pred, score, mixture) for each row of docs (doc_id, text, lang; further columns don't matter).

    score: the predicted language's proportion; mixture: the selected languages with theirs. Learns from text and lang of
    rows with a lang whose crc32(doc_id) mod 5 isn't 0: of each language the train_rows doc_ids with the least hash, one text
    (the least) and one language (the first by name) of each, and train_bytes of text in all. A null
    text, one without a letter, and any text if nothing could be learned, is `und` with score 0. Repeated rows come back once each.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    known = rows.where("lang is not null and doc_id is not null and text is not null").where(~held_out()).select("doc_id", "lang").distinct()
    # a hash threshold first, so that the window below sees about 1.2 * train_rows rows of a language, not all of it
    share = known.withColumn("h", F.xxhash64("doc_id", "lang"))
    per = share.groupBy("lang").agg(F.count("*").alias("n"))
    limit = share.join(F.broadcast(per), "lang").where(F.col("n") <= train_rows).select("doc_id", "lang").union(
        share.join(F.broadcast(per), "lang").where((F.col("n") > train_rows) & ((F.shiftrightunsigned("h", 11) / F.lit(float(2**53))) < 1.2 * train_rows / F.col("n"))).select("doc_id", "lang")
    )
    place = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id", "lang"), "doc_id")
    few = limit.withColumn("k", F.row_number().over(place)).where(F.col("k") <= train_rows).select("doc_id", "lang")
    got = sample(rows.join(F.broadcast(few.groupBy("doc_id").agg(F.min("lang").alias("lang"))), ["doc_id", "lang"]).groupBy("doc_id", "lang").agg(F.min("text").alias("text")), train_bytes)
    model = train(got.column("text").to_pylist(), got.column("lang").to_pylist())
    return rows.withColumn("held_out", F.coalesce(held_out(), F.lit(False))).select("doc_id", "held_out", "text").mapInArrow(lean(_predict(model), "text"), "doc_id long, held_out boolean, lang_pred string, score double, mixture string")


def op10_language_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(spark.read.parquet(f"{sf_dir}/documents.parquet"))
