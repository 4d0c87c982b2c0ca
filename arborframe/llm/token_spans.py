"""Token counts of sections by offset-mapped attribution.

A whole document is encoded once. Byte-level tokens spell the text, so the running sum of their lengths gives each token's
span, and the spans are interval-joined with the sections by binary search of both ends in the sorted section starts. A
token inside one section is its; one that crosses a boundary goes by an explicit rule:

start      to the section of its first byte
end        to the section of its last byte
majority   to the section with most of its bytes, the first of equals
split      to each section in proportion to its bytes

Sections are the lines of a text (each with its line feed), or the parts that another separator ends.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._bytes import buffer, chunks, column, lean, ranges

VOCABULARY = "byte_bpe_50k.tiktoken"
RULES = ("start", "end", "majority", "split")
RULE = "majority"


class Encoder:
    def __init__(self, vocabulary: str):
        import public_tokenizers
        import tiktoken

        with open(vocabulary if os.path.isabs(vocabulary) else public_tokenizers.path(vocabulary), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.encoding = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.length = np.zeros(max(ranks.values()) + 1, np.int64)
        for token, i in ranks.items():
            self.length[i] = len(token)

    def ids(self, text: str) -> np.ndarray:
        return np.asarray(self.encoding.encode_to_numpy(text, disallowed_special=()), np.int64)


_ENCODERS: dict[str, Encoder] = {}


def encoder(vocabulary: str) -> Encoder:
    """One per worker process."""
    if vocabulary not in _ENCODERS:
        _ENCODERS[vocabulary] = Encoder(vocabulary)
    return _ENCODERS[vocabulary]


def section_starts(data: np.ndarray, off: np.ndarray, separator: bytes) -> np.ndarray:
    """Sorted starts of the sections of all rows: each row's start (twice for an empty row's neighbours is meant) and what follows a separator inside it."""
    sep = np.frombuffer(separator, np.uint8)
    hit = np.ones(max(0, len(data) - len(sep) + 1), bool)
    for i, b in enumerate(sep):
        hit &= data[i : i + len(hit)] == b
    at = np.flatnonzero(hit)
    if len(sep) > 1 and len(at):  # the leftmost of overlapping ones
        keep, last = [], -len(sep)
        for a in at.tolist():
            if a >= last + len(sep):
                keep.append(a)
                last = a
        at = np.array(keep, np.int64)
    row = np.searchsorted(off, at, "right") - 1
    after = at + len(sep)
    after = after[(after < off[row + 1])]
    return np.sort(np.concatenate([off[:-1], after]), kind="stable")


def attribute(start: np.ndarray, end: np.ndarray, sections: np.ndarray, total: int, rule: str) -> tuple[np.ndarray, np.ndarray]:
    """(tokens, crossing tokens) of each section. start, end: the tokens' bytes; sections: sorted starts."""
    first = np.searchsorted(sections, start, "right") - 1
    last = np.searchsorted(sections, end - 1, "right") - 1
    n = len(sections)
    cross = np.flatnonzero(first != last)
    crossing = np.bincount(first[cross], minlength=n)
    if rule == "start":
        return np.bincount(first, minlength=n).astype(float), crossing
    if rule == "end":
        return np.bincount(last, minlength=n).astype(float), crossing
    out = np.bincount(first[first == last], minlength=n).astype(float)
    if len(cross):
        k = (last - first + 1)[cross]
        part = ranges(first[cross], k)
        who = np.repeat(np.arange(len(cross)), k)
        size = np.minimum(end[cross][who], np.append(sections, total)[part + 1]) - np.maximum(start[cross][who], sections[part])
        if rule == "split":
            out += np.bincount(part, size / (end - start)[cross][who], n)
        else:
            order = np.lexsort((part, -size, who))
            lead = order[np.concatenate([[True], who[order][1:] != who[order][:-1]])]
            out += np.bincount(part[lead], minlength=n)
    return out, crossing


def _count(vocabulary: str, separator: bytes, rule: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(vocabulary)
        for batch in batches:
            ids = np.asarray(column(batch, "doc_id").fill_null(0))
            none = np.asarray(column(batch, "doc_id").is_null())
            data, off = buffer(column(batch, "text"))
            for i, j, d, o in chunks(data, off, 1 << 20):
                raw = d.tobytes()
                tokens = [enc.ids(raw[a:b].decode()) for a, b in zip(o[:-1].tolist(), o[1:].tolist(), strict=True)]
                length = enc.length[np.concatenate(tokens)] if tokens else np.zeros(0, np.int64)
                end = np.cumsum(length)
                sections = section_starts(d, o, separator)
                count, crossing = attribute(end - length, end, sections, len(d), rule)
                row = np.searchsorted(o[:-1], sections, "right") - 1
                empty = np.flatnonzero(np.diff(o) == 0)
                if len(empty):  # rows that start at one place: each has its own first section
                    starts = np.concatenate([o[:-1], np.setdiff1d(sections, o[:-1])])
                    rows = np.concatenate([np.arange(len(o) - 1), np.searchsorted(o, np.setdiff1d(sections, o[:-1]), "right") - 1])
                    order = np.lexsort((starts, rows))
                    row = rows[order]
                    sections = starts[order]
                chars = np.concatenate([[0], np.cumsum((d & 0xC0) != 0x80)])
                until = np.minimum(np.append(sections[1:], len(d)), o[row + 1])
                lead = np.searchsorted(row, np.arange(len(o) - 1))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(ids[i:j][row], pa.int64(), mask=none[i:j][row]),
                        *(pa.array(x.astype(np.int64)) for x in (np.arange(len(row)) - lead[row], chars[sections] - chars[o[row]], chars[until] - chars[o[row]])),
                        pa.array(count),
                        pa.array(crossing.astype(np.int64)),
                    ],
                    ["doc_id", "section", "start", "end", "n_tokens", "n_crossing"],
                )

    return run


def section_tokens(docs: DataFrame, rule: str = RULE, separator: str = "\n", vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, section, start, end, n_tokens, n_crossing) for each section of each row of docs (doc_id, text; further columns don't matter).

    start, end: characters. n_crossing: tokens that start in the section and end in a later one. The counts of a document's
    sections sum to the number of its tokens, whatever the rule. A null or empty text has one empty section. Repeated rows
    come back once each.
    """
    if rule not in RULES:
        raise ValueError(f"rule {rule!r} isn't one of {RULES}")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(lean(_count(vocabulary, separator.encode(), rule), "text"), "doc_id long, section long, start long, end long, n_tokens double, n_crossing long")


def op6_token_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return section_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"))
