"""Exact removal of repeated byte strings with a hash-compared suffix sort.

A byte goes when a string of LENGTH bytes that covers it also starts earlier. The strings are compared by a mergesort whose
comparisons find the common extension of two suffixes by binary search over prefix polynomial hashes (logarithmic in
LENGTH); equal neighbours are then verified byte by byte.

Sorting all suffixes of a corpus in one place is out of the question, so the suffixes are dealt to tasks such that equal
strings always meet:

1. Each string of LENGTH bytes has an anchor: the 24-byte gram in it with the least hash (the leftmost of equal ones). It
   depends on the string alone, so equal strings have equal anchors at equal places. Consecutive strings with one anchor
   form its context. Each batch of documents sends, for the first occurrence of each (anchor, context) in it, the anchor's
   hash, two 64-bit hashes of the context with different bases, and its place to the fragment of the anchor's hash; the
   later ones are repeats as a whole. An anchor with many different contexts in one batch is wide in its task from then
   on: its contexts go to fragments of their own hashes, and the anchor's fragment is told.
2. A fragment sees all contexts of its anchors, but for wide ones. Of equal contexts all but the first are repeats. An
   anchor with several different contexts (the ends of common passages) leaves one of each to step 3; an anchor that
   occurs once is done.
3. For those only, the bytes of the contexts are fetched, and their strings are suffix sorted per (anchor, place in the
   context). A wide anchor, or one with very many contexts, is dealt out by the hash of each string instead, and each
   batch sends the first of equal strings only; the others are repeats.
4. The repeats are joined with the documents; their union is cut out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._bytes import BASES, CHUNK, PrefixHash, buffer, chunks, column, lean, lean_group, mix, ranges
from ._store import files_for, input_bytes, partitions, written

LENGTH = 100
GRAM = 24
#: Contexts of one anchor beyond which its strings are dealt out by their own hashes.
HOT = 4_000
#: Different contexts of one anchor in one batch of SLICE bytes that make it wide; an anchor below that in every batch
#: leaves its fragment fewer than SPREAD rows of some 40 bytes for each SLICE of input, 0.02 % of it.
SPREAD = 32
#: Bytes of text whose contexts a worker holds at once.
SLICE = 8 << 20
#: Bytes of input files whose contexts a fragment holds on average, at most.
FRAGMENT = 16 << 20
#: Strings sorted at once in a task.
PIECE = 300_000


def _sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    n = len(x) - w + 1
    full = np.full(-(-len(x) // w) * w, np.iinfo(np.uint64).max, np.uint64)
    full[: len(x)] = x
    rows = full.reshape(-1, w)
    ahead = np.minimum.accumulate(rows, axis=1).ravel()
    back = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[:n], ahead[w - 1 : w - 1 + n])


def contexts(data: np.ndarray, off: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """Per anchor occurrence: hash of the anchor, hash of its context, row, first string's start in the row, anchor's place, strings less one, another hash of the context."""
    size = np.diff(off)
    at = ranges(off[:-1], np.maximum(0, size - length + 1))
    if not len(at):
        return tuple(np.zeros(0, t) for t in (np.uint64, np.uint64, np.int64, np.int64, np.int64, np.int64, np.uint64))
    p = PrefixHash(data, 0)
    g = mix((p.sums[gram:] - p.sums[:-gram]) * p.inverse[: len(data) - gram + 1])
    low = np.uint64(2**32 - 1)
    key = (g & ~low) | np.arange(len(g), dtype=np.uint64)
    anchor = (_sliding_min(key, length - gram + 1)[at] & low).astype(np.int64)
    cut = np.flatnonzero(np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (at[1:] != at[:-1] + 1)]))
    first, last = at[cut], at[np.append(cut[1:], len(at)) - 1]
    anchor = anchor[cut]
    place, more = anchor - first, last - first
    c = mix(PrefixHash(data, 1).of(first, last + length) ^ mix((place << 32 | more).astype(np.uint64)))
    row = np.searchsorted(off, first, "right") - 1
    return mix(g[anchor] + np.uint64(BASES[0])), c, row, first - off[row], place, more, mix(p.of(first, last + length))  # the least of many hashes is small: mixed again, it spreads over the fragments


def _contexts(data: np.ndarray, off: np.ndarray, length: int, gram: int) -> Iterator[tuple[np.ndarray, ...]]:
    """The same in parts of a long text. A context that a cut parts is two: equal strings in it have one anchor still, and are found by their bytes."""
    if len(off) > 2 or len(data) <= 2 * CHUNK:
        yield contexts(data, off, length, gram)
        return
    for i in range(0, len(data) - length + 1, CHUNK):
        h, c, row, s, place, more, c2 = contexts(data[i : i + CHUNK + length - 1], np.array([0, min(len(data) - i, CHUNK + length - 1)]), length, gram)
        yield h, c, row, s + i, place, more, c2


#: a..g: columns of contexts; m: the anchors of the part that are wide.
_SENT = pa.schema([("part", pa.string()), *((c, pa.binary()) for c in "abcdefgm")])
_SENT_SQL = "part string, a binary, b binary, c binary, d binary, e binary, f binary, g binary, m binary"
_FOUND = pa.schema([("doc_id", pa.int64()), ("s", pa.int64()), ("e", pa.int64()), ("h", pa.int64()), ("place", pa.int64()), ("several", pa.int64())])
_FOUND_SQL = "doc_id long, s long, e long, h long, place long, several long"


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(ids, bytes, offsets) of up to SLICE bytes, or of one longer text."""
    for batch in batches:
        ids = np.asarray(column(batch, "doc_id"))
        for i, j, data, off in chunks(*buffer(column(batch, "text")), SLICE):
            yield ids[i:j], data, off


def _send(fragments: int, length: int, gram: int, spread: int):
    def dealt(key: np.ndarray) -> np.ndarray:
        return (key >> np.uint64(32)) * np.uint64(fragments) >> np.uint64(32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        wide = np.zeros(0, np.uint64)
        for number, (ids, data, off) in enumerate(_slices(batches)):
            parts = [(i, x) for i, _, d, o in chunks(data, off) for x in _contexts(d, o, length, gram)]
            h, c, row, s, place, more, c2 = (np.concatenate([p[k] for _, p in parts]) if k != 2 else np.concatenate([p[2] + i for i, p in parts]) for k in range(7))
            doc = ids[row]
            order = np.lexsort((s, doc, c2, c, h))
            h, c, doc, s, place, more, c2 = (x[order] for x in (h, c, doc, s, place, more, c2))
            new = np.ones(len(h), bool)
            new[1:] = (h[1:] != h[:-1]) | (c[1:] != c[:-1]) | (c2[1:] != c2[:-1])
            lead = np.flatnonzero(new)[np.cumsum(new) - 1]
            again = ~new & ((doc != doc[lead]) | (s != s[lead]))
            out = []
            if again.any():
                out.append((f"own {task} {number}", None, None, doc[again].tobytes(), s[again].tobytes(), (s + more + length)[again].tobytes(), None, None, None))
            cols = (h[new], c[new], doc[new].astype(np.int64), s[new].astype(np.uint32), place[new].astype(np.uint16), more[new].astype(np.uint16), c2[new])
            anchors, count = np.unique(cols[0], return_counts=True)
            fresh = np.setdiff1d(anchors[count >= spread], wide)
            wide = np.union1d(wide, fresh)
            apart = np.isin(cols[0], wide)
            told = dealt(fresh)
            for name, mine, key in (("", ~apart, 0), ("wide ", apart, 1)):
                rows = np.flatnonzero(mine)
                frag = dealt(cols[key][rows])
                if key:
                    o = np.argsort(frag, kind="stable")
                    rows, frag = rows[o], frag[o]
                own = [x[rows] for x in cols]
                cut, mark = np.searchsorted(frag, np.arange(fragments + 1)), np.searchsorted(told, np.arange(fragments + 1))
                for f in np.unique(np.concatenate([frag, told] if not key else [frag])).tolist():
                    marks = fresh[mark[f] : mark[f + 1]] if not key else fresh[:0]
                    out.append((f"{name}{f}", *(x[cut[f] : cut[f + 1]].tobytes() for x in own), marks.tobytes()))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), _SENT.types, strict=True)], schema=_SENT)

    return run


def _meet(length: int, hot: int):
    def run(table: pa.Table) -> pa.Table:
        part = table.column("part")[0].as_py()
        if part.startswith("own"):
            doc, s, e = (np.concatenate([np.frombuffer(x.as_py(), np.int64) for x in table.column(c)]) for c in "cde")
            none = pa.nulls(len(doc), pa.int64())
            return pa.table([doc, s, e, none, none, none], schema=_FOUND)
        kinds = dict(zip("abcdefg", (np.uint64, np.uint64, np.int64, np.uint32, np.uint16, np.uint16, np.uint64), strict=True))
        h, c, doc, s, place, more, c2 = (np.concatenate([np.frombuffer(x.as_py(), t) for x in table.column(n)]) for n, t in kinds.items())
        marks = np.concatenate([np.frombuffer(x.as_py(), np.uint64) for x in table.column("m")])
        if not len(h):
            return _FOUND.empty_table()
        order = np.lexsort((s, doc, c2, c, h))
        h, c, c2 = h[order], c[order], c2[order]
        other = np.concatenate([[True], h[1:] != h[:-1]])
        new = other.copy()
        new[1:] |= (c[1:] != c[:-1]) | (c2[1:] != c2[:-1])
        del c, c2
        several = np.add.reduceat(new.astype(np.int64), np.flatnonzero(other))[np.cumsum(other) - 1]
        several[np.isin(h, marks) if part[:4] != "wide" else slice(None)] = hot + 1
        lead = np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))
        again = ~new & ((doc[order] != doc[order[lead]]) | (s[order] != s[order[lead]]))
        asked = new & (several > 1)
        del lead, other, new
        both = np.flatnonzero(again | asked)
        asked, at = asked[both], order[both]
        start = s[at].astype(np.int64)
        end = start + more[at] + length
        cols = (h[both].view(np.int64), place[at].astype(np.int64), several[both])
        return pa.table([doc[at], start, end, *(pa.array(x, pa.int64(), mask=~asked) for x in cols)], schema=_FOUND)

    return run


#: Without bytes: a repeat that is known already.
_BYTES = pa.schema([("task", pa.int64()), ("h", pa.int64()), ("doc_id", pa.int64()), ("s", pa.int64()), ("e", pa.int64()), ("place", pa.int64()), ("bytes", pa.binary())])
_BYTES_SQL = "task long, h long, doc_id long, s long, e long, place long, bytes binary"


def _lists(batch: pa.RecordBatch, name: str, fields: tuple[str, ...]) -> tuple[np.ndarray, list[np.ndarray]]:
    """Row and fields of each struct in a list column."""
    col = column(batch, name)
    flat = col.flatten()
    count = np.asarray(col.value_lengths().fill_null(0))
    return np.repeat(np.arange(len(col)), count), [np.asarray(flat.field(f)) for f in fields]


def _again(data: np.ndarray, pos: np.ndarray, keys: tuple[np.ndarray, ...], doc: np.ndarray, start: np.ndarray, length: int) -> np.ndarray:
    """Which strings have the keys and the bytes of an earlier one, the first of those with its keys."""
    order = np.lexsort((start, doc, *keys))
    new = np.ones(len(order), bool)
    new[1:] = np.logical_or.reduce([k[order[1:]] != k[order[:-1]] for k in keys])
    lead = order[np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))]
    at = np.flatnonzero((doc[order] != doc[lead]) | (start[order] != start[lead]))
    out, span = np.zeros(len(order), bool), np.arange(length)
    for x in np.array_split(at, len(at) // 50_000 + 1):
        out[order[x]] = (data[pos[order[x]][:, None] + span] == data[pos[lead[x]][:, None] + span]).all(axis=1)
    return out


def _runs(doc: np.ndarray, s: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(doc, start, end) of the runs of strings of `length` bytes that start at consecutive bytes."""
    o = np.lexsort((s, doc))
    doc, s = doc[o], s[o]
    cut = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (s[1:] > s[:-1] + 1)]))
    return doc[cut], s[cut], s[np.append(cut[1:], len(s)) - 1] + length


def _known(doc: np.ndarray, s: np.ndarray, length: int, tasks: int) -> pa.RecordBatch:
    doc, s, e = _runs(doc, s, length)
    zero = pa.array(np.zeros(len(doc), np.int64))
    return pa.RecordBatch.from_arrays([pa.array(doc % tasks), zero, pa.array(doc), pa.array(s), pa.array(e), zero, pa.nulls(len(doc), pa.binary())], schema=_BYTES)


def _fetch(tasks: int, length: int, hot: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = np.asarray(column(batch, "doc_id"))
            data, off = buffer(column(batch, "text"))
            row, (s, e, h, place, several) = _lists(batch, "asked", ("s", "e", "h", "place", "several"))
            task = h % tasks
            wide = several > hot
            if wide.any():  # one row for each string
                k = (e - s - length + 1)[wide]
                shift = ranges(np.zeros(len(k), np.int64), k)
                r, s2, h2, p2 = (np.repeat(x[wide], k) for x in (row, s, h, place))
                s2, p2 = s2 + shift, p2 - shift
                key = np.zeros(len(s2), np.uint64)
                for i, _, d, o in chunks(data, off):
                    mine = np.flatnonzero((r >= i) & (r < i + len(o) - 1))
                    a = o[r[mine] - i] + s2[mine]
                    key[mine] = mix(PrefixHash(d, 1).of(a, a + length) ^ (h2[mine] + p2[mine]).view(np.uint64))
                again = _again(data, off[r] + s2, (key, h2, p2), ids[r], s2, length)
                if again.any():
                    yield _known(ids[r[again]], s2[again], length, tasks)
                    r, s2, h2, p2, key = (x[~again] for x in (r, s2, h2, p2, key))
                own = (key >> np.uint64(2)).astype(np.int64) % tasks
                keep = ~wide
                row, s, e, h, place, task = (np.concatenate(x) for x in ((row[keep], r), (s[keep], s2), (e[keep], s2 + length), (h[keep], h2), (place[keep], p2), (task[keep], own)))
            for i in range(0, len(s), 100_000):
                x = slice(i, i + 100_000)
                size = (e - s)[x]
                raw = data[ranges(off[row[x]] + s[x], size)]
                to = np.concatenate([[0], np.cumsum(size)]).astype(np.int32)
                text = pa.BinaryArray.from_buffers(pa.binary(), len(size), [None, pa.py_buffer(to), pa.py_buffer(raw)])
                yield pa.RecordBatch.from_arrays([pa.array(task[x]), pa.array(h[x]), pa.array(ids[row[x]]), pa.array(s[x]), pa.array(e[x]), pa.array(place[x]), text], schema=_BYTES)

    return run


class Suffixes:
    """Suffixes of one byte buffer, compared over `length` bytes by prefix hashes."""

    def __init__(self, data: np.ndarray, length: int):
        self.data, self.length, self.hash = data, length, PrefixHash(data, 0)

    def common(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Length of the common extension, `length` at most, by binary search."""
        found = np.zeros(len(x), np.int64)
        step = 1 << (self.length.bit_length() - 1)
        sums, inverse = self.hash.sums, self.hash.inverse
        sx, sy, ix, iy = sums[x], sums[y], inverse[x], inverse[y]
        while step:
            mid = np.minimum(found + step, self.length)
            same = (sums[x + mid] - sx) * ix == (sums[y + mid] - sy) * iy
            found = np.where(same, mid, found)
            step >>= 1
        return found

    def less(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        k = self.common(x, y)
        i = np.minimum(k, self.length - 1)
        return (k < self.length) & (self.data[x + i] < self.data[y + i])

    def sort(self, pos: np.ndarray, segment: np.ndarray) -> np.ndarray:
        """Stable order of the suffixes at pos inside each segment (segments are consecutive): a bottom-up mergesort, all merges of a round at once."""
        n = len(pos)
        order = np.arange(n)
        edge = np.flatnonzero(np.concatenate([[True], segment[1:] != segment[:-1]])) if n else np.zeros(0, np.int64)
        size = np.diff(np.append(edge, n))
        begin, count = np.repeat(edge, size), np.repeat(size, size)
        width = 1
        while n and width < size.max():
            act = np.flatnonzero(count > width)
            t = act - begin[act]
            left0 = begin[act] + t // (2 * width) * (2 * width)
            end = np.minimum(left0 + 2 * width, begin[act] + count[act])
            mid = np.minimum(left0 + width, end)
            is_left = act < mid
            pair = mid < end
            act, left0, mid, end, is_left = (x[pair] for x in (act, left0, mid, end, is_left))
            me = pos[order[act]]
            lo, hi = np.where(is_left, mid, left0), np.where(is_left, end, mid)
            base = lo.copy()
            open_ = np.flatnonzero(lo < hi)
            while len(open_):
                m = (lo[open_] + hi[open_]) >> 1
                other, own, on_left = pos[order[m]], me[open_], is_left[open_]
                low = self.less(np.where(on_left, other, own), np.where(on_left, own, other))
                right = np.where(on_left, low, ~low)
                lo[open_] = np.where(right, m + 1, lo[open_])
                hi[open_] = np.where(right, hi[open_], m)
                open_ = open_[lo[open_] < hi[open_]]
            to = act + (lo - base) - np.where(is_left, 0, mid - left0)
            fresh = order.copy()
            fresh[to] = order[act]
            order = fresh
            width *= 2
        return order


def repeats(data: np.ndarray, pos: np.ndarray, segment: np.ndarray, doc: np.ndarray, start: np.ndarray, length: int) -> np.ndarray:
    """Which strings equal an earlier one of their segment. Rows must be sorted by (segment, doc, start)."""
    s = Suffixes(data, length)
    order = s.sort(pos, segment)
    n = len(order)
    same = np.zeros(n, bool)
    if n > 1:
        a, b = order[:-1], order[1:]
        near = np.flatnonzero(segment[a] == segment[b])
        near = near[s.common(pos[a[near]], pos[b[near]]) == length]
        span = np.arange(length)
        sure = np.concatenate([(data[pos[a[x]][:, None] + span] == data[pos[b[x]][:, None] + span]).all(axis=1) for x in np.array_split(near, len(near) // 50_000 + 1)]) if len(near) else np.zeros(0, bool)
        same[near + 1] = True
        if not sure.all():  # two strings with one hash: settle the run by its bytes
            return _by_bytes(data, pos, segment, doc, start, length)
    lead = np.maximum.accumulate(np.where(same, 0, np.arange(n)))
    out = np.zeros(n, bool)
    out[order] = same & ((doc[order] != doc[order[lead]]) | (start[order] != start[order[lead]]))
    return out


def _by_bytes(data, pos, segment, doc, start, length):
    seen: dict = {}
    out = np.zeros(len(pos), bool)
    for i in range(len(pos)):
        key = (int(segment[i]), data[pos[i] : pos[i] + length].tobytes())
        out[i] = seen.setdefault(key, (doc[i], start[i])) != (doc[i], start[i])
    return out


_SPANS = pa.schema([("doc_id", pa.int64()), ("s", pa.int64()), ("e", pa.int64())])


def _sort_task(length: int):
    def run(table: pa.Table) -> pa.Table:
        known = table.filter(pc.is_null(table.column("bytes")))
        table = table.filter(pc.is_valid(table.column("bytes")))
        out = [tuple(np.asarray(known.column(c).combine_chunks()) for c in ("doc_id", "s", "e"))] if len(known) else []
        h, doc, s, place = (np.asarray(table.column(c).combine_chunks()) for c in ("h", "doc_id", "s", "place"))
        text = table.column("bytes").combine_chunks()
        data, off = buffer(text)
        order = np.argsort(h, kind="stable")
        count = (np.diff(off) - length + 1)[order]
        ho = h[order]
        piece = np.cumsum(count) // PIECE
        piece = np.maximum.accumulate(np.where(np.concatenate([[True], ho[1:] != ho[:-1]]), piece, 0))
        for rows in np.split(order, np.flatnonzero(np.diff(piece)) + 1) if len(order) else []:
            size = np.diff(off)[rows]
            own = data[ranges(off[rows], size)]
            to = np.cumsum(size) - size
            k = size - length + 1
            shift = ranges(np.zeros(len(k), np.int64), k)
            pos, hh, dd, ss, pp = (np.repeat(x, k) for x in (to, h[rows], doc[rows], s[rows], place[rows]))
            pos, ss, pp = pos + shift, ss + shift, pp - shift
            o = np.lexsort((ss, dd, pp, hh))
            pos, hh, dd, ss, pp = (x[o] for x in (pos, hh, dd, ss, pp))
            new = np.concatenate([[True], (hh[1:] != hh[:-1]) | (pp[1:] != pp[:-1])])
            hit = repeats(own, pos, np.cumsum(new), dd, ss, length)
            if hit.any():
                out.append(_runs(dd[hit], ss[hit], length))
        return pa.table([np.concatenate([x[i] for x in out]) if out else np.zeros(0, np.int64) for i in range(3)], schema=_SPANS)

    return run


def _cut_out(keep_text: bool, carry: bool = False):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, off = buffer(column(batch, "text"))
            row, (s, e) = _lists(batch, "spans", ("s", "e"))
            order = np.lexsort((s, row))
            cut = np.searchsorted(row[order], np.arange(batch.num_rows + 1))
            s, e = s[order], e[order]
            removed, spans, sha, texts = [], [], [], []
            for i in range(batch.num_rows):
                text = data[off[i] : off[i + 1]]
                a, b = s[cut[i] : cut[i + 1]], e[cut[i] : cut[i + 1]]
                if len(a):
                    far = np.maximum.accumulate(b)
                    new = np.concatenate([[True], a[1:] > far[:-1]])
                    lead = np.flatnonzero(new)
                    a, b = a[new], far[np.append(lead[1:], len(far)) - 1]
                    gone = np.zeros(len(text) + 1, np.int8)
                    gone[a] += 1
                    gone[b] -= 1
                    text = text[np.cumsum(gone[:-1]) == 0]
                removed.append(int((b - a).sum()))
                spans.append(len(a))
                raw = text.tobytes()
                sha.append(hashlib.sha256(raw).hexdigest())
                if keep_text:
                    texts.append(raw.decode("utf-8", "ignore"))
            out = [column(batch, "doc_id"), pa.array(np.diff(off)), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(sha, pa.string())]
            if keep_text:
                out.append(pa.array(texts, pa.string()))
            if carry:
                out.append(column(batch, "row"))
            yield pa.RecordBatch.from_arrays(out, _RESULT + ["kept_text"] * keep_text + ["row"] * carry)

    return run


_RESULT = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]


def remove_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, hot: int = HOT, spread: int = SPREAD, keep_text: bool = False, carry: list[str] | None = None) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256[, kept_text][, row]) for each row of docs (doc_id, text; further columns don't matter).

    Texts count as UTF-8 bytes, null as empty. Of a string of `length` bytes the occurrence with the smallest (doc_id,
    start) stays. kept_text drops characters of which only some bytes are left. Rows that repeat a doc_id and text are one
    document and come back once each; of rows that share a doc_id but not the text, the text with the smallest hash stands
    for the document, and the others, like rows without a doc_id, come back whole and repeat nothing. row: the columns
    that carry names, as a struct.
    """
    spark = docs.sparkSession
    n = partitions(spark)
    more = [F.struct(*[F.col(f"`{c}`") for c in carry]).alias("row")] if carry else []
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), *more)
    names = docs.columns
    own = docs.where("doc_id is not null")
    rest = docs.where("doc_id is null")
    several = own.select("doc_id", F.xxhash64("text").alias("x")).groupBy("doc_id").agg(F.min("x").alias("least"), F.max("x").alias("most")).where("least <> most").drop("most")
    few, many = files_for(docs, 128 << 20), files_for(docs, 4 << 20)
    several = written(several, few)
    if several.limit(1).count():
        marked = own.join(several, "doc_id", "left")
        rest = rest.union(marked.where(F.xxhash64("text") > F.col("least")).select(names))
        own = marked.where(F.col("least").isNull() | (F.xxhash64("text") == F.col("least"))).select(names)
    texts = own.select("doc_id", "text")
    fragments = max(2 * n, input_bytes(texts) // FRAGMENT)
    found = written(texts.mapInArrow(lean(_send(fragments, length, gram, spread)), _SENT_SQL).groupBy("part").applyInArrow(lean_group(_meet(length, hot)), _FOUND_SQL), many)
    asked = found.where("place is not null").groupBy("doc_id").agg(F.collect_list(F.struct("s", "e", "h", "place", "several")).alias("asked"))
    fetched = texts.repartition(n, "doc_id").join(asked.hint("shuffle_hash"), "doc_id").select("doc_id", "text", "asked").mapInArrow(lean(_fetch(max(4 * n, 2 * fragments), length, hot), "text"), _BYTES_SQL)
    sorted_ = written(fetched.groupBy("task").applyInArrow(lean_group(_sort_task(length)), "doc_id long, s long, e long"), many)
    spans = found.where("place is null").select("doc_id", "s", "e").union(sorted_).groupBy("doc_id").agg(F.collect_list(F.struct("s", "e")).alias("spans"))
    schema = T._parse_datatype_string("doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept_text string" * keep_text)
    schema = T.StructType([*schema.fields, *[docs.schema[c] for c in names[2:]]])
    cut = lean(_cut_out(keep_text, bool(carry)), "text")
    out = own.repartition(n, "doc_id").join(spans.hint("shuffle_hash"), "doc_id", "left").select("doc_id", "text", "spans", *names[2:]).mapInArrow(cut, schema)
    whole = rest.withColumn("spans", F.array().cast("array<struct<s:long,e:long>>")).select("doc_id", "text", "spans", *names[2:]).mapInArrow(cut, schema)
    return out.union(whole)


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the texts lose their repeated strings; a document of which nothing is left, empty and null texts included, goes.

    Rows without a doc_id, and all texts but one of a doc_id that several share, stay whole. Rows that repeat doc_id and
    text are cut alike. All other columns stay as they are, whatever their names; an empty table gives an empty one.
    """
    own = [c for c in docs.columns if c not in ("text", "n_chars")]
    got = remove_repeats(docs, keep_text=True, carry=own).where("kept_text <> ''")
    kind = dict(docs.dtypes)
    cols = {"text": F.col("kept_text").cast(kind["text"])} | ({"n_chars": F.length("kept_text").cast(kind["n_chars"])} if "n_chars" in kind else {})
    return got.select(*[cols[c].alias(c) if c in cols else F.col("row")[c].alias(c) for c in docs.columns])
