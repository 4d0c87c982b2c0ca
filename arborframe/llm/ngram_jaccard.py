"""N-gram Jaccard join by vertical partitioning.

The global n-gram order is cut into fragments. A fragment holds every document's n-grams of one range of the order, so
fragments count overlaps on their own and the counts are summed.

1. Every document's distinct 5-word shingles, as 64-bit hashes, go to the fragment of their hash range. A fragment counts
   how many of a document's shingles some other document has; the sums over all fragments bound the document's overlap
   with any other one. Documents below the threshold even so can't link (on prose, nine in ten). A batch of documents
   sends a shingle that several of them have once, with their number, so that a shingle of a third of all documents is
   one entry for each batch.
2. The others (one for each distinct set) go through the fragments again, which now return each shingle's document
   frequency. Ordered by (frequency, hash), two documents that link share a shingle in their prefixes.
3. Of the documents of a prefix shingle the one whose prefix shingles have the most documents in all is its pivot (the text
   that near copies were made from has more of them than any copy). Each document is paired with the pivot that it shares most
   prefix shingles with (one pair a document, whatever the size of its group). The order is cut into RANGES; each range
   emits the partial overlap of a pair there, and the partial overlaps are summed per pair. Links connect documents into parts.
4. Prefix shingles whose documents lie in several parts may hold further links. Their documents form candidate groups, found by a
   star per shingle (one edge a document), never by pairs. Each group is one task, a large one many tasks: one for each block and
   one for each two blocks, which compares only across. There pivots count overlaps with the others range by range, sum them per
   pair and drop a pair once the rest can't reach the threshold; pairs whose documents are already connected are left out,
   which changes no component. Only edges of a spanning forest leave a task.

All pairs of a group of n near copies would be n^2 rows; steps 3 and 4 emit fewer than n. Nothing is broadcast or collected but the state of the component rounds (two numbers).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._bytes import LOWER, buffer, chunks, column, hashes, lean, lean_group, mix, ranges, word_spans
from ._graph import components
from ._store import files_for, input_bytes, partitions, stable, written

WORDS = 5
PERCENT = 75
#: Documents in a block of a large candidate group.
BLOCK = 2048
#: Ranges of the order in which the overlaps of pairs are counted.
RANGES = 8
#: Bytes of input files whose shingles a fragment holds on average, at most.
FRAGMENT = 16 << 20
_FACTORS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)


def shingles(data: np.ndarray, off: np.ndarray, words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Each row's distinct shingle hashes in ascending order, one row after the other, and how many each row has."""
    low = LOWER[data]
    start, end, first = word_spans(low, off)
    each = mix(hashes(low, start, end) ^ (end - start).astype(np.uint64))
    n = np.diff(first)
    k = np.where(n >= words, n - words + 1, n > 0)
    at = ranges(first[:-1], k)
    last = np.repeat(first[1:], k)
    out = np.zeros(len(at), np.uint64)
    each = np.append(each, np.zeros(words, np.uint64))
    for j in range(words):
        term = each[at + j] * mix(_FACTORS[j % 5 : j % 5 + 1] + np.uint64(j))
        term[at + j >= last] = 0
        out += term
    out = mix(out)
    to = np.concatenate([[0], np.cumsum(k)])
    for i in range(len(k)):
        out[to[i] : to[i + 1]].sort()
    keep = np.ones(len(out), bool)
    keep[1:] = out[1:] != out[:-1]
    keep[to[:-1][k > 0]] = True
    return out[keep], np.add.reduceat(np.append(keep, False), np.minimum(to[:-1], len(keep))) * (k > 0) if len(k) else k


def _set_keys(h: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits that depend on the set alone."""
    to = np.concatenate([[0], np.cumsum(n)])
    out = []
    for salt in (0x5851F42D4C957F2D, 0x14057B7EF767814F):
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(h ^ np.uint64(salt)))])
        out.append((sums[to[1:]] - sums[to[:-1]]).view(np.int64))
    return out[0], out[1]


_ROWS = pa.schema([("part", pa.string()), ("batch", pa.int64()), ("a", pa.binary()), ("b", pa.binary()), *((c, pa.binary()) for c in "cdef")])
_ROWS_SQL = "part string, batch long, a binary, b binary, c binary, d binary, e binary, f binary"


def _to_fragments(fragments: int, words: int, full: bool):
    """Rows of one batch: one for each fragment (row numbers and hashes that one document has; hashes that several have, and their numbers) and
    one of the batch itself (ids, set sizes, set keys, and the entries of the hashes that several have, or how many each row has of them).

    A batch is named by its partition and its number there, which are the same when a lost task runs again.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        for number, batch in enumerate(batches):
            name = task << 32 | number
            ids = np.asarray(column(batch, "doc_id").fill_null(0))
            data, off = buffer(column(batch, "text"))
            parts = [shingles(d, o, words) for _, _, d, o in chunks(data, off)]
            h = np.concatenate([p[0] for p in parts]) if parts else np.zeros(0, np.uint64)
            n = np.concatenate([p[1] for p in parts]).astype(np.int64) if parts else np.zeros(0, np.int64)
            k1, k2 = _set_keys(h, n)
            row = np.repeat(np.arange(len(n), dtype=np.uint32), n)
            order = np.argsort(h, kind="stable")
            row, h = row[order], h[order]
            edge = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])) if len(h) else np.zeros(0, np.int64)
            count = np.diff(np.append(edge, len(h))).astype(np.uint32)
            twice = np.repeat(count > 1, count)
            mine = (row[twice].tobytes(), h[twice].tobytes()) if full else (np.bincount(row[twice], minlength=len(n)).astype(np.int64).tobytes(), None)
            out = [(f"batch {name}", name, ids.astype(np.int64).tobytes(), n.tobytes(), k1.tobytes(), k2.tobytes(), *mine)]
            known, count = h[edge[count > 1]], count[count > 1]
            row, h = row[~twice].astype(np.uint16 if len(n) < 65536 else np.uint32), h[~twice]
            cut, at = (np.searchsorted((x >> np.uint64(32)) * np.uint64(fragments) >> np.uint64(32), np.arange(fragments + 1, dtype=np.uint64)) for x in (h, known))
            h, known = (h, known) if full else (h.astype(np.uint32), known.astype(np.uint32))
            wide = bytes([row.dtype.itemsize])
            for f in np.flatnonzero((cut[1:] > cut[:-1]) | (at[1:] > at[:-1])).tolist():
                x, y = slice(cut[f], cut[f + 1]), slice(at[f], at[f + 1])
                out.append((str(f), name, row[x].tobytes(), h[x].tobytes(), wide, known[y].tobytes(), count[y].tobytes(), None))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), _ROWS.types, strict=True)], schema=_ROWS)

    return run


def _count(full: bool):
    """In one fragment: how many rows have each hash. Returns, by batch, the entries that two rows or more have, and (full) the frequencies of the hashes that several rows of the batch have."""

    def run(table: pa.Table) -> pa.Table:
        if table.column("part")[0].as_py().startswith("batch"):
            return table
        rows = table.to_pylist()
        rows.sort(key=lambda r: r["batch"])
        kind = np.uint64 if full else np.uint32
        h = np.concatenate([np.frombuffer(r[c], kind) for c in "bd" for r in rows])
        own = sum(len(r["b"]) for r in rows) // h.itemsize
        w = np.concatenate([np.ones(own, np.uint32), *(np.frombuffer(r["e"], np.uint32) for r in rows)])
        order = np.argsort(h, kind="stable")
        s = h[order]
        edge = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]]))
        df = np.empty(len(h), np.uint32)
        df[order] = np.repeat(np.minimum(np.add.reduceat(w[order], edge, dtype=np.uint64), 2**32 - 1).astype(np.uint32), np.diff(np.append(edge, len(s))))
        out, at, to = [], 0, own
        for r in rows:
            row, known = np.frombuffer(r["a"], np.uint16 if r["c"] == b"\x02" else np.uint32), len(r["e"]) // 4
            mine, theirs = slice(at, at + len(row)), slice(to, to + known)
            at, to = at + len(row), to + known
            more = df[mine] > 1
            x = row[more].astype(np.uint32)
            if full:
                if more.any() or known:
                    out.append((r["part"], r["batch"], x.tobytes(), h[mine][more].tobytes(), df[mine][more].tobytes(), r["d"], df[theirs].tobytes(), None))
            elif more.any():
                x, c = np.unique(x, return_counts=True)
                out.append((r["part"], r["batch"], x.tobytes(), c.astype(np.uint32).tobytes(), None, None, None, None))
        return pa.Table.from_pylist([dict(zip(_ROWS.names, x, strict=True)) for x in out], schema=_ROWS)

    return run


_STATS = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("k1", pa.int64()), ("k2", pa.int64()), ("shared", pa.int64())])


def _sum_shared(table: pa.Table) -> pa.Table:
    own = [r for r in table.to_pylist() if r["part"].startswith("batch")][0]
    n = np.frombuffer(own["b"], np.int64)
    shared = np.frombuffer(own["e"], np.int64).copy()
    for r in table.to_pylist():
        if r is not own and not r["part"].startswith("batch"):
            shared[np.frombuffer(r["a"], np.uint32)] += np.frombuffer(r["b"], np.uint32)
    return pa.table([np.frombuffer(own["a"], np.int64), n, np.frombuffer(own["c"], np.int64), np.frombuffer(own["d"], np.int64), shared], schema=_STATS)


_SETS = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("prefix", pa.int64()), ("h", pa.binary())])


def _ordered(percent: int):
    """Each document's shingles that others have, in the global order (frequency, hash); prefix: how many of them are in its prefix."""

    def run(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        own = next(r for r in rows if r["part"].startswith("batch"))
        parts = [r for r in rows if not r["part"].startswith("batch")]
        ids, n = np.frombuffer(own["a"], np.int64), np.frombuffer(own["b"], np.int64)
        empty = pa.table({f.name: pa.array([], f.type) for f in _SETS})
        if not parts:
            return empty
        row, h, df = (np.concatenate([np.frombuffer(r[c], t) for r in parts]) for c, t in (("a", np.uint32), ("b", np.uint64), ("c", np.uint32)))
        known, many = (np.concatenate([np.frombuffer(r[c], t) for r in parts]) for c, t in (("d", np.uint64), ("e", np.uint32)))
        mine = np.frombuffer(own["f"], np.uint64)
        at = np.argsort(known)
        at = at[np.searchsorted(known, mine, sorter=at)] if len(mine) else at[:0]
        row, h, df = np.concatenate([row, np.frombuffer(own["e"], np.uint32)]), np.concatenate([h, mine]), np.concatenate([df, many[at]])
        order = np.lexsort((h, df, row))
        row, h = row[order], h[order]
        cut = np.searchsorted(row, np.arange(len(n) + 1))
        have = np.diff(cut)
        prefix = np.minimum(have, (n - -(-percent * n // 100) + 1) - (n - have))
        keep = np.flatnonzero((prefix > 0) & (100 * have >= percent * n) & (n > 0))
        return pa.table([ids[keep], n[keep], prefix[keep], [h[cut[i] : cut[i + 1]].tobytes() for i in keep]], schema=_SETS) if len(keep) else empty

    return run


def _prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, pre = np.asarray(column(batch, "doc_id")), np.asarray(column(batch, "prefix"))
        h = [np.frombuffer(x.as_py(), np.int64)[:p] for x, p in zip(column(batch, "h"), pre, strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(h) if h else np.zeros(0, np.int64)), pa.array(np.repeat(ids, pre))], ["h", "doc_id"])


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each document's shingles in each range of the order that has some."""
    for batch in batches:
        ids, n = np.asarray(column(batch, "doc_id")), np.asarray(column(batch, "n"))
        h = [np.frombuffer(x.as_py(), np.uint64) for x in column(batch, "h")]
        if not h:
            continue
        row, h = np.repeat(np.arange(len(h)), [len(x) for x in h]), np.concatenate(h)
        key = row * RANGES + _range(h)
        order = np.argsort(key, kind="stable")
        key = key[order]
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        part = pa.ListArray.from_arrays(pa.array(np.append(first, len(key)), pa.int32()), pa.array(h[order].view(np.int64)))
        at = key[first] // RANGES
        yield pa.RecordBatch.from_arrays([pa.array(ids[at]), pa.array(n[at]), pa.array((key[first] % RANGES).astype(np.int32)), part], ["doc_id", "n", "part", "h"])


def _range(h: np.ndarray) -> np.ndarray:
    return ((h >> np.uint64(32)) * np.uint64(RANGES) >> np.uint64(32)).astype(np.int64)


def pivot_links(sets: DataFrame, entries: DataFrame, percent: int, files: int | None = None) -> DataFrame:
    """(a, b): links of each document b with the pivot a that it shares most prefix shingles with, where they are one. Partial overlaps are counted in each range of the order and summed per pair."""
    common = entries.groupBy("h").agg(F.count("*").alias("c"))
    weight = entries.join(common, "h").groupBy("doc_id").agg(F.sum("c").alias("w"))
    pivot = entries.join(weight, "doc_id").groupBy("h").agg(F.max_by("doc_id", F.struct("w", F.bitwise_not("doc_id"))).alias("a"))
    shared = entries.join(pivot, "h").where("a <> doc_id").groupBy("doc_id", "a").agg(F.count("*").alias("k"))
    pairs = shared.groupBy(F.col("doc_id").alias("b")).agg(F.max_by("a", F.struct("k", F.bitwise_not("a"))).alias("a"))
    pieces = written(sets.mapInArrow(lean(_pieces), "doc_id long, n long, part int, h array<long>"), files)
    b = pairs.join(pieces.select(F.col("doc_id").alias("b"), F.col("n").alias("nb"), "part", F.col("h").alias("hb")), "b")
    both = b.join(pieces.select(F.col("doc_id").alias("a"), F.col("n").alias("na"), "part", F.col("h").alias("ha")), ["a", "part"])
    partial = both.where(f"100 * least(na, nb) >= {percent} * greatest(na, nb)").select("a", "b", "na", "nb", F.size(F.array_intersect("ha", "hb")).alias("o"))
    total = partial.groupBy("a", "b", "na", "nb").agg(F.sum("o").alias("o"))
    return total.where(f"100 * o >= {percent} * (na + nb - o)").select("a", "b")


_EDGES = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def _postings(values: np.ndarray, rows: np.ndarray, keys: int) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(values, kind="stable")
    return rows[order], np.searchsorted(values[order], np.arange(keys + 1))


def block_links(percent: int):
    """Of the rows in one task: edges that connect what their links connect, beyond what `part` says is connected. Rows of two sides are compared across only."""

    def run(table: pa.Table) -> pa.Table:
        ids, n, pre, part, side = (np.asarray(table.column(c).combine_chunks()) for c in ("doc_id", "n", "prefix", "part", "side"))
        order = np.argsort(ids, kind="stable")
        sets = [np.frombuffer(x.as_py(), np.uint64) for x in table.column("h")]
        ids, n, pre, part, side, sets = ids[order], n[order], pre[order], part[order], side[order], [sets[i] for i in order]
        m, across = len(ids), side.any()
        size = np.array([len(s) for s in sets])
        every = np.concatenate(sets)
        _, code = np.unique(every, return_inverse=True)
        rows, at = np.repeat(np.arange(m), size), np.concatenate([[0], np.cumsum(size)])
        keys, cut = int(code.max()) + 1, _range(every)
        docs, to = _postings(code, rows, keys)
        early = np.arange(len(code)) - at[rows] < pre[rows]
        first, first_to = _postings(code[early], rows[early], keys)
        _, comp = np.unique(part, return_inverse=True)
        out = []
        for x in range(m):
            mine, own = code[at[x] : at[x + 1]], cut[at[x] : at[x + 1]]
            p = mine[: pre[x]]
            near = np.unique(first[ranges(first_to[p], first_to[p + 1] - first_to[p])])
            near = near[(near > x) & (comp[near] != comp[x])]
            if across:
                near = near[side[near] != side[x]]
            if not len(near):
                continue
            need = -(-percent * (n[x] + n[near]) // (100 + percent))
            total, left = np.zeros(len(near), np.int64), len(mine)
            for k in range(RANGES):
                some = mine[own == k]
                if len(some) and len(near):
                    total += np.bincount(docs[ranges(to[some], to[some + 1] - to[some])], minlength=m)[near]
                    left -= len(some)
                    able = total + left >= need
                    near, need, total = near[able], need[able], total[able]
            near = near[100 * total >= percent * (n[x] + n[near] - total)]
            for y in near:
                if comp[y] != comp[x]:
                    out.append((ids[x], ids[y]))
                    comp[comp == comp[y]] = comp[x]
        a, b = zip(*out, strict=True) if out else ((), ())
        return pa.table([pa.array(a, pa.int64()), pa.array(b, pa.int64())], schema=_EDGES)

    return run


def _through_fragments(docs: DataFrame, fragments: int, words: int, full: bool) -> DataFrame:
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(lean(_to_fragments(fragments, words, full)), _ROWS_SQL)
    return rows.groupBy("part").applyInArrow(lean_group(_count(full)), _ROWS_SQL)


def link_components(docs: DataFrame, words: int = WORDS, percent: int = PERCENT, fragments: int | None = None, block: int = BLOCK) -> DataFrame:
    """(doc_id, n_shingles, component_id, class_id) for each row of docs (doc_id, text; further columns don't matter).

    component_id: smallest doc_id reachable by links (100 * intersection >= percent * union of the shingle sets);
    class_id: smallest doc_id with the same set. Words are runs without ASCII white space, A-Z lower-cased. A text with
    fewer than `words` words is one shingle; null, empty or blank texts have none, link with nothing and are their own component.
    Rows with one doc_id are one node, which has the links of all its texts, and come back once each. A null doc_id is
    returned with null component_id and takes no part.
    """
    spark = docs.sparkSession
    docs = stable(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")))
    fragments = fragments or max(2 * partitions(spark), input_bytes(docs) // FRAGMENT)
    few, many = files_for(docs, 128 << 20), files_for(docs, 4 << 20)
    known = docs.where("doc_id is not null")
    stats = written(_through_fragments(known, fragments, words, False).groupBy("batch").applyInArrow(lean_group(_sum_shared), "doc_id long, n long, k1 long, k2 long, shared long"), many)
    linked = stats.where(f"n > 0 and 100 * shared >= {percent} * n")
    classes = written(linked.groupBy("n", "k1", "k2").agg(F.min("doc_id").alias("class_id")), few)
    # written, as rows are named by their place in it; the ids grow with the corpus and are never broadcast
    wanted = written(known.join(classes.select(F.col("class_id").alias("doc_id")).distinct().hint("shuffle_hash"), "doc_id", "left_semi"), many)
    sets = written(_through_fragments(wanted, fragments, words, True).groupBy("batch").applyInArrow(lean_group(_ordered(percent)), "doc_id long, n long, prefix long, h binary"), few)
    entries = sets.mapInArrow(lean(_prefixes), "h long, doc_id long")
    links = written(pivot_links(sets, entries, percent, few), few)
    parts = components(links, files=few)
    placed = entries.join(parts.withColumnRenamed("node", "doc_id"), "doc_id", "left").select("h", "doc_id", F.coalesce("component", "doc_id").alias("part"))
    several = placed.groupBy("h").agg(F.min("part").alias("x"), F.max("part").alias("y"), F.min("doc_id").alias("first")).where("x <> y")
    group = components(placed.join(several, "h").select(F.col("doc_id").alias("a"), F.col("first").alias("b")), files=few)
    blocks = group.groupBy("component").agg(F.ceil(F.count("*") / F.lit(block)).cast("int").alias("blocks"))
    dealt = sets.join(group.withColumnRenamed("node", "doc_id"), "doc_id").join(blocks, "component").join(parts.select(F.col("node").alias("doc_id"), F.col("component").alias("part")), "doc_id", "left")
    dealt = dealt.withColumns({"part": F.coalesce("part", "doc_id"), "own": F.pmod(F.xxhash64("doc_id"), F.col("blocks")).cast("int")})
    one = F.concat(F.lit("s"), F.pmod(F.xxhash64("component"), F.lit(4 * partitions(spark))).cast("string"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    pair = F.concat_ws("/", F.col("component"), F.least("own", "other"), F.greatest("own", "other"))
    columns = ["doc_id", "n", "prefix", "part", "h"]
    tasks = dealt.where("blocks = 1").select(one.alias("task"), *columns, F.lit(0).alias("side")).union(dealt.where("blocks > 1").withColumn("other", other).select(pair.alias("task"), *columns, (F.col("own") > F.col("other")).cast("int").alias("side")))
    edges = tasks.groupBy("task").applyInArrow(lean_group(block_links(percent)), "a long, b long").union(links)
    # a doc_id with several texts joins their classes
    rows = stats.join(classes, ["n", "k1", "k2"], "left").select("doc_id", "n", F.coalesce("class_id", "doc_id").alias("class_id"))
    member = rows.where("n > 0")
    several = member.groupBy("doc_id").agg(F.min("class_id").alias("b"), F.max("class_id").alias("c")).where("b <> c").select("doc_id")
    also = member.join(several, "doc_id").select(F.col("class_id").alias("a"), F.col("doc_id").alias("b"))
    found = components(edges.union(also), files=few).withColumnRenamed("node", "class_id")
    out = rows.join(found, "class_id", "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "class_id").alias("component_id"), "class_id")
    lost = docs.where("doc_id is null").mapInArrow(lean(_sizes(words)), "doc_id long, n_shingles long, component_id long, class_id long")
    return out.union(lost)


def _sizes(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, off = buffer(column(batch, "text"))
            n = [c for _, _, d, o in chunks(data, off) for c in shingles(d, o, words)[1]]
            none = pa.nulls(batch.num_rows, pa.int64())
            yield pa.RecordBatch.from_arrays([none, pa.array(n, pa.int64()), none, none], ["doc_id", "n_shingles", "component_id", "class_id"])

    return run


def op2_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_components(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def first_of_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: of each component the document with the smallest doc_id stays, with all its columns, whatever their names.

    Rows that share a doc_id are one document, of which the row stays whose text (null: empty), then whose other
    columns, have the least hash. Rows without a doc_id can't be told apart and all stay, as do null and empty texts, which
    link with nothing. An empty table gives an empty one.
    """
    gone = link_components(docs).where("doc_id <> component_id").select(F.col("doc_id").alias("id")).distinct()
    names = [F.col("row")[c].alias(c) for c in docs.columns]
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    left = docs.select(F.col("doc_id").cast("long").alias("id"), row).where("id is not null").join(gone.hint("shuffle_hash"), "id", "left_anti")
    several = written(docs.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("id")).agg(F.count("*").alias("k")).where("k > 1").select("id", F.lit(True).alias("shared")), files_for(docs, 128 << 20))
    out = docs.where("doc_id is null")
    if not several.limit(1).count():
        return out.union(left.select(*names))
    left = left.join(several, "id", "left")
    hashed = [F.col("row")[f.name] for f in docs.schema.fields if f.dataType.typeName() not in ("map", "variant")]
    order = F.struct(F.xxhash64(F.coalesce(F.col("row.text").cast("string"), F.lit(""))), F.xxhash64(*hashed))
    return out.union(left.where("shared is null").select(*names)).union(left.where("shared").groupBy("id").agg(F.min_by("row", order).alias("row")).select(*names))


#: DuckDB; LINKS is shared with the pipeline.
LINKS_SQL = """
w as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') as v from {docs}),
s as (select distinct doc_id, unnest(case when len(v) = 0 then [] when len(v) < 5 then [array_to_string(v, ' ')] else list_transform(range(1, len(v) - 3), lambda i: array_to_string(v[i:i + 4], ' ')) end) as x from w),
c as (select doc_id, count(*) as n from s group by all),
p as (select a.doc_id as a, b.doc_id as b, count(*) as k from s a join s b on a.x = b.x and a.doc_id < b.doc_id group by all),
l as (select a, b from p join c ca on ca.doc_id = a join c cb on cb.doc_id = b where 100 * k >= 75 * (ca.n + cb.n - k)),
e as (select a, b from l union all select b, a from l),
r as (select doc_id, doc_id as root from {docs} union select e.a, r.root from r join e on e.b = r.doc_id)
"""
ORACLE = (
    "with recursive "
    + LINKS_SQL.format(docs="documents")
    + """, k as (select doc_id, md5(string_agg(x, chr(10) order by x)) as h from s group by all), z as (select h, min(doc_id) as class_id from k group by all)
select d.doc_id, coalesce(c.n, 0) as n_shingles, g.component_id, coalesce(z.class_id, d.doc_id) as class_id
from documents d left join c using (doc_id) left join k using (doc_id) left join z using (h) join (select doc_id, min(root) as component_id from r group by all) g using (doc_id)"""
)
