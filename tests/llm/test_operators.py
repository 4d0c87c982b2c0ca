"""Each operator against a brute-force version, with nulls, empty and long texts, ties, repeated rows, empty tables and clashing names."""

import hashlib
import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from arborframe.llm import ctph, host_quality, language_mixture, mixing, ngram_jaccard, packing, suffix_dedup, token_spans, toxicity, url_filter
from arborframe.llm._graph import components

from .helpers import SCHEMA, corpus, prose, table, words


def low(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


# ---- 2


def brute_components(rows):
    sets = {}
    for i, t, *_ in rows:
        w = words(low(t))
        sets[i] = {tuple(w[j : j + 5]) for j in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    at = {i: i for i in sets}

    def find(x):
        while at[x] != x:
            x = at[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                at[y] = x
    return {i: (len(sets[i]), find(i)) for i in ids}


@pytest.mark.parametrize("kw", [{}, {"block": 3, "fragments": 7}])
def test_ngram_join(spark, kw):
    want = brute_components(corpus())
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_jaccard.link_components(table(spark, clash=True), **kw).collect()}
    assert got == want


def test_ngram_join_edges(spark):
    rows = [(1, "a b c d e f", "en", "s")] * 3 + [(None, "a b c d e f", "en", "s"), (2, "a b c d e f", "en", "s"), (3, "q r s t u v w", "en", "s"), (3, "a b c d e f", "en", "s")]
    got = Counter((r.doc_id, r.component_id) for r in ngram_jaccard.link_components(table(spark, rows)).collect())
    assert got == Counter({(1, 1): 3, (None, None): 1, (2, 1): 1, (3, 1): 2})
    assert ngram_jaccard.link_components(table(spark, [])).count() == 0


def test_many_near_copies(spark):
    """A group in which only some pairs link; the blocks are smaller than the group."""
    base = prose(60, 5).split()
    rows = []
    for i in range(40):
        w = list(base)
        for j in range(i % 8):
            w[(i * 7 + j * 11) % 60] = f"edit{i}x{j}"
        rows.append((i, " ".join(w), "en", "s"))
    want = brute_components(rows)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_jaccard.link_components(table(spark, rows), block=6).collect()}
    assert got == want


@pytest.mark.parametrize("partitions", [1, 5])
def test_shingles_that_most_documents_have(spark, partitions):
    """A phrase in all documents, twice in some; batches in which many, one or no document has it."""
    phrase = "this line stands in every document of the table"
    rows = [(i, f"{prose(30, i)} {phrase} {prose(20 + i % 5, i % 4)} {phrase if i % 3 else ''}", "en", "s") for i in range(50)]
    rows += [(100 + i, f"{prose(30, i)} {phrase} {prose(20 + i % 5, i % 4)} {phrase if i % 3 else ''} more", "en", "s") for i in range(0, 50, 7)]
    rows += [(200, phrase, "en", "s"), (201, None, None, None), (202, phrase, "en", "s")]
    want = brute_components(rows)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_jaccard.link_components(table(spark, rows, partitions=partitions)).collect()}
    assert got == want and any(k != c for k, (_, c) in want.items())


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, 101), (102, 101), (200, 200)]
    got = dict(components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert all(got[i] == 0 for i in range(61)) and got[102] == 100 and 200 not in got


# ---- 7


def brute_repeats(rows, n=100):
    seen, out = set(), {}
    for i, t in sorted((i, (t or "").encode()) for i, t, *_ in rows):
        mark = np.zeros(len(t), bool)
        for s in range(len(t) - n + 1):
            w = t[s : s + n]
            if w in seen:
                mark[s : s + n] = True
            seen.add(w)
        edges = np.diff(np.concatenate([[0], mark.astype(int)]))
        out[i] = (len(t), int(mark.sum()), int((edges == 1).sum()), hashlib.sha256(bytes(b for b, m in zip(t, mark) if not m)).hexdigest())
    return out


@pytest.mark.parametrize("kw", [{}, {"hot": 1}, {"spread": 1}, {"spread": 3}])
def test_suffix_dedup(spark, kw):
    want = brute_repeats(corpus())
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.remove_repeats(table(spark, clash=True), **kw).collect()}
    assert got == want


def test_suffix_dedup_edges(spark):
    text = prose(60, 3)
    rows = [(1, text, "en", "s"), (1, text, "en", "s"), (2, text, "en", "s"), (None, text, "en", "s"), (3, "short", "en", "s"), (3, text + "!", "en", "s")]
    got = sorted((r.doc_id or 0, r.n_bytes, r.n_removed) for r in suffix_dedup.remove_repeats(table(spark, rows)).collect())
    n = len(text)
    assert got[:3] == [(0, n, 0), (1, n, 0), (1, n, 0)] and (2, n, n) in got and len(got) == 6
    assert suffix_dedup.remove_repeats(table(spark, [])).count() == 0


@pytest.mark.parametrize("spread", [4, 32])
def test_a_passage_that_all_documents_continue_differently(spark, spread):
    """Partitions with many, few and no contexts of the anchors at the passage's ends; rows that repeat."""
    passage = prose(25, 11)
    rows = [(i, f"{passage} {prose(25, 500 + i)}" if i < 60 else prose(25, 500 + i) + " " + passage, "en", "s") for i in range(90)]
    rows += [(200, None, None, None), rows[3], rows[70]]
    few = table(spark, rows[:5], partitions=1).union(table(spark, rows[5:62], partitions=1)).union(table(spark, rows[62:], partitions=2))
    want = brute_repeats(rows[:-2])
    got = [(r.doc_id, (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256)) for r in suffix_dedup.remove_repeats(few, spread=spread).collect()]
    assert len(got) == len(rows) and dict(got) == want and all(want[i] == x for i, x in got)


def test_suffix_dedup_of_long_texts(spark):
    """Texts over twice the bytes that are worked on at once."""
    import random

    r = random.Random(5)
    a = "".join(r.choices("abcdefgh ", k=700_000))
    rows = [(1, a, None, None), (2, "x" * 37 + a[100:400_000] + a[600_000:] + a[:50_000], None, None)]
    want = brute_repeats([(i, t) for i, t, *_ in rows])
    for r in suffix_dedup.remove_repeats(table(spark, rows)).collect():
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == want[r.doc_id][:4]


def test_fragments_are_even():
    data = np.random.default_rng(3).integers(97, 123, 400_000).astype(np.uint8)
    h = suffix_dedup.contexts(data, np.array([0, len(data)]), 100, 24)[0]
    per = np.bincount((h >> np.uint64(58)).astype(np.int64), minlength=64)
    assert per.max() < 2 * per.mean()


def test_suffix_sort_orders_and_verifies():
    rng = np.random.default_rng(0)
    data = rng.integers(97, 99, 400).astype(np.uint8)
    pos = rng.integers(0, 300, 120)
    seg = np.sort(rng.integers(0, 5, 120))
    order = suffix_dedup.Suffixes(data, 20).sort(pos, seg)
    keys = [(seg[i], data[pos[i] : pos[i] + 20].tobytes()) for i in order]
    assert keys == sorted(keys)
    doc, start = np.arange(120), pos
    assert (suffix_dedup.repeats(data, pos, seg, doc, start, 20) == suffix_dedup._by_bytes(data, pos, seg, doc, start, 20)).all()


# ---- 3


def brute_ids(rows):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    return {i: np.array([*t.encode(x or "", add_special_tokens=False).ids, 2], "<u4") for i, x, *_ in rows}


@pytest.mark.parametrize("kw", [{}, {"targets": {"a": 0.5, "long": 0.2, "u": 0.1}}, {"size": 64}])
def test_packing(spark, kw):
    rows = [*corpus(), (90, "it's <|endoftext|> don't «q». 12a b.c|d İ \xa0 z", "en", "a")]
    ids, size = brute_ids(rows), kw.get("size", 4096)
    pieces, windows = defaultdict(list), defaultdict(list)
    for r in packing.pack(table(spark, rows, clash=True), with_ids=True, **kw).collect():
        assert r.doc_tokens == len(ids[r.doc_id]) and r.length > 0
        own = ids[r.doc_id][r.start : r.start + r.length].tobytes()
        assert r.ids_crc32 == zlib.crc32(own) and bytes(r.ids) == own
        pieces[r.doc_id].append((r.start, r.length))
        windows[r.sequence_id].append((r.offset, r.length))
    assert set(pieces) == set(ids)
    for at, total in [(p, len(ids[i])) for i, p in pieces.items()] + [(w, None) for w in windows.values()]:
        end = 0
        for s, n in sorted(at):
            assert s == end
            end += n
        assert total in (None, end)
    fill = [sum(n for _, n in windows[w]) for w in range(len(windows))]
    assert max(fill) <= size and all(n == size for n in fill[:-1])


def test_packing_mixture_and_edges(spark):
    rows = [(i, prose(400, i), "en", "x" if i % 4 else "y") for i in range(40)]
    got = defaultdict(Counter)
    for r in packing.pack(table(spark, rows), size=512).collect():
        got[r.sequence_id][r.source] += r.length
    share = sum(c["y"] for c in got.values()) / sum(sum(c.values()) for c in got.values())
    assert all(abs(c["y"] - 512 * share) <= 2 for w, c in got.items() if w < len(got) - 2)
    assert packing.pack(table(spark, [])).count() == 0
    twice = packing.pack(table(spark, [(1, "a b", "en", "s")] * 2)).collect()
    assert sum(r.length for r in twice) == 6


def test_schedule_covers_every_token():
    for totals, weights in (([1000, 10, 333], [3, 5, 1]), ([5, 0, 7], [1, 1, 1]), ([100000], [7]), ([0, 0], [1, 2])):
        s = packing.Schedule(totals, weights, 64)
        seen = set()
        for q, n in enumerate(totals):
            for start in range(0, n, 37):
                got = s.pieces(q, start, min(37, n - start))
                assert sum(g[3] for g in got) == min(37, n - start)
                for w, off, _, k in got:
                    cells = {(w, off + j) for j in range(k)}
                    assert not cells & seen
                    seen |= cells
        assert len(seen) == sum(totals) and (not seen or max(w for w, _ in seen) == -(-sum(totals) // 64) - 1)


def test_packing_controls_small_sources(spark):
    """200 sources of half a per cent: each has given its share after any window, but for about a run."""
    rows = [(i, prose(200, i % 7), "en", f"s{i % 200}") for i in range(400)]
    got = defaultdict(Counter)
    for r in packing.pack(table(spark, rows)).collect():
        got[r.source][r.sequence_id] += r.length
    total = sum(sum(c.values()) for c in got.values())
    last = max(w for c in got.values() for w in c)
    assert len(got) == 200 and last > 20
    for c in got.values():
        given, share = 0, sum(c.values()) / total
        for w in range(last):
            given += c[w]
            assert abs(given - 4096 * share * (w + 1)) <= 2 * packing.RUN


def test_packing_keeps_small_targets(spark):
    rows = [(i, prose(3000, i), "en", "x") for i in range(24)] + [(100, prose(300, 1), "en", "y"), (101, prose(300, 1), "en", "z")]
    got = defaultdict(Counter)
    for r in packing.pack(table(spark, rows), targets={"x": 0.99, "y": 0.005, "z": 0.001}).collect():
        got[r.source][r.sequence_id] += r.length
    end = max(got["y"])
    assert 10 < end < max(got["x"])
    assert abs(sum(n for w, n in got["z"].items() if w <= end) - sum(got["y"].values()) / 5) <= 2 * packing.RUN


def test_runs_cover_every_place():
    for totals, weights in (([1000, 10, 333, 64], [3, 5, 1, 1e-12]), ([70] * 90, [70] * 90), ([1], [1]), ([5000, 33], [1e-6, 1.0])):
        runs = packing.Runs([str(i) for i in range(len(totals))], totals, weights)
        seen = []
        for i, n in enumerate(totals):
            for start in range(0, n, 37):
                got = runs.places(str(i), start, min(37, n - start))
                assert [a for _, a, _ in got] == [start + sum(k for *_, k in got[:j]) for j in range(len(got))]
                seen += [p + j for p, _, k in got for j in range(k)]
        assert sorted(seen) == list(range(sum(totals)))


# ---- 4


def test_ctph(spark):
    rows = corpus()
    line = sorted(((i, t or "") for i, t, *_ in rows), reverse=True)
    got = {r.doc_id: r for r in ctph.fingerprints(table(spark, clash=True, partitions=5)).collect()}
    for k, (i, t) in enumerate(line):
        follow = line[(k + 1) % len(line)][1]
        half = len(t) // 2
        e = t[: len(t) - half] + follow[:half]
        r = got[i]
        assert (r.n_chars, r.edited_sha256) == (len(t), hashlib.sha256(e.encode()).hexdigest())
        assert r.fingerprint == ctph.fingerprint(t.encode()) and r.edited_fingerprint == ctph.fingerprint(e.encode())
        assert 0 <= r.near_edited <= 1 and r.near_next == ctph.likeness([r.fingerprint], [ctph.fingerprint(follow.encode())])[0]
    assert got[1].fingerprint == got[2].fingerprint and got[42].near_edited > 0.3
    assert ctph.fingerprints(table(spark, [])).count() == 0
    one = ctph.fingerprints(table(spark, [(1, "abcd", "en", "s")])).collect()
    assert one[0].edited_sha256 == hashlib.sha256(b"abab").hexdigest()
    assert ctph.fingerprints(table(spark, [(1, "a", "en", "s")] * 3 + [(None, "b", "en", "s")])).count() == 4


def test_fingerprint_byte_by_byte():
    """The same hash rolled over a text one byte at a time, in plain integers."""
    from arborframe.llm._bytes import BASES

    full, letters = 2**64, "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"

    def spread(x):
        x ^= x >> 30
        x = x * 0xBF58476D1CE4E5B9 % full
        x ^= x >> 27
        x = x * 0x94D049BB133111EB % full
        return x ^ x >> 31

    def poly(raw):
        return sum((b + 1) * pow(BASES[0], i, full) for i, b in enumerate(raw)) % full

    def plain(raw):
        if not raw:
            return "3::"
        rolled = [(spread(poly(raw[max(0, i - 6) : i + 1])) >> 32) + 1 for i in range(len(raw))]
        k = 0
        while sum(t % (3 << k) == 0 for t in rolled) > 63:
            k += 1

        def signature(k):
            cuts = [i + 1 for i, t in enumerate(rolled) if t % (3 << k) == 0]
            parts = [raw[a:b] for a, b in zip([0, *cuts], [*cuts, len(raw)]) if b > a]
            return "".join(letters[spread(poly(x)) >> 58] for x in parts)

        return f"{3 << k}:{signature(k)}:{signature(k + 1)}"

    for text in ("", "a", "short text", prose(30, 1), prose(200, 2), "é漢🙂" * 40, "ab" * 300):
        assert ctph.fingerprint(text.encode()) == plain(text.encode()), text[:20]


def test_edit_distance():
    import random

    r = random.Random(1)
    pairs = [("".join(r.choice("ABC") for _ in range(r.randint(0, 64))), "".join(r.choice("ABC") for _ in range(r.randint(0, 64)))) for _ in range(60)]

    def plain(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            new = [i]
            for j, y in enumerate(b, 1):
                new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
            row = new
        return row[-1]

    assert ctph.edit_distances([a for a, _ in pairs], [b for _, b in pairs]).tolist() == [plain(a, b) for a, b in pairs]


# ---- 5


def test_url_filter(spark):
    urls = ["http://a.example.net/en/1", "https://EXAMPLE.net/en", "http://x.net", "http://x.net/", "http://net/a?b#c", "http://h.org/fr/x", "http://h.org/frx", "ftp://example.com/de/?q", "http://notexample.com/de/", None, "", "no scheme", "http://a.net:80/x", "http://b.org/adserver/x", "x://y.com/a#b?c", "http://é.net/ü"]
    df = spark.createDataFrame([(i, u, "<p>") for i, u in enumerate(urls)], "page_id long, url string, html string").withColumn("rule", __import__("pyspark.sql.functions", fromlist=["lit"]).lit("clash"))
    got = {r.page_id: r for r in url_filter.judge_urls(df).collect()}

    def brute(u):
        host, path = "", ""
        if u and "://" in u:
            rest = u.split("://", 1)[1]
            cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
            host, rest = low(rest[:cut]), rest[cut:]
            path = rest[: min([rest.find(c) for c in "?#" if c in rest] or [len(rest)])]
        fits = []
        for rule, action in url_filter.RULES:
            h, _, p = rule.partition("/")
            if (host == h or host.endswith("." + h)) and path.startswith("/" + p):
                fits.append((len(rule), rule, action))
        best = max(fits, default=(0, None, "block" if "/adserver/" in host + path else "allow"))
        return host, path, best[1], best[2]

    for i, u in enumerate(urls):
        assert (got[i].host, got[i].path, got[i].rule, got[i].verdict) == brute(u), u
    many = [(f"h{i}.com/", "block") for i in range(50)] + list(url_filter.RULES)
    small = {r.page_id: r.rule for r in url_filter.judge_urls(df, rules=many, rule_chars=40).collect()}
    assert small == {i: got[i].rule for i in got}
    assert url_filter.judge_urls(df.limit(0)).count() == 0


def test_url_filter_of_many_rules(spark):
    """Thousands of rules and patterns against each of them tried on each url, by plain comparisons; repeated rows and null page_ids."""
    import random

    r = random.Random(11)
    names, tops, dirs = [f"h{i}" for i in range(60)], ["com", "net", "org"], ["a", "ads", "en", "shop", "x1", "img", ""]
    path = lambda: "/".join(r.choice(dirs) for _ in range(r.randint(0, 3)))
    rules = {f"{r.choice(names)}.{r.choice(tops)}/{path()}": r.choice(["block", "allow"]) for _ in range(2500)}
    patterns = {f"*/{r.choice(dirs[:-1])}/{r.choice(dirs[:-1])}{r.choice(['/*', '*', '/' + r.choice(dirs) + '/*'])}": r.choice(["block", "allow"]) for _ in range(120)}
    rows = [(i, f"http://{r.choice(['', 'www.', 'm.'])}h{r.randint(0, 240)}.{r.choice(tops)}/{path()}{r.choice(['', '?q=1', '#t', '/end.html'])}") for i in range(700)]
    rows += [rows[3], rows[3], (None, rows[5][1]), (None, None)]
    df = spark.createDataFrame(rows, "page_id long, url string").repartition(3)

    def fits(pattern, text):
        first, *rest = pattern.split("*")
        at = len(first)
        if not text.startswith(first):
            return False
        for part in rest[:-1]:
            if (at := text.find(part, at)) < 0:
                return False
            at += len(part)
        return text.endswith(rest[-1]) and len(text) - len(rest[-1]) >= at

    def best(found):
        return max(found, key=lambda x: (len(x[0]), len(x[0].partition("/")[0]), x[1] == "block", x[0]), default=(None, None))

    want = []
    for i, url in rows:
        host, path_ = url_filter.parts(url)
        own = [(x, a) for x, a in rules.items() if (host == (h := x.partition("/")[0]) or host.endswith("." + h)) and path_.startswith("/" + x.partition("/")[2])] if host else []
        any_ = [(x, a) for x, a in patterns.items() if fits(x, host + path_)] if host else []
        rule, pattern = best(own), best(any_)
        want.append((str(i), host, path_, str(rule[0]), rule[1] or pattern[1] or "allow", str(pattern[0])))
    got = url_filter.judge_urls(df, rules=list(rules.items()), patterns=list(patterns.items())).collect()
    assert sorted((str(x.page_id), x.host, x.path, str(x.rule), x.verdict, str(x.pattern)) for x in got) == sorted(want)
    assert sum(x[3] != "None" for x in want) > 100 and sum(x[3] == "None" and x[5] != "None" for x in want) > 20


# ---- 6


@pytest.mark.parametrize("rule", token_spans.RULES)
def test_token_spans(spark, rule):
    rows = [*corpus(), (70, "a\n\n\nb .\n\n c\n", "en", "s")]
    enc = token_spans.encoder(token_spans.VOCABULARY)
    got = defaultdict(list)
    for r in token_spans.section_tokens(table(spark, rows, clash=True), rule=rule).collect():
        got[r.doc_id].append(r)
    for i, text, *_ in rows:
        text = text or ""
        lines = text.splitlines(keepends=True) if False else [x for x in __import__("re").split("(?<=\n)", text) if x] or [""]
        own = sorted(got[i], key=lambda r: r.section)
        assert [text[r.start : r.end] for r in own] == lines
        raw, at = [], 0
        for t in enc.ids(text):
            raw.append((at, at + int(enc.length[t])))
            at += int(enc.length[t])
        ends = np.cumsum([len(x.encode()) for x in lines])
        count = np.zeros(len(lines))
        for a, b in raw:
            parts = [(max(0, min(b, e) - max(a, e - len(x.encode()))), k) for k, (e, x) in enumerate(zip(ends, lines))]
            if rule == "split":
                for n, k in parts:
                    count[k] += n / (b - a)
            else:
                inside = [(n, k) for n, k in parts if n]
                count[inside[0][1] if rule == "start" else inside[-1][1] if rule == "end" else max(inside, key=lambda p: (p[0], -p[1]))[1]] += 1
        assert np.allclose([r.n_tokens for r in own], count)
    assert token_spans.section_tokens(table(spark, [])).count() == 0


# ---- 8


def brute_quality(text):
    text = text or ""
    w = words(text)
    lines = [x for x in text.split("\n") if words(x)]
    grams = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    hit = {i + j for i in range(len(w) - 4) if grams[tuple(w[i : i + 5])] > 1 for j in range(5)}
    failed = len(w) < 10 or 100 * len(hit) > 20 * len(w)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(hit), failed


def test_host_quality(spark):
    rows = corpus()
    got = {r.doc_id: r for r in host_quality.judged(table(spark, clash=True)).collect()}
    by_host = defaultdict(list)
    for i, t, _, s in rows:
        r = got[i]
        want = brute_quality(t)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == want, i
        if s is not None:
            by_host[s].append(brute_rules(t))
    bad = brute_hosts(by_host)
    for i, _, _, s in rows:
        assert got[i].kept == (not got[i].base_failed and s not in bad)
    assert host_quality.judged(table(spark, [])).count() == 0


def brute_rules(text):
    n, _, symbols, again, hit, _ = brute_quality(text)
    lines = sum(bool(words(x)) for x in (text or "").split("\n"))
    return n < 10, 100 * hit > 20 * n, 100 * symbols > 10 * n, 100 * again > 30 * lines


def brute_hosts(by_host):
    """Hosts that some rule rejects: failures per host, a beta prior from the moments, the posterior against the other hosts' rate."""
    out = set()
    for k in range(4):
        f, n = {s: sum(x[k] for x in v) for s, v in by_host.items()}, {s: len(v) for s, v in by_host.items()}
        total, fails = sum(n.values()), sum(f.values())
        mean = min(max(fails / total, 1e-6), 1 - 1e-6)
        spread = sum(f[s] ** 2 / n[s] for s in f) / total - (fails / total) ** 2 - mean * (1 - mean) * (len(f) - 1) / total
        strength = min(max(mean * (1 - mean) / max(spread, 1e-12) - 1, 1.0), 1e6)
        for s in f:
            a, b = f[s] + mean * strength, n[s] - f[s] + (1 - mean) * strength
            low = a / (a + b) - 2 * (a * b / (a + b) ** 2 / (a + b + 1)) ** 0.5
            if total > n[s] and low > max(0.25, 3 * (fails - f[s]) / (total - n[s])):
                out.add(s)
    return out


def test_bad_hosts(spark):
    """Hosts are rejected for any of the rules, also one that rejects no document by itself, and good documents go with them."""
    rows = [(i, "bad", "en", "junk") for i in range(60)] + [(100, prose(50, 3), "en", "junk")] + [(200 + i, prose(50, i), "en", f"h{i % 4}") for i in range(60)]
    rows += [(300 + i, prose(20, i) + " # * | & $ %", "en", "marks") for i in range(40)] + [(400 + i, f"{prose(30, 500 + i)}\nmenu\nmenu\nmenu", "en", "lines") for i in range(40)]
    rows += [(500, prose(30, 1), "en", None), (501, prose(30, 2), "en", None), (501, prose(30, 2), "en", None)]
    got = [(r.doc_id, r.kept, r.base_failed) for r in host_quality.judged(table(spark, rows, clash=True)).collect()]
    assert len(got) == len(rows)
    assert not any(kept for i, kept, _ in got if i < 200 or 300 <= i < 500)
    assert not any(failed for i, _, failed in got if 300 <= i < 500)
    assert all(kept for i, kept, _ in got if 200 <= i < 300 or i >= 500)
    by_host = defaultdict(list)
    for _, t, _, s in rows:
        if s:
            by_host[s].append(brute_rules(t))
    assert brute_hosts(by_host) == {"junk", "marks", "lines"}


def test_only_host(spark):
    """One host has nothing to be compared with; windows with one hash are compared by their words in any order."""
    rows = [(i, "bad" if i % 2 else prose(40, i), "en", "one") for i in range(20)]
    assert sum(r.kept for r in host_quality.judged(table(spark, rows)).collect()) == 10


# ---- 1


def test_mixing(spark):
    rows = [(i, prose(20 + i % 50, i), ["en", "de", None][i // 5 % 3], "big" if i % 5 else f"s{i % 7 // 2}") for i in range(300)] + [(1000, None, None, None), (1001, "", "en", "empty")]
    df = table(spark, rows, clash=True)
    got = mixing.mix(df).collect()
    assert len(got) == len(rows)
    tokens = sum(r.n_tokens for r in got)
    assert all(r.n_tokens == len(words(dict((x[0], x[1]) for x in rows)[r.doc_id])) for r in got)
    assert math.isclose(sum(r.n_tokens * r.probability for r in got), mixing.BUDGET * tokens, rel_tol=1e-6)
    # raked weights meet the targets of each margin
    for m in mixing.MARGINS:
        actual = Counter()
        for r in got:
            actual[getattr(r, m)] += r.n_tokens
        want = mixing.tempered(actual, mixing.TEMPER[m])
        raked = Counter()
        for r in got:
            raked[getattr(r, m)] += r.n_tokens * r.weight
        for k in actual:
            assert math.isclose(raked[k] / tokens, want[k], rel_tol=1e-3, abs_tol=1e-3), (m, k)
    again = {r.doc_id: r.selected for r in mixing.mix(df.repartition(5)).collect()}
    assert again == {r.doc_id: r.selected for r in got}
    assert mixing.mix(table(spark, [])).count() == 0


def test_raking_on_frames_agrees(spark):
    rows = [(i, prose(10 + i % 30, i), "en" if i % 3 else "de", "ab"[i % 2]) for i in range(60)]
    df = table(spark, rows)
    for targets in (None, {"source": {"a": 0.3, "b": 0.5, "absent": 0.2}, "lang": {"en": 0.5, "de": 0.5}, "topic": {"short": 0.8, "table": 0.1}}):
        one, two = ({r.doc_id: r for r in mixing.mix(df, targets, most_cells=k).collect()} for k in (mixing.MOST_CELLS, 0))
        assert one.keys() == two.keys()
        for i, r in one.items():
            assert abs(r.weight - two[i].weight) < 1e-6 and abs(r.probability - two[i].probability) < 1e-6 and r.selected == two[i].selected


def test_mixing_by_brute_force(spark):
    """Weights and probabilities against a plain raking over dictionaries, on the whole table."""
    rows = [(i, prose(5 + i % 40, i), ["en", "de", "fr"][i % 7 % 3], f"s{i % 5 * (i % 2)}") for i in range(200)]
    power = {"source": 0.7, "lang": 0.7, "topic": 0.9}
    n = {i: len(words(t)) for i, t, *_ in rows}
    cell = {i: (s, x, "short") for i, t, x, s in rows}
    tokens = Counter()
    for i, c in cell.items():
        tokens[c] += n[i]
    now, goal = {c: float(x) for c, x in tokens.items()}, sum(tokens.values())
    share = []
    for m, name in enumerate(("source", "lang", "topic")):
        t = Counter()
        for c, x in tokens.items():
            t[c[m]] += x
        up = {k: v ** power[name] for k, v in t.items()}
        share.append({k: v / sum(up.values()) for k, v in up.items()})
    for _ in range(300):
        for m in range(3):
            for k, s in share[m].items():
                have = sum(x for c, x in now.items() if c[m] == k)
                for c in now:
                    if c[m] == k:
                        now[c] *= s * goal / have
    weight = {c: now[c] / tokens[c] for c in now}
    lo, hi = 0.0, 100.0
    for _ in range(200):
        mid = (lo + hi) / 2
        kept = sum(x * min(1, mid * weight[c]) for c, x in tokens.items())
        lo, hi = (mid, hi) if kept < 0.8 * goal else (lo, mid)
    for r in mixing.mix(table(spark, rows, clash=True)).collect():
        assert abs(r.weight - weight[cell[r.doc_id]]) < 1e-4
        assert abs(r.probability - min(1, hi * weight[cell[r.doc_id]])) < 1e-4


def test_capped_scale():
    w, t = np.array([1.0, 2.0, 0.5, 4.0]), np.array([10.0, 5.0, 20.0, 1.0])
    for share in (0.1, 0.5, 0.9, 0.99):
        c = mixing.scale_for(w, t, share * t.sum())
        assert math.isclose((t * np.minimum(1, c * w)).sum(), share * t.sum(), rel_tol=1e-9)
    assert mixing.scale_for(w, t, t.sum()) == math.inf


# ---- 9 and 10


def test_toxicity(spark):
    bad = ["scumbag", "idiotic", "moron", "trashy"]
    rows, labels = [], []
    for i in range(400):
        t = prose(60, i)
        if i % 4 == 0:
            t += " " + bad[i % 16 // 4] + ["", "s", "z"][i % 3] + " " + prose(5, i)
        rows.append((i, t, "en", "s"))
        labels.append((i, int(i % 4 == 0)))
    rows += [(1000, None, None, None), (1001, "", "en", "s"), (None, "x", "en", "s")]
    lab = spark.createDataFrame([*labels, (2000, None), (1, 0), (3, 1), (None, 1)], "doc_id long, toxic int").withColumn("score", __import__("pyspark.sql.functions", fromlist=["lit"]).lit(1))
    got = toxicity.score_toxicity(table(spark, rows, clash=True), lab).collect()
    assert len(got) == 403 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    out = [r for r in got if r.doc_id is not None and r.doc_id < 400 and r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got if r.doc_id is not None)
    assert sum(r.predicted == int(r.doc_id % 4 == 0) for r in out) >= 0.9 * len(out)
    assert toxicity.score_toxicity(table(spark, []), lab).count() == 0
    assert toxicity.score_toxicity(table(spark, rows), lab.limit(0)).select("score").distinct().count() == 1


def test_language_mixture(spark):
    own = {"xx": "kara mota silu denpa rako", "yy": "the when other which under", "zz": "eau queue leur ceux dans"}
    import random

    r = random.Random(0)
    say = lambda k, n: " ".join(r.choice(own[k].split()) for _ in range(n))
    rows = [(i, say(k, 30), k, "s") for i, k in enumerate(list(own) * 40)]
    rows += [(500, say("xx", 60) + " " + say("yy", 30), None, "s"), (501, None, "xx", "s"), (502, "12 34 ..", "xx", "s"), (503, "", None, None), (None, say("zz", 9), "zz", "s")]
    got = language_mixture.identify(table(spark, rows, clash=True)).collect()
    assert len(got) == len(rows)
    by = {x.doc_id: x for x in got}
    assert sum(by[i].lang_pred == k for i, k in enumerate(list(own) * 40)) >= 118
    assert by[500].lang_pred == "xx" and abs(by[500].score - 2 / 3) < 0.15 and "yy" in by[500].mixture
    assert all(by[i].lang_pred == "und" and by[i].score == 0 for i in (501, 502, 503))
    assert language_mixture.identify(table(spark, [])).count() == 0
    none = language_mixture.identify(spark.createDataFrame([(1, "abc", None, None)], SCHEMA)).first()
    assert none.lang_pred == "und"


def test_language_mixture_of_many():
    """The penalty alone bounds the set: as many languages as a text has, and the same as trying every size."""
    import random

    r = random.Random(0)
    own = {c: [c + x + c + y + c for x in "aeiou" for y in "aeiou"] for c in "bdfgkm"}
    model = language_mixture.train([" ".join(r.choice(w) for _ in range(400)) for w in own.values()], list(own))
    texts = [" ".join(r.choice(own[c]) for c in list(own)[:k] for _ in range(60)) for k in range(1, 7)]
    mix = np.concatenate(list(model.mixtures(*language_mixture.buffer(pa.array(texts, pa.large_string())))))
    assert [(m > 0.01).sum() for m in mix] == [1, 2, 3, 4, 5, 6]
    assert all(abs(m[:k] - 1 / k).max() < 0.02 for k, m in enumerate(mix, 1))
    rng = np.random.default_rng(0)
    n = rng.integers(0, 60, 200)
    like = (rng.random((n.sum(), 5)) ** rng.choice([1, 4, 12], (n.sum(), 1))).astype(np.float32)
    like /= like.max(axis=1, keepdims=True)
    got = language_mixture.select(like, np.zeros(n.sum(), np.float32), n)
    for i in np.flatnonzero(n):
        own = like[n[:i].sum() : n[: i + 1].sum()]
        row, cut, one = np.zeros(n[i], int), np.zeros(1, int), n[i : i + 1]
        full, _ = language_mixture._em(own, row, cut, one, np.full((1, 5), 0.2, np.float32), language_mixture.ROUNDS)
        order, tried = np.argsort(-full[0], kind="stable"), []
        for size in range(1, 6):
            start = np.zeros((1, 5), np.float32)
            start[0, order[:size]] = full[0, order[:size]] + 1e-6
            mix, fit = language_mixture._em(own, row, cut, one, start / start.sum(), language_mixture.ROUNDS if size > 1 else 0)
            tried.append((fit[0] - language_mixture.PENALTY * (size - 1) * np.log(n[i] + 1), -size, mix[0]))
        assert np.allclose(got[i], max(tried, key=lambda t: t[:2])[2], atol=1e-4)
