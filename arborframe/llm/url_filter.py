"""URL filter: rules found by their rarest literal token.

A rule is written host/path (it fits the host and its subdomains, and paths that start with its path) or as a wildcard
pattern over host and path, with * for any characters. Both become regular expressions. A token is a run of letters and
digits; a token of a rule is usable if the rule itself has its ends, so that a url that fits must have it as a whole token.
How many urls have each usable token is counted over the whole table, and each rule is indexed by its rarest one. A url's
own tokens then fetch its candidate rules, and only their regular expressions run. Rules without a usable token are tried on every url.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._bytes import column

#: Characters of rules that one pass sends to the executors; more rules take more passes.
RULE_CHARS = 16 << 20
_TOKEN = re.compile(r"[A-Za-z0-9]+")
RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))
#: The method's own verdict for urls that no rule fits: the longest of these patterns that fits, else allow.
PATTERNS = (("*/adserver/*", "block"), ("*/banner/ads/*", "block"), ("*.casino.*", "block"), ("*/porn/*", "block"), ("*/xxx/*", "block"))


class Rule(NamedTuple):
    text: str
    action: str
    regex: str
    tokens: tuple[str, ...]
    pattern: bool


def host_rule(text: str, action: str) -> Rule:
    host, slash, path = text.partition("/")
    end = re.escape(slash + path) if slash else "(?:/|$)"
    tokens = [m[0] for m in _TOKEN.finditer(host)] + [m[0] for m in _TOKEN.finditer(slash + path) if m.end() < len(slash + path)]
    return Rule(text, action, rf"(?:[^/]*\.)?{re.escape(host)}{end}", tuple(tokens), False)


def pattern_rule(text: str, action: str) -> Rule:
    tokens = [m[0] for m in _TOKEN.finditer(text) if m.start() and m.end() < len(text) and text[m.start() - 1] != "*" and text[m.end()] != "*"]
    return Rule(text, action, r"[\s\S]*".join(map(re.escape, text.split("*"))) + r"\Z", tuple(tokens), True)


_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
_STOP = re.compile(r"[/?#]")


def parts(url: str | None) -> tuple[str, str]:
    """Host and path."""
    at = -1 if url is None else url.find("://")
    if at < 0:
        return "", ""
    rest = url[at + 3 :]
    m = _STOP.search(rest)
    host, rest = (rest, "") if m is None else (rest[: m.start()], rest[m.start() :])
    return host.translate(_LOWER), re.split(r"[?#]", rest, maxsplit=1)[0]


def _count(wanted: frozenset[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen: dict[str, int] = defaultdict(int)
            for url in column(batch, "url").to_pylist():
                for t in wanted.intersection(_TOKEN.findall("/".join(parts(url)))):
                    seen[t] += 1
            yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], ["token", "n"])

    return run


def rarest_tokens(urls: DataFrame, rules: list[Rule]) -> dict[str, int]:
    """How many urls have each token of a rule; the result is as large as the rules at most."""
    wanted = frozenset(t for r in rules for t in r.tokens)
    rows = urls.select("url").mapInArrow(_count(wanted), "token string, n long").groupBy("token").agg(F.sum("n").alias("n"))
    return dict.fromkeys(wanted, 0) | {r.token: r.n for r in rows.toLocalIterator()}


class Index:
    """Rules by their rarest token."""

    def __init__(self, rules: list[Rule], counts: dict[str, int]):
        self.rules = rules
        self.always: list[int] = []
        self.by_token: dict[str, list[int]] = defaultdict(list)
        for i, r in enumerate(rules):
            (self.by_token[min(r.tokens, key=lambda t: (counts.get(t, 0), t))] if r.tokens else self.always).append(i)
        self.compiled: dict[int, re.Pattern] = {}

    def __getstate__(self):
        return self.__dict__ | {"compiled": {}}

    def best(self, host: str, path: str) -> tuple[Rule | None, Rule | None]:
        """The rule and the pattern that win: the longest; of equal length the one with the longer host, then a blocking one."""
        text = host + path
        ids = {i for t in _TOKEN.findall(text) if t in self.by_token for i in self.by_token[t]}.union(self.always)
        found: list[Rule | None] = [None, None]
        for i in ids:
            r = self.rules[i]
            old = found[r.pattern]
            if old is not None and strength(r) <= strength(old):
                continue
            if (c := self.compiled.get(i)) is None:
                c = self.compiled[i] = re.compile(r.regex)
            if c.match(text):
                found[r.pattern] = r
        return found[0], found[1]


def strength(r: Rule) -> tuple:
    return len(r.text), len(r.text.partition("/")[0]), r.action == "block", r.text


_OUT = ["page_id", "host", "path", "rule", "action", "pattern", "pattern_action"]


def _judge(index: Index):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_text = {r.text: r for r in index.rules}
        for batch in batches:
            rows = []
            old = zip(*(column(batch, c).to_pylist() for c in _OUT[3:]), strict=True)
            for url, (rule, action, pattern, pattern_action) in zip(column(batch, "url").to_pylist(), old, strict=True):
                host, path = parts(url)
                new = index.best(host, path) if host or path else (None, None)
                row = [host, path]
                for r, was in zip(new, ((rule, action, False), (pattern, pattern_action, True)), strict=True):
                    before = was[0] is not None and strength(by_text.get(was[0]) or Rule(was[0], was[1], "", (), was[2]))
                    row += [r.text, r.action] if r is not None and (not before or strength(r) > before) else was[:2]
                rows.append(row)
            cols = list(zip(*rows, strict=True)) if rows else [()] * 6
            yield pa.RecordBatch.from_arrays([column(batch, "page_id"), column(batch, "url"), *(pa.array(c, pa.string()) for c in cols)], ["page_id", "url", *_OUT[1:]])

    return run


def judge_urls(pages: DataFrame, rules=RULES, patterns=PATTERNS, otherwise: str = "allow", rule_chars: int = RULE_CHARS) -> DataFrame:
    """(page_id, host, path, rule, verdict, pattern) for each row of pages (page_id, url; further columns don't matter).

    A null url, or one without ://, has empty host and path and fits no rule. Repeated rows come back once each. Rules of
    more than rule_chars characters are split over several passes, so what goes to the executors is bounded.
    """
    every = [host_rule(*r) for r in dict(rules).items()] + [pattern_rule(*r) for r in dict(patterns).items()]
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"))
    counts = rarest_tokens(rows, every) if every else {}
    schema = "page_id long, url string, " + ", ".join(f"{c} string" for c in _OUT[1:])
    out = rows.select("*", *(F.lit(None).cast("string").alias(c) for c in _OUT[1:]))
    passes: list[list[Rule]] = [[]]
    for r in every:
        if sum(len(x.text) for x in passes[-1]) + len(r.text) > rule_chars and passes[-1]:
            passes.append([])
        passes[-1].append(r)
    for some in passes:
        out = out.mapInArrow(_judge(Index(some, counts)), schema)
    return out.select("page_id", "host", "path", "rule", F.coalesce("action", "pattern_action", F.lit(otherwise)).alias("verdict"), "pattern")


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(spark.read.parquet(f"{sf_dir}/pages.parquet"))


ORACLE = """
with a as (select page_id, case when strpos(url, '://') > 0 then substr(url, strpos(url, '://') + 3) else '' end as rest from pages),
b as (select page_id, rest, regexp_extract(rest, '^[^/?#]*') as raw from a),
c as (select page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host, regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') as path from b),
d as (select *, case when regexp_matches(host, '(^|\\.)example\\.net$') and starts_with(path, '/en/') then 'example.net/en/'
  when regexp_matches(host, '(^|\\.)example\\.com$') and starts_with(path, '/de/') then 'example.com/de/'
  when regexp_matches(host, '(^|\\.)org$') and starts_with(path, '/fr/') then 'org/fr/'
  when regexp_matches(host, '(^|\\.)net$') and starts_with(path, '/') then 'net/' end as rule,
  case when contains(host || path, '/banner/ads/') then '*/banner/ads/*' when contains(host || path, '/adserver/') then '*/adserver/*' when contains(host || path, '.casino.') then '*.casino.*'
  when contains(host || path, '/porn/') then '*/porn/*' when contains(host || path, '/xxx/') then '*/xxx/*' end as pattern from c)
select page_id, host, path, rule, case when rule in ('example.net/en/', 'org/fr/') then 'allow' when rule is not null or pattern is not null then 'block' else 'allow' end as verdict, pattern from d"""
