"""Quality rules judged per document and per host, in DataFrame functions only.

Each text is measured once (one projection, no shuffle of texts). Rules are failed by documents: too few words, too many
words in repeated windows (these two reject the document), too many symbols, too many repeated lines. Failures are summed
per rule and host, which Spark aggregates before it shuffles. Per rule, each host's failure rate has a beta prior whose two
parameters come from the rates of all hosts (method of moments). A host is rejected if, for some rule, its rate is surely
above HOST_FACTOR times that of all other hosts' documents, and above HOST_LEAST: the posterior's mean less HOST_SURE of its
standard deviations is compared. The verdicts are joined back to the measured rows.

Repeated 5-word windows are found by one sort per text: a long holds the window's hash in its upper bits and its place in
as many lower bits as the text needs, so that sorting primitive longs brings equal windows together; neighbours with one
hash are compared word by word, and a window that differs from its neighbour of the same hash with all before it that have that hash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._store import files_for, written

SPACES = " \t\n\x0b\x0c\r"
WINDOW = 5
LEAST_WORDS = 10
REPEATED_PERCENT = 20
#: A document fails the rules for symbols and lines beyond these percentages of its words and of its lines with a word.
SYMBOL_PERCENT = 10
LINE_PERCENT = 30
#: A host goes if its failure rate of some rule is surely above this many times that of the other hosts, and above HOST_LEAST.
HOST_FACTOR = 3.0
HOST_LEAST = 0.25
HOST_SURE = 2.0
RULES = ("few", "repeats", "symbols", "lines")
_SUMS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def _text(name: str = "text") -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def measured(docs: DataFrame, *more: Column) -> DataFrame:
    """(doc_id, host, the five counts, a column for each rule, base_failed, and what is asked for besides) of each row."""
    none = F.array().cast("array<string>")
    bare = F.btrim("text", F.lit(SPACES))
    words = F.when(bare == "", none).otherwise(F.split(bare, "[\\x20\\x09-\\x0D]+"))
    lines = F.filter(F.split("text", "\n"), lambda x: F.btrim(x, F.lit(SPACES)) != "")
    a = docs.select(F.col("doc_id"), F.col("source").cast("string").alias("host"), _text().alias("text"), F.struct(F.lit(0).alias("none"), *more).alias("more"))
    b = a.select("doc_id", "host", "more", words.alias("words"), F.regexp_count("text", F.lit("[#*$%&|<>]")).cast("long").alias("n_symbols"), lines.alias("lines"))
    c = b.select(
        *("doc_id", "host", "more", "words", "n_symbols"),
        F.size("lines").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.size("words").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        F.expr("cast(ceil(log2(size(words) + 1)) as int)").alias("bits"),
    )
    hashed = ", ".join(f"words[i + {j}]" for j in range(WINDOW))
    keys = F.expr(f"if(n_words >= {WINDOW}, transform(sequence(0, cast(n_words as int) - {WINDOW}), i -> shiftleft(shiftrightunsigned(xxhash64({hashed}), bits), bits) | i), cast(array() as array<bigint>))")
    d = c.select("*", F.sort_array(keys).alias("keys"))
    place = "cast(keys[{}] & (shiftleft(1L, bits) - 1) as int)"
    alike = "shiftrightunsigned(keys[{0}], bits) = shiftrightunsigned(keys[j], bits)"
    same = f"slice(words, {place} + 1, {WINDOW}) = slice(words, {place.format('j')} + 1, {WINDOW})"
    near, far = (x.replace("{}", y).replace("{0}", y) for x, y in ((same, "j - 1"), (f"{alike} and {same}", "k")))
    pairs = F.expr(
        f"""flatten(transform(filter(if(size(keys) > 1, sequence(1, size(keys) - 1), cast(array() as array<int>)), j -> {alike.format("j - 1")}),
        j -> if({near}, array({place.format("j - 1")}, {place.format("j")}),
          if(exists(sequence(0, j - 1), k -> {far}), flatten(transform(filter(sequence(0, j - 1), k -> {far}), k -> array({place.format("k")}, {place.format("j")}))), cast(array() as array<int>)))))"""
    )
    sums = [x for x in _SUMS if x != "n_repeat_words"]
    e = d.select("doc_id", "host", "more", "n_lines", *sums, F.sort_array(F.array_distinct(pairs)).alias("starts"))
    covered = F.expr(f"if(size(starts) = 0, 0L, {WINDOW}L + aggregate(sequence(1, size(starts)), 0L, (s, j) -> s + if(j < size(starts), least({WINDOW}, starts[j] - starts[j - 1]), 0)))")
    f = e.select("doc_id", "host", "more", "n_lines", *sums, covered.alias("n_repeat_words"))
    rules = [F.expr(x).alias(r) for r, x in rule_texts().items()]
    g = f.select("doc_id", "host", "more", *_SUMS, *rules)
    return g.select("doc_id", "host", *_SUMS, *RULES, F.expr("few or repeats").alias("base_failed"), *([F.col("more")] if more else []))


def rule_texts() -> dict[str, str]:
    return {
        "few": f"n_words < {LEAST_WORDS}",
        "repeats": f"100 * n_repeat_words > {REPEATED_PERCENT} * n_words",
        "symbols": f"100 * n_symbols > {SYMBOL_PERCENT} * n_words",
        "lines": f"100 * n_dup_lines > {LINE_PERCENT} * n_lines",
    }


def host_rates(rows: DataFrame, factor: float = HOST_FACTOR, least: float = HOST_LEAST, sure: float = HOST_SURE) -> DataFrame:
    """(host, n, for each rule failed_, rate_ and rejected_, rejected) of rows (host and a column for each rule); rows without a host are left out, and an only host is never rejected."""
    hosts = rows.where("host is not null").groupBy("host").agg(F.count("*").alias("n"), *[F.sum(F.col(r).cast("long")).alias(f"failed_{r}") for r in RULES])
    hosts = written(hosts, files_for(rows, 256 << 20))
    sums = [x for r in RULES for x in (F.sum(f"failed_{r}").alias(f"f_{r}"), F.sum(F.col(f"failed_{r}") * F.col(f"failed_{r}") / F.col("n")).alias(f"q_{r}"))]
    t = hosts.agg(F.count("*").alias("k"), F.sum("n").alias("n"), *sums).first()
    out = hosts
    for r in RULES:
        failed = t[f"f_{r}"] or 0
        alpha, beta = beta_prior(t.k or 0, t.n or 0, failed, t[f"q_{r}"] or 0.0)
        a, b = F.col(f"failed_{r}") + F.lit(alpha), F.col("n") - F.col(f"failed_{r}") + F.lit(beta)
        rate = a / (a + b)
        low = rate - F.lit(sure) * F.sqrt(rate * (1 - rate) / (a + b + 1))
        others = (F.lit(failed) - F.col(f"failed_{r}")) / F.nullif(F.lit(t.n or 0) - F.col("n"), F.lit(0))
        out = out.withColumns({f"rate_{r}": rate, f"rejected_{r}": others.isNotNull() & (low > F.greatest(F.lit(least), F.lit(factor) * others))})
    return out.withColumn("rejected", F.expr(" or ".join(f"rejected_{r}" for r in RULES)))


def beta_prior(hosts: int, rows: int, failed: int, squares: float) -> tuple[float, float]:
    """Method of moments: squares is the sum over hosts of n * rate^2. The variance between hosts is what the binomial variance leaves over."""
    if not rows:
        return 1.0, 1.0
    mean = min(max(failed / rows, 1e-6), 1 - 1e-6)
    spread = squares / rows - (failed / rows) ** 2 - mean * (1 - mean) * max(hosts - 1, 0) / rows
    strength = min(max(mean * (1 - mean) / max(spread, 1e-12) - 1, 1.0), 1e6)
    return mean * strength, (1 - mean) * strength


def judged(docs: DataFrame, **limits: float) -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, host) for each row of docs
    (doc_id, text, source; further columns don't matter).

    A null text has no words and so fails. A row without a source has no host: its own rules decide. Repeated rows, also of
    a null doc_id, come back once each. An empty table gives an empty one.
    """
    rows = written(measured(docs), files_for(docs, 16 << 20))
    bad = host_rates(rows, **limits).where("rejected").select("host", "rejected")
    out = rows.join(bad, "host", "left")
    return out.select("doc_id", *_SUMS, "base_failed", (~F.col("base_failed") & F.col("rejected").isNull()).alias("kept"), "host")


def op8_host_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("host")


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the rows that are kept, with all their columns, whatever their names.

    Rows decide for themselves: a null doc_id, a doc_id that several rows share and repeated rows change nothing. Null and
    empty texts fail. An empty table gives an empty one. The rows that pass their own rules are written once, with their verdicts; no text is shuffled.
    """
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    rows = measured(docs, whole)
    rows = written(rows.select("host", *RULES, "base_failed", F.when(~F.col("base_failed"), F.col("more.row")).alias("row")), files_for(docs, 16 << 20))
    bad = host_rates(rows).where("rejected").select("host")
    return rows.where("not base_failed").join(bad, "host", "left_anti").select(*[F.col("row")[c].alias(c) for c in docs.columns])


ORACLE = f"""
with t as (select doc_id, source as host, coalesce(text, '') as text from documents),
w as (select *, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') as v, string_split(text, chr(10)) as lines from t),
g as (select doc_id, unnest(range(1, len(v) - 3)) as i, v from w),
x as (select doc_id, i, array_to_string(v[i:i + 4], ' ') as s from g),
y as (select doc_id, i from (select *, count(*) over (partition by doc_id, s) as k from x) where k > 1),
z as (select doc_id, count(distinct i + j) as n_repeat_words from y, range(0, 5) r(j) group by all),
f as (select doc_id, host, len(v) as n_words, length(array_to_string(v, '')) as word_chars, length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) as n_symbols,
  len(list_filter(lines, lambda l: regexp_matches(l, '[^\\x20\\x09-\\x0D]'))) as n_lines, len(list_filter(lines, lambda l: regexp_matches(l, '[^\\x20\\x09-\\x0D]'))) - len(list_distinct(list_filter(lines, lambda l: regexp_matches(l, '[^\\x20\\x09-\\x0D]')))) as n_dup_lines, coalesce(n_repeat_words, 0) as n_repeat_words
  from w left join z using (doc_id)),
b as (select *, few or repeats as base_failed from (select *, {", ".join(f"{x} as {r}" for r, x in rule_texts().items())} from f)),
u as (select host, unnest([{", ".join(f"'{r}'" for r in RULES)}]) as rule, unnest([{", ".join(RULES)}])::bigint as x from b where host is not null),
h as (select host, rule, count(*) as n, sum(x)::double as f from u group by all),
m as (select rule, count(*) as k, sum(n)::double as n, sum(f) as f, sum(f * f / n) as q from h group by rule),
a as (select rule, f, greatest(least(f / n, 1 - 1e-6), 1e-6) as mean, q / n - (f / n) * (f / n) as v, k, n from m),
p as (select rule, f, n, mean, least(greatest(mean * (1 - mean) / greatest(v - mean * (1 - mean) * (k - 1) / n, 1e-12) - 1, 1.0), 1e6) as s from a),
o as (select host, (p.f - h.f) / nullif(p.n - h.n, 0) as others, h.n + s as w, (h.f + mean * s) / (h.n + s) as rate from h join p using (rule)),
r as (select host, bool_or(others is not null and rate - {HOST_SURE} * sqrt(rate * (1 - rate) / (w + 1)) > greatest({HOST_LEAST}, {HOST_FACTOR} * others)) as rejected from o group by host)
select doc_id, n_words::bigint as n_words, word_chars::bigint as word_chars, n_symbols::bigint as n_symbols, n_dup_lines::bigint as n_dup_lines, n_repeat_words::bigint as n_repeat_words, base_failed,
  not base_failed and not coalesce(rejected, false) as kept
from b left join r using (host)"""
