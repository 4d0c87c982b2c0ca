"""Small document tables with everything that can go wrong in them."""

import random

WORDS = "the of and a river stone bright window carries seven maps under cold light where birds gather near old bridges and slow boats drift past quiet gardens".split()


def prose(n, seed):
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + (r.choice("abcdefgh") * r.randint(0, 2)) for _ in range(n))


def corpus():
    """(doc_id, text, lang, source): nulls, empty and blank texts, ties, copies, near copies, shared passages, a long text, odd characters."""
    base, passage = prose(120, 1), prose(60, 2)
    rows = [(1, base, "en", "a"), (2, base, "en", "a"), (3, base.replace(" river", " RIVER", 1).upper(), "en", "b"), (4, base + " extra words at the end", "de", None)]
    rows += [(5, None, None, "a"), (6, "", "en", "c"), (7, " \t\n ", None, None), (8, "one two", "en", "c"), (9, "ONE  two", "en", "c"), (10, "x", "fr", "c")]
    rows += [(20 + i, prose(40, 100 + i) + " " + passage + " " + prose(40, 200 + i), ["en", "de"][i % 2], f"s{i % 3}") for i in range(8)]
    rows += [(40, ("é" * 3 + " ß漢字 🙂 ") * 60, "fr", "u"), (41, "ab" * 400, "en", "u"), (42, prose(3000, 9), "en", "long"), (43, prose(3000, 9), "en", "long")]
    rows += [(50 + i, " ".join(w if j % 17 or i != j % 5 else w + "x" for j, w in enumerate(base.split())), "en", "near") for i in range(5)]
    rows += [(60, "line one here\nline one here\nother #$ line\n\n", "es", "d"), (61, passage, "es", "d"), (-5, prose(30, 77) + " " + passage, "es", "d")]
    return rows


SCHEMA = "doc_id long, text string, lang string, source string"


def table(spark, rows=None, clash=False, partitions=3):
    df = spark.createDataFrame(corpus() if rows is None else rows, SCHEMA).repartition(partitions)
    if clash:  # names that operators use inside
        for c in ("n", "h", "k1", "component", "batch", "part", "spans", "weight", "rank", "held_out", "_x", "mark", "label"):
            df = df.withColumn(c, df.doc_id)
    return df


def words(text):
    import re

    return re.findall("[^\x20\x09-\x0d]+", text or "")
