"""The pipeline against its stages in plain Python, and the registered queries."""

import pytest

import corpus_pipeline
from arborframe.llm import mixing, registry
from arborframe.llm._store import written

from .helpers import corpus, prose, table
from .test_operators import brute_components, brute_quality, brute_repeats


def test_pipeline(spark):
    rows = [r for r in corpus() if r[0] is not None]
    docs = written(table(spark, rows).selectExpr("doc_id", "text", "lang", "source", "cast(length(text) as long) as n_chars"))
    stages = dict(corpus_pipeline.STAGES)
    kept = stages["quality"](spark, docs, "")
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {i for i, t, *_ in rows if not brute_quality(t)[-1]}
    kept = written(kept)
    now = {r.doc_id: r.text for r in kept.collect()}
    first = written(stages["near_duplicates"](spark, kept, ""))
    comps = brute_components([(i, t) for i, t in now.items()])
    assert {r.doc_id for r in first.collect()} == {i for i, (_, c) in comps.items() if c == i}
    left = {r.doc_id: r.text for r in first.collect()}
    cut = written(stages["repeated_passages"](spark, first, ""))
    want = brute_repeats([(i, t) for i, t in left.items()])
    got = {r.doc_id: r for r in cut.collect()}
    assert set(got) == {i for i, w in want.items() if w[0] > w[1]}
    assert all(len(r.text.encode()) <= want[i][0] - want[i][1] and r.n_chars == len(r.text) for i, r in got.items())
    mixed = written(stages["mixture"](spark, cut, ""))
    assert {r.doc_id for r in mixed.collect()} == {r.doc_id for r in mixing.mix(cut).collect() if r.selected}
    pieces = stages["packing"](spark, mixed, "").collect()
    assert {r.doc_id for r in pieces} == {r.doc_id for r in mixed.collect()}


def test_stages_on_odd_rows(spark):
    """As the stages' docstrings say: null and shared doc_ids, repeated rows, null and empty texts, columns with names that operators use inside."""
    a, b, c, d = (prose(60, i) for i in range(4))
    rows = [(None, a, "en", "a"), (None, b, None, None), (1, a, "en", "a"), (2, c, "en", "a"), (2, d, "en", "a"), (3, d, "en", "b"), (4, b, "en", "b"), (4, b, "en", "b"), (5, None, "en", "b"), (6, "", "en", "b")]
    df = table(spark, rows, clash=True)
    for name in ("_d", "_m", "kept_text", "row", "id", "more", "text2", "draw", "asked", "bytes", "shared", "selected"):
        df = df.withColumn(name, df.doc_id.cast("string"))
    df = written(df.withColumn("where it was", df.source).withColumn("n_chars", df.doc_id * 0))
    stages = dict(corpus_pipeline.STAGES)
    out = {name: stages[name](spark, df, "") for name in list(stages)[:4]}
    for name, got in out.items():
        assert got.dtypes == df.dtypes, name
        for r in got.collect():
            assert r["_d"] == (None if r.doc_id is None else str(r.doc_id)) and r["_x"] == r.doc_id and r["where it was"] == r.source, name
    key = lambda name: sorted((str(r.doc_id), str(r.text)) for r in out[name].collect())
    every = sorted((str(i), str(t)) for i, t, *_ in rows)
    assert key("quality") == [x for x in every if x[1] not in ("None", "")]
    near = key("near_duplicates")
    assert len(near) == 7 and [x[0] for x in near] == ["1", "2", "4", "5", "6", "None", "None"]  # 3 links with a text of 2
    assert near == sorted((str(r.doc_id), str(r.text)) for r in stages["near_duplicates"](spark, df.repartition(5), "").collect())
    cut = key("repeated_passages")
    assert {x for x in every if x[0] in ("None", "1")} - {("None", "")} <= set(cut) and not any(x[0] in ("5", "6") for x in cut) and sum(x[0] == "4" for x in cut) == 2
    assert set(key("mixture")) <= set(every)
    packed = stages["packing"](spark, df, "").collect()
    assert sorted(str(r.doc_id) for r in packed if r.start == 0) == sorted(str(i) for i, *_ in rows)


def test_run_leaves_one_table(spark, tmp_path):
    """Stages see what the one before kept; tables in between are deleted."""
    from arborframe.llm import _store

    before = len(_store._tables)
    table(spark).selectExpr("doc_id", "text", "lang", "source", "cast(length(text) as long) as n_chars").write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() > 0
    assert len(_store._tables) - before <= 4  # what the last stage reads


def test_pipeline_empty(spark):
    docs = table(spark, []).selectExpr("doc_id", "text", "lang", "source", "cast(0 as long) as n_chars")
    for name, stage in corpus_pipeline.STAGES:
        docs = written(stage(spark, docs, ""))
        assert docs.count() == 0, name


def test_registry_has_one_query_per_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in registry.QUERIES) == list(range(1, 11))
    assert set(registry.ORACLES) <= set(registry.QUERIES)


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_sql(spark, sf_dir, name):
    import os

    import duckdb

    con = duckdb.connect()
    for t in os.listdir(sf_dir):
        con.sql(f"create view {t.removesuffix('.parquet')} as select * from '{sf_dir}/{t}'")
    df = registry.QUERIES[name](spark, sf_dir)
    want = con.sql(registry.ORACLES[name])
    columns = want.columns
    at = [columns.index(c) for c in df.columns]
    assert sorted(repr(tuple(r)) for r in df.collect()) == sorted(repr(tuple(r[i] for i in at)) for r in want.fetchall())
