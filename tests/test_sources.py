"""Arrays, frames, sparse matrices, text files and streams."""

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import arborframe as A
from arborframe.sources import matrix, text


def test_matrices(spark):
    x = np.arange(12.0).reshape(4, 3)
    assert matrix.from_dense(spark, x).columns == ["Column_0", "Column_1", "Column_2"]
    assert matrix.from_chunks(spark, [x, x]).count() == 8
    with pytest.raises(ValueError):
        matrix.from_chunks(spark, [x, x[:, :2]])
    long = matrix.from_sparse(spark, (np.array([0, 2, 2, 3]), np.array([0, 2, 1]), np.array([1.0, 2.0, 3.0]), 3))
    wide = matrix.to_wide(long, "row_id", 3)
    assert sorted(map(tuple, wide.collect())) == [(0, 1.0, 0.0, 2.0), (2, 0.0, 3.0, 0.0)]
    with pytest.raises(ValueError):
        matrix.from_sparse(spark, (np.array([0, 5]), np.array([0]), np.array([1.0]), 1))


def test_frames(spark):
    pdf = pd.DataFrame({"a": pd.Categorical(["x", "y", None]), "b": [1.0, 2.0, 3.0]})
    df, cats = matrix.from_pandas(spark, pdf)
    assert cats == {"a": ["x", "y"]} and [r.a for r in df.collect()][:2] == [0.0, 1.0]
    other, _ = matrix.from_pandas(spark, pd.DataFrame({"a": pd.Categorical(["y", "new", "x"]), "b": [1.0, 1.0, 1.0]}), cats)
    assert np.isnan(other.collect()[1].a) and other.collect()[0].a == 1.0
    with pytest.raises(ValueError):
        matrix.from_arrow(spark, pa.table({"s": ["x"]}))
    assert matrix.from_arrow(spark, pa.table({"i": pa.array([1, None])})).count() == 2


@pytest.fixture
def files(tmp_path):
    (tmp_path / "a.csv").write_text("1,0.5,na\n0,0.25,3\n1,NULL,2\n")
    (tmp_path / "a.tsv").write_text("1\t0.5\t1\n0\t0.25\t3\n")
    (tmp_path / "a.svm").write_text("1 0:0.5 3:2\n0 1:1.5\n")
    (tmp_path / "h.csv").write_text("a,target,b,wt,qid\n1,0,2,0.5,7\n3,1,4,1.5,7\n5,1,6,1,8\n")
    (tmp_path / "s.csv").write_text("1,2\n0,3\n1,4\n")
    (tmp_path / "s.csv.weight").write_text("0.5\n1\n2\n")
    (tmp_path / "s.csv.query").write_text("2\n1\n")
    (tmp_path / "s.csv.init").write_text("0.1\n0.2\n0.3\n")
    return tmp_path


def test_text_formats(spark, files):
    rows = text.read(spark, str(files / "a.csv")).collect()
    assert [r.label for r in rows] == [1, 0, 1] and np.isnan(rows[0].Column_1) and np.isnan(rows[2].Column_0)
    assert text.read(spark, str(files / "a.tsv")).count() == 2
    svm = text.read(spark, str(files / "a.svm")).collect()
    assert svm[0].Column_3 == 2.0 and svm[1].Column_1 == 1.5 and svm[1].Column_0 == 0.0
    h = text.read(spark, str(files / "h.csv"), header=True, label="name:target", weight="name:wt", group="name:qid")
    assert h.columns == ["label", "weight", "query", "a", "b"] and [r.a for r in h.collect()] == [1, 3, 5]
    with pytest.raises(ValueError):
        text.detect(["1,2", "1"])


def test_side_files(spark, files):
    d = text.dataset(spark, str(files / "s.csv"))
    rows = {r.row_id: r for r in d.data.collect()}
    assert [rows[i].weight for i in range(3)] == [0.5, 1, 2] and [rows[i].query for i in range(3)] == [0, 0, 1] and rows[2].init_score == [0.3]


def test_predict_file_and_stream(spark, tmp_path):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(400, 2))
    df = matrix.from_dense(spark, x, ["a", "b"], y=x[:, 0] * 2)
    b = A.train({"num_leaves": 5}, A.Dataset(df, "y", feature_name=["a", "b"]), 3)
    (tmp_path / "x.csv").write_text("b,a\n" + "\n".join(f"{v[1]},{v[0]}" for v in x[:20]) + "\n")
    from arborframe.plans.predict import predict_file

    predict_file(b, spark, str(tmp_path / "x.csv"), str(tmp_path / "out"), header=True)
    assert spark.read.text(str(tmp_path / "out")).count() == 20
    df.write.parquet(str(tmp_path / "in"))
    from arborframe.streaming import write_scores

    q = write_scores(b, spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")), str(tmp_path / "scored"), str(tmp_path / "ck"))
    q.awaitTermination(60)
    got = spark.read.parquet(str(tmp_path / "scored"))
    assert got.count() == 400 and got.where(F.col("prediction").isNull()).count() == 0


def test_sampled_columns_keep_values(spark):
    df = spark.range(20_000).selectExpr("cast(id % 10 as double) as a", "cast(id % 2 as double) as b")
    got = {(r.feature, r.value): r["count"] for r in matrix.sampled_columns(df, ["a", "b"], 0.1).groupBy("feature", "value").count().collect()}
    assert set(got) == {(0, float(v)) for v in range(1, 10)} | {(1, 1.0)}
    assert all(130 < got[0, float(v)] < 280 for v in range(1, 10))
