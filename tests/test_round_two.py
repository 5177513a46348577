"""Hot ties, one-pass correlations, persisted models, row-wise dropout masks and headers by place."""

import random

import pytest
from pyspark.sql import functions as F

from lumenrank.functions import scalar
from lumenrank.operators import governance, metrics, ml, ranking, stats
from lumenrank.sources import readers
from lumenrank.sources.scratch import scratch_folder


def test_hot_ties_are_cut_by_their_key(spark):
    n = 60_000
    df = spark.range(n).select(F.col("id"), F.when(F.col("id") % 10 == 0, F.rand(3)).otherwise(0.5).alias("s"))
    b = ranking._bucketed(df, "s", True, "id")
    assert b.groupBy("_bucket").count().agg(F.max("count")).first()[0] < 0.2 * n and b.select("_bucket").distinct().count() > 15
    local = df.toPandas().sort_values(["s", "id"], ascending=[False, True]).reset_index(drop=True)
    got = ranking.rank_contiguous(df, "s", "id").orderBy("rank").toPandas()
    assert got["id"].tolist() == local["id"].tolist() and got["rank"].tolist() == list(range(1, n + 1))


def test_prefix_sums_order_nulls_nan_and_strings(spark, monkeypatch):
    monkeypatch.setattr(ranking, "BUCKET_ROWS", 8)
    rng = random.Random(1)
    rows = [(i, rng.choice([None, float("nan"), -1.0, 0.0, 2.5, float("inf")]), rng.choice("abcé")) for i in range(400)]
    df = spark.createDataFrame(rows, "id long, v double, t string").withColumn("one", F.lit(1))
    for descending in (True, False):
        got = ranking.prefix_sums(df, "v", {"before": "one"}, descending=descending, tie="id")
        order = F.col("v").desc() if descending else F.col("v").asc()
        assert [r.before for r in got.orderBy(order, "id").collect()] == list(range(400))
    got = ranking.prefix_sums(df, "t", {"before": "one"}, tie="id")
    assert [r.before for r in got.orderBy("t", "id").collect()] == list(range(400))


def test_correlations_with_and_without_gaps(spark):
    rng = random.Random(2)
    rows = [(float(rng.randint(0, 9)), float(rng.randint(0, 9)), rng.choice([None, 1.0, 2.0, 3.0])) for _ in range(300)]
    df = spark.createDataFrame(rows, "a double, b double, c double")
    pdf = df.toPandas()
    got = {(r.a, r.b): r for r in metrics.spearman(df, [("a", "b"), ("a", "c"), ("b", "c")], p_values=True).collect()}
    for (x, y), r in got.items():
        both = pdf[[x, y]].dropna().rank()
        assert r.n == len(both) and r.rho == pytest.approx(both[x].corr(both[y]))
    assert all(0 <= r.p_value <= 1 for r in got.values()) and len(got) == 3


@pytest.mark.parametrize("rho,n,p", [(0.5, 10, 0.14111328), (0.9, 5, 0.03738607), (0.1, 100, 0.32220), (0.0, 20, 1.0), (1.0, 8, 0.0)])
def test_two_sided_p(rho, n, p):
    assert metrics.student_p(rho, n) == pytest.approx(p, abs=1e-4)


def test_models_are_saved_with_their_columns(spark, tmp_path):
    df = spark.createDataFrame([(i, float(i % 7), float(i % 3), int(i % 7 > 3)) for i in range(80)], "id long, x double, y double, label int")
    model = ml.forest(["x", "y"], trees=3).fit(df)
    ml.save_model(model, str(tmp_path / "m"), ["x", "y"], 0.45)
    again, columns, threshold = ml.load_model(str(tmp_path / "m"))
    assert (columns, threshold) == (["x", "y"], 0.45)
    assert ml.score(again, df).orderBy("id").collect() == ml.score(model, df).orderBy("id").collect()


def test_specific_and_pooled_models(spark):
    rows = [(i, "abc"[i % 3] if i else None, float(i % 11), int(i % 11 > 5 and i % 3 != 2)) for i in range(150)]
    df = ml.stratified_folds(spark.createDataFrame(rows, "id long, g string, x double, label int"), "id", ["label"])
    got = ml.specific_and_pooled(df, "g", lambda: ml.forest(["x"], trees=2))
    n = {(r.g, r.method): r["count"] for r in got.groupBy("g", "method").count().collect()}
    assert n == {("a", "pooled"): 49, ("b", "pooled"): 50, ("a", "specific"): 49, ("b", "specific"): 50}  # "c" has one class


def test_dropout_masks_belong_to_rows(spark):
    layers = [([[1.0] * 8, [0.5] * 8], [0.1] * 8), ([[1.0]] * 8, [0.0])]
    df = spark.createDataFrame([(i, float(i % 2), 1.0) for i in range(64)], "id long, x double, y double")
    run = lambda d: {r.id: (r.mc_score, r.uncertainty_std) for r in ml.dense_scores(d, ["x", "y"], layers, [0.0, 0.0], [1.0, 1.0], passes=20, dropout=0.5, key="id").collect()}
    one = run(df.coalesce(1))
    assert one == run(df.repartition(7)) and len({v for v in one.values()}) > 20


def test_equal_lines_below_the_header_stay(spark, tmp_path):
    (tmp_path / "a.csv").write_text("a title\nk,v\n1,x\nk,v\na title\n2,y\n")
    got = readers.table_below(spark, str(tmp_path / "a.csv"), 1).collect()
    assert sorted(map(tuple, got), key=str) == sorted([("1", "x"), ("k", "v"), ("a title", None), ("2", "y")], key=str)
    (tmp_path / "b.csv").write_text("a title\nk,v\n3,z\n")
    assert {r.k for r in readers.table_below(spark, str(tmp_path), 1).collect()} == {"1", "k", "a title", "2", "3"}
    assert [r.v for r in readers.positional(spark, str(tmp_path / "b.csv"), {1: "v"}, skip=2).collect()] == ["z"]


def test_viruses_of_organisms(spark):
    names = ["HPV-16 (W12)", "Human papillomavirus type 11", "Epstein Barr", "Zika", None]
    df = spark.createDataFrame([(n,) for n in names], "o string")
    assert [tuple(r) for r in df.select(scalar.virus(F.col("o")), scalar.virus(F.col("o"), hpv11=False)).collect()] == [("HPV16", "HPV16"), ("HPV11", None), ("EBV", "EBV"), (None, None), (None, None)]


def test_bootstrap_draws_rows_by_number(spark):
    df = spark.createDataFrame([(i * 10, float(i)) for i in range(50)], "k long, v double")
    got = stats.resampled(df, "k", 3)
    assert got.count() == 150 and {(r.b, r["count"]) for r in got.groupBy("b").count().collect()} == {(0, 50), (1, 50), (2, 50)}
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, stats.resampled(df.repartition(5), "k", 3).collect()))


def test_scratch_folders_need_a_shared_place(spark, monkeypatch):
    conf = spark.conf

    class Cluster:
        class conf:
            get = staticmethod(lambda key, default=None: "spark://host:7077" if key == "spark.master" else None)

    assert scratch_folder(spark, "x") != scratch_folder(spark, "x") and conf.get("spark.master").startswith("local")
    with pytest.raises(RuntimeError):
        scratch_folder(Cluster, "x")


def test_report_tables_are_of_a_reports_size(spark):
    assert governance.markdown_table(spark.range(3), ["id"], most=3).splitlines()[2:] == ["| 0 |", "| 1 |", "| 2 |"]
    with pytest.raises(ValueError):
        governance.markdown_table(spark.range(4), most=3)
