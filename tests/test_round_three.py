"""Queries against their SQL on odd tables: values out of bounds, nulls, special letters, ties."""

import hashlib
import math
import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenrank.functions import digest, scalar
from lumenrank.operators import stats
from lumenrank.plans import catalog


def both(spark, folder, name, **tables):
    """Rows of a query and of its SQL over (schema, rows) of each table, columns in one order."""
    con = duckdb.connect()
    for table, (schema, rows) in tables.items():
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{folder}/{table}.parquet")
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{folder}/{table}.parquet/*.parquet')")
    df = catalog.QUERIES[name](spark, str(folder))
    quoted = ", ".join(f'"{c}"' for c in df.columns)
    want = con.execute(f"SELECT {quoted} FROM ({catalog.ORACLES[name]})").fetchall()
    return sorted(map(repr, (tuple(r) for r in df.collect()))), sorted(map(repr, want))


def test_numeric_functions_out_of_bounds(spark, tmp_path):
    values = [0.0, -0.0, 0.0001, 250.0, 499.9999, 500.0, 560.21, -3.5, 1e300, math.inf, -math.inf, math.nan, None]
    got, want = both(spark, tmp_path, "numeric_functions", events=("event_id long, value double", list(enumerate(values))))
    assert got == want and "-inf" in got[0]


def test_bounded_logit_and_sigmoid_keep_null_and_nan(spark):
    df = spark.createDataFrame([(None,), (math.nan,), (0.0,), (1.0,)], "p double")
    rows = df.select(scalar.logit(F.col("p")).alias("l"), scalar.sigmoid(F.col("p") * 1e6).alias("s")).collect()
    assert tuple(rows[0]) == (None, None) and all(map(math.isnan, rows[1]))
    assert [r.l for r in rows[2:]] == pytest.approx([-13.815510, 13.815510]) and [r.s for r in rows[2:]] == [0.5, 1.0]


TEXTS = ["straße zwei", "STRASSE ZWEI", "eine Straße zwei und", "STRASSE", "ﬁn d'été", "FIN", "ᾳ", "ᾼ", "ǆ", "плод", None, "", "q"]


@pytest.mark.parametrize(
    "texts,known",
    [
        (TEXTS, ["STRASSE ZWEI", "strasse", "fin", "αι", "ПЛОД"]),
        (TEXTS, ["STRASSE ZWEI", "strasse", None]),
        (TEXTS, [None]),
        (TEXTS, [""]),
        (TEXTS, []),
        ([], ["a"]),
        ([f"x{i}" for i in range(199_999)] + ["a b"] * 3, ["x", "A"]),
    ],
)
def test_overlap_bands_on_odd_texts(spark, tmp_path, texts, known):
    got, want = both(spark, tmp_path, "overlap_bands", documents=("text string", [(x,) for x in texts]), benchmark=("text string", [(x,) for x in known]))
    assert got == want


def test_shares_just_above_a_bound(spark, tmp_path):
    """50.00002 % and 30.000005 % are above the bounds, though they round to them."""
    n = 2_000_003
    for name, k, want in (("a", 1_000_002, (50.0, "contaminated")), ("b", 600_001, (30.0, "contaminated_cap"))):
        folder = tmp_path / name
        folder.mkdir()
        spark.range(n).select(F.concat(F.when(F.col("id") < k, "known").otherwise(""), F.col("id").cast("string")).alias("text")).write.parquet(f"{folder}/documents.parquet")
        spark.createDataFrame([("known",)], "text string").write.parquet(f"{folder}/benchmark.parquet")
        row = catalog.overlap_bands(spark, str(folder)).first()
        assert (row.n_substring, row.overlap_pct, row.status) == (k, *want)


def test_simple_upper_of_every_letter(spark):
    letters = [chr(c) for c in range(1, 0x20000) if not 0xD800 <= c <= 0xDFFF]
    got = spark.createDataFrame([(c,) for c in letters], "c string").select("c", scalar.simple_upper(F.col("c")).alias("u")).collect()
    con = duckdb.connect()
    con.execute("CREATE TABLE t AS SELECT chr(i::INT) AS c FROM range(1, 131072) t(i) WHERE i NOT BETWEEN 55296 AND 57343")
    assert {r.c: r.u for r in got} == dict(con.execute("SELECT c, upper(c) FROM t").fetchall())


def _ranked_items(n):
    rng = random.Random(3)
    return [(i, rng.choice(["de", "en"]), "s", rng.choice([None, *range(1, 9)])) for i in range(n)], [(i, rng.choice([0, 1, 1, None])) for i in range(n)]


@pytest.mark.parametrize("n", [0, 1, 7, 150])
def test_bootstrap_diff_with_gaps_and_ties(spark, tmp_path, n):
    d, y = _ranked_items(n)
    got, want = both(spark, tmp_path, "bootstrap_diff_ci", documents=("doc_id long, lang string, source string, n_chars int", d), labels=("doc_id long, quality int", y))
    assert got == want


def test_bootstrap_ratio_with_gaps_and_no_positives(spark, tmp_path):
    """Of 5 rows many replicates have no known label in the top, or no positive at all."""
    d = [(i, "de", "s", [9, 9, None, 3, 2][i]) for i in range(5)]
    got, want = both(spark, tmp_path, "bootstrap_ratio_ci", documents=("doc_id long, lang string, source string, n_chars int", d), labels=("doc_id long, quality int", list(enumerate([None, 1, 0, 0, 1]))))
    assert got == want


def test_replicates_in_numpy_are_those_in_rows(spark):
    rows = [(i, None if i % 11 == 0 else float(i % 7), None if i % 13 == 0 else i % 3 % 2) for i in range(230)]
    df = spark.createDataFrame(rows, "k long, s double, y int").repartition(5)
    for percent in (10, 25):
        a = {r.b: (r.share, r.rate) for r in stats.resampled_top(df, "k", "s", "y", 12, percent).collect()}
        b = {r.b: (r.share, r.rate) for r in stats.resampled_top(df, "k", "s", "y", 12, percent, most_rows=0).collect()}
        assert len(a) == 12 and a.keys() == b.keys()
        for k in a:
            assert a[k] == pytest.approx(b[k])


def test_numbered_digests_are_md5():
    for prefix, n in ((b"42|0|", 12_345), (b"42|4999|", 100_100), (b"x" * 36, 1_001), (b"", 11)):
        got = np.concatenate(list(digest.numbered(prefix, n)))
        assert got.tolist() == [int(hashlib.md5(prefix + str(i).encode()).hexdigest()[:8], 16) for i in range(n)]


def test_models_read_the_texts_once(spark, tmp_path, monkeypatch):
    """Fits and scores read stored features; these are what the patterns say, for odd texts too."""
    texts = ["", " ", "a b\n c", "|%#*&$!", "é 😀 | ! x", None, *(f"{'w ' * (i % 9)}{'|' * (i % 4)}" for i in range(54))]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("lang", F.lit("de")).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    rows = catalog._model_rows(spark, str(tmp_path))
    assert rows.inputFiles() and not any("documents.parquet" in f for f in rows.inputFiles())
    for r in rows.collect():
        text = texts[r.doc_id]
        if text is None:
            assert (r["size"], r.space_rate, r.symbol_rate) == (None, None, None)
        else:
            n = max(1, len(text))
            assert (r.space_rate, r.symbol_rate) == (text.count(" ") / n, sum(c in "|%#*&$!" for c in text) / n) and r["size"] == pytest.approx(math.log1p(len(text)))
    scored = catalog.ml.ablation(rows.dropna(), {"size": ("size",), "all": catalog._INPUTS}, lambda features: catalog.ml.forest(features, trees=2))
    assert scored.count() == 2 * 59 and not any("model_rows" in f or "documents" in f for f in scored.inputFiles())
