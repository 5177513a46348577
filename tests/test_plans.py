"""The train and validate plans, the service contract, the registry."""

import importlib.util
import os
import random
import shutil
import subprocess
import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from lumenrank.functions import constants as K
from lumenrank.plans import catalog, service, train, validate

ROOT = Path(__file__).resolve().parents[1]


def peptides(n, seed=0):
    rng = random.Random(seed)
    return ["".join(rng.choice(K.RESIDUES) for _ in range(rng.choice(K.LENGTHS))) for _ in range(n)]


def test_train(spark):
    rows = [(p, int("K" in p[3:6]), "EBV" if i % 3 else "HPV16") for i, p in enumerate([*peptides(150), *K.HOLDOUTS])]
    table = train.training_table(spark.createDataFrame(rows, "peptide string, label int, virus string"), 21)
    assert table.count() == 150
    got = train.train(table, 21, k=3, trees=10, rounds=3, least=5)
    assert got.scores.count() == 300
    summary = {r.method: r for r in got.summary.collect()}
    assert set(summary) == {"RandomForest", "GradientBoosting"} and summary["RandomForest"].n_folds == 3 and summary["RandomForest"].auc_roc_mean > 0.6
    assert 0 <= got.threshold.first().threshold <= 1
    with pytest.raises(ValueError):
        train.training_table(spark.createDataFrame(rows, "peptide string, label int, virus string"), 30)


def test_validate(spark):
    rng = random.Random(1)
    rows = [(p, y := rng.randint(0, 1), y + rng.random(), rng.random()) for p in peptides(80)]
    d = spark.createDataFrame([(p, y) for p, y, _, _ in rows], "peptide string, label int")
    tools = {name: spark.createDataFrame([(r[0], r[k]) for r in rows] + [(rows[0][0], -1.0)], "peptide string, score double") for name, k in (("model", 2), ("noise", 3))}
    merged = validate.merge_tools(d, tools)
    assert merged.count() == 80 and validate.intersection(merged, ["model", "noise"]).count() == 80
    tests = validate.compare(merged, "model", ["noise"], replicates=20)
    assert {r.metric: r.ci_excludes_zero for r in tests.collect()}["auc_pr"]
    got = validate.verdicts(merged, "model", ["noise"], tests, spark.createDataFrame([("noise", 10.0)], "tool string, overlap_pct double")).first()
    assert got.verdict == "Worse" and got.auc_pr_delta > 0


def test_service():
    assert service.health(None) == {"status": "ok", "model_loaded": False}
    for peptide, model, status in (("SHORT", len, 400), ("CLGGLLTMX", len, 400), ("CLGGLLTMV", None, 503)):
        with pytest.raises(service.RequestError) as e:
            service.score(peptide, model)
        assert e.value.status == status
    assert service.score(" clggllTMV", lambda p: 0.5) == {"peptide": "CLGGLLTMV", "score": 0.5}


def test_registry_runs_without_the_training_data_subpackage(tmp_path):
    copy = tmp_path / "repo"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "llm", "corpus_pipeline.py", "__pycache__", "spark-warehouse"))
    code = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); assert set(o) <= set(q) and not any(n.startswith('op') and n[2].isdigit() or n == 'pipeline' for n in q); print(len(q))"
    said = subprocess.run([sys.executable, "-c", code], cwd=copy, env=os.environ | {"PYTHONPATH": str(copy)}, capture_output=True, text=True, timeout=120)
    assert said.returncode == 0, said.stderr
    assert int(said.stdout) == len(catalog.QUERIES)


def test_nothing_else_imports_the_subpackage():
    for f in (ROOT / "lumenrank").rglob("*.py"):
        if "llm" not in f.relative_to(ROOT).parts:
            assert "lumenrank.llm" not in f.read_text()


@pytest.mark.skipif(not Path("/root/testdata/sf0.001").is_dir(), reason="no tables here")
@pytest.mark.parametrize("name", ["kmer_explode", "rank_flavours", "subgroup_metrics", "threshold_search", "bh_fdr", "overlap_bands"])
def test_oracles(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for f in Path("/root/testdata/sf0.001").glob("*.parquet"):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM read_parquet('{f}')")
    df = catalog.QUERIES[name](spark, "/root/testdata/sf0.001")
    names = sorted(df.columns)
    quoted = ", ".join(f'"{c}"' for c in names)
    want = con.execute(f"SELECT {quoted} FROM ({catalog.ORACLES[name]})").fetchall()
    plain = lambda v: round(float(v), 6) if isinstance(v, (int, float)) and not isinstance(v, bool) else v
    flat = lambda rows: sorted((tuple(map(plain, r)) for r in rows), key=repr)
    assert flat([tuple(r) for r in df.select(*[F.col(c) for c in names]).collect()]) == flat(want)


def test_entry_is_importable():
    assert importlib.util.find_spec("__spark_entry__") is not None
