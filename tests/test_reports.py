"""Runs over several steps against plain Python."""

import json
import random

import pytest

from lumenrank.operators.curation import GateError
from lumenrank.plans import reports
from lumenrank.sources import writers


def _scored(spark, n=200):
    rng = random.Random(4)
    rows = []
    for i in range(n):
        y = int(rng.random() < 0.3)
        rows.append((f"p{i:04d}", y, i % 5, y + rng.random() * 0.2, rng.random(), "EBV" if i % 2 else None))
    return rows, spark.createDataFrame(rows, "peptide string, label int, fold int, model double, binding double, virus string")


def _issr(rows, col, percent=10):
    top = sorted(rows, key=lambda r: (-r[col], r[0]))[: max(1, len(rows) * percent // 100)]
    return sum(r[1] for r in top) / len(top)


def test_evaluation_against_a_baseline(spark):
    rows, df = _scored(spark)
    e = reports.evaluate(df, "model", "binding", subgroups=["virus"], replicates=40)
    d = e.decision.first()
    folds = [[r for r in rows if r[2] == f] for f in range(5)]
    a, b = (sum(_issr(f, c) for f in folds) / 5 for c in (3, 4))
    assert d.issr_10_score == pytest.approx(a) and d.issr_10_baseline == pytest.approx(b) and d.ratio_10 == pytest.approx(a / b)
    assert d.mean_delta == pytest.approx(a - b) and d.p_value == d.p_value_fdr and 0 < d.n_boot <= 40
    assert d.supported == (d.ratio_10 >= 2 and d.stable and d.ci_low >= 2)
    groups = {(r.subgroup_key, r.subgroup_value) for r in e.folds.collect()}
    assert groups == {("overall", "all"), ("virus", "EBV"), ("virus", "missing")}
    text = reports.evaluation_report(e, "Evaluation", {"data": "x.csv"})
    assert f"**{'SUPPORTED' if d.supported else 'NOT SUPPORTED'}**" in text and "| model |" in text and f"`{d.ratio_10:.4f}`" in text


def test_a_ratio_over_nothing_supports_nothing(spark):
    df = spark.createDataFrame([(f"p{i}", int(i < 2), i % 2, float(-i), float(i)) for i in range(20)], "peptide string, label int, fold int, model double, binding double")
    d = reports.evaluate(df, "model", "binding", replicates=5).decision.first()
    assert d.issr_10_baseline == 0 and d.ratio_10 is None and not d.stable and not d.supported


def test_comparison_names_undefined_measures(spark):
    cols = ", ".join(f"{m}_mean double, {m}_std_pop double" for m in reports.HEADINGS)
    r = reports.comparison(spark.createDataFrame([("RF", 0.5, 0.125, None, None, 0.25, 0.0, 1.0, None)], f"method string, {cols}")).first()
    assert (r["AUC-ROC"], r["AUC-PR"], r["ISSR@10"], r["ISSR@25"]) == ("0.5000 +/- 0.1250", "N/A", "0.2500 +/- 0.0000", "N/A") and r["ISSR@25_mean"] == 1.0


def test_curation_writes_only_what_the_gates_pass(spark, tmp_path):
    raw = tmp_path / "raw.csv"
    lines = ["ACDEFGHIK,Positive-High,", "acdefghik,Negative,100", "ACDEFGHIK,Positive,", "LLLLLLLLL,Negative,100", "MMMMMMMMM,Negative,9000", "VVVVVVVVV,,10", "AXA,Positive,", "GGGGGGGGG,Positive,", "GGGGGGGGG,Negative,5"]
    raw.write_text("link,,\nseq,measure,nM\n" + "\n".join(lines) + "\n")
    names = {"peptide": "seq", "measure": "measure", "affinity": "nM"}
    counts = reports.curate(spark, str(raw), str(tmp_path / "out"), **names)
    got = {(r.peptide, r.label) for r in spark.read.option("header", True).csv(str(tmp_path / "out")).collect()}
    assert got == {("ACDEFGHIK", "1"), ("LLLLLLLLL", "0")} and counts["n_rows"] == 2
    with pytest.raises(GateError):
        reports.curate(spark, str(raw), str(tmp_path / "none"), **names, gates=reports.curation.ConsensusGates(least_yield=0.9))
    assert not (tmp_path / "none").exists()


def test_review_summary_and_frozen_release(spark, tmp_path):
    m = spark.createDataFrame([("RF", 7, 0.5), ("PRIME", 7, 0.25)], "tool string, n long, auc_pr double")
    s = reports.review_summary("runs/r1", ["RF", "other"], {"intersection": m, "excluded": m, "only": None, "lengths": spark.createDataFrame([("RF", 9, 0.75)], "tool string, length int, auc_pr double")})
    assert s["run_id"] == "r1" and s["overlap_excluded_n"] == 7 and s["overlap_only_n"] is None and s["overlap_excluded_auc_pr"] == {"RF": 0.5, "other": None}
    assert s["intersection_metrics"] == {"RF": {"tool": "RF", "n": 7, "auc_pr": 0.5}, "other": {}} and s["nine_mer_auc_pr"] == {"RF": 0.75, "other": None}
    writers.json_report(s, tmp_path / "s.json")
    assert json.loads((tmp_path / "s.json").read_text()) == s
    with pytest.raises(ValueError):
        reports.records(m, most=1)
    reports.require_frozen(tmp_path / "s.json", {"metrics": m})
    with pytest.raises(RuntimeError, match="model .*, metrics"):
        reports.require_frozen(tmp_path / "gone", {"metrics": m.filter("false")})
