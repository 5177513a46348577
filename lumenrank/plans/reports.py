"""Entry 4: runs over several steps: curation to a file, evaluation against a baseline score, reports, freeze checks."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenrank.operators import aggregates, curation, governance, metrics, ml, stats
from lumenrank.plans.catalog import _FOLDS, LABELLED, labelled, metrics_sql, query
from lumenrank.sources import readers, writers

#: The measures of a report and their headings.
HEADINGS = {"auc_roc": "AUC-ROC", "auc_pr": "AUC-PR", "issr_10": "ISSR@10", "issr_25": "ISSR@25"}


def curate(spark: SparkSession, path: str, target: str, *, peptide: str, measure: str, affinity: str, gates: curation.ConsensusGates = curation.ConsensusGates()) -> dict:
    """An assay export (header on its second line) to a file of one label per valid sequence; returns the gate's counts.

    A measure that says Positive is label 1, any other 0, none drops the row; weakly binding negatives and
    tied sequences go; the file is written only if every gate is met.
    """
    raw = readers.table_below(spark, path, 1)
    label = F.when(F.col(f"`{measure}`").isNotNull(), F.col(f"`{measure}`").contains("Positive").cast("int"))
    rows = raw.select(F.col(f"`{peptide}`").alias("peptide"), label.alias("label"), F.col(f"`{affinity}`").alias("affinity"))
    kept = curation.consensus(curation.mine_negatives(curation.sanitise(rows)), gates=gates)
    counts = curation.gate(kept)
    writers.delimited(kept, target)
    return counts


@dataclass(frozen=True)
class Evaluation:
    folds: DataFrame  # per method, fold and subgroup
    summary: DataFrame  # mean and deviation per method
    decision: DataFrame  # one row


def evaluate(scored: DataFrame, score: str, baseline: str, *, key: str = "peptide", label: str = "label", subgroups: Sequence[str] = (), replicates: int = 5000, least: int = 15) -> Evaluation:
    """A score against a baseline one on out-of-fold rows (key, label, fold, both scores, subgroups).

    The decision holds the ratios of their mean enrichment, the bootstrapped interval of the first (over
    replicates where the baseline's is above 0), the sign-flip p-value of the folds' differences, adjusted
    too, and whether the ratio is supported. A ratio over 0 is null and supports nothing.
    """
    long = scored.unpivot([key, label, "fold", *subgroups], [score, baseline], "method", "_score")
    every = metrics.ranked_metrics(long, ["method", "fold"], "_score", label, key).withColumns({"subgroup_key": F.lit("overall"), "subgroup_value": F.lit("all")})
    folds = every
    if subgroups:
        parts = metrics.subgroup_metrics(long, ["method", "fold"], subgroups, "_score", label, key, least)
        folds = every.unionByName(parts.filter("subgroup_key <> 'overall'"))
    summary = aggregates.fold_summary(every, ["method"], list(HEADINGS))

    def side(value: str, method: str) -> Column:
        return F.max(F.when(F.col("method") == method, F.col(value)))

    means = [side(f"{m}_mean", s).alias(f"{m}_{name}") for m in ("issr_10", "issr_25") for s, name in ((score, "score"), (baseline, "baseline"))]
    ratio = lambda m: F.when(F.col(f"{m}_baseline") > 0, F.col(f"{m}_score") / F.col(f"{m}_baseline"))
    ratios = summary.agg(*means).select("*", ratio("issr_10").alias("ratio_10"), ratio("issr_25").alias("ratio_25"))

    deltas = every.groupBy("fold").agg((side("issr_10", score) - side("issr_10", baseline)).alias("delta")).filter("delta IS NOT NULL")
    flipped = stats.benjamini_hochberg(stats.sign_flip(deltas, "delta"), "p_value")

    drawn = stats.resampled(scored.select(key, label, score, baseline), key, replicates).withColumnRenamed("b", "replicate")
    sides = drawn.unpivot(["replicate", "_slot", label], [score, baseline], "method", "_score")
    issr = metrics.ranked_metrics(sides, ["replicate", "method"], "_score", label, "_slot", spread=False).groupBy("replicate").agg(side("issr_10", score).alias("a"), side("issr_10", baseline).alias("b"))
    ci = stats.interval(issr.withColumn("ratio", F.when(F.col("b") > 0, F.col("a") / F.col("b"))), "ratio").select("n_boot", "ci_low", "ci_high")

    supported = stats.ratio_supported(F.col("ratio_10"), F.col("issr_10_baseline"), F.col("ci_low"))
    stable = F.coalesce(F.col("issr_10_baseline") >= 0.08, F.lit(False))
    decision = ratios.crossJoin(ci).crossJoin(flipped).withColumns({"stable": stable, "supported": supported})  # one row each
    return Evaluation(folds, summary, decision)


def comparison(summary: DataFrame, by: str = "method", deviation: str = "std_pop") -> DataFrame:
    """A row of a fold summary as a report shows it: mean +/- deviation of each measure (N/A without one), and the mean."""
    out = []
    for m, heading in HEADINGS.items():
        known = F.col(f"{m}_mean").isNotNull() & F.col(f"{m}_{deviation}").isNotNull()
        text = F.format_string("%.4f +/- %.4f", F.col(f"{m}_mean"), F.col(f"{m}_{deviation}"))
        out += [F.when(known, text).otherwise("N/A").alias(heading), F.col(f"{m}_mean").alias(f"{heading}_mean")]
    return summary.select(F.col(by).alias("Model"), *out)


def evaluation_report(evaluation: Evaluation, title: str, inputs: Mapping[str, str]) -> str:
    """Markdown of an evaluation: its inputs, the methods' measures, the ratios with their support, and the decision."""
    d = evaluation.decision.first()
    cell = lambda v: "N/A" if v is None else f"{v:.4f}"
    facts = {
        "ISSR@10 ratio": cell(d.ratio_10), "ISSR@25 ratio": cell(d.ratio_25), "95% interval of the ISSR@10 ratio": f"[{cell(d.ci_low)}, {cell(d.ci_high)}]",
        "Sign-flip p-value of the folds": f"{cell(d.p_value)} (adjusted {cell(d.p_value_fdr)})", "Denominator": "stable" if d.stable else "low, the ratio may be unstable",
    }
    shown = comparison(evaluation.summary).select("Model", *HEADINGS.values())
    listed = lambda of: "".join(f"- {k}: `{v}`\n" for k, v in of.items())
    return f"# {title}\n\n## Inputs\n{listed(inputs)}\n## Methods\n{governance.markdown_table(shown, ['Model'])}\n## Ratios\n{listed(facts)}\n## Decision\n**{'SUPPORTED' if d.supported else 'NOT SUPPORTED'}**\n"


def records(df: DataFrame | None, most: int = 10_000) -> list[dict]:
    """The rows of a report's table; none for a missing one, an error for more than ``most``."""
    rows = [] if df is None else df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"a report table of more than {most} rows")
    return [r.asDict(recursive=True) for r in rows]


def review_summary(run: str, tools: Iterable[str], tables: Mapping[str, DataFrame | None], *, coverage: Mapping = {}, overlap: Mapping = {}) -> dict:
    """What a reviewer reads of a run, from its tables; whatever is missing is empty or null.

    Tables by name: ``intersection``, ``excluded`` and ``only`` (metrics by tool on all shared rows, without and
    with only the training overlap), ``weighted`` (tool, weighted_auc_pr), ``tests``, ``verdicts``,
    ``transfer``, ``lengths`` (tool, length, auc_pr) and ``holdout``.
    """
    of, tools = {k: records(v) for k, v in tables.items()}, list(tools)
    row = lambda table, tool: next((r for r in of.get(table, []) if r.get("tool") == tool), {})
    size = lambda table: next((r.get("n") for r in of.get(table, [])), None)
    return {
        "run_id": Path(run).name, "coverage": dict(coverage), "training_overlap": dict(overlap), "verdicts": of.get("verdicts", []),
        "intersection_metrics": {t: row("intersection", t) for t in tools},
        "overlap_excluded_n": size("excluded"), "overlap_excluded_auc_pr": {t: row("excluded", t).get("auc_pr") for t in tools},
        "overlap_only_n": size("only"), "overlap_only_auc_pr": {t: row("only", t).get("auc_pr") for t in tools},
        "weighted_auc_pr": {r["tool"]: r["weighted_auc_pr"] for r in of.get("weighted", [])}, "primary_tests": of.get("tests", []),
        "transfer": of.get("transfer", []), "holdout_n": len(of.get("holdout", [])),
        "nine_mer_auc_pr": {t: next((r["auc_pr"] for r in of.get("lengths", []) if r["tool"] == t and r["length"] == 9), None) for t in tools},
    }


def require_frozen(model: str | Path, outputs: Mapping[str, DataFrame]) -> None:
    """A frozen release needs its model and a row in every output; anything missing is an error that names it."""
    missing = [] if Path(model).exists() else [f"model {model}"]
    missing += [name for name, df in outputs.items() if df.isEmpty()]
    if missing:
        raise RuntimeError(f"a frozen release lacks: {', '.join(missing)}")


_REPORT = ", ".join(f"""CASE WHEN count({m}) > 0 THEN printf('%.4f +/- %.4f', avg({m}), stddev_pop({m})) ELSE 'N/A' END AS "{h}", round(avg({m}), 8) AS "{h}_mean" """ for m, h in HEADINGS.items())


@query(f"SELECT lang AS \"Model\", {_REPORT} FROM ({metrics_sql('folds', 'lang, fold', f'{LABELLED}, {_FOLDS}')}) GROUP BY lang")
def baseline_report(spark, sf_dir):
    rows = ml.stratified_folds(labelled(spark, sf_dir), "doc_id", ["label"])
    folds = metrics.ranked_metrics(rows, ["lang", "fold"], "score", "label", "doc_id")
    shown = comparison(aggregates.fold_summary(folds, ["lang"], list(HEADINGS)), "lang")
    return shown.withColumns({c: F.round(c, 8) for c in shown.columns if c.endswith("_mean")})
