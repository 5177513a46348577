"""Entry 3: scores of a model and of other tools on one evaluation set: metrics, tests, overlap, verdicts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenrank.operators import metrics, relational, stats


def merge_tools(dataset: DataFrame, tools: dict[str, DataFrame], value: str = "score") -> DataFrame:
    """The dataset with one column per tool: the largest of a tool's scores for an item."""
    out = dataset
    for name, t in tools.items():
        out = out.join(t.groupBy("peptide").agg(F.max(value).alias(name)), "peptide", "left")
    return out


def intersection(merged: DataFrame, tools: Sequence[str]) -> DataFrame:
    """Rows that every tool scored."""
    return merged.na.drop(subset=list(tools))


def compare(merged: DataFrame, reference: str, tools: Sequence[str], *, replicates: int = 2000, least: int = 20) -> DataFrame:
    """tool, metric, interval and adjusted p-value of reference minus tool, over rows that both scored."""
    out = None
    for tool in tools:
        rows = merged.filter(F.col(reference).isNotNull() & F.col(tool).isNotNull()).select("peptide", "label", F.col(reference).alias("model"), F.col(tool).alias("other"))
        drawn = stats.resampled(rows, "peptide", replicates).withColumnRenamed("b", "replicate")
        long = drawn.unpivot(["replicate", "_slot", "label"], ["model", "other"], "side", "score")
        m = metrics.ranked_metrics(long, ["replicate", "side"], "score", "label", "_slot", spread=False)
        side = lambda c, s: F.max(F.when(F.col("side") == s, F.col(c)))
        wide = m.filter(F.col("n") >= least).groupBy("replicate").agg(*[(side(c, "model") - side(c, "other")).alias(c) for c in ("auc_pr", "issr_10")])
        part = stats.interval(wide.unpivot(["replicate"], ["auc_pr", "issr_10"], "metric", "difference"), "difference", ["metric"]).withColumn("tool", F.lit(tool))
        out = part if out is None else out.unionByName(part)
    return stats.benjamini_hochberg(out, "p_value").withColumns({"ci_excludes_zero": (F.col("ci_low") > 0) | (F.col("ci_high") < 0), "fdr_significant": F.col("p_value_fdr") < 0.05})


def verdicts(merged: DataFrame, reference: str, tools: Sequence[str], tests: DataFrame, overlaps: DataFrame) -> DataFrame:
    """tool, deltas and verdict. ``overlaps``: tool, overlap_pct (null if unknown)."""
    m = metrics.tool_metrics(merged, [reference, *tools], "label", "peptide").select("tool", "auc_pr", "issr_10")
    base = relational.baseline_delta(m.withColumn("_all", F.lit(1)), ["_all"], F.col("tool") == reference, ["auc_pr", "issr_10"]).filter(F.col("tool") != reference)
    of = lambda metric, c: F.coalesce(F.max(F.when(F.col("metric") == metric, F.col(c))), F.lit(False))
    t = tests.groupBy("tool").agg(of("auc_pr", "fdr_significant").alias("af"), of("issr_10", "fdr_significant").alias("xf"), of("auc_pr", "ci_excludes_zero").alias("ac"), of("issr_10", "ci_excludes_zero").alias("xc"))
    j = base.join(t, "tool", "left").na.fill(False, ["af", "xf", "ac", "xc"]).join(overlaps, "tool", "left")
    v = stats.verdict(-F.col("delta_auc_pr"), -F.col("delta_issr_10"), F.col("af"), F.col("xf"), F.col("ac"), F.col("xc"), F.col("overlap_pct"))
    return j.select("tool", F.bround(-F.col("delta_auc_pr"), 4).alias("auc_pr_delta"), F.bround(-F.col("delta_issr_10"), 4).alias("issr10_delta"), "overlap_pct", v.alias("verdict"))
