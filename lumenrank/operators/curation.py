"""Label curation: cleaning, mining, votes with gates, and quality gates over a dataset."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenrank.functions import sequence
from lumenrank.operators.aggregates import conflicts, duplicates, majority_vote


class GateError(ValueError):
    """A quality gate was not met."""


def sanitise(df: DataFrame, peptide: str = "peptide", label: str = "label") -> DataFrame:
    """Upper-cased, trimmed, valid sequences with a label of 0 or 1."""
    if missing := {peptide, label} - set(df.columns):
        raise GateError(f"missing columns: {sorted(missing)}")
    clean = df.withColumn(peptide, F.upper(F.trim(peptide)))
    return clean.filter(sequence.valid_peptide(F.col(peptide)) & F.col(label).isin(0, 1))


def mine_negatives(df: DataFrame, label: str = "label", affinity: str = "affinity", most: float = 500.0) -> DataFrame:
    """Positives, and negatives that bind strongly; without an affinity column all rows pass."""
    if affinity not in df.columns:
        return df
    value = F.expr(f"try_cast(`{affinity}` AS DOUBLE)")
    return df.filter((F.col(label) == 1) | ((F.col(label) == 0) & (value <= most)))


@dataclass(frozen=True)
class ConsensusGates:
    conflict_ratio: float = 1.0
    least_yield: float = 0.0


def consensus(df: DataFrame, key: str = "peptide", label: str = "label", gates: ConsensusGates = ConsensusGates()) -> DataFrame:
    """Majority label with ties dropped; the gates look at one row of counts."""
    out = majority_vote(df, [key], label, tie="drop")
    total = df.agg(F.countDistinct(key).alias("n")).first().n
    if total:
        if conflicts(df, [key], label).count() / total > gates.conflict_ratio:
            raise GateError("too many keys have conflicting labels")
        if out.count() / total < gates.least_yield:
            raise GateError("too few keys are left")
    return out


def audit(df: DataFrame, peptide: str, label: str) -> DataFrame:
    """One row: rows, classes, missing labels, distinct keys, lengths."""
    n = F.length(peptide)
    return df.agg(
        F.count("*").alias("n_rows"), F.count_if(F.col(label) == 1).alias("n_positive"), F.count_if(F.col(label) == 0).alias("n_negative"), F.count_if(F.col(label).isNull()).alias("n_unlabelled"),
        F.countDistinct(peptide).alias("n_distinct"), F.min(n).cast("long").alias("min_length"), F.max(n).cast("long").alias("max_length"), F.avg(n).alias("mean_length"),
    )


def violations(df: DataFrame, key: str, label: str, bad: str) -> DataFrame:
    """One row of counts that a gate looks at. ``bad``: a pattern that a key must not match."""
    one = df.agg(F.count("*").alias("n_rows"), F.count_if(F.col(key).rlike(bad)).alias("n_bad_alphabet"), F.count_if(F.col(label) == 1).alias("n_positive"), F.count_if(F.col(label) == 0).alias("n_negative"))
    twice = duplicates(df, [key, label]).agg(F.count("*").alias("n_duplicates"))
    mixed = conflicts(df, [key], label).agg(F.count("*").alias("n_conflicts"))
    ratio = F.when(F.col("n_negative") > 0, F.col("n_positive") / F.col("n_negative"))
    return one.crossJoin(twice).crossJoin(mixed).withColumn("class_ratio", ratio)


def gate(df: DataFrame, key: str = "peptide", label: str = "label") -> dict:
    """Fail on bad residues, duplicates or conflicts; report the counts and a warning about the class ratio."""
    row = violations(df, key, label, f"[^{sequence.K.RESIDUES}]").first().asDict()
    problems = [c for c in ("n_bad_alphabet", "n_duplicates", "n_conflicts") if row[c]]
    if problems:
        raise GateError(f"quality gate: {', '.join(f'{c} = {row[c]}' for c in problems)}")
    ratio = row["class_ratio"]
    return row | {"warning": None if ratio is not None and 0.1 <= ratio <= 10 else "unbalanced classes"}


def release_gates(metrics: DataFrame, threshold: DataFrame, deltas: DataFrame, counts: DataFrame) -> DataFrame:
    """One row of release decisions from the tables of a run."""
    a = metrics.filter("subgroup_key = 'virus'").agg(F.coalesce(F.bool_and(F.coalesce(F.col("auc_pr") >= 0.55, F.lit(True))), F.lit(True)).alias("no_severe_subgroup_underperformance"))
    b = threshold.agg(F.coalesce(F.bool_and((F.col("overall_precision") >= 0.55) & (F.col("overall_recall") >= 0.55)), F.lit(False)).alias("acceptable_threshold_tradeoff"))
    c = deltas.agg(F.coalesce(F.bool_and(F.col("delta_recovery_top25") > -0.20), F.lit(True)).alias("gold_standard_not_brittle"))
    d = counts.agg(F.coalesce(F.bool_and((F.col("n_total") > 0) & (F.col("raw_n_records") > 0)), F.lit(False)).alias("dataset_provenance_complete"))
    out = a.crossJoin(b).crossJoin(c).crossJoin(d)
    every = F.lit(True)
    for name in out.columns:
        every = every & F.col(name)
    return out.withColumn("all_passed", every)


def pool_manifest(df: DataFrame, pool: str, key: str, value: str, forced: Column, n: int) -> DataFrame:
    """A row per pool: distinct keys, the size of its first ``n`` with the forced rows, the value at rank n, and the forced rows in it and beyond its first n."""
    w = Window.partitionBy(pool).orderBy(F.desc(value), key)
    r = df.withColumns({"_forced": F.coalesce(forced, F.lit(False)), "_rn": F.row_number().over(w)})
    top = F.col("_rn") <= n
    return r.groupBy(pool).agg(
        F.count_distinct(key).alias("n_unique"), F.count_if(top | F.col("_forced")).alias("pool_size"), F.lit(n).alias("top_n"), F.max(F.when(F.col("_rn") == n, F.col(value))).alias("value_at_rank_n"),
        F.count_if("_forced").alias("gold_in_pool"), F.count_if(F.col("_forced") & ~top).alias("gold_forced"),
    )
