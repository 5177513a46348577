"""Entry 1: sequences to ranked, evaluated candidates."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenrank.functions import constants as K
from lumenrank.functions import scalar, sequence
from lumenrank.operators.aggregates import pivot_values, sorted_set
from lumenrank.operators.backends import BindingBackend
from lumenrank.operators.ranking import rank_contiguous
from lumenrank.operators.relational import best_per_key


def peptides(proteins: DataFrame, lengths: Iterable[int] = K.LENGTHS) -> DataFrame:
    """Stage 1: windows of standard residues with their coordinates."""
    out = sequence.kmers(proteins.select("protein_id", "seq"), "seq", lengths)
    return out.filter(sequence.standard(F.col("peptide"))).select("protein_id", "peptide", "length", "start", "end")


def binding(found: DataFrame, backend: BindingBackend, alleles: Iterable[str] = K.ALLELES) -> DataFrame:
    """Stage 2: the best allele of each distinct peptide, all alleles' scores as columns, and its source proteins.

    Wide columns and the best row come from one aggregation of the predictions.
    """
    alleles = list(alleles)
    long = backend.predict(found, alleles)
    names = {a: "bind_" + "".join(c for c in a.removeprefix("HLA-") if c.isalnum()) for a in alleles}
    wide = pivot_values(long, ["peptide"], "allele", "presentation_score", names)
    best = best_per_key(long, ["peptide"], F.desc_nulls_last("presentation_score"), F.col("allele").asc())
    proteins = sorted_set(found, ["peptide"], "protein_id").select("peptide", F.col("first_value").alias("protein_id"), F.col("all_values").alias("protein_ids"), F.col("n_values").alias("source_protein_count"))
    return best.join(wide, "peptide").join(proteins, "peptide")


def features(bound: DataFrame) -> DataFrame:
    """Stage 3: property columns of the contact positions."""
    return sequence.features(bound, "peptide", "presentation_score")


def ranked(scored: DataFrame, score: str = "immunogenicity_score", threshold: float | None = None) -> DataFrame:
    """Stage 4: rank by score, ties by peptide, and the call at an operating threshold."""
    out = rank_contiguous(scored, score, "peptide")
    return out if threshold is None else out.withColumn("immunogenic", F.when(F.col(score) >= threshold, 1).otherwise(0))


def linear_score(df: DataFrame, weights: dict[str, float], intercept: float = 0.0) -> Column:
    """A stated linear model's probability, where no trained one is at hand."""
    z = F.lit(intercept)
    for c, w in weights.items():
        z = z + F.col(c) * w
    return scalar.sigmoid(z)


def stage_recovery(gold: DataFrame, found: DataFrame, bound: DataFrame, final: DataFrame, strong: float = 0.5) -> DataFrame:
    """Per gold peptide: found in stages 1 and 2, strong binder, rank, and in the top quarter."""
    n = final.agg(F.count("*").alias("_n"))
    one = found.select("peptide").distinct().withColumn("stage1_found", F.lit(True))
    two = bound.groupBy("peptide").agg(F.max("presentation_score").alias("_s")).select("peptide", F.lit(True).alias("stage2_found"), (F.col("_s") >= strong).alias("stage2_strong_binder"))
    four = final.groupBy("peptide").agg(F.min("rank").alias("rank"))
    out = gold.join(one, "peptide", "left").join(two, "peptide", "left").join(four, "peptide", "left").crossJoin(F.broadcast(n))
    out = out.withColumns({"stage4_found": F.col("rank").isNotNull(), "in_top_25pct": F.coalesce(F.col("rank") <= F.col("_n") * 0.25, F.lit(False))}).drop("_n")
    return out.na.fill(False, ["stage1_found", "stage2_found", "stage2_strong_binder"])
