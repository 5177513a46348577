"""Scoring backends: peptides by alleles to long predictions."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenrank.functions.scalar import hash_unit


class BindingBackend(Protocol):
    """peptide, allele, affinity, presentation_score, presentation_percentile for each pair."""

    def predict(self, peptides: DataFrame, alleles: Iterable[str]) -> DataFrame: ...


def pairs(peptides: DataFrame, alleles: Iterable[str]) -> DataFrame:
    """Each distinct peptide with each allele, without a shuffle of its own for the alleles."""
    return peptides.select("peptide").distinct().withColumn("allele", F.explode(F.array(*map(F.lit, alleles))))


class LookupBackend:
    """Scores from a table (peptide, allele, presentation_score); pairs that it lacks get none."""

    def __init__(self, scores: DataFrame):
        self.scores = scores

    def predict(self, peptides: DataFrame, alleles: Iterable[str]) -> DataFrame:
        return pairs(peptides, alleles).join(self.scores, ["peptide", "allele"], "left")


class HashBackend:
    """Synthetic, repeatable scores in [0, 1) from md5, in plain SQL; a stand-in where no predictor is installed."""

    def predict(self, peptides: DataFrame, alleles: Iterable[str]) -> DataFrame:
        score = hash_unit(F.col("peptide"), F.col("allele")) / F.lit(4294967296.0)
        out = pairs(peptides, alleles).withColumn("presentation_score", score)
        return out.withColumns({"affinity": F.pow(F.lit(50000.0), 1 - F.col("presentation_score")), "presentation_percentile": (1 - F.col("presentation_score")) * 100})


class ModelBackend:
    """A Python predictor, loaded once per task and fed Arrow batches: ``load()`` gives f(peptides, alleles) -> scores."""

    def __init__(self, load: Callable[[], Callable]):
        self.load = load

    def predict(self, peptides: DataFrame, alleles: Iterable[str]) -> DataFrame:
        load = self.load

        def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            f = load()
            for b in batches:
                yield b.assign(presentation_score=f(b.peptide, b.allele))

        return pairs(peptides, alleles).mapInPandas(score, "peptide string, allele string, presentation_score double")
