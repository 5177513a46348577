"""Entry 2: labelled items to out-of-fold scores, metrics, an operating threshold and final models."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml import Pipeline, PipelineModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenrank.functions import constants as K
from lumenrank.functions import sequence
from lumenrank.operators import aggregates, metrics, ml, relational


@dataclass(frozen=True)
class Training:
    scores: DataFrame  # out of fold, tagged by method
    fold_metrics: DataFrame  # per method, fold and subgroup
    summary: DataFrame  # mean and deviation per method
    threshold: DataFrame
    models: dict[str, PipelineModel]


def holdouts(df: DataFrame) -> DataFrame:
    """The sequences that never train a model."""
    return df.sparkSession.createDataFrame([(p,) for p in K.HOLDOUTS], "peptide string")


def training_table(dataset: DataFrame, width: int, binding: DataFrame | None = None, pockets: DataFrame | None = None) -> DataFrame:
    """Features of a model width for the dataset without the hold-outs; missing binding scores are 0."""
    df = relational.holdout_split(dataset, holdouts(dataset), "peptide")[0]
    df = sequence.features(df, "peptide", None)
    if binding is not None:
        df = relational.left_with_defaults(df, binding.select("peptide", *K.ALLELE_COLUMNS), ["peptide"], dict.fromkeys(K.ALLELE_COLUMNS, 0.0))
    if pockets is not None:
        df = df.join(pockets, "allele", "left").na.fill(0.0, list(K.POCKET))
    wanted = sequence.model_columns(width)
    if missing := [c for c in wanted if c not in df.columns]:
        raise ValueError(f"a model of {width} columns needs {missing[:5]}")
    return df.withColumns({c: F.col(c).cast("double") for c in wanted})


def train(table: DataFrame, width: int, *, k: int = 5, trees: int = 200, rounds: int = 200, group: str = "virus", least: int = 15) -> Training:
    """Both methods under stratified folds and sample weights, then refitted on all rows with the same weights."""
    features = list(sequence.model_columns(width))
    df = aggregates.sample_weights(ml.stratified_folds(table, "peptide", ["label"], k), group, F.length("peptide") == 9)
    methods: dict[str, Pipeline] = {"RandomForest": ml.forest(features, weight="weight", trees=trees), "GradientBoosting": ml.boosted(features, weight="weight", rounds=rounds)}
    scores, models = None, {}
    for name, pipeline in methods.items():
        part = ml.out_of_fold(df, pipeline, name, k).select("peptide", group, "label", "score", "fold", "method")
        scores = part if scores is None else scores.unionByName(part)
        models[name] = pipeline.fit(df)
    fold_metrics = metrics.subgroup_metrics(scores, ["method", "fold"], [group], "score", "label", "peptide", least)
    overall = fold_metrics.filter("subgroup_key = 'overall'")
    summary = aggregates.fold_summary(overall, ["method"], ["auc_roc", "auc_pr", "issr_10", "issr_25"])
    threshold = metrics.pick_threshold(metrics.threshold_candidates(scores.filter("method = 'RandomForest'"), "score", "label", group, least))
    return Training(scores, fold_metrics, summary, threshold, models)


def hidden_layer_search(df: DataFrame, features: list[str], layouts: list[tuple[int, ...]], k: int = 5) -> DataFrame:
    """Out-of-fold metrics of each layout of a perceptron."""
    out = ml.ablation(df, {"x".join(map(str, h)): h for h in layouts}, lambda h: ml.perceptron(features, h), k)
    return metrics.ranked_metrics(out, ["method"], "score", "label", "peptide", spread=False)
