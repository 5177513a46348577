"""Models on Spark ML: folds, out-of-fold scores, importances, ablations, transfer, calibration."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression, MultilayerPerceptronClassifier, RandomForestClassifier
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumenrank.functions.scalar import hash_unit, logit
from lumenrank.operators.ranking import prefix_sums
from lumenrank.sources.scratch import stored


def stratified_folds(df: DataFrame, key: str, strata: Sequence[str], k: int = 5, seed: int = 42) -> DataFrame:
    """fold 0 to k-1, level within strata, by the order of a hash of the key."""
    w = Window.partitionBy(*strata).orderBy(hash_unit(F.lit(seed), F.col(key)), key)
    return df.withColumn("fold", ((F.row_number().over(w) - 1) % k).cast("int"))


def positive_weight(df: DataFrame, label: str) -> DataFrame:
    """One row: negatives / positives, null without positives."""
    return df.agg(F.when(F.count_if(F.col(label) == 1) > 0, F.count_if(F.col(label) == 0) / F.count_if(F.col(label) == 1)).alias("pos_weight"))


def forest(features: Sequence[str], label: str = "label", weight: str | None = None, trees: int = 200, seed: int = 42) -> Pipeline:
    rf = RandomForestClassifier(labelCol=label, featuresCol="_x", numTrees=trees, seed=seed, maxDepth=8, **({"weightCol": weight} if weight else {}))
    return Pipeline(stages=[VectorAssembler(inputCols=list(features), outputCol="_x", handleInvalid="keep"), rf])


def boosted(features: Sequence[str], label: str = "label", weight: str | None = None, rounds: int = 200, seed: int = 42) -> Pipeline:
    gbt = GBTClassifier(labelCol=label, featuresCol="_x", maxIter=rounds, seed=seed, maxDepth=4, stepSize=0.05, **({"weightCol": weight} if weight else {}))
    return Pipeline(stages=[VectorAssembler(inputCols=list(features), outputCol="_x", handleInvalid="keep"), gbt])


def perceptron(features: Sequence[str], hidden: Sequence[int] = (64, 32), label: str = "label", seed: int = 42) -> Pipeline:
    net = MultilayerPerceptronClassifier(labelCol=label, featuresCol="_z", layers=[len(features), *hidden, 2], seed=seed, maxIter=100)
    return Pipeline(stages=[VectorAssembler(inputCols=list(features), outputCol="_x"), StandardScaler(inputCol="_x", outputCol="_z", withMean=True), net])


def score(model: PipelineModel, df: DataFrame, name: str = "score") -> DataFrame:
    """Probability of class 1 next to the columns of ``df``."""
    return model.transform(df).withColumn(name, vector_to_array("probability")[1]).select(*df.columns, name)


def out_of_fold(df: DataFrame, pipeline: Pipeline, method: str, k: int = 5) -> DataFrame:
    """Every row scored by the model of the folds that it is not in, tagged with the method.

    Each fold's rows are stored as soon as they are scored: no model is kept, and none is asked twice.
    """
    out = None
    for f in range(k):
        model = pipeline.fit(df.filter(F.col("fold") != f))
        part = stored(score(model, df.filter(F.col("fold") == f)).withColumn("method", F.lit(method)), "fold")
        out = part if out is None else out.unionByName(part)
    return out


def save_model(model: PipelineModel, path: str, features: Sequence[str], threshold: float | None = None) -> None:
    """A fitted pipeline with its feature columns and operating threshold, under one folder of any file system."""
    from pyspark.sql import SparkSession

    model.write().overwrite().save(f"{path}/model")
    meta = SparkSession.active().createDataFrame([(list(features), threshold)], "features array<string>, threshold double")
    meta.write.mode("overwrite").json(f"{path}/columns")


def load_model(path: str) -> tuple[PipelineModel, list[str], float | None]:
    """The pipeline, its feature columns and its threshold."""
    from pyspark.sql import SparkSession

    r = SparkSession.active().read.schema("features array<string>, threshold double").json(f"{path}/columns").first()
    return PipelineModel.load(f"{path}/model"), list(r.features), r.threshold


def specific_and_pooled(df: DataFrame, by: str, make: Callable[[], Pipeline], label: str = "label", k: int = 5) -> DataFrame:
    """Out-of-fold scores of each group by a model of its own and by the pooled one, tagged specific or pooled.

    Groups with fewer than ``k`` rows of a class are left to the pooled model, which has no row of theirs here.
    """
    counts = df.filter(F.col(by).isNotNull()).groupBy(by).agg(F.count_if(F.col(label) == 1).alias("p"), F.count_if(F.col(label) == 0).alias("n"))
    values = sorted(r[by] for r in counts.filter((F.col("p") >= k) & (F.col("n") >= k)).collect())
    out = out_of_fold(df, make(), "pooled", k).filter(F.col(by).isin(values))
    for v in values:
        out = out.unionByName(out_of_fold(df.filter(F.col(by) == v), make(), "specific", k))
    return out


def importances(model: PipelineModel, features: Sequence[str]) -> DataFrame:
    from pyspark.sql import SparkSession

    values = model.stages[-1].featureImportances.toArray()
    return SparkSession.active().createDataFrame([(f, float(v)) for f, v in zip(features, values)], "feature string, importance double").orderBy(F.desc("importance"), "feature")


def permutation_importance(model: PipelineModel, df: DataFrame, features: Sequence[str], metric: Callable[[DataFrame], float], key: str, seed: int = 42) -> list[tuple[str, float]]:
    """Loss of the metric when a feature's values go to other rows, by the order of a hash."""
    base = metric(score(model, df))
    out = []
    a = prefix_sums(df.withColumn("_one", F.lit(1)), key, {"_i": "_one"}).drop("_one")
    for f in features:
        b = df.select(F.col(f).alias("_v"), key, hash_unit(F.lit(seed), F.lit(f), F.col(key)).alias("_h"), F.lit(1).alias("_one"))
        b = prefix_sums(b, "_h", {"_i": "_one"}, tie=key).select("_v", "_i")
        out.append((f, base - metric(score(model, a.join(b, "_i").withColumn(f, F.col("_v")).drop("_i", "_v")))))
    return out


def ablation(df: DataFrame, groups: Mapping[str, Sequence[str]], make: Callable[[Sequence[str]], Pipeline], k: int = 5) -> DataFrame:
    """Out-of-fold scores with each group of features, tagged with its name."""
    out = None
    for name, features in groups.items():
        part = out_of_fold(df, make(features), name, k)
        out = part if out is None else out.unionByName(part)
    return out


def transfer(df: DataFrame, by: str, values: Sequence[str], make: Callable[[], Pipeline]) -> DataFrame:
    """Every other value's rows scored by a model of one value's rows: trained_on, tested_on and the scores."""
    out = None
    for a in values:
        model = make().fit(df.filter(F.col(by) == a))
        part = score(model, df.filter(F.col(by) != a)).withColumns({"trained_on": F.lit(a), "tested_on": F.col(by)})
        out = part if out is None else out.unionByName(part)
    return out


def platt(df: DataFrame, score_col: str = "score", label: str = "label") -> tuple[float, float]:
    """Slope and intercept of a logistic fit on the logit of scores."""
    z = VectorAssembler(inputCols=["_z"], outputCol="_x").transform(df.withColumn("_z", logit(F.col(score_col))))
    m = LogisticRegression(labelCol=label, featuresCol="_x").fit(z)
    return float(m.coefficients[0]), float(m.intercept)


def calibrated(score_col: Column, slope: float, intercept: float) -> Column:
    return 1 / (1 + F.exp(-(slope * logit(score_col) + intercept)))


def prototype_labels(df: DataFrame, score_col: str, frozen: bool = False) -> DataFrame:
    """Labels by the median of a score where no model exists; not allowed once a release is frozen."""
    if frozen:
        raise RuntimeError("a frozen release does not fall back to prototype labels")
    return df.crossJoin(F.broadcast(df.agg(F.median(score_col).alias("_m")))).withColumn("label", (F.col(score_col) >= F.col("_m")).cast("int")).drop("_m")


def dense_scores(df: DataFrame, features: Sequence[str], layers: Sequence[tuple], mean: Sequence[float], scale: Sequence[float], *, passes: int = 0, dropout: float = 0.0, seed: int = 42, key: str | None = None) -> DataFrame:
    """Scores of an exported relu network (weights [in][out], bias) over standardised features, in Arrow batches.

    With ``passes``, also the mean and deviation over dropout masks, drawn for each row and pass from the seed
    and the row's ``key`` (or its features), so they do not depend on batches or partitions.
    """
    import numpy as np
    import pandas as pd

    def uniform(rows, i, layer, width):
        """[rows, width] numbers in [0, 1) by a 64-bit mixer of row, seed, pass, layer and unit."""
        with np.errstate(over="ignore"):
            x = rows[:, None] + np.uint64(0x9E3779B97F4A7C15) * (np.arange(width, dtype=np.uint64) + np.uint64(((seed * 1009 + i) * 31 + layer) * 65537))
            for shift, odd in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
                x = (x ^ (x >> np.uint64(shift))) * np.uint64(odd)
        return ((x ^ (x >> np.uint64(31))) >> np.uint64(11)).astype(float) / (1 << 53)

    def forward(x, rows=None, i=0):
        h = x
        for layer, (w, b) in enumerate(layers):
            h = h @ np.asarray(w) + np.asarray(b)
            if layer < len(layers) - 1:
                h = np.maximum(h, 0)
                if rows is not None and dropout:
                    h = h * (uniform(rows, i, layer, h.shape[1]) >= dropout) / (1 - dropout)
        return 1 / (1 + np.exp(-np.clip(h[:, 0], -500, 500)))

    def run(batches):
        for b in batches:
            x = (b[list(features)].to_numpy(float) - np.asarray(mean)) / (np.asarray(scale) + 1e-10)
            rows = pd.util.hash_pandas_object(b[[key] if key else list(features)], index=False).to_numpy(np.uint64)
            many = np.stack([forward(x, rows, i) for i in range(passes)]) if passes else np.full((1, len(b)), np.nan)
            yield b.assign(score=forward(x), mc_score=many.mean(0), uncertainty_std=many.std(0))

    schema = T.StructType([*df.schema.fields, *(T.StructField(c, T.DoubleType()) for c in ("score", "mc_score", "uncertainty_std"))])
    return df.mapInPandas(run, schema)
