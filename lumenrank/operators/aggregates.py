"""Group aggregations: votes, collapses, pivots, weights, profiles."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def collapse_max_mean(df: DataFrame, key: Sequence[str], value: str) -> DataFrame:
    """Largest and mean value of each key."""
    return df.groupBy(*key).agg(F.max(value).alias(f"{value}_max"), F.avg(value).alias(f"{value}_mean"))


def majority_vote(df: DataFrame, key: Sequence[str], label: str, tie: str = "positive") -> DataFrame:
    """Label of each key by majority. Ties: 'positive' makes them 1, 'drop' removes them."""
    votes = df.groupBy(*key).agg(F.avg(label).alias("_p"), F.count(label).alias("n_votes"))
    if tie == "drop":
        votes = votes.filter("_p <> 0.5")
    return votes.select(*key, F.when(F.col("_p") >= 0.5, 1).otherwise(0).alias("label"), "n_votes")


def first_non_null(df: DataFrame, key: Sequence[str], columns: Sequence[str], *order: str) -> DataFrame:
    """Per key the first non-null value of each column, by ``order``."""
    by = F.struct(*order)
    return df.groupBy(*key).agg(*[F.min_by(F.col(c), F.when(F.col(c).isNotNull(), by)).alias(c) for c in columns])


def sorted_set(df: DataFrame, key: Sequence[str], value: str, separator: str = "|") -> DataFrame:
    """Per key the distinct values in order: the first, all joined, and how many."""
    s = F.array_sort(F.collect_set(F.col(value).cast("string")))
    return df.groupBy(*key).agg(s.alias("_s")).select(*key, F.col("_s")[0].alias("first_value"), F.array_join("_s", separator).alias("all_values"), F.size("_s").cast("long").alias("n_values"))


def conflicts(df: DataFrame, key: Sequence[str], label: str) -> DataFrame:
    """Keys with more than one distinct label."""
    return df.groupBy(*key).agg(F.countDistinct(label).alias("n_labels"), F.count("*").alias("n_rows")).filter("n_labels > 1")


def duplicates(df: DataFrame, key: Sequence[str]) -> DataFrame:
    return df.groupBy(*key).agg(F.count("*").alias("n_rows")).filter("n_rows > 1")


def pivot_values(df: DataFrame, key: Sequence[str], column: str, value: str, names: Mapping[str, str], default: float | None = None) -> DataFrame:
    """Long to wide over stated values (value in ``column``: output name); missing cells get the default."""
    cells = [F.max(F.when(F.col(column) == v, F.col(value))).alias(n) for v, n in names.items()]
    out = df.groupBy(*key).agg(*cells)
    return out if default is None else out.na.fill(default, list(names.values()))


def strict_pivot_violations(df: DataFrame, key: Sequence[str], column: str) -> DataFrame:
    """Cells that a strict pivot would reject because they have several values."""
    return duplicates(df, [*key, column])


def sample_weights(df: DataFrame, group: str, is_usual_length: Column, group_weight: float = 0.5, length_weight: float = 0.5) -> DataFrame:
    """Weights that level groups and lengths, with mean 1. Rows without a group keep theirs.

    Group counts are a small table, so nothing is windowed over all rows.
    """
    base = df.withColumn("_usual", F.coalesce(is_usual_length, F.lit(False)))
    counts = base.groupBy(group, "_usual").agg(F.count("*").alias("_n"))
    everything = Window.partitionBy(F.lit(1))
    n = F.sum("_n").over(everything)
    of_group = F.sum("_n").over(Window.partitionBy(group))
    groups = F.size(F.collect_set(group).over(everything))
    share = F.sum(F.when(F.col("_usual"), F.col("_n")).otherwise(0)).over(everything) / n
    by_group = F.when(F.col(group).isNull() | (groups <= 1), 1.0).otherwise((1 - group_weight) + group_weight / groups / F.greatest(of_group / n, F.lit(1e-6)))
    by_length = F.when((share <= 0) | (share >= 1), 1.0).otherwise((1 - length_weight) + length_weight * 0.5 / F.when(F.col("_usual"), share).otherwise(1 - share))
    w = counts.select(F.col(group).alias("_g"), F.col("_usual").alias("_u"), "_n", (by_group * by_length).alias("_w"))
    w = w.withColumn("weight", F.col("_w") / (F.sum(F.col("_w") * F.col("_n")).over(everything) / F.sum("_n").over(everything))).select("_g", "_u", "weight")
    return base.join(w, F.col(group).eqNullSafe(F.col("_g")) & (F.col("_usual") == F.col("_u"))).drop("_g", "_u", "_usual")


def error_taxonomy(df: DataFrame, group: Sequence[str], label: str, predicted: str) -> DataFrame:
    """Rows, false positives, false negatives and their rates of each group."""
    fp, fn = F.count_if((F.col(predicted) == 1) & (F.col(label) == 0)), F.count_if((F.col(predicted) == 0) & (F.col(label) == 1))
    return df.groupBy(*group).agg(F.count("*").alias("total"), fp.alias("fp"), fn.alias("fn"), F.round(fp / F.count("*"), 4).alias("fp_rate"), F.round(fn / F.count("*"), 4).alias("fn_rate"))


def coverage(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """A row per column: present, missing, share present."""
    one = df.agg(F.count("*").alias("n"), *[F.count(c).alias(c) for c in columns])
    long = one.unpivot("n", list(columns), "tool", "present")
    return long.select("tool", "present", (F.col("n") - F.col("present")).alias("missing"), F.when(F.col("n") > 0, F.col("present") * 100.0 / F.col("n")).alias("coverage_pct"))


def with_total(df: DataFrame, group: str, value: str, total_name: str = "ALL") -> DataFrame:
    """Count, sum and mean of each group, and one row of the counts and sums over all with the mean of the means."""
    g = df.groupBy(F.col(group).cast("string").alias(group)).agg(F.count("*").alias("n"), F.sum(value).alias("total"), F.avg(value).alias("mean"))
    t = g.agg(F.sum("n").alias("n"), F.sum("total").alias("total"), F.avg("mean").alias("mean")).select(F.lit(total_name).alias(group), "n", "total", "mean")
    return g.unionByName(t)


def fold_summary(df: DataFrame, by: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    """Mean, population and sample deviation of metrics over folds; nulls do not count."""
    out = []
    for m in metrics:
        out += [F.avg(m).alias(f"{m}_mean"), F.stddev_pop(m).alias(f"{m}_std_pop"), F.stddev_samp(m).alias(f"{m}_std")]
    return df.groupBy(*by).agg(F.count("*").alias("n_folds"), *out) if by else df.agg(F.count("*").alias("n_folds"), *out)
