"""Ranking metrics of labelled scores, by group, from the distinct scores of each group.

Rows meet once, in a partial aggregation to (group, score): count and positives. What follows are
prefix sums over distinct scores and, for the one tied score that a top-k% cut falls into, a pick of
its rows by key. Groups may be as large as the table: no task sees a whole group.
Undefined values are null. Ties of scores count half in the area under the ROC, share a precision
step, and are cut by ascending key in top-k% picks.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenrank.operators.ranking import count_truncated, prefix_sums

METRICS = ("auc_roc", "auc_pr", "issr_10", "issr_25", "recall_10", "recall_25", "precision_10", "precision_25", "ndcg_10", "ndcg_25")


def _same(by: Sequence[str], left: str = "", right: str = "_r_") -> Column:
    out = F.lit(True)
    for c in by:
        out = out & F.col(f"{left}{c}").eqNullSafe(F.col(f"{right}{c}"))
    return out


def _discounts(first: Column, last: Column) -> Column:
    """Sum of 1 / log2(i + 1) for i from first to last, 0 if there is none."""
    each = F.aggregate(F.sequence(first, last), F.lit(0.0), lambda s, i: s + 1 / F.log2(i.cast("double") + 1))
    return F.when(last >= first, each).otherwise(0.0)


def ranked_metrics(df: DataFrame, by: Sequence[str], score: str, label: str, key: str, percents: Sequence[int] = (10, 25), spread: bool = True) -> DataFrame:
    """by, n, n_positive and the ten metrics of each group. Rows without score or label do not count.

    ``spread`` False: every group is small, such as a fold or a bootstrap replicate.
    """
    by = list(by)
    rows = df.filter(F.col(score).isNotNull() & F.col(label).isNotNull()).select(*by, F.col(score).cast("double").alias("_s"), F.col(label).cast("long").alias("_y"), F.col(key).alias("_k"))
    agg = rows.groupBy(*by, "_s").agg(F.count("*").alias("_n"), F.sum("_y").alias("_p"))
    cum = prefix_sums(agg, "_s", {"_nb": "_n", "_pb": "_p"}, by=by, descending=True, spread=spread)
    totals = (agg.groupBy(*by) if by else agg.groupBy()).agg(F.sum("_n").alias("_all_n"), F.sum("_p").alias("_all_p")).withColumnsRenamed({c: f"_r_{c}" for c in by})
    cum = cum.join(totals, _same(by)).drop(*[f"_r_{c}" for c in by])
    n, p = F.col("_n"), F.col("_p")
    neg_after = (F.col("_all_n") - F.col("_all_p")) - (F.col("_nb") - F.col("_pb")) - (n - p)
    parts = [F.sum(p * (neg_after + (n - p) / 2.0)).alias("_auc"), F.sum(p * (F.col("_pb") + p) / (F.col("_nb") + n)).alias("_ap"), F.first("_all_n").alias("n"), F.first("_all_p").alias("n_positive")]
    for k in percents:
        take = F.greatest(F.lit(0), F.least(n, count_truncated(F.col("_all_n"), k) - F.col("_nb")))
        whole = take == n
        parts += [F.sum(F.when(whole, p).otherwise(0)).alias(f"_top_{k}"), F.sum(F.when(take > 0, p / n * _discounts(F.col("_nb") + 1, F.col("_nb") + take)).otherwise(0.0)).alias(f"_dcg_{k}")]
    out = cum.groupBy(*by).agg(*parts)
    for k in percents:
        left = count_truncated(F.col("_all_n"), k) - F.col("_nb")
        cut = cum.filter((left > 0) & (left < n)).select(*[F.col(c).alias(f"_r_{c}") for c in by], F.col("_s").alias("_cut"), left.alias("_left"))
        tied = rows.join(cut, _same(by) & (F.col("_s") == F.col("_cut")))
        tied = tied.withColumn("_i", F.row_number().over(Window.partitionBy(*by, "_s").orderBy("_k"))).filter("_i <= _left")
        more = tied.groupBy(*[F.col(c).alias(f"_r_{c}") for c in by]).agg(F.sum("_y").alias(f"_more_{k}"))
        out = out.join(more, _same(by), "left").drop(*[f"_r_{c}" for c in by])
    P, N = F.col("n_positive"), F.col("n")
    columns = [F.when((P > 0) & (N > P), F.col("_auc") / (P * (N - P))).alias("auc_roc"), F.when((P > 0) & (N > P), F.col("_ap") / P).alias("auc_pr")]
    for k in percents:
        size = count_truncated(N, k)
        hits = F.col(f"_top_{k}") + F.coalesce(F.col(f"_more_{k}"), F.lit(0))
        ideal = _discounts(F.lit(1).cast("long"), F.least(size, P))
        columns += [(hits / size).alias(f"issr_{k}"), (hits / size).alias(f"precision_{k}"), (hits / F.greatest(F.lit(1), P)).alias(f"recall_{k}"), F.when(P > 0, F.col(f"_dcg_{k}") / ideal).otherwise(0.0).alias(f"ndcg_{k}")]
    return out.select(*by, "n", "n_positive", *columns)


def subgroup_metrics(df: DataFrame, by: Sequence[str], keys: Sequence[str], score: str, label: str, key: str, least: int = 15) -> DataFrame:
    """Metrics overall and of every value of each subgroup column (null counts as 'missing'), for groups of at least ``least`` rows."""
    every = F.array(F.struct(F.lit("overall").alias("k"), F.lit("all").alias("v")), *[F.struct(F.lit(c).alias("k"), F.coalesce(F.col(c).cast("string"), F.lit("missing")).alias("v")) for c in keys])
    long = df.withColumn("_g", F.explode(every)).withColumns({"subgroup_key": F.col("_g.k"), "subgroup_value": F.col("_g.v")})
    return ranked_metrics(long, [*by, "subgroup_key", "subgroup_value"], score, label, key).filter(F.col("n") >= least)


def tool_metrics(df: DataFrame, tools: Sequence[str], label: str, key: str, strata: Sequence[str] = ()) -> DataFrame:
    """Metrics of each score column, within strata."""
    long = df.unpivot([key, label, *strata], list(tools), "tool", "_score")
    return ranked_metrics(long, ["tool", *strata], "_score", label, key)


def curve_points(df: DataFrame, score: str, label: str) -> DataFrame:
    """threshold, tp, fp, tpr, fpr, precision, recall at every distinct score."""
    agg = df.filter(F.col(score).isNotNull()).groupBy(F.col(score).alias("threshold")).agg(F.count("*").alias("_n"), F.sum(F.col(label).cast("long")).alias("_p"))
    cum = prefix_sums(agg, "threshold", {"_nb": "_n", "_pb": "_p"}, descending=True)
    t = agg.agg(F.sum("_n").alias("_all_n"), F.sum("_p").alias("_all_p"))
    tp, n = F.col("_pb") + F.col("_p"), F.col("_nb") + F.col("_n")
    return cum.crossJoin(F.broadcast(t)).select("threshold", tp.alias("tp"), (n - tp).alias("fp"), (tp / F.col("_all_p")).alias("tpr"), ((n - tp) / (F.col("_all_n") - F.col("_all_p"))).alias("fpr"), (tp / n).alias("precision"), (tp / F.col("_all_p")).alias("recall"))


def histogram(df: DataFrame, value: str, bins: int) -> DataFrame:
    """bin (0 to bins-1) and count between the smallest and largest value; the last bin holds the largest."""
    ends = df.agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"))
    at = F.when(F.col("_hi") > F.col("_lo"), F.least(F.lit(bins - 1), F.floor((F.col(value) - F.col("_lo")) * bins / (F.col("_hi") - F.col("_lo"))))).otherwise(0)
    return df.filter(F.col(value).isNotNull()).crossJoin(F.broadcast(ends)).groupBy(at.cast("int").alias("bin")).agg(F.count("*").alias("n"))


def brier(df: DataFrame, p: str, label: str) -> DataFrame:
    """brier, brier_trivial (always the base rate) and brier_skill."""
    m = df.agg(F.avg((F.col(p) - F.col(label)) ** 2).alias("brier"), F.avg(F.col(label).cast("double")).alias("_m"))
    trivial = F.col("_m") * (1 - F.col("_m"))
    return m.select("brier", trivial.alias("brier_trivial"), F.when(trivial > 0, 1 - F.col("brier") / trivial).alias("brier_skill"))


def reliability(df: DataFrame, p: str, label: str, bins: int = 10) -> DataFrame:
    """bin, mean prediction, observed share and count of equal-width bins that have rows; inner edges belong to the bin below."""
    at = F.greatest(F.lit(0), F.ceil(F.col(p) * bins) - 1).cast("int")
    return df.groupBy(at.alias("bin")).agg(F.avg(p).alias("mean_predicted"), F.avg(F.col(label).cast("double")).alias("observed"), F.count("*").alias("n"))


def spearman(df: DataFrame, pairs: Sequence[tuple[str, str]], least: int = 5, p_values: bool = False) -> DataFrame:
    """a, b, rho, n of each pair of columns, over rows with both: Pearson correlation of average ranks.

    Columns without nulls are ranked once each and correlated in one aggregation; pairs with nulls are
    ranked over their complete rows. ``p_values`` adds the two-sided p of Student's t with n - 2 degrees.
    """
    from lumenrank.operators.ranking import rank_ties

    columns = sorted({c for pair in pairs for c in pair})
    d = df.select(*[F.col(c).cast("double").alias(c) for c in columns])
    gaps = d.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in columns]).first()

    def correlated(rows: DataFrame, some: Sequence[tuple[str, str]]) -> DataFrame:
        names = sorted({c for pair in some for c in pair})
        for c in names:
            rows = rank_ties(rows.select(*[k for k in rows.columns if k not in ("rank_min", "rank_average", "rank_average_floor")]), c, descending=False).withColumn(c, F.col("rank_average"))
        out = rows.agg(F.count("*").alias("n"), F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.corr(a, b).alias("rho")) for a, b in some]).alias("r"))
        return out.select("n", F.inline("r")).select("a", "b", F.when(F.col("n") >= least, F.col("rho")).alias("rho"), "n")

    whole = [p for p in pairs if not gaps[p[0]] and not gaps[p[1]]]
    parts = ([correlated(d, whole)] if whole else []) + [correlated(d.select(*dict.fromkeys(p)).dropna(), [p]) for p in pairs if p not in whole]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    p = F.udf(lambda rho, n: None if rho is None else student_p(rho, n), "double")  # a row for each pair of columns
    return out.withColumn("p_value", p("rho", "n")) if p_values else out


def student_p(rho: float, n: int) -> float:
    """Two-sided p of a correlation of n pairs: the regularised incomplete beta function of 1 - rho**2."""
    if n < 3:
        return math.nan
    x, a, b = 1 - min(1.0, rho * rho), (n - 2) / 2, 0.5
    if x <= 0:
        return 0.0
    flip = x > (a + 1) / (a + b + 2)
    if flip:
        x, a, b = 1 - x, b, a
    if x <= 0:
        return 1.0
    # Lentz's continued fraction
    tiny, c, d = 1e-300, 1.0, 1 - (a + b) * x / (a + 1)
    d = 1 / (d if abs(d) > tiny else tiny)
    h = d
    for m in range(1, 500):
        for k in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d, c = 1 + k * d, 1 + k / c
            d, c = 1 / (d if abs(d) > tiny else tiny), (c if abs(c) > tiny else tiny)
            h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    value = front * h / a
    return 1 - value if flip else value


def threshold_candidates(df: DataFrame, score: str, label: str, group: str, least: int = 15) -> DataFrame:
    """For the 91 quantiles from 5 to 95 %: precision, recall, F1 over all and the smallest F1 of the groups."""
    grid = [round(0.05 + 0.01 * i, 2) for i in range(91)]
    rows = df.filter(F.col(score).isNotNull() & F.col(label).isNotNull()).select(F.col(score).cast("double").alias("s"), F.col(label).cast("long").alias("y"), F.col(group).alias("g"))
    cuts = rows.agg(F.percentile("s", F.array(*map(F.lit, grid))).alias("q")).select(F.explode(F.array_distinct("q")).alias("threshold"))
    # distinct (group, score) first: each meets 91 thresholds
    agg = rows.groupBy("g", "s").agg(F.count("*").alias("n"), F.sum("y").alias("p"))
    hit = F.col("s") >= F.col("threshold")
    per = agg.crossJoin(F.broadcast(cuts)).groupBy("threshold", "g").agg(F.sum(F.when(hit, F.col("p")).otherwise(0)).alias("tp"), F.sum(F.when(hit, F.col("n") - F.col("p")).otherwise(0)).alias("fp"), F.sum("p").alias("pos"), F.sum("n").alias("n"))

    def f1(tp: Column, fp: Column, pos: Column) -> tuple[Column, Column, Column]:
        precision = F.when(tp + fp > 0, tp / (tp + fp)).otherwise(0.0)
        recall = F.when(pos > 0, tp / pos).otherwise(0.0)
        return precision, recall, F.when(precision + recall > 0, 2 * precision * recall / (precision + recall)).otherwise(0.0)

    per = per.withColumn("gf", F.when(F.col("n") >= least, f1(F.col("tp"), F.col("fp"), F.col("pos"))[2]))
    total = per.groupBy("threshold").agg(F.sum("tp").alias("tp"), F.sum("fp").alias("fp"), F.sum("pos").alias("pos"), F.min("gf").alias("least_f1"))
    precision, recall, score_f1 = f1(F.col("tp"), F.col("fp"), F.col("pos"))
    return total.select("threshold", precision.alias("overall_precision"), recall.alias("overall_recall"), score_f1.alias("overall_f1"), F.coalesce("least_f1", score_f1).alias("min_subgroup_f1"))


def pick_threshold(candidates: DataFrame) -> DataFrame:
    """The best candidate: smallest group F1, then F1, then recall, compared at 8 decimals; of equal ones the lowest threshold.

    Comparing rounded values is a total order, unlike a chain of near-equality tests, so it needs no replay on the driver.
    """
    order = F.struct(F.round("min_subgroup_f1", 8), F.round("overall_f1", 8), F.round("overall_recall", 8), -F.col("threshold"))
    return candidates.agg(F.max_by(F.struct(*candidates.columns), order).alias("b")).select("b.*")
