"""Ranks and prefix sums over all rows without sending them to one task.

A row's range bucket comes from cut points in the order itself, (value, tie), chosen from a hashed
sample of some thousand distinct pairs; so one value that many rows have is cut by its ties. Bucket
totals are added up in order, and a window inside each bucket does the rest. Which bucket a row is in
depends on its value and tie alone, so recomputed tasks agree, and the result is exact whatever the
cuts. The number of buckets follows the number of rows, up to ``MOST_BUCKETS``.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUCKET_ROWS, MOST_BUCKETS, SAMPLED = 2048, 256, 16


def _order_key(df: DataFrame, value: str, descending: bool, tie: str | None) -> Column:
    """A struct whose ascending order is that of the rows: nulls first, or last and values negated where it descends."""
    v = F.col(value)
    nan = F.isnan(v) if df.schema[value].dataType.typeName() in ("double", "float") else F.lit(False)
    parts = [v.isNull(), ~nan, -v] if descending else [v.isNotNull(), nan, v]
    parts += [F.col(tie).isNotNull(), F.col(tie)] if tie else []
    return F.struct(*[p.alias(f"k{i}") for i, p in enumerate(parts)])


def _bucketed(df: DataFrame, value: str, descending: bool, tie: str | None = None) -> DataFrame:
    n = df.count()
    buckets = max(1, min(MOST_BUCKETS, n // BUCKET_ROWS))
    if buckets == 1:
        return df.withColumn("_bucket", F.lit(0))
    key, names = _order_key(df, value, descending, tie), [value, *([tie] if tie else [])]
    every = max(1, n // (SAMPLED * buckets))
    some = df.select(*names).filter(F.pmod(F.xxhash64(*names), F.lit(every)) == 0).distinct()
    rows = [r[0] for r in some.select(key.alias("k")).orderBy("k").limit(4 * SAMPLED * MOST_BUCKETS).collect()]
    kind = some.select(key.alias("k")).schema["k"].dataType
    picked = sorted({len(rows) * i // buckets for i in range(1, buckets)}) if rows else []
    if not picked:
        return df.withColumn("_bucket", F.lit(0))
    cuts = F.array(*[F.struct(*[F.lit(v).cast(f.dataType).alias(f.name) for v, f in zip(rows[i], kind.fields)]) for i in picked])
    steps = F.array(*[F.lit(1 << k) for k in range(len(picked).bit_length() - 1, -1, -1)])
    # a binary search: as many cuts as are below the key
    below = F.aggregate(steps, F.lit(0), lambda at, step: F.when((at + step <= len(picked)) & (F.get(cuts, at + step - 1) < key), at + step).otherwise(at))
    return df.withColumn("_bucket", below)


def prefix_sums(df: DataFrame, value: str, sums: Mapping[str, str], *, by: Sequence[str] = (), descending: bool = False, ties: Sequence[Column] = (), tie: str | None = None, spread: bool = True) -> DataFrame:
    """Add, per output name, the sum of a column over the rows before each row, by ``value`` and ``ties``, within ``by``.

    ``tie``: a column that orders equal values (ascending); buckets then cut through them.
    ``spread`` False is for groups that are known to be small: one window each.
    """
    ties = [F.col(tie).asc(), *ties] if tie else ties
    if not spread and by:
        line = Window.partitionBy(*by).orderBy(F.col(value).desc() if descending else F.col(value).asc(), *ties).rowsBetween(Window.unboundedPreceding, -1)
        return df.select("*", *[F.coalesce(F.sum(c).over(line), F.lit(0)).alias(o) for o, c in sums.items()])
    b = _bucketed(df, value, descending, tie)
    order = [F.col(value).desc() if descending else F.col(value).asc(), *ties]
    inside = Window.partitionBy(*by, "_bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    line = Window.partitionBy(*by).orderBy("_bucket") if by else Window.orderBy("_bucket")  # at most MOST_BUCKETS rows a group
    totals = b.groupBy(*by, "_bucket").agg(*[F.sum(c).alias(f"_t_{o}") for o, c in sums.items()])
    before = line.rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(*by, "_bucket", *[F.coalesce(F.sum(f"_t_{o}").over(before), F.lit(0)).alias(f"_b_{o}") for o in sums])
    totals = totals.withColumnsRenamed({c: f"_k_{c}" for c in [*by, "_bucket"]})
    same = F.col("_bucket") == F.col("_k__bucket")
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"_k_{c}"))
    out = b.join(totals, same)
    return out.select(*df.columns, *[(F.col(f"_b_{o}") + F.coalesce(F.sum(c).over(inside), F.lit(0))).alias(o) for o, c in sums.items()])


def global_row_number(df: DataFrame, name: str, *order: Column) -> DataFrame:
    """1, 2, ... by any order, in one task; for a numeric first key over many rows use ``rank_contiguous``."""
    return df.withColumn(name, F.row_number().over(Window.orderBy(*order)))


def rank_contiguous(df: DataFrame, score: str, tie: str, name: str = "rank") -> DataFrame:
    """1 to n by (score descending, tie ascending)."""
    one = df.withColumn("_one", F.lit(1))
    return prefix_sums(one, score, {name: "_one"}, descending=True, tie=tie).drop("_one").withColumn(name, (F.col(name) + 1).cast("long"))


def rank_ties(df: DataFrame, score: str, *, descending: bool = True) -> DataFrame:
    """rank_min, rank_average and rank_average_floor of each row, from the distinct scores and their counts."""
    counts = df.groupBy(score).agg(F.count("*").alias("_n"))
    r = prefix_sums(counts, score, {"_before": "_n"}, descending=descending)
    r = r.select(F.col(score).alias("_s"), (F.col("_before") + 1).cast("long").alias("rank_min"), (F.col("_before") + 1 + (F.col("_n") - 1) / 2.0).alias("rank_average"))
    r = r.withColumn("rank_average_floor", F.floor("rank_average").cast("long"))
    return df.join(r, F.col(score) == F.col("_s")).drop("_s")


def rank_percent(df: DataFrame, rank: str, n: int, name: str = "rank_pct") -> DataFrame:
    """rank * 100 / n."""
    return df.withColumn(name, F.col(rank) * 100.0 / n)


def count_truncated(n: Column, percent: float) -> Column:
    """Top-k% size: truncated, at least 1."""
    return F.greatest(F.lit(1), F.floor(n * percent / 100.0))


def recovery(ranked: DataFrame, gold: DataFrame, on: str, *, rank: str = "rank") -> DataFrame:
    """One row: how many of ``gold`` are ranked, in the top 10 and 25 % (rank <= n * share), their mean and median rank %."""
    n = ranked.agg(F.count("*").alias("n"))
    hits = ranked.join(gold.select(on).distinct(), on, "left_semi").select(F.col(rank).alias("r")).crossJoin(F.broadcast(n))
    wanted = gold.select(on).distinct().agg(F.count("*").alias("gs_total"))
    pct = F.col("r") * 100.0 / F.col("n")
    got = hits.agg(F.count("*").alias("gs_found"), F.count_if(F.col("r") <= F.col("n") * 0.10).alias("gs_in_top_10pct"), F.count_if(F.col("r") <= F.col("n") * 0.25).alias("gs_in_top_25pct"), F.avg(pct).alias("mean_rank_pct"), F.median(pct).alias("median_rank_pct"))
    both = got.crossJoin(F.broadcast(wanted))
    share = lambda c: F.when(F.col("gs_total") > 0, F.col(c) / F.col("gs_total"))
    return both.select("gs_total", "gs_found", "gs_in_top_10pct", "gs_in_top_25pct", share("gs_in_top_10pct").alias("gs_recovery_top10"), share("gs_in_top_25pct").alias("gs_recovery_top25"), "mean_rank_pct", "median_rank_pct")


def push_down(df: DataFrame, key: str, model: str, binding: str, is_negative: Column, scope: str = "population") -> DataFrame:
    """Average ranks of the negatives under two scores, ranked in the whole population or among themselves."""
    base = df.withColumn("_neg", is_negative)
    if scope == "subset":
        base = base.filter("_neg")
    a = rank_ties(base.select(key, model, binding, "_neg"), model).select(key, binding, "_neg", F.col("rank_average").alias("model_rank"))
    b = rank_ties(a, binding).select(key, "_neg", "model_rank", F.col("rank_average").alias("binding_rank"))
    return b.filter("_neg").select(key, "model_rank", "binding_rank", (F.col("model_rank") > F.col("binding_rank")).alias("pushed_down"))
