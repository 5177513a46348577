"""Joins, set operations and picks of rows, each with an explicit order where order matters."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def left_with_defaults(left: DataFrame, right: DataFrame, on: Sequence[str], defaults: dict[str, float]) -> DataFrame:
    """Left join whose missing cells get a default."""
    out = left.join(right, list(on), "left")
    return out.withColumns({c: F.coalesce(F.col(c), F.lit(v)) for c, v in defaults.items()})


def left_suffixed(left: DataFrame, right: DataFrame, on: Sequence[str], suffix: str = "_dup") -> DataFrame:
    """Left join; columns that both sides have keep their name on the left and get a suffix on the right."""
    clash = {c: f"{c}{suffix}" for c in right.columns if c in left.columns and c not in on}
    return left.join(right.withColumnsRenamed(clash), list(on), "left")


def holdout_split(df: DataFrame, held: DataFrame, on: str) -> tuple[DataFrame, DataFrame]:
    """(rows not in ``held``, rows in it)."""
    keys = held.select(on).distinct()
    return df.join(keys, on, "left_anti"), df.join(keys, on, "left_semi")


def contained_in_any(df: DataFrame, text: str, others: DataFrame, other: str, *, key: str | None = None, most_bytes: int = 64 << 20) -> DataFrame:
    """Rows whose text contains, or is contained in, a text of ``others``.

    Up to ``most_bytes`` of other texts, which are measured, it is a nested loop that stops at the first
    match. Beyond that both directions go through ``seeded_containment``, by ``key`` (or the text itself),
    and nothing is broadcast.
    """
    o = others.select(F.col(other).alias("_o")).distinct()
    if (o.agg(F.sum(F.octet_length("_o"))).first()[0] or 0) <= most_bytes:
        return df.join(o, F.col(text).contains(F.col("_o")) | F.col("_o").contains(F.col(text)), "left_semi")
    named = o.withColumn("_i", F.col("_o"))
    texts = df.select(F.col(key or text).alias("_k"), F.col(text).alias("_t")).distinct()
    inside = seeded_containment(texts, "_k", "_t", named, "_i", "_o").select("_k")
    around = seeded_containment(named, "_i", "_o", texts, "_k", "_t").select("_k")
    return df.join(inside.union(around).distinct(), F.col(key or text) == F.col("_k"), "left_semi")


def seeded_containment(df: DataFrame, key: str, text: str, needles: DataFrame, needle_key: str, needle: str, seed: int = 16) -> DataFrame:
    """(key, needle_key) pairs where the text contains the needle, by a hash join on the needle's first ``seed`` characters.

    Windows travel without the text; the text meets its candidates again to verify them. For many needles.
    """
    n = needles.select(F.col(needle_key), F.col(needle).alias("_needle"), F.substring(needle, 1, seed).alias("_seed"))
    long_n, short_n = n.filter(F.length("_needle") >= seed), n.filter(F.length("_needle") < seed)
    at = df.filter(F.length(text) >= seed).select(key, F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(text) - seed + 1), lambda i: F.substring(F.col(text), i, seed)))).alias("_seed"))
    candidates = at.join(long_n, "_seed").select(key, needle_key, "_needle")
    found = candidates.join(df.select(key, text), key).filter(F.col(text).contains(F.col("_needle"))).select(key, needle_key)
    few = df.select(key, text).join(short_n, F.col(text).contains(F.col("_needle"))).select(key, needle_key)
    return found.union(few).distinct()


def first_parent(needles: DataFrame, key: str, needle: str, parents: DataFrame, parent: str, text: str, order: Column) -> DataFrame:
    """Every needle with the first parent, by ``order``, whose text contains it; null where none does."""
    hit = needles.select(key, needle).join(parents.select(F.col(parent).alias("_p"), F.col(text).alias("_t"), order.alias("_o")), F.col("_t").contains(F.col(needle)))
    return needles.join(hit.groupBy(key).agg(F.min_by("_p", "_o").alias(parent)), key, "left")


def synthetic_context(peptide: Column, width: int = 31, filler: str = "G") -> Column:
    """A peptide in the middle of filler residues."""
    left = F.floor((F.lit(width) - F.length(peptide)) / 2).cast("int")
    padded = F.concat(F.repeat(F.lit(filler), left), peptide)
    return F.rpad(padded, width, filler)


def cross_pairs(df: DataFrame, dimension: DataFrame) -> DataFrame:
    """Every row with every row of a small dimension."""
    return df.crossJoin(dimension)


def baseline_delta(df: DataFrame, group: Sequence[str], is_base: Column, values: Sequence[str]) -> DataFrame:
    """Differences to the group's base row, in one pass."""
    w = Window.partitionBy(*group)
    return df.withColumns({f"delta_{v}": F.col(v) - F.max(F.when(is_base, F.col(v))).over(w) for v in values})


def best_per_key(df: DataFrame, key: Sequence[str], *order: Column) -> DataFrame:
    """The first row of each key by ``order``."""
    w = Window.partitionBy(*key).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")


def top_per_group(df: DataFrame, group: Sequence[str], n: int, *order: Column) -> DataFrame:
    """The first n rows of each group with their rank; the limit is pushed below the shuffle."""
    w = Window.partitionBy(*group).orderBy(*order)
    return df.withColumn("rank_in_group", F.row_number().over(w)).filter(F.col("rank_in_group") <= n)


def top_or_forced(df: DataFrame, group: Sequence[str], n: int, forced: DataFrame, on: str, *order: Column) -> DataFrame:
    """The first n of each group and every forced row, flagged, each once."""
    keys = forced.select(on).distinct().withColumn("_forced", F.lit(True))
    w = Window.partitionBy(*group).orderBy(*order)
    out = df.join(keys, on, "left").withColumn("_rn", F.row_number().over(w)).withColumn("is_forced", F.coalesce("_forced", F.lit(False)))
    return out.filter((F.col("_rn") <= n) | F.col("is_forced")).drop("_rn", "_forced")


def nth_value(df: DataFrame, group: Sequence[str], n: int, value: str, *order: Column) -> DataFrame:
    """The n-th value of each group, null if it is shorter."""
    w = Window.partitionBy(*group).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).groupBy(*group).agg(F.max(F.when(F.col("_rn") == n, F.col(value))).alias("cutoff"))


def union_first(frames: Sequence[DataFrame], key: Sequence[str], tag: str = "source_order") -> DataFrame:
    """Union of frames; of equal keys the row of the earliest frame stays."""
    out = None
    for i, f in enumerate(frames):
        f = f.withColumn(tag, F.lit(i))
        out = f if out is None else out.unionByName(f, allowMissingColumns=True)
    return best_per_key(out, key, F.col(tag).asc())


def batches(df: DataFrame, n: int, *order: Column, group: Sequence[str] = ()) -> DataFrame:
    """Rows in order, cut into batches of n, within groups or over all rows."""
    from lumenrank.operators.ranking import global_row_number

    if group:
        return df.withColumn("batch", F.floor((F.row_number().over(Window.partitionBy(*group).orderBy(*order)) - 1) / n).cast("int"))
    return global_row_number(df, "_rn", *order).withColumn("batch", F.floor((F.col("_rn") - 1) / n).cast("int")).drop("_rn")


def hash_sample(df: DataFrame, n: int, key: str, seed: int = 42) -> DataFrame:
    """n rows in the order of a hash of their key: the same ones each time."""
    from lumenrank.functions.scalar import hash_unit

    return df.orderBy(hash_unit(F.lit(seed), F.col(key)), key).limit(n)
