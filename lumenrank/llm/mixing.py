"""Mixing sources to target weights.

Each document gets a hash-random key. Keys are uniform, so equal ranges of key space are the range
partitions of a sort; a distributed prefix sum (totals per range, then a running sum inside each
range) places every document on its source's line of words, and the source's exact budget cuts it.

Defined results: null or empty texts have size 0 and take nothing; a null source is a source of its
own, last in order; ties of keys (the same id and text repeated) are cut in any order, which gives
the same rows; an empty table gives an empty result; other columns pass through when carried, whatever
their names, but for those of the added columns, which are replaced. The mix itself keeps every column
of the documents.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenrank.llm.common import WORD, materialise, power_of_two, word_count


def source_targets(sizes: DataFrame, weights: Sequence[int] = (5, 2, 1), share_percent: int = 150, max_repeat: int = 2) -> DataFrame:
    """(source, source_size) to (source, source_size, target).

    Weights go round over the sources by code point, null last. Targets share ``share_percent`` of all
    sizes by weight; one above ``max_repeat`` times its source stops there and the excess is shared
    again. That is one water level: in order of limit per weight, the first source below its limit
    fixes it. The table has a row per source, so its windows are small.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    everything = Window.partitionBy(F.lit(1))
    place = (F.row_number().over(by_name) - 1) % len(weights)
    s = sizes.select("source", "source_size", F.element_at(F.array(*map(F.lit, weights)), place + 1).cast("double").alias("w"))
    s = s.withColumn("limit", (F.col("source_size") * max_repeat).cast("double"))
    s = s.withColumn("budget", F.sum("source_size").over(everything) * F.lit(share_percent) / F.lit(100.0)).withColumn("all_w", F.sum("w").over(everything))
    by_limit = Window.orderBy((F.col("limit") / F.col("w")).asc(), F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    before = lambda c: F.coalesce(F.sum(c).over(by_limit), F.lit(0.0))
    s = s.withColumn("level", (F.col("budget") - before("limit")) / (F.col("all_w") - before("w")))
    fixed = F.when(F.col("level") * F.col("w") <= F.col("limit"), F.struct(F.col("limit") / F.col("w"), F.col("level")))
    s = s.withColumn("level", F.min(fixed).over(everything)["level"])
    return s.select("source", "source_size", F.least("limit", F.col("level") * F.col("w")).alias("target"))


def mix_sources(docs: DataFrame, *, weights: Sequence[int] = (5, 2, 1), share_percent: int = 150, max_repeat: int = 2, carry: Sequence[str] = (), rows_per_range: int = 20_000) -> DataFrame:
    """doc_id, source, key, size, source_size, target, taken (and ``carry``) of each row of ``docs``."""
    key = F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit("|"), F.coalesce(F.col("text"), F.lit(""))).cast("binary"))
    carry = [c for c in carry if c not in ("doc_id", "source", "key", "size", "source_size", "target", "taken")]
    held = [F.struct(*[F.col(f"`{c}`") for c in carry]).alias("_carried")] if carry else []
    sized = docs.select("doc_id", "source", *held, word_count(F.col("text")).alias("size"), key.alias("key"))
    narrow = materialise(sized.select("doc_id", "source", "size", "key"), "mix-sizes")
    bits = power_of_two(narrow.count(), rows_per_range)

    def ranged(df: DataFrame) -> DataFrame:
        at: Column = F.shiftrightunsigned(F.conv(F.substring("key", 1, 8), 16, 10).cast("long"), 32 - bits)
        return df.withColumn("_range", at.cast("int"))

    ranges = ranged(narrow).groupBy("source", "_range").agg(F.sum("size").alias("words"))
    line = Window.partitionBy("source").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.withColumn("_before", F.coalesce(F.sum("words").over(line), F.lit(0)))
    targets = source_targets(ranges.groupBy("source").agg(F.sum("words").alias("source_size")), weights, share_percent, max_repeat)
    t = targets.withColumnRenamed("source", "_s")
    ranges = ranges.join(t, F.col("source").eqNullSafe(F.col("_s"))).select(F.col("source").alias("_s"), F.col("_range").alias("_r"), "_before", "source_size", "target")
    rows = ranged(sized if carry else narrow)
    rows = rows.join(ranges, F.col("source").eqNullSafe(F.col("_s")) & (F.col("_range") == F.col("_r")))
    inside = Window.partitionBy("source", "_range").orderBy("key", "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    start = F.col("_before") + F.coalesce(F.sum("size").over(inside), F.lit(0))
    budget, whole = F.floor("target"), F.floor(F.floor("target") / F.greatest(F.col("source_size"), F.lit(1)))
    rest = budget - whole * F.col("source_size")
    taken = whole * F.col("size") + F.least(F.col("size"), F.greatest(F.lit(0), rest - start))
    return rows.select("doc_id", "source", *[F.col(f"_carried.`{c}`") for c in carry], "key", "size", "source_size", "target", taken.cast("long").alias("taken"))


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: each document as often as it is taken, in the columns of ``docs``.

    The one document of a source that its budget cuts gives a last copy with its first words only.
    """
    whole = docs.select("doc_id", "source", "text", F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    m = mix_sources(whole, carry=["row"], **options).filter("taken > 0").select("row", "size", "taken")
    copies = F.ceil(F.col("taken") / F.greatest(F.col("size"), F.lit(1)))
    m = m.withColumn("copy", F.explode(F.sequence(F.lit(1), copies.cast("int"))))
    m = m.withColumn("words", F.least(F.col("size"), F.col("taken") - (F.col("copy") - 1) * F.col("size")))
    cut = F.col("words") < F.col("size")
    first_words = F.expr(f"array_join(slice(regexp_extract_all(row.text, r'{WORD}', 0), 1, cast(words as int)), ' ')")
    m = m.select("row", cut.alias("cut"), F.when(cut, first_words).otherwise(F.col("row.text")).alias("text"))
    out = {c: F.col(f"row.`{c}`") for c in docs.columns} | {"text": F.col("text")}
    if "n_chars" in out:
        out["n_chars"] = F.when(F.col("cut"), F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(out["n_chars"])
    return m.select(*[v.alias(c) for c, v in out.items()])
