"""Column builders over residue sequences. All stay in generated JVM code; none is a Python UDF."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenrank.functions import constants as K


def lookup(values: Mapping) -> Column:
    """A literal map."""
    return F.create_map(*[F.lit(x) for kv in values.items() for x in kv])


def kmers(df: DataFrame, seq: str = "seq", lengths: Iterable[int] = K.LENGTHS) -> DataFrame:
    """Every window of each length: peptide, length, start (from 1), end (inclusive), other columns kept."""
    wide = df.withColumn("length", F.explode(F.array(*map(F.lit, lengths)))).filter(F.length(seq) >= F.col("length"))
    wide = wide.withColumn("start", F.explode(F.sequence(F.lit(1), F.length(seq) - F.col("length") + 1)))
    return wide.withColumn("peptide", F.substring(seq, F.col("start"), F.col("length"))).withColumn("end", F.col("start") + F.col("length") - 1)


def standard(seq: Column) -> Column:
    """Only standard residues; an empty sequence passes."""
    return ~seq.rlike(f"[^{K.RESIDUES}]")


def valid_peptide(seq: Column, least: int = 8, most: int = 11) -> Column:
    s = F.upper(F.trim(seq))
    return F.coalesce(F.length(s).between(least, most) & standard(s), F.lit(False))


def class_one(allele: Column) -> Column:
    """Not a class II allele; null is not class I."""
    return F.coalesce(~F.concat_ws("", F.lit(""), allele).rlike("^(" + "|".join(K.CLASS_TWO_PREFIXES) + ")") & allele.isNotNull(), F.lit(False))


def contact_index(position: str, length: Column) -> Column:
    """Index from 0 of a contact position, null where the sequence has none: p4 to p6 count from the front, p7 and p8 from the back."""
    if position in ("p4", "p5", "p6"):
        k = int(position[1]) - 1
        return F.when(length > k, F.lit(k))
    back = 3 if position == "p7" else 2
    return F.when(length - 3 > 5, length - back)


def property_columns(seq: str = "peptide", binding: Column | None = None, scales: Iterable[str] = tuple(K.SCALES)) -> list[Column]:
    """Property columns of all contact positions, exposure, length and binding score, 0 where a position is missing."""
    s, n = F.col(seq), F.length(seq)
    out = []
    for scale in scales:
        table = lookup({k: float(v) for k, v in K.SCALES[scale].items()})
        for p in K.POSITIONS:
            residue = F.substring(s, contact_index(p, n) + 1, 1)
            out.append(F.coalesce(table[residue], F.lit(0.0)).alias(f"{p}_{scale}"))
    for p in K.POSITIONS:
        by_length = lookup({k: v[p] for k, v in K.UPWARD.items()})
        out.append(F.coalesce(by_length[n], F.lit(K.UPWARD[9][p])).alias(f"{p}_upward_prob"))
    score = F.lit(0.0) if binding is None else F.coalesce(F.nanvl(binding.cast("double"), F.lit(None)), F.lit(0.0))
    return [*out, score.alias("binding_score"), n.alias("peptide_length")]


def features(df: DataFrame, seq: str = "peptide", binding: str | None = "presentation_score") -> DataFrame:
    """All property columns next to the columns of ``df``; a missing binding column counts as 0."""
    score = F.col(binding) if binding and binding in df.columns else None
    return df.select("*", *property_columns(seq, score))


def one_hot(seq: Column, width: int = 11) -> Column:
    """[width][20] indicators of the residues, zero beyond the sequence."""
    return F.transform(F.sequence(F.lit(1), F.lit(width)), lambda i: F.transform(F.array(*map(F.lit, K.RESIDUES)), lambda r: (F.substring(seq, i, 1) == r).cast("int")))


def chain_edges(df: DataFrame, key: str, seq: str = "peptide") -> DataFrame:
    """Both directions of the backbone chain: key, src, dst (from 0)."""
    n = F.length(seq)
    e = df.filter(n > 1).select(key, F.explode(F.sequence(F.lit(0), n - 2)).alias("i"))
    return e.select(key, F.col("i").alias("src"), (F.col("i") + 1).alias("dst")).union(e.select(key, (F.col("i") + 1).alias("src"), F.col("i").alias("dst")))


def pocket_features(alleles: DataFrame, pseudo: str = "pseudo_sequence") -> DataFrame:
    """allele and four properties of each of 34 pocket residues; a dimension of a few rows."""
    out = []
    for i in range(1, 35):
        r = F.substring(pseudo, i, 1)
        for s in ("hydrophobicity", "aromaticity", "vdw_volume", "charge"):
            out.append(F.coalesce(lookup({k: float(v) for k, v in K.SCALES[s].items()})[r], F.lit(0.0)).alias(f"hla_p{i}_{s}"))
    return alleles.select("allele", *out)


def model_columns(width: int) -> tuple[str, ...]:
    """The input columns of a model by its width."""
    if width not in K.FEATURE_SETS:
        raise ValueError(f"no feature set has {width} columns")
    return K.FEATURE_SETS[width]
