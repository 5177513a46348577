"""Names, alleles, text rules and numeric helpers as Column expressions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from lumenrank.functions import constants as K
from lumenrank.functions.sequence import lookup


@cache
def _capitals() -> tuple[str, str]:
    """The letters that have a single capital, and those capitals."""
    one = lambda c: next((u for u in (c.upper(), "\u1e9e" if c == "ß" else c.title(), c) if len(u) == 1))
    pairs = [(c, u) for c in map(chr, range(1, 0x110000)) if not "\ud800" <= c <= "\udfff" and (u := one(c)) != c]
    return "".join(c for c, _ in pairs), "".join(u for _, u in pairs)


def simple_upper(text: Column) -> Column:
    """Upper case letter by letter, as other SQL engines have it; ``upper`` makes SS of ß and FI of ﬁ.

    Texts of letters that both treat alike go through ``upper``, which is faster.
    """
    return F.when(text.rlike("[^\\x00-\\u017F]|[ßŉ]"), F.translate(text, *_capitals())).otherwise(F.upper(text))


def sanitise(name: Column) -> Column:
    return F.regexp_replace(name, "[^a-zA-Z0-9_-]", "_")


def allele_column(allele: Column) -> Column:
    """HLA-A*02:01 to bind_A0201."""
    return F.concat(F.lit("bind_"), F.regexp_replace(F.replace(allele, F.lit("HLA-"), F.lit("")), "[^A-Za-z0-9]", ""))


def allele_of_column(column: Column) -> Column:
    """bind_A0201 to HLA-A*02:01."""
    return F.regexp_replace(column, "^bind_([A-Z])([0-9]{2})([0-9]{2})$", "HLA-$1*$2:$3")


def standard_allele(allele: Column) -> Column:
    """Add the prefix, the star and the colon where they are missing."""
    s = F.trim(allele)
    s = F.when(s.startswith("HLA-"), s).otherwise(F.concat(F.lit("HLA-"), s))
    s = F.when(s.contains("*"), s).otherwise(F.regexp_replace(s, "^(HLA-[ABC])", "$1*"))
    return F.when(s.contains(":"), s).otherwise(F.regexp_replace(s, r"^([^*]*\*)(.{2})(.{2})$", "$1$2:$3"))


def compact_allele(allele: Column) -> Column:
    """HLA-A*02:01 to A0201."""
    return F.regexp_replace(allele, r"HLA-|[*:]", "")


def first_match(text: Column, rules: Sequence[tuple[str, str | None]], default: Column | None = None) -> Column:
    """The meaning of the first pattern, in order, that the lower-cased text contains."""
    low, out = F.lower(text), None
    for pattern, meaning in rules:
        out = F.when(low.contains(pattern), F.lit(meaning)) if out is None else out.when(low.contains(pattern), F.lit(meaning))
    return out.otherwise(F.lit(None).cast("string") if default is None else default)


def gene(name: Column, virus: Column) -> Column:
    """Gene symbol of a free-text antigen name; unknown names stay as they are."""
    nuclear = first_match(name, [(s, "EBNA" + s.upper()) for s in K.NUCLEAR_SUFFIXES], F.lit("EBNA"))
    low = F.lower(F.trim(name))
    ebv = None
    for pattern, meaning in K.EBV_GENES:
        value = nuclear if meaning is None else F.lit(meaning)
        ebv = F.when(low.contains(pattern), value) if ebv is None else ebv.when(low.contains(pattern), value)
    hpv = first_match(name, [(g.lower(), g) for g in K.HPV_GENES], F.trim(name))
    return F.when(virus.isin("HPV16", "HPV11"), hpv).when(virus == "EBV", ebv.otherwise(F.trim(name))).otherwise(F.trim(name))


def strain(organism: Column, virus: Column) -> Column:
    return F.when(virus == "EBV", first_match(organism, K.EBV_STRAINS)).when(virus.isin("HPV16", "HPV11"), first_match(organism, K.HPV_STRAINS))


def virus(organism: Column, hpv11: bool = True) -> Column:
    """Panel name of an organism's name; null for others, and for HPV11 where it is left out."""
    name = F.lower(organism)
    return first_match(name, [(k, v) for k, v in K.ORGANISM_VIRUSES if hpv11 or v != "HPV11"])


def file_label(file: Column) -> Column:
    return first_match(file, [("positive", "1"), ("negative", "0")]).cast("int")


def file_virus(file: Column) -> Column:
    return first_match(file, K.FILE_VIRUSES)


def assay_label(text: Column) -> Column:
    """positive... is 1, negative is 0, anything else is null."""
    s = F.lower(F.trim(text))
    return F.when(s.startswith("positive"), 1).when(s == "negative", 0)


def canonical(name: Column, aliases: Mapping[str, str] = K.PANEL_ALIASES) -> Column:
    return F.coalesce(lookup(aliases)[name], name)


def strict_lookup(key: Column, values: Mapping[str, str], what: str = "value") -> Column:
    """The mapped value; an unknown key fails the query."""
    table = lookup(values)
    return F.when(table[key].isNotNull(), table[key]).otherwise(F.raise_error(F.concat(F.lit(f"unknown {what}: "), F.coalesce(key, F.lit("null")))))


def row_max(columns: Sequence[str]) -> Column:
    """Largest value of a row; nulls and NaN do not count."""
    return F.greatest(*[F.nanvl(F.col(c).cast("double"), F.lit(None)) for c in columns])


def row_arg_max(columns: Sequence[str]) -> Column:
    """Name of the column with the largest value; the first of equal ones."""
    cells = [F.when(F.nanvl(F.col(c).cast("double"), F.lit(None)).isNotNull(), F.struct(F.col(c).cast("double").alias("v"), F.lit(-i).alias("i"), F.lit(c).alias("name"))) for i, c in enumerate(columns)]
    return F.array_max(F.array_compact(F.array(*cells)))["name"]


def _bounded(x: Column, low: float, high: float) -> Column:
    """x within low and high; null and NaN stay, which least and greatest would turn into a bound."""
    return F.when(x < low, low).when(~F.isnan(x) & (x > high), high).otherwise(x)


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-_bounded(x, -500.0, 500.0)))


def logit(p: Column, eps: float = 1e-6) -> Column:
    """Log odds of a share held within eps and 1 - eps, so always finite; ``log_odds`` holds nothing back."""
    q = _bounded(p, eps, 1 - eps)
    return F.ln(q / (1 - q))


def log_odds(p: Column) -> Column:
    """Log odds in IEEE arithmetic: minus infinity at 0, infinity at 1, NaN outside and for NaN, null for null."""
    inside = F.when((p > 0) & (p < 1), p)  # keeps the division and the logarithm defined
    odd = F.when(p == 0, float("-inf")).when(p == 1, float("inf")).when(p.isNotNull(), float("nan"))
    return F.coalesce(F.ln(inside / (1 - inside)), odd)


def standardise(x: Column, mean: float, scale: float) -> Column:
    return (x - mean) / (scale + 1e-10)


def inverted_percent(rank: Column) -> Column:
    return 1 - rank / 100


def guarded_ratio(n: Column, d: Column, floor: float = 0.05) -> Column:
    return F.when(d > floor, n / d)


def close(a: Column, b: Column) -> Column:
    return F.abs(a - b) <= 1e-8 + 1e-5 * F.abs(b)


def hash_unit(*parts: Column) -> Column:
    """32 hash bits of the parts as a long; the same in any SQL engine with md5."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *[p.cast("string") for p in parts]).cast("binary")), 1, 8), 16, 10).cast("long")


def safe_path(path: Column) -> Column:
    return path.rlike(r"^/[A-Za-z0-9_./-]+$") & ~path.contains("..")
