"""Scans: FASTA, delimited tables with odd headers, text lists, JSON, YAML, and folders of them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumenrank.functions.scalar import file_label, file_virus


def fasta(spark: SparkSession, path: str) -> DataFrame:
    """protein_id (first word), name (second part of a|b|c ids that start with sp), header, seq (upper-cased)."""
    records = spark.read.option("lineSep", ">").text(path).filter(F.trim("value") != "")
    record = F.regexp_replace("value", "\r", "")
    header = F.trim(F.split(record, "\n", 2)[0])
    first = F.split(header, r"\s+")[0]
    parts = F.split(first, r"\|")
    seq = F.upper(F.regexp_replace(F.coalesce(F.get(F.split(record, "\n", 2), F.lit(1)), F.lit("")), r"\s+", ""))
    name = F.when((parts[0] == "sp") & (F.size(parts) > 1), F.element_at(parts, -1)).otherwise(first)
    return records.select(first.alias("protein_id"), name.alias("name"), header.alias("header"), seq.alias("seq"))


def table(spark: SparkSession, path: str, schema: T.StructType | str | None = None, sep: str = ",", comment: str | None = None) -> DataFrame:
    """Delimited text with a header; ``comment`` drops lines that start with it."""
    reader = spark.read.option("header", True).option("sep", sep)
    if comment:
        reader = reader.option("comment", comment)
    reader = reader.schema(schema) if schema is not None else reader.option("inferSchema", True)
    return reader.csv(path)


def head_lines(spark: SparkSession, path: str, n: int) -> list[str]:
    return [r.value for r in spark.read.text(path).limit(n).collect()]


def _names(line: str, sep: str) -> list[str]:
    import csv

    return [c.strip() for c in next(csv.reader([line], delimiter=sep))]


def lines_below(spark: SparkSession, path: str, n: int) -> DataFrame:
    """The lines (value) of each file after its first ``n``, told by their place, so an equal line further down stays.

    A file's first block has its lines in order, so the smallest row number there is that of its first line.
    """
    if not n:
        return spark.read.text(path)
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("_p"), F.col("_metadata.file_block_start").alias("_s"), F.monotonically_increasing_id().alias("_i"))
    firsts = lines.filter("_s = 0").groupBy("_p").agg(F.min("_i").alias("_m"))
    return lines.join(firsts, "_p").filter((F.col("_s") != 0) | (F.col("_i") >= F.col("_m") + n)).select("value")


def table_below(spark: SparkSession, path: str, skip: int, sep: str = ",", levels: int = 1) -> DataFrame:
    """Delimited text whose header follows ``skip`` lines; with two levels the names are joined by a dot.

    Header lines are dropped where the data starts, by their position in the file.
    """
    lines = head_lines(spark, path, skip + levels)
    if levels == 2:
        top, low, last, names = _names(lines[skip], sep), _names(lines[skip + 1], sep), "", []
        for i, name in enumerate(low):
            last = top[i] if i < len(top) and top[i] else last
            names.append(f"{last}.{name}" if last else name)
    else:
        names = _names(lines[skip], sep)
    seen: dict[str, int] = {}
    unique = []
    for n in names:
        seen[n] = seen.get(n, 0) + 1
        unique.append(n if seen[n] == 1 else f"{n}.{seen[n] - 1}")
    raw = lines_below(spark, path, skip + levels)
    return raw.select(F.from_csv("value", ", ".join(f"`{n}` string" for n in unique), {"sep": sep}).alias("r")).select("r.*")


def positional(spark: SparkSession, path: str, columns: dict[int, str], skip: int, sep: str = ",") -> DataFrame:
    """Chosen columns by position from a table without a usable header."""
    lines = head_lines(spark, path, skip + 1)
    width = max(len(_names(lines[-1], sep)) if lines else 0, max(columns) + 1)
    raw = lines_below(spark, path, skip)
    kind = ", ".join(f"_c{i} string" for i in range(width))
    return raw.select(F.from_csv("value", kind, {"sep": sep}).alias("r")).select(*[F.col(f"r._c{i}").alias(n) for i, n in columns.items()])


def sniff(spark: SparkSession, path: str) -> tuple[str, int]:
    """Kind of an export and its number of header lines, from the first three lines of text.

    A line that names a qualitative measure makes it a 'tcell_assay', whose header ends there; else it is an 'epitope_table'.
    """
    for i, line in enumerate(head_lines(spark, path, 3)):
        if "qualitative" in line.lower():
            return "tcell_assay", i + 1
    return "epitope_table", 1


def folder(spark: SparkSession, path: str, pattern: str, header: bool = True) -> DataFrame:
    """All matching tables of a folder with file, and the label and virus that the file name tells."""
    df = spark.read.option("header", header).option("pathGlobFilter", pattern).csv(path)
    file = F.col("_metadata.file_name")
    return df.select("*", file.alias("file"), file_label(file).alias("file_label"), file_virus(file).alias("file_virus"))


def lines(spark: SparkSession, path: str, name: str = "peptide") -> DataFrame:
    """One upper-cased item per line, each once, in order."""
    return spark.read.text(path).select(F.upper(F.trim("value")).alias(name)).filter(F.col(name) != "").distinct().orderBy(name)


def json_document(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.json(path, multiLine=True)


def config(path: str) -> dict:
    """A YAML file, or JSON, which is YAML."""
    try:
        import yaml
    except ImportError:
        import json

        with open(path) as f:
            return json.load(f)
    with open(path) as f:
        return yaml.safe_load(f)


def workbook(spark: SparkSession, path: str, skip: int = 0) -> DataFrame:
    """The first sheet of an XLSX file, if openpyxl is installed."""
    import openpyxl  # optional

    rows = list(openpyxl.load_workbook(path, read_only=True).active.iter_rows(values_only=True))[skip:]
    names = [str(c) for c in rows[0]]
    return spark.createDataFrame([tuple(None if v is None else str(v) for v in r) for r in rows[1:]], T.StructType([T.StructField(n, T.StringType()) for n in names]))


def read_or_empty(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """The table, or an empty one of its schema if there is none."""
    from pyspark.errors import AnalysisException

    try:
        return spark.read.schema(schema).option("header", True).csv(path)
    except AnalysisException:
        return spark.createDataFrame([], schema)


def resolve_column(df: DataFrame, names: Sequence[str], keyword: str | None = None) -> str | None:
    """The first column that equals one of the names, whatever its case, or else contains the keyword."""
    low = {c.lower(): c for c in df.columns}
    for n in names:
        if n.lower() in low:
            return low[n.lower()]
    return next((c for c in df.columns if keyword and keyword.lower() in c.lower()), None)
