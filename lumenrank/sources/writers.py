"""Sinks: Parquet and delimited text, item lists, JSON and run folders."""

from __future__ import annotations

import json
import logging
import sys
from datetime import datetime, timezone
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def parquet(df: DataFrame, path: str, partition_by: tuple[str, ...] = (), mode: str = "overwrite") -> None:
    w = df.write.mode(mode)
    (w.partitionBy(*partition_by) if partition_by else w).parquet(path)


def delimited(df: DataFrame, path: str, columns: list[str] | None = None, sep: str = ",", header: bool = True, mode: str = "overwrite") -> None:
    (df.select(*columns) if columns else df).write.mode(mode).option("header", header).option("sep", sep).csv(path)


def item_list(df: DataFrame, column: str, path: str, mode: str = "overwrite") -> None:
    df.select(F.col(column).cast("string")).write.mode(mode).text(path)


def json_lines(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).json(path)


def json_report(data: dict, path: str | Path) -> None:
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    Path(path).write_text(json.dumps(data, indent=2, sort_keys=True, default=str))


def run_folder(root: str | Path, run_id: str | None = None) -> Path:
    """A folder for a run with its raw, processed and manifests subfolders."""
    run_id = run_id or f"run_{datetime.now(timezone.utc):%Y%m%d_%H%M%S}"
    for sub in ("raw", "processed", "manifests"):
        (Path(root) / run_id / sub).mkdir(parents=True, exist_ok=True)
    return Path(root) / run_id


def log_to(path: str | Path) -> logging.Logger:
    """The package's log, on the console and in a file."""
    log = logging.getLogger("lumenrank")
    log.setLevel(logging.INFO)
    for h in (logging.StreamHandler(sys.stderr), logging.FileHandler(path)):
        h.setFormatter(logging.Formatter("%(asctime)s %(levelname)s %(message)s"))
        log.addHandler(h)
    return log
