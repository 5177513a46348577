"""Hashes, manifests, atomic publishing, reports and bundles."""

from __future__ import annotations

import hashlib
import json
import os
import shutil
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterable, Mapping
from datetime import datetime, timezone
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenrank.functions import constants as K


def content_hash(df: DataFrame) -> DataFrame:
    """rows and a digest of a table's content, whatever its order or layout.

    A row's hash is cut into four numbers that are summed, so partial sums meet, not rows.
    """
    row = F.sha2(F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"}), 256)
    sums = [F.sum(F.conv(F.substring(row, 1 + 15 * i, 15), 16, 10).cast("decimal(38,0)")) for i in range(4)]
    return df.agg(F.count("*").alias("n_rows"), F.sha2(F.concat_ws("|", F.count("*").cast("string"), *[s.cast("string") for s in sums]), 256).alias("digest"))


def file_hashes(spark: SparkSession, glob: str) -> DataFrame:
    """path, size_bytes and sha256 of files, read by the cluster."""
    files = spark.read.format("binaryFile").load(glob)
    return files.select("path", F.col("length").alias("size_bytes"), F.sha2("content", 256).alias("sha256"))


def file_sha256(path: str | Path) -> str:
    with open(path, "rb") as f:
        return hashlib.file_digest(f, "sha256").hexdigest()


def update_manifest(manifest: str | Path, artifacts: Iterable[str | Path], root: str | Path, **extra) -> dict:
    """Insert or replace the artifacts' checksums and sizes in a JSON manifest."""
    manifest, root = Path(manifest), Path(root)
    data = json.loads(manifest.read_text()) if manifest.exists() else {"artifacts": {}}
    for a in map(Path, artifacts):
        data["artifacts"][os.path.relpath(a, root).replace(os.sep, "/")] = {"sha256": file_sha256(a), "size_bytes": a.stat().st_size}
    data |= extra | {"updated_at": datetime.now(timezone.utc).isoformat()}
    manifest.parent.mkdir(parents=True, exist_ok=True)
    temporary = manifest.with_name(f".{manifest.name}.{uuid.uuid4().hex}")
    temporary.write_text(json.dumps(data, indent=2, sort_keys=True))
    temporary.replace(manifest)
    return data


def verify_manifest(manifest: str | Path, root: str | Path, required: Iterable[str] = ()) -> list[str]:
    """What is wrong: required names that are missing, and files whose bytes changed."""
    listed = json.loads(Path(manifest).read_text())["artifacts"]
    wrong = [f"{name}: not in the manifest" for name in required if name not in listed]
    for name, entry in listed.items():
        path = Path(root) / name
        if not path.exists():
            wrong += [f"{name}: missing"] if name in set(required) else []
        elif file_sha256(path) != entry["sha256"]:
            wrong.append(f"{name}: checksum differs")
    return wrong


def publish(target: str | Path, steps: Mapping[str, Callable[[Path], None]]) -> list[Path]:
    """Run every step in a staging folder; only if all succeed move their files to ``target``, else leave a status file."""
    target = Path(target)
    target.mkdir(parents=True, exist_ok=True)
    staging = Path(tempfile.mkdtemp(prefix=".staging-", dir=target))
    status = target / "status.json"
    try:
        for name, step in steps.items():
            try:
                step(staging)
            except Exception as e:
                status.write_text(json.dumps({"status": "failed", "step": name, "error": str(e)}, indent=2))
                raise
        out = []
        for f in sorted(p for p in staging.rglob("*") if p.is_file()):
            to = target / f.relative_to(staging)
            to.parent.mkdir(parents=True, exist_ok=True)
            f.replace(to)
            out.append(to)
        status.write_text(json.dumps({"status": "ok", "files": [str(p.relative_to(target)) for p in out]}, indent=2))
        return out
    finally:
        shutil.rmtree(staging, ignore_errors=True)


def bundle(archive: str | Path, files: Iterable[str | Path], root: str | Path) -> dict:
    """A zip of the files with a manifest inside; a missing file is an error."""
    files = [Path(f) for f in files]
    if missing := [str(f) for f in files if not f.is_file()]:
        raise FileNotFoundError(f"missing from the bundle: {missing}")
    manifest = {os.path.relpath(f, root): {"sha256": file_sha256(f), "size_bytes": f.stat().st_size} for f in files}
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as z:
        for f in files:
            z.write(f, os.path.relpath(f, root))
        z.writestr("MANIFEST.json", json.dumps(manifest, indent=2, sort_keys=True))
    return manifest


def markdown_table(df: DataFrame, order: list[str] | None = None, digits: int = 4, most: int = 10_000) -> str:
    """A report table. A table of more than ``most`` rows is no report and an error."""
    rows = (df.orderBy(*order) if order else df).limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"a report table of more than {most} rows")
    cell = lambda v: "" if v is None else f"{v:.{digits}f}" if isinstance(v, float) else str(v).replace("|", "\\|")
    lines = ["| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns)]
    return "\n".join([*lines, *("| " + " | ".join(map(cell, r)) + " |" for r in rows)]) + "\n"


def replace_section(report: str, marker: str, section: str) -> str:
    """The report with the section under a marker replaced, or appended if there is none; it ends at the next marker."""
    head, found, tail = report.partition(marker)
    if not found:
        return report.rstrip("\n") + f"\n\n{marker}\n{section.strip()}\n"
    after = tail.find("\n<!--", 1)
    return f"{head}{marker}\n{section.strip()}\n" + (tail[after:] if after >= 0 else "")


def output_name(stem: str, mode: str, version: str, suffix: str = "csv") -> str:
    return f"{stem}_{mode}_{version}.{suffix}"


def name_candidates(name: str) -> list[str]:
    """A canonical panel name first, then its older aliases."""
    canonical = K.PANEL_ALIASES.get(name, name)
    return [canonical, *(old for old, new in K.PANEL_ALIASES.items() if new == canonical)]


def first_existing(folder: str | Path, names: Iterable[str], strict: bool = False) -> Path:
    """The first name that exists; ``strict`` refuses a folder that mixes several of them."""
    found = [Path(folder) / n for n in names if (Path(folder) / n).exists()]
    if not found:
        raise FileNotFoundError(f"none of {list(names)} in {folder}")
    if strict and len(found) > 1:
        raise ValueError(f"mixed names in {folder}: {[f.name for f in found]}")
    return found[0]
