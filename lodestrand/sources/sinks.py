"""Writers: canonical JSON, files that are never overwritten, a content-addressed cache, freezes and chained ledgers.

Big tables are written by Spark to a folder of their own; what is hashed and written here is the small record beside them.
"""

from __future__ import annotations

import hashlib
import json
import os
import tempfile
from collections.abc import Mapping
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def canonical(value: Any) -> str:
    """JSON with sorted keys, no blanks and characters as they are."""
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def digest(value: Any) -> str:
    """The SHA-256 of a value's canonical form."""
    return hashlib.sha256(canonical(value).encode()).hexdigest()


def write_atomic(path: str | Path, value: Any, overwrite: bool = True) -> Path:
    """Write a value as JSON through a temporary file; without overwrite, an existing file of other content is refused."""
    path = Path(path)
    text = json.dumps(value, sort_keys=True, indent=2, ensure_ascii=False) + "\n"
    if path.exists() and not overwrite:
        if path.read_text(encoding="utf-8") == text:
            return path
        raise FileExistsError(path)
    path.parent.mkdir(parents=True, exist_ok=True)
    handle, name = tempfile.mkstemp(dir=path.parent, prefix=path.name)
    with os.fdopen(handle, "w", encoding="utf-8") as out:
        out.write(text)
    os.replace(name, path)
    return path


def export_schemas(folder: str | Path, schemas: Mapping[str, Any]) -> list[Path]:
    """Write each Spark schema as JSON, one file a name; the same schemas give the same bytes."""
    return [write_atomic(Path(folder) / f"{name}.schema.json", json.loads(schema.json())) for name, schema in sorted(schemas.items())]


class TableCache:
    """Tables kept under the hash of what they were made from; one that is there is never replaced."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def path(self, key: Mapping[str, str]) -> str:
        """Where the table of a key is."""
        return f"{self.root}/{digest(dict(key))}"

    def _there(self, path: str) -> bool:
        jvm = self.spark._jvm
        target = jvm.org.apache.hadoop.fs.Path(path + "/_SUCCESS")
        return target.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(target)

    @staticmethod
    def _mark(df: DataFrame) -> tuple:
        """The number of rows and two sums of their hashes: the same for the same rows in any order."""
        text = F.to_json(F.struct(*df.columns))
        h = [F.sum(F.xxhash64(F.lit(seed), text).cast("decimal(38,0)")) for seed in (1, 2)]
        return tuple(df.agg(F.count(F.lit(1)), *h).first())

    def get(self, key: Mapping[str, str]) -> DataFrame | None:
        """The table of a key, or None."""
        path = self.path(key)
        return self.spark.read.parquet(path) if self._there(path) else None

    def put(self, key: Mapping[str, str], df: DataFrame) -> DataFrame:
        """The table of a key, written unless it is there; other rows under a key that is there are refused."""
        if (kept := self.get(key)) is not None:
            if kept.schema.simpleString() != df.schema.simpleString() or self._mark(kept) != self._mark(df):
                raise FileExistsError(self.path(key))
            return kept
        df.write.mode("errorifexists").parquet(self.path(key))
        return self.spark.read.parquet(self.path(key))


def freeze(folder: str | Path, parts: Mapping[str, list[dict]], facts: Mapping[str, Any]) -> dict:
    """Write small record lists once, with a manifest of their hashes; the same content again is accepted, other content refused."""
    folder = Path(folder)
    hashes = {name: digest(rows) for name, rows in sorted(parts.items())}
    manifest = {"files": hashes, "facts": dict(facts), "identity": digest({"files": hashes, "facts": dict(facts)})}
    place = folder / "manifest.json"
    if place.exists():
        if json.loads(place.read_text(encoding="utf-8")) == manifest:
            return manifest
        raise FileExistsError(folder)
    if folder.exists() and any(folder.iterdir()):
        raise FileExistsError(folder)
    # Staged beside its place and moved there as a whole, so that a crash leaves nothing that looks frozen.
    folder.parent.mkdir(parents=True, exist_ok=True)
    staged = Path(tempfile.mkdtemp(dir=folder.parent, prefix=f".{folder.name}"))
    for name, rows in parts.items():
        write_atomic(staged / f"{name}.json", rows, overwrite=False)
    write_atomic(staged / "manifest.json", manifest, overwrite=False)
    os.replace(staged, folder)
    return manifest


def ledger_append(path: str | Path, entry: Mapping[str, Any]) -> dict:
    """Add an entry that holds the hash of the one before; a ledger whose chain is broken is refused."""
    path = Path(path)
    rows = [json.loads(x) for x in path.read_text(encoding="utf-8").splitlines() if x.strip()] if path.exists() else []
    if broken := ledger_breaks(rows):
        raise ValueError(f"the chain is broken at entry {broken[0]}")
    row = dict(entry) | {"previous_entry_hash": rows[-1]["entry_hash"] if rows else None}
    row["entry_hash"] = digest(row)
    path.parent.mkdir(parents=True, exist_ok=True)
    with path.open("a", encoding="utf-8") as out:
        out.write(canonical(row) + "\n")
    return row


def ledger_breaks(rows: list[dict]) -> list[int]:
    """The places of entries whose own hash or link to the one before is wrong."""
    out, before = [], None
    for k, row in enumerate(rows):
        body = {n: v for n, v in row.items() if n != "entry_hash"}
        if row.get("previous_entry_hash") != before or digest(body) != row.get("entry_hash"):
            out.append(k)
        before = row.get("entry_hash")
    return out
