"""Crawl snapshots: Parquet tables and a manifest that is written last.

A snapshot is a new folder. The manifest names the current one and is replaced by a
rename, so a reader sees the old snapshot or the new one, never a part of it. Paths are
those of any file system that Spark knows.
"""

from __future__ import annotations

import json
import logging
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession

MANIFEST = "manifest.json"


def _fs(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def save(spark: SparkSession, path: str, tables: dict[str, DataFrame], round_no: int, extra: dict | None = None, growing: dict[str, DataFrame] | None = None, follows: bool = False) -> str:
    """Write the tables and point the manifest at them; the snapshot's folder.

    With ``follows``, ``growing`` tables are given without the rows that the last snapshot
    has: the new manifest names their folders as well, so that a save costs what is new.
    """
    name = f"snapshot-{round_no:06d}-{uuid.uuid4().hex[:8]}"
    for table, df in {**tables, **(growing or {})}.items():
        df.write.parquet(f"{path}/{name}/{table}")
    before = (_manifest(spark, path) or {}).get("folders", {}) if follows else {}
    folders = {t: [f"{name}/{t}"] for t in tables} | {t: [*before.get(t, []), f"{name}/{t}"] for t in growing or {}}
    folders = {t: f for t, f in before.items() if t not in tables} | folders
    text = json.dumps({"snapshot": name, "round": round_no, "folders": folders, "extra": extra or {}}, default=str)
    fs, target = _fs(spark, f"{path}/{MANIFEST}")
    _, draft = _fs(spark, f"{path}/{MANIFEST}.{name}.tmp")
    out = fs.create(draft, True)
    out.write(bytearray(text.encode()))
    out.close()
    context = spark.sparkContext._jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri(), spark.sparkContext._jsc.hadoopConfiguration())
    options = spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.org.apache.hadoop.fs.Options.Rename, 1)
    options[0] = spark.sparkContext._jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    context.rename(fs.makeQualified(draft), fs.makeQualified(target), options)
    return f"{path}/{name}"


def _manifest(spark: SparkSession, path: str) -> dict | None:
    fs, target = _fs(spark, f"{path}/{MANIFEST}")
    if not fs.exists(target):
        return None
    try:
        found = json.loads("\n".join(r.value for r in spark.read.text(f"{path}/{MANIFEST}").collect()))
        return found if {"round", "folders", "extra"} <= set(found) else None
    except (ValueError, TypeError):
        return None


def load(spark: SparkSession, path: str) -> dict | None:
    """The tables of the current snapshot by name, with ``round`` and ``extra``; None if there
    is no manifest, or it or a folder that it names can't be read (a crawl then starts afresh)."""
    manifest = _manifest(spark, path)
    if manifest is None:
        return None
    try:
        found = {t: spark.read.parquet(*[f"{path}/{f}" for f in folders]) for t, folders in manifest["folders"].items()}
    except AnalysisException as why:
        logging.getLogger("spindrift").warning("the snapshot in %s can't be read: %s", path, str(why).split("\n", 1)[0])
        return None
    return found | {"round": manifest["round"], "extra": manifest["extra"]}


def match_states(names: list[str], states: dict[str, str]) -> tuple[dict[str, str], list[str]]:
    """(states of the pipelines by name, names of saved states that no pipeline has)."""
    return {n: states[n] for n in names if n in states}, sorted(set(states) - set(names))
