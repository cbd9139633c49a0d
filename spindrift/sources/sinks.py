"""Where items go: files of any format that Spark writes, the console, or a stream's sink."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write(items: DataFrame, path: str, kind: str = "parquet", partition_by: list[str] | None = None) -> None:
    """Survivors of the item chain as parquet, orc, json, csv or text; whole or not at all."""
    kept = items.where("dropped_by IS NULL").drop("dropped_by", "drop_kind") if "dropped_by" in items.columns else items
    if kind == "text":
        kept = kept.select(F.to_json(F.struct(*kept.columns)).alias("value"))
    writer = kept.write.format(kind)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.save(path)


def console(items: DataFrame, rows: int = 20) -> None:
    """The sink of a crawl without pipelines: its first rows, printed."""
    items.show(rows, truncate=False)
