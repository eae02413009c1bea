"""Writing stages: tables, a manifest and a report, swapped in at once."""

from __future__ import annotations

import json
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tramline.functions.geo import cell_wkt
from tramline.functions.scalar import content_key


def _fs(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark._jsc.hadoopConfiguration())


def swap(spark: SparkSession, staged: str, target: str) -> None:
    """Put a finished folder in the place of another."""
    source, fs = _fs(spark, staged)
    goal, _ = _fs(spark, target)
    old, _ = _fs(spark, f"{target}.old")
    fs.delete(old, True)
    if fs.exists(goal):
        fs.rename(goal, old)
    fs.mkdirs(goal.getParent())
    if not fs.rename(source, goal):
        raise OSError(f"can't put {staged} in place")
    fs.delete(old, True)


def write_text(spark: SparkSession, path: str, text: str) -> None:
    where, fs = _fs(spark, path)
    out = fs.create(where, True)
    out.write(bytearray(text.encode()))
    out.close()


def write_stage(
    spark: SparkSession, target: str, tables: dict[str, DataFrame], order: dict[str, list[str]], settings: dict, natures: dict[str, str] | None = None
) -> dict:
    """Tables as sorted Parquet (zstd) with manifest.json and report.md; returns the manifest.

    Each table is range-partitioned by its order, so that equal inputs give equal rows in
    equal places and readers can skip files. natures: data nature of columns.
    """
    staged = f"{target}.staging"
    where, fs = _fs(spark, staged)
    fs.delete(where, True)
    counts = {}
    for name, table in tables.items():
        for column, nature in (natures or {}).items():
            if column in table.columns:
                table = table.withMetadata(column, {"nature": nature})
        table.repartitionByRange(*order[name]).sortWithinPartitions(*order[name]).write.option("compression", "zstd").parquet(f"{staged}/{name}")
        counts[name] = spark.read.parquet(f"{staged}/{name}").count()
    manifest = {"rows": counts, "settings": settings, "key": content_key(settings), "natures": natures or {}}
    write_text(spark, f"{staged}/manifest.json", json.dumps(manifest, indent=1, sort_keys=True))
    lines = [f"# {target.rpartition('/')[2]}", "", "| table | rows |", "|---|---|", *(f"| {n} | {c} |" for n, c in counts.items())]
    write_text(spark, f"{staged}/report.md", "\n".join(lines) + "\n")
    swap(spark, staged, target)
    return manifest


def read_manifest(spark: SparkSession, target: str) -> dict | None:
    where, fs = _fs(spark, f"{target}/manifest.json")
    if not fs.exists(where):
        return None
    return json.loads("\n".join(r["value"] for r in spark.read.text(f"{target}/manifest.json", wholetext=True).collect()))


def cached_stage(spark: SparkSession, target: str, settings: dict, make) -> bool:
    """Run make() unless the target's manifest has the same settings; True if it ran."""
    held = read_manifest(spark, target)
    if held and held.get("key") == content_key(settings):
        return False
    make()
    return True


def write_matrix(matrix: DataFrame, path: str, block: int = 256) -> None:
    """Travel times in folders of `block` origins each, sorted, for pruning by origin."""
    rows = matrix.withColumn("origin_block", F.floor(F.col("origin_zone") / block).cast("int"))
    rows.repartitionByRange("origin_block").sortWithinPartitions("origin_block", "origin_zone", "dest_zone").write.partitionBy("origin_block").parquet(path)


def write_zone_wkt(zones: DataFrame, path: str, size: float) -> None:
    """Zones with their outlines as WKT, for loading into a spatial database."""
    zones.withColumn("wkt", cell_wkt("cell", size)).write.parquet(path)


def write_csv(rows: DataFrame, path: str) -> None:
    rows.write.option("header", True).csv(path)


def progress_line(step: str, done: int, total: int) -> str:
    """One JSON line of progress."""
    return json.dumps({"at": datetime.now(timezone.utc).isoformat(timespec="seconds"), "step": step, "done": done, "total": total})
