"""Outputs of micro-batches merged in tiers.

Every micro-batch adds a folder. As soon as ``fan`` folders of a tier stand at the end, they are merged into one of the
next tier, so a reader opens a number of folders that grows with the logarithm of the micro-batches. A small list,
written last, names the folders that hold each row once; it replaces the one before as a whole. What a micro-batch has merged
away stays until a later one is complete, so a micro-batch that is run again finds what it read.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

FAN = 8
#: Lists that are kept: of this micro-batch and of the two before.
KEPT = 3


def _fs(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark._jsc.hadoopConfiguration())


def _numbers(spark: SparkSession, out: str) -> list[int]:
    """Micro-batches whose list is kept, in order; a few."""
    at, fs = _fs(spark, f"{out}/_live")
    if not fs.exists(at):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(at)]
    return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json") and not n.startswith("."))


def live(spark: SparkSession, out: str, before: int | None = None) -> list[tuple[str, int]]:
    """(folder, tier) of the folders that hold the output up to the last micro-batch, or the last one ``before``."""
    numbers = [n for n in _numbers(spark, out) if before is None or n < before]
    return _listed(spark, out, numbers[-1]) if numbers else []


def _listed(spark: SparkSession, out: str, number: int) -> list[tuple[str, int]]:
    rows = spark.read.schema("folder string, tier int").json(f"{out}/_live/{number}.json").collect()
    return [(r["folder"], r["tier"]) for r in rows]


def read(spark: SparkSession, out: str, folders: list[tuple[str, int]] | None = None) -> DataFrame | None:
    """The rows of ``folders``, by default of all live ones; null when there are none."""
    folders = live(spark, out) if folders is None else folders
    return spark.read.parquet(*[f"{out}/{name}" for name, _ in folders]) if folders else None


def add(rows: DataFrame, out: str, micro_batch: int, combine: Callable[[DataFrame], DataFrame], fan: int = FAN) -> None:
    """Add the output of a micro-batch; ``combine`` reduces the rows of several folders to what they say together."""
    spark = rows.sparkSession
    folders = [*live(spark, out, micro_batch), (f"batch-{micro_batch}", 0)]
    rows.write.mode("overwrite").parquet(f"{out}/{folders[-1][0]}")
    while len(folders) >= fan and len({tier for _, tier in folders[-fan:]}) == 1:
        tier = folders[-1][1] + 1
        merged = (f"tier-{tier}-to-{micro_batch}", tier)
        combine(read(spark, out, folders[-fan:])).write.mode("overwrite").parquet(f"{out}/{merged[0]}")
        folders[-fan:] = [merged]
    _write_list(spark, out, micro_batch, folders)
    _clean(spark, out, micro_batch)


def _write_list(spark: SparkSession, out: str, micro_batch: int, folders: list[tuple[str, int]]) -> None:
    path, fs = _fs(spark, f"{out}/_live/{micro_batch}.json")
    beside, _ = _fs(spark, f"{out}/_live/.{micro_batch}.json")
    stream = fs.create(beside, True)
    stream.write(bytearray("\n".join(json.dumps({"folder": f, "tier": t}) for f, t in folders).encode()))
    stream.close()
    fs.delete(path, False)
    fs.rename(beside, path)


def _clean(spark: SparkSession, out: str, micro_batch: int) -> None:
    """Drop folders that neither this list nor the one before names, and lists older than the last KEPT."""
    numbers = [n for n in _numbers(spark, out) if n <= micro_batch]
    wanted = {f for n in numbers[-2:] for f, _ in _listed(spark, out, n)}
    for n in numbers[-KEPT:-2]:
        for folder in {f for f, _ in _listed(spark, out, n)} - wanted:
            path, fs = _fs(spark, f"{out}/{folder}")
            fs.delete(path, True)
    for n in numbers[:-KEPT]:
        path, fs = _fs(spark, f"{out}/_live/{n}.json")
        fs.delete(path, False)
