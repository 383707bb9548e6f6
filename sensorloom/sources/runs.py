"""Tables of batch jobs whose runs take effect as a whole or not at all.

A run writes each of its tables into a folder of its own and, after all of them, one success
record. Readers see the folders of recorded runs only, so a run that is killed leaves nothing
behind that counts: run again under its id it replaces its folders, and a recorded run is not
done again. Tables that are looked up by key are bucketed by it, one partition a run, so a
join with them moves the new rows only.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

RUN = "run"
RECORDS = "_runs"


class ConflictingRun(RuntimeError):
    """Another run was recorded since this one read the tables; it has to be done again."""


@dataclass
class RunStore:
    """Runs below ``root``, a folder that all executors share.

    The list of recorded runs, one short name each, is read on the driver.
    """

    spark: SparkSession
    root: str
    buckets: int = 200
    _opened: dict[str, str] = field(default_factory=dict)

    def _path(self, *parts: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path("/".join([self.root.rstrip("/"), *parts]))
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def records(self) -> list[dict]:
        """The success records in the order of the runs."""
        path, fs = self._path(RECORDS)
        if not fs.exists(path):
            return []
        rows = self.spark.read.schema("run string, number long, rows map<string,long>").json(f"{self.root}/{RECORDS}").collect()
        return sorted((r.asDict() for r in rows), key=lambda r: r["number"])

    def recorded(self, run: str) -> bool:
        path, fs = self._path(RECORDS, f"{run}.json")
        return fs.exists(path)

    def record(self, run: str, seen: int, rows: dict[str, int] | None = None) -> None:
        """Make ``run`` count; ``seen`` is the number of records it has read.

        The record is written beside and renamed, so it is there whole or not at all. One job at a time
        is meant to write; one that was overtaken by another is refused.
        """
        if len(self.records()) != seen:
            raise ConflictingRun(run)
        path, fs = self._path(RECORDS, f"{run}.json")
        beside, _ = self._path(RECORDS, f".{run}.json")
        out = fs.create(beside, True)
        out.write(bytearray(json.dumps({RUN: run, "number": seen + 1, "rows": rows or {}}).encode()))
        out.close()
        if fs.exists(path) or not fs.rename(beside, path):
            raise ConflictingRun(run)

    def write(self, run: str, name: str, rows: DataFrame, day: str | None = None, order: Sequence[str] = ()) -> None:
        """Replace what ``run`` has written to the table ``name``, by day of the column ``day`` if given."""
        if day:
            rows = rows.withColumn("date", F.to_date(day)).hint("rebalance", "date").sortWithinPartitions("date", *order)
        writer = rows.write.mode("overwrite").option("compression", "zstd")
        (writer.partitionBy("date") if day else writer).parquet(f"{self.root}/{name}/{RUN}={run}")

    def read(self, name: str, schema: T.StructType | str, runs: Sequence[str] | None = None) -> DataFrame:
        """The rows of recorded runs; filters on ``date`` prune folders."""
        wanted = [r[RUN] for r in self.records()] if runs is None else list(runs)
        paths = [f"{self.root}/{name}/{RUN}={run}" for run in wanted]
        if not paths:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).option("basePath", f"{self.root}/{name}").parquet(*paths).drop(RUN)

    def _ledger(self, name: str, schema: T.StructType, keys: Sequence[str]) -> str:
        """Catalog name of a table bucketed by ``keys``; a new session opens the stored data under the same name."""
        if name not in self._opened:
            path = f"{self.root}/{name}"
            table = f"{name}_{hashlib.sha256(path.encode()).hexdigest()[:16]}"
            columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)
            by = ", ".join(f"`{k}`" for k in keys)
            self.spark.sql(
                f"CREATE TABLE IF NOT EXISTS {table} ({columns}, {RUN} string) USING parquet PARTITIONED BY ({RUN}) "
                f"CLUSTERED BY ({by}) SORTED BY ({by}) INTO {self.buckets} BUCKETS LOCATION '{path}'"
            )
            self._opened[name] = table
        return self._opened[name]

    def write_ledger(self, run: str, name: str, rows: DataFrame, keys: Sequence[str]) -> None:
        """Replace what ``run`` has written to the ledger ``name``: one file a bucket, sorted by ``keys``."""
        table = self._ledger(name, rows.schema, keys)
        view = f"_new_{table}"
        rows.repartition(self.buckets, *keys).sortWithinPartitions(*keys).createOrReplaceTempView(view)
        columns = ", ".join(f"`{c}`" for c in rows.columns)
        self.spark.sql(f"INSERT OVERWRITE TABLE {table} PARTITION ({RUN} = '{run}') SELECT {columns} FROM {view}")
        self.spark.catalog.dropTempView(view)

    def read_ledger(self, name: str, schema: T.StructType, keys: Sequence[str]) -> DataFrame:
        """The rows of recorded runs, bucketed by ``keys``."""
        table = self._ledger(name, schema, keys)
        self.spark.sql(f"ALTER TABLE {table} RECOVER PARTITIONS")  # runs of other sessions
        return self.spark.table(table).where(F.col(RUN).isin([r[RUN] for r in self.records()])).drop(RUN)

    def aligned(self, rows: DataFrame, keys: Sequence[str]) -> DataFrame:
        """``rows`` dealt out like a ledger with these keys, so that a join on them leaves the ledger in place."""
        return rows.repartition(self.buckets, *keys)

    def close(self) -> None:
        """Forget the session's names of the ledgers; the data stays."""
        for table in self._opened.values():
            self.spark.sql(f"DROP TABLE IF EXISTS {table}")
        self._opened.clear()
