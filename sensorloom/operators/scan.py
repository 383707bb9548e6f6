"""Ordered prefix scans and lookups that stay balanced under skew.

A window over ``partitionBy(key).orderBy(...)`` puts a whole key into one task. Here
rows are cut into range slices over (key, order), so a key that holds a third of all
rows spans many slices. Each slice is reduced to one small row per key, the small rows
are scanned, and every slice then continues from the value carried into it.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sensorloom.runtime import default_slices, materialize

SLICE = "_slice"


@dataclass(frozen=True)
class Sliced:
    """Rows with their slice number, written once so that all readers agree on it."""

    rows: DataFrame
    keys: list[str]
    order: list[str]

    def select(self, *columns) -> "Sliced":
        return Sliced(self.rows.select(*columns, SLICE), self.keys, self.order)


@dataclass(frozen=True)
class Running:
    """A running maximum or sum.

    ``inclusive`` counts the row itself. ``seed`` names a column of the seeds table
    holding the value from before the first row of a key.
    """

    value: Column
    kind: str = "max"
    inclusive: bool = False
    seed: str | None = None

    def aggregate(self, value: Column) -> Column:
        return F.max(value) if self.kind == "max" else F.sum(value)

    def combine(self, *parts: Column) -> Column:
        if self.kind == "max":
            return F.greatest(*parts)
        return reduce(lambda a, b: a + b, [F.coalesce(p, F.lit(0)) for p in parts])


def slice_rows(df: DataFrame, keys: list[str], order: list[str], slices: int | None = None) -> Sliced:
    """Cut rows into contiguous ranges of (keys, order) of about equal size.

    Keys must not be null. The slice number comes from sampled range bounds, so the
    result is written before anything reads it twice.
    """
    count = slices or default_slices(df.sparkSession)
    ranged = df.repartitionByRange(count, *keys, *order).withColumn(SLICE, F.spark_partition_id())
    return Sliced(materialize(ranged, "slices"), list(keys), list(order))


def running(sliced: Sliced, columns: dict[str, Running], seeds: DataFrame | None = None) -> DataFrame:
    """Add running columns; ``seeds`` has the keys and the named seed columns, one row per key.

    The result keeps the slice column, so a second scan can follow.
    """
    keys, rows = sliced.keys, sliced.rows
    edges = rows.groupBy(*keys, SLICE).agg(
        *[r.aggregate(r.value).alias(f"_edge_{name}") for name, r in columns.items()]
    )
    before = Window.partitionBy(*keys).orderBy(SLICE).rowsBetween(Window.unboundedPreceding, -1)
    carries = edges.select(
        *keys, SLICE, *[r.aggregate(F.col(f"_edge_{n}")).over(before).alias(f"_carry_{n}") for n, r in columns.items()]
    )
    if seeds is not None:
        carries = carries.join(seeds, keys, "left")
        for name, r in columns.items():
            if r.seed:
                carries = carries.withColumn(f"_carry_{name}", r.combine(F.col(f"_carry_{name}"), F.col(r.seed)))
        carries = carries.select(*keys, SLICE, *[f"_carry_{n}" for n in columns])
    inside = Window.partitionBy(*keys, SLICE).orderBy(*sliced.order)
    # The window needs this exchange of the rows anyway; hashing the few carries adds no sort.
    out = rows.join(carries.hint("shuffle_hash"), [*keys, SLICE], "left")
    computed = {}
    for name, r in columns.items():
        frame = inside.rowsBetween(Window.unboundedPreceding, 0 if r.inclusive else -1)
        computed[name] = r.combine(r.aggregate(r.value).over(frame), F.col(f"_carry_{name}"))
    return out.select(*rows.columns, *[c.alias(n) for n, c in computed.items()])


def continue_scan(sliced: Sliced, rows: DataFrame) -> Sliced:
    """Scan again over rows that kept their slice column."""
    return Sliced(rows, sliced.keys, sliced.order)


def lookup_join(rows: DataFrame, lookup: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """Left join ``rows`` to a lookup that has one row per key.

    The lookup is written first. So the join deals out both sides anew by key, and adaptive
    execution may cut the rows of a hot key into several tasks, each with a copy of its one
    lookup row; a lookup that turns out small is broadcast by Spark's own size check.
    """
    lookup = materialize(lookup.select(*keys, *values), "lookup")
    return rows.join(lookup, keys, "left").select(*rows.columns, *values)
