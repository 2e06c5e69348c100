"""Ordered scans over keyed series, also when one key holds a large share of all rows.

Two plans give the same result. While every key is known to be small the scan is
a plain window over the key. Otherwise the series is cut into time chunks: the
window runs inside ``(keys, chunk)``, each chunk yields one small total, and the
totals of earlier chunks are carried into its rows, so no task sees a whole key.

``sized_for`` measures the inputs once, and scans far below their limit rely on that;
the others, and scans outside of it, measure their own input.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from contextlib import contextmanager
from contextvars import ContextVar
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cuelattice.session import cut_lineage

CHUNK_MS = 600_000
KEY_ROWS = 1_000_000
#: Rows that an operator derives from one source row at most when a measured source stands for its frames.
FAN_OUT = 16
#: Rows that one task should get of a table dealt by its keys.
PART_ROWS = 250_000
#: ``fan_out`` of tables measured in bytes of text: a task gets a megabyte.
TEXT_SHARE = 0.25
_CHUNK = "__chunk"
_HOT: ContextVar[bool | int | None] = ContextVar("hot_keys", default=None)
_ROWS: ContextVar[int] = ContextVar("measured_rows", default=0)


def has_hot_key(df: DataFrame, keys: Sequence[str], limit: int = KEY_ROWS, weight: Column | None = None) -> bool:
    """Whether some key has more than ``limit`` rows (or summed ``weight``); one map-side combined count."""
    rows = F.count(F.lit(1)) if weight is None else F.sum(weight)
    return bool(df.groupBy(*keys).agg(rows.alias("__rows")).where(F.col("__rows") > limit).take(1))


@contextmanager
def hot_keys(hot: bool) -> Iterator[None]:
    """Fix the plan choice for every scan built inside."""
    token = _HOT.set(hot)
    try:
        yield
    finally:
        _HOT.reset(token)


def key_sizes(df: DataFrame, keys: Sequence[str], weight: Column | None = None) -> tuple[int, int]:
    """Rows (or summed ``weight``) of the largest key and of all; one map-side combined count."""
    rows = F.count(F.lit(1)) if weight is None else F.sum(weight)
    largest, every = df.groupBy(*keys).agg(rows.alias("__rows")).agg(F.max("__rows"), F.sum("__rows")).first()
    return int(largest or 0), int(every or 0)


@contextmanager
def sized_for(*inputs: tuple) -> Iterator[None]:
    """Measure ``(df, keys)`` or ``(df, keys, weight)`` inputs once for the plan choices of the block.

    A scan in it is cold without further ado if the largest key times ``FAN_OUT`` stays below that scan's own limit;
    otherwise the scan measures the frame it is about to read. Inside ``hot_keys`` nothing is measured.
    """
    if isinstance(_HOT.get(), bool):
        yield
        return
    sizes = [key_sizes(i[0], i[1], i[2] if len(i) > 2 else None) for i in inputs]
    token, counted = _HOT.set(max((s[0] for s in sizes), default=0)), _ROWS.set(max((s[1] for s in sizes), default=0))
    try:
        yield
    finally:
        _HOT.reset(token)
        _ROWS.reset(counted)


def is_hot(df: DataFrame, keys: Sequence[str], limit: int = KEY_ROWS) -> bool:
    """Whether a key of ``df`` may have more than ``limit`` rows; ``hot_keys`` fixes the answer."""
    known = _HOT.get()
    if isinstance(known, bool):
        return known
    if known is not None and known * FAN_OUT <= limit:
        return False
    return has_hot_key(df, keys, limit)


def gathered() -> bool:
    """Whether scans are known to be plain windows here, which leave all rows of their keys in one task."""
    known = _HOT.get()
    return known is not None and (not known if isinstance(known, bool) else known * FAN_OUT <= KEY_ROWS)


def dealt(df: DataFrame, keys: Sequence[str], fan_out: float = 2, meet: bool = True) -> DataFrame:
    """Rows of a key in one task, before they fan out, so that scans over the keys shuffle narrow sources and not what comes of them.

    The number of tasks follows the rows that ``sized_for`` measured, times ``fan_out``. All tables dealt by one key in
    its block meet without a further shuffle, with ``meet`` also where a join asks for more columns than the key: Spark is
    told in the session that both sides may stay where the key alone has put them. Without it joins deal anew by all their columns,
    which clips do better with. Unmeasured tables, and those with a large key, stay as they are.
    """
    known = _HOT.get()
    if known is None or isinstance(known, bool) or known * FAN_OUT > KEY_ROWS:
        return df
    df.sparkSession.conf.set("spark.sql.requireAllClusterKeysForCoPartition", str(not meet).lower())
    least = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(max(least, math.ceil(_ROWS.get() * fan_out / PART_ROWS)), *keys)


@dataclass(frozen=True)
class Running:
    """One running value. ``kind`` is sum, count, max, min or last (last non-null)."""

    name: str
    kind: str
    value: Column
    inclusive: bool = True
    reverse: bool = False


def time_chunk(column: str | Column, width: int = CHUNK_MS) -> Column:
    return F.floor(F.col(column) / F.lit(width)) if isinstance(column, str) else F.floor(column / F.lit(width))


_OVER = {
    "sum": F.sum,
    "count": F.count,
    "max": F.max,
    "min": F.min,
    "last": lambda c: F.last(c, ignorenulls=True),
}


def _chunk_total(spec: Running, value: str, order: Sequence[str]) -> Column:
    if spec.kind != "last":
        return _OVER[spec.kind](F.col(value))
    rank = F.when(F.col(value).isNotNull(), F.struct(*order))
    return (F.min_by if spec.reverse else F.max_by)(F.col(value), rank)


def _merge(spec: Running, near: Column, far: Column) -> Column:
    if spec.kind in ("sum", "count"):
        return F.when(near.isNull() & far.isNull(), None).otherwise(
            F.coalesce(near, F.lit(0)) + F.coalesce(far, F.lit(0))
        )
    if spec.kind == "last":
        return F.coalesce(near, far)
    return (F.greatest if spec.kind == "max" else F.least)(near, far)


def running(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    specs: Sequence[Running],
    chunk: Column,
) -> DataFrame:
    """Add one column per spec.

    ``order`` names columns sorted ascending and must be a total order; ``chunk``
    must not decrease along it. Keys must not be null.
    """
    keys = list(keys)
    order = list(order)
    names = [spec.name for spec in specs]
    keep = [c for c in df.columns if c not in names] + names
    ascending = [F.col(name) for name in order]
    descending = [F.col(name).desc_nulls_last() for name in order]

    def over(spec: Running, value: Column, *groups: str) -> Column:
        rows = Window.partitionBy(*groups).orderBy(*(descending if spec.reverse else ascending))
        upper = Window.currentRow if spec.inclusive else -1
        return _OVER[spec.kind](value).over(rows.rowsBetween(Window.unboundedPreceding, upper))

    if not is_hot(df, keys):
        return df.withColumns({s.name: over(s, s.value, *keys) for s in specs}).select(*keep)

    base = cut_lineage(df.withColumn(_CHUNK, chunk).withColumns({f"__v{i}": s.value for i, s in enumerate(specs)}))
    local, totals, carried, merged = {}, [], [], {}
    for i, spec in enumerate(specs):
        local[f"__n{i}"] = over(spec, F.col(f"__v{i}"), *keys, _CHUNK)
        totals.append(_chunk_total(spec, f"__v{i}", order).alias(f"__t{i}"))
        chunks = Window.partitionBy(*keys).orderBy(
            F.col(_CHUNK).desc() if spec.reverse else F.col(_CHUNK)
        ).rowsBetween(Window.unboundedPreceding, -1)
        total_kind = "sum" if spec.kind == "count" else spec.kind
        carried.append(_OVER[total_kind](F.col(f"__t{i}")).over(chunks).alias(f"__f{i}"))
        merged[spec.name] = _merge(spec, F.col(f"__n{i}"), F.col(f"__f{i}"))

    far = base.groupBy(*keys, _CHUNK).agg(*totals).select(*keys, _CHUNK, *carried)
    far = far.where(" OR ".join(f"__f{i} IS NOT NULL" for i in range(len(specs))))
    return base.withColumns(local).join(far, [*keys, _CHUNK], "left").withColumns(merged).select(*keep)


def as_of(
    queries: DataFrame,
    frames: DataFrame,
    keys: Sequence[str],
    query_time: str,
    frame_time: str,
    payload: Sequence[str],
    tie: Sequence[str] = (),
    width: int = CHUNK_MS,
    previous: str | None = "prev",
    following: str | None = "next",
    strict_previous: bool = False,
) -> DataFrame:
    """Attach the frame at or before (``previous``) and strictly after (``following``)
    each query time as structs ``(frame_time, *payload)``. Linear in both inputs:
    queries and frames are merged into one ordered series and scanned.

    ``tie`` are frame columns that order frames of equal time; the last one wins.
    With ``strict_previous`` frames at exactly the query time count as following.
    """
    fields = [frame_time, *payload]
    frame_struct = F.struct(*fields)
    frame_side = frames.select(
        *keys,
        F.col(frame_time).alias("__at"),
        F.lit(1 if strict_previous else 0).alias("__side"),
        *[F.col(t).alias(f"__tie{i}") for i, t in enumerate(tie)],
        frame_struct.alias("__frame"),
    )
    asked = [c for c in queries.columns if c not in keys]
    query_side = queries.select(
        *keys,
        F.col(query_time).alias("__at"),
        F.lit(0 if strict_previous else 1).alias("__side"),
        F.struct(*asked).alias("__query"),
    )
    shown = [F.col(c) if c in keys else F.col(f"__query.{c}") for c in queries.columns]
    merged = frame_side.unionByName(query_side, allowMissingColumns=True)
    order = ["__at", "__side", *[f"__tie{i}" for i in range(len(tie))]]
    specs = []
    if previous:
        specs.append(Running(previous, "last", F.col("__frame")))
    if following:
        specs.append(Running(following, "last", F.col("__frame"), reverse=True))
    scanned = running(merged, keys, order, specs, time_chunk("__at", width)).where("__query IS NOT NULL")
    return scanned.select(*shown, *[s.name for s in specs])


def nearest_rank(
    df: DataFrame, keys: Sequence[str], value: str, fractions: dict[str, float], width: float = 1.0
) -> DataFrame:
    """Exact nearest-rank quantiles ``sorted[round((n-1)*q)]`` per key.

    Equal values are counted first, so the scan runs over distinct values, cut
    into chunks of the value range.
    """
    counted = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("__n"))
    ranked = running(
        counted, keys, [value], [Running("__upto", "sum", F.col("__n"))], F.floor(F.col(value) / F.lit(width))
    )
    sizes = counted.groupBy(*keys).agg(F.sum("__n").alias("__size"))
    picked = ranked.join(sizes, list(keys))
    columns = []
    for name, q in fractions.items():
        rank = F.floor((F.col("__size") - 1) * F.lit(q) + F.lit(0.5)) + 1
        hit = (F.col("__upto") >= rank) & (F.col("__upto") - F.col("__n") < rank)
        columns.append(F.max(F.when(hit, F.col(value))).alias(name))
    return picked.groupBy(*keys).agg(F.max("__size").alias("n_values"), *columns)


def with_halo(
    df: DataFrame, keys: Sequence[str], position: str, before: int, after: int, width: int
) -> tuple[DataFrame, list[str]]:
    """Rows plus copies in neighbouring cells, for windows that look at most ``before``/``after`` back/ahead.

    Returns the frame and the partition columns; keep only rows with ``__core`` after the window.
    """
    if not is_hot(df, keys):
        return df.withColumn("__core", F.lit(True)), list(keys)
    reach = F.expr(f"sequence(floor(({position} - {before}) / {width}), floor(({position} + {after}) / {width}))")
    spread = df.withColumn("__cell", F.explode(reach))
    return spread.withColumn("__core", F.expr(f"__cell = floor({position} / {width})")), [*keys, "__cell"]
