"""Interval algebra on keyed tables: islands, complement, binned overlap joins, step functions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cuelattice.kernel.scan import CHUNK_MS, Running, running, time_chunk


def mark_islands(
    df: DataFrame,
    keys: Sequence[str],
    start: str = "start_ms",
    end: str = "end_ms",
    gap: float = 0,
    tie: Sequence[str] = (),
    width: int = CHUNK_MS,
    strict: bool = False,
    name: str = "island_start",
) -> DataFrame:
    """Label every interval with the start of its island.

    An interval opens a new island when it starts more than ``gap`` after the
    running end (``strict``: at or beyond it).
    """
    order = [start, end, *tie]
    reach = running(df, keys, order, [Running("__reach", "max", F.col(end), inclusive=False)], time_chunk(start, width))
    limit = F.col("__reach") + F.lit(gap)
    opens = F.col("__reach").isNull() | ((F.col(start) >= limit) if strict else (F.col(start) > limit))
    marked = reach.withColumn("__open", F.when(opens, F.col(start)))
    out = running(marked, keys, order, [Running(name, "last", F.col("__open"))], time_chunk(start, width))
    return out.drop("__reach", "__open")


def merge_intervals(
    df: DataFrame,
    keys: Sequence[str],
    start: str = "start_ms",
    end: str = "end_ms",
    gap: float = 0,
    aggregates: Sequence[Column] = (),
    width: int = CHUNK_MS,
    strict: bool = False,
) -> DataFrame:
    """Union of intervals per key; ``aggregates`` are extra columns per island.

    Without aggregates equal starts are collapsed before the shuffle for the scan.
    """
    if not aggregates:
        df = df.groupBy(*keys, start).agg(F.max(end).alias(end))
    marked = mark_islands(df, keys, start, end, gap, width=width, strict=strict)
    return marked.groupBy(*keys, "island_start").agg(F.max(end).alias(end), *aggregates).withColumnRenamed(
        "island_start", start
    )


def complement(
    islands: DataFrame,
    spans: DataFrame,
    keys: Sequence[str],
    start: str = "start_ms",
    end: str = "end_ms",
    span_end: str = "duration_ms",
    width: int = CHUNK_MS,
) -> DataFrame:
    """Gaps between disjoint islands inside ``[0, span_end]``; keys without islands give nothing."""
    scanned = running(
        islands.select(*keys, start, end),
        keys,
        [start, end],
        [
            Running("__before", "max", F.col(end), inclusive=False),
            Running("__after", "last", F.col(start), inclusive=False, reverse=True),
        ],
        time_chunk(start, width),
    ).join(spans.select(*keys, span_end), list(keys))
    head = F.struct(F.coalesce(F.col("__before"), F.lit(0)).cast("long").alias(start), F.col(start).cast("long").alias(end))
    tail = F.when(
        F.col("__after").isNull(),
        F.struct(F.col(end).cast("long").alias(start), F.col(span_end).cast("long").alias(end)),
    )
    gaps = scanned.select(*keys, F.explode(F.array_compact(F.array(head, tail))).alias("__gap"))
    return gaps.select(*keys, f"__gap.{start}", f"__gap.{end}").where(F.col(end) > F.col(start))


def overlap_join(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    left_span: tuple[str, str],
    right_span: tuple[str, str],
    width: int,
    closed: bool = False,
) -> DataFrame:
    """Pairs of intervals that overlap, joined on ``(keys, bin)``.

    A long key is spread over its time bins, so no task holds a whole key. A pair
    is kept only in the later of the two first bins, hence exactly once. Right
    key columns are dropped; other names must not clash.
    """
    ls, le = (F.col(c) for c in left_span)
    rs, re = (F.col(c) for c in right_span)
    binned_left = left.withColumn("__lb", F.floor(ls / width)).withColumn(
        "__bin", F.explode(F.sequence(F.col("__lb"), F.greatest(F.col("__lb"), F.floor(le / width))))
    )
    binned_right = right.withColumn("__rb", F.floor(rs / width)).withColumn(
        "__bin", F.explode(F.sequence(F.col("__rb"), F.greatest(F.col("__rb"), F.floor(re / width))))
    )
    meets = ((le >= rs) & (ls <= re)) if closed else ((le > rs) & (ls < re))
    joined = binned_left.join(binned_right, [*keys, "__bin"]).where(
        (F.col("__bin") == F.greatest("__lb", "__rb")) & meets
    )
    return joined.drop("__bin", "__lb", "__rb")


def step_function(
    intervals: DataFrame,
    keys: Sequence[str],
    start: str,
    end: str,
    value: str,
    width: int = CHUNK_MS,
) -> DataFrame:
    """Slices ``(lo, hi, level)`` where level is the highest value covering the slice.

    Equal intervals are collapsed first; slices meet intervals through the binned join.
    """
    distinct = intervals.groupBy(*keys, start, end).agg(F.max(value).alias(value)).where(F.col(end) > F.col(start))
    cuts = distinct.select(*keys, F.explode(F.array(start, end)).alias("lo")).dropDuplicates([*keys, "lo"])
    slices = running(
        cuts, keys, ["lo"], [Running("hi", "last", F.col("lo"), inclusive=False, reverse=True)], time_chunk("lo", width)
    ).where("hi IS NOT NULL")
    covered = overlap_join(slices, distinct, keys, ("lo", "hi"), (start, end), width)
    return covered.groupBy(*keys, "lo", "hi").agg(F.max(value).alias("level"))
