"""Comparisons inside buckets of any size, in groups of bounded size."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cuelattice.llm.records import arrow_batches
from cuelattice.session import cut_lineage

Arrays = dict[str, np.ndarray]
#: Rows against rows that one call of a comparison sees, unless a single group has more.
SQUARES = 1 << 22


def _column(array: pa.Array) -> np.ndarray:
    """Numbers as they are; lists as a matrix, or as single arrays if their lengths differ."""
    if not pa.types.is_list(array.type):
        return array.to_numpy(zero_copy_only=False)
    flat, ends = np.asarray(array.flatten()), np.cumsum(array.value_lengths().to_numpy())
    if len(flat) == len(array) * ends[0]:
        return flat.reshape(len(array), -1)
    return _single(np.split(flat, ends[:-1]))


def _single(rows: Sequence[np.ndarray]) -> np.ndarray:
    held = np.empty(len(rows), dtype=object)
    for k, row in enumerate(rows):
        held[k] = row
    return held


def _joined(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.concatenate((a, b)) if a.shape[1:] == b.shape[1:] else np.concatenate([x if x.ndim == 1 else _single(list(x)) for x in (a, b)])


def whole_groups(batches: Iterator[pa.RecordBatch], key: Sequence[str], most: int) -> Iterator[tuple[Arrays, np.ndarray, np.ndarray]]:
    """Arrays of whole groups, with the starts and sizes of the groups in them, from batches sorted by ``key``.

    Of a group of more than ``most`` rows the first ``most + 1`` are kept, so memory does not depend on it.
    """
    held: Arrays = {}
    for batch in batches:
        if not batch.num_rows:
            continue
        now = {name: _column(batch.column(name)) for name in batch.schema.names}
        held = {name: _joined(held[name], now[name]) for name in now} if held else now
        change = np.zeros(len(held[key[0]]) - 1, dtype=bool)
        for name in key:
            change |= held[name][1:] != held[name][:-1]
        starts = np.concatenate(([0], np.flatnonzero(change) + 1))
        last = starts[-1]
        if last:
            yield {k: x[:last] for k, x in held.items()}, starts[:-1], np.diff(starts)
        held = {k: x[last : last + most + 1] for k, x in held.items()}
    if held:
        yield held, np.zeros(1, dtype=np.int64), np.array([len(held[key[0]])])


def _bounded(starts: np.ndarray, sizes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Groups in runs of at most ``SQUARES`` possible links, so that what is held of the links does not depend on their number."""
    ends = np.flatnonzero(np.diff(np.cumsum(sizes.astype(np.int64) ** 2) // SQUARES)) + 1
    return zip(np.split(starts, ends), np.split(sizes, ends), strict=True)


def bucket_pairs(
    rows: DataFrame, bucket: Sequence[str], node: str, compare: Callable[[Arrays, np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]], most: int = 2048,
) -> DataFrame:
    """Links (a, b) of long nodes that ``compare`` finds between rows of a bucket.

    ``compare`` gets arrays of whole groups with the starts and sizes of the groups of two rows or more, and returns
    the two ends of the links; where the column ``_side`` has both 0 and 1 in a group, links between the sides
    suffice. Rows are dealt and sorted by bucket once and each bucket is compared as it streams by. A bucket of more
    than ``most`` rows is only noted there. Its rows are dealt again: it has ceil(rows / most) blocks, and each pair
    of blocks is a group of its own, so every two rows of a bucket meet and no task holds more than two blocks.
    """
    names = list(rows.columns)
    arrow_batches(rows.sparkSession)

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held, starts, sizes in whole_groups(batches, bucket, most):
            fit, over = (sizes > 1) & (sizes <= most), starts[sizes > most]
            for some, their in _bounded(starts[fit], sizes[fit]):
                a, b = compare(held, some, their) if len(some) else (np.zeros(0, np.int64),) * 2
                pad = np.zeros(len(over), np.int64)
                ends = [pa.array(np.concatenate((a, pad)), pa.int64()), pa.array(np.concatenate((b, pad)), pa.int64())]
                keys = [pa.array(np.concatenate((np.zeros(len(a), np.int64), held[k][over])), pa.int64()) for k in bucket]
                yield pa.RecordBatch.from_arrays([*ends, pa.array(np.arange(len(a) + len(over)) >= len(a)), *keys], ["a", "b", "over", *bucket])
                over = over[:0]

    schema = "a long, b long, over boolean, " + ", ".join(f"{k} long" for k in bucket)
    dealt = rows.repartition(*bucket).sortWithinPartitions(*bucket)
    found = cut_lineage(dealt.mapInArrow(first, schema).distinct())
    links = found.where("not over").select("a", "b").distinct()
    large = found.where("over").select(*bucket)
    if not large.take(1):
        return links
    sizes = rows.join(large, list(bucket)).groupBy(*bucket).agg(F.ceil(F.count("*") / most).cast("int").alias("_blocks"))
    other = F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1))
    blocks = rows.join(sizes, list(bucket)).withColumn("_own", F.pmod(F.xxhash64(node), F.col("_blocks")).cast("int")).withColumn("_other", other)
    group = [*bucket, "_i", "_j"]
    pairs = blocks.select(
        *names, F.least("_own", "_other").cast("long").alias("_i"), F.greatest("_own", "_other").cast("long").alias("_j"),
        F.when(F.col("_own") <= F.col("_other"), 0).otherwise(1).alias("_side"))

    def second(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held, starts, sizes in whole_groups(batches, group, 1 << 40):
            several = sizes > 1
            for some, their in _bounded(starts[several], sizes[several]) if several.any() else ():
                a, b = compare(held, some, their)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    again = pairs.repartition(*group).sortWithinPartitions(*group).mapInArrow(second, "a long, b long")
    return cut_lineage(links.union(again).distinct())

