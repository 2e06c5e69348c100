"""Keyed state over rows in their own order, however the stream delivers them.

Rows of a key wait on a page, a single state value, while there are ``PAGE_ROWS`` of them at most, and in buckets of a map
state as soon as there are more: each call to the state is a message to the JVM, so a small key has one page and one timer
however many buckets its rows belong to. A bucket is folded when the watermark has passed its end, on the page too, so each row is
seen after all rows before it, whatever batches they came in; where rows need not wait, or have no event time, the
buckets are folded at the end of each batch. A call holds one Arrow batch, one page or one bucket, never what a key has in a batch or in the stream.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping
from dataclasses import dataclass
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Rows of a key that may wait on its page.
PAGE_ROWS = 4096
Rows = list[tuple]
Step = Callable[[Rows, tuple | None, int], tuple[Rows, tuple | None]]


@dataclass(frozen=True)
class Fold:
    """What is folded: ``fields`` (name to type) in the order in which rows sort, the first one being time or number.

    ``step(rows, state, until)`` gets the sorted rows of a bucket, or of neighbouring ones, and the end of the last; ``closes(state)`` is the time at which
    the series of a key is over if nothing comes before it, and ``finish(state)`` what comes out then.
    """

    fields: Mapping[str, str]
    state: str
    step: Step
    closes: Callable[[tuple], int | None] = lambda _: None
    finish: Callable[[tuple], Rows] = lambda _: []


class _Ordered(StatefulProcessor):
    def __init__(self, fold: Fold, bucket: int, wait: bool, names: list[str]) -> None:
        self.fold, self.bucket, self.wait, self.names = fold, bucket, wait, names

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        columns = ", ".join(f"{n} array<{t}>" for n, t in self.fold.fields.items())
        self.page = handle.getValueState("page", f"spilled boolean, {columns}")
        self.waiting = handle.getMapState("waiting", "bucket bigint", columns)
        self.held = handle.getValueState("held", self.fold.state)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        names = list(self.fold.fields)
        spilled, waiting = self._page()
        known, before = len(waiting), spilled
        for frame in rows:
            # Rows without time or number have no place in the order.
            fresh = [row for row in zip(*(_plain(frame[n]) for n in names), strict=True) if row[0] is not None]
            if not spilled and len(waiting) + len(fresh) <= PAGE_ROWS:
                waiting += fresh
            else:
                self._spill(waiting + fresh)
                spilled, waiting = True, []
        if spilled:
            if not before:
                self.page.update((True, *([] for _ in names)))
        elif len(waiting) > known:
            self.page.update((False, *map(list, zip(*waiting, strict=True))))
            if self.wait:
                first = min(self._buckets(waiting))
                if not known or first < min(self._buckets(waiting[:known])):
                    self.handle.registerTimer((first + 1) * self.bucket)
        if not self.wait:
            yield from self._folded(key, None, timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key: tuple, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        # The first timer of a key does what the watermark allows; the others of the same batch find nothing left.
        passed = max(expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs())
        yield from self._folded(key, passed, passed)

    def _page(self) -> tuple[bool, Rows]:
        """Whether the key's rows have gone to buckets, and the rows of its page."""
        page = self.page.get()
        return (False, []) if page is None else (bool(page[0]), list(zip(*page[1:], strict=True)))

    def _buckets(self, rows: Rows) -> list[int]:
        return [int(row[0] // self.bucket) for row in rows]

    def _spill(self, rows: Rows) -> None:
        """Put rows into the buckets of the map state."""
        parts: dict[int, Rows] = {}
        for bucket, row in zip(self._buckets(rows), rows, strict=True):
            parts.setdefault(bucket, []).append(row)
        for bucket, part in parts.items():
            before = self.waiting.getValue((bucket,))
            columns = tuple(map(list, zip(*part, strict=True)))
            self.waiting.updateValue((bucket,), columns if before is None else tuple([*b, *c] for b, c in zip(before, columns, strict=True)))
            if self.wait and before is None:
                self.handle.registerTimer((bucket + 1) * self.bucket)

    def _ready(self, until: int | None) -> Iterator[tuple[Rows, int]]:
        """Rows to fold by ``until`` with the end of their last bucket, taken out of the state; returns the first bucket that is left."""
        spilled, waiting = self._page()
        if spilled:
            buckets = sorted(int(k[0]) for k in self.waiting.keys())
            ready = [b for b in buckets if until is None or (b + 1) * self.bucket <= until]
            for bucket in ready:
                yield list(zip(*self.waiting.getValue((bucket,)), strict=True)), (bucket + 1) * self.bucket
                self.waiting.removeKey((bucket,))
            if len(ready) < len(buckets):
                return buckets[len(ready)]
            self.page.clear()
            return None
        buckets = self._buckets(waiting)
        ready = [until is None or (b + 1) * self.bucket <= until for b in buckets]
        if any(ready):
            yield [row for row, now in zip(waiting, ready, strict=True) if now], (max(b for b, now in zip(buckets, ready, strict=True) if now) + 1) * self.bucket
        if all(ready):
            if waiting:
                self.page.clear()
            return None
        first = min(b for b, now in zip(buckets, ready, strict=True) if not now)
        if any(ready):
            self.page.update((False, *map(list, zip(*(row for row, now in zip(waiting, ready, strict=True) if not now), strict=True))))
            if self.wait:
                self.handle.registerTimer((first + 1) * self.bucket)
        return first

    def _folded(self, key: tuple, until: int | None, watermark: int) -> Iterator[pd.DataFrame]:
        """Fold all buckets that end by ``until`` (all there are without one), then see whether the series is over by now."""
        state = self.held.get()
        state = None if state is None else tuple(state)
        before, ready, left = state, self._ready(until), None
        while True:
            try:
                rows, end = next(ready)
            except StopIteration as over:
                left = over.value
                break
            out, state = self.fold.step(sorted(rows, key=_sort_key), state, end)
            if out:
                yield self._frame(key, out)
        due = None if state is None else self.fold.closes(state)
        if due is not None and due <= watermark and not (left is not None and left * self.bucket < due):
            out, state = self.fold.finish(state), None
            if out:
                yield self._frame(key, out)
        elif due is not None and state != before:
            self.handle.registerTimer(due)
        if state is not None:
            if state != before:
                self.held.update(state)
        elif before is not None:
            self.held.clear()

    def _frame(self, key: tuple, out: Rows) -> pd.DataFrame:
        return pd.DataFrame([(*key, *o) for o in out], columns=self.names)

    def close(self) -> None:
        """Nothing is held outside the state."""


def _plain(column: pd.Series) -> list:
    return [None if v is None or v != v else v for v in column.tolist()]


def _sort_key(row: tuple) -> tuple:
    return tuple((v is not None, v) for v in row)


def ordered_state(rows: DataFrame, key: str, fold: Fold, output: str, bucket: int, lateness: str | None, wait: bool = False) -> DataFrame:
    """Fold the rows of each ``key`` in order; ``output`` names the key first, then what the fold gives.

    With ``lateness`` the first field is event time in milliseconds and rows later than that behind the newest one
    are dropped; without, it is a number that grows from batch to batch. Where the batches themselves are in order,
    rows are folded at the end of the batch that brings them; with ``wait`` they are folded when the watermark has
    passed, so that their order does not depend on how late they come. ``bucket`` is the width of a bucket in its unit:
    a key's rows in one bucket, or ``PAGE_ROWS`` rows, are what memory must hold. The session's state goes to RocksDB, which map states and
    timers need and which keeps it on disk.
    """
    rows.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    names = [part.split()[0] for part in output.split(", ")]
    first = next(iter(fold.fields))
    timed = rows.select(key, *fold.fields)
    if lateness:
        # Rows at the watermark count as late, and it starts at 0, where media begin.
        timed = timed.withColumn("ts", F.timestamp_millis(F.col(first).cast("long") + 1)).withWatermark("ts", lateness)
    processor = _Ordered(fold, bucket, wait and bool(lateness), names)
    return timed.groupBy(key).transformWithStateInPandas(processor, output, "Append", "EventTime" if lateness else "None")
