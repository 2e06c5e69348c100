"""A user's frame model over PCM: framed audio in, one score per frame out."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import groupby
from typing import Any, Protocol

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from cuelattice.kernel.scan import Running, running

#: Samples of a frame and of what the model sees before it, and samples a second.
FRAME, CONTEXT, RATE = 512, 64, 16_000
#: Frames that one call of a model gets at most.
BATCH_FRAMES = 256


class Scorer(Protocol):
    """What a model is inside a task."""

    def start(self) -> Any:
        """State before the first frame of an asset."""

    def predict(self, windows: np.ndarray, state: Any) -> tuple[np.ndarray, Any]:
        """Scores of consecutive frames (each row is the context before a frame and the frame) and the state after them."""


@dataclass(frozen=True)
class FrameModel:
    """Model bytes, broadcast, and how a worker makes a scorer of them. A worker makes one and keeps it."""

    payload: Broadcast
    build: Callable[[bytes], Scorer]

    def built(self) -> Scorer:
        key = (len(self.payload.value), hash(self.payload.value), self.build.__module__, self.build.__qualname__)
        if key not in _SCORERS:
            _SCORERS[key] = self.build(self.payload.value)
        return _SCORERS[key]


_SCORERS: dict[tuple, Scorer] = {}


def frame_model(spark: SparkSession, payload: bytes, build: Callable[[bytes], Scorer], most_bytes: int = 256 << 20) -> FrameModel:
    """Broadcast a model of at most ``most_bytes``."""
    if len(payload) > most_bytes:
        raise ValueError(f"{len(payload)} bytes are too many for a broadcast model")
    return FrameModel(spark.sparkContext.broadcast(payload), build)


@dataclass(frozen=True)
class PeakTable:
    """Tabled model: the score of the largest magnitude's step, drawn half-way from the score before.

    Stands for a recurrent network where scores are known: it sees the context and carries a state.
    """

    table: tuple[float, ...]

    @classmethod
    def build(cls, payload: bytes) -> PeakTable:
        return cls(tuple(np.frombuffer(payload, dtype="<f8").tolist()))

    def start(self) -> float:
        return 0.0

    def predict(self, windows: np.ndarray, state: float) -> tuple[np.ndarray, float]:
        steps = np.minimum((np.abs(windows).max(axis=1) * len(self.table)).astype(int), len(self.table) - 1)
        out = np.empty(len(windows))
        for k, value in enumerate(np.asarray(self.table)[steps]):
            state = out[k] = 0.5 * state + 0.5 * value
        return out, state


class _Section:
    """Samples of one section of an asset, cut into windows as they stream by."""

    def __init__(self, scorer: Scorer, first: int, warm: int, end: int | None) -> None:
        self.scorer, self.state = scorer, scorer.start()
        self.frame, self.first, self.end = warm, first, end
        self.at = warm * FRAME - CONTEXT
        self.held = np.zeros(CONTEXT, dtype=np.float32) if warm == 0 else np.zeros(0, dtype=np.float32)
        self.known = self.at + len(self.held)

    def add(self, base: int, samples: np.ndarray) -> Iterator[tuple[int, np.ndarray, int]]:
        """Frames that samples from ``base`` on complete: (first frame, scores, samples of the last frame)."""
        fresh = samples[max(0, self.known - base) :]
        if len(fresh):
            self.held = np.concatenate((self.held, fresh))
            self.known += len(fresh)
            yield from self._score((len(self.held) - CONTEXT) // FRAME)

    def _score(self, ready: int) -> Iterator[tuple[int, np.ndarray, int]]:
        if self.end is not None:
            ready = min(ready, self.end - self.frame)
        while ready > 0:
            n = min(ready, BATCH_FRAMES)
            windows = np.lib.stride_tricks.sliding_window_view(self.held, CONTEXT + FRAME)[: n * FRAME : FRAME]
            scores, self.state = self.scorer.predict(windows, self.state)
            skip = max(0, self.first - self.frame)
            if skip < n:
                yield self.frame + skip, np.clip(scores[skip:], 0.0, 1.0), FRAME
            self.held = self.held[n * FRAME :]
            self.frame += n
            ready -= n

    def close(self) -> Iterator[tuple[int, np.ndarray, int]]:
        """The last frame of an asset may be short; silence fills it up."""
        rest = len(self.held) - CONTEXT
        if rest > 0 and (self.end is None or self.frame < self.end):
            self.held = np.concatenate((self.held, np.zeros(FRAME - rest, dtype=np.float32)))
            for frame, scores, _ in self._score(1):
                yield frame, scores, rest


def score_frames(pcm: DataFrame, model: FrameModel, section_frames: int | None = None, warm_up: int = 64) -> DataFrame:
    """One score in 0..1 for every frame of 512 samples; the last one of an asset may be shorter.

    ``pcm(asset_id, chunk_no, samples)`` holds chunks of any length in order; null or empty chunks add nothing, and
    samples that are not finite raise an error, as a model's answer to them means nothing. Returns ``asset_id``,
    ``frame_idx``, ``sample_count``, ``at_ms``, ``end_ms`` and ``probability``. An empty table gives none.

    A model with a state sees the frames of an asset one after the other, so by default an asset streams through one
    task. With ``section_frames`` an asset of any length is scored in sections in parallel, each after ``warm_up``
    frames of the one before that only set the state; that is exact for models whose memory is no longer. Chunks are
    numbered by a chunked running sum and dealt once; a task holds one Arrow batch and one call of the model.
    """
    whole = pcm.select("asset_id", "chunk_no", F.col("samples").cast("array<float>").alias("samples")).where(F.size("samples") > 0)
    placed = running(whole.withColumn("__n", F.size("samples")), ["asset_id"], ["chunk_no"], [Running("__end", "sum", F.col("__n"))], F.expr("chunk_no DIV 4096"))
    based = placed.select("asset_id", F.expr("__end - __n").cast("long").alias("base"), F.col("__end").cast("long").alias("until"), "samples")
    if section_frames is None:
        dealt = based.withColumn("section", F.lit(0).cast("long"))
    else:
        wide, before = section_frames * FRAME, warm_up * FRAME + CONTEXT
        dealt = based.withColumn("section", F.explode(F.expr(f"sequence(base DIV {wide}, (until - 1 + {before}) DIV {wide})")))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = model.built()
        names = ("asset_id", "section", "base", "samples")

        def rows() -> Iterator[tuple[Any, int, int, np.ndarray]]:
            for batch in batches:
                asset, section, base, samples = (batch.column(batch.schema.get_field_index(n)) for n in names)
                flat, ends = samples.flatten().to_numpy(), np.append(0, np.cumsum(samples.value_lengths().to_numpy()))
                for k, (a, s, b) in enumerate(zip(asset.to_pylist(), section.to_pylist(), base.to_pylist(), strict=True)):
                    yield a, s, b, flat[ends[k] : ends[k + 1]]

        def out(asset: Any, found: tuple[int, np.ndarray, int]) -> pa.RecordBatch:
            frame, scores, samples = found
            count = np.full(len(scores), FRAME)
            count[-1] = samples
            return pa.RecordBatch.from_arrays(
                [pa.array([asset] * len(scores), kind), pa.array(np.arange(frame, frame + len(scores)), pa.int64()), pa.array(count, pa.int64()), pa.array(scores, pa.float64())],
                ["asset_id", "frame_idx", "sample_count", "probability"])

        for (asset, section), chunks in groupby(rows(), key=lambda r: (r[0], r[1])):
            first = section * (section_frames or 0)
            stream = _Section(scorer, first, max(0, first - warm_up) if section_frames else 0, first + section_frames if section_frames else None)
            for _, _, base, samples in chunks:
                if not np.isfinite(samples).all():
                    raise ValueError(f"asset {asset}: samples that are not finite")
                for found in stream.add(base, np.clip(samples, -1.0, 1.0)):
                    yield out(asset, found)
            for found in stream.close():
                yield out(asset, found)

    kind = to_arrow_type(dealt.schema["asset_id"].dataType)
    ordered = dealt.repartition("asset_id", "section").sortWithinPartitions("asset_id", "section", "base")
    scored = ordered.mapInArrow(score, f"asset_id {dealt.schema['asset_id'].dataType.simpleString()}, frame_idx long, sample_count long, probability double")
    return scored.select(
        "asset_id", "frame_idx", "sample_count", F.expr(f"frame_idx * {FRAME} * 1000 DIV {RATE}").alias("at_ms"),
        F.expr(f"((frame_idx * {FRAME} + sample_count) * 1000 + {RATE - 1}) DIV {RATE}").alias("end_ms"), "probability")
