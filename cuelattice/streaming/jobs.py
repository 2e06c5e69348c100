"""Structured Streaming forms of the stateful operators.

Every function takes and returns a streaming DataFrame. Event time and the
watermark (late rows are dropped) are additions of this engine.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cuelattice.operators import series as S
from cuelattice.streaming.ordered import Fold, ordered_state

#: Width of the buckets in which rows wait for their turn: time of a key, and numbers of a key without event time.
BUCKET_MS, BUCKET_ROWS = 60_000, 8192


def at_time(ms: str = "at_ms") -> F.col:
    """Media time as event time."""
    return F.timestamp_millis(F.col(ms).cast("long"))


def bucket_peaks_stream(points: DataFrame, bucket_ms: int = 250, lateness: str = "10 seconds") -> DataFrame:
    """Loudest sample of each tumbling bucket, earliest on ties."""
    timed = points.withColumn("ts", at_time()).withWatermark("ts", lateness)
    best = F.expr("max_by(struct(at_ms, loudness_db), struct(loudness_db, -at_ms))")
    return timed.groupBy("asset_id", F.window("ts", f"{bucket_ms} milliseconds")).agg(best.alias("b")).select("asset_id", "b.*")


def class_sessions_stream(frames: DataFrame, min_confidence: float, lateness: str = "10 seconds") -> DataFrame:
    """Sessions of confident classifier frames; the gap runs from the end of a frame's window."""
    timed = frames.where(F.col("s") >= min_confidence).withColumn("ts", at_time("t")).withWatermark("ts", lateness)
    session = F.session_window("ts", f"{S.CLASS_WINDOW_MS + S.CLASS_GAP_MS} milliseconds")
    events = timed.groupBy("asset_id", session).agg(
        F.min("t").alias("start_ms"), (F.max("t") + S.CLASS_WINDOW_MS).alias("end_ms"), F.max("s").alias("peak"), F.avg("s").alias("mean"),
        F.count(F.lit(1)).alias("frame_count"), F.expr("max_by(l, struct(s, -t))").alias("label"),
    )
    return events.where(f"frame_count >= 2 OR peak >= {S.STRONG_SINGLE}").selectExpr(
        "asset_id", "CASE WHEN label IN ('Giggle', 'Snicker') THEN 'giggle' ELSE 'laughter' END AS kind", "label", "start_ms", "end_ms",
        "peak AS confidence", "mean AS average_confidence", "frame_count")


def job_progress_stream(lines: DataFrame) -> DataFrame:
    """Latest progress values of each job, emitted at every ``progress=`` line."""

    def number(text: str):
        try:
            value = float(text)
        except ValueError:
            return None
        return value if 0 <= value < float("inf") else None

    def step(rows, state, _):
        frame, speed, encoded, exact = state or (None, None, 0, False)
        out = []
        for seq, line in rows:
            name, _, value = line.strip().partition("=")
            if name == "out_time_us" or (name == "out_time_ms" and not exact):
                encoded, exact = (int(value) if value.isdigit() else 0) // 1000, exact or name == "out_time_us"
            elif name == "frame":
                frame = int(value) if value.isdigit() else None
            elif name == "speed":
                speed = number(value.rstrip("x"))
            elif name == "progress" and value in ("continue", "end"):
                out.append((seq, encoded, frame, speed, value == "end"))
        return out, (frame, speed, encoded, exact)

    fold = Fold({"seq": "bigint", "line": "string"}, "frame long, speed double, encoded long, exact boolean", step)
    return ordered_state(lines, "job_id", fold, "job_id long, seq long, encoded_ms long, frame long, speed double, finished boolean", BUCKET_ROWS, None)


def speech_segments_stream(frames: DataFrame, lateness: str = "5 seconds", idle_ms: int = 1_000, bucket_ms: int = BUCKET_MS, wait: bool = False) -> DataFrame:
    """Online hysteresis: raw speech spans as they close; a timer closes the last one ``idle_ms`` after the last frame.

    Frames are taken in time order, as the batch form does; with ``wait`` also where they come late. Padding and merging of neighbouring spans follow as there.
    """

    def step(rows, state, _):
        speech, silence, last = state or (None, None, 0)
        out = []
        for at, end, p in rows:
            last = end
            if speech is None:
                if p >= S.OPEN_AT:
                    speech, silence = at, None
            elif p >= S.CLOSE_BELOW:
                silence = None
            else:
                silence = at if silence is None else silence
                if end - silence >= S.MIN_SILENCE_MS:
                    if silence - speech >= S.MIN_SPEECH_MS:
                        out.append((speech, silence))
                    speech, silence = None, None
        return out, (speech, silence, last)

    def finish(state):
        speech, _, last = state
        return [(speech, last)] if speech is not None and last - speech >= S.MIN_SPEECH_MS else []

    fold = Fold({"at_ms": "bigint", "end_ms": "bigint", "speech_probability": "double"}, "speech long, silence long, last long", step, lambda state: state[2] + idle_ms, finish)
    return ordered_state(frames, "asset_id", fold, "asset_id long, start_ms long, end_ms long", bucket_ms, lateness, wait)


def debounced_writes_stream(edits: DataFrame, delay_ms: int = 1_500, max_wait_ms: int = 15_000, lateness: str = "1 seconds", bucket_ms: int = BUCKET_MS, wait: bool = False) -> DataFrame:
    """Debounced autosave: a write once edits pause, at the latest after the maximum wait; a timer stands for the clock.

    With ``wait`` edits that come late are taken in their order of time.
    """

    def due(state):
        return min(state[1] + delay_ms, state[0] + max_wait_ms)

    def step(rows, state, _):
        out = []
        for at, revision in rows:
            if state is not None and at >= due(state):
                out.append((due(state), state[2]))
                state = None
            state = (at, at, revision) if state is None else (state[0], at, revision)
        return out, state

    fold = Fold({"at_ms": "bigint", "revision": "bigint"}, "first long, last long, pending long", step, due, lambda state: [(due(state), state[2])])
    return ordered_state(edits, "project_id", fold, "project_id long, written_at_ms long, revision long", bucket_ms, lateness, wait)


SMOOTHED = ("x", "y", "width", "height")
#: Least tolerance of each field around the window's median.
TOLERANCES = {"x": 0.006, "y": 0.006, "width": 0.01, "height": 0.01}


def robust_mean(values: np.ndarray, weights: np.ndarray, least: float) -> float:
    """Weighted mean of the values within three scaled median deviations of the median; the median if none weighs."""
    middle = float(np.median(values))
    near = np.abs(values - middle) <= max(least, 4.4478 * float(np.median(np.abs(values - middle))))
    mass = float(weights[near].sum())
    return float((values[near] * weights[near]).sum() / mass) if mass else middle


def smoothing_stream(samples: DataFrame, window_ms: int = 280, lateness_ms: int = 1_000, bucket_ms: int = BUCKET_MS) -> DataFrame:
    """Robust centred smoothing online, as ``smooth_samples`` of the camera operators does it for stored samples.

    ``samples(asset_id, time_ms, x, y, width, height, confidence, state)``. A sample is emitted once all of its window
    has come in order; what is left comes when a timer closes the series a window after its last sample. The state of
    an asset holds the samples that windows still to come need: those of two windows at most beside the bucket.
    """
    numbers = (*SMOOTHED, "confidence", "tracked")

    def smooth(held: list[np.ndarray], ready: slice) -> list[tuple]:
        times, confidence, tracked = held[0], held[5], held[6] > 0
        first, last = np.searchsorted(times, times - window_ms), np.searchsorted(times, times + window_ms, side="right")
        sure = np.where(tracked, np.maximum(0.2, confidence), 0.15)
        out = []
        for i in range(*ready.indices(len(times))):
            if last[i] - first[i] > 1:
                near = slice(first[i], last[i])
                weights = np.exp(-np.abs(times[near] - times[i]) / max(1, window_ms)) * sure[near]
                x, y, w, h = (robust_mean(column[near], weights, TOLERANCES[f]) for f, column in zip(SMOOTHED, held[1:5], strict=True))
            else:
                x, y, w, h = (float(column[i]) for column in held[1:5])
            w, h = min(1.0, max(1e-6, w)), min(1.0, max(1e-6, h))
            out.append((int(times[i]), min(1 - w / 2, max(w / 2, x)), min(1 - h / 2, max(h / 2, y)), w, h))
        return out

    def step(rows, state, until):
        fresh = [np.array(c) for c in zip(*rows, strict=True)]
        done, held = (0, fresh) if state is None else (state[0], [np.concatenate((np.array(a), b)) for a, b in zip(state[1:], fresh, strict=True)])
        # Later samples are at ``until`` or after it.
        ready = int(np.searchsorted(held[0], until - window_ms, side="left"))
        out = smooth(held, slice(done, ready))
        ready = max(done, ready)
        gone = int(np.searchsorted(held[0], held[0][ready] - window_ms)) if ready < len(held[0]) else int(np.searchsorted(held[0], until - window_ms))
        return out, (ready - gone, *(c[gone:].tolist() for c in held))

    def finish(state):
        return smooth([np.array(c) for c in state[1:]], slice(state[0], None))

    lists = "done long, time_ms array<long>, " + ", ".join(f"{n} array<double>" for n in numbers)
    fold = Fold({"time_ms": "bigint", **dict.fromkeys(numbers, "double")}, lists, step, lambda state: (state[1][-1] if state[1] else 0) + window_ms, finish)
    marked = samples.withColumn("tracked", (F.col("state") == "tracked").cast("double"))
    return ordered_state(marked, "asset_id", fold, "asset_id long, time_ms long, x double, y double, width double, height double", bucket_ms, f"{lateness_ms} milliseconds", wait=True)


def accept_revisions_stream(attempts: DataFrame) -> DataFrame:
    """Serial optimistic saves per project in arrival order."""

    def step(rows, state, _):
        head = state[0] if state else None
        out = []
        for number, base, checksum in rows:
            ok = base is None or (head is not None and base.strip().lower() == head.strip().lower())
            head = checksum if ok else head
            out.append((number, ok))
        return out, (head,)

    fold = Fold({"attempt_no": "bigint", "base_checksum": "string", "checksum": "string"}, "head string", step)
    return ordered_state(attempts, "project_id", fold, "project_id long, attempt_no long, accepted boolean", BUCKET_ROWS, None)
