"""Operators on frame, loudness, beat and classifier series, keyed by ``asset_id``."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cuelattice.kernel.fold import ordered_fold
from cuelattice.kernel.intervals import merge_intervals, overlap_join
from cuelattice.kernel.ranges import range_sums
from cuelattice.kernel.scan import Running, as_of, nearest_rank, running, time_chunk, with_halo

KEY = ["asset_id"]
MICRO = 1_000_000

# Fixed values of the speech detector.
OPEN_AT, CLOSE_BELOW, MIN_SILENCE_MS, MIN_SPEECH_MS, PAD_MS = 0.5, 0.35, 100, 250, 30
# Fixed values of the gain rider.
WINDOW_FRAMES, FRAME_MS, ATTACK_MS, RELEASE_MS, MIN_GAIN_DB, MAX_GAIN_DB = 6, 32, 80.0, 400.0, -18.0, 12.0
# Fixed values of the classifier event rule.
CLASS_WINDOW_MS, CLASS_GAP_MS, STRONG_SINGLE = 960, 600, 0.55


def bucket_peaks(points: DataFrame, bucket_ms: int = 250) -> DataFrame:
    """Loudest sample of each bucket, earliest on ties. Combines before the shuffle."""
    best = F.expr("max_by(struct(at_ms, loudness_db), struct(loudness_db, -at_ms))")
    return points.groupBy("asset_id", F.expr(f"at_ms DIV {max(1, bucket_ms)}").alias("bucket")).agg(best.alias("b")).select(
        "asset_id", "b.*"
    )


def waveform_peaks(samples: DataFrame, buckets: int) -> DataFrame:
    """Largest magnitude per bucket over all channels; ``samples(asset_id, channel, idx, value)``."""
    sizes = samples.groupBy("asset_id").agg((F.max("idx") + 1).alias("n"))
    dense = samples.join(sizes.where(f"n >= {buckets}"), KEY).groupBy(
        "asset_id", F.expr(f"((idx + 1) * {buckets} - 1) DIV n").alias("bucket")
    ).agg(F.max(F.abs("value")).alias("peak"))
    slots = sizes.where(f"n < {buckets}").select(
        "asset_id", "n", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(buckets - 1).cast("long"))).alias("bucket")
    ).withColumn("idx", F.expr(f"bucket * n DIV {buckets}"))
    sparse = slots.join(samples.groupBy("asset_id", "idx").agg(F.max(F.abs("value")).alias("peak")), ["asset_id", "idx"], "left")
    every = dense.unionByName(sparse.select("asset_id", "bucket", "peak"))
    return every.withColumn("peak", F.expr("least(1.0D, greatest(0.0D, coalesce(peak, 0)))"))


def frame_pcm(pcm: DataFrame, frame: int = 512, gain: str = "1.0D", rate: int = 16_000) -> DataFrame:
    """Energy, count and peak per fixed-size frame of ``pcm(asset_id, chunk_no, samples)``."""
    placed = running(
        pcm.withColumn("__n", F.size("samples")), KEY, ["chunk_no"],
        [Running("__end", "sum", F.col("__n"))], F.expr("chunk_no DIV 4096"),
    )
    flat = placed.select(
        "asset_id", F.expr("__end - __n").alias("__base"), F.posexplode("samples").alias("pos", "sample")
    ).selectExpr("asset_id", "__base + pos AS i", f"CAST(sample AS DOUBLE) * {gain} AS v")
    return flat.groupBy("asset_id", F.expr(f"i DIV {frame}").alias("frame_idx")).agg(
        F.sum(F.expr("v * v")).alias("sum_squares"), F.count(F.lit(1)).alias("sample_count"), F.max(F.abs("v")).alias("peak")
    ).withColumns({
        "at_ms": F.expr(f"frame_idx * {frame} * 1000 DIV {rate}"),
        "end_ms": F.expr(f"((frame_idx * {frame} + sample_count) * 1000 + {rate} - 1) DIV {rate}"),
    })


def speech_segments(frames: DataFrame) -> DataFrame:
    """Hysteresis segmentation: opens at the upper threshold, closes after enough silence, padded and merged."""
    order = ["at_ms", "end_ms"]
    chunk = time_chunk("at_ms")
    quiet = frames.withColumn("__quiet", F.col("speech_probability") < CLOSE_BELOW)
    runs = running(quiet, KEY, order, [Running("__was_quiet", "last", F.col("__quiet"), inclusive=False)], chunk)
    runs = runs.withColumn("__starts", F.expr("CASE WHEN __quiet AND NOT coalesce(__was_quiet, false) THEN at_ms END"))
    runs = running(runs, KEY, order, [Running("__run", "last", F.col("__starts"))], chunk)
    mark = F.expr(
        f"CASE WHEN speech_probability >= {OPEN_AT} THEN 1 WHEN __quiet AND end_ms - __run >= {MIN_SILENCE_MS} THEN 0 END"
    )
    states = running(
        runs.withColumn("__mark", mark), KEY, order,
        [Running("__before", "last", F.col("__mark"), inclusive=False), Running("__state", "last", F.col("__mark"))], chunk,
    ).withColumn("__opens", F.expr("CASE WHEN __state = 1 AND coalesce(__before, 0) = 0 THEN at_ms END"))
    opened = running(
        states, KEY, order,
        [
            Running("__start", "last", F.col("__opens")),
            Running("__next", "last", F.col("at_ms"), inclusive=False, reverse=True),
        ],
        chunk,
    )
    closed = F.expr("__state = 0 AND __before = 1")
    unfinished = F.expr("__next IS NULL AND __state = 1")
    raw = opened.where(closed | unfinished).select(
        "asset_id", F.col("__start").alias("start_ms"), F.when(closed, F.col("__run")).otherwise(F.col("end_ms")).alias("end_ms")
    ).where(f"end_ms - start_ms >= {MIN_SPEECH_MS}")
    duration = frames.groupBy("asset_id").agg(F.max("end_ms").alias("duration_ms"))
    padded = raw.join(duration, KEY).selectExpr(
        "asset_id", f"greatest(start_ms - {PAD_MS}, 0) AS start_ms", f"least(end_ms + {PAD_MS}, duration_ms) AS end_ms"
    )
    spans = merge_intervals(padded, KEY)
    return mean_over_spans(spans, frames, "speech_probability", "confidence")


def mean_over_spans(spans: DataFrame, frames: DataFrame, value: str, name: str) -> DataFrame:
    """Mean of a frame value over the frames that overlap each span, from running totals."""
    graded = F.expr(f"CAST(round({value} * {MICRO}) AS BIGINT)")
    points = frames.select("asset_id", F.col("at_ms").alias("t"), F.lit(1).alias("a"), graded.alias("av")).unionByName(
        frames.select("asset_id", F.col("end_ms").alias("t"), F.lit(1).alias("b"), graded.alias("bv")), True
    )
    sums = range_sums(
        spans, points, KEY, "t",
        {"n1": ("a", "before_end"), "v1": ("av", "before_end"), "n0": ("b", "until_start"), "v0": ("bv", "until_start")},
    )
    mean = f"coalesce((v1 - v0) / nullif(n1 - n0, 0) / {MICRO}, 0.0D)"
    return sums.selectExpr("asset_id", "start_ms", "end_ms", f"{mean} AS {name}")


def speech_activity(frames: DataFrame, segments: DataFrame) -> DataFrame:
    """Coverage and mean probability per asset."""
    base = frames.groupBy("asset_id").agg(F.max("end_ms").alias("duration_ms"), F.avg("speech_probability").alias("average_probability"))
    talk = segments.groupBy("asset_id").agg(F.sum(F.expr("end_ms - start_ms")).alias("speech_ms"))
    return base.join(talk, KEY, "left").selectExpr(
        "asset_id", "duration_ms", "coalesce(speech_ms, 0) AS speech_ms",
        "least(1.0D, coalesce(speech_ms, 0) / duration_ms) AS speech_coverage",
        "least(1.0D, greatest(0.0D, average_probability)) AS average_probability",
    )


def cleanup_profile(frames: DataFrame, segments: DataFrame) -> DataFrame:
    """Speech and noise level percentiles, their distance, and whether cleanup should run."""
    level = frames.where("sample_count > 0 AND sum_squares > 1e-12").withColumn("db", F.expr("10 * log10(sum_squares / sample_count)"))
    speech = nearest_rank(level.where("speech_probability >= 0.55"), KEY, "db", {"speech_level": 0.5}).drop("n_values")
    noise = nearest_rank(level.where("speech_probability <= 0.20"), KEY, "db", {"noise_level": 0.75}).drop("n_values")
    return speech_activity(frames, segments).join(speech, KEY, "left").join(noise, KEY, "left").selectExpr(
        "asset_id", f"speech_ms >= greatest(least(duration_ms, 800), {MIN_SPEECH_MS}) AS speech_detected", "speech_coverage",
        "least(60.0D, greatest(-20.0D, coalesce(speech_level, -30.0D) - coalesce(noise_level, -60.0D))) AS estimated_snr_db",
    ).withColumn("strength", F.expr("CASE WHEN speech_detected THEN 1.0D ELSE 0.0D END"))


def bpm(beats: DataFrame) -> DataFrame:
    """60000 over the median beat gap between 100 ms and 3 s; the gap histogram is at most 2901 values per asset."""
    gaps = running(beats, KEY, ["source_ms", "event_id"], [Running("__prev", "last", F.col("source_ms"), inclusive=False)], time_chunk("source_ms"))
    gaps = gaps.withColumn("gap", F.expr("source_ms - __prev")).where("gap BETWEEN 100 AND 3000")
    return gaps.groupBy("asset_id").agg(F.expr("60000 / percentile(gap, 0.5)").alias("bpm"))


def event_confidence(events: DataFrame, logits: str = "logits", fps: float = 50.0) -> DataFrame:
    """Largest sigmoid within three model frames of each event; ``events(seconds, logits)``."""
    center = f"CAST(greatest(0, round(seconds * {fps})) AS INT)"
    near = f"slice({logits}, greatest({center} - 3, 0) + 1, least({center} + 4, size({logits})) - greatest({center} - 3, 0))"
    ok = f"size({logits}) > 0 AND seconds IS NOT NULL AND NOT isnan(seconds) AND {center} - 3 < size({logits})"
    best = f"array_max(transform(filter({near}, x -> NOT isnan(x)), x -> 1 / (1 + exp(-least(60.0D, greatest(-60.0D, CAST(x AS DOUBLE)))))))"
    return events.withColumn("confidence", F.expr(f"CASE WHEN {ok} THEN coalesce({best}, 0.0D) ELSE 0.0D END"))


def class_events(frames: DataFrame, min_confidence: float, durations: DataFrame) -> DataFrame:
    """Sessions of confident classifier frames; a lone weak frame is dropped."""
    ready = frames.where(f"s >= {min_confidence}").join(durations, KEY).selectExpr(
        "asset_id", "t AS start_ms", f"least(t + {CLASS_WINDOW_MS}, duration_ms) AS end_ms", "s", "l"
    )
    sums = [
        F.max("s").alias("peak"), F.avg("s").alias("mean"), F.count(F.lit(1)).alias("frame_count"),
        F.expr("max_by(l, struct(s, -start_ms))").alias("label"),
    ]
    events = merge_intervals(ready, KEY, gap=CLASS_GAP_MS, aggregates=sums)
    return events.where(f"frame_count >= 2 OR peak >= {STRONG_SINGLE}").selectExpr(
        "asset_id", "CASE WHEN label IN ('Giggle', 'Snicker') THEN 'giggle' ELSE 'laughter' END AS kind", "label",
        "start_ms", "end_ms", "peak AS confidence", "mean AS average_confidence", "frame_count",
    )


def strongest_per_timestamp(frames: DataFrame, at: str = "t", score: str = "s", first: str = "ordinal") -> DataFrame:
    """One row per timestamp of overlapped passes: the strongest, the first of equals."""
    rest = [c for c in frames.columns if c not in ("asset_id", at)]
    best = F.max_by(F.struct(*rest), F.struct(F.col(score), -F.col(first)))
    return frames.groupBy("asset_id", at).agg(best.alias("b")).select("asset_id", at, "b.*")


def merge_near_events(events: DataFrame, tolerance_ms: int = 70) -> DataFrame:
    """Events closer than the tolerance to the kept anchor collapse; a stronger one replaces the anchor.

    A gap above the tolerance always starts anew, so each dense run folds on its own.
    """
    runs = running(events, KEY, ["at_ms", "event_id"], [Running("__prev", "last", F.col("at_ms"), inclusive=False)], time_chunk("at_ms"))
    runs = runs.withColumn("__open", F.expr(f"CASE WHEN __prev IS NULL OR at_ms - __prev > {tolerance_ms} THEN at_ms END"))
    runs = running(runs, KEY, ["at_ms", "event_id"], [Running("run", "last", F.col("__open"))], time_chunk("at_ms"))

    def step(state, row):
        at, confidence = row[0], row[1]
        if state is not None and at - state[0] <= tolerance_ms:
            return ([at, confidence] if confidence > state[1] else state), []
        return [at, confidence], ([] if state is None else [tuple(state)])

    fields = [T.StructField("at_ms", T.LongType()), T.StructField("confidence", T.DoubleType())]
    return ordered_fold(
        runs, ["asset_id", "run"], ["at_ms", "event_id"], ["at_ms", "confidence"], step, fields,
        finish=lambda s: [] if s is None else [tuple(s)],
    ).drop("run")


def trusted_centre(events: DataFrame, chunks: DataFrame, overlap_ms: int = 5_000) -> DataFrame:
    """Events of overlapped chunks inside each chunk's trusted part; outer edges belong to the first and last chunk."""
    seen = running(
        chunks, KEY, ["chunk_no"],
        [
            Running("__before", "last", F.col("chunk_no"), inclusive=False),
            Running("__after", "last", F.col("chunk_no"), inclusive=False, reverse=True),
        ],
        F.expr("chunk_no DIV 4096"),
    )
    half = overlap_ms // 2
    bounds = seen.selectExpr(
        "asset_id", "chunk_no", "offset_ms", f"IF(__before IS NULL, 0, {half}) AS lo",
        f"IF(__after IS NULL, length_ms, length_ms - {half}) AS hi",
    )
    return events.join(bounds, ["asset_id", "chunk_no"]).where("local_ms BETWEEN lo AND hi").withColumn(
        "at_ms", F.expr("offset_ms + local_ms")
    ).drop("lo", "hi", "offset_ms")


def overlapped_chunks(durations: DataFrame, chunk_ms: int, overlap_ms: int, offset_ms: int = 0) -> DataFrame:
    """Chunk table of each asset: a chunk every ``chunk - overlap`` ms until one reaches the end."""
    step = chunk_ms - overlap_ms
    last = f"greatest(CAST(ceil((duration_ms - {offset_ms} - {chunk_ms}) / {step}) AS BIGINT), 0L)"
    return durations.where(f"duration_ms > {offset_ms}").selectExpr(
        "asset_id", "duration_ms", f"explode(sequence(0L, {last})) AS chunk_no"
    ).selectExpr(
        "asset_id", "chunk_no", f"{offset_ms} + chunk_no * {step} AS start_ms",
        f"least({offset_ms} + chunk_no * {step} + {chunk_ms}, duration_ms) AS end_ms",
    )


def rolling_levels(frames: DataFrame, each_side: int = WINDOW_FRAMES) -> DataFrame:
    """RMS and peak in dBFS over a window of neighbouring frames."""
    numbered = running(frames, KEY, ["at_ms"], [Running("__rn", "count", F.lit(1))], time_chunk("at_ms"))
    spread, part = with_halo(numbered, KEY, "__rn", each_side, each_side, 65_536)
    near = Window.partitionBy(*part).orderBy("__rn").rowsBetween(-each_side, each_side)
    return spread.withColumns({
        "__s": F.sum("sum_squares").over(near), "__n": F.sum("sample_count").over(near), "__p": F.max("peak").over(near),
    }).where("__core").withColumns({
        "rms_dbfs": F.expr("IF(__n = 0 OR __s <= 1e-12, -120.0D, 10 * log10(__s / __n))"),
        "peak_dbfs": F.expr("IF(__p <= 1e-9, -120.0D, 20 * log10(__p))"),
    }).select(*frames.columns, "rms_dbfs", "peak_dbfs")


def gain_envelope(frames: DataFrame, segments: DataFrame, target_lufs: float = -16.0, true_peak_db: float = -1.5) -> DataFrame:
    """Voice-leveling gain: one-pole attack and release toward the target, capped by the local peak."""
    levels = rolling_levels(frames).withColumn("center_ms", F.expr("at_ms + (end_ms - at_ms) DIV 2"))
    inside = as_of(levels, segments.withColumnRenamed("start_ms", "s_at"), KEY, "center_ms", "s_at", ["end_ms"], following=None)
    target = target_lufs - 3.0
    ready = inside.withColumn("active", F.expr("coalesce(center_ms < prev.end_ms, false)")).withColumn(
        "cap", F.expr(f"{true_peak_db}D - peak_dbfs - 0.5D")
    ).withColumn(
        "desired", F.expr(
            f"CASE WHEN active AND rms_dbfs > -55 THEN least(cap, least({MAX_GAIN_DB}D, greatest({MIN_GAIN_DB}D, {target}D - rms_dbfs))) "
            "WHEN active THEN least(cap, 0.0D) ELSE 0.0D END")
    )
    attack, release = (1.0 - math.exp(-FRAME_MS / t) for t in (ATTACK_MS, RELEASE_MS))

    def step(state, row):
        at, end, active, cap, desired, probability = row
        gain = 0.0 if state is None else state[0]
        gain += (attack if desired < gain else release) * (desired - gain)
        gain = min(gain, cap) if active else min(gain, 0.0)
        gain = max(MIN_GAIN_DB, min(MAX_GAIN_DB, gain))
        first = [(0, 0.0, probability, 0)] if state is None else []
        return [gain, end, probability], first + [(at, gain, probability, 1)]

    fields = [
        T.StructField("at_ms", T.LongType()), T.StructField("gain_db", T.DoubleType()),
        T.StructField("speech_probability", T.DoubleType()), T.StructField("ordinal", T.IntegerType()),
    ]
    folded = ordered_fold(
        ready, KEY, ["center_ms"], ["center_ms", "end_ms", "active", "cap", "desired", "speech_probability"], step, fields,
        finish=lambda s: [] if s is None else [(s[1], s[0], s[2], 2)],
    )
    ends = segments.groupBy("asset_id").agg(F.max("end_ms").alias("speech_end"))
    tail = folded.join(ends, KEY, "left").withColumn(
        "gain_db", F.expr("IF(ordinal = 2 AND coalesce(speech_end < at_ms, true), least(gain_db, 0.0D), gain_db)")
    ).drop("speech_end")
    return last_per_time(tail, "at_ms", "ordinal").drop("ordinal")


def extend_silent_tail(points: DataFrame, durations: DataFrame) -> DataFrame:
    """Release to unity after the decoded end when the container lasts longer; ``durations(actual_ms, expected_ms)``."""
    late = durations.where("expected_ms > actual_ms")
    release = f"least(actual_ms + {int(RELEASE_MS)}, expected_ms)"
    extra = late.selectExpr(
        "asset_id", f"explode(array_distinct(array({release}, expected_ms))) AS at_ms", "0.0D AS gain_db", "0.0D AS speech_probability", "1 AS ordinal"
    )
    return last_per_time(points.withColumn("ordinal", F.lit(0)).unionByName(extra), "at_ms", "ordinal").drop("ordinal")


def last_per_time(points: DataFrame, at: str, ordinal: str, keys: list[str] | None = None) -> DataFrame:
    """Last-written point per timestamp; combines before the shuffle."""
    keys = keys or KEY
    rest = [c for c in points.columns if c not in (*keys, at)]
    return points.groupBy(*keys, at).agg(F.max_by(F.struct(*rest), F.col(ordinal)).alias("b")).select(*keys, at, "b.*")


def rider_keyframes(points: DataFrame, durations: DataFrame) -> DataFrame:
    """Envelope points as clip-local keyframes with both clip ends present; ``points(at_ms, gain, ordinal)``."""
    valid = points.where("NOT isnan(gain) AND gain > 0").join(durations, KEY).selectExpr(
        "asset_id", "greatest(0L, least(duration_ms, CAST(floor(at_ms + 0.5) AS BIGINT))) AS at_ms", "gain", "ordinal", "duration_ms"
    )
    unique = last_per_time(valid, "at_ms", "ordinal")
    edges = unique.groupBy("asset_id", "duration_ms").agg(
        F.min("at_ms").alias("lo"), F.max("at_ms").alias("hi"), F.min_by("gain", "at_ms").alias("g_lo"), F.max_by("gain", "at_ms").alias("g_hi")
    )
    head = edges.where("lo > 0").selectExpr("asset_id", "0L AS at_ms", "g_lo AS gain")
    tail = edges.where("hi < duration_ms").selectExpr("asset_id", "duration_ms AS at_ms", "g_hi AS gain")
    return unique.select("asset_id", "at_ms", "gain").unionByName(head).unionByName(tail).selectExpr(
        "asset_id", "at_ms", "greatest(0.0D, least(4.0D, gain)) AS value", "'ease-in-out' AS easing"
    )


def cap_points(points: DataFrame, order: list[str], maximum: int) -> DataFrame:
    """At most ``maximum`` evenly picked points per asset, both ends kept."""
    numbered = running(points, KEY, order, [Running("__i", "count", F.lit(1))], time_chunk(order[0]))
    sizes = numbered.groupBy("asset_id").agg(F.max("__i").alias("__n"))
    slots = sizes.where(f"__n > {maximum}").selectExpr(
        "asset_id", "__n", f"explode(sequence(0L, {maximum - 1}L)) AS slot"
    ).selectExpr("asset_id", f"CAST(round(slot * (__n - 1) / {maximum - 1}) AS BIGINT) + 1 AS __i").distinct()
    small = numbered.join(sizes.where(f"__n <= {maximum}").select("asset_id"), KEY, "left_semi")
    return small.unionByName(numbered.join(slots, ["asset_id", "__i"], "left_semi")).drop("__i")


def beat_markers(beats: DataFrame, downbeats: DataFrame, tolerance_ms: int = 70) -> DataFrame:
    """Beats raised by a matching downbeat (the first listed within the tolerance), then unmatched downbeats.

    An unmatched downbeat is dropped when an earlier appended one lies within the tolerance.
    """
    left = beats.selectExpr("asset_id", "beat_idx", "source_ms", "confidence", f"source_ms - {tolerance_ms} AS lo", f"source_ms + {tolerance_ms} AS hi")
    right = downbeats.selectExpr("asset_id", "down_idx", "source_ms AS d_ms", "source_ms AS d_end", "confidence AS d_conf")
    pairs = overlap_join(left, right, KEY, ("lo", "hi"), ("d_ms", "d_end"), 10_000, closed=True)
    hits = pairs.groupBy("asset_id", "beat_idx").agg(F.min_by("d_conf", "down_idx").alias("d_conf"))
    raised = left.join(hits, ["asset_id", "beat_idx"], "left").selectExpr(
        "asset_id", "source_ms", "least(1.0D, greatest(0.0D, confidence, coalesce(d_conf, 0.0D))) AS confidence", "d_conf IS NOT NULL AS downbeat"
    )
    alone = right.join(pairs.select("asset_id", "down_idx").distinct(), ["asset_id", "down_idx"], "left_anti")

    def step(state, row):
        at, confidence = row
        if state is not None and at - state <= tolerance_ms:
            return state, []
        return at, [(at, confidence, True)]

    fields = [T.StructField("source_ms", T.LongType()), T.StructField("confidence", T.DoubleType()), T.StructField("downbeat", T.BooleanType())]
    kept = ordered_fold(alone, KEY, ["d_ms", "down_idx"], ["d_ms", "d_conf"], step, fields)
    return raised.unionByName(kept)


def normalization_gain(clips: DataFrame, keyframes: DataFrame) -> DataFrame:
    """Loudness gain per clip, limited by automation headroom and a shared cap.

    ``clips(asset_id, volume, target_lufs, target_tp, measured_lufs, measured_tp)``;
    ``keyframes(asset_id, value)`` is the volume automation.
    """
    loudest = keyframes.groupBy("asset_id").agg(F.max(F.expr("greatest(0, value)")).alias("__top"))
    return clips.join(loudest, KEY, "left").selectExpr(
        "*", "greatest(0.0D, volume) AS __base", "greatest(0.0D, volume, coalesce(__top, 0.0D)) AS __loud",
        "least(target_lufs - measured_lufs, target_tp - measured_tp) AS recommended_db",
    ).selectExpr(
        "*", "pow(10.0D, recommended_db / 20) AS __rec",
        "IF(__base <= 0 OR __loud <= __base, NULL, pow(10.0D, (target_tp - measured_tp - 20 * log10(__loud / __base)) / 20)) AS __safe",
    ).selectExpr(
        "*", "greatest(0.0D, least(__rec, coalesce(__safe, __rec))) AS __want"
    ).selectExpr(
        "asset_id", "recommended_db", "greatest(0.0D, least(__want, IF(__loud > 0, 4.0D / __loud, 1.0D))) AS multiplier", "volume", "__want"
    ).selectExpr(
        "asset_id", "recommended_db", "multiplier", "least(4.0D, greatest(0.0D, volume * multiplier)) AS volume",
        "multiplier + 1e-6D < __want AS limited",
    )


def frame_blackness(pixels: DataFrame, luma: float = 8.0, ratio: float = 0.02) -> DataFrame:
    """Whether the share of bright samples stays below ``ratio``; ``pixels(asset_id, frame_idx, r, g, b)``."""
    bright = f"CASE WHEN 0.2126D * r + 0.7152D * g + 0.0722D * b > {luma} THEN 1.0D ELSE 0.0D END"
    return pixels.groupBy("asset_id", "frame_idx").agg(F.expr(f"avg({bright}) < {ratio}").alias("black"))


def trailing_black(series: DataFrame, durations: DataFrame, window_ms: int = 2_000, pad_ms: int = 20, eps_ms: int = 50) -> DataFrame:
    """Trimmed duration when a series ends in black: last bright sample plus padding."""
    window = f"least({window_ms}, duration_ms - {1000 / 120})"
    placed = series.join(durations, KEY).where(f"at_ms <= duration_ms - {eps_ms} AND at_ms >= duration_ms - {eps_ms} - {window}")
    state = placed.groupBy("asset_id", "duration_ms").agg(
        F.max_by("black", "at_ms").alias("ends_black"), F.max(F.expr("CASE WHEN NOT black THEN at_ms END")).alias("last_bright")
    )
    trimmed = f"greatest({1000 / 120}, least(duration_ms, last_bright + {pad_ms}))"
    known = state.selectExpr("asset_id", f"IF(ends_black AND last_bright IS NOT NULL, {trimmed}, CAST(duration_ms AS DOUBLE)) AS trimmed_ms")
    return durations.join(known, KEY, "left").selectExpr("asset_id", "duration_ms", "coalesce(trimmed_ms, CAST(duration_ms AS DOUBLE)) AS trimmed_ms")


def weighted_merge(segments: DataFrame, min_ms: float = 1.0) -> DataFrame:
    """Touching segments merged with a running duration-weighted confidence; islands fold independently."""
    from cuelattice.kernel.intervals import mark_islands

    marked = mark_islands(segments.where(f"end_ms - start_ms >= {min_ms}"), KEY)

    def step(state, row):
        start, end, confidence = row
        if state is None:
            return [start, end, confidence], []
        before, length = state[1] - state[0], end - start
        mixed = (state[2] * before + confidence * length) / max(min_ms, before + length)
        return [state[0], max(state[1], end), mixed], []

    fields = [T.StructField("start_ms", T.LongType()), T.StructField("end_ms", T.LongType()), T.StructField("confidence", T.DoubleType())]
    return ordered_fold(
        marked, ["asset_id", "island_start"], ["start_ms", "end_ms", "confidence"], ["start_ms", "end_ms", "confidence"], step, fields,
        finish=lambda s: [] if s is None else [tuple(s)],
    ).drop("island_start")


def speech_metadata(segments: DataFrame, durations: DataFrame) -> DataFrame:
    """Coverage and duration-weighted confidence per asset."""
    sums = segments.groupBy("asset_id").agg(
        F.sum(F.expr("end_ms - start_ms")).alias("speech_ms"), F.sum(F.expr("confidence * (end_ms - start_ms)")).alias("weight")
    )
    return durations.join(sums, KEY, "left").selectExpr(
        "asset_id", "IF(duration_ms > 0, least(1.0D, coalesce(speech_ms, 0) / duration_ms), 0.0D) AS speech_coverage",
        "least(1.0D, coalesce(weight / nullif(speech_ms, 0), 0.0D)) AS average_confidence",
    )
