"""Set-based transforms of ``clips``, ``tracks`` and ``keyframes`` tables, all times in milliseconds.

An edit table holds at most one edit per project. A rejected edit leaves the
project unchanged and carries its reason in ``error``. Effects on other clips go
through joins on the project and partial aggregates, never through a per-project group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cuelattice.functions.scalars import ease
from cuelattice.kernel.fold import ordered_fold
from cuelattice.kernel.intervals import merge_intervals, overlap_join
from cuelattice.kernel.scan import Running, as_of, running, time_chunk
from cuelattice.kernel.suppress import buffered_groups
from cuelattice.session import cut_lineage

PROJECT = ["project_id"]
CLIP = ["project_id", "clip_id"]
MIN_MS = 1000.0 / 120.0
EPS = 0.001
# Transition names.
TRANSITIONS = (
    "none", "crossfade", "dip-to-black", "wipe-left", "wipe-right", "slide-up", "slide-down", "slide-left", "slide-right",
    "zoom-in", "zoom-out", "spin", "flip-3d", "blur", "whip-left", "whip-right", "fx-light-leak", "fx-film-burn", "fx-glitch",
    "fx-ink", "fx-brush",
)
# Allowed keyframe values per property.
PROPERTY_RANGE = {
    "scale": (0.01, 20.0), "opacity": (0.0, 1.0), "volume": (0.0, 4.0), "riderGain": (0.0, 4.0), "duckGain": (0.0, 1.0), "pan": (-1.0, 1.0),
}


def _quoted(names) -> str:
    return ", ".join(f"'{n}'" for n in names)


# --- validation and normalization -----------------------------------------------


def timeline_issues(clips: DataFrame, tracks: DataFrame) -> DataFrame:
    """Issue rows ``(project_id, clip_id, code)``; transition columns are optional."""
    ids = tracks.selectExpr("project_id", "track_id AS id").unionByName(clips.selectExpr("project_id", "clip_id AS id"))
    twice = ids.groupBy("project_id", "id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").selectExpr(
        "project_id", "id AS clip_id", "explode(array_repeat('duplicate-id', CAST(n - 1 AS INT))) AS code"
    )
    lost = clips.join(tracks, ["project_id", "track_id"], "left_anti").selectExpr("project_id", "clip_id", "'missing-track' AS code")
    checks = [
        f"IF(start_ms < 0 OR duration_ms < {MIN_MS}, 'invalid-time', NULL)",
        "IF(speed < 0.05 OR speed > 16, 'invalid-speed', NULL)",
        f"IF(trim_in_ms + duration_ms * speed > source_duration_ms + {EPS}, 'source-overrun', NULL)",
    ]
    if "in_type" in clips.columns:
        for side in ("in", "out"):
            checks.append(f"IF({side}_type NOT IN ({_quoted(TRANSITIONS)}), 'invalid-transition', NULL)")
            checks.append(f"IF({side}_ms > duration_ms + {EPS}, 'transition-too-long', NULL)")
        checks.append(f"IF(in_ms + out_ms > duration_ms + {EPS}, 'transition-overlap', NULL)")
    own = clips.selectExpr("project_id", "clip_id", f"explode(array_compact(array({', '.join(checks)}))) AS code")
    scanned = running(
        clips.join(tracks.select("project_id", "track_id"), ["project_id", "track_id"], "left_semi"), ["project_id", "track_id"],
        ["start_ms", "clip_idx"], [Running("__end", "last", F.expr("start_ms + duration_ms"), inclusive=False)], time_chunk("start_ms"),
    )
    overlap = scanned.where(f"start_ms < __end - {EPS}").selectExpr("project_id", "clip_id", "'overlap' AS code")
    return twice.unionByName(lost).unionByName(own).unionByName(overlap)


RENDER_CHECKS = (
    ("bad-track", "track_type IS NULL"),
    ("incompatible", "NOT ((track_type = 'video' AND kind IN ('video', 'image')) OR (track_type = 'audio' AND kind IN ('audio', 'video')) OR (track_type = 'text' AND kind = 'text'))"),
    ("duration", "duration_ms <= 0"),
    ("speed", "isnan(speed) OR speed NOT BETWEEN 0.05 AND 16"),
    ("volume", "isnan(volume) OR volume NOT BETWEEN 0 AND 4"),
    ("pan", "isnan(pan) OR pan NOT BETWEEN -1 AND 1"),
    ("text", "kind = 'text' AND (content IS NULL OR trim(content) = '' OR octet_length(content) > 1000000)"),
    ("path", "kind <> 'text' AND path IS NULL"),
)


def render_issues(clips: DataFrame, tracks: DataFrame) -> DataFrame:
    """First failed check per project in check order: tracks, then clips in their order."""
    counted = tracks.groupBy("project_id", "track_id").agg(F.count(F.lit(1)).alias("n"), F.min("track_idx").alias("ordinal"), F.max("type").alias("type"), F.max("gain").alias("gain"), F.max("pan").alias("pan"))
    track_bad = counted.where("trim(track_id) = '' OR n > 1 OR gain NOT BETWEEN 0 AND 4 OR pan NOT BETWEEN -1 AND 1").selectExpr(
        "project_id", "0 AS stage", "CAST(ordinal AS BIGINT) AS ordinal", "0 AS step", "'track' AS code", "track_id AS id"
    )
    cases = [f"IF({test}, struct({i} AS step, '{code}' AS code), NULL)" for i, (code, test) in enumerate(RENDER_CHECKS)]
    joined = clips.join(counted.select("project_id", "track_id", F.col("type").alias("track_type")), ["project_id", "track_id"], "left")
    clip_bad = joined.withColumn("__b", F.expr(f"coalesce({', '.join(cases)})")).where("__b IS NOT NULL").selectExpr(
        "project_id", "1 AS stage", "CAST(clip_idx AS BIGINT) AS ordinal", "__b.step", "__b.code", "clip_id AS id"
    )
    first = F.min(F.struct("stage", "ordinal", "step", "code", "id"))
    return track_bad.unionByName(clip_bad).groupBy("project_id").agg(first.alias("f")).select("project_id", "f.code", "f.id")


def keyframe_issues(keyframes: DataFrame, clips: DataFrame) -> DataFrame:
    """Keyframes beyond the clip or outside their property's range."""
    spark = keyframes.sparkSession
    ranges = spark.createDataFrame([(k, lo, hi) for k, (lo, hi) in PROPERTY_RANGE.items()], "property string, lo double, hi double")
    joined = keyframes.join(clips.select(*CLIP, "duration_ms"), CLIP).join(F.broadcast(ranges), "property", "left")
    code = "CASE WHEN time_ms > duration_ms THEN 'beyond-clip' WHEN isnan(value) OR abs(value) = double('infinity') THEN 'not-finite' WHEN value < lo OR value > hi THEN 'out-of-range' END"
    return joined.withColumn("code", F.expr(code)).where("code IS NOT NULL").select(*CLIP, "property", "time_ms", "code")


def normalize_clips(clips: DataFrame, tracks: DataFrame) -> DataFrame:
    """Bounded clip fields; the kind follows the track where it is missing."""
    types = tracks.select("project_id", "track_id", F.col("type").alias("__type"))
    number = "IF({0} IS NULL OR isnan({0}) OR abs({0}) = double('infinity'), {1}, {0})"
    safe = lambda c, d, lo, hi: f"least({hi}, greatest({lo}, {number.format(c, d)}))"
    return clips.join(types, ["project_id", "track_id"], "left").withColumns({
        "kind": F.expr("coalesce(kind, CASE __type WHEN 'audio' THEN 'audio' WHEN 'text' THEN 'text' ELSE 'video' END)"),
        "start_ms": F.expr(f"greatest(0.0D, {number.format('start_ms', '0.0D')})"),
        "duration_ms": F.expr(f"greatest({MIN_MS}D, {number.format('duration_ms', '1000.0D')})"),
        "trim_in_ms": F.expr(f"greatest(0.0D, {number.format('trim_in_ms', '0.0D')})"),
        "speed": F.expr(safe("speed", "1.0D", "0.05D", "16.0D")), "volume": F.expr(safe("volume", "1.0D", "0.0D", "4.0D")),
        "pan": F.expr(safe("pan", "0.0D", "-1.0D", "1.0D")), "opacity": F.expr(safe("opacity", "1.0D", "0.0D", "1.0D")),
    }).drop("__type")


def clamp_transitions(clips: DataFrame) -> DataFrame:
    """In and out transitions that fit the clip together; unknown types become none."""
    known = lambda s: f"IF({s}_type IN ({_quoted(TRANSITIONS[1:])}), {s}_type, 'none')"
    sized = clips.withColumns({"in_type": F.expr(known("in")), "out_type": F.expr(known("out"))})
    sized = sized.withColumn("in_ms", F.expr("IF(in_type = 'none', 0, least(duration_ms, greatest(0, coalesce(in_ms, 0))))"))
    return sized.withColumn("out_ms", F.expr("IF(out_type = 'none', 0, least(greatest(0, duration_ms - in_ms), greatest(0, coalesce(out_ms, 0))))"))


def normalize_keyframes(keyframes: DataFrame) -> DataFrame:
    bad = "(value IS NULL OR isnan(value) OR abs(value) = double('infinity'))"
    return keyframes.withColumns({
        "time_ms": F.expr("greatest(0.0D, IF(time_ms IS NULL OR isnan(time_ms), 0.0D, time_ms))"),
        "value": F.expr(f"IF(property = 'riderGain', least(4.0D, greatest(0.0D, IF({bad}, 1.0D, value))), IF({bad}, 0.0D, value))"),
        "easing": F.coalesce("easing", F.lit("linear")),
    })


def snapshot_checks(clips: DataFrame, tracks: DataFrame) -> DataFrame:
    """Per project whether the stored structure is usable."""
    t = tracks.groupBy("project_id", "track_id").agg(F.count(F.lit(1)).alias("n"), F.min(F.expr("type IN ('video', 'audio', 'text')")).alias("ok"))
    good_tracks = t.groupBy("project_id").agg(F.bool_and(F.expr("n = 1 AND ok AND track_id <> ''")).alias("tracks_ok"))
    known = clips.join(t.select("project_id", "track_id", F.lit(True).alias("__known")), ["project_id", "track_id"], "left")
    fine = "clip_id <> '' AND __known IS NOT NULL AND start_ms IS NOT NULL AND NOT isnan(start_ms) AND duration_ms IS NOT NULL AND file IS NOT NULL"
    good_clips = known.groupBy("project_id").agg(F.bool_and(F.expr(f"coalesce({fine}, false)")).alias("clips_ok"))
    return good_tracks.join(good_clips, "project_id", "full").selectExpr("project_id", "coalesce(tracks_ok, true) AND coalesce(clips_ok, true) AS valid")


def snapshot(clips_seconds: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Seconds to whole milliseconds, and the duration of each project."""
    ms = clips_seconds.selectExpr(
        "project_id", "clip_id", *[f"floor({c} * 1000 + 0.5) AS {c}_ms" for c in ("start", "duration", "trim_in")]
    )
    total = clips_seconds.groupBy("project_id").agg(F.expr("floor(max(start + duration) * 1000 + 0.5) AS duration_ms"))
    return ms, total


def render_frames(keyframes: DataFrame, ducking: DataFrame | None = None) -> DataFrame:
    """One row per clip and millisecond with a column per property; the last written value wins."""
    names = {"x": "x", "y": "y", "scale": "scale_x", "rotation": "rotation_deg", "opacity": "opacity", "volume": "volume", "riderGain": "rider_gain", "pan": "pan", "duckGain": "duck_gain"}
    rows = keyframes.select(*CLIP, "property", "time_ms", "value", "ordinal")
    if ducking is not None:
        rows = rows.unionByName(ducking.select(*CLIP, F.lit("duckGain").alias("property"), "time_ms", "value", F.lit(0).cast("long").alias("ordinal")))
    rows = rows.withColumn("at_ms", F.expr("CAST(greatest(0, floor(time_ms + 0.5)) AS BIGINT)"))
    pivot = [F.expr(f"max_by(value, ordinal) FILTER (WHERE property = '{p}') AS {c}") for p, c in names.items()]
    out = rows.groupBy(*CLIP, "at_ms").agg(*pivot)
    return out.withColumn("scale_y", F.col("scale_x"))


# --- keyframes and envelopes --------------------------------------------------------


def _eased(at: str, fallback: Column) -> Column:
    """Value at ``at`` between the frames ``prev`` and ``next``."""
    span = F.col("next.time_ms") - F.col("prev.time_ms")
    progress = (F.col(at) - F.col("prev.time_ms")) / span
    eased = F.col("prev.value") + (F.col("next.value") - F.col("prev.value")) * ease(progress, F.col("prev.easing"))
    return (
        F.when(F.col("prev").isNull() & F.col("next").isNull(), fallback)
        .when(F.col("prev").isNull(), F.col("next.value"))
        .when(F.col("next").isNull() | (F.col("prev.time_ms") == F.col(at)), F.col("prev.value"))
        .otherwise(eased)
    )


def evaluate_keyframes(samples: DataFrame, frames: DataFrame, keys: list[str], at: str, fallback: Column, name: str = "value") -> DataFrame:
    """Value of an eased keyframe series at each sample; ends hold, an empty series gives the fallback.

    ``frames(keys, time_ms, value, easing)``; of frames at one time the last written (``ordinal``) counts.
    """
    unique = frames.groupBy(*keys, "time_ms").agg(F.max_by(F.struct("value", "easing"), "ordinal").alias("__f")).select(*keys, "time_ms", "__f.*")
    near = as_of(samples, unique, keys, at, "time_ms", ["value", "easing"])
    return near.withColumn(name, _eased(at, fallback)).drop("prev", "next")


def quiet_regions(keyframes: DataFrame, clips: DataFrame) -> DataFrame:
    """Plateaus of the volume automation below the clip level."""
    scanned = running(
        keyframes.where("property = 'volume'"), CLIP, ["time_ms", "ordinal"],
        [Running("__next", "last", F.struct("time_ms", "value"), inclusive=False, reverse=True)], time_chunk("time_ms"),
    ).join(clips.select(*CLIP, "volume"), CLIP)
    flat = f"abs(value - __next.value) < 1e-6 AND value < volume - 0.01 AND __next.time_ms - time_ms > {EPS}"
    return scanned.where(flat).selectExpr(*CLIP, "time_ms AS start_ms", "__next.time_ms AS end_ms", "value AS region_volume")


def write_volume_region(keyframes: DataFrame, clips: DataFrame, edits: DataFrame, fade_ms: float = 180.0) -> DataFrame:
    """Volume keyframes after writing one region per clip with fades; frames inside are replaced."""
    volume = keyframes.where("property = 'volume'")
    spans = edits.join(clips.select(*CLIP, "duration_ms", F.col("volume").alias("base")), CLIP).selectExpr(
        *CLIP, "duration_ms", "base", "new_volume", "least(duration_ms, greatest(0, least(region_start, region_end))) AS s",
        "least(duration_ms, greatest(0, greatest(region_start, region_end))) AS e",
    ).where(f"e - s >= {EPS}").withColumn("f", F.expr(f"least({fade_ms}, (e - s) / 3)")).selectExpr(
        "*", "greatest(0, s - f) AS fs", "least(duration_ms, e + f) AS fe"
    )
    before = evaluate_keyframes(spans, volume, CLIP, "fs", F.col("base"), "v_before")
    both = evaluate_keyframes(before, volume, CLIP, "fe", F.col("base"), "v_after")
    made = both.selectExpr(
        *CLIP,
        f"explode(array_compact(array(IF(fs < s - {EPS}, struct(fs AS t, v_before AS v, 1L AS o), NULL), struct(s AS t, new_volume AS v, 2L AS o), "
        f"struct(e AS t, new_volume AS v, 3L AS o), IF(fe > e + {EPS}, struct(fe AS t, v_after AS v, 4L AS o), NULL)))) AS k",
    ).selectExpr(*CLIP, "'volume' AS property", "CAST(k.t AS DOUBLE) AS time_ms", "CAST(k.v AS DOUBLE) AS value", "'linear' AS easing", "1000000L + k.o AS ordinal")
    kept = volume.join(spans.select(*CLIP, "fs", "fe"), CLIP, "left").where(f"fs IS NULL OR time_ms < fs - {EPS} OR time_ms > fe + {EPS}")
    return kept.selectExpr(*CLIP, "property", "CAST(time_ms AS DOUBLE) AS time_ms", "value", "easing", "ordinal").unionByName(made)


def upsert_keyframes(keyframes: DataFrame, edits: DataFrame, clips: DataFrame) -> DataFrame:
    """Edits replace the frame at their (bounded) time; an edit with a null value removes it."""
    key = [*CLIP, "property"]
    bounded = edits.join(clips.select(*CLIP, "duration_ms"), CLIP).selectExpr(*key, "CAST(least(duration_ms, greatest(0, time_ms)) AS DOUBLE) AS time_ms", "value", "easing", "ordinal").withColumn(
        "__slot", F.expr("floor(time_ms * 1000 + 0.5)"))
    marked = keyframes.withColumn("__slot", F.expr("floor(time_ms * 1000 + 0.5)"))
    kept = marked.join(bounded.select(*key, "__slot"), [*key, "__slot"], "left_anti")
    return kept.select(*key, "time_ms", "value", "easing", "ordinal").unionByName(
        bounded.where("value IS NOT NULL").selectExpr(*key, "time_ms", "value", "coalesce(easing, 'linear') AS easing", "ordinal"))


def replace_property(keyframes: DataFrame, frames: DataFrame, prop: str, clips: DataFrame) -> DataFrame:
    """Set one property of the clips named in ``frames`` (bounded, last frame of a time wins); fewer than two points are refused."""
    bounded = frames.join(clips.select(*CLIP, "duration_ms"), CLIP).selectExpr(
        *CLIP, "CAST(least(duration_ms, greatest(0, time_ms)) AS DOUBLE) AS time_ms", "least(4.0D, greatest(0.0D, coalesce(value, 1.0D))) AS value", "coalesce(easing, 'ease-in-out') AS easing", "ordinal")
    unique = bounded.groupBy(*CLIP, "time_ms").agg(F.max_by(F.struct("value", "easing", "ordinal"), "ordinal").alias("k")).select(*CLIP, F.lit(prop).alias("property"), "time_ms", "k.*")
    enough = unique.groupBy(*CLIP).agg(F.count(F.lit(1)).alias("n")).where("n >= 2").select(*CLIP)
    fresh = unique.join(enough, CLIP, "left_semi")
    kept = keyframes.join(enough.withColumn("property", F.lit(prop)), [*CLIP, "property"], "left_anti")
    return kept.select(*fresh.columns).unionByName(fresh)


def project_source_beats(clips: DataFrame, beats: DataFrame) -> DataFrame:
    """Source-time beats of each clip's asset inside its source range, on the timeline."""
    spans = clips.selectExpr(*CLIP, "asset_id", "start_ms", "speed", "trim_in_ms AS src_lo", "CAST(floor(trim_in_ms + duration_ms * speed) AS BIGINT) AS src_hi")
    hits = overlap_join(
        spans, beats.selectExpr("asset_id", "source_ms", "source_ms AS source_end", "confidence", "downbeat"), ["asset_id"],
        ("src_lo", "src_hi"), ("source_ms", "source_end"), 60_000, closed=True,
    )
    return hits.selectExpr(*CLIP, "source_ms", "confidence", "downbeat", "start_ms + (source_ms - src_lo) / speed AS timeline_ms")


def project_segments(segments: DataFrame, ranges: DataFrame, min_ms: float = 1.0) -> DataFrame:
    """Analysed segments cut to a sub-range and shifted to its start."""
    cut = segments.join(ranges, ["asset_id"]).selectExpr(
        "asset_id", "least(range_end, greatest(range_start, start_ms)) - range_start AS start_ms",
        "least(range_end, greatest(range_start, end_ms)) - range_start AS end_ms", "confidence")
    return cut.where(f"end_ms - start_ms >= {min_ms}")


# --- sampling the timeline --------------------------------------------------------------


def active_tracks(tracks: DataFrame, muted_solo_counts: bool = True) -> DataFrame:
    """Tracks that play: not muted, and solo when any track of the project is solo.

    ``muted_solo_counts=False`` ignores the solo flag of muted tracks, as the renderer does.
    """
    rule = "solo" if muted_solo_counts else "solo AND NOT muted"
    solo = tracks.groupBy("project_id").agg(F.max(F.expr(rule)).alias("__any"))
    return tracks.join(solo, PROJECT).where("NOT muted AND (NOT __any OR solo)").drop("__any")


def frame_layers(times: DataFrame, clips: DataFrame, tracks: DataFrame) -> DataFrame:
    """Clips alive at each sample time (half-open), on playing tracks, in layer order, with source time."""
    spans = clips.withColumn("end_ms", F.expr("start_ms + duration_ms"))
    points = times.selectExpr("project_id", "at_ms", "at_ms + 1 AS at_next")
    alive = overlap_join(points, spans, PROJECT, ("at_ms", "at_next"), ("start_ms", "end_ms"), 60_000).where("at_ms >= start_ms AND at_ms < end_ms")
    return alive.join(active_tracks(tracks).select("project_id", "track_id", "track_idx", "type"), ["project_id", "track_id"]).selectExpr(
        "project_id", "at_ms", "clip_id", "track_id", "track_idx", "type", "at_ms - start_ms AS local_ms", "trim_in_ms + (at_ms - start_ms) * speed AS source_ms")


def snap_times(requests: DataFrame, boundaries: DataFrame, tolerance_ms: int) -> DataFrame:
    """Nearest boundary strictly within the tolerance; the first listed of equally near ones.

    ``requests(project_id, request_id, time_ms, length_ms)``; a boundary also attracts the end of the moved span.
    """
    wide = requests.selectExpr("*", f"explode(array(0L, length_ms)) AS shift").selectExpr(
        "project_id", "request_id", "time_ms", "shift", f"time_ms + shift - {tolerance_ms} AS lo", f"time_ms + shift + {tolerance_ms} AS hi")
    points = boundaries.selectExpr("project_id", "ordinal", "boundary_ms AS b_lo", "boundary_ms AS b_hi")
    near = overlap_join(wide, points, PROJECT, ("lo", "hi"), ("b_lo", "b_hi"), max(1_000, tolerance_ms * 4), closed=True)
    ranked = near.withColumn("diff", F.expr("abs(time_ms - (b_lo - shift))")).where(f"diff < {tolerance_ms}")
    best = ranked.groupBy("project_id", "request_id").agg(F.expr("min_by(b_lo - shift, struct(diff, ordinal, shift <> 0)) AS snapped"))
    return requests.join(best, ["project_id", "request_id"], "left").withColumn("snapped_ms", F.coalesce("snapped", "time_ms")).drop("snapped")


def nearest_filled(slots: DataFrame, key: str) -> DataFrame:
    """For each slot the nearest rendered slot, the lower index on ties, -1 when none is rendered."""
    scanned = running(
        slots.withColumn("__hit", F.expr("IF(rendered, idx, NULL)")), [key], ["idx"],
        [Running("__lo", "last", F.col("__hit")), Running("__hi", "last", F.col("__hit"), reverse=True)], F.expr("idx DIV 100000"),
    )
    near = "CASE WHEN __lo IS NULL AND __hi IS NULL THEN -1 WHEN __lo IS NULL THEN __hi WHEN __hi IS NULL THEN __lo WHEN idx - __lo <= __hi - idx THEN __lo ELSE __hi END"
    return scanned.selectExpr(key, "idx", f"{near} AS source_idx")


def duck_intervals(clips: DataFrame, tracks: DataFrame, segments: DataFrame, targets: DataFrame, merge_gap_ms: int = 120) -> DataFrame:
    """Merged speech of audible source clips inside each target's influence window, on the timeline.

    ``segments(project_id, clip_id, start_ms, end_ms, confidence)`` are clip-local and current;
    ``targets`` carry the normalized ducking settings and the source track.
    """
    audible = active_tracks(tracks).where("type <> 'text'").select("project_id", "track_id")
    sources = clips.join(audible, ["project_id", "track_id"], "left_semi").selectExpr("project_id", "clip_id AS src_id", "track_id AS src_track", "start_ms AS src_start", "volume")
    spoken = segments.selectExpr("project_id", "clip_id AS src_id", "start_ms AS seg_s", "end_ms AS seg_e", "confidence").join(sources.where("volume > 0.0001"), ["project_id", "src_id"]).selectExpr(
        "project_id", "src_id", "src_track", "src_start + seg_s AS s", "src_start + seg_e AS e", "confidence")
    reach = targets.selectExpr(
        "project_id", "clip_id", "source_track", "min_confidence", "start_ms - (lookahead_ms + attack_ms) AS lo", "start_ms + duration_ms + hold_ms + release_ms AS hi")
    pairs = overlap_join(reach, spoken, PROJECT, ("lo", "hi"), ("s", "e"), 60_000).where(
        "src_id <> clip_id AND src_track = source_track AND confidence >= min_confidence")
    return merge_intervals(pairs.selectExpr(*CLIP, "s AS start_ms", "e AS end_ms"), CLIP, gap=merge_gap_ms)


def duck_envelope(targets: DataFrame, intervals: DataFrame) -> DataFrame:
    """Gain curve of each target: trapezoids around the speech intervals, lowest gain where they meet.

    Only the neighbours of a breakpoint can shape it when intervals keep their order, so each
    breakpoint is evaluated against the intervals whose influence covers it.
    """
    shaped = intervals.join(targets.drop("source_track", "min_confidence").withColumnsRenamed({"start_ms": "t_start", "duration_ms": "t_len"}), CLIP).selectExpr(
        *CLIP, "t_start", "t_len", "least(1.0D, greatest(0.0D, pow(10.0D, reduction_db / 20))) AS depth",
        "CAST(start_ms - lookahead_ms - attack_ms AS DOUBLE) AS a0", "CAST(start_ms - lookahead_ms AS DOUBLE) AS a1",
        "CAST(end_ms + hold_ms AS DOUBLE) AS b0", "CAST(end_ms + hold_ms + release_ms AS DOUBLE) AS b1",
    )
    linked = running(
        shaped, CLIP, ["a0"], [Running("nx", "last", F.struct("a0", "a1"), inclusive=False, reverse=True)], time_chunk("a0"))
    # Release of one shape against the attack of the next: the two lines cross once.
    up, down = "((1 - depth) / (b1 - b0))", "((depth - 1) / (nx.a1 - nx.a0))"
    cross = f"(depth - {up} * b0 - 1 + {down} * nx.a0) / ({down} - {up})"
    lo, hi = "greatest(b0, nx.a0)", "least(b1, nx.a1)"
    crossing = f"IF(nx IS NOT NULL AND {hi} > {lo} AND {cross} BETWEEN {lo} - 1e-9 AND {hi} + 1e-9, {cross}, NULL)"
    times = linked.selectExpr(*CLIP, "t_start", "t_len", f"explode(array_compact(array(a0, a1, b0, b1, {crossing}, CAST(t_start AS DOUBLE), CAST(t_start + t_len AS DOUBLE)))) AS t").where(
        "t BETWEEN t_start AND t_start + t_len").selectExpr(*CLIP, "t_start", "round(t, 4) AS t").distinct()
    points = times.selectExpr(*CLIP, "t_start", "t AS p_lo", "t AS p_hi")
    spans = shaped.drop("t_start", "t_len")
    met = overlap_join(points, spans, CLIP, ("p_lo", "p_hi"), ("a0", "b1"), 30_000, closed=True)
    gain = (
        "CASE WHEN p_lo <= a0 OR p_lo >= b1 THEN 1.0D WHEN p_lo < a1 THEN 1 + (depth - 1) * (p_lo - a0) / (a1 - a0) "
        "WHEN p_lo <= b0 THEN depth ELSE depth + (1 - depth) * (p_lo - b0) / (b1 - b0) END"
    )
    lowest = met.groupBy(*CLIP, "p_lo").agg(F.min(F.expr(gain)).alias("g"))
    return points.join(lowest, [*CLIP, "p_lo"], "left").selectExpr(*CLIP, "p_lo - t_start AS time_ms", "coalesce(g, 1.0D) AS value")


# --- edits ------------------------------------------------------------------------------


def _targets(clips: DataFrame, tracks: DataFrame, edits: DataFrame) -> DataFrame:
    """Edits with their clip and track; ``error`` says why an edit cannot apply."""
    old = clips.selectExpr(*CLIP, "track_id AS src_track", "start_ms AS old_start", "duration_ms AS len", "start_ms + duration_ms AS old_end", "trim_in_ms AS old_trim", "speed AS old_speed", "source_duration_ms AS src_len", "kind AS clip_kind", "true AS __found")
    lock = tracks.selectExpr("project_id", "track_id AS src_track", "locked AS src_locked")
    joined = edits.join(old, CLIP, "left").join(lock, ["project_id", "src_track"], "left")
    return joined.withColumn("error", F.expr(
        "CASE WHEN __found IS NULL THEN 'unknown-clip' WHEN src_locked IS NULL THEN 'unknown-track' WHEN src_locked THEN 'locked' END")).drop("__found", "src_locked")


def _fits(kind: str, track: str) -> str:
    return f"(({kind} IN ('video', 'image') AND {track} = 'video') OR ({kind} = 'audio' AND {track} = 'audio') OR ({kind} = 'text' AND {track} = 'text'))"


def _apply(clips: DataFrame, plan: DataFrame) -> DataFrame:
    """Clips next to the edit of their project. Plans have one row per project, so the clip side never gathers."""
    return clips.join(plan.withColumnRenamed("clip_id", "edited_id"), PROJECT, "left")


def _placed(clips: DataFrame, tracks: DataFrame, edits: DataFrame) -> DataFrame:
    to = tracks.selectExpr("project_id", "track_id AS to_track", "locked AS to_locked", "type AS to_type")
    plan = _targets(clips, tracks, edits).join(to, ["project_id", "to_track"], "left")
    return plan.withColumn("error", F.expr(
        f"coalesce(error, CASE WHEN to_start IS NULL OR to_start < 0 THEN 'bad-start' WHEN to_type IS NULL THEN 'unknown-target' WHEN to_locked THEN 'target-locked' "
        f"WHEN NOT {_fits('clip_kind', 'to_type')} THEN 'incompatible' END)"))


def move_clips(clips: DataFrame, tracks: DataFrame, edits: DataFrame, ripple: bool = False) -> DataFrame:
    """Move one clip per project; ``edits(project_id, clip_id, to_track, to_start)``. Overlaps reject the move."""
    plan = _placed(clips, tracks, edits)
    still = f"(src_track = to_track AND (abs(to_start - old_start) <= {EPS} OR abs(to_start - old_end) <= {EPS}))"
    follows = f"(src_track = to_track AND to_start >= old_end - {EPS})"
    plan = plan.withColumns({
        "noop": F.expr(still if ripple else "false"), "goal": F.expr(f"IF({follows}, greatest(0, to_start - len), to_start)" if ripple else "to_start"),
    })
    shift = f"IF(error IS NULL AND NOT noop AND track_id = src_track AND clip_id <> edited_id AND start_ms >= old_end - {EPS}, greatest(0, start_ms - len), start_ms)"
    moved = _apply(clips, plan).withColumn("new_start", F.expr(shift if ripple else "start_ms"))
    hit = f"clip_id <> edited_id AND track_id = to_track AND goal < new_start + duration_ms - {EPS} AND goal + len > new_start + {EPS}"
    clash = moved.where("error IS NULL AND NOT noop").groupBy("project_id").agg(F.max(F.expr(hit)).alias("clash"))
    done = moved.join(clash, PROJECT, "left").withColumn("error", F.expr("coalesce(error, IF(clash, 'overlap', NULL))"))
    ok = "edited_id IS NOT NULL AND error IS NULL AND NOT noop"
    return done.selectExpr(
        *CLIP, f"IF({ok} AND clip_id = edited_id, to_track, track_id) AS track_id",
        f"CASE WHEN NOT coalesce({ok}, false) THEN start_ms WHEN clip_id = edited_id THEN goal ELSE new_start END AS start_ms", "duration_ms", "error")


def insert_clips(clips: DataFrame, tracks: DataFrame, edits: DataFrame) -> DataFrame:
    """Insert move: take the clip out, close its gap, fill the gap before the edit point, push what no longer fits."""
    plan = _placed(clips, tracks, edits).withColumns({
        "noop": F.expr(f"src_track = to_track AND (abs(to_start - old_start) <= {EPS} OR abs(to_start - old_end) <= {EPS})"),
        "goal": F.expr(f"IF(src_track = to_track AND to_start >= old_end - {EPS}, greatest(0, to_start - len), to_start)"),
    })
    pulled = _apply(clips, plan).withColumn("at", F.expr(
        f"IF(error IS NULL AND NOT noop AND track_id = src_track AND clip_id <> edited_id AND start_ms >= old_end - {EPS}, greatest(0, start_ms - len), start_ms)"))
    mates = pulled.where("error IS NULL AND NOT noop AND clip_id <> edited_id AND track_id = to_track").withColumn("til", F.expr("at + duration_ms"))
    facts = mates.groupBy("project_id").agg(
        F.max(F.expr(f"goal > at + {EPS} AND goal < til - {EPS}")).alias("inside"),
        F.max(F.expr(f"IF(til <= goal + {EPS}, til, NULL)")).alias("left_end"),
        F.min(F.expr(f"IF(at >= goal - {EPS}, at, NULL)")).alias("right_start"),
    )
    done = pulled.join(facts, PROJECT, "left").withColumn("error", F.expr("coalesce(error, IF(inside, 'inside-clip', NULL))"))
    done = done.withColumn("slot", F.expr("least(goal, coalesce(left_end, 0))")).withColumn(
        "push", F.expr("IF(right_start IS NULL, 0, greatest(0, len - greatest(0, right_start - slot)))"))
    ok = "coalesce(edited_id IS NOT NULL AND error IS NULL AND NOT noop, false)"
    return done.selectExpr(
        *CLIP, f"IF({ok} AND clip_id = edited_id, to_track, track_id) AS track_id",
        f"CASE WHEN NOT {ok} THEN start_ms WHEN clip_id = edited_id THEN slot WHEN track_id = to_track AND at >= goal - {EPS} AND push > {EPS} THEN at + push ELSE at END AS start_ms",
        "duration_ms", "error")


def trim_clips(clips: DataFrame, tracks: DataFrame, edits: DataFrame, ripple: bool = False) -> DataFrame:
    """Trim one edge per project; ``edits(project_id, clip_id, edge, delta_ms)``, bounded by source, neighbours and minimum length."""
    plan = _targets(clips, tracks, edits)
    near = _apply(clips, plan).where("error IS NULL AND track_id = src_track AND clip_id <> edited_id").groupBy("project_id").agg(
        F.max(F.expr("IF(start_ms <= old_start, start_ms + duration_ms, NULL)")).alias("prev_end"),
        F.min(F.expr("IF(start_ms >= old_start, start_ms, NULL)")).alias("next_start"),
    )
    source_min = "(-old_trim / old_speed)"
    head_min = source_min if ripple else f"greatest({source_min}, -old_start, IF(prev_end IS NULL, -1e15D, least(0, prev_end - old_start)))"
    source_max = "IF(src_len IS NULL, 1e15D, greatest(0, (src_len - old_trim) / old_speed - len))"
    tail_max = source_max if ripple else f"least({source_max}, IF(next_start IS NULL, 1e15D, greatest(0, next_start - old_end)))"
    bounded = plan.join(near, PROJECT, "left").withColumn("applied", F.expr(
        f"IF(error IS NOT NULL OR delta_ms = 0, 0.0D, IF(edge = 'start', least(len - {MIN_MS}, greatest({head_min}, delta_ms)), least({tail_max}, greatest(-(len - {MIN_MS}), delta_ms))))"))
    own = "edited_id = clip_id"
    head = "edge = 'start'"
    follow = f"track_id = src_track AND NOT {own} AND start_ms >= old_end - {EPS}" if ripple else "false"
    new_start = "start_ms + 0.0D" if ripple else f"IF({head}, start_ms + applied, start_ms + 0.0D)"
    return _apply(clips, bounded.drop("prev_end", "next_start")).selectExpr(
        *CLIP, "track_id", f"CASE WHEN edited_id IS NULL OR error IS NOT NULL THEN start_ms + 0.0D WHEN {own} THEN {new_start} WHEN {follow} THEN greatest(0, start_ms + IF({head}, -applied, applied)) ELSE start_ms + 0.0D END AS start_ms",
        f"IF(coalesce({own}, false), duration_ms + IF({head}, -applied, applied), duration_ms + 0.0D) AS duration_ms",
        f"IF(coalesce({own} AND {head}, false), trim_in_ms + applied * speed, trim_in_ms + 0.0D) AS trim_in_ms", "error")


def delete_clips(clips: DataFrame, tracks: DataFrame, edits: DataFrame, ripple: bool = False) -> DataFrame:
    plan = _targets(clips, tracks, edits)
    joined = _apply(clips, plan)
    shift = f"IF(coalesce(error IS NULL AND track_id = src_track AND start_ms >= old_end - {EPS}, false), greatest(old_start, start_ms - len), start_ms)"
    return joined.where("edited_id IS NULL OR error IS NOT NULL OR clip_id <> edited_id").selectExpr(
        *CLIP, "track_id", f"{shift if ripple else 'start_ms'} AS start_ms", "duration_ms", "error")


def delete_tracks(tracks: DataFrame, clips: DataFrame, edits: DataFrame, cascade: bool = True) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Tracks, clips and outcome after deleting one track per project."""
    same = tracks.groupBy("project_id", "type").agg(F.count(F.lit(1)).alias("n_same"))
    used = clips.groupBy("project_id", "track_id").agg(F.count(F.lit(1)).alias("n_clips"))
    plan = edits.join(tracks, ["project_id", "track_id"], "left").join(same, ["project_id", "type"], "left").join(used, ["project_id", "track_id"], "left")
    refuse = "" if cascade else "WHEN n_clips > 0 THEN 'not-empty' "
    plan = plan.withColumn("error", F.expr(
        f"CASE WHEN type IS NULL THEN 'unknown-track' WHEN locked THEN 'locked' WHEN type = 'text' THEN 'text-track' WHEN n_same <= 1 THEN 'last-of-type' {refuse}END"))
    gone = plan.where("error IS NULL").select("project_id", "track_id")
    return tracks.join(gone, ["project_id", "track_id"], "left_anti"), clips.join(gone, ["project_id", "track_id"], "left_anti"), plan.select("project_id", "track_id", "error")


def split_clips(clips: DataFrame, tracks: DataFrame, edits: DataFrame) -> DataFrame:
    """Cut one clip per project at ``at_ms``; the second half gets ``new_id``."""
    plan = _targets(clips, tracks, edits).withColumn("cut", F.expr("at_ms - old_start")).withColumn(
        "error", F.expr(f"coalesce(error, IF(cut < {MIN_MS} OR cut > len - {MIN_MS}, 'outside', NULL))"))
    joined = _apply(clips, plan)
    hit = "coalesce(edited_id = clip_id AND error IS NULL, false)"
    halves = (
        f"explode(IF({hit}, array(struct(clip_id AS id, start_ms + 0.0D AS s, cut + 0.0D AS d, trim_in_ms + 0.0D AS i, 0 AS half), "
        "struct(new_id AS id, at_ms + 0.0D AS s, duration_ms - cut + 0.0D AS d, trim_in_ms + cut * speed AS i, 1 AS half)), "
        "array(struct(clip_id AS id, start_ms + 0.0D AS s, duration_ms + 0.0D AS d, trim_in_ms + 0.0D AS i, 0 AS half)))) AS h"
    )
    return joined.selectExpr("project_id", "track_id", "error", halves).selectExpr(
        "project_id", "h.id AS clip_id", "track_id", "h.s AS start_ms", "h.d AS duration_ms", "h.i AS trim_in_ms", "h.half AS half", "error")


def split_keyframes(keyframes: DataFrame, cuts: DataFrame) -> DataFrame:
    """Keyframes of both halves; a boundary frame is interpolated where none exists. ``cuts(project_id, clip_id, new_id, cut_ms)``."""
    key = [*CLIP, "property"]
    # Frames of clips that are not cut stay out, and the frames around a cut are found by one combined count of its clip's.
    placed = keyframes.join(cuts, CLIP)
    before, frame = "(time_ms IS NULL OR coalesce(time_ms <= cut_ms, false))", "struct(time_ms, value, easing)"
    # Of frames at one time the last written counts; the easing behind an edge without a frame before it is the first written's.
    edges = placed.groupBy(*key, "new_id", "cut_ms").agg(
        F.expr(f"max_by({frame}, struct(time_ms, ordinal)) FILTER (WHERE {before})").alias("prev"),
        F.expr(f"min_by({frame}, struct(time_ms, ordinal IS NULL, -ordinal)) FILTER (WHERE NOT {before})").alias("next"),
        F.expr(f"min_by(easing, struct(time_ms, ordinal)) FILTER (WHERE NOT {before})").alias("next_easing"),
    ).withColumns({"edge": _eased("cut_ms", F.lit(None).cast("double")), "edge_easing": F.coalesce("prev.easing", "next_easing")})
    own = placed.selectExpr(
        "project_id", "property", "value", "easing",
        "explode(array_compact(array(IF(time_ms <= cut_ms, struct(clip_id AS id, time_ms + 0.0D AS t), NULL), IF(time_ms >= cut_ms, struct(new_id AS id, time_ms - cut_ms + 0.0D AS t), NULL)))) AS e",
    ).selectExpr("project_id", "e.id AS clip_id", "property", "e.t AS time_ms", "value", "easing", "1 AS own")
    made = edges.selectExpr("project_id", "property", "explode(array(struct(clip_id AS id, cut_ms + 0.0D AS t), struct(new_id AS id, 0.0D AS t))) AS e", "edge", "edge_easing").selectExpr(
        "project_id", "e.id AS clip_id", "property", "e.t AS time_ms", "edge AS value", "edge_easing AS easing", "0 AS own")
    return own.unionByName(made).groupBy(*key, "time_ms").agg(F.max_by(F.struct("value", "easing"), "own").alias("k")).select(*key, "time_ms", "k.*")


def set_speed(clips: DataFrame, tracks: DataFrame, edits: DataFrame, keep: str = "source", ripple: bool = False) -> DataFrame:
    """``edits(project_id, clip_id, new_speed)``; keeps the source span or the timeline length."""
    plan = _targets(clips, tracks, edits).withColumn("error", F.expr("coalesce(error, IF(new_speed IS NULL OR new_speed NOT BETWEEN 0.05 AND 16, 'bad-speed', NULL))"))
    length = f"greatest({MIN_MS}, len * old_speed / new_speed)" if keep == "source" else "len + 0.0D"
    plan = plan.withColumn("new_len", F.expr(f"IF(error IS NULL, {length}, len + 0.0D)"))
    own = "coalesce(edited_id = clip_id AND error IS NULL, false)"
    follow = f"coalesce(error IS NULL AND track_id = src_track AND clip_id <> edited_id AND start_ms >= old_end - {EPS}, false)" if ripple else "false"
    return _apply(clips, plan).selectExpr(
        *CLIP, "track_id", f"IF({follow}, start_ms + new_len - len, start_ms + 0.0D) AS start_ms", f"IF({own}, new_len, duration_ms + 0.0D) AS duration_ms",
        f"IF({own}, new_speed, speed) AS speed", "error")


def set_track_state(tracks: DataFrame, edits: DataFrame) -> DataFrame:
    """Flags and bounded gain/pan; null edit fields keep the old value."""
    key = ["project_id", "track_id"]
    new = edits.select(*key, *[F.col(c).alias(f"__{c}") for c in ("muted", "solo", "locked", "gain", "pan")])
    return tracks.join(new, key, "left").withColumns({
        **{c: F.coalesce(f"__{c}", c) for c in ("muted", "solo", "locked")},
        "gain": F.expr("IF(__gain IS NULL, gain, least(4.0D, greatest(0.0D, __gain)))"), "pan": F.expr("IF(__pan IS NULL, pan, least(1.0D, greatest(-1.0D, __pan)))"),
    }).drop("__muted", "__solo", "__locked", "__gain", "__pan")


def delete_ranges(clips: DataFrame, tracks: DataFrame, ranges: DataFrame, ripple: bool = False) -> DataFrame:
    """Remove clip-local ranges of one clip per project; left-overs shorter than a frame go with the range.

    Pieces are the complement of the merged ranges; with ripple each piece moves left by what was removed before it.
    """
    open_tracks = tracks.where("NOT locked").select("project_id", "track_id")
    lengths = clips.join(open_tracks, ["project_id", "track_id"], "left_semi").selectExpr(*CLIP, "duration_ms AS len")
    bounded = ranges.join(lengths, CLIP).selectExpr(
        *CLIP, "len", "least(len, greatest(0, least(start_ms, end_ms))) AS start_ms", "least(len, greatest(0, greatest(start_ms, end_ms))) AS end_ms"
    ).where(f"end_ms - start_ms >= {MIN_MS}")
    merged = merge_intervals(bounded, CLIP, gap=EPS, aggregates=[F.max("len").alias("len")])
    scanned = running(
        merged, CLIP, ["start_ms"],
        [
            Running("prev_end", "last", F.col("end_ms"), inclusive=False), Running("next_start", "last", F.col("start_ms"), inclusive=False, reverse=True),
            Running("ordinal", "count", F.lit(1)),
        ],
        time_chunk("start_ms"),
    )
    # A sliver before or after a range is removed with it.
    snapped = scanned.withColumns({
        "s": F.expr(f"IF(start_ms - coalesce(prev_end, 0) < {MIN_MS}, coalesce(prev_end, 0), start_ms)"),
        "e": F.expr(f"IF(coalesce(next_start, len) - end_ms < {MIN_MS}, coalesce(next_start, len), end_ms)"),
    })
    # Written once: pieces and totals would each derive it again, all of them in one task with all their sorts.
    removed = cut_lineage(running(snapped, CLIP, ["start_ms"], [Running("gone", "sum", F.expr("e - s"))], time_chunk("start_ms")).select(
        *CLIP, "len", "prev_end", "next_start", "ordinal", "s", "e", "gone"))
    head = "IF(prev_end IS NULL AND s > 0, struct(0L AS piece, 0L AS lo, s AS hi, 0L AS before), NULL)"
    after = "IF(coalesce(next_start, len) > e, struct(ordinal AS piece, e AS lo, coalesce(next_start, len) AS hi, gone AS before), NULL)"
    pieces = removed.selectExpr(*CLIP, f"explode(array_compact(array({head}, {after}))) AS p").select(*CLIP, "p.*")
    total = removed.groupBy(*CLIP).agg(F.sum(F.expr("e - s")).alias("removed"))
    base = clips.join(total, CLIP, "left")
    whole, edited = base.where("removed IS NULL").drop("removed"), base.where("removed IS NOT NULL")
    move = "before" if ripple else "0"
    cut = edited.join(pieces, CLIP).selectExpr(
        "project_id", "IF(piece = 0, clip_id, concat(clip_id, '~', piece)) AS clip_id", "track_id", f"start_ms + lo - {move} AS start_ms", "hi - lo AS duration_ms", "trim_in_ms + lo * speed AS trim_in_ms")
    shifts = edited.selectExpr("project_id", "track_id", "removed", "start_ms AS o_start", "start_ms + duration_ms AS o_end")
    others = whole.join(shifts, ["project_id", "track_id"], "left")
    shift = f"IF(removed IS NOT NULL AND start_ms >= o_end - {EPS}, greatest(o_start, start_ms - removed), start_ms)" if ripple else "start_ms"
    return cut.unionByName(others.selectExpr("project_id", "clip_id", "track_id", f"{shift} AS start_ms", "duration_ms", "trim_in_ms + 0.0D AS trim_in_ms"))


def spaced_times(times: DataFrame, keys: list[str], at: str, spacing: float, first: str | None = None, extra: tuple[str, ...] = ()) -> DataFrame:
    """Greedy left-to-right choice of times at least ``spacing`` apart, from the optional ``first`` column (one value a key) on."""

    def step(state, row):
        now, start = row[0], row[1]
        last = start if state is None else state[0]
        if last is not None and now - last < spacing:
            return [last], []
        return [now], [(now, *row[2:])]

    frame = times.withColumn("__first", F.col(first).cast("double") if first else F.lit(None).cast("double"))
    frame = frame.withColumn(at, F.col(at).cast("double"))
    # Arrow hands missing numbers to Python as NaN.
    def safe(state, row):
        return step(state, (row[0], None if row[1] != row[1] else row[1], *row[2:]))

    fields = [T.StructField(at, T.DoubleType()), *[times.schema[c] for c in extra]]
    return ordered_fold(frame, keys, [at], [at, "__first", *extra], safe, fields)


def split_visuals(clips: DataFrame, tracks: DataFrame, times: DataFrame, minimum_ms: float = 100.0) -> DataFrame:
    """Split unlocked visual clips at marker times; pieces keep the minimum length on both sides."""
    close = running(times.select("project_id", "time_ms").distinct(), PROJECT, ["time_ms"], [Running("__p", "last", F.col("time_ms"), inclusive=False)], time_chunk("time_ms"))
    marks = close.where("__p IS NULL OR time_ms - __p > 20").selectExpr("project_id", "time_ms AS m_lo", "time_ms AS m_hi")
    open_tracks = tracks.where("NOT locked").select("project_id", "track_id")
    visual = clips.where("kind IN ('video', 'image')").join(open_tracks, ["project_id", "track_id"], "left_semi").withColumn("end_ms", F.expr("start_ms + duration_ms"))
    hits = overlap_join(visual.selectExpr(*CLIP, "start_ms", "end_ms"), marks, PROJECT, ("start_ms", "end_ms"), ("m_lo", "m_hi"), 60_000).where(
        f"m_lo > start_ms + {minimum_ms} AND m_lo < end_ms - {minimum_ms}")
    # After each accepted cut the rest of the clip starts there; a mark must lie strictly beyond the minimum.
    cuts = spaced_times(hits.withColumn("__s", F.col("start_ms").cast("double")), CLIP, "m_lo", minimum_ms + 1e-6, "__s")
    ends = cuts.selectExpr(*CLIP, "CAST(m_lo AS BIGINT) AS cut_ms")
    edges = ends.unionByName(visual.selectExpr(*CLIP, "start_ms AS cut_ms"))
    pieces = running(edges, CLIP, ["cut_ms"], [Running("until", "last", F.col("cut_ms"), inclusive=False, reverse=True), Running("piece", "count", F.lit(1))], time_chunk("cut_ms"))
    split = pieces.join(visual.drop("end_ms"), CLIP).selectExpr(
        "project_id", "IF(piece = 1, clip_id, concat(clip_id, '~', piece - 1)) AS clip_id", "track_id", "cut_ms AS start_ms",
        "coalesce(until, start_ms + duration_ms) - cut_ms AS duration_ms", "trim_in_ms + (cut_ms - start_ms) * speed AS trim_in_ms")
    rest = clips.join(visual.select(*CLIP), CLIP, "left_anti").selectExpr("project_id", "clip_id", "track_id", "start_ms", "duration_ms", "trim_in_ms + 0.0D AS trim_in_ms")
    return split.unionByName(rest)


def distinct_markers(markers: DataFrame, keys: list[str], tolerance_ms: float = 20.0) -> DataFrame:
    """Markers closer than the tolerance to the kept one collapse; a stronger or a downbeat marker takes its place."""

    def step(state, row):
        at, confidence, down = float(row[0]), float(row[1]), bool(row[2])
        if state is not None and abs(state[0] - at) < tolerance_ms:
            return ([at, confidence, down] if confidence > state[1] or down else state), []
        return [at, confidence, down], ([] if state is None else [tuple(state)])

    fields = [T.StructField("timeline_ms", T.DoubleType()), T.StructField("confidence", T.DoubleType()), T.StructField("downbeat", T.BooleanType())]
    return ordered_fold(
        markers, keys, ["timeline_ms", "source_ms"], ["timeline_ms", "confidence", "downbeat"], step, fields,
        finish=lambda s: [] if s is None else [tuple(s)])


def beat_cuts(markers: DataFrame, ranges: DataFrame, keys: list[str], mode: str, min_shot_ms: float = 350.0) -> DataFrame:
    """Cut times on downbeats, every second or every beat, spaced by the minimum shot length."""
    unique = distinct_markers(markers, keys)
    numbered = running(unique, keys, ["timeline_ms"], [Running("n", "count", F.lit(1))], time_chunk("timeline_ms"))
    chosen = {"downbeat": "downbeat", "every-2": "n % 2 = 1", "every-beat": "true"}[mode]
    inside = numbered.where(chosen).join(ranges, keys).where(f"timeline_ms >= range_start + {min_shot_ms} AND timeline_ms <= range_end - {min_shot_ms}")
    return spaced_times(inside.select(*keys, "timeline_ms", "range_start"), keys, "timeline_ms", min_shot_ms, "range_start")


def smart_beat_cuts(markers: DataFrame, ranges: DataFrame, keys: list[str], min_shot_ms: float = 350.0, max_shot_ms: float = 4000.0) -> DataFrame:
    """Chain of cuts with the best score and bounded shot lengths, per clip.

    A cut scores its confidence (0.45 more on a downbeat) less 0.28 times the relative distance of its shot from the
    middle length; the last shot may be 1.35 times as long. Two folds find the chain: one along time links each
    point to its best predecessor, knowing only the points of the last longest shot, and one against time follows
    those links back from the end. Both carry a bounded state, so long clips are folded in chunks.
    """
    unique = distinct_markers(markers, keys).join(ranges, keys)
    inside = unique.where(f"timeline_ms >= range_start + {min_shot_ms} AND timeline_ms <= range_end - {min_shot_ms}")
    edges = inside.select(*keys, "range_start", "range_end").distinct().selectExpr(
        *keys, "explode(array(struct(range_start AS at_ms, 'start' AS role), struct(range_end AS at_ms, 'end' AS role))) AS e").selectExpr(*keys, "e.at_ms AS at_ms", "e.role AS role", "0.0D AS gain")
    points = inside.selectExpr(*keys, "CAST(timeline_ms AS DOUBLE) AS at_ms", "'cut' AS role", "confidence + IF(downbeat, 0.45D, 0.0D) AS gain").unionByName(
        edges.withColumn("at_ms", F.col("at_ms").cast("double")))
    middle = min(max((min_shot_ms + max_shot_ms) / 2, min_shot_ms), max_shot_ms)

    def link(state, point):
        at, role, gain = point
        if role == "start":
            return [[at, 0.0]], [(at, role, None)]
        longest = max_shot_ms * (1.35 if role == "end" else 1.0)
        near = [(at_, value) for at_, value in state or [] if at - at_ <= max_shot_ms * 1.35]
        offers = [(value + gain - abs(at - at_ - middle) / max(middle, 1.0) * 0.28, at_) for at_, value in near if min_shot_ms <= at - at_ <= longest]
        if not offers:
            return [list(x) for x in near], []
        value, came_from = max(offers, key=lambda offer: (offer[0], -offer[1]))
        return [*[list(x) for x in near], [at, value]], [(at, role, came_from)]

    fields = [T.StructField("at_ms", T.DoubleType()), T.StructField("role", T.StringType()), T.StructField("from_ms", T.DoubleType())]
    linked = ordered_fold(points, keys, ["at_ms"], ["at_ms", "role", "gain"], link, fields, chunk=time_chunk("at_ms"))

    def follow(wanted, point):
        at, role, came_from = point
        if role == "end":
            return came_from, []
        if wanted is None or at != wanted or role == "start":
            return wanted, []
        return came_from, [(at,)]

    backwards = linked.withColumn("before_end", -F.col("at_ms"))
    return ordered_fold(backwards, keys, ["before_end"], ["at_ms", "role", "from_ms"], follow, [T.StructField("cut_ms", T.DoubleType())], chunk=time_chunk("before_end"))


def first_free_start(requests: DataFrame, clips: DataFrame) -> DataFrame:
    """Earliest start at or after the wanted one where the span fits between the clips of a track.

    ``requests(project_id, request_id, track_id, wanted_ms, length_ms)``.
    """
    key = ["project_id", "track_id"]
    busy = merge_intervals(clips.selectExpr(*key, "start_ms", "start_ms + duration_ms AS end_ms"), key)
    gaps = running(busy, key, ["start_ms"], [Running("nx", "last", F.col("start_ms"), inclusive=False, reverse=True)], time_chunk("start_ms"))
    after = gaps.selectExpr(*key, "end_ms AS lo", "nx AS hi")
    head = busy.groupBy(*key).agg(F.min("start_ms").alias("hi")).selectExpr(*key, "0L AS lo", "hi")
    free = after.unionByName(head)
    fits = requests.join(free, key).withColumn("at", F.expr("greatest(wanted_ms, lo)")).where("at + length_ms <= coalesce(hi, 9000000000000000)")
    best = fits.groupBy("project_id", "request_id").agg(F.min("at").alias("free_ms"))
    return requests.join(best, ["project_id", "request_id"], "left").withColumn("free_ms", F.coalesce("free_ms", F.greatest(F.lit(0), "wanted_ms")))


def separate_audio(clips: DataFrame, tracks: DataFrame, edits: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Copy a video clip's sound to the first open voice track (or a new one) and mute the original."""
    plan = _targets(clips, tracks, edits).where("error IS NULL AND clip_kind = 'video'").select(*CLIP)
    voice = tracks.where("type = 'audio' AND NOT locked AND name RLIKE '(?i)^voice(\\\\s+\\\\d+)?$'").groupBy("project_id").agg(F.min_by("track_id", "track_idx").alias("voice_track"))
    taken = tracks.groupBy("project_id").agg(F.collect_set(F.lower("name")).alias("names"))
    named = plan.join(voice, PROJECT, "left").join(taken, PROJECT).withColumn("new_name", F.expr(
        "IF(voice_track IS NOT NULL, NULL, IF(NOT array_contains(names, 'voice'), 'Voice', concat('Voice ', filter(sequence(2, size(names) + 2), i -> NOT array_contains(names, concat('voice ', i)))[0])))"))
    placed = named.withColumn("voice_track", F.expr("coalesce(voice_track, concat('a-voice-', clip_id))")).drop("names")
    fresh = placed.where("new_name IS NOT NULL").selectExpr("project_id", "voice_track AS track_id", "new_name AS name", "'audio' AS type")
    joined = clips.join(placed.drop("new_name"), CLIP, "left")
    muted = joined.selectExpr("project_id", "clip_id", "track_id", "kind", "start_ms", "duration_ms", "IF(voice_track IS NULL, volume, 0.0D) AS volume", "voice_track IS NOT NULL AS audio_separated")
    copies = joined.where("voice_track IS NOT NULL").selectExpr("project_id", "concat(clip_id, '-voice') AS clip_id", "voice_track AS track_id", "'audio' AS kind", "start_ms", "duration_ms", "volume", "false AS audio_separated")
    return muted.unionByName(copies), fresh


def replace_generated(clips: DataFrame, tracks: DataFrame, fresh: DataFrame, prefix: str) -> DataFrame:
    """Swap the generated clips of a source prefix; a locked or non-text track in the way rejects the project."""
    old = clips.where(F.col("file").startswith(prefix)).select("project_id", "track_id")
    want = fresh.select("project_id", "track_id")
    key = ["project_id", "track_id"]
    blocked = tracks.join(old.distinct(), key, "left_semi").where("locked").select("project_id").unionByName(
        tracks.join(want.distinct(), key, "left_semi").where("locked OR type <> 'text'").select("project_id")
    ).unionByName(fresh.where(F.expr("kind <> 'text'") | ~F.col("file").startswith(prefix)).select("project_id")).distinct()
    go = want.select("project_id").distinct().join(blocked, PROJECT, "left_anti").withColumn("__go", F.lit(True))
    kept = clips.join(go, PROJECT, "left").where((~F.col("file").startswith(prefix)) | F.col("__go").isNull()).drop("__go")
    return kept.unionByName(fresh.join(go.drop("__go"), PROJECT, "left_semi").select(*kept.columns))


def paste_clips(clips: DataFrame, tracks: DataFrame, edits: DataFrame) -> DataFrame:
    """Paste position per project: preferred, then original, then first compatible open track; first free start there.

    ``edits(project_id, clip_id, wanted_ms, preferred_track)``.
    """
    source = edits.join(clips.selectExpr(*CLIP, "track_id AS own_track", "kind", "duration_ms AS length_ms"), CLIP)
    fits = source.join(tracks.where("NOT locked"), PROJECT).where(_fits("kind", "type"))
    best = fits.groupBy(*CLIP).agg(F.expr("min_by(track_id, struct(IF(track_id = preferred_track, 0, IF(track_id = own_track, 1, 2)), track_idx)) AS track_id"))
    asked = best.join(source, CLIP).selectExpr("project_id", "clip_id AS request_id", "track_id", "wanted_ms", "length_ms")
    return first_free_start(asked, clips)


def change_transition(clips: DataFrame, edits: DataFrame, defaults: DataFrame) -> DataFrame:
    """Change type or duration of one transition side; ``edits(project_id, clip_id, side, new_type, new_ms)``.

    ``defaults(type, default_ms)`` gives the length of a type that had none.
    """
    joined = clips.join(edits, CLIP).join(F.broadcast(defaults), F.col("new_type") == F.col("type"), "left")
    now_type, now_ms = "IF(side = 'in', in_type, out_type)", "IF(side = 'in', in_ms, out_ms)"
    room = "greatest(0, duration_ms - IF(side = 'in', out_ms, in_ms))"
    by_type = f"IF(type IS NULL OR type = 'none' OR {room} = 0, 'none', type)"
    wanted = f"IF({now_ms} > 0, {now_ms}, default_ms)"
    out_type = f"IF(new_type IS NOT NULL, {by_type}, IF(least({room}, greatest(0, new_ms)) = 0 OR {now_type} = 'none', 'none', {now_type}))"
    out_ms = f"IF(new_type IS NOT NULL, least({room}, greatest(0, {wanted})), least({room}, greatest(0, new_ms)))"
    return joined.selectExpr(*CLIP, "side", f"{out_type} AS type", f"CAST(IF({out_type} = 'none', 0, {out_ms}) AS BIGINT) AS ms")


def place_spans(requests: DataFrame, clips: DataFrame, slack_ms: int = 0) -> DataFrame:
    """Start that overlaps nothing: the wanted one, else beside the first clip in the way, else in the gap nearest to it.

    ``requests(project_id, request_id, track_id, wanted_ms, length_ms)``.
    """
    key = ["project_id", "track_id"]
    busy = clips.selectExpr(*key, "start_ms AS b_s", "start_ms + duration_ms AS b_e")
    asked = requests.selectExpr("*", f"wanted_ms + {slack_ms} AS __s", f"wanted_ms + length_ms - {slack_ms} AS __e")
    first = overlap_join(asked, busy, key, ("__s", "__e"), ("b_s", "b_e"), 60_000).groupBy("project_id", "request_id").agg(F.min(F.struct("b_s", "b_e")).alias("hit"))
    base = asked.drop("__s", "__e").join(first, ["project_id", "request_id"], "left")
    before = "abs(wanted_ms - (hit.b_s - length_ms)) <= abs(wanted_ms - hit.b_e)"
    near = base.selectExpr(
        "project_id", "request_id", "track_id", "length_ms",
        f"explode(array_compact(array(struct(0 AS stage, CAST(wanted_ms AS BIGINT) AS pos, 0.0D AS rank), IF(hit IS NULL, NULL, struct(1 AS stage, CAST(greatest(0, hit.b_s - length_ms) AS BIGINT) AS pos, IF({before}, 0.0D, 1.0D) AS rank)), "
        f"IF(hit IS NULL, NULL, struct(1 AS stage, CAST(hit.b_e AS BIGINT) AS pos, IF({before}, 1.0D, 0.0D) AS rank))))) AS c").select("project_id", "request_id", "track_id", "length_ms", "c.*")
    tested = near.selectExpr("*", f"pos + {slack_ms} AS __s", f"pos + length_ms - {slack_ms} AS __e")
    taken = overlap_join(tested, busy, key, ("__s", "__e"), ("b_s", "b_e"), 60_000).select("project_id", "request_id", "pos").distinct()
    free = near.join(taken, ["project_id", "request_id", "pos"], "left_anti").select("project_id", "request_id", "stage", "pos", "rank")
    islands = merge_intervals(busy.withColumnsRenamed({"b_s": "start_ms", "b_e": "end_ms"}), key)
    scanned = running(islands, key, ["start_ms"], [Running("nx", "last", F.col("start_ms"), inclusive=False, reverse=True), Running("pv", "last", F.col("end_ms"), inclusive=False)], time_chunk("start_ms"))
    head = scanned.where("pv IS NULL AND start_ms > 0").selectExpr(*key, "0L AS lo", "start_ms AS hi")
    gaps = scanned.selectExpr(*key, "end_ms AS lo", "nx AS hi").unionByName(head)
    fits = base.join(gaps, key).where("hi IS NULL OR hi - lo >= length_ms").selectExpr(
        "project_id", "request_id", "2 AS stage", "CAST(greatest(lo, IF(hi IS NULL, wanted_ms, least(wanted_ms, hi - length_ms))) AS BIGINT) AS pos", "IF(hi IS NULL, 1e15D, abs(wanted_ms - (lo + hi) / 2)) AS rank")
    best = free.unionByName(fits).groupBy("project_id", "request_id").agg(F.min_by("pos", F.struct("stage", "rank", "pos")).alias("start_ms"))
    return requests.join(best, ["project_id", "request_id"], "left").withColumn("start_ms", F.coalesce("start_ms", "wanted_ms"))


def place_media(media: DataFrame, clips: DataFrame, tracks: DataFrame, image_ms: int = 5_000) -> DataFrame:
    """New clips for dropped media on a compatible open track; images get a fixed length."""
    from cuelattice.operators.library import media_kind

    kind = media_kind(F.col("file"))
    fit = media.withColumn("file_kind", kind).join(tracks.select("project_id", "track_id", "type", "locked"), ["project_id", "track_id"]).where(
        "NOT locked AND type <> 'text' AND file_kind IS NOT NULL AND ((type = 'audio') = (file_kind = 'audio'))")
    asked = fit.selectExpr("project_id", "media_id AS request_id", "track_id", "wanted_ms", f"IF(file_kind = 'image', {image_ms}L, source_ms) AS length_ms", "IF(type = 'audio', 'audio', file_kind) AS kind", "file")
    return place_spans(asked, clips)
