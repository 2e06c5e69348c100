"""Registered queries over clips, tracks, keyframes and edit tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from cuelattice.operators import timeline as M
from cuelattice.plans import tables as T
from cuelattice.plans.registry import query
from cuelattice.plans.tables import with_tables

CK = ", ck AS (SELECT *, ['video','audio','text'][clip_idx % 3 + 1] AS kind FROM clips)"
KF = """, kf AS (SELECT project_id, clip_id, ['volume','pan','scale','riderGain'][k % 4 + 1] AS property, (k * duration_ms) // 11 AS time_ms,
  ((project_id * 13 + k * 29 + clip_idx * 7) % 101) / 50.0::DOUBLE AS value, ['linear','hold','ease-in','ease-out','ease-in-out'][k % 5 + 1] AS easing, k AS ordinal FROM clips, range(0, 12) r(k))"""


def _clips(spark, sf):
    return T.clips(spark, sf).withColumn("kind", F.expr("element_at(array('video','audio','text'), clip_idx % 3 + 1)"))


def _keyframes(spark, sf):
    return T.clips(spark, sf).selectExpr("project_id", "clip_id", "clip_idx", "duration_ms", "explode(sequence(0L, 11L)) AS k").selectExpr(
        "project_id", "clip_id", "element_at(array('volume','pan','scale','riderGain'), CAST(k % 4 AS INT) + 1) AS property", "(k * duration_ms) DIV 11 AS time_ms",
        "((project_id * 13 + k * 29 + clip_idx * 7) % 101) / 50.0D AS value",
        "element_at(array('linear','hold','ease-in','ease-out','ease-in-out'), CAST(k % 5 AS INT) + 1) AS easing", "k AS ordinal")


def _r6(df, *names):
    return df.withColumns({n: F.round(n, 6) for n in names})


TR = """, tc AS (SELECT *, ['none','crossfade','bogus','fx-ink'][(project_id + clip_idx) % 4 + 1] AS in_type, ((project_id * 3 + clip_idx) % 9) * 700 AS in_ms,
  ['spin','none','blur'][(project_id * 2 + clip_idx) % 3 + 1] AS out_type, ((project_id * 5 + clip_idx) % 11) * 600 AS out_ms FROM ck)"""


def _with_transitions(spark, sf):
    return _clips(spark, sf).selectExpr(
        "*", "element_at(array('none','crossfade','bogus','fx-ink'), CAST((project_id + clip_idx) % 4 AS INT) + 1) AS in_type", "((project_id * 3 + clip_idx) % 9) * 700 AS in_ms",
        "element_at(array('spin','none','blur'), CAST((project_id * 2 + clip_idx) % 3 AS INT) + 1) AS out_type", "((project_id * 5 + clip_idx) % 11) * 600 AS out_ms")


_KNOWN = ", ".join(f"'{t}'" for t in M.TRANSITIONS)
ISSUES = TR + f""", tk AS (SELECT * FROM tracks WHERE NOT (project_id % 13 = 0 AND track_idx = 1)), bc AS (SELECT * REPLACE (CASE WHEN project_id % 17 = 0 THEN 't0' ELSE clip_id END AS clip_id) FROM tc)
, ids AS (SELECT project_id, track_id AS id FROM tk UNION ALL SELECT project_id, clip_id FROM bc)
, dup AS (SELECT project_id, id, count(*) AS n FROM ids GROUP BY 1, 2 HAVING count(*) > 1)
, ov AS (SELECT b.*, lag(start_ms + duration_ms) OVER (PARTITION BY b.project_id, track_id ORDER BY start_ms, clip_idx) AS pe FROM bc b SEMI JOIN tk USING (project_id, track_id))
SELECT project_id, id AS clip_id, 'duplicate-id' AS code, (n - 1)::BIGINT AS n FROM dup
UNION ALL SELECT project_id, clip_id, 'missing-track', count(*) FROM bc ANTI JOIN tk USING (project_id, track_id) GROUP BY 1, 2
UNION ALL SELECT project_id, clip_id, code, count(*) FROM (
  SELECT project_id, clip_id, 'source-overrun' AS code FROM bc WHERE trim_in_ms + duration_ms * speed > source_duration_ms + 0.001
  UNION ALL SELECT project_id, clip_id, 'invalid-transition' FROM bc WHERE in_type NOT IN ({_KNOWN}) UNION ALL SELECT project_id, clip_id, 'invalid-transition' FROM bc WHERE out_type NOT IN ({_KNOWN})
  UNION ALL SELECT project_id, clip_id, 'transition-too-long' FROM bc WHERE in_ms > duration_ms UNION ALL SELECT project_id, clip_id, 'transition-too-long' FROM bc WHERE out_ms > duration_ms
  UNION ALL SELECT project_id, clip_id, 'transition-overlap' FROM bc WHERE in_ms + out_ms > duration_ms
  UNION ALL SELECT project_id, clip_id, 'overlap' FROM ov WHERE start_ms < pe) GROUP BY 1, 2, 3"""


@query("prj_05_validate_timeline", with_tables("clips tracks", CK + ISSUES), sized="lineitem")
def _(spark, sf):
    clips = _with_transitions(spark, sf).withColumn("clip_id", F.expr("IF(project_id % 17 = 0, 't0', clip_id)"))
    tracks = T.tracks(spark, sf).where("NOT (project_id % 13 = 0 AND track_idx = 1)")
    return M.timeline_issues(clips, tracks).groupBy("project_id", "clip_id", "code").agg(F.count("*").alias("n"))


@query("prj_06_validate_render_graph", with_tables("clips tracks", CK + """, tk AS (SELECT *, (project_id % 19) * 0.25 AS gain, 0.0 AS pan FROM tracks)
, b AS (SELECT c.*, t.type, CASE WHEN t.type IS NULL THEN 'bad-track' WHEN NOT ((t.type = 'video' AND kind IN ('video','image')) OR (t.type = 'audio' AND kind IN ('audio','video')) OR (t.type = 'text' AND kind = 'text')) THEN 'incompatible'
   WHEN volume * 5 > 4 THEN 'volume' WHEN kind = 'text' AND project_id % 3 = 0 THEN 'text' WHEN kind <> 'text' AND project_id % 7 = 3 THEN 'path' END AS code FROM ck c LEFT JOIN tk t USING (project_id, track_id))
, al AS (SELECT project_id, 0 AS st, track_idx AS o, 'track' AS code, track_id AS id FROM tk WHERE gain > 4 UNION ALL SELECT project_id, 1, clip_idx, code, clip_id FROM b WHERE code IS NOT NULL)
SELECT project_id, arg_min(code, (st, o)) AS code, arg_min(id, (st, o)) AS id FROM al GROUP BY 1"""))
def _(spark, sf):
    tracks = T.tracks(spark, sf).withColumns({"gain": F.expr("(project_id % 19) * 0.25D"), "pan": F.lit(0.0)})
    clips = _clips(spark, sf).withColumns({
        "volume": F.expr("volume * 5"), "pan": F.lit(0.0), "content": F.expr("IF(project_id % 3 = 0, ' ', 'hello')"), "path": F.expr("IF(project_id % 7 = 3, NULL, 'a.mp4')")})
    return M.render_issues(clips, tracks)


@query("prj_07_validate_keyframes", with_tables("clips", KF + """
, k2 AS (SELECT kf.*, duration_ms, CASE property WHEN 'scale' THEN 0.01 WHEN 'pan' THEN -1 ELSE 0 END AS lo, CASE property WHEN 'scale' THEN 20 WHEN 'pan' THEN 1 WHEN 'volume' THEN 4 WHEN 'riderGain' THEN 4 END AS hi FROM kf JOIN clips USING (project_id, clip_id))
SELECT project_id, clip_id, property, time_ms + 100 AS time_ms, CASE WHEN time_ms + 100 > duration_ms THEN 'beyond-clip' ELSE 'out-of-range' END AS code FROM k2 WHERE time_ms + 100 > duration_ms OR value < lo OR value > hi"""))
def _(spark, sf):
    frames = _keyframes(spark, sf).withColumn("time_ms", F.col("time_ms") + 100)
    return M.keyframe_issues(frames, T.clips(spark, sf))


@query("prj_10_normalize_clips", with_tables("clips tracks", """SELECT c.project_id, clip_id, coalesce(CASE WHEN clip_idx % 2 = 0 THEN 'image' END, CASE t.type WHEN 'audio' THEN 'audio' WHEN 'text' THEN 'text' ELSE 'video' END) AS kind,
 greatest(0, start_ms - 20000)::DOUBLE AS start_ms, greatest(1000.0::DOUBLE / 120, duration_ms - 3000)::DOUBLE AS duration_ms, least(16, greatest(0.05, speed * 12 - 5))::DOUBLE AS speed, round(least(4, volume * 6), 6) AS volume, round(least(1, greatest(-1, volume * 3 - 1.5)), 6) AS pan
FROM clips c LEFT JOIN tracks t USING (project_id, track_id)"""))
def _(spark, sf):
    raw = T.clips(spark, sf).selectExpr(
        "project_id", "clip_id", "track_id", "IF(clip_idx % 2 = 0, 'image', NULL) AS kind", "CAST(start_ms - 20000 AS DOUBLE) AS start_ms", "CAST(duration_ms - 3000 AS DOUBLE) AS duration_ms",
        "CAST(trim_in_ms AS DOUBLE) AS trim_in_ms", "speed * 12 - 5 AS speed", "volume * 6 AS volume", "volume * 3 - 1.5D AS pan", "double('NaN') AS opacity")
    out = M.normalize_clips(raw, T.tracks(spark, sf))
    return _r6(out.select("project_id", "clip_id", "kind", "start_ms", "duration_ms", "speed", "volume", "pan"), "volume", "pan")


@query("prj_11_clamp_transitions", with_tables("clips", CK + TR + f""", a AS (SELECT *, CASE WHEN in_type IN ({_KNOWN}) THEN in_type ELSE 'none' END AS it, CASE WHEN out_type IN ({_KNOWN}) THEN out_type ELSE 'none' END AS ot FROM tc)
, b AS (SELECT *, CASE WHEN it = 'none' THEN 0 ELSE least(duration_ms, in_ms) END AS i FROM a)
SELECT project_id, clip_id, it AS in_type, i AS in_ms, ot AS out_type, CASE WHEN ot = 'none' THEN 0 ELSE least(duration_ms - i, out_ms) END AS out_ms FROM b"""))
def _(spark, sf):
    return M.clamp_transitions(_with_transitions(spark, sf)).select("project_id", "clip_id", "in_type", "in_ms", "out_type", "out_ms")


@query("prj_12_normalize_keyframes", with_tables("clips", KF + """
SELECT project_id, clip_id, property, ordinal, greatest(0, time_ms - 500)::DOUBLE AS time_ms, round(CASE WHEN property = 'riderGain' THEN least(4, greatest(0, CASE WHEN ordinal % 5 = 2 THEN 1 ELSE value * 4 - 2 END)) ELSE CASE WHEN ordinal % 5 = 2 THEN 0 ELSE value * 4 - 2 END END, 6)::DOUBLE AS value FROM kf"""))
def _(spark, sf):
    raw = _keyframes(spark, sf).withColumns({"time_ms": F.expr("CAST(time_ms - 500 AS DOUBLE)"), "value": F.expr("IF(ordinal % 5 = 2, double('NaN'), value * 4 - 2)")})
    return M.normalize_keyframes(raw).selectExpr("project_id", "clip_id", "property", "ordinal", "time_ms", "round(value, 6) AS value")


@query("prj_23_snapshot_check", with_tables("clips tracks", """, tk AS (SELECT * FROM tracks WHERE NOT (project_id % 13 = 0 AND track_idx = 1))
SELECT project_id, bool_and(t.track_id IS NOT NULL AND project_id % 29 <> 4) AS valid FROM clips c LEFT JOIN tk t USING (project_id, track_id) GROUP BY 1"""))
def _(spark, sf):
    clips = T.clips(spark, sf).withColumn("file", F.expr("IF(project_id % 29 = 4, NULL, 'x.mp4')")).withColumn("start_ms", F.col("start_ms").cast("double"))
    return M.snapshot_checks(clips, T.tracks(spark, sf).where("NOT (project_id % 13 = 0 AND track_idx = 1)"))


@query("src_21_snapshot_export", with_tables("clips", """, s AS (SELECT project_id, clip_id, start_ms / 1000.0::DOUBLE + 0.0004 AS st, duration_ms / 1000.0::DOUBLE AS du, trim_in_ms / 1000.0::DOUBLE AS tr FROM clips)
, d AS (SELECT project_id, floor(max(st + du) * 1000 + 0.5)::BIGINT AS project_ms FROM s GROUP BY 1)
SELECT s.project_id, clip_id, floor(st * 1000 + 0.5)::BIGINT AS start_ms, floor(du * 1000 + 0.5)::BIGINT AS duration_ms, floor(tr * 1000 + 0.5)::BIGINT AS trim_in_ms, project_ms FROM s JOIN d USING (project_id)"""))
def _(spark, sf):
    seconds = T.clips(spark, sf).selectExpr("project_id", "clip_id", "start_ms / 1000.0D + 0.0004D AS start", "duration_ms / 1000.0D AS duration", "trim_in_ms / 1000.0D AS trim_in")
    ms, total = M.snapshot(seconds)
    return ms.join(total.withColumnRenamed("duration_ms", "project_ms"), "project_id")


@query("agg_15_timeline_duration", with_tables("clips", "SELECT project_id, max(start_ms + duration_ms) AS duration_ms FROM clips GROUP BY 1"))
def _(spark, sf):
    return T.clips(spark, sf).groupBy("project_id").agg(F.max(F.expr("start_ms + duration_ms")).alias("duration_ms"))


@query("src_22_render_projection", with_tables("clips", KF + """, k AS (SELECT project_id, clip_id, time_ms // 500 * 500 AS at_ms, property, value, ordinal FROM kf UNION ALL SELECT project_id, clip_id, 250, 'duckGain', 0.5, 0 FROM clips)
SELECT project_id, clip_id, at_ms, round(arg_max(value, ordinal) FILTER (property = 'volume'), 6) AS volume, round(arg_max(value, ordinal) FILTER (property = 'pan'), 6) AS pan, round(arg_max(value, ordinal) FILTER (property = 'scale'), 6) AS scale_x,
 round(arg_max(value, ordinal) FILTER (property = 'scale'), 6) AS scale_y, round(arg_max(value, ordinal) FILTER (property = 'riderGain'), 6) AS rider_gain, round(arg_max(value, ordinal) FILTER (property = 'duckGain'), 6)::DOUBLE AS duck_gain FROM k GROUP BY 1, 2, 3"""))
def _(spark, sf):
    frames = _keyframes(spark, sf).withColumn("time_ms", F.expr("time_ms DIV 500 * 500"))
    duck = T.clips(spark, sf).selectExpr("project_id", "clip_id", "250L AS time_ms", "0.5D AS value")
    out = M.render_frames(frames, duck).select("project_id", "clip_id", "at_ms", "volume", "pan", "scale_x", "scale_y", "rider_gain", "duck_gain")
    return _r6(out, "volume", "pan", "scale_x", "scale_y", "rider_gain", "duck_gain")


EVAL = """, pt AS (SELECT project_id, clip_id, property, at_ms, q.base, max(k.time_ms) FILTER (k.time_ms <= at_ms) AS lt, min(k.time_ms) FILTER (k.time_ms > at_ms) AS rt,
   arg_max(k.value, (k.time_ms, k.ordinal)) FILTER (k.time_ms <= at_ms) AS lv, arg_max(k.easing, (k.time_ms, k.ordinal)) FILTER (k.time_ms <= at_ms) AS le, arg_min(k.value, (k.time_ms, -k.ordinal)) FILTER (k.time_ms > at_ms) AS rv
  FROM sq q LEFT JOIN kf k USING (project_id, clip_id, property) GROUP BY 1, 2, 3, 4, 5)
, pg AS (SELECT *, CASE WHEN rt > lt THEN (at_ms - lt) / (rt - lt)::DOUBLE END AS x FROM pt)
, evd AS (SELECT *, CASE WHEN lt IS NULL AND rt IS NULL THEN base WHEN lt IS NULL THEN rv WHEN rt IS NULL OR lt = at_ms THEN lv ELSE lv + (rv - lv) * CASE le WHEN 'hold' THEN 0 WHEN 'ease-in' THEN x * x WHEN 'ease-out' THEN 1 - (1 - x) * (1 - x)
   WHEN 'ease-in-out' THEN CASE WHEN x < 0.5 THEN 2 * x * x ELSE 1 - pow(2 - 2 * x, 2) / 2 END ELSE x END END AS v FROM pg)"""
SAMPLES = ", sq AS (SELECT project_id, clip_id, p.property, (k * duration_ms) // 7 AS at_ms, volume AS base FROM clips, (SELECT unnest(['volume','pan','x']) AS property) p, range(0, 8) r(k))"


def _samples(spark, sf):
    # A clip is one row, so equal times of a property are found inside it.
    return T.clips(spark, sf).selectExpr("project_id", "clip_id", "volume AS base", "duration_ms", "explode(array('volume','pan','x')) AS property").selectExpr(
        "project_id", "clip_id", "property", "base", "explode(array_distinct(transform(sequence(0L, 7L), k -> (k * duration_ms) DIV 7))) AS at_ms")


@query("join_04_keyframe_interpolation", with_tables("clips", KF + SAMPLES + EVAL + "SELECT project_id, clip_id, property, at_ms, round(v + 1e-9, 6) AS value FROM evd"), sized="lineitem")
def _(spark, sf):
    out = M.evaluate_keyframes(_samples(spark, sf), _keyframes(spark, sf), ["project_id", "clip_id", "property"], "at_ms", F.col("base"))
    return out.selectExpr("project_id", "clip_id", "property", "at_ms", "round(value + 1e-9, 6) AS value")


@query("win_17_envelope_evaluation", with_tables("clips", KF.replace("['linear','hold','ease-in','ease-out','ease-in-out'][k % 5 + 1]", "'linear'") + SAMPLES + EVAL + "SELECT project_id, clip_id, at_ms, round(v + 1e-9, 6) AS gain FROM evd WHERE property = 'volume'"), sized="lineitem")
def _(spark, sf):
    linear = _keyframes(spark, sf).withColumn("easing", F.lit("linear"))
    out = M.evaluate_keyframes(_samples(spark, sf).where("property = 'volume'"), linear, ["project_id", "clip_id", "property"], "at_ms", F.col("base"))
    return out.selectExpr("project_id", "clip_id", "at_ms", "round(value + 1e-9, 6) AS gain")


@query("join_03_active_at_time", with_tables("clips tracks", """, so AS (SELECT project_id, bool_or(solo) AS s FROM tracks GROUP BY 1), tm AS (SELECT DISTINCT project_id, unnest([5000, 20000, 41000]) AS at_ms FROM clips)
SELECT c.project_id, at_ms, clip_id, c.track_id, track_idx, type, at_ms - start_ms AS local_ms, round(trim_in_ms + (at_ms - start_ms) * speed, 6) AS source_ms FROM tm JOIN clips c ON c.project_id = tm.project_id AND at_ms >= start_ms AND at_ms < start_ms + duration_ms
JOIN tracks t ON t.project_id = c.project_id AND t.track_id = c.track_id JOIN so ON so.project_id = c.project_id WHERE NOT muted AND (NOT s OR solo)"""))
def _(spark, sf):
    times = T.clips(spark, sf).select("project_id").distinct().selectExpr("project_id", "explode(array(5000L, 20000L, 41000L)) AS at_ms")
    return _r6(M.frame_layers(times, T.clips(spark, sf), T.tracks(spark, sf)), "source_ms")


@query("top_09_layer_order", with_tables("clips tracks", """SELECT c.project_id, clip_id, row_number() OVER (PARTITION BY c.project_id ORDER BY track_idx, clip_idx) AS layer FROM clips c JOIN tracks t USING (project_id, track_id) WHERE 20000 >= start_ms AND 20000 < start_ms + duration_ms AND type <> 'audio'"""), sized="lineitem")
def _(spark, sf):
    from cuelattice.kernel.scan import Running, running

    alive = T.clips(spark, sf).where("20000 >= start_ms AND 20000 < start_ms + duration_ms").join(T.tracks(spark, sf).where("type <> 'audio'"), ["project_id", "track_id"])
    return running(alive, ["project_id"], ["track_idx", "clip_idx"], [Running("layer", "count", F.lit(1))], F.col("track_idx")).select("project_id", "clip_id", "layer")


BOUND = """, bd AS (SELECT project_id, -1 AS o, 0 AS b FROM clips GROUP BY 1 UNION ALL SELECT project_id, clip_idx * 2, start_ms FROM clips UNION ALL SELECT project_id, clip_idx * 2 + 1, start_ms + duration_ms FROM clips)
, rq AS (SELECT project_id, clip_id, start_ms + 333 AS t, duration_ms AS len FROM clips)
, cd AS (SELECT rq.project_id, clip_id, t, b AS c, o, 0 AS e FROM rq JOIN bd USING (project_id) UNION ALL SELECT rq.project_id, clip_id, t, b - len, o, 1 FROM rq JOIN bd USING (project_id))"""


@query("join_19_snap_to_boundary", with_tables("clips", BOUND + " SELECT project_id, clip_id AS request_id, t AS time_ms, coalesce(arg_min(c, (abs(t - c), o, e)) FILTER (abs(t - c) < 400), t) AS snapped_ms FROM cd GROUP BY 1, 2, 3"))
def _(spark, sf):
    clips = T.clips(spark, sf)
    bounds = clips.select("project_id").distinct().selectExpr("project_id", "-1 AS ordinal", "0L AS boundary_ms").unionByName(
        clips.selectExpr("project_id", "clip_idx * 2 AS ordinal", "start_ms AS boundary_ms")).unionByName(
        clips.selectExpr("project_id", "clip_idx * 2 + 1 AS ordinal", "start_ms + duration_ms AS boundary_ms"))
    wanted = clips.selectExpr("project_id", "clip_id AS request_id", "start_ms + 333 AS time_ms", "duration_ms AS length_ms")
    return M.snap_times(wanted, bounds, 400).select("project_id", "request_id", "time_ms", "snapped_ms")


@query("join_20_nearest_filled", with_tables("ev", """, s AS (SELECT user_id, rn AS idx, event_id % 4 = 0 AS rendered FROM ev), a AS (SELECT user_id, idx FROM s WHERE rendered)
SELECT s.user_id, s.idx, coalesce(arg_min(a.idx, (abs(a.idx - s.idx), a.idx)), -1) AS source_idx FROM s LEFT JOIN a USING (user_id) GROUP BY 1, 2"""), sized="events")
def _(spark, sf):
    return M.nearest_filled(T.numbered_events(spark, sf).selectExpr("user_id", "rn AS idx", "event_id % 4 = 0 AS rendered"), "user_id")


SEGS = ", sg AS (SELECT project_id, clip_id, k * 1700 AS s, least(k * 1700 + 900, duration_ms) AS e, ((project_id + clip_idx * 3 + k) % 10) / 10.0::DOUBLE AS conf FROM clips, range(0, 5) r(k) WHERE k * 1700 < duration_ms)"
DUCK = SEGS + """, so AS (SELECT project_id, bool_or(solo) AS s FROM tracks GROUP BY 1), au AS (SELECT t.project_id, t.track_id FROM tracks t JOIN so USING (project_id) WHERE NOT muted AND (NOT s OR solo) AND type <> 'text')
, tg AS (SELECT * FROM clips WHERE track_id = 't1')
, iv AS (SELECT tg.project_id, tg.clip_id, c.start_ms + sg.s AS s, c.start_ms + sg.e AS e FROM tg JOIN clips c ON c.project_id = tg.project_id AND c.track_id = 't0' AND c.clip_id <> tg.clip_id AND c.volume > 0.0001 JOIN au ON au.project_id = c.project_id AND au.track_id = 't0'
   JOIN sg ON sg.project_id = c.project_id AND sg.clip_id = c.clip_id AND conf >= 0.5 WHERE c.start_ms + sg.e > tg.start_ms - 180 AND c.start_ms + sg.s < tg.start_ms + tg.duration_ms + 810)
, ip AS (SELECT *, max(e) OVER (PARTITION BY project_id, clip_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pe FROM iv)
, ig AS (SELECT *, sum(CASE WHEN pe IS NULL OR s > pe + 120 THEN 1 ELSE 0 END) OVER (PARTITION BY project_id, clip_id ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS g FROM ip)
, im AS (SELECT project_id, clip_id, min(s) AS s, max(e) AS e FROM ig GROUP BY project_id, clip_id, g)"""


def _duck(spark, sf):
    clips = T.clips(spark, sf)
    segments = clips.selectExpr("project_id", "clip_id", "clip_idx", "duration_ms", "explode(sequence(0L, 4L)) AS k").where("k * 1700 < duration_ms").selectExpr(
        "project_id", "clip_id", "k * 1700 AS start_ms", "least(k * 1700 + 900, duration_ms) AS end_ms", "((project_id + clip_idx * 3 + k) % 10) / 10.0D AS confidence")
    targets = clips.where("track_id = 't1'").selectExpr(
        "project_id", "clip_id", "start_ms", "duration_ms", "'t0' AS source_track", "0.5D AS min_confidence", "-14.0D AS reduction_db",
        "80L AS lookahead_ms", "100L AS attack_ms", "160L AS hold_ms", "650L AS release_ms")
    return targets, M.duck_intervals(clips, T.tracks(spark, sf), segments, targets)


@query("join_15_duck_sources", with_tables("clips tracks", DUCK + "SELECT project_id, clip_id, s::BIGINT AS start_ms, e::BIGINT AS end_ms FROM im"), sized="lineitem")
def _(spark, sf):
    return _duck(spark, sf)[1]


# Release (650 ms) of one shape and attack (100 ms) of the next meet where their shares of the way add up to one.
ENV = DUCK + """, sh AS (SELECT im.project_id, im.clip_id, t.start_ms AS ts, t.duration_ms AS tl, pow(10, -14 / 20.0) AS d, s - 180 AS a0, s - 80 AS a1, e + 160 AS b0, e + 810 AS b1 FROM im JOIN tg t USING (project_id, clip_id))
, nx AS (SELECT *, lead(a0) OVER (PARTITION BY project_id, clip_id ORDER BY a0) AS na FROM sh), cr AS (SELECT *, (1 + b0 / 650.0 + na / 100.0) / (1 / 650.0 + 1 / 100.0) AS t FROM nx WHERE na IS NOT NULL AND least(b1, na + 100) > greatest(b0, na))
, tp AS (SELECT DISTINCT project_id, clip_id, ts, tl, round(t, 4)::DOUBLE AS t FROM (SELECT project_id, clip_id, ts, tl, unnest([a0, a1, b0, b1, ts, ts + tl]) AS t FROM sh UNION ALL SELECT project_id, clip_id, ts, tl, t FROM cr WHERE t BETWEEN greatest(b0, na) - 1e-9 AND least(b1, na + 100) + 1e-9))
SELECT tp.project_id, tp.clip_id, round(t - tp.ts, 3)::DOUBLE AS time_ms, round(min(CASE WHEN t <= a0 OR t >= b1 THEN 1 WHEN t < a1 THEN 1 + (d - 1) * (t - a0) / (a1 - a0) WHEN t <= b0 THEN d ELSE d + (1 - d) * (t - b0) / (b1 - b0) END), 5) AS value
FROM tp JOIN sh USING (project_id, clip_id) WHERE t BETWEEN tp.ts AND tp.ts + tp.tl GROUP BY 1, 2, 3"""


@query("win_16_ducking_envelope", with_tables("clips tracks", ENV), sized="lineitem")
def _(spark, sf):
    targets, merged = _duck(spark, sf)
    return M.duck_envelope(targets, merged).selectExpr("project_id", "clip_id", "round(time_ms, 3) AS time_ms", "round(value, 5) AS value")


@query("win_24_quiet_regions", with_tables("clips", """, k AS (SELECT project_id, clip_id, k * 500 AS t, (k // 2 % 3) * 0.2 AS v, k FROM clips, range(0, 8) r(k)), n AS (SELECT *, lead(t) OVER w AS nt, lead(v) OVER w AS nv FROM k WINDOW w AS (PARTITION BY project_id, clip_id ORDER BY t))
SELECT n.project_id, n.clip_id, t AS start_ms, nt AS end_ms, round(v, 6)::DOUBLE AS region_volume FROM n JOIN clips USING (project_id, clip_id) WHERE abs(v - nv) < 1e-6 AND v < volume - 0.01"""), sized="lineitem")
def _(spark, sf):
    frames = T.clips(spark, sf).selectExpr("project_id", "clip_id", "explode(sequence(0L, 7L)) AS k").selectExpr(
        "project_id", "clip_id", "'volume' AS property", "k * 500 AS time_ms", "CAST((k DIV 2 % 3) AS DOUBLE) * 0.2D AS value", "k AS ordinal")
    return _r6(M.quiet_regions(frames, T.clips(spark, sf)), "region_volume")


REGION = KF + """, ed AS (SELECT project_id, clip_id, duration_ms, volume AS base, least(duration_ms, 900) AS s, least(duration_ms, 2100) AS e FROM clips WHERE clip_idx = 1)
, sp AS (SELECT *, least(180, (e - s) / 3.0) AS f FROM ed WHERE e - s >= 0.001), sf AS (SELECT *, greatest(0, s - f)::DOUBLE AS fs, least(duration_ms, e + f)::DOUBLE AS fe FROM sp)
, sq AS (SELECT project_id, clip_id, 'volume' AS property, unnest([fs, fe]) AS at_ms, base FROM sf)""" + EVAL + """
SELECT k.project_id, k.clip_id, k.time_ms::DOUBLE AS time_ms, round(value, 6) AS value FROM kf k LEFT JOIN sf USING (project_id, clip_id) WHERE property = 'volume' AND (fs IS NULL OR k.time_ms < fs - 0.001 OR k.time_ms > fe + 0.001)
UNION ALL SELECT project_id, clip_id, round(fs, 6), round(v, 6) FROM sf JOIN evd USING (project_id, clip_id) WHERE at_ms = fs AND fs < s - 0.001 UNION ALL SELECT project_id, clip_id, s, 0.25 FROM sf UNION ALL SELECT project_id, clip_id, e, 0.25 FROM sf
UNION ALL SELECT project_id, clip_id, round(fe, 6), round(v, 6) FROM sf JOIN evd USING (project_id, clip_id) WHERE at_ms = fe AND fe > e + 0.001"""


@query("win_25_write_volume_region", with_tables("clips", REGION), sized="lineitem")
def _(spark, sf):
    clips = T.clips(spark, sf)
    edits = clips.where("clip_idx = 1").selectExpr("project_id", "clip_id", "2100.0D AS region_start", "900.0D AS region_end", "0.25D AS new_volume")
    frames = _keyframes(spark, sf).withColumn("time_ms", F.col("time_ms").cast("double"))
    return _r6(M.write_volume_region(frames, clips, edits).select("project_id", "clip_id", "time_ms", "value"), "time_ms", "value")


BEATCLIP = ", cb AS (SELECT *, (project_id % 97) AS asset_id FROM clips)"
PROJ = BEATCLIP + """, pb AS (SELECT c.project_id, c.clip_id, b.source_ms, b.confidence, b.downbeat, c.start_ms + (b.source_ms - c.trim_in_ms) / c.speed AS timeline_ms FROM cb c JOIN beats b ON b.asset_id = c.asset_id AND b.source_ms >= trim_in_ms AND b.source_ms <= trim_in_ms + duration_ms * speed)"""


def _projected(spark, sf):
    clips = T.clips(spark, sf).withColumn("asset_id", F.expr("project_id % 97"))
    return clips, M.project_source_beats(clips, T.beats(spark, sf))


@query("win_26_project_beats", with_tables("clips beats", PROJ + "SELECT project_id, clip_id, source_ms, downbeat, round(timeline_ms, 6) AS timeline_ms FROM pb"), sized="lineitem events")
def _(spark, sf):
    return _r6(_projected(spark, sf)[1].select("project_id", "clip_id", "source_ms", "downbeat", "timeline_ms"), "timeline_ms")


@query("win_27_project_speech", with_tables("segments assets", """, c AS (SELECT asset_id, least(duration_ms // 2 + 4000, greatest(4000, start_ms)) - 4000 AS s, least(duration_ms // 2 + 4000, greatest(4000, end_ms)) - 4000 AS e, confidence FROM segments JOIN assets USING (asset_id))
SELECT asset_id, s AS start_ms, e AS end_ms, confidence FROM c WHERE e - s >= 1"""))
def _(spark, sf):
    ranges = T.assets(spark, sf).selectExpr("asset_id", "4000L AS range_start", "duration_ms DIV 2 + 4000 AS range_end")
    return M.project_segments(T.segments(spark, sf), ranges)


@query("prj_21_analysis_currency", with_tables("clips", """SELECT project_id, clip_id, trim_in_ms >= 500 - 1 AND trim_in_ms + duration_ms * speed <= 500 + 9000 + 1 AS is_current FROM clips"""))
def _(spark, sf):
    stored = T.clips(spark, sf).selectExpr("project_id", "clip_id", "500L AS analyzed_start", "9000L AS analyzed_length")
    return T.clips(spark, sf).join(stored, ["project_id", "clip_id"], "left").selectExpr(
        "project_id", "clip_id", "coalesce(trim_in_ms >= analyzed_start - 1 AND trim_in_ms + duration_ms * speed <= analyzed_start + analyzed_length + 1, false) AS is_current")


# --- edits ---------------------------------------------------------------------------------

ED = ", ed AS (SELECT c.*, start_ms + duration_ms AS oe, t.locked FROM ck c JOIN tracks t USING (project_id, track_id) WHERE clip_id = 'c1')"


def _edit(spark, sf, **columns):
    return T.clips(spark, sf).where("clip_id = 'c1'").select("project_id", "clip_id", *[F.expr(v).alias(k) for k, v in columns.items()])


GOAL = "(project_id * 7 % 90) * 1000"
MOVE = CK + ED + f""", pl AS (SELECT project_id, track_id AS st, start_ms AS os, oe, duration_ms AS len, locked, {GOAL} AS g0 FROM ed)
, p2 AS (SELECT *, abs(g0 - os) <= 0.001 OR abs(g0 - oe) <= 0.001 AS noop, CASE WHEN g0 >= oe THEN greatest(0, g0 - len) ELSE g0 END AS g FROM pl)
, ns AS (SELECT c.*, p2.* EXCLUDE (project_id), CASE WHEN NOT locked AND NOT noop AND track_id = st AND clip_id <> 'c1' AND start_ms >= oe THEN greatest(0, start_ms - len) ELSE start_ms END AS n FROM ck c LEFT JOIN p2 ON p2.project_id = c.project_id)"""


@query("edt_01_move_clip", with_tables("clips tracks", MOVE + """, cl AS (SELECT project_id, bool_or(clip_id <> 'c1' AND track_id = st AND g < n + duration_ms - 0.001 AND g + len > n + 0.001) AS clash FROM ns WHERE NOT locked AND NOT noop GROUP BY 1)
SELECT ns.project_id, clip_id, track_id, CASE WHEN locked IS NULL OR locked OR noop OR clash THEN start_ms WHEN clip_id = 'c1' THEN g ELSE n END AS start_ms,
 CASE WHEN locked THEN 'locked' WHEN clash THEN 'overlap' END AS error FROM ns LEFT JOIN cl USING (project_id)"""))
def _(spark, sf):
    out = M.move_clips(_clips(spark, sf), T.tracks(spark, sf), _edit(spark, sf, to_track="'t1'", to_start=GOAL), ripple=True)
    return out.select("project_id", "clip_id", "track_id", "start_ms", "error")


@query("edt_02_insert_move", with_tables("clips tracks", MOVE + """, fa AS (SELECT project_id, bool_or(g > n + 0.001 AND g < n + duration_ms - 0.001) AS ins, max(n + duration_ms) FILTER (n + duration_ms <= g + 0.001) AS le, min(n) FILTER (n >= g - 0.001) AS rs FROM ns WHERE NOT locked AND NOT noop AND clip_id <> 'c1' AND track_id = st GROUP BY 1)
, fb AS (SELECT ns.*, ins, rs, least(g, coalesce(le, 0)) AS slot FROM ns LEFT JOIN fa USING (project_id)), fc AS (SELECT *, CASE WHEN rs IS NULL THEN 0 ELSE greatest(0, len - greatest(0, rs - slot)) END AS push FROM fb)
SELECT project_id, clip_id, CASE WHEN locked IS NULL OR locked OR noop OR ins THEN start_ms WHEN clip_id = 'c1' THEN slot WHEN track_id = st AND n >= g - 0.001 AND push > 0 THEN n + push ELSE n END AS start_ms, CASE WHEN locked THEN 'locked' WHEN ins THEN 'inside-clip' END AS error FROM fc"""))
def _(spark, sf):
    out = M.insert_clips(_clips(spark, sf), T.tracks(spark, sf), _edit(spark, sf, to_track="'t1'", to_start=GOAL))
    return out.select("project_id", "clip_id", "start_ms", "error")


DELTA = "((project_id * 11 % 80) - 40) * 100.0"
EDGE = "CASE WHEN project_id % 2 = 0 THEN 'start' ELSE 'end' END"
TRIM = CK + ED + f""", nb AS (SELECT e.project_id, max(c.start_ms + c.duration_ms) FILTER (c.start_ms <= e.start_ms) AS pe, min(c.start_ms) FILTER (c.start_ms >= e.start_ms) AS nx FROM ed e JOIN ck c ON c.project_id = e.project_id AND c.track_id = e.track_id AND c.clip_id <> 'c1' GROUP BY 1)
, ap AS (SELECT e.*, {EDGE} AS edge, CASE WHEN locked OR {DELTA} = 0 THEN 0 WHEN project_id % 2 = 0 THEN least(duration_ms - 1000.0::DOUBLE / 120, greatest(greatest(-trim_in_ms / speed, -start_ms, CASE WHEN pe IS NULL THEN -1e15 ELSE least(0, pe - start_ms) END), {DELTA}))
   ELSE least(least(greatest(0, (source_duration_ms - trim_in_ms) / speed - duration_ms), CASE WHEN nx IS NULL THEN 1e15 ELSE greatest(0, nx - oe) END), greatest(-(duration_ms - 1000.0::DOUBLE / 120), {DELTA})) END::DOUBLE AS a FROM ed e LEFT JOIN nb USING (project_id))
SELECT c.project_id, c.clip_id, round(CASE WHEN c.clip_id = 'c1' AND edge = 'start' THEN c.start_ms + a ELSE c.start_ms END, 6)::DOUBLE AS start_ms, round(CASE WHEN c.clip_id = 'c1' THEN c.duration_ms + CASE WHEN edge = 'start' THEN -a ELSE a END ELSE c.duration_ms END, 6)::DOUBLE AS duration_ms,
 round(CASE WHEN c.clip_id = 'c1' AND edge = 'start' THEN c.trim_in_ms + a * c.speed ELSE c.trim_in_ms END, 6)::DOUBLE AS trim_in_ms FROM ck c LEFT JOIN ap ON ap.project_id = c.project_id"""


@query("edt_03_trim_clip", with_tables("clips tracks", TRIM))
def _(spark, sf):
    edits = _edit(spark, sf, edge="IF(project_id % 2 = 0, 'start', 'end')", delta_ms="((project_id * 11 % 80) - 40) * 100.0D")
    out = M.trim_clips(_clips(spark, sf), T.tracks(spark, sf), edits)
    return _r6(out.select("project_id", "clip_id", "start_ms", "duration_ms", "trim_in_ms"), "start_ms", "duration_ms", "trim_in_ms")


@query("edt_04_delete_clip", with_tables("clips tracks", CK + ED + """
SELECT c.project_id, c.clip_id, CASE WHEN NOT e.locked AND c.track_id = e.track_id AND c.start_ms >= oe THEN greatest(e.start_ms, c.start_ms - e.duration_ms) ELSE c.start_ms END AS start_ms FROM ck c LEFT JOIN ed e ON e.project_id = c.project_id WHERE e.locked IS NULL OR e.locked OR c.clip_id <> 'c1'"""))
def _(spark, sf):
    return M.delete_clips(_clips(spark, sf), T.tracks(spark, sf), _edit(spark, sf), ripple=True).select("project_id", "clip_id", "start_ms")


@query("edt_05_delete_track", with_tables("clips tracks", """, tk AS (SELECT project_id, track_id, track_idx, type, locked FROM tracks UNION ALL SELECT project_id, 'v9', 9, 'video', false FROM tracks WHERE track_idx = 0 AND project_id % 2 = 0)
, ok AS (SELECT a.project_id FROM tk a WHERE track_id = 't0' AND NOT locked AND (SELECT count(*) FROM tk b WHERE b.project_id = a.project_id AND b.type = 'video') > 1)
SELECT project_id, track_id, 'track' AS what FROM tk WHERE NOT (track_id = 't0' AND project_id IN (SELECT project_id FROM ok)) UNION ALL SELECT project_id, clip_id, 'clip' FROM clips WHERE NOT (track_id = 't0' AND project_id IN (SELECT project_id FROM ok))"""))
def _(spark, sf):
    base = T.tracks(spark, sf).select("project_id", "track_id", "track_idx", "type", "locked")
    tracks = base.unionByName(base.where("track_idx = 0 AND project_id % 2 = 0").selectExpr("project_id", "'v9' AS track_id", "9 AS track_idx", "'video' AS type", "false AS locked"))
    left_tracks, left_clips, _ = M.delete_tracks(tracks, T.clips(spark, sf), base.select("project_id").distinct().withColumn("track_id", F.lit("t0")))
    return left_tracks.selectExpr("project_id", "track_id", "'track' AS what").unionByName(left_clips.selectExpr("project_id", "clip_id AS track_id", "'clip' AS what"))


@query("edt_06_split_clip", with_tables("clips tracks", CK + ED + """, h AS (SELECT c.*, e.project_id IS NOT NULL AND NOT e.locked AND c.clip_id = 'c1' AND 1500 >= 1000.0 / 120 AND 1500 <= c.duration_ms - 1000.0 / 120 AS cut FROM ck c LEFT JOIN ed e ON e.project_id = c.project_id)
SELECT project_id, clip_id, start_ms::DOUBLE AS start_ms, (CASE WHEN cut THEN 1500 ELSE duration_ms END)::DOUBLE AS duration_ms, trim_in_ms::DOUBLE AS trim_in_ms FROM h UNION ALL SELECT project_id, 'c1b', start_ms + 1500, duration_ms - 1500, trim_in_ms + 1500 * speed FROM h WHERE cut"""))
def _(spark, sf):
    out = M.split_clips(_clips(spark, sf), T.tracks(spark, sf), _edit(spark, sf, at_ms="start_ms + 1500", new_id="'c1b'"))
    return out.select("project_id", "clip_id", "start_ms", "duration_ms", "trim_in_ms")


@query("edt_06_split_keyframes", with_tables("clips", KF + """, ct AS (SELECT project_id, clip_id, duration_ms // 2 AS c FROM clips WHERE clip_id = 'c1'), ks AS (SELECT kf.*, c FROM kf JOIN ct USING (project_id, clip_id))
, sq AS (SELECT DISTINCT project_id, clip_id, property, c AS at_ms, NULL::DOUBLE AS base FROM ks)""" + EVAL + """
, al AS (SELECT project_id, clip_id, property, time_ms::DOUBLE AS t, value AS v FROM ks WHERE time_ms <= c UNION ALL SELECT project_id, 'c1b', property, time_ms - c, value FROM ks WHERE time_ms >= c
 UNION ALL SELECT project_id, clip_id, property, at_ms, v FROM evd WHERE NOT EXISTS (SELECT 1 FROM ks k WHERE k.project_id = evd.project_id AND k.clip_id = evd.clip_id AND k.property = evd.property AND k.time_ms = k.c)
 UNION ALL SELECT project_id, 'c1b', property, 0, v FROM evd WHERE NOT EXISTS (SELECT 1 FROM ks k WHERE k.project_id = evd.project_id AND k.clip_id = evd.clip_id AND k.property = evd.property AND k.time_ms = k.c))
SELECT project_id, clip_id, property, t AS time_ms, round(v + 1e-9, 6) AS value FROM al"""), sized="lineitem")
def _(spark, sf):
    cuts = T.clips(spark, sf).where("clip_id = 'c1'").selectExpr("project_id", "clip_id", "'c1b' AS new_id", "duration_ms DIV 2 AS cut_ms")
    return M.split_keyframes(_keyframes(spark, sf), cuts).selectExpr("project_id", "clip_id", "property", "time_ms", "round(value + 1e-9, 6) AS value")


@query("edt_07_set_speed", with_tables("clips tracks", CK + ED + """, p AS (SELECT *, greatest(1000.0::DOUBLE / 120, duration_ms * speed / 1.6) AS nl FROM ed)
SELECT c.project_id, c.clip_id, round(CASE WHEN NOT p.locked AND c.clip_id <> 'c1' AND c.track_id = p.track_id AND c.start_ms >= oe THEN c.start_ms + nl - p.duration_ms ELSE c.start_ms END, 6)::DOUBLE AS start_ms,
 round(CASE WHEN NOT p.locked AND c.clip_id = 'c1' THEN nl ELSE c.duration_ms END, 6)::DOUBLE AS duration_ms, CASE WHEN NOT p.locked AND c.clip_id = 'c1' THEN 1.6 ELSE c.speed END::DOUBLE AS speed FROM ck c LEFT JOIN p ON p.project_id = c.project_id"""))
def _(spark, sf):
    out = M.set_speed(_clips(spark, sf), T.tracks(spark, sf), _edit(spark, sf, new_speed="1.6D"), ripple=True)
    return _r6(out.select("project_id", "clip_id", "start_ms", "duration_ms", "speed"), "start_ms", "duration_ms")


@query("edt_08_track_state", with_tables("tracks", "SELECT project_id, track_id, CASE WHEN track_idx = 1 THEN true ELSE muted END AS muted, solo, locked, CASE WHEN track_idx = 1 THEN 4.0 ELSE 1.0 END::DOUBLE AS gain, CASE WHEN track_idx = 1 THEN -1.0 ELSE 0.0 END::DOUBLE AS pan FROM tracks"))
def _(spark, sf):
    tracks = T.tracks(spark, sf).withColumns({"gain": F.lit(1.0), "pan": F.lit(0.0)})
    edits = tracks.where("track_idx = 1").selectExpr("project_id", "track_id", "true AS muted", "CAST(NULL AS BOOLEAN) AS solo", "CAST(NULL AS BOOLEAN) AS locked", "9.0D AS gain", "-3.0D AS pan")
    return M.set_track_state(tracks, edits).select("project_id", "track_id", "muted", "solo", "locked", "gain", "pan")


@query("edt_09_upsert_keyframe", with_tables("clips", KF + """, ed AS (SELECT project_id, clip_id, property, time_ms AS t, ordinal FROM kf WHERE ordinal IN (0, 5)), u AS (SELECT * FROM kf ANTI JOIN ed ON ed.project_id = kf.project_id AND ed.clip_id = kf.clip_id AND ed.property = kf.property AND ed.t = kf.time_ms)
SELECT project_id, clip_id, property, time_ms::DOUBLE AS time_ms, round(value, 6) AS value FROM u UNION ALL SELECT project_id, clip_id, property, t, 9.5 FROM ed WHERE ordinal = 0"""))
def _(spark, sf):
    frames = _keyframes(spark, sf).withColumn("time_ms", F.col("time_ms").cast("double"))
    edits = frames.where("ordinal IN (0, 5)").withColumns({"value": F.expr("IF(ordinal = 0, 9.5D, NULL)"), "ordinal": F.col("ordinal") + 100})
    return _r6(M.upsert_keyframes(frames, edits, T.clips(spark, sf)).select("project_id", "clip_id", "property", "time_ms", "value"), "value")


@query("edt_10_rider_envelope", with_tables("clips", KF + """, n AS (SELECT project_id, clip_id, least(duration_ms, k * 900)::DOUBLE AS t, k FROM clips, range(0, 6) r(k) WHERE clip_idx = 1), u AS (SELECT project_id, clip_id, t, max(k) AS k FROM n GROUP BY 1, 2, 3)
, g AS (SELECT project_id, clip_id FROM u GROUP BY 1, 2 HAVING count(*) >= 2)
SELECT project_id, clip_id, property, time_ms::DOUBLE AS time_ms, round(value, 6)::DOUBLE AS value FROM kf WHERE NOT (property = 'riderGain' AND (project_id, clip_id) IN (SELECT (project_id, clip_id) FROM g))
UNION ALL SELECT project_id, clip_id, 'riderGain', t, least(4, k * 1.5) FROM u WHERE (project_id, clip_id) IN (SELECT (project_id, clip_id) FROM g)"""))
def _(spark, sf):
    frames = _keyframes(spark, sf).withColumn("time_ms", F.col("time_ms").cast("double"))
    fresh = T.clips(spark, sf).where("clip_idx = 1").selectExpr("project_id", "clip_id", "explode(sequence(0L, 5L)) AS k").selectExpr(
        "project_id", "clip_id", "CAST(k * 900 AS DOUBLE) AS time_ms", "CAST(k * 1.5 AS DOUBLE) AS value", "CAST(NULL AS STRING) AS easing", "k AS ordinal")
    return _r6(M.replace_property(frames, fresh, "riderGain", T.clips(spark, sf)).select("project_id", "clip_id", "property", "time_ms", "value"), "value")


RANGES = """, rg AS (SELECT project_id, clip_id, track_id, start_ms AS os, duration_ms AS len, trim_in_ms, speed, least(duration_ms, k * 1300 + 4) AS s, least(duration_ms, k * 1300 + 600) AS e FROM clips JOIN tracks USING (project_id, track_id), range(0, 4) r(k) WHERE clip_id = 'c1' AND NOT locked)
, rm AS (SELECT * FROM rg WHERE e - s >= 1000.0 / 120), rn AS (SELECT *, lag(e) OVER w AS pe, lead(s) OVER w AS nx, row_number() OVER w AS o FROM rm WINDOW w AS (PARTITION BY project_id ORDER BY s))
, rs AS (SELECT *, CASE WHEN s - coalesce(pe, 0) < 1000.0 / 120 THEN coalesce(pe, 0) ELSE s END AS s2, CASE WHEN coalesce(nx, len) - e < 1000.0 / 120 THEN coalesce(nx, len) ELSE e END AS e2 FROM rn)
, rc AS (SELECT *, sum(e2 - s2) OVER (PARTITION BY project_id ORDER BY s) AS gone FROM rs)
, pc AS (SELECT project_id, 0 AS piece, 0 AS lo, s2 AS hi, 0 AS bf, os, trim_in_ms, speed, track_id FROM rc WHERE pe IS NULL AND s2 > 0 UNION ALL SELECT project_id, o, e2, coalesce(nx, len), gone, os, trim_in_ms, speed, track_id FROM rc WHERE coalesce(nx, len) > e2)
, tot AS (SELECT project_id, any_value(track_id) AS tk, any_value(os) AS os, any_value(os + len) AS oe, sum(e2 - s2) AS removed FROM rs GROUP BY 1)
SELECT project_id, CASE WHEN piece = 0 THEN 'c1' ELSE 'c1~' || piece END AS clip_id, (os + lo - bf)::BIGINT AS start_ms, (hi - lo)::BIGINT AS duration_ms, round(trim_in_ms + lo * speed, 6)::DOUBLE AS trim_in_ms FROM pc
UNION ALL SELECT c.project_id, clip_id, (CASE WHEN removed IS NOT NULL AND track_id = tk AND start_ms >= oe THEN greatest(os, start_ms - removed) ELSE start_ms END)::BIGINT, duration_ms, trim_in_ms FROM clips c LEFT JOIN tot USING (project_id) WHERE NOT (clip_id = 'c1' AND removed IS NOT NULL)"""


@query("edt_11_delete_ranges", with_tables("clips tracks", RANGES), sized="lineitem")
def _(spark, sf):
    ranges = T.clips(spark, sf).where("clip_id = 'c1'").selectExpr("project_id", "clip_id", "explode(sequence(0L, 3L)) AS k").selectExpr("project_id", "clip_id", "k * 1300 + 600 AS start_ms", "k * 1300 + 4 AS end_ms")
    out = M.delete_ranges(T.clips(spark, sf), T.tracks(spark, sf), ranges, ripple=True)
    return out.selectExpr("project_id", "clip_id", "CAST(start_ms AS BIGINT) AS start_ms", "CAST(duration_ms AS BIGINT) AS duration_ms", "round(trim_in_ms, 6) AS trim_in_ms")


MARKS = """, mk0 AS (SELECT DISTINCT project_id, (clip_idx * 977 + project_id * 31) % 60000 AS t FROM clips UNION SELECT DISTINCT project_id, (clip_idx * 977 + project_id * 31) % 60000 + 60 FROM clips)
, mk AS (SELECT * FROM (SELECT *, lag(t) OVER (PARTITION BY project_id ORDER BY t) AS p FROM mk0) WHERE p IS NULL OR t - p > 20)
, vs AS (SELECT c.*, start_ms + duration_ms AS en FROM ck c JOIN tracks t USING (project_id, track_id) WHERE kind = 'video' AND NOT locked)
, hm AS (SELECT v.project_id, clip_id, start_ms, t, row_number() OVER (PARTITION BY v.project_id, clip_id ORDER BY t) AS i FROM vs v JOIN mk ON mk.project_id = v.project_id AND t > start_ms + 100 AND t < en - 100)
, wk AS (SELECT project_id, clip_id, i, t AS last, true AS keep FROM hm WHERE i = 1 UNION ALL SELECT h.project_id, h.clip_id, h.i, CASE WHEN h.t - w.last > 100 THEN h.t ELSE w.last END, h.t - w.last > 100 FROM wk w JOIN hm h ON h.project_id = w.project_id AND h.clip_id = w.clip_id AND h.i = w.i + 1)
, ct AS (SELECT project_id, clip_id, last AS c FROM wk WHERE keep UNION ALL SELECT project_id, clip_id, start_ms FROM vs)
, pc AS (SELECT *, lead(c) OVER w AS nx, row_number() OVER w AS n FROM ct WINDOW w AS (PARTITION BY project_id, clip_id ORDER BY c))
SELECT p.project_id, CASE WHEN n = 1 THEN p.clip_id ELSE p.clip_id || '~' || (n - 1) END AS clip_id, c AS start_ms, coalesce(nx, en) - c AS duration_ms FROM pc p JOIN vs v ON v.project_id = p.project_id AND v.clip_id = p.clip_id
UNION ALL SELECT project_id, clip_id, start_ms, duration_ms FROM ck WHERE (project_id, clip_id) NOT IN (SELECT (project_id, clip_id) FROM vs)"""


@query("edt_12_split_visuals", with_tables("clips tracks", CK + MARKS, recursive=True), sized="lineitem")
def _(spark, sf):
    marks = T.clips(spark, sf).selectExpr("project_id", "explode(array((clip_idx * 977 + project_id * 31) % 60000, (clip_idx * 977 + project_id * 31) % 60000 + 60)) AS time_ms")
    return M.split_visuals(_clips(spark, sf), T.tracks(spark, sf), marks).select("project_id", "clip_id", "start_ms", "duration_ms")


CUTS = PROJ + """, o AS (SELECT *, row_number() OVER (PARTITION BY project_id, clip_id ORDER BY timeline_ms, source_ms) AS i FROM pb)
, dd AS (SELECT project_id, clip_id, i, timeline_ms AS t, confidence AS c, downbeat AS d, 1 AS g FROM o WHERE i = 1 UNION ALL
  SELECT o.project_id, o.clip_id, o.i, CASE WHEN near AND NOT better THEN t ELSE timeline_ms END, CASE WHEN near AND NOT better THEN c ELSE confidence END, CASE WHEN near AND NOT better THEN d ELSE downbeat END, CASE WHEN near THEN g ELSE g + 1 END
  FROM (SELECT dd.t, dd.c, dd.d, dd.g, o2.*, abs(dd.t - o2.timeline_ms) < 20 AS near, o2.confidence > dd.c OR o2.downbeat AS better FROM dd JOIN o o2 ON o2.project_id = dd.project_id AND o2.clip_id = dd.clip_id AND o2.i = dd.i + 1) o)
, un AS (SELECT project_id, clip_id, arg_max(t, i) AS t, arg_max(d, i) AS d FROM dd GROUP BY project_id, clip_id, g), nm AS (SELECT *, row_number() OVER (PARTITION BY project_id, clip_id ORDER BY t) AS n FROM un)
, ins AS (SELECT nm.*, start_ms AS rs, row_number() OVER (PARTITION BY nm.project_id, nm.clip_id ORDER BY t) AS k FROM nm JOIN clips c ON c.project_id = nm.project_id AND c.clip_id = nm.clip_id WHERE n % 2 = 1 AND t >= start_ms + 900 AND t <= start_ms + duration_ms - 900)
, sp AS (SELECT project_id, clip_id, k, CASE WHEN t - rs >= 900 THEN t ELSE rs END AS last, t - rs >= 900 AS keep FROM ins WHERE k = 1 UNION ALL SELECT x.project_id, x.clip_id, x.k, CASE WHEN x.t - s.last >= 900 THEN x.t ELSE s.last END, x.t - s.last >= 900 FROM sp s JOIN ins x ON x.project_id = s.project_id AND x.clip_id = s.clip_id AND x.k = s.k + 1)
SELECT project_id, clip_id, round(last, 6) AS timeline_ms FROM sp WHERE keep"""


def _shot_ranges(clips):
    return clips.selectExpr("project_id", "clip_id", "CAST(start_ms AS DOUBLE) AS range_start", "CAST(start_ms + duration_ms AS DOUBLE) AS range_end")


@query("edt_13_beat_cuts", with_tables("clips beats", CUTS, recursive=True), sized="lineitem events")
def _(spark, sf):
    clips, markers = _projected(spark, sf)
    return _r6(M.beat_cuts(markers, _shot_ranges(clips), ["project_id", "clip_id"], "every-2", 900.0), "timeline_ms")


CHAIN = CUTS.split(", un AS")[0] + """, un AS (SELECT project_id, clip_id, arg_max(t, i) AS t, arg_max(d, i) AS d, arg_max(c, i) AS c FROM dd GROUP BY project_id, clip_id, g)
, nd AS (SELECT u.project_id, u.clip_id, list_concat([any_value(rs)], list(t ORDER BY t), [any_value(re)]) AS ts, list_concat([0.0::DOUBLE], list(c + CASE WHEN d THEN 0.45 ELSE 0 END::DOUBLE ORDER BY t), [0.0::DOUBLE]) AS gs
  FROM (SELECT un.*, start_ms::DOUBLE AS rs, (start_ms + duration_ms)::DOUBLE AS re FROM un JOIN clips c ON c.project_id = un.project_id AND c.clip_id = un.clip_id) u WHERE t >= rs + 700 AND t <= re - 700 GROUP BY 1, 2)
, dp AS (SELECT project_id, clip_id, ts, gs, 1 AS k, [0.0::DOUBLE] AS best, [0::BIGINT] AS prev FROM nd UNION ALL
  SELECT project_id, clip_id, ts, gs, k + 1, list_append(best, list_max(offers)), list_append(prev, CASE WHEN list_max(offers) IS NULL THEN NULL ELSE list_position(offers, list_max(offers)) END::BIGINT)
  FROM (SELECT *, list_transform(range(1, k + 1), lambda j: CASE WHEN ts[k + 1] - ts[j] >= 700 AND ts[k + 1] - ts[j] <= CASE WHEN k + 1 = len(ts) THEN 3375.0 ELSE 2500.0 END
    THEN best[j] + gs[k + 1] - abs(ts[k + 1] - ts[j] - 1600) / 1600 * 0.28 END) AS offers FROM dp WHERE k < len(ts)))
, bk AS (SELECT project_id, clip_id, ts, prev, prev[k] AS j FROM dp WHERE k = len(ts) UNION ALL SELECT project_id, clip_id, ts, prev, prev[j] FROM bk WHERE j > 1)
SELECT project_id, clip_id, round(ts[j], 6) AS cut_ms FROM bk WHERE j > 1"""


@query("edt_14_smart_beat_cuts", with_tables("clips beats", CHAIN, recursive=True), sized="lineitem events")
def _(spark, sf):
    clips, markers = _projected(spark, sf)
    return _r6(M.smart_beat_cuts(markers, _shot_ranges(clips), ["project_id", "clip_id"], 700.0, 2500.0), "cut_ms")


FREE = """, bz AS (SELECT project_id, track_id, start_ms AS s, start_ms + duration_ms AS e FROM clips), cd AS (SELECT project_id, track_id, w, len, clip_id, t FROM (SELECT project_id, track_id, clip_id, start_ms + 500 AS w, 2500 AS len FROM clips) q JOIN (SELECT project_id, track_id, e AS t FROM bz) z USING (project_id, track_id) WHERE t >= w
  UNION ALL SELECT project_id, track_id, start_ms + 500, 2500, clip_id, start_ms + 500 FROM clips)
SELECT c.project_id, clip_id AS request_id, min(t) AS free_ms FROM cd c WHERE NOT EXISTS (SELECT 1 FROM bz WHERE bz.project_id = c.project_id AND bz.track_id = c.track_id AND t < bz.e AND t + len > bz.s) GROUP BY 1, 2"""


@query("edt_15_first_free_start", with_tables("clips", FREE), sized="lineitem")
def _(spark, sf):
    wanted = T.clips(spark, sf).selectExpr("project_id", "clip_id AS request_id", "track_id", "start_ms + 500 AS wanted_ms", "2500L AS length_ms")
    return M.first_free_start(wanted, T.clips(spark, sf)).select("project_id", "request_id", "free_ms")


@query("edt_16_separate_audio", with_tables("clips tracks", CK + """, tk AS (SELECT *, CASE WHEN track_idx = 1 AND project_id % 2 = 0 THEN 'voice 2' ELSE 'Track ' || track_idx END AS name FROM tracks)
, pl AS (SELECT c.project_id, c.clip_id, coalesce((SELECT arg_min(track_id, track_idx) FROM tk t WHERE t.project_id = c.project_id AND t.type = 'audio' AND NOT t.locked AND regexp_matches(lower(t.name), '^voice( [0-9]+)?$')), 'a-voice-c3') AS vt FROM ck c JOIN tracks t USING (project_id, track_id) WHERE clip_id = 'c3' AND kind = 'video' AND NOT t.locked)
SELECT c.project_id, c.clip_id, c.track_id, c.kind, CASE WHEN vt IS NULL THEN round(volume, 6) ELSE 0 END AS volume, vt IS NOT NULL AS audio_separated FROM ck c LEFT JOIN pl ON pl.project_id = c.project_id AND pl.clip_id = c.clip_id
UNION ALL SELECT c.project_id, 'c3-voice', vt, 'audio', round(volume, 6), false FROM ck c JOIN pl ON pl.project_id = c.project_id AND pl.clip_id = c.clip_id
UNION ALL SELECT project_id, 'Voice', vt, 'track', 0, false FROM pl WHERE vt = 'a-voice-c3'"""))
def _(spark, sf):
    tracks = T.tracks(spark, sf).withColumn("name", F.expr("IF(track_idx = 1 AND project_id % 2 = 0, 'voice 2', concat('Track ', track_idx))"))
    clips = _clips(spark, sf)
    edits = clips.where("clip_id = 'c3'").select("project_id", "clip_id")
    out, fresh = M.separate_audio(clips, tracks, edits)
    added = fresh.selectExpr("project_id", "name AS clip_id", "track_id", "'track' AS kind", "0.0D AS volume", "false AS audio_separated")
    return _r6(out.select("project_id", "clip_id", "track_id", "kind", "volume", "audio_separated").unionByName(added), "volume")


@query("edt_17_replace_generated", with_tables("clips tracks", CK + """, gc AS (SELECT project_id, clip_id, track_id, kind, CASE WHEN kind = 'text' AND clip_idx > 3 THEN 'gen://' || clip_id ELSE 'm' || clip_id END AS file FROM ck)
, nw AS (SELECT DISTINCT project_id, 'n1' AS clip_id, 't2' AS track_id, 'text' AS kind, 'gen://n1' AS file FROM clips), bl AS (SELECT project_id FROM tracks WHERE track_id = 't2' AND locked)
SELECT * FROM gc WHERE NOT starts_with(file, 'gen://') OR project_id IN (SELECT project_id FROM bl) UNION ALL SELECT * FROM nw WHERE project_id NOT IN (SELECT project_id FROM bl)"""))
def _(spark, sf):
    clips = _clips(spark, sf).selectExpr("project_id", "clip_id", "track_id", "kind", "IF(kind = 'text' AND clip_idx > 3, concat('gen://', clip_id), concat('m', clip_id)) AS file")
    fresh = clips.select("project_id").distinct().selectExpr("project_id", "'n1' AS clip_id", "'t2' AS track_id", "'text' AS kind", "'gen://n1' AS file")
    return M.replace_generated(clips, T.tracks(spark, sf), fresh, "gen://")


@query("edt_20_paste_clip", with_tables("clips tracks", CK + """, sr AS (SELECT project_id, clip_id, track_id AS own, kind, duration_ms AS len, 15000 AS w FROM ck WHERE clip_id = 'c1'), bt AS (SELECT s.project_id, s.clip_id, any_value(s.len) AS len, any_value(s.w) AS w, arg_min(t.track_id, (CASE WHEN t.track_id = 't0' THEN 0 WHEN t.track_id = own THEN 1 ELSE 2 END, t.track_idx)) AS tk FROM sr s JOIN tracks t ON t.project_id = s.project_id AND NOT t.locked AND t.type = s.kind GROUP BY 1, 2)
, bz AS (SELECT project_id, track_id, start_ms AS s, start_ms + duration_ms AS e FROM clips), cd AS (SELECT b.*, t FROM bt b JOIN (SELECT project_id, track_id, e AS t FROM bz) z ON z.project_id = b.project_id AND z.track_id = b.tk AND t >= w UNION ALL SELECT *, w FROM bt)
SELECT project_id, clip_id AS request_id, tk AS track_id, min(t) AS free_ms FROM cd c WHERE NOT EXISTS (SELECT 1 FROM bz WHERE bz.project_id = c.project_id AND bz.track_id = c.tk AND t < bz.e AND t + len > bz.s) GROUP BY 1, 2, 3"""), sized="lineitem")
def _(spark, sf):
    edits = _edit(spark, sf, wanted_ms="15000L", preferred_track="'t0'")
    return M.paste_clips(_clips(spark, sf), T.tracks(spark, sf), edits).select("project_id", "request_id", "track_id", "free_ms")


@query("edt_22_change_transition", with_tables("clips", CK + TR + """, j AS (SELECT *, CASE WHEN project_id % 3 = 0 THEN 'crossfade' WHEN project_id % 3 = 1 THEN 'nonsense' END AS nt, greatest(0, duration_ms - out_ms) AS room FROM tc WHERE clip_idx = 1)
, k AS (SELECT *, CASE WHEN nt IS NOT NULL THEN CASE WHEN nt = 'crossfade' AND room > 0 THEN nt ELSE 'none' END ELSE CASE WHEN least(room, 450) = 0 OR in_type = 'none' THEN 'none' ELSE in_type END END AS t FROM j)
SELECT project_id, clip_id, 'in' AS side, t AS type, CASE WHEN t = 'none' THEN 0 WHEN nt IS NOT NULL THEN least(room, CASE WHEN in_ms > 0 THEN in_ms ELSE 600 END) ELSE least(room, 450) END::BIGINT AS ms FROM k"""))
def _(spark, sf):
    edits = _clips(spark, sf).where("clip_idx = 1").selectExpr(
        "project_id", "clip_id", "'in' AS side", "CASE project_id % 3 WHEN 0 THEN 'crossfade' WHEN 1 THEN 'nonsense' END AS new_type", "450L AS new_ms")
    defaults = spark.createDataFrame([("crossfade", 600), ("none", 0)], "type string, default_ms long")
    return M.change_transition(_with_transitions(spark, sf), edits, defaults)


@query("edt_21_reset_clip", with_tables("clips tracks", CK + ED + "SELECT c.project_id, c.clip_id, CASE WHEN e.locked = false AND c.clip_id = 'c1' THEN 1.0 ELSE round(c.volume, 6) END::DOUBLE AS volume, CASE WHEN e.locked = false AND c.clip_id = 'c1' THEN 0.0 ELSE 0.3 END::DOUBLE AS pan FROM ck c LEFT JOIN ed e ON e.project_id = c.project_id"))
def _(spark, sf):
    clips = _clips(spark, sf).withColumn("pan", F.lit(0.3))
    plan = M._targets(clips, T.tracks(spark, sf), _edit(spark, sf)).where("error IS NULL").selectExpr("project_id", "clip_id", "true AS __reset")
    return clips.join(plan, ["project_id", "clip_id"], "left").selectExpr("project_id", "clip_id", "IF(__reset, 1.0D, round(volume, 6)) AS volume", "IF(__reset, 0.0D, pan) AS pan")
