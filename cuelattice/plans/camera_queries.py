"""Registered queries over tracker samples, faces and camera paths."""

from __future__ import annotations

from pyspark.sql import functions as F

from cuelattice.operators import camera as A
from cuelattice.operators import series as S
from cuelattice.plans import tables as T
from cuelattice.plans.registry import query
from cuelattice.plans.series_queries import ENVELOPE, _speech
from cuelattice.plans.tables import with_tables


@query("prj_08_tracker_validation", with_tables("track_samples", """, s AS (SELECT asset_id, time_ms, x + CASE WHEN time_ms % 700 = 0 THEN 0.35 ELSE 0 END AS x, y, confidence + CASE WHEN time_ms % 500 = 0 THEN 0.4 ELSE 0 END AS c FROM track_samples)
SELECT asset_id, time_ms, (CASE WHEN x > 1 THEN 1 ELSE 0 END + CASE WHEN c > 1 THEN 1 ELSE 0 END + CASE WHEN x + 0.1 > 1 + 1e-6 THEN 1 ELSE 0 END)::BIGINT AS n_issues FROM s"""))
def _(spark, sf):
    raw = T.track_samples(spark, sf).withColumns({"x": F.expr("x + IF(time_ms % 700 = 0, 0.35D, 0.0D)"), "confidence": F.expr("confidence + IF(time_ms % 500 = 0, 0.4D, 0.0D)")})
    return A.sample_issues(raw).select("asset_id", "time_ms", F.size("issues").cast("long").alias("n_issues"))


@query("prj_09_face_track", with_tables("track_samples", """, s AS (SELECT asset_id, time_ms // 100 AS i, CASE WHEN asset_id % 4 = 1 AND time_ms = 500 THEN 300 ELSE time_ms END AS t, x FROM track_samples), p AS (SELECT *, lag(t) OVER (PARTITION BY asset_id ORDER BY i) AS q FROM s)
SELECT asset_id, bool_and((q IS NULL OR t > q) AND x + 0.1 <= 1 + 1e-6) AS valid FROM p GROUP BY 1"""), sized="events")
def _(spark, sf):
    raw = T.track_samples(spark, sf).withColumns({"sample_idx": F.expr("time_ms DIV 100"), "time_ms": F.expr("IF(asset_id % 4 = 1 AND time_ms = 500, 300, time_ms)")})
    return A.face_track_checks(raw)


HELD = """, b AS (SELECT *, max(CASE WHEN confidence >= 0.55 THEN time_ms END) OVER (PARTITION BY asset_id ORDER BY time_ms) AS bt, min(CASE WHEN confidence >= 0.55 THEN time_ms END) OVER (PARTITION BY asset_id ORDER BY time_ms ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS at FROM track_samples)
, u AS (SELECT *, CASE WHEN bt IS NULL THEN at WHEN at IS NULL THEN bt WHEN time_ms - bt <= at - time_ms THEN bt ELSE at END AS ut FROM (SELECT * EXCLUDE (at), "at" FROM b))
, hd AS (SELECT u.asset_id, u.time_ms, s.x, s.y, s.width, s.height, u.confidence, CASE WHEN u.confidence >= 0.55 THEN 'tracked' ELSE 'held' END AS state, ut FROM u JOIN track_samples s ON s.asset_id = u.asset_id AND s.time_ms = ut)""".replace(" AS at FROM", ' AS "at" FROM').replace("THEN at WHEN at IS", 'THEN "at" WHEN "at" IS').replace("<= at - time_ms", '<= "at" - time_ms').replace("ELSE at END", 'ELSE "at" END').replace("EXCLUDE (at)", 'EXCLUDE ("at")')


@query("win_18_hold_samples", with_tables("track_samples", HELD + """, v AS (SELECT asset_id, bool_or(abs(time_ms - ut) > 900) AS gap FROM hd GROUP BY 1)
SELECT asset_id, time_ms, round(x, 6) AS x, round(y, 6) AS y, state, gap FROM hd JOIN v USING (asset_id)"""), sized="events")
def _(spark, sf):
    held, verdict = A.hold_samples(T.track_samples(spark, sf))
    return held.join(verdict, "asset_id").selectExpr("asset_id", "time_ms", "round(x, 6) AS x", "round(y, 6) AS y", "state", "error IS NOT NULL AS gap")


SMOOTH = HELD + """, nb AS (SELECT c.asset_id, c.time_ms, n.time_ms AS nt, n.x, n.y, n.state, n.confidence, c.x AS cx, c.y AS cy FROM hd c JOIN hd n ON n.asset_id = c.asset_id AND abs(n.time_ms - c.time_ms) <= 280)
, md AS (SELECT *, median(x) OVER w AS mx, median(y) OVER w AS my FROM nb WINDOW w AS (PARTITION BY asset_id, time_ms)), tl AS (SELECT *, greatest(0.006, 4.4478 * median(abs(x - mx)) OVER w) AS tx, greatest(0.006, 4.4478 * median(abs(y - my)) OVER w) AS ty FROM md WINDOW w AS (PARTITION BY asset_id, time_ms))
, wt AS (SELECT *, exp(-abs(nt - time_ms) / 280.0) * CASE WHEN state = 'tracked' THEN greatest(0.2, confidence) ELSE 0.15 END AS w FROM tl)
SELECT asset_id, time_ms, round(least(0.9, greatest(0.1, sum(x * w) FILTER (abs(x - mx) <= tx) / sum(w) FILTER (abs(x - mx) <= tx))), 6) AS x, round(least(0.85, greatest(0.15, sum(y * w) FILTER (abs(y - my) <= ty) / sum(w) FILTER (abs(y - my) <= ty))), 6) AS y FROM wt GROUP BY 1, 2"""


@query("win_19_robust_smoothing", with_tables("track_samples", SMOOTH), sized="events")
def _(spark, sf):
    held, _ = A.hold_samples(T.track_samples(spark, sf))
    return A.smooth_samples(held).selectExpr("asset_id", "time_ms", "round(x, 6) AS x", "round(y, 6) AS y")


def _path(spark, sf):
    held, _ = A.hold_samples(T.track_samples(spark, sf), hold_all=True)
    return A.camera_path(A.smooth_samples(held), 1920, 1080)


@query("win_20_camera_path", sized="events")
def _(spark, sf):
    return _path(spark, sf)


@query("win_21_reframe_plan", sized="events")
def _(spark, sf):
    """Every series is made reliable enough to be planned."""
    samples = T.track_samples(spark, sf).withColumns({"confidence": F.expr("0.5D + confidence / 2"), "sample_idx": F.col("time_ms")})
    return A.reframe_plan(samples, 1920, 1080)[1]


@query("win_22_evaluate_camera", with_tables("track_samples", """, f AS (SELECT asset_id, time_ms * 3 AS time_ms, x, y, 1 + confidence AS scale, CASE WHEN confidence < 0.2 THEN 'held' ELSE 'tracked' END AS state FROM track_samples), q AS (SELECT asset_id, time_ms * 2 + 50 AS t FROM track_samples)
, j AS (SELECT q.asset_id, t, max(time_ms) FILTER (time_ms <= t) AS lt, min(time_ms) FILTER (time_ms > t) AS rt FROM q JOIN f USING (asset_id) GROUP BY 1, 2)
SELECT j.asset_id, t AS at_ms, round(CASE WHEN l.x IS NULL THEN r.x WHEN r.x IS NULL OR lt = t THEN l.x ELSE l.x + (r.x - l.x) * (t - lt) / (rt - lt) END + 1e-9, 6) AS x, CASE WHEN l.x IS NULL THEN r.state WHEN r.x IS NULL OR lt = t THEN l.state WHEN l.state = 'held' OR r.state = 'held' THEN 'held' ELSE 'tracked' END AS state
FROM j LEFT JOIN f l ON l.asset_id = j.asset_id AND l.time_ms = lt LEFT JOIN f r ON r.asset_id = j.asset_id AND r.time_ms = rt"""), sized="events")
def _(spark, sf):
    frames = T.track_samples(spark, sf).selectExpr("asset_id", "'1:1' AS aspect", "time_ms * 3 AS time_ms", "x", "y", "1 + confidence AS scale", "IF(confidence < 0.2, 'held', 'tracked') AS state")
    asked = T.track_samples(spark, sf).selectExpr("asset_id", "'1:1' AS aspect", "time_ms * 2 + 50 AS at_ms")
    return A.evaluate_camera(asked, frames).selectExpr("asset_id", "at_ms", "round(x + 1e-9, 6) AS x", "state")


SPLIT = ENVELOPE + """, ep AS (SELECT *, row_number() OVER (PARTITION BY asset_id ORDER BY at_ms) AS i FROM env)
, st AS (SELECT asset_id, min(i) AS lo, max(i) AS hi FROM ep GROUP BY 1 UNION ALL
  SELECT asset_id, unnest([lo, w]), unnest([w, hi]) FROM (
    SELECT s.asset_id, lo, hi, arg_max(p.i, (abs(p.gain_db - (l.gain_db + (r.gain_db - l.gain_db) * (p.at_ms - l.at_ms) / (r.at_ms - l.at_ms))), -p.i))
      FILTER (abs(p.gain_db - (l.gain_db + (r.gain_db - l.gain_db) * (p.at_ms - l.at_ms) / (r.at_ms - l.at_ms))) > 0.35) AS w
    FROM st s JOIN ep l ON l.asset_id = s.asset_id AND l.i = lo JOIN ep r ON r.asset_id = s.asset_id AND r.i = hi JOIN ep p ON p.asset_id = s.asset_id AND p.i > lo AND p.i < hi
    GROUP BY s.asset_id, lo, hi) WHERE w IS NOT NULL)
SELECT asset_id, at_ms, round(gain_db, 6) AS gain_db FROM ep WHERE (asset_id, i) IN (SELECT (asset_id, lo) FROM st UNION ALL SELECT (asset_id, hi) FROM st)"""


@query("win_13_simplify_envelope", with_tables("frames", SPLIT, recursive=True), sized="events")
def _(spark, sf):
    return A.simplify_gain(S.gain_envelope(*_speech(spark, sf))).withColumn("gain_db", F.round("gain_db", 6))


@query("win_23_face_clusters", sized="events")
def _(spark, sf):
    faces = T.track_samples(spark, sf).selectExpr(
        "asset_id", "time_ms", "IF(confidence < 0.2, CAST(array() AS array<array<double>>), array(array(x * 0.2D + IF(time_ms > 3000, 0.5D, 0.1D), y * 0.2D + 0.2D, 0.12D, 0.12D))) AS faces")
    return A.cluster_faces(faces)


@query("edt_18_apply_camera", with_tables("track_samples", "SELECT asset_id, property, time_ms, round(v, 6) AS value FROM (SELECT asset_id, 'volume' AS property, time_ms, confidence AS v FROM track_samples UNION ALL SELECT asset_id, unnest(['x', 'y', 'scale']), time_ms, unnest([x, y, width]) FROM track_samples)"))
def _(spark, sf):
    samples = T.track_samples(spark, sf)
    old = samples.selectExpr("asset_id", "explode(map('x', 0.0D, 'y', 0.0D, 'volume', confidence)) AS (property, value)", "time_ms")
    camera = samples.selectExpr("asset_id", "explode(map('x', x, 'y', y, 'scale', width)) AS (property, value)", "time_ms")
    kept = old.join(camera.select("asset_id", "property").distinct(), ["asset_id", "property"], "left_anti")
    return kept.select("asset_id", "property", "time_ms", "value").unionByName(camera.select("asset_id", "property", "time_ms", "value")).withColumn("value", F.round("value", 6))


@query("prj_25_camera_plan_check", with_tables("track_samples", """, s AS (SELECT *, time_ms // 100 AS i FROM track_samples)
SELECT asset_id, 'bad-scale' AS issue, count(*)::BIGINT AS n FROM s WHERE confidence * 25 > 20 OR confidence <= 0 GROUP BY 1 UNION ALL SELECT asset_id, 'timeline-differs', count(*) * 3 FROM s WHERE i % 10 = 3 GROUP BY 1 UNION ALL SELECT asset_id, 'not-increasing', 1 FROM s WHERE i = 7 AND asset_id % 2 = 0"""), sized="events")
def _(spark, sf):
    s = T.track_samples(spark, sf).selectExpr("asset_id", "'1:1' AS aspect", "time_ms DIV 100 AS frame_idx", "CAST(IF(asset_id % 2 = 0 AND time_ms = 700, 600, time_ms) AS DOUBLE) AS time_ms", "x", "y", "confidence * 25 AS scale")
    timeline = s.selectExpr("asset_id", "aspect", "frame_idx", "time_ms + IF(frame_idx % 10 = 3, 5, 0) AS time_ms", "explode(map('x', x, 'y', y, 'scale', scale)) AS (property, value)")
    expected = s.groupBy("asset_id", "aspect").agg(F.count("*").alias("n_frames"))
    return A.plan_issues(s, timeline, expected).select("asset_id", "issue", "n")


@query("math_08_box_maths", with_tables("track_samples", """SELECT asset_id, time_ms, round(x, 6) AS x, round(greatest(1e-6, least(0.2 * 1.35, x * 2, (1 - x) * 2)), 6) AS width, round(greatest(1e-6, least(0.3 * 1.35, y * 2, (1 - y) * 2)), 6) AS height FROM track_samples"""))
def _(spark, sf):
    raw = T.track_samples(spark, sf).selectExpr("asset_id", "time_ms * 2 AS time_ms", "x - width / 2 AS left", "y - height / 2 AS top", "width", "height", "confidence")
    return A.planner_samples(raw, "full", 2.0).selectExpr("asset_id", "CAST(time_ms AS BIGINT) AS time_ms", "round(x, 6) AS x", "round(width, 6) AS width", "round(height, 6) AS height")


@query("math_09_style_presets", with_tables("track_samples", "SELECT asset_id, time_ms, CASE asset_id % 3 WHEN 0 THEN 520 WHEN 1 THEN 140 ELSE 280 END::BIGINT AS window_ms FROM track_samples"))
def _(spark, sf):
    names = ("calm", "dynamic", "natural")
    cases = " ".join(f"WHEN {i} THEN {A.style_options(n)['window_ms']}" for i, n in enumerate(names))
    return T.track_samples(spark, sf).selectExpr("asset_id", "time_ms", f"CAST(CASE asset_id % 3 {cases} END AS BIGINT) AS window_ms")
