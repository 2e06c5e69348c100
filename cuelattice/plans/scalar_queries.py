"""Registered queries for scalar functions, over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from cuelattice.functions import motion as V
from cuelattice.functions import scalars as X
from cuelattice.operators import timeline as M
from cuelattice.plans import tables as T
from cuelattice.plans.registry import query
from cuelattice.plans.tables import with_tables


def _lines(spark, sf):
    return spark.read.parquet(f"{sf}/lineitem.parquet").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_discount")


KEYS = "l_orderkey, l_linenumber, l_partkey"


@query("math_01_clamp_finite", f"SELECT {KEYS}, CASE WHEN l_linenumber = 3 THEN 1.5 ELSE least(40, greatest(5, l_quantity)) END::DOUBLE AS v FROM lineitem")
def _(spark, sf):
    raw = F.when(F.col("l_linenumber") == 3, F.lit(float("nan"))).otherwise(F.col("l_quantity"))
    value = F.when(X.is_finite(raw), X.clamp(raw, 5.0, 40.0)).otherwise(X.finite_or(raw, 1.5))
    return _lines(spark, sf).select("l_orderkey", "l_linenumber", "l_partkey", value.alias("v"))


@query("math_02_gain_decibels", f"SELECT {KEYS}, round(CASE WHEN l_discount = 0 THEN -999 ELSE 20 * log10(least(4, l_discount * 60)) END, 6) AS db, round(CASE WHEN l_linenumber = 2 THEN 0 ELSE least(4, pow(10, (l_quantity - 25) / 20)) END, 6) AS gain FROM lineitem")
def _(spark, sf):
    db = X.gain_to_db(F.col("l_discount") * 60)
    gain = X.db_to_gain(F.when(F.col("l_linenumber") == 2, F.lit(float("-inf"))).otherwise(F.col("l_quantity") - 25))
    return _lines(spark, sf).select("l_orderkey", "l_linenumber", "l_partkey", F.round(F.when(X.is_finite(db), db).otherwise(-999.0), 6).alias("db"), F.round(gain, 6).alias("gain"))


_X = "(l_quantity / 50.0)"
EASE = f"CASE l_linenumber % 5 WHEN 0 THEN 0 WHEN 1 THEN {_X} * {_X} WHEN 2 THEN 1 - (1 - {_X}) * (1 - {_X}) WHEN 3 THEN CASE WHEN {_X} < 0.5 THEN 2 * {_X} * {_X} ELSE 1 - pow(2 - 2 * {_X}, 2) / 2 END ELSE {_X} END"
BOUNCE = f"CASE WHEN {_X} < 1 / 2.75 THEN 7.5625 * {_X} * {_X} WHEN {_X} < 2 / 2.75 THEN 7.5625 * pow({_X} - 1.5 / 2.75, 2) + 0.75 WHEN {_X} < 2.5 / 2.75 THEN 7.5625 * pow({_X} - 2.25 / 2.75, 2) + 0.9375 ELSE 7.5625 * pow({_X} - 2.625 / 2.75, 2) + 0.984375 END"


@query("math_03_easing", f"SELECT {KEYS}, round({EASE}, 6)::DOUBLE AS eased, round(1 - pow(1 - {_X}, 3), 6) AS cubic, round(1 + 2.70158 * pow({_X} - 1, 3) + 1.70158 * pow({_X} - 1, 2), 6) AS back, round({BOUNCE}, 6) AS bounce FROM lineitem")
def _(spark, sf):
    x = F.col("l_quantity") / 50.0
    kind = F.expr("element_at(array('hold','ease-in','ease-out','ease-in-out','linear'), l_linenumber % 5 + 1)")
    return _lines(spark, sf).select(
        "l_orderkey", "l_linenumber", "l_partkey", F.round(X.ease(x, kind), 6).alias("eased"), F.round(X.ease_out_cubic(x), 6).alias("cubic"),
        F.round(X.ease_out_back(x), 6).alias("back"), F.round(X.ease_out_bounce(x), 6).alias("bounce"))


@query("math_04_time_mapping", with_tables("clips", "SELECT project_id, clip_id, round(trim_in_ms + 700 * speed, 6) AS source_ms, greatest(1, round(duration_ms / speed)::BIGINT) AS played_ms, (duration_ms * 1000 + 11025) // 22050 AS sample_ms FROM clips"))
def _(spark, sf):
    return T.clips(spark, sf).select(
        "project_id", "clip_id", F.round(X.source_time(F.col("trim_in_ms"), F.lit(700), F.col("speed")), 6).alias("source_ms"),
        X.post_speed_ms(F.col("duration_ms"), F.col("speed")).alias("played_ms"), X.samples_to_ms(F.col("duration_ms")).alias("sample_ms"))


@query("math_05_sigmoid", f"SELECT {KEYS}, round(1 / (1 + exp(-least(60, greatest(-60, (l_quantity - 25) * 4)))), 9) AS p FROM lineitem")
def _(spark, sf):
    return _lines(spark, sf).select("l_orderkey", "l_linenumber", "l_partkey", F.round(X.sigmoid((F.col("l_quantity") - 25) * 4), 9).alias("p"))


STATE = """, s AS (SELECT *, least(duration_ms, (project_id * 37 % 100) * duration_ms / 99.0) AS l, ['none','crossfade','spin'][clip_idx % 3 + 1] AS it, 800 AS im, ['blur','none'][clip_idx % 2 + 1] AS ot, 900 AS om FROM clips)"""


def _states(spark, sf, kinds_in, kinds_out):
    pick = lambda kinds, by: f"element_at(array({', '.join(repr(k) for k in kinds)}), CAST({by} AS INT) + 1)"
    return T.clips(spark, sf).selectExpr(
        "project_id", "clip_id", "duration_ms", "least(duration_ms, (project_id * 37 % 100) * duration_ms / 99.0D) AS l", pick(kinds_in, f"clip_idx % {len(kinds_in)}") + " AS it",
        "800 AS im", pick(kinds_out, f"clip_idx % {len(kinds_out)}") + " AS ot", "900 AS om")


@query("math_06_transition_state", with_tables("clips", STATE + """SELECT project_id, clip_id, CASE WHEN it <> 'none' AND l < im THEN 'in' WHEN ot <> 'none' AND duration_ms - l <= om THEN 'out' ELSE 'none' END AS phase,
 round(CASE WHEN it <> 'none' AND l < im THEN l / im WHEN ot <> 'none' AND duration_ms - l <= om THEN greatest(0, 1 - (duration_ms - l) / om) ELSE 1 END, 6)::DOUBLE AS progress FROM s"""))
def _(spark, sf):
    rows = _states(spark, sf, ("none", "crossfade", "spin"), ("blur", "none"))
    state = V.transition_state(*[F.col(c) for c in ("l", "duration_ms", "it", "im", "ot", "om")])
    return rows.withColumn("s", state).selectExpr("project_id", "clip_id", "s.phase", "round(s.progress, 6) AS progress")


@query("math_07_text_effect", with_tables("clips", STATE.replace("['none','crossfade','spin'][clip_idx % 3 + 1]", "['fade','slide-up','spin'][clip_idx % 3 + 1]").replace("['blur','none'][clip_idx % 2 + 1]", "['fade','none'][clip_idx % 2 + 1]") + """
, p AS (SELECT *, CASE WHEN l < im THEN 1 - pow(1 - l / im, 3) END AS ei, CASE WHEN ot <> 'none' AND duration_ms - l <= om THEN 1 - pow(greatest(0, 1 - (duration_ms - l) / om), 3) END AS eo FROM s)
SELECT project_id, clip_id, round(coalesce(ei, 1) * coalesce(eo, 1), 6)::DOUBLE AS alpha, round(CASE WHEN it = 'slide-up' AND ei IS NOT NULL THEN 0.12 * (1 - ei) ELSE 0 END, 6)::DOUBLE AS dy, round(CASE WHEN it = 'spin' AND ei IS NOT NULL THEN -180 * (1 - ei) ELSE 0 END, 6)::DOUBLE AS rotation
FROM p WHERE ei IS NOT NULL OR eo IS NOT NULL"""))
def _(spark, sf):
    rows = _states(spark, sf, ("fade", "slide-up", "spin"), ("fade", "none"))
    effect = V.text_effect(*[F.col(c) for c in ("l", "duration_ms", "it", "im", "ot", "om")])
    return rows.withColumn("e", effect).where("e IS NOT NULL").selectExpr("project_id", "clip_id", "round(e.alpha, 6) AS alpha", "round(e.dy, 6) + 0.0D AS dy", "round(e.rotation, 6) + 0.0D AS rotation")


@query("math_10_frame_times", with_tables("clips", """, c AS (SELECT project_id, clip_id, duration_ms::DOUBLE AS d, greatest(0, duration_ms - least(50, greatest(1, duration_ms * 0.005)))::DOUBLE AS last FROM clips), s AS (SELECT *, least(last, 300) AS st FROM c), e AS (SELECT *, least(last, st + 5000) AS en FROM s)
SELECT project_id, clip_id, k::BIGINT AS idx, round(st + (en - st) * k / 6.0, 4) AS t FROM e, range(0, 7) r(k) WHERE k = 0 OR en > st"""))
def _(spark, sf):
    rows = T.clips(spark, sf).select("project_id", "clip_id", F.posexplode(V.frame_times("duration_ms", "300.0D", "5000.0D", "7.9D")).alias("idx", "t"))
    return rows.selectExpr("project_id", "clip_id", "CAST(idx AS BIGINT) AS idx", "round(t, 4) AS t")


@query("arr_01_waveform_slice", with_tables("words clips", """, w AS (SELECT asset_id, list(confidence ORDER BY word_idx) AS v FROM words GROUP BY 1), j AS (SELECT project_id, clip_id, v, trim_in_ms, trim_in_ms + duration_ms * speed AS re, greatest(trim_in_ms + duration_ms * speed, source_duration_ms) AS sd FROM clips JOIN w ON asset_id = project_id WHERE len(v) >= 3)
, b AS (SELECT *, least(len(v) - 1, floor(trim_in_ms / sd * len(v)))::BIGINT AS lo FROM j), x AS (SELECT *, greatest(lo + 1, least(len(v), ceil(re / sd * len(v))))::BIGINT AS hi FROM b)
SELECT project_id, clip_id, hi - lo AS n, round(list_sum(v[lo + 1:hi]), 6) AS total FROM x"""))
def _(spark, sf):
    wave = T.words(spark, sf).groupBy("asset_id").agg(F.expr("transform(array_sort(collect_list(struct(word_idx, confidence))), w -> w.confidence) AS v"))
    joined = T.clips(spark, sf).withColumn("asset_id", F.col("project_id")).join(wave, "asset_id").where("size(v) >= 3").selectExpr(
        "project_id", "clip_id", "v", "trim_in_ms", "trim_in_ms + duration_ms * speed AS re", "greatest(trim_in_ms + duration_ms * speed, source_duration_ms) AS sd")
    cut = joined.withColumn("lo", F.expr("CAST(least(size(v) - 1, floor(trim_in_ms / sd * size(v))) AS INT)")).withColumn("hi", F.expr("CAST(greatest(lo + 1, least(size(v), ceil(re / sd * size(v)))) AS INT)"))
    return cut.selectExpr("project_id", "clip_id", "CAST(hi - lo AS BIGINT) AS n", "round(aggregate(slice(v, lo + 1, hi - lo), 0.0D, (a, x) -> a + x), 6) AS total")


@query("arr_02_partition_interval", with_tables("clips", """SELECT project_id, clip_id, k::BIGINT AS part, floor(start_ms + duration_ms * k / (clip_idx + 2)::DOUBLE + 0.5)::BIGINT AS start_ms, floor(start_ms + duration_ms * (k + 1) / (clip_idx + 2)::DOUBLE + 0.5)::BIGINT AS end_ms FROM clips, range(0, 12) r(k) WHERE k < clip_idx + 2"""))
def _(spark, sf):
    parts = X.partition_interval(F.col("start_ms"), F.col("start_ms") + F.col("duration_ms"), F.col("clip_idx") + 2)
    return T.clips(spark, sf).select("project_id", "clip_id", F.posexplode(parts).alias("part", "p")).selectExpr("project_id", "clip_id", "CAST(part AS BIGINT) AS part", "p.start_ms", "p.end_ms")


PLACE = """, bz AS (SELECT project_id, start_ms AS s, start_ms + duration_ms AS e FROM clips WHERE track_id = 't0'), m AS (SELECT DISTINCT c.project_id, 15000 AS w, 5000 AS len FROM clips c JOIN tracks t ON t.project_id = c.project_id AND t.track_id = 't0' AND NOT t.locked)
, ov AS (SELECT m.*, min(s) AS os, arg_min(e, (s, e)) AS oe FROM m JOIN bz ON bz.project_id = m.project_id AND w + len > s AND w < e GROUP BY ALL)
, cd AS (SELECT project_id, w, len, 0 AS st, w AS pos, 0 AS pr FROM m UNION ALL SELECT project_id, w, len, 1, greatest(0, os - len - 0), CASE WHEN abs(w - (os - len)) <= abs(w - oe) THEN 0 ELSE 1 END FROM ov UNION ALL SELECT project_id, w, len, 1, oe, CASE WHEN abs(w - (os - len)) <= abs(w - oe) THEN 1 ELSE 0 END FROM ov)
, mg AS (SELECT project_id, s, e, max(e) OVER (PARTITION BY project_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pe FROM bz)
, gp AS (SELECT project_id, coalesce(pe, 0) AS lo, s AS hi FROM mg WHERE s > coalesce(pe, 0) UNION ALL SELECT project_id, max(e), NULL FROM bz GROUP BY 1)
, gc AS (SELECT m.project_id, w, len, 2 AS st, greatest(lo, least(w, coalesce(hi - len, 1e15)))::BIGINT AS pos, CASE WHEN hi IS NULL THEN 1e15 ELSE abs(w - (lo + hi) / 2.0) END AS pr FROM m JOIN gp USING (project_id) WHERE coalesce(hi - lo, 1e15) >= len)
, al AS (SELECT * FROM cd WHERE NOT EXISTS (SELECT 1 FROM bz WHERE bz.project_id = cd.project_id AND pos + len > s AND pos < e) UNION ALL SELECT * FROM gc)
SELECT project_id, arg_min(pos, (st, pr, pos))::BIGINT AS start_ms FROM al GROUP BY 1"""


@query("edt_19_place_media", with_tables("clips tracks", PLACE), sized="lineitem")
def _(spark, sf):
    media = T.clips(spark, sf).select("project_id").distinct().selectExpr("project_id", "'m1' AS media_id", "'photo.PNG' AS file", "'t0' AS track_id", "15000L AS wanted_ms", "9999L AS source_ms")
    return M.place_media(media, T.clips(spark, sf), T.tracks(spark, sf)).select("project_id", "start_ms")
