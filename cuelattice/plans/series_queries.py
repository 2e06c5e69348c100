"""Registered queries over frame, loudness, beat and classifier series."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from cuelattice.kernel.intervals import merge_intervals
from cuelattice.kernel.scan import Running, running
from cuelattice.operators import scoring as M
from cuelattice.operators import series as S
from cuelattice.plans import tables as T
from cuelattice.plans.registry import query
from cuelattice.plans.tables import with_tables

DUR = ", dur AS (SELECT asset_id, max(end_ms) AS duration_ms FROM frames GROUP BY 1)"
# Hysteresis as a recursive state machine: one step per frame.
SPEECH = DUR + """,
f AS (SELECT *, row_number() OVER (PARTITION BY asset_id ORDER BY at_ms) AS i FROM frames),
sm AS (SELECT asset_id, i, CASE WHEN speech_probability >= 0.5 THEN at_ms END AS sp, NULL::BIGINT AS si, NULL::BIGINT AS seg_s, NULL::BIGINT AS seg_e FROM f WHERE i = 1
  UNION ALL SELECT f.asset_id, f.i,
    CASE WHEN sm.sp IS NULL THEN CASE WHEN f.speech_probability >= 0.5 THEN f.at_ms END
         WHEN f.speech_probability < 0.35 AND f.end_ms - coalesce(sm.si, f.at_ms) >= 100 THEN NULL ELSE sm.sp END,
    CASE WHEN sm.sp IS NOT NULL AND f.speech_probability < 0.35 AND f.end_ms - coalesce(sm.si, f.at_ms) < 100 THEN coalesce(sm.si, f.at_ms) END,
    CASE WHEN sm.sp IS NOT NULL AND f.speech_probability < 0.35 AND f.end_ms - coalesce(sm.si, f.at_ms) >= 100 THEN sm.sp END,
    CASE WHEN sm.sp IS NOT NULL AND f.speech_probability < 0.35 AND f.end_ms - coalesce(sm.si, f.at_ms) >= 100 THEN coalesce(sm.si, f.at_ms) END
  FROM sm JOIN f ON f.asset_id = sm.asset_id AND f.i = sm.i + 1),
rawseg AS (SELECT asset_id, seg_s AS s, seg_e AS e FROM sm WHERE seg_s IS NOT NULL
  UNION ALL SELECT asset_id, arg_max(sp, i), any_value(duration_ms) FROM sm JOIN dur USING (asset_id) GROUP BY 1 HAVING arg_max(sp IS NOT NULL, i)),
pad AS (SELECT asset_id, greatest(s - 30, 0) AS s, least(e + 30, duration_ms) AS e FROM rawseg JOIN dur USING (asset_id) WHERE e - s >= 250),
pr AS (SELECT *, max(e) OVER (PARTITION BY asset_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pe FROM pad),
isl AS (SELECT *, sum(CASE WHEN pe IS NULL OR s > pe THEN 1 ELSE 0 END) OVER (PARTITION BY asset_id ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS g FROM pr),
sp AS (SELECT asset_id, min(s) AS start_ms, max(e) AS end_ms FROM isl GROUP BY asset_id, g),
speech AS (SELECT sp.asset_id, sp.start_ms, sp.end_ms, avg(f.speech_probability) AS confidence FROM sp
  JOIN frames f ON f.asset_id = sp.asset_id AND f.end_ms > sp.start_ms AND f.at_ms < sp.end_ms GROUP BY 1, 2, 3)
"""


def _speech(spark, sf):
    frames = T.frames(spark, sf)
    return frames, S.speech_segments(frames)


@query("win_03_hysteresis_segments", with_tables("frames", SPEECH + "SELECT asset_id, start_ms, end_ms, round(confidence + 1e-9, 5) AS confidence FROM speech", recursive=True), sized="events")
def _(spark, sf):
    return _speech(spark, sf)[1].withColumn("confidence", F.round(F.col("confidence") + 1e-9, 5))


@query("agg_07_speech_coverage", with_tables("frames", SPEECH + """, t AS (SELECT asset_id, sum(end_ms - start_ms)::BIGINT AS ms FROM speech GROUP BY 1)
SELECT f.asset_id, max(f.end_ms)::BIGINT AS duration_ms, coalesce(any_value(ms), 0)::BIGINT AS speech_ms,
  round(coalesce(any_value(ms), 0) / max(f.end_ms)::DOUBLE, 6) AS speech_coverage, round(avg(speech_probability), 6) AS average_probability
FROM frames f LEFT JOIN t USING (asset_id) GROUP BY 1""", recursive=True), sized="events")
def _(spark, sf):
    frames, speech = _speech(spark, sf)
    return S.speech_activity(frames, speech).withColumns({c: F.round(c, 6) for c in ("speech_coverage", "average_probability")})


@query("agg_06_cleanup_profile", with_tables("frames", SPEECH + """, t AS (SELECT asset_id, sum(end_ms - start_ms) AS ms FROM speech GROUP BY 1)
, lv AS (SELECT asset_id, speech_probability AS p, 10 * log10(sum_squares / sample_count) AS db FROM frames WHERE sum_squares > 1e-12)
, q AS (SELECT asset_id, list_sort(list(db) FILTER (p >= 0.55)) AS a, list_sort(list(db) FILTER (p <= 0.20)) AS b FROM lv GROUP BY 1)
SELECT d.asset_id, coalesce(ms, 0) >= greatest(least(duration_ms, 800), 250) AS speech_detected, round(coalesce(ms, 0) / duration_ms::DOUBLE, 6) AS speech_coverage,
 round(least(60, greatest(-20, coalesce(a[round((len(a) - 1) * 0.5)::BIGINT + 1], -30) - coalesce(b[round((len(b) - 1) * 0.75)::BIGINT + 1], -60))), 6) AS estimated_snr_db,
 CASE WHEN coalesce(ms, 0) >= greatest(least(duration_ms, 800), 250) THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS strength
FROM dur d LEFT JOIN t USING (asset_id) LEFT JOIN q USING (asset_id)""", recursive=True), sized="events")
def _(spark, sf):
    return S.cleanup_profile(*_speech(spark, sf)).withColumns({c: F.round(c, 6) for c in ("speech_coverage", "estimated_snr_db")})


@query("agg_03_bucket_argmax", with_tables("loudness", """, b AS (SELECT *, row_number() OVER (PARTITION BY asset_id, at_ms // 250 ORDER BY loudness_db DESC, at_ms) AS r FROM loudness)
SELECT asset_id, at_ms, loudness_db FROM b WHERE r = 1"""))
def _(spark, sf):
    return S.bucket_peaks(T.loudness(spark, sf))


PEAKS = """, smp AS (SELECT asset_id, word_idx AS idx, confidence * 2 - 1 AS v FROM words), n AS (SELECT asset_id, max(idx) + 1 AS n FROM smp GROUP BY 1)
, bk AS (SELECT asset_id, n, b AS bucket, b * n // 256 AS lo, greatest(b * n // 256 + 1, (b + 1) * n // 256) AS hi FROM n, range(0, 256) r(b))
SELECT bk.asset_id, bucket, round(coalesce(max(abs(v)), 0), 6) AS peak FROM bk LEFT JOIN smp s ON s.asset_id = bk.asset_id AND s.idx >= lo AND s.idx < hi GROUP BY 1, 2"""


@query("agg_04_waveform_peaks", with_tables("words", PEAKS))
def _(spark, sf):
    samples = T.words(spark, sf).selectExpr("asset_id", "0 AS channel", "word_idx AS idx", "confidence * 2 - 1 AS value")
    return S.waveform_peaks(samples, 256).withColumn("peak", F.round("peak", 6))


@query("agg_05_pcm_framing", """
WITH e AS (SELECT label::BIGINT AS asset_id, vec_id AS chunk_no, embedding AS samples,
       sum(len(embedding)) OVER (PARTITION BY label ORDER BY vec_id) - len(embedding) AS base FROM embeddings),
x AS (SELECT asset_id, base + p AS i, samples[p + 1]::DOUBLE * 0.5 AS v FROM (SELECT *, unnest(range(0, len(samples))) AS p FROM e))
SELECT asset_id, (i // 512)::BIGINT AS frame_idx, round(sum(v * v), 6) AS sum_squares, count(*)::BIGINT AS sample_count, round(max(abs(v)), 6) AS peak,
  ((i // 512) * 512 * 1000 // 16000)::BIGINT AS at_ms, (((i // 512) * 512 + count(*)) * 1000 + 15999)::BIGINT // 16000 AS end_ms FROM x GROUP BY asset_id, i // 512""")
def _(spark, sf):
    pcm = spark.read.parquet(f"{sf}/embeddings.parquet").selectExpr("CAST(label AS BIGINT) AS asset_id", "vec_id AS chunk_no", "embedding AS samples")
    return S.frame_pcm(pcm, gain="0.5D").withColumns({"sum_squares": F.round("sum_squares", 6), "peak": F.round("peak", 6)})


#: Scores of the tabled model by steps of the largest magnitude.
SCORE_TABLE = tuple((k * 7 % 16) / 15 for k in range(16))


@query("udf_04_frame_scores", f"""
WITH RECURSIVE e AS (SELECT label::BIGINT AS asset_id, vec_id, embedding, sum(len(embedding)) OVER (PARTITION BY label ORDER BY vec_id) - len(embedding) AS base FROM embeddings
  WHERE len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)),
x AS (SELECT asset_id, base + p AS i, least(1, abs(embedding[p + 1])) AS v FROM (SELECT *, unnest(range(0, len(embedding))) AS p FROM e)),
f AS (SELECT asset_id, (i // 512)::BIGINT AS frame_idx, count(*) AS sample_count, max(v) AS own, max(v) FILTER (i % 512 >= 448) AS last FROM x GROUP BY ALL),
s AS (SELECT *, {list(SCORE_TABLE)}[least(15, floor(greatest(own, coalesce(lag(last) OVER (PARTITION BY asset_id ORDER BY frame_idx), 0))::DOUBLE * 16)::INT) + 1]::DOUBLE AS score FROM f),
r AS (SELECT asset_id, frame_idx, sample_count, 0.5::DOUBLE * score AS p FROM s WHERE frame_idx = 0
  UNION ALL SELECT s.asset_id, s.frame_idx, s.sample_count, 0.5::DOUBLE * r.p + 0.5::DOUBLE * s.score FROM r JOIN s ON s.asset_id = r.asset_id AND s.frame_idx = r.frame_idx + 1)
SELECT asset_id, frame_idx, sample_count, (frame_idx * 512 * 1000 // 16000)::BIGINT AS at_ms, (((frame_idx * 512 + sample_count) * 1000 + 15999)::BIGINT // 16000)::BIGINT AS end_ms, round(p, 9) AS probability FROM r""")
def _(spark, sf):
    pcm = spark.read.parquet(f"{sf}/embeddings.parquet").where("forall(embedding, x -> x IS NOT NULL AND abs(x) < double('Infinity'))").selectExpr(
        "CAST(label AS BIGINT) AS asset_id", "vec_id AS chunk_no", "embedding AS samples")
    model = M.frame_model(spark, np.array(SCORE_TABLE, dtype="<f8").tobytes(), M.PeakTable.build)
    return M.score_frames(pcm, model, section_frames=64, warm_up=64).withColumn("probability", F.round("probability", 9))


@query("agg_08_bpm", with_tables("beats", """, g AS (SELECT asset_id, source_ms - lag(source_ms) OVER (PARTITION BY asset_id ORDER BY source_ms, event_id) AS gap FROM beats)
SELECT asset_id, round(60000 / median(gap), 6) AS bpm FROM g WHERE gap BETWEEN 100 AND 3000 GROUP BY 1"""), sized="events")
def _(spark, sf):
    return S.bpm(T.beats(spark, sf)).withColumn("bpm", F.round("bpm", 6))


@query("agg_09_event_confidence", """
SELECT vec_id AS asset_id, k::BIGINT AS event_idx, round((SELECT coalesce(max(1 / (1 + exp(-least(60, greatest(-60, x::DOUBLE * 10))))), 0)
   FROM (SELECT unnest(embedding[greatest(round(k * 0.13 * 50)::BIGINT - 3, 0) + 1 : least(round(k * 0.13 * 50)::BIGINT + 4, len(embedding))]) AS x)), 5) AS confidence
FROM embeddings, range(0, 12) r(k)""")
def _(spark, sf):
    events = spark.read.parquet(f"{sf}/embeddings.parquet").selectExpr(
        "vec_id AS asset_id", "transform(embedding, x -> CAST(x AS DOUBLE) * 10) AS logits", "explode(sequence(0L, 11L)) AS event_idx"
    ).withColumn("seconds", F.expr("event_idx * 0.13D"))
    return S.event_confidence(events).select("asset_id", "event_idx", F.round("confidence", 5).alias("confidence"))


@query("agg_14_union_length", with_tables("clips", """, r AS (SELECT project_id, start_ms AS s, start_ms + duration_ms AS e FROM clips)
, p AS (SELECT *, max(e) OVER (PARTITION BY project_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pe FROM r)
SELECT project_id, sum(greatest(0, e - greatest(s, coalesce(pe, s))))::BIGINT AS union_ms FROM p GROUP BY 1"""), sized="lineitem")
def _(spark, sf):
    spans = T.clips(spark, sf).selectExpr("project_id AS asset_id", "start_ms", "start_ms + duration_ms AS end_ms")
    merged = merge_intervals(spans, ["asset_id"])
    return merged.groupBy(F.col("asset_id").alias("project_id")).agg(F.sum(F.expr("end_ms - start_ms")).alias("union_ms"))


@query("win_01_merge_intervals", with_tables("clips", """, r AS (SELECT project_id, start_ms AS s, start_ms + duration_ms AS e, volume FROM clips)
, p AS (SELECT *, max(e) OVER (PARTITION BY project_id ORDER BY s, e, volume ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pe FROM r)
, i AS (SELECT *, sum(CASE WHEN pe IS NULL OR s > pe + 120 THEN 1 ELSE 0 END) OVER (PARTITION BY project_id ORDER BY s, e, volume ROWS UNBOUNDED PRECEDING) AS g FROM p)
SELECT project_id, min(s)::BIGINT AS start_ms, max(e)::BIGINT AS end_ms, round(max(volume), 6) AS volume FROM i GROUP BY project_id, g"""), sized="lineitem")
def _(spark, sf):
    spans = T.clips(spark, sf).selectExpr("project_id", "start_ms", "start_ms + duration_ms AS end_ms", "volume")
    return merge_intervals(spans, ["project_id"], gap=120, aggregates=[F.round(F.max("volume"), 6).alias("volume")])


@query("win_02_weighted_confidence_merge", with_tables("audio_events", """, g AS (SELECT asset_id, at_ms AS s, at_ms + 15000 AS e, score,
  row_number() OVER (PARTITION BY asset_id ORDER BY at_ms, score) AS i FROM audio_events)
, w AS (SELECT asset_id, i, s, e, score AS c, 1 AS grp FROM g WHERE i = 1 UNION ALL
  SELECT g.asset_id, g.i, CASE WHEN g.s <= w.e THEN w.s ELSE g.s END, CASE WHEN g.s <= w.e THEN greatest(w.e, g.e) ELSE g.e END,
   CASE WHEN g.s <= w.e THEN (w.c * (w.e - w.s) + g.score * (g.e - g.s)) / greatest(1, (w.e - w.s) + (g.e - g.s)) ELSE g.score END,
   CASE WHEN g.s <= w.e THEN w.grp ELSE w.grp + 1 END FROM w JOIN g ON g.asset_id = w.asset_id AND g.i = w.i + 1)
SELECT asset_id, arg_max(s, i)::BIGINT AS start_ms, arg_max(e, i)::BIGINT AS end_ms, round(arg_max(c, i), 6) AS confidence FROM w GROUP BY asset_id, grp""", recursive=True), sized="documents")
def _(spark, sf):
    spans = T.audio_events(spark, sf).selectExpr("asset_id", "at_ms AS start_ms", "at_ms + 15000 AS end_ms", "score AS confidence")
    return S.weighted_merge(spans).withColumn("confidence", F.round("confidence", 6))


@query("win_04_classifier_sessions", with_tables("class_frames", """, d AS (SELECT asset_id, max(t) + 700 AS duration_ms FROM class_frames GROUP BY 1)
, r AS (SELECT c.asset_id, t AS s, least(t + 960, duration_ms) AS e, s AS score, l FROM class_frames c JOIN d USING (asset_id) WHERE s >= 0.35)
, p AS (SELECT *, max(e) OVER (PARTITION BY asset_id ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pe FROM r)
, i AS (SELECT *, sum(CASE WHEN pe IS NULL OR s > pe + 600 THEN 1 ELSE 0 END) OVER (PARTITION BY asset_id ORDER BY s ROWS UNBOUNDED PRECEDING) AS g FROM p)
, m AS (SELECT asset_id, min(s) AS start_ms, max(e) AS end_ms, max(score) AS peak, avg(score) AS mean, count(*) AS n, arg_max(l, (score, -s)) AS label FROM i GROUP BY asset_id, g)
SELECT asset_id, CASE WHEN label IN ('Giggle','Snicker') THEN 'giggle' ELSE 'laughter' END AS kind, label, start_ms, end_ms, round(peak, 6) AS confidence,
 round(mean, 6) AS average_confidence, n AS frame_count FROM m WHERE n >= 2 OR peak >= 0.55"""), sized="events")
def _(spark, sf):
    frames = T.class_frames(spark, sf)
    durations = frames.groupBy("asset_id").agg((F.max("t") + 700).alias("duration_ms"))
    return S.class_events(frames, 0.35, durations).withColumns({c: F.round(c, 6) for c in ("confidence", "average_confidence")})


NEAR = """, b AS (SELECT asset_id, (source_ms // 8)::BIGINT AS at_ms, event_id, confidence, row_number() OVER (PARTITION BY asset_id ORDER BY source_ms // 8, event_id) AS i FROM beats)
, w AS (SELECT asset_id, i, at_ms, confidence, 1 AS grp FROM b WHERE i = 1 UNION ALL
  SELECT b.asset_id, b.i, CASE WHEN b.at_ms - w.at_ms > 70 OR b.confidence > w.confidence THEN b.at_ms ELSE w.at_ms END,
   CASE WHEN b.at_ms - w.at_ms > 70 OR b.confidence > w.confidence THEN b.confidence ELSE w.confidence END,
   CASE WHEN b.at_ms - w.at_ms > 70 THEN w.grp + 1 ELSE w.grp END FROM w JOIN b ON b.asset_id = w.asset_id AND b.i = w.i + 1)
SELECT asset_id, arg_max(at_ms, i) AS at_ms, round(arg_max(confidence, i), 6) AS confidence FROM w GROUP BY asset_id, grp"""


@query("win_05_near_duplicate_merge", with_tables("beats", NEAR, recursive=True), sized="events")
def _(spark, sf):
    events = T.beats(spark, sf).selectExpr("asset_id", "event_id", "source_ms DIV 8 AS at_ms", "confidence")
    return S.merge_near_events(events).withColumn("confidence", F.round("confidence", 6))


CHUNKS = """, d AS (SELECT asset_id, max(source_ms) + 500 AS duration_ms FROM beats GROUP BY 1)
, ch AS (SELECT asset_id, k AS chunk_no, k * 8000 AS start_ms, least(k * 8000 + 10000, duration_ms) AS end_ms
  FROM (SELECT asset_id, duration_ms, unnest(range(0, greatest(0, (duration_ms - 10000 + 7999) // 8000) + 1)) AS k FROM d))"""


def _chunks(spark, sf):
    beats = T.beats(spark, sf)
    durations = beats.groupBy("asset_id").agg((F.max("source_ms") + 500).alias("duration_ms"))
    return beats, S.overlapped_chunks(durations, 10_000, 2_000)


@query("str_09_overlapped_chunks", with_tables("beats", CHUNKS + "SELECT asset_id, chunk_no, start_ms, end_ms FROM ch"))
def _(spark, sf):
    return _chunks(spark, sf)[1]


@query("win_06_chunk_overlap_trim", with_tables("beats", CHUNKS + """, last AS (SELECT asset_id, max(chunk_no) AS top FROM ch GROUP BY 1)
SELECT b.asset_id, chunk_no, event_id, source_ms - start_ms AS local_ms, source_ms AS at_ms FROM beats b JOIN ch ON ch.asset_id = b.asset_id AND b.source_ms BETWEEN start_ms AND end_ms
JOIN last ON last.asset_id = b.asset_id WHERE source_ms - start_ms >= CASE WHEN chunk_no = 0 THEN 0 ELSE 1000 END
  AND source_ms - start_ms <= end_ms - start_ms - CASE WHEN chunk_no = top THEN 0 ELSE 1000 END"""), sized="events")
def _(spark, sf):
    beats, chunks = _chunks(spark, sf)
    # A beat lies in at most two chunks of this spacing.
    seen = beats.selectExpr("*", "explode(array_distinct(array(greatest(source_ms DIV 8000 - 1, 0), source_ms DIV 8000))) AS chunk_no")
    local = seen.join(chunks, ["asset_id", "chunk_no"]).where("source_ms BETWEEN start_ms AND end_ms").selectExpr(
        "asset_id", "chunk_no", "event_id", "source_ms - start_ms AS local_ms")
    spans = chunks.selectExpr("asset_id", "chunk_no", "start_ms AS offset_ms", "end_ms - start_ms AS length_ms")
    return S.trusted_centre(local, spans, 2_000)


@query("agg_18_strongest_per_timestamp", with_tables("class_frames", """, two AS (SELECT asset_id, t // 960 * 960 AS t, s, l, t AS ordinal FROM class_frames)
SELECT asset_id, t, round(arg_max(s, (s, -ordinal)), 6) AS s, arg_max(l, (s, -ordinal)) AS l FROM two GROUP BY 1, 2"""))
def _(spark, sf):
    frames = T.class_frames(spark, sf).selectExpr("asset_id", "t DIV 960 * 960 AS t", "s", "l", "t AS ordinal")
    return S.strongest_per_timestamp(frames).select("asset_id", "t", F.round("s", 6).alias("s"), "l")


LEVELS = """, lv AS (SELECT *, sum(sum_squares) OVER w AS s, sum(sample_count) OVER w AS n, max(peak) OVER w AS p FROM frames
  WINDOW w AS (PARTITION BY asset_id ORDER BY at_ms ROWS BETWEEN 6 PRECEDING AND 6 FOLLOWING))
, lvl AS (SELECT *, CASE WHEN s <= 1e-12 THEN -120 ELSE 10 * log10(s / n) END AS rms_dbfs, CASE WHEN p <= 1e-9 THEN -120 ELSE 20 * log10(p) END AS peak_dbfs FROM lv)"""


@query("win_11_rolling_levels", with_tables("frames", LEVELS + "SELECT asset_id, at_ms, round(rms_dbfs, 6) AS rms_dbfs, round(peak_dbfs, 6) AS peak_dbfs FROM lvl"), sized="events")
def _(spark, sf):
    return S.rolling_levels(T.frames(spark, sf)).select("asset_id", "at_ms", F.round("rms_dbfs", 6).alias("rms_dbfs"), F.round("peak_dbfs", 6).alias("peak_dbfs"))


ENVELOPE = SPEECH + LEVELS + """, fx AS (SELECT l.asset_id, row_number() OVER (PARTITION BY l.asset_id ORDER BY at_ms) AS i, at_ms + (l.end_ms - at_ms) // 2 AS c, peak_dbfs, rms_dbfs, speech_probability AS p,
   EXISTS (SELECT 1 FROM speech s WHERE s.asset_id = l.asset_id AND at_ms + (l.end_ms - at_ms) // 2 >= s.start_ms AND at_ms + (l.end_ms - at_ms) // 2 < s.end_ms) AS act FROM lvl l)
, fd AS (SELECT *, -1.5 - peak_dbfs - 0.5 AS cap, CASE WHEN act THEN least(-1.5 - peak_dbfs - 0.5, CASE WHEN rms_dbfs > -55 THEN least(12, greatest(-18, -19 - rms_dbfs)) ELSE 0 END) ELSE 0 END::DOUBLE AS want FROM fx)
, gw AS (SELECT asset_id, 0::BIGINT AS i, 0::DOUBLE AS g FROM dur UNION ALL
  SELECT fd.asset_id, fd.i, least(12, greatest(-18, least(gw.g + (1 - exp(-32.0 / CASE WHEN want < gw.g THEN 80.0 ELSE 400.0 END)) * (want - gw.g), CASE WHEN act THEN cap ELSE 0 END)))
  FROM gw JOIN fd ON fd.asset_id = gw.asset_id AND fd.i = gw.i + 1)
, se AS (SELECT asset_id, max(end_ms) AS se FROM speech GROUP BY 1)
, env AS (SELECT asset_id, 0::BIGINT AS at_ms, 0::DOUBLE AS gain_db FROM dur
  UNION ALL SELECT gw.asset_id, c, g FROM gw JOIN fd ON fd.asset_id = gw.asset_id AND fd.i = gw.i
  UNION ALL SELECT d.asset_id, duration_ms, CASE WHEN coalesce(se, -1) >= duration_ms THEN arg_max(g, i) ELSE least(arg_max(g, i), 0) END FROM dur d JOIN gw ON gw.asset_id = d.asset_id LEFT JOIN se ON se.asset_id = d.asset_id GROUP BY d.asset_id, duration_ms, se)"""


@query("win_12_gain_envelope", with_tables("frames", ENVELOPE + """, tl AS (SELECT asset_id, unnest([duration_ms + 400, duration_ms + 1000]) AS at_ms FROM dur)
SELECT asset_id, at_ms, round(gain_db, 6) AS gain_db FROM env UNION ALL SELECT asset_id, at_ms, 0.0::DOUBLE FROM tl""", recursive=True), sized="events")
def _(spark, sf):
    frames, speech = _speech(spark, sf)
    durations = frames.groupBy("asset_id").agg(F.max("end_ms").alias("actual_ms")).withColumn("expected_ms", F.col("actual_ms") + 1000)
    envelope = S.extend_silent_tail(S.gain_envelope(frames, speech), durations)
    return envelope.select("asset_id", "at_ms", F.round("gain_db", 6).alias("gain_db"))


@query("win_14_cap_points", with_tables("loudness", """, n AS (SELECT *, row_number() OVER (PARTITION BY asset_id ORDER BY at_ms) - 1 AS i, count(*) OVER (PARTITION BY asset_id) AS n FROM loudness)
SELECT asset_id, at_ms, loudness_db FROM n WHERE n <= 20 OR i IN (SELECT round(k * (n.n - 1) / 19.0)::BIGINT FROM range(0, 20) r(k))"""), sized="events")
def _(spark, sf):
    return S.cap_points(T.loudness(spark, sf), ["at_ms"], 20)


@query("win_15_last_wins_keyframes", with_tables("loudness", """, v AS (SELECT asset_id, at_ms // 300 * 300 + 300 AS at_ms, (loudness_db + 60) / 20 AS gain, at_ms AS o FROM loudness WHERE loudness_db > -60)
, d AS (SELECT asset_id, max(at_ms) + 1000 AS duration_ms FROM loudness GROUP BY 1)
, u AS (SELECT asset_id, at_ms, arg_max(gain, o) AS gain FROM v GROUP BY 1, 2)
SELECT asset_id, at_ms, round(least(4, gain), 6) AS value, 'ease-in-out' AS easing FROM (SELECT * FROM u UNION ALL SELECT asset_id, 0, arg_min(gain, at_ms) FROM u GROUP BY 1
 UNION ALL SELECT asset_id, any_value(duration_ms), arg_max(gain, at_ms) FROM u JOIN d USING (asset_id) GROUP BY 1)"""))
def _(spark, sf):
    loud = T.loudness(spark, sf)
    durations = loud.groupBy("asset_id").agg((F.max("at_ms") + 1000).alias("duration_ms"))
    points = loud.selectExpr("asset_id", "at_ms DIV 300 * 300 + 300 AS at_ms", "(loudness_db + 60) / 20 AS gain", "at_ms AS ordinal")
    return S.rider_keyframes(points, durations).withColumn("value", F.round("value", 6))


@query("join_05_tolerance_match", with_tables("beats", """, bt AS (SELECT asset_id, event_id AS beat_idx, source_ms, confidence FROM beats WHERE NOT downbeat)
, dn AS (SELECT asset_id, event_id AS down_idx, source_ms - 430 + event_id % 60 AS d_ms, confidence AS d_conf FROM beats WHERE downbeat)
, m AS (SELECT b.*, (SELECT arg_min(d_conf, down_idx) FROM dn WHERE dn.asset_id = b.asset_id AND abs(d_ms - source_ms) <= 70) AS dc FROM bt b)
, al AS (SELECT *, row_number() OVER (PARTITION BY asset_id ORDER BY d_ms, down_idx) AS i FROM dn WHERE NOT EXISTS (SELECT 1 FROM bt WHERE bt.asset_id = dn.asset_id AND abs(dn.d_ms - bt.source_ms) <= 70))
, w AS (SELECT asset_id, i, d_ms AS last, true AS keep, d_ms, d_conf FROM al WHERE i = 1 UNION ALL
  SELECT al.asset_id, al.i, CASE WHEN al.d_ms - w.last > 70 THEN al.d_ms ELSE w.last END, al.d_ms - w.last > 70, al.d_ms, al.d_conf FROM w JOIN al ON al.asset_id = w.asset_id AND al.i = w.i + 1)
SELECT asset_id, source_ms, round(greatest(confidence, coalesce(dc, 0)), 6) AS confidence, dc IS NOT NULL AS downbeat FROM m
UNION ALL SELECT asset_id, d_ms, round(d_conf, 6), true FROM w WHERE keep""", recursive=True), sized="events")
def _(spark, sf):
    beats = T.beats(spark, sf)
    down = beats.where("downbeat").selectExpr("asset_id", "event_id AS down_idx", "source_ms - 430 + event_id % 60 AS source_ms", "confidence")
    plain = beats.where("NOT downbeat").selectExpr("asset_id", "event_id AS beat_idx", "source_ms", "confidence")
    return S.beat_markers(plain, down).withColumn("confidence", F.round("confidence", 6))


@query("agg_20_normalization_gain", with_tables("clips loudness", """, k AS (SELECT asset_id, max(greatest(0, (loudness_db + 60) / 15)) AS top FROM loudness GROUP BY 1)
, c AS (SELECT project_id AS asset_id, max(volume) AS volume, -30 + max(clip_idx) * 3.5 AS mi, -8 + min(clip_idx) * 1.0 AS mt FROM clips GROUP BY 1)
, r AS (SELECT c.*, least(-14 - mi, -1 - mt) AS db, greatest(0, volume) AS base, greatest(0, volume, coalesce(top, 0)) AS loud FROM c LEFT JOIN k USING (asset_id))
, s AS (SELECT *, greatest(0, least(pow(10, db / 20), coalesce(CASE WHEN base <= 0 OR loud <= base THEN NULL ELSE pow(10, (-1 - mt - 20 * log10(loud / base)) / 20) END, pow(10, db / 20)))) AS want FROM r)
, m AS (SELECT *, greatest(0, least(want, CASE WHEN loud > 0 THEN 4 / loud ELSE 1 END)) AS mul FROM s)
SELECT asset_id, round(db, 6)::DOUBLE AS recommended_db, round(mul, 6) AS multiplier, round(least(4, greatest(0, volume * mul)), 6) AS volume, mul + 1e-6 < want AS limited FROM m"""))
def _(spark, sf):
    clips = T.clips(spark, sf).groupBy(F.col("project_id").alias("asset_id")).agg(
        F.max("volume").alias("volume"), F.expr("-30 + max(clip_idx) * 3.5D AS measured_lufs"), F.expr("-8 + min(clip_idx) * 1.0D AS measured_tp")
    ).withColumns({"target_lufs": F.lit(-14.0), "target_tp": F.lit(-1.0)})
    keys = T.loudness(spark, sf).selectExpr("asset_id", "(loudness_db + 60) / 15 AS value")
    out = S.normalization_gain(clips, keys)
    return out.withColumns({c: F.round(c, 6) for c in ("recommended_db", "multiplier", "volume")})


PIX = """SELECT l_orderkey AS asset_id, l_linenumber::BIGINT AS frame_idx, (l_partkey * 7) % 12 AS r, (l_suppkey * 5) % 12 AS g, CAST(l_quantity AS BIGINT) % 12 AS b FROM lineitem"""


@query("agg_19_black_frames", f"SELECT asset_id, frame_idx, avg(CASE WHEN 0.2126 * r + 0.7152 * g + 0.0722 * b > 8 THEN 1.0 ELSE 0.0 END) < 0.02 AS black FROM ({PIX}) GROUP BY 1, 2")
def _(spark, sf):
    pixels = spark.read.parquet(f"{sf}/lineitem.parquet").selectExpr(
        "l_orderkey AS asset_id", "CAST(l_linenumber AS BIGINT) AS frame_idx", "(l_partkey * 7) % 12 AS r", "(l_suppkey * 5) % 12 AS g", "CAST(l_quantity AS BIGINT) % 12 AS b")
    return S.frame_blackness(pixels)


@query("win_32_trailing_black", with_tables("ev", """, s AS (SELECT user_id AS asset_id, rn * 100 AS at_ms, (rn + user_id) % 61 > (user_id * 7) % 50 AS black FROM ev)
, d AS (SELECT asset_id, max(at_ms) + 60 AS duration_ms FROM s GROUP BY 1)
, p AS (SELECT d.asset_id, duration_ms, arg_max(black, at_ms) AS eb, max(at_ms) FILTER (NOT black) AS lb FROM d JOIN s ON s.asset_id = d.asset_id
   AND at_ms <= duration_ms - 50 AND at_ms >= duration_ms - 50 - least(2000, duration_ms - 8.333333333333334) GROUP BY 1, 2)
SELECT asset_id, duration_ms, round(CASE WHEN eb AND lb IS NOT NULL THEN greatest(8.333333333333334, least(duration_ms, lb + 20)) ELSE duration_ms END, 6)::DOUBLE AS trimmed_ms FROM p"""))
def _(spark, sf):
    series = T.numbered_events(spark, sf).selectExpr("user_id AS asset_id", "rn * 100 AS at_ms", "(rn + user_id) % 61 > (user_id * 7) % 50 AS black")
    durations = series.groupBy("asset_id").agg((F.max("at_ms") + 60).alias("duration_ms"))
    return S.trailing_black(series, durations).withColumn("trimmed_ms", F.round("trimmed_ms", 6))


@query("agg_17_speech_metadata", with_tables("segments assets", """, g AS (SELECT asset_id, sum(end_ms - start_ms) AS ms, sum(confidence * (end_ms - start_ms)) AS w FROM segments GROUP BY 1)
SELECT asset_id, round(coalesce(ms, 0) / duration_ms::DOUBLE, 6) AS speech_coverage, round(coalesce(w / ms, 0) + 1e-9, 6) AS average_confidence FROM assets LEFT JOIN g USING (asset_id)"""))
def _(spark, sf):
    out = S.speech_metadata(T.segments(spark, sf), T.assets(spark, sf))
    return out.withColumns({"speech_coverage": F.round("speech_coverage", 6), "average_confidence": F.round(F.col("average_confidence") + 1e-9, 6)})


@query("set_01_union_event_kinds", with_tables("audio_events retention", """
SELECT asset_id, at_ms, round(score, 6) AS score, kind FROM audio_events UNION ALL SELECT asset_id, at_ms, round(score, 6), 'energy' FROM retention"""))
def _(spark, sf):
    energy = T.retention(spark, sf).selectExpr("asset_id", "at_ms", "score", "'energy' AS kind")
    return T.audio_events(spark, sf).select("asset_id", "at_ms", "score", "kind").unionByName(energy).withColumn("score", F.round("score", 6))


@query("set_02_distinct_times", with_tables("beats", """, t AS (SELECT DISTINCT asset_id, source_ms // 3 AS tm FROM beats), p AS (SELECT *, lag(tm) OVER (PARTITION BY asset_id ORDER BY tm) AS q FROM t)
SELECT asset_id, tm AS at_ms FROM p WHERE q IS NULL OR tm - q >= 130"""), sized="events")
def _(spark, sf):
    """Times closer than the tolerance to their raw neighbour are dropped."""
    times = T.beats(spark, sf).selectExpr("asset_id", "source_ms DIV 3 AS at_ms").distinct()
    seen = running(times, ["asset_id"], ["at_ms"], [Running("prev", "last", F.col("at_ms"), inclusive=False)], F.expr("at_ms DIV 600000"))
    return seen.where("prev IS NULL OR at_ms - prev >= 130").drop("prev")
