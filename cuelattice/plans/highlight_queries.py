"""Registered highlight queries and their oracles (plain joins in DuckDB, no running totals)."""

from __future__ import annotations

from pyspark.sql import functions as F

from cuelattice.functions import lexicons as L
from cuelattice.functions.scalars import plain_token
from cuelattice.kernel.intervals import merge_intervals, overlap_join
from cuelattice.kernel.scan import dealt
from cuelattice.operators import highlights as H
from cuelattice.plans import tables as T
from cuelattice.plans.registry import query
from cuelattice.plans.tables import with_tables
from cuelattice.session import cut_lineage


def _stored(spark, sf):
    """Words as they are read from the documents, segments (a row per 17 words) as a stored table.

    Several branches read both. Exploding texts again costs less than writing a second copy of the corpus.
    """
    return T.words(spark, sf), dealt(cut_lineage(T.segments(spark, sf).drop("seg_idx")), H.KEY)


def _inputs(spark, sf):
    options = H.normalize_options(T.assets(spark, sf))
    carry = H.WINDOW_OPTIONS
    raw_words, raw_segments = _stored(spark, sf)
    words, segments = H.normalize_spans(raw_words, options, carry), H.normalize_spans(raw_segments, options)
    beats = H.normalize_points(T.doc_beats(spark, sf), options, "confidence")
    events = H.normalize_points(T.audio_events(spark, sf), options, "score", carry)
    kept = H.normalize_points(T.retention(spark, sf), options, "score", carry)
    return options, words, segments, beats, events, kept


def _spans(spark, sf, cut=True):
    options, words, segments, beats, events, kept = _inputs(spark, sf)
    spans = H.windows(H.anchors(words, events, kept, options), segments)
    return options, words, segments, beats, events, kept, dealt(cut_lineage(spans), H.KEY) if cut else spans


BASE = "words assets segments audio_events retention doc_beats"
NORMAL = """,
opt AS (SELECT asset_id, duration_ms, least(duration_ms, greatest(1000, 15000)) AS min_ms FROM assets),
opts AS (SELECT *, least(duration_ms, greatest(min_ms, 45000)) AS max_ms FROM opt),
o AS (SELECT *, least(max_ms, greatest(min_ms, 30000)) AS target_ms FROM opts),
ev_n AS (SELECT e.asset_id, event_idx, least(greatest(at_ms, 0), duration_ms) AS at_ms, score, kind FROM audio_events e JOIN assets USING (asset_id)),
re_n AS (SELECT r.asset_id, least(greatest(at_ms, 0), duration_ms) AS at_ms, score FROM retention r JOIN assets USING (asset_id)),
be_n AS (SELECT b.asset_id, least(greatest(at_ms, 0), duration_ms) AS at_ms, confidence, downbeat FROM doc_beats b JOIN assets USING (asset_id))
"""
ANCHORS = """,
prevw AS (SELECT *, lag(end_ms) OVER w AS p_end, lag(text) OVER w AS p_text FROM words
          WINDOW w AS (PARTITION BY asset_id ORDER BY start_ms, word_idx)),
anchor_all AS (
  SELECT asset_id, start_ms AS anchor_ms, 0 AS kind FROM prevw WHERE p_end IS NULL
  UNION ALL SELECT asset_id, start_ms, 1 FROM prevw WHERE start_ms - p_end >= 700 OR regexp_matches(p_text, '[?!…]$')
  UNION ALL SELECT asset_id, at_ms, 2 FROM ev_n UNION ALL SELECT asset_id, at_ms, 3 FROM re_n WHERE score >= 0.65
  UNION ALL SELECT asset_id, unnest(range(0, duration_ms, greatest(5000, (target_ms + 1) // 2))), 4 FROM o),
anchor AS (SELECT asset_id, anchor_ms, min(kind) AS kind FROM anchor_all
           WHERE asset_id IN (SELECT asset_id FROM words) GROUP BY 1, 2),
w0 AS (SELECT a.asset_id, anchor_ms, kind, o.* EXCLUDE (asset_id),
              least(greatest(floor(anchor_ms - target_ms * 0.24 + 0.5), 0), greatest(0, duration_ms - target_ms))::BIGINT AS s0
       FROM anchor a JOIN o USING (asset_id)),
w1 AS (SELECT *, least(duration_ms, s0 + target_ms) AS e0 FROM w0),
w2 AS (SELECT w.asset_id, anchor_ms, kind, any_value(duration_ms) AS duration_ms, any_value(min_ms) AS min_ms, any_value(max_ms) AS max_ms,
              any_value(s0) AS s0, any_value(e0) AS e0,
              arg_min(g.start_ms, (abs(g.start_ms - s0), g.start_ms)) FILTER (abs(g.start_ms - s0) <= 1800) AS s1,
              arg_min(g.end_ms, (abs(g.end_ms - e0), g.start_ms)) FILTER (abs(g.end_ms - e0) <= 2400) AS e1
       FROM w1 w LEFT JOIN segments g USING (asset_id) GROUP BY 1, 2, 3),
w3 AS (SELECT asset_id, anchor_ms, kind, duration_ms, min_ms, max_ms, coalesce(s1, s0) AS s, coalesce(e1, e0) AS e FROM w2),
w4 AS (SELECT *, CASE WHEN e - s < min_ms THEN least(duration_ms, s + min_ms) ELSE e END AS e2, e - s < min_ms AS short FROM w3),
w5 AS (SELECT *, CASE WHEN short THEN greatest(0, e2 - min_ms) ELSE s END AS s3 FROM w4),
w6 AS (SELECT asset_id, anchor_ms, kind, s3 AS start_ms, least(e2, s3 + max_ms) AS end_ms FROM w5),
spans AS (SELECT asset_id, start_ms, end_ms, min((kind, anchor_ms)) AS ord FROM w6 WHERE end_ms > start_ms GROUP BY 1, 2, 3)
"""
COVER = """,
cut AS (SELECT DISTINCT asset_id, start_ms, end_ms, t FROM (
  SELECT asset_id, start_ms, end_ms, unnest([start_ms, end_ms]) AS t FROM spans
  UNION ALL SELECT p.asset_id, p.start_ms, p.end_ms, unnest([greatest(p.start_ms, g.start_ms), least(p.end_ms, g.end_ms)])
  FROM spans p JOIN segments g ON g.asset_id = p.asset_id AND g.end_ms > p.start_ms AND g.start_ms < p.end_ms)),
slice AS (SELECT *, lead(t) OVER (PARTITION BY asset_id, start_ms, end_ms ORDER BY t) AS hi FROM cut),
cover AS (SELECT asset_id, start_ms, end_ms, least(1.0, sum((hi - t) * level) / (end_ms - start_ms)) AS speech FROM (
  SELECT s.asset_id, s.start_ms, s.end_ms, s.t, s.hi, coalesce(max(g.confidence), 0) AS level
  FROM slice s LEFT JOIN segments g ON g.asset_id = s.asset_id AND (s.t + s.hi) / 2.0 BETWEEN g.start_ms AND g.end_ms
  WHERE hi IS NOT NULL GROUP BY 1, 2, 3, 4, 5) GROUP BY 1, 2, 3)
"""
SIGNALS = """,
sw AS (SELECT p.asset_id, p.start_ms, p.end_ms, count(*) AS n_words, round(avg(w.confidence), 9) AS transcript_confidence
       FROM spans p JOIN words w ON w.asset_id = p.asset_id AND w.end_ms > p.start_ms AND w.start_ms < p.end_ms GROUP BY 1, 2, 3),
sb AS (SELECT p.asset_id, p.start_ms, p.end_ms, count(*) AS n_beats, avg(b.confidence * CASE WHEN b.downbeat THEN 1.08 ELSE 1 END) AS mean_beat
       FROM spans p JOIN be_n b ON b.asset_id = p.asset_id AND b.at_ms BETWEEN p.start_ms AND p.end_ms GROUP BY 1, 2, 3),
se AS (SELECT p.asset_id, p.start_ms, p.end_ms,
              max(e.score * CASE WHEN kind IN ('laughter','giggle') THEN 1 WHEN kind IN ('cheering','applause') THEN 0.86 ELSE 0.62 END) AS audio_event,
              bool_or(kind IN ('laughter','giggle') AND score >= 0.55) AS laugh, bool_or(kind = 'energy' AND score >= 0.62) AS burst
       FROM spans p JOIN ev_n e ON e.asset_id = p.asset_id AND e.at_ms BETWEEN p.start_ms AND p.end_ms GROUP BY 1, 2, 3),
sr AS (SELECT p.asset_id, p.start_ms, p.end_ms, round(avg(r.score), 9) AS retention
       FROM spans p JOIN re_n r ON r.asset_id = p.asset_id AND r.at_ms BETWEEN p.start_ms AND p.end_ms GROUP BY 1, 2, 3),
sig AS (SELECT sw.*, least(1.0, n_words / greatest(1.0, (end_ms - start_ms) / 1000.0) / 2.6) AS word_density,
               least(1.0, coalesce(mean_beat, 0) * (0.55 + 0.45 * least(1.0, coalesce(n_beats, 0) / greatest(4.0, (end_ms - start_ms) / 1000.0 * 0.8)))) AS rhythm,
               least(1.0, coalesce(audio_event, 0)) AS audio_event, coalesce(laugh, false) AS laugh, coalesce(burst, false) AS burst,
               coalesce(retention, 0) AS retention
        FROM sw LEFT JOIN sb USING (asset_id, start_ms, end_ms) LEFT JOIN se USING (asset_id, start_ms, end_ms)
        LEFT JOIN sr USING (asset_id, start_ms, end_ms))
"""
_HOOK_LIST = ", ".join(f"'{w}'" for w in L.HOOK_WORDS)
HOOK = f""",
early AS (SELECT p.asset_id, p.start_ms, p.end_ms, w.text, w.start_ms AS ws, w.end_ms AS we,
                 row_number() OVER (PARTITION BY p.asset_id, p.start_ms, p.end_ms ORDER BY w.start_ms, w.word_idx) AS n
          FROM spans p JOIN words w ON w.asset_id = p.asset_id AND w.end_ms > p.start_ms AND w.start_ms < p.end_ms AND w.start_ms < p.start_ms + 4500),
hook AS (SELECT asset_id, start_ms, end_ms, least(1.0,
           count(*) FILTER (regexp_replace(lower(text), '[^\\p{{L}}\\p{{N}}]', '', 'g') IN ({_HOOK_LIST})) * 0.24
           + CASE WHEN bool_or(regexp_matches(text, '[?!…]$')) THEN 0.34 ELSE 0 END
           + CASE WHEN count(*) >= 5 AND arg_max(we, n) - arg_min(ws, n) <= 4000 THEN 0.28 ELSE 0 END) AS hook
         FROM early WHERE n <= 18 GROUP BY 1, 2, 3)
"""
SCORE = f""",
mix AS (SELECT sig.*, speech, coalesce(hook, 0) AS hook,
          asset_id IN (SELECT asset_id FROM ev_n) AS has_ev, asset_id IN (SELECT asset_id FROM re_n) AS has_re
        FROM sig JOIN cover USING (asset_id, start_ms, end_ms) LEFT JOIN hook USING (asset_id, start_ms, end_ms)),
raw AS (SELECT *, (speech*0.31 + word_density*0.19 + transcript_confidence*0.14 + hook*0.14 + rhythm*0.08
          + CASE WHEN has_ev THEN audio_event*0.18 ELSE 0 END + CASE WHEN has_re THEN retention*0.14 ELSE 0 END)
          / (0.86 + CASE WHEN has_ev THEN 0.18 ELSE 0 END + CASE WHEN has_re THEN 0.14 ELSE 0 END) AS m FROM mix),
scored AS (SELECT *, floor(round(least(1.0, m * CASE WHEN speech < 0.38 THEN 0.72 ELSE 1 END
                     * CASE WHEN transcript_confidence < 0.45 THEN 0.8 ELSE 1 END) * 100, 9) + 0.5)::BIGINT AS score,
          list_filter([CASE WHEN laugh THEN '{L.REASON_LAUGHTER}' END, CASE WHEN burst THEN '{L.REASON_ENERGY}' END,
            CASE WHEN retention >= 0.66 THEN '{L.REASON_RETENTION}' END, CASE WHEN hook >= 0.5 THEN '{L.REASON_HOOK}' END,
            CASE WHEN speech >= 0.72 AND word_density >= 0.55 THEN '{L.REASON_SPEECH}' END,
            CASE WHEN rhythm >= 0.62 THEN '{L.REASON_RHYTHM}' END], lambda x: x IS NOT NULL) AS found FROM raw)
"""
PICK = """,
ranked AS (SELECT c.asset_id, c.start_ms, c.end_ms, c.score, c.found,
             row_number() OVER (PARTITION BY c.asset_id ORDER BY c.score DESC, c.start_ms, p.ord) AS rk
           FROM scored c JOIN spans p USING (asset_id, start_ms, end_ms)),
pick AS (
  SELECT DISTINCT asset_id, 0::BIGINT AS k, []::STRUCT(s BIGINT, e BIGINT)[] AS kept FROM ranked
  UNION ALL
  SELECT p.asset_id, p.k + 1,
    CASE WHEN len(list_filter(p.kept, lambda x: greatest(0, least(x.e, r.end_ms) - greatest(x.s, r.start_ms))
                  / least(x.e - x.s, r.end_ms - r.start_ms)::DOUBLE >= 0.45)) > 0
         THEN p.kept ELSE list_append(p.kept, {'s': r.start_ms, 'e': r.end_ms}) END
  FROM pick p JOIN ranked r ON r.asset_id = p.asset_id AND r.rk = p.k + 1 WHERE len(p.kept) < 6),
last_pick AS (SELECT asset_id, arg_max(kept, k) AS kept FROM pick GROUP BY 1),
chosen AS (SELECT asset_id, u.s AS start_ms, u.e AS end_ms FROM (SELECT asset_id, unnest(kept) AS u FROM last_pick))
"""
PLAN = BASE, NORMAL + ANCHORS + COVER + SIGNALS + HOOK + SCORE + PICK


@query("prj_01_normalize_rows", with_tables("words assets audio_events", """
SELECT 'word' AS source, w.asset_id, count(*)::BIGINT AS n, sum(least(greatest(start_ms - 100, 0), duration_ms // 2))::BIGINT AS sum_start,
       sum(least(greatest(end_ms - 100, 0), duration_ms // 2))::BIGINT AS sum_end, round(sum(least(1, greatest(0, confidence * 1.5 - 0.2))), 6) AS sum_value
FROM words w JOIN assets USING (asset_id)
WHERE least(greatest(end_ms - 100, 0), duration_ms // 2) > least(greatest(start_ms - 100, 0), duration_ms // 2) GROUP BY 2
UNION ALL
SELECT 'event', e.asset_id, count(*), sum(least(greatest(at_ms - 5000, 0), duration_ms // 2))::BIGINT, NULL, round(sum(least(1, greatest(0, score * 1.5 - 0.2))), 6)
FROM audio_events e JOIN assets USING (asset_id) GROUP BY 2"""), sized="documents")
def _(spark, sf):
    half = T.assets(spark, sf).withColumn("duration_ms", F.expr("duration_ms DIV 2"))
    words = T.words(spark, sf).withColumns({
        "start_ms": F.col("start_ms") - 100.25, "end_ms": F.col("end_ms") - 100.25, "confidence": F.col("confidence") * 1.5 - 0.2,
        "text": F.concat(F.lit("  "), "text"),
    })
    events = T.audio_events(spark, sf).withColumns({"at_ms": F.col("at_ms") - 5000, "score": F.col("score") * 1.5 - 0.2})
    w = H.normalize_spans(words, half).groupBy("asset_id").agg(
        F.count("*").alias("n"), F.sum("start_ms").alias("sum_start"), F.sum("end_ms").alias("sum_end"),
        F.round(F.sum("confidence"), 6).alias("sum_value"))
    e = H.normalize_points(events, half, "score").groupBy("asset_id").agg(
        F.count("*").alias("n"), F.sum("at_ms").alias("sum_start"), F.lit(None).cast("long").alias("sum_end"),
        F.round(F.sum("score"), 6).alias("sum_value"))
    return w.withColumn("source", F.lit("word")).unionByName(e.withColumn("source", F.lit("event")))


@query("prj_02_normalize_options", with_tables("assets", """, a AS (
SELECT asset_id, duration_ms, least(duration_ms, greatest(1000, 20000)) AS min_ms FROM assets)
, b AS (SELECT *, least(duration_ms, greatest(min_ms, 10000)) AS max_ms FROM a)
SELECT asset_id, duration_ms, min_ms, max_ms, least(max_ms, greatest(min_ms, 90000)) AS target_ms, 20::BIGINT AS max_candidates, 250::BIGINT AS boundary_gap_ms FROM b"""), sized="documents")
def _(spark, sf):
    return H.normalize_options(T.assets(spark, sf), H.PlannerOptions(90_000, 20_000, 10_000, 99, 10))


@query("top_04_anchor_windows", with_tables(BASE, NORMAL + ANCHORS + "SELECT asset_id, start_ms, end_ms, ord[1]::BIGINT AS kind, ord[2]::BIGINT AS anchor_ms FROM spans"), sized="documents")
def _(spark, sf):
    spans = _spans(spark, sf, cut=False)[-1]
    return spans.withColumn("kind", F.col("kind").cast("long"))


@query("agg_13_interval_coverage", with_tables(BASE, NORMAL + ANCHORS + COVER + "SELECT asset_id, start_ms, end_ms, round(speech, 6) AS speech FROM cover"), sized="documents")
def _(spark, sf):
    _, _, segments, _, _, _, spans = _spans(spark, sf)
    return H.coverage(spans, segments).withColumn("speech", F.round("speech", 6))


@query("agg_12_window_signals", with_tables(BASE, NORMAL + ANCHORS + SIGNALS + """
SELECT asset_id, start_ms, end_ms, n_words, round(word_density, 6) AS word_density, round(transcript_confidence, 5) AS transcript_confidence,
       round(rhythm + 1e-9, 3) AS rhythm, round(audio_event, 6) AS audio_event, round(retention, 5) AS retention, laugh, burst FROM sig"""), sized="documents")
def _(spark, sf):
    _, words, _, beats, events, kept, spans = _spans(spark, sf)
    s = H.window_signals(spans, words, beats, events, kept).where("n_words > 0")
    return s.select(
        "asset_id", "start_ms", "end_ms", "n_words", F.round("word_density", 6).alias("word_density"),
        F.round("transcript_confidence", 5).alias("transcript_confidence"), F.round(F.col("rhythm") + 1e-9, 3).alias("rhythm"),
        F.round("audio_event", 6).alias("audio_event"), F.round("retention", 5).alias("retention"),
        (F.col("laughs") > 0).alias("laugh"), (F.col("bursts") > 0).alias("burst"))


@query("top_05_highlight_score", with_tables(BASE, NORMAL + ANCHORS + COVER + SIGNALS + HOOK + SCORE + f"""
SELECT asset_id, start_ms, end_ms, score, round(hook, 6) AS hook,
       CASE WHEN len(found) = 0 THEN '{L.REASON_DEFAULT}' ELSE array_to_string(found, ' | ') END AS reasons FROM scored"""), sized="documents")
def _(spark, sf):
    _, words, segments, beats, events, kept, spans = _spans(spark, sf)
    scored = H.score_candidates(words, segments, beats, events, kept, spans)
    return scored.select("asset_id", "start_ms", "end_ms", "score", F.round("hook", 6).alias("hook"), F.concat_ws(" | ", "reasons").alias("reasons"))


@query("top_03_overlap_suppression", with_tables(*PLAN, recursive=True) + "SELECT asset_id, start_ms, end_ms, score FROM chosen JOIN ranked USING (asset_id, start_ms, end_ms)", sized="documents")
def _(spark, sf):
    options, words, segments, beats, events, kept, spans = _spans(spark, sf)
    scored = H.score_candidates(words, segments, beats, events, kept, spans)
    return H.suppress_candidates(scored, options).select("asset_id", "start_ms", "end_ms", "score")


def highlight_plan(spark, sf):
    words, segments = _stored(spark, sf)
    plan = H.plan_highlights(
        T.assets(spark, sf), words, segments, T.doc_beats(spark, sf), T.audio_events(spark, sf), T.retention(spark, sf))
    return plan.select("asset_id", "candidate_id", "start_ms", "end_ms", "score", F.concat_ws(" | ", "reasons").alias("reasons"), "transcript")


query("top_06_highlight_planner", with_tables(*PLAN, recursive=True) + f"""
SELECT c.asset_id, 'short:' || c.start_ms || ':' || c.end_ms AS candidate_id, c.start_ms, c.end_ms, any_value(r.score) AS score,
       any_value(CASE WHEN len(r.found) = 0 THEN '{L.REASON_DEFAULT}' ELSE array_to_string(r.found, ' | ') END) AS reasons,
       string_agg(w.text, ' ' ORDER BY w.start_ms, w.word_idx) AS transcript
FROM chosen c JOIN ranked r USING (asset_id, start_ms, end_ms)
JOIN words w ON w.asset_id = c.asset_id AND w.end_ms > c.start_ms AND w.start_ms < c.end_ms GROUP BY 1, 2, 3, 4""", sized="documents")(highlight_plan)


HIGHLIGHT = "SELECT asset_id, greatest(0, at_ms - 4000) AS start_ms, at_ms + 9000 AS end_ms FROM audio_events"
DISCARD = f""", hl AS (SELECT h.asset_id, least(start_ms, duration_ms) AS start_ms, least(end_ms, duration_ms) AS end_ms, duration_ms
  FROM ({HIGHLIGHT}) h JOIN assets USING (asset_id) WHERE least(end_ms, duration_ms) > least(start_ms, duration_ms)),
reach AS (SELECT *, max(end_ms) OVER (PARTITION BY asset_id ORDER BY start_ms, end_ms ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev FROM hl),
island AS (SELECT *, sum(CASE WHEN prev IS NULL OR start_ms > prev THEN 1 ELSE 0 END) OVER (PARTITION BY asset_id ORDER BY start_ms, end_ms ROWS UNBOUNDED PRECEDING) AS isl FROM reach),
merged AS (SELECT asset_id, min(start_ms) AS s, max(end_ms) AS e, any_value(duration_ms) AS d FROM island GROUP BY asset_id, isl)"""
GAPS = """ SELECT * FROM (
  SELECT asset_id, coalesce(lag(e) OVER (PARTITION BY asset_id ORDER BY s), 0) AS start_ms, s AS end_ms FROM merged
  UNION ALL SELECT asset_id, max(e), any_value(d) FROM merged GROUP BY 1) WHERE end_ms > start_ms"""


def _padded_events(spark, sf):
    return T.audio_events(spark, sf).selectExpr("asset_id", "greatest(0, at_ms - 4000) AS start_ms", "at_ms + 9000 AS end_ms")


@query("win_09_complement_ranges", with_tables("assets audio_events", DISCARD + GAPS), sized="documents")
def _(spark, sf):
    return H.discard_ranges(_padded_events(spark, sf), T.assets(spark, sf))


@query("set_03_interval_difference", with_tables("assets audio_events segments", DISCARD + """
, cuts AS (SELECT DISTINCT g.asset_id, g.seg_idx, g.start_ms AS gs, g.end_ms AS ge, t FROM segments g, (SELECT asset_id, unnest([s, e]) AS t FROM merged) c WHERE c.asset_id = g.asset_id AND t > g.start_ms AND t < g.end_ms
  UNION SELECT asset_id, seg_idx, start_ms, end_ms, unnest([start_ms, end_ms]) FROM segments)
, sl AS (SELECT *, lead(t) OVER (PARTITION BY asset_id, seg_idx ORDER BY t) AS hi FROM cuts)
SELECT asset_id, seg_idx, t AS start_ms, hi AS end_ms FROM sl WHERE hi IS NOT NULL
  AND NOT EXISTS (SELECT 1 FROM merged m WHERE m.asset_id = sl.asset_id AND m.s <= sl.t AND m.e >= sl.hi)"""), sized="documents")
def _(spark, sf):
    """Speech segments minus the merged event ranges."""
    assets = T.assets(spark, sf)
    inside_asset = _padded_events(spark, sf).join(assets, ["asset_id"]).where("least(end_ms, duration_ms) > least(start_ms, duration_ms)")
    removed = merge_intervals(inside_asset, ["asset_id"])
    held = removed.select("asset_id").distinct()
    kept = H.discard_ranges(removed, assets).select("asset_id", F.col("start_ms").alias("k_start"), F.col("end_ms").alias("k_end"))
    segments = T.segments(spark, sf).drop("confidence")
    inside = overlap_join(segments, kept, ["asset_id"], ("start_ms", "end_ms"), ("k_start", "k_end"), 60_000)
    cut = inside.select("asset_id", "seg_idx", F.greatest("start_ms", "k_start").alias("start_ms"), F.least("end_ms", "k_end").alias("end_ms"))
    untouched = segments.join(held, ["asset_id"], "left_anti").select("asset_id", "seg_idx", "start_ms", "end_ms")
    return cut.unionByName(untouched)


@query("join_01_overlap_words_segments", with_tables("words audio_events", """
SELECT e.asset_id, event_idx, count(*)::BIGINT AS n, sum(word_idx)::BIGINT AS idx_sum FROM audio_events e JOIN words w
ON w.asset_id = e.asset_id AND w.end_ms > e.at_ms AND w.start_ms < e.at_ms + 8000 GROUP BY 1, 2"""), sized="documents")
def _(spark, sf):
    events = T.audio_events(spark, sf).selectExpr("asset_id", "event_idx", "at_ms AS s", "at_ms + 8000 AS e")
    pairs = overlap_join(events, T.words(spark, sf).drop("confidence"), ["asset_id"], ("s", "e"), ("start_ms", "end_ms"), 15_000)
    return pairs.groupBy("asset_id", "event_idx").agg(F.count("*").alias("n"), F.sum("word_idx").alias("idx_sum"))


@query("join_02_points_in_intervals", with_tables("segments audio_events", """
SELECT g.asset_id, seg_idx, event_idx, kind FROM segments g JOIN audio_events e ON e.asset_id = g.asset_id AND e.at_ms BETWEEN g.start_ms AND g.end_ms"""), sized="documents")
def _(spark, sf):
    events = T.audio_events(spark, sf).selectExpr("asset_id", "event_idx", "kind", "at_ms AS a", "at_ms AS b")
    pairs = overlap_join(T.segments(spark, sf), events, ["asset_id"], ("start_ms", "end_ms"), ("a", "b"), 15_000, closed=True)
    return pairs.select("asset_id", "seg_idx", "event_idx", "kind")


def _spaced_oracle(name: str, gap: str, limit: int) -> str:
    """Greedy minimum-distance selection over ``cand(asset_id, at_ms, score, ord)``."""
    return f""", rk AS (SELECT *, row_number() OVER (PARTITION BY asset_id ORDER BY score DESC, ord) AS r FROM {name}),
walk AS (SELECT DISTINCT asset_id, 0::BIGINT AS k, []::STRUCT(t BIGINT, score DOUBLE)[] AS kept FROM rk UNION ALL
  SELECT w.asset_id, w.k + 1, CASE WHEN len(list_filter(w.kept, lambda x: abs(x.t - r.at_ms) < {gap})) > 0 THEN w.kept
         ELSE list_append(w.kept, {{'t': r.at_ms, 'score': r.score}}) END
  FROM walk w JOIN rk r ON r.asset_id = w.asset_id AND r.r = w.k + 1 WHERE len(w.kept) < {limit})
SELECT asset_id, u.t AS at_ms, round(u.score, 6) AS score, 'energy' AS kind
FROM (SELECT asset_id, unnest(arg_max(kept, k)) AS u FROM walk GROUP BY 1)"""


LOUD = """, s AS (SELECT asset_id, list_sort(list(loudness_db)) AS v FROM loudness WHERE loudness_db > -100 GROUP BY 1)
, q AS (SELECT asset_id, v[floor((len(v) - 1) * 0.5 + 0.5)::BIGINT + 1] AS base, v[floor((len(v) - 1) * 0.9 + 0.5)::BIGINT + 1] AS high, len(v) AS n FROM s)
, nb AS (SELECT l.*, base, high, lag(loudness_db) OVER w AS p, lead(loudness_db) OVER w AS f FROM loudness l JOIN q USING (asset_id)
  WHERE n >= 3 AND high - base >= 1.5 WINDOW w AS (PARTITION BY asset_id ORDER BY at_ms))
, cand AS (SELECT asset_id, at_ms, at_ms AS ord, least(1.0, greatest(0.0, (loudness_db - base) / greatest(5.0, high - base))) AS score FROM nb
  WHERE loudness_db >= base + greatest(2.0, (high - base) * 0.58) AND loudness_db >= coalesce(p, -1e9) AND loudness_db >= coalesce(f, -1e9)
    AND (loudness_db - base) / greatest(5.0, high - base) >= 0.55)"""


@query("win_10_loudness_peaks", with_tables("loudness", LOUD + _spaced_oracle("cand", "750", 16), recursive=True), sized="events")
def _(spark, sf):
    return H.loudness_energy_events(T.loudness(spark, sf)).withColumn("score", F.round("score", 6))


WAVE = """, wv AS (SELECT asset_id, word_idx AS idx, confidence * confidence AS value FROM words)
, s AS (SELECT asset_id, list_sort(list(value)) AS v FROM wv GROUP BY 1)
, q AS (SELECT asset_id, v[floor((len(v) - 1) * 0.5 + 0.5)::BIGINT + 1] AS base, v[floor((len(v) - 1) * 0.9 + 0.5)::BIGINT + 1] AS high, len(v) AS n FROM s)
, nb AS (SELECT l.*, base, high, n, duration_ms, lag(value) OVER w AS p, lead(value) OVER w AS f FROM wv l JOIN q USING (asset_id) JOIN assets USING (asset_id)
  WHERE n >= 3 AND high >= 0.08 AND high - base >= 0.045 WINDOW w AS (PARTITION BY asset_id ORDER BY idx))
, cand AS (SELECT asset_id, floor((idx + 0.5) / n::DOUBLE * duration_ms + 0.5)::BIGINT AS at_ms, idx AS ord, greatest(750.0, duration_ms / n::DOUBLE * 3) AS gap,
    least(1.0, greatest(0.0, (value - base) / greatest(0.08, high - base))) AS score FROM nb
  WHERE value >= base + (high - base) * 0.62 AND value >= coalesce(p, -1) AND value >= coalesce(f, -1) AND (value - base) / greatest(0.08, high - base) >= 0.55)"""


@query("win_10_waveform_peaks", with_tables("words assets", WAVE + _spaced_oracle("cand", "r.gap", 12), recursive=True), sized="documents")
def _(spark, sf):
    wave = T.words(spark, sf).selectExpr("asset_id", "word_idx AS idx", "confidence * confidence AS value")
    return H.waveform_energy_events(wave, T.assets(spark, sf)).withColumn("score", F.round("score", 6))


@query("top_02_distance_suppression", with_tables("audio_events", """, cand AS (SELECT asset_id, at_ms, score, event_idx AS ord FROM audio_events WHERE score > 0.05)""" + _spaced_oracle("cand", "20000", 4), recursive=True), sized="documents")
def _(spark, sf):
    events = T.audio_events(spark, sf).where("score > 0.05").selectExpr(
        "asset_id", "at_ms", "at_ms + 20000 AS at_end", "score", "event_idx AS ordinal")
    return H._spaced(events, 4).select("asset_id", "at_ms", F.round("score", 6).alias("score"), F.lit("energy").alias("kind"))


_HINTS = ", ".join(f"'{w}'" for w in L.LAUGHTER_HINTS)


@query("join_08_support_fusion", with_tables("words audio_events", """
, hinted AS (SELECT asset_id, start_ms, end_ms FROM words WHERE regexp_replace(lower(text), '[^\\p{L}\\p{N}]', '', 'g') IN ('the', 'et', 'und', 'que'))
, n AS (SELECT asset_id, event_idx, at_ms AS s, at_ms + 960 AS e, score, kind FROM audio_events WHERE kind IN ('laughter','giggle'))
, sup AS (SELECT n.*, coalesce((SELECT max(x.score) FROM audio_events x WHERE x.kind = 'energy' AND x.asset_id = n.asset_id AND x.at_ms BETWEEN n.s - 750 AND n.e + 750), 0) AS en,
  EXISTS (SELECT 1 FROM hinted h WHERE h.asset_id = n.asset_id AND h.end_ms >= n.s - 500 AND h.start_ms <= n.e + 500) AS hint FROM n)
SELECT asset_id, floor((s + e) / 2.0 + 0.5)::BIGINT AS at_ms, round(least(1.0, score + en * 0.08 + CASE WHEN hint THEN 0.06 ELSE 0 END), 6) AS score, kind
FROM sup WHERE score + en * 0.08 + CASE WHEN hint THEN 0.06 ELSE 0 END > 0"""), sized="documents")
def _(spark, sf):
    """Common words of the test corpus stand in for spoken laughter cues."""
    events = T.audio_events(spark, sf)
    neural = events.where("kind IN ('laughter','giggle')").selectExpr("asset_id", "at_ms AS start_ms", "at_ms + 960 AS end_ms", "score", "kind")
    words = T.words(spark, sf).withColumn(
        "text", F.when(plain_token(F.col("text")).isin("the", "et", "und", "que"), F.lit("hahaha")).otherwise(F.lit("-")))
    return H.fuse_laughter(neural, events, words).withColumn("score", F.round("score", 6))


def _candidates(spark, sf):
    return T.segments(spark, sf).select(
        "asset_id", F.concat(F.lit("short:"), "start_ms", F.lit(":"), "end_ms").alias("candidate_id"), "start_ms", "end_ms",
        F.expr("CAST(floor(confidence * 100 + 0.5) AS BIGINT)").alias("score"), F.array(F.lit("local")).alias("reasons"))


def _answers(spark, sf):
    """Two answers per third segment (the first counts) and one for an id that was never supplied."""
    seg = T.segments(spark, sf)
    given = seg.where("seg_idx % 3 = 0").select(
        "asset_id", F.concat(F.lit("short:"), "start_ms", F.lit(":"), "end_ms").alias("candidate_id"), "seg_idx", "confidence",
        F.explode(F.array(F.lit(0), F.lit(1))).alias("answer_idx"))
    rows = given.selectExpr(
        "asset_id", "candidate_id", "CAST(answer_idx AS BIGINT) AS answer_idx", "confidence * 140 - 10 - answer_idx * 50 AS score",
        "concat(' note ', repeat('x', 400)) AS reason", "CASE WHEN seg_idx % 2 = 0 THEN '' ELSE ' speaker ' END AS focus_target")
    ghosts = seg.where("seg_idx = 0").selectExpr("asset_id", "'short:ghost' AS candidate_id", "0L AS answer_idx", "100.0D AS score", "'x' AS reason", "'' AS focus_target")
    return rows.unionByName(ghosts)


@query("join_10_ranking_sanitation", with_tables("segments", """
SELECT asset_id, 'short:' || start_ms || ':' || end_ms AS candidate_id, round(least(100, greatest(0, confidence * 140 - 10)), 6) AS score,
 'note ' || repeat('x', 315) AS reason, CASE WHEN seg_idx % 2 = 0 THEN '' ELSE 'speaker' END AS focus_target FROM segments WHERE seg_idx % 3 = 0"""), sized="documents")
def _(spark, sf):
    return H.sanitize_rankings(_answers(spark, sf), _candidates(spark, sf)).withColumn("score", F.round("score", 6))


@query("join_09_external_rerank", with_tables("segments", f"""
SELECT asset_id, 'short:' || start_ms || ':' || end_ms AS candidate_id,
  CASE WHEN seg_idx % 3 = 0 THEN floor(round(floor(confidence * 100 + 0.5) * 0.55 + least(100, greatest(0, confidence * 140 - 10)) * 0.45, 9) + 0.5)::BIGINT
       ELSE floor(confidence * 100 + 0.5)::BIGINT END AS score,
  CASE WHEN seg_idx % 3 > 0 THEN 'local' ELSE '{L.NOTE_PREFIX}note ' || repeat('x', 315) || ' | local' ||
       CASE WHEN seg_idx % 2 = 0 THEN '' ELSE ' | {L.FOCUS_PREFIX}speaker' END END AS reasons FROM segments"""), sized="documents")
def _(spark, sf):
    candidates = _candidates(spark, sf)
    merged = H.merge_rankings(candidates, H.sanitize_rankings(_answers(spark, sf), candidates))
    return merged.select("asset_id", "candidate_id", "score", F.concat_ws(" | ", "reasons").alias("reasons"))
