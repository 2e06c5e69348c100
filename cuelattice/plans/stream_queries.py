"""Registered streaming queries: the events table is read as a stream and drained; results equal the batch forms."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from cuelattice.plans.registry import query
from cuelattice.session import ensure_checkpoint_dir
from cuelattice.streaming import jobs as J
from cuelattice.streaming.drain import drain


#: Key and number of the closing row; the number gives it a classifier score above every threshold.
CLOSING_USER, CLOSING_EVENT = -1, 40


#: Slices in which the events are delivered, each a span of time and a batch of its own.
SLICES, SPAN_MS = 4, 31 * 86_400_000
LATENESS, WEEK_MS = f"{SPAN_MS} milliseconds", 7 * 86_400_000


def _events(spark, sf):
    """Events as a stream that ends, delivered in time order by several files; media time is event time in milliseconds.

    The table is written again in slices of time, one after the other, each in as many files as the table is read in;
    a batch takes that many, so that there is one a slice however large the table is. A closing row, ninety
    days after the last event and of a user of its own, comes last. It moves the watermark past every real row,
    so whatever is still open is closed and emitted; its own state never is.
    """
    static = spark.read.parquet(f"{sf}/events.parquet")
    ensure_checkpoint_dir(spark)
    folder = f"{spark.sparkContext.getCheckpointDir()}/slices-{uuid.uuid4().hex}"
    least, most = static.agg(F.min("ts"), F.max("ts")).first()
    ends = [] if least is None else [least + (most - least) / SLICES * k for k in range(1, SLICES)]
    files, written = max(1, static.rdd.getNumPartitions()), 0
    for k in range(SLICES):
        after = F.lit(True) if k == 0 or not ends else F.col("ts") >= F.lit(ends[k - 1])
        before = F.lit(True) if k == SLICES - 1 or not ends else F.col("ts") < F.lit(ends[k])
        static.where(after & before).repartition(files).write.mode("append").parquet(folder)
        written += files
        # A part without rows leaves no file; empty ones keep the next slice out of this one's batch.
        while len(spark.read.schema(static.schema).parquet(folder).inputFiles()) < written:
            spark.createDataFrame([], static.schema).coalesce(1).write.mode("append").parquet(folder)
    last = static.agg(F.coalesce(F.max("ts"), F.to_timestamp_ntz(F.lit("1970-01-01 00:00:00"))).alias("ts"))
    closing = {"event_id": F.lit(CLOSING_EVENT), "user_id": F.lit(CLOSING_USER), "ts": F.col("ts") + F.expr("INTERVAL 90 DAYS"), "value": F.lit(0.0)}
    last.select(*[closing.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in static.schema.fields]).write.mode("append").parquet(folder)
    stream = spark.readStream.schema(static.schema).option("maxFilesPerTrigger", files).parquet(folder)
    return stream.withColumn("ms", F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', CAST(ts AS TIMESTAMP_NTZ)) DIV 1000")).drop("ts")


def _rows(spark, sf):
    """The same rows without the closing one, for queries that keep no state open."""
    return _events(spark, sf).where(F.col("user_id") != CLOSING_USER)


MS = "(epoch_us(ts) // 1000)"
LOUD = f"SELECT user_id AS asset_id, {MS} AS at_ms, -60 + (CAST(floor(value * 10) AS BIGINT) % 600) / 10.0::DOUBLE AS loudness_db FROM events"


@query("str_02_bucket_stream", f"""WITH l AS ({LOUD}), b AS (SELECT *, row_number() OVER (PARTITION BY asset_id, at_ms // 600000 ORDER BY loudness_db DESC, at_ms) AS r FROM l)
SELECT asset_id, at_ms, loudness_db FROM b WHERE r = 1""")
def _(spark, sf):
    points = _events(spark, sf).selectExpr("user_id AS asset_id", "ms AS at_ms", "-60 + (CAST(floor(value * 10) AS BIGINT) % 600) / 10.0D AS loudness_db")
    return drain(J.bucket_peaks_stream(points, 600_000, LATENESS), spark)


@query("str_03_session_stream", f"""WITH f AS (SELECT user_id AS asset_id, {MS} // 3600 AS t, ((event_id * 53) % 101) / 100.0::DOUBLE AS s, CASE WHEN event_id % 2 = 0 THEN 'Laughter' ELSE 'Giggle' END AS l FROM events)
, k AS (SELECT * FROM f WHERE s >= 0.35), p AS (SELECT *, lag(t) OVER (PARTITION BY asset_id ORDER BY t) AS q FROM k), g AS (SELECT *, sum(CASE WHEN q IS NULL OR t - q > 1560 THEN 1 ELSE 0 END) OVER (PARTITION BY asset_id ORDER BY t ROWS UNBOUNDED PRECEDING) AS g FROM p)
, e AS (SELECT asset_id, min(t) AS start_ms, max(t) + 960 AS end_ms, max(s) AS confidence, avg(s) AS m, count(*) AS frame_count, arg_max(l, (s, -t)) AS label FROM g GROUP BY asset_id, g)
SELECT asset_id, CASE WHEN label = 'Giggle' THEN 'giggle' ELSE 'laughter' END AS kind, label, start_ms, end_ms, confidence, round(m, 6) AS average_confidence, frame_count FROM e
WHERE (frame_count >= 2 OR confidence >= 0.55)""")
def _(spark, sf):
    frames = _events(spark, sf).selectExpr("user_id AS asset_id", "ms DIV 3600 AS t", "((event_id * 53) % 101) / 100.0D AS s", "IF(event_id % 2 = 0, 'Laughter', 'Giggle') AS l")
    return drain(J.class_sessions_stream(frames, 0.35, f"{SPAN_MS // 3600} milliseconds"), spark).withColumn("average_confidence", F.round("average_confidence", 6))


SPEECH = f"""WITH RECURSIVE f AS (SELECT *, row_number() OVER (PARTITION BY asset_id ORDER BY at_ms) AS i FROM (SELECT user_id AS asset_id, {MS} AS at_ms, {MS} + 32 AS end_ms, ((event_id // 3 * 37) % 101) / 100.0::DOUBLE AS p FROM events))
, w AS (SELECT asset_id, i, end_ms AS last, CASE WHEN p >= 0.5 THEN at_ms END AS speech, NULL::BIGINT AS silence, NULL::BIGINT AS s, NULL::BIGINT AS e FROM f WHERE i = 1
  UNION ALL SELECT f.asset_id, f.i, f.end_ms,
    CASE WHEN speech IS NULL THEN CASE WHEN p >= 0.5 THEN f.at_ms END WHEN p < 0.35 AND f.end_ms - coalesce(silence, f.at_ms) >= 100 THEN NULL ELSE speech END,
    CASE WHEN speech IS NOT NULL AND p < 0.35 AND f.end_ms - coalesce(silence, f.at_ms) < 100 THEN coalesce(silence, f.at_ms) END,
    CASE WHEN speech IS NOT NULL AND p < 0.35 AND f.end_ms - coalesce(silence, f.at_ms) >= 100 THEN speech END,
    CASE WHEN speech IS NOT NULL AND p < 0.35 AND f.end_ms - coalesce(silence, f.at_ms) >= 100 THEN coalesce(silence, f.at_ms) END
  FROM w JOIN f ON f.asset_id = w.asset_id AND f.i = w.i + 1)
SELECT asset_id, s AS start_ms, e AS end_ms FROM w WHERE e - s >= 250 UNION ALL
SELECT asset_id, arg_max(speech, i), max(last) FROM w GROUP BY 1 HAVING arg_max(speech IS NOT NULL, i) AND max(last) - arg_max(coalesce(speech, 0), i) >= 250"""


@query("str_04_speech_stream", SPEECH)
def _(spark, sf):
    frames = _events(spark, sf).selectExpr("user_id AS asset_id", "ms AS at_ms", "ms + 32 AS end_ms", "((event_id DIV 3 * 37) % 101) / 100.0D AS speech_probability")
    return drain(J.speech_segments_stream(frames, LATENESS, SPAN_MS, WEEK_MS, wait=True), spark)


TRACK = f"SELECT user_id AS asset_id, {MS} AS time_ms, 0.3 + (event_id * 17 % 41) / 100.0::DOUBLE AS x, 0.3 + (event_id * 23 % 41) / 100.0::DOUBLE AS y, (event_id * 37 % 101) / 100.0::DOUBLE AS confidence, CASE WHEN event_id % 4 = 0 THEN 'held' ELSE 'tracked' END AS state FROM events"


@query("str_10_smoothing_stream", f"""WITH s AS ({TRACK}), nb AS (SELECT c.asset_id, c.time_ms, n.time_ms AS nt, n.x, n.y, n.state, n.confidence FROM s c JOIN s n ON n.asset_id = c.asset_id AND abs(n.time_ms - c.time_ms) <= 3600000)
, md AS (SELECT *, median(x) OVER w AS mx, median(y) OVER w AS my FROM nb WINDOW w AS (PARTITION BY asset_id, time_ms)), tl AS (SELECT *, greatest(0.006, 4.4478 * median(abs(x - mx)) OVER w) AS tx, greatest(0.006, 4.4478 * median(abs(y - my)) OVER w) AS ty FROM md WINDOW w AS (PARTITION BY asset_id, time_ms))
, wt AS (SELECT *, exp(-abs(nt - time_ms) / 3600000.0) * CASE WHEN state = 'tracked' THEN greatest(0.2, confidence) ELSE 0.15 END AS w FROM tl)
SELECT asset_id, time_ms, round(least(0.9, greatest(0.1, sum(x * w) FILTER (abs(x - mx) <= tx) / sum(w) FILTER (abs(x - mx) <= tx))), 6) AS x, round(least(0.85, greatest(0.15, sum(y * w) FILTER (abs(y - my) <= ty) / sum(w) FILTER (abs(y - my) <= ty))), 6) AS y FROM wt GROUP BY 1, 2""")
def _(spark, sf):
    samples = _events(spark, sf).selectExpr(
        "user_id AS asset_id", "ms AS time_ms", "0.3D + (event_id * 17 % 41) / 100.0D AS x", "0.3D + (event_id * 23 % 41) / 100.0D AS y", "0.2D AS width", "0.3D AS height",
        "(event_id * 37 % 101) / 100.0D AS confidence", "IF(event_id % 4 = 0, 'held', 'tracked') AS state")
    return drain(J.smoothing_stream(samples, 3_600_000, SPAN_MS, WEEK_MS), spark).selectExpr("asset_id", "time_ms", "round(x, 6) AS x", "round(y, 6) AS y")


DEBOUNCED = f"""WITH RECURSIVE n AS (SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY at_ms, revision) AS i FROM (SELECT user_id AS project_id, {MS} AS at_ms, event_id AS revision FROM events))
, w AS (SELECT project_id, i, at_ms AS f, at_ms AS l, revision AS r, NULL::BIGINT AS out_at, NULL::BIGINT AS out_r FROM n WHERE i = 1 UNION ALL
  SELECT n.project_id, n.i, CASE WHEN n.at_ms >= least(l + 3600000, f + 36000000) THEN n.at_ms ELSE f END, n.at_ms, n.revision, CASE WHEN n.at_ms >= least(l + 3600000, f + 36000000) THEN least(l + 3600000, f + 36000000) END, CASE WHEN n.at_ms >= least(l + 3600000, f + 36000000) THEN r END
  FROM w JOIN n ON n.project_id = w.project_id AND n.i = w.i + 1)
SELECT project_id, out_at AS written_at_ms, out_r AS revision FROM w WHERE out_at IS NOT NULL UNION ALL SELECT project_id, least(arg_max(l, i) + 3600000, arg_max(f, i) + 36000000), arg_max(r, i) FROM w GROUP BY 1"""


@query("str_05_debounce_stream", DEBOUNCED)
def _(spark, sf):
    edits = _events(spark, sf).selectExpr("user_id AS project_id", "ms AS at_ms", "event_id AS revision")
    return drain(J.debounced_writes_stream(edits, 3_600_000, 36_000_000, LATENESS, WEEK_MS, wait=True), spark)


@query("str_06_revision_stream", """WITH RECURSIVE a AS (SELECT user_id AS project_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i, event_id, CASE WHEN event_id % 5 = 0 THEN NULL ELSE 'c' || ((event_id + 1) % 4) END AS base, 'C' || (event_id % 4) AS ck FROM events)
, w AS (SELECT project_id, i, event_id, base IS NULL AS ok, CASE WHEN base IS NULL THEN ck END AS head FROM a WHERE i = 1 UNION ALL SELECT a.project_id, a.i, a.event_id, a.base IS NULL OR coalesce(a.base = lower(w.head), false), CASE WHEN a.base IS NULL OR coalesce(a.base = lower(w.head), false) THEN a.ck ELSE w.head END
 FROM w JOIN a ON a.project_id = w.project_id AND a.i = w.i + 1) SELECT project_id, event_id AS attempt_no, ok AS accepted FROM w""")
def _(spark, sf):
    attempts = _rows(spark, sf).selectExpr("user_id AS project_id", "event_id AS attempt_no", "concat('C', event_id % 4) AS checksum", "IF(event_id % 5 = 0, NULL, concat('c', (event_id + 1) % 4)) AS base_checksum")
    return drain(J.accept_revisions_stream(attempts), spark)
