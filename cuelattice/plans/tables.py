"""Media-shaped tables derived from the given parquet tables, in Spark and as DuckDB CTEs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cuelattice.kernel.scan import TEXT_SHARE, Running, dealt, running


def _read(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def words(spark, sf):
    """One row per token of every document, whole texts. Texts are dealt by document before they become words."""
    tokens = dealt(_read(spark, sf, "documents").select("doc_id", "text"), ["doc_id"]).select(
        F.col("doc_id").alias("asset_id"), F.posexplode(F.split(F.trim("text"), "[ \\n\\t\\r]+")).alias("pos", "text")
    ).where("text <> ''")
    return tokens.selectExpr(
        "asset_id", "pos AS word_idx", "concat('w', pos) AS word_id", "text",
        "pos * 450L + (pos DIV 17) * 1200L AS start_ms",
        "pos * 450L + (pos DIV 17) * 1200L + 320 AS end_ms",
        "((asset_id * 31 + pos * 17) % 101) / 100.0D AS confidence",
        "concat('s', (pos DIV 23) % 3) AS speaker_id",
    )


def assets(spark, sf):
    """Duration from the token count, without exploding the texts."""
    last = F.size(F.split(F.regexp_replace(F.trim("text"), "[ \\n\\t\\r]+$", ""), "[ \\n\\t\\r]+")).cast("long") - 1
    counted = _read(spark, sf, "documents").select(F.col("doc_id").alias("asset_id"), last.alias("pos"))
    return dealt(counted.where("pos >= 0"), ["asset_id"]).groupBy("asset_id").agg(F.max("pos").alias("pos")).selectExpr(
        "asset_id", "pos * 450 + (pos DIV 17) * 1200 + 320 + 2000 AS duration_ms"
    )


def segments(spark, sf):
    return words(spark, sf).groupBy("asset_id", F.expr("word_idx DIV 17").alias("seg_idx")).agg(
        F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms"), F.max("confidence").alias("confidence")
    )


def audio_events(spark, sf):
    return dealt(_read(spark, sf, "documents").select("doc_id"), ["doc_id"]).selectExpr("doc_id AS asset_id", "explode(sequence(0L, 5L)) AS k").selectExpr(
        "asset_id", "k AS event_idx", "(asset_id * 7919 + k * 104729) % 180000 AS at_ms",
        "((asset_id * 13 + k * 29) % 101) / 100.0D AS score",
        "element_at(array('laughter','giggle','cheering','applause','energy'), CAST((asset_id + k) % 5 AS INT) + 1) AS kind",
    )


def retention(spark, sf):
    return dealt(_read(spark, sf, "documents").select("doc_id"), ["doc_id"]).selectExpr("doc_id AS asset_id", "explode(sequence(0L, 9L)) AS k").selectExpr(
        "asset_id", "k AS point_idx", "(asset_id * 977 + k * 15013) % 120000 AS at_ms",
        "((asset_id * 11 + k * 37) % 101) / 100.0D AS score",
    )


def doc_beats(spark, sf):
    return assets(spark, sf).selectExpr("asset_id", "explode(sequence(0L, duration_ms DIV 480)) AS k").selectExpr(
        "asset_id", "k AS beat_idx", "k * 480 + (asset_id * 7 + k * 13) % 90 AS at_ms",
        "((asset_id * 3 + k * 41) % 101) / 100.0D AS confidence", "k % 4 = 0 AS downbeat",
    )


def numbered_events(spark, sf):
    """Events with their position per user; numbered without gathering a user in one task."""
    ev = _read(spark, sf, "events")
    return running(
        ev, ["user_id"], ["ts", "event_id"], [Running("rn", "count", F.lit(1))], F.to_date("ts")
    )


def frames(spark, sf):
    return numbered_events(spark, sf).selectExpr(
        "user_id AS asset_id", "(rn - 1) * 32 AS at_ms", "rn * 32 AS end_ms",
        "(((rn DIV 7) * 37 + (event_id % 9) * 2) % 101) / 100.0D AS speech_probability",
        "value AS sum_squares", "512 AS sample_count", "(event_id % 100) / 100.0D AS peak",
    )


def loudness(spark, sf):
    return numbered_events(spark, sf).selectExpr(
        "user_id AS asset_id", "(rn - 1) * 100 AS at_ms",
        "-60 + (CAST(floor(value * 10) AS BIGINT) % 600) / 10.0D AS loudness_db",
    )


def beats(spark, sf):
    return numbered_events(spark, sf).selectExpr(
        "user_id AS asset_id", "event_id", "(rn - 1) * 480 + event_id % 90 AS source_ms",
        "(event_id * 41 % 101) / 100.0D AS confidence", "rn % 4 = 1 AS downbeat",
    )


def class_frames(spark, sf):
    """Classifier frames on a 480 ms hop."""
    return numbered_events(spark, sf).selectExpr(
        "user_id AS asset_id", "(rn - 1) * 480 AS t", "((event_id * 53 + rn * 7) % 101) / 100.0D AS s",
        "element_at(array('Laughter','Giggle','Snicker','Belly laugh'), CAST(event_id % 4 AS INT) + 1) AS l",
    )


def track_samples(spark, sf):
    return numbered_events(spark, sf).selectExpr(
        "user_id AS asset_id", "(rn - 1) * 100 AS time_ms", "0.3D + (event_id * 17 % 41) / 100.0D AS x",
        "0.3D + (event_id * 23 % 41) / 100.0D AS y", "0.2D AS width", "0.3D AS height",
        "(event_id * 37 % 101) / 100.0D AS confidence",
    )


def job_log(spark, sf):
    return numbered_events(spark, sf).selectExpr(
        "user_id AS job_id", "rn AS seq", "ts",
        "CASE rn % 4 WHEN 1 THEN concat('frame=', rn * 10) WHEN 2 THEN concat('out_time_us=', rn * 100000) "
        "WHEN 3 THEN concat('speed=', CAST((event_id % 30) / 10.0D AS STRING), 'x') ELSE 'progress=continue' END AS line",
    )


def tracks(spark, sf):
    return _read(spark, sf, "lineitem").selectExpr(
        "l_orderkey AS project_id", "l_linenumber % 3 AS track_idx", "concat('t', l_linenumber % 3) AS track_id",
        "element_at(array('video','audio','text'), l_linenumber % 3 + 1) AS type",
        "l_orderkey % 5 = 0 AS muted", "l_orderkey % 7 = 0 AS solo", "l_orderkey % 11 = 0 AS locked",
    ).distinct()


def clips(spark, sf):
    """Clips keyed by (project_id, clip_id); orders may repeat a line number, so lines are grouped.

    Lines are dealt by project first: what is derived from a project's clips is many times as much.
    """
    raw = _read(spark, sf, "lineitem").selectExpr(
        "l_orderkey AS project_id", "concat('c', l_linenumber) AS clip_id", "concat('t', l_linenumber % 3) AS track_id",
        "l_linenumber AS clip_idx", "(l_partkey * 7 % 60) * 1000 AS start_ms",
        "CAST(l_quantity AS BIGINT) * 200 AS duration_ms", "(l_suppkey % 10) * 500 AS trim_in_ms",
        "0.5D + (l_linenumber % 4) * 0.5D AS speed", "CAST(l_quantity AS BIGINT) * 350 AS source_duration_ms",
        "l_discount * 10 AS volume", "l_partkey", "l_suppkey",
    )
    best = F.min_by(
        F.struct("track_id", "clip_idx", "start_ms", "duration_ms", "trim_in_ms", "speed", "source_duration_ms", "volume"),
        F.struct("l_partkey", "l_suppkey", "duration_ms", "volume"),
    )
    return dealt(raw, ["project_id"], 8, meet=False).groupBy("project_id", "clip_id").agg(best.alias("c")).select("project_id", "clip_id", "c.*")


def cue_turns(spark, sf):
    spans = running(
        dealt(_read(spark, sf, "conversations"), ["conv_id"], TEXT_SHARE, meet=False), ["conv_id"], ["turn"],
        [Running("end_ms", "sum", F.length("text") * 60)], F.expr("turn DIV 1000"),
    )
    return spans.selectExpr(
        "conv_id AS doc_id", "turn AS cue_idx", "concat('cue-', turn) AS cue_id",
        "end_ms - length(text) * 60 AS start_ms", "end_ms", "text", "role AS speaker_id",
    )


def media_refs(spark, sf):
    return _read(spark, sf, "part").selectExpr(
        "p_partkey AS asset_id", "concat('/old/', p_partkey % 40, '.mp4') AS path",
        "CASE WHEN p_partkey % 3 > 0 THEN p_size END AS size_bytes",
        "CASE WHEN p_partkey % 4 = 0 THEN sha2(concat(p_size, ':', p_partkey % 20), 256) END AS quick_hash",
    )


def media_found(spark, sf):
    raw = _read(spark, sf, "part").selectExpr(
        "concat('/new/', p_partkey % 7, '/', p_partkey % 50, '.mp4') AS path",
        "concat(p_partkey % 50, '.mp4') AS file_name", "p_size AS size_bytes",
        "sha2(concat(p_size, ':', p_partkey % 20), 256) AS quick_hash",
    )
    return raw.groupBy("path", "file_name").agg(F.min(F.struct("size_bytes", "quick_hash")).alias("b")).select(
        "path", "file_name", "b.*"
    )


def cache_files(spark, sf):
    return _read(spark, sf, "orders").selectExpr(
        "concat(CASE WHEN o_orderkey % 9 = 0 THEN '.' ELSE '' END, o_orderkey, '.proxy', "
        "CASE WHEN o_orderkey % 9 = 0 THEN '.partial-1' ELSE '' END, '.mp4') AS path",
        "CAST(floor(o_totalprice) AS BIGINT) AS bytes", "o_orderdate AS modified", "o_orderkey % 9 = 0 AS partial",
    )


# DuckDB definitions of the same tables, for the oracle. Order matters: later ones use earlier ones.
CTE: dict[str, tuple[tuple[str, ...], str]] = {
    "words": ((), """
        SELECT asset_id, word_idx, 'w' || word_idx AS word_id, text,
               word_idx * 450 + (word_idx // 17) * 1200 AS start_ms,
               word_idx * 450 + (word_idx // 17) * 1200 + 320 AS end_ms,
               ((asset_id * 31 + word_idx * 17) % 101) / 100.0::DOUBLE AS confidence,
               's' || ((word_idx // 23) % 3) AS speaker_id
        FROM (SELECT doc_id AS asset_id, unnest(toks) AS text, unnest(range(0, len(toks)))::BIGINT AS word_idx
              FROM (SELECT doc_id, string_split_regex(trim(text), '[ \\n\\t\\r]+') AS toks FROM documents))
        WHERE text <> ''"""),
    "assets": (("words",), "SELECT asset_id, max(end_ms) + 2000 AS duration_ms FROM words GROUP BY 1"),
    "segments": (("words",), """
        SELECT asset_id, word_idx // 17 AS seg_idx, min(start_ms) AS start_ms, max(end_ms) AS end_ms,
               max(confidence) AS confidence FROM words GROUP BY 1, 2"""),
    "audio_events": ((), """
        SELECT doc_id AS asset_id, k AS event_idx, (doc_id * 7919 + k * 104729) % 180000 AS at_ms,
               ((doc_id * 13 + k * 29) % 101) / 100.0::DOUBLE AS score,
               ['laughter','giggle','cheering','applause','energy'][(doc_id + k) % 5 + 1] AS kind
        FROM documents, range(0, 6) r(k)"""),
    "retention": ((), """
        SELECT doc_id AS asset_id, k AS point_idx, (doc_id * 977 + k * 15013) % 120000 AS at_ms,
               ((doc_id * 11 + k * 37) % 101) / 100.0::DOUBLE AS score FROM documents, range(0, 10) r(k)"""),
    "doc_beats": (("assets",), """
        SELECT asset_id, k AS beat_idx, k * 480 + (asset_id * 7 + k * 13) % 90 AS at_ms,
               ((asset_id * 3 + k * 41) % 101) / 100.0::DOUBLE AS confidence, k % 4 = 0 AS downbeat
        FROM (SELECT asset_id, unnest(range(0, duration_ms // 480 + 1)) AS k FROM assets)"""),
    "ev": ((), "SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events"),
    "frames": (("ev",), """
        SELECT user_id AS asset_id, (rn - 1) * 32 AS at_ms, rn * 32 AS end_ms,
               (((rn // 7) * 37 + (event_id % 9) * 2) % 101) / 100.0::DOUBLE AS speech_probability,
               value AS sum_squares, 512 AS sample_count, (event_id % 100) / 100.0::DOUBLE AS peak FROM ev"""),
    "loudness": (("ev",), """
        SELECT user_id AS asset_id, (rn - 1) * 100 AS at_ms,
               -60 + (CAST(floor(value * 10) AS BIGINT) % 600) / 10.0::DOUBLE AS loudness_db FROM ev"""),
    "beats": (("ev",), """
        SELECT user_id AS asset_id, event_id, (rn - 1) * 480 + event_id % 90 AS source_ms,
               (event_id * 41 % 101) / 100.0::DOUBLE AS confidence, rn % 4 = 1 AS downbeat FROM ev"""),
    "class_frames": (("ev",), """
        SELECT user_id AS asset_id, (rn - 1) * 480 AS t, ((event_id * 53 + rn * 7) % 101) / 100.0::DOUBLE AS s,
               ['Laughter','Giggle','Snicker','Belly laugh'][event_id % 4 + 1] AS l FROM ev"""),
    "track_samples": (("ev",), """
        SELECT user_id AS asset_id, (rn - 1) * 100 AS time_ms, 0.3::DOUBLE + (event_id * 17 % 41) / 100.0::DOUBLE AS x,
               0.3::DOUBLE + (event_id * 23 % 41) / 100.0::DOUBLE AS y, 0.2::DOUBLE AS width, 0.3::DOUBLE AS height,
               (event_id * 37 % 101) / 100.0::DOUBLE AS confidence FROM ev"""),
    "job_log": (("ev",), """
        SELECT user_id AS job_id, rn AS seq, ts,
               CASE rn % 4 WHEN 1 THEN 'frame=' || (rn * 10) WHEN 2 THEN 'out_time_us=' || (rn * 100000)
                    WHEN 3 THEN 'speed=' || ((event_id % 30) / 10.0::DOUBLE) || 'x' ELSE 'progress=continue' END AS line FROM ev"""),
    "tracks": ((), """
        SELECT DISTINCT l_orderkey AS project_id, l_linenumber % 3 AS track_idx, 't' || (l_linenumber % 3) AS track_id,
               ['video','audio','text'][l_linenumber % 3 + 1] AS type, l_orderkey % 5 = 0 AS muted,
               l_orderkey % 7 = 0 AS solo, l_orderkey % 11 = 0 AS locked FROM lineitem"""),
    "clips": ((), """
        SELECT project_id, clip_id, track_id, clip_idx, start_ms, duration_ms, trim_in_ms, speed, source_duration_ms, volume
        FROM (SELECT l_orderkey AS project_id, 'c' || l_linenumber AS clip_id, 't' || (l_linenumber % 3) AS track_id,
                     l_linenumber AS clip_idx, (l_partkey * 7 % 60) * 1000 AS start_ms,
                     CAST(l_quantity AS BIGINT) * 200 AS duration_ms, (l_suppkey % 10) * 500 AS trim_in_ms,
                     0.5::DOUBLE + (l_linenumber % 4) * 0.5::DOUBLE AS speed,
                     CAST(l_quantity AS BIGINT) * 350 AS source_duration_ms, l_discount * 10 AS volume,
                     row_number() OVER (PARTITION BY l_orderkey, l_linenumber
                                        ORDER BY l_partkey, l_suppkey, l_quantity, l_discount) AS pick
              FROM lineitem) WHERE pick = 1"""),
    "cue_turns": ((), """
        SELECT conv_id AS doc_id, turn AS cue_idx, 'cue-' || turn AS cue_id,
               sum(length(text) * 60) OVER (PARTITION BY conv_id ORDER BY turn) - length(text) * 60 AS start_ms,
               sum(length(text) * 60) OVER (PARTITION BY conv_id ORDER BY turn) AS end_ms, text, role AS speaker_id
        FROM conversations"""),
    "media_refs": ((), """
        SELECT p_partkey AS asset_id, '/old/' || (p_partkey % 40) || '.mp4' AS path,
               CASE WHEN p_partkey % 3 > 0 THEN p_size END AS size_bytes,
               CASE WHEN p_partkey % 4 = 0 THEN sha256(p_size || ':' || (p_partkey % 20)) END AS quick_hash FROM part"""),
    "media_found": ((), """
        SELECT path, file_name, size_bytes, quick_hash FROM (
          SELECT *, row_number() OVER (PARTITION BY path ORDER BY size_bytes, quick_hash) AS pick FROM (
            SELECT '/new/' || (p_partkey % 7) || '/' || (p_partkey % 50) || '.mp4' AS path,
                   (p_partkey % 50) || '.mp4' AS file_name, p_size AS size_bytes,
                   sha256(p_size || ':' || (p_partkey % 20)) AS quick_hash FROM part)) WHERE pick = 1"""),
    "cache_files": ((), """
        SELECT (CASE WHEN o_orderkey % 9 = 0 THEN '.' ELSE '' END) || o_orderkey || '.proxy' ||
               (CASE WHEN o_orderkey % 9 = 0 THEN '.partial-1' ELSE '' END) || '.mp4' AS path,
               CAST(floor(o_totalprice) AS BIGINT) AS bytes, o_orderdate AS modified, o_orderkey % 9 = 0 AS partial FROM orders"""),
}


def with_tables(names: str, body: str, recursive: bool = False) -> str:
    """Prefix a DuckDB query with the CTEs it needs. ``body`` may start with its own ``name AS (...),`` list
    ended by a final SELECT; write it as ``, x AS (...) SELECT ...`` or just ``SELECT ...``."""
    chosen: list[str] = []

    def add(name: str) -> None:
        for dependency in CTE[name][0]:
            add(dependency)
        if name not in chosen:
            chosen.append(name)

    for name in names.split():
        add(name)
    ctes = ",\n".join(f"{n} AS ({CTE[n][1]})" for n in chosen)
    return f"WITH {'RECURSIVE ' if recursive else ''}{ctes}\n{body}"
