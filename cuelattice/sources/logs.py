"""Tool logs and tool JSON as tables: loudness lines, measurements, probe fields, recogniser, classifier and tracker output."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cuelattice.kernel.scan import Running, running

# Fixed values of the classifier and tracker contracts.
CLASS_LABELS = (
    "Laughter", "Baby laughter", "Giggle", "Snicker", "Belly laugh", "Chuckle, chortle",
)
CLASS_RATE, CLASS_WINDOW_MS = 16_000, 960
RECOGNISER_SCHEMA = (
    "result struct<language: string>, transcription array<struct<offsets: struct<`from`: bigint, `to`: bigint>, text: string, "
    "tokens: array<struct<text: string, offsets: struct<`from`: bigint, `to`: bigint>, p: double>>>>"
)
CLASS_SCHEMA = "schema string, sample_rate int, window_ms int, hop_ms int, duration_ms bigint, frames array<struct<t: bigint, s: double, l: string>>"
TRACK_SCHEMA = (
    "key string, width int, height int, fps double, samples array<struct<time_ms: bigint, confidence: double, "
    "bbox: struct<x: double, y: double, width: double, height: double>>>"
)


def loudness_points(lines: DataFrame, durations: DataFrame) -> DataFrame:
    """Momentary loudness lines to ``(asset_id, line_no, at_ms, loudness_db)``."""
    number = "([-+]?(?:\\d+\\.?\\d*|\\.\\d+)(?:[eE][-+]?\\d+)?)(?:\\s|$)"
    found = lines.where(F.col("line").contains("ebur128") & F.col("line").contains(" M:")).select(
        "asset_id", "line_no", F.regexp_extract("line", " t:\\s*" + number, 1).try_cast("double").alias("t"),
        F.regexp_extract("line", " M:\\s*" + number, 1).try_cast("double").alias("m"),
    ).where("t IS NOT NULL AND m IS NOT NULL AND t >= 0")
    return found.join(durations, "asset_id").selectExpr(
        "asset_id", "line_no", "CAST(round(t * 1000) AS BIGINT) AS at_ms", "round(m * 10) / 10 AS loudness_db", "duration_ms"
    ).where("at_ms <= duration_ms + 250").selectExpr("asset_id", "line_no", "least(at_ms, duration_ms) AS at_ms", "loudness_db")


MEASURED = ("input_i", "input_tp", "input_lra", "input_thresh", "target_offset")


def loudness_measurement(logs: DataFrame) -> DataFrame:
    """Last complete JSON object with all measured keys; values may be numbers or strings and must be finite."""
    objects = F.regexp_extract_all("log", F.lit("(\\{[^{}]*\\})"), 1)
    has = " AND ".join(f"get_json_object(o, '$.{k}') IS NOT NULL" for k in MEASURED)
    found = logs.withColumn("__all", objects).withColumn("o", F.expr(f"try_element_at(filter(__all, o -> {has}), -1)"))
    values = {k: F.expr(f"try_cast(trim(get_json_object(o, '$.{k}')) AS DOUBLE)") for k in MEASURED}
    out = found.withColumns(values)
    bad = " OR ".join(f"isnan({k}) OR abs({k}) = double('infinity')" for k in MEASURED)
    absent = " OR ".join(f"{k} IS NULL" for k in MEASURED)
    return out.withColumn("error", F.expr(f"CASE WHEN o IS NULL OR {absent} THEN 'parse-failed' WHEN {bad} THEN 'unmeasurable' END")).drop("__all", "o", "log")


def probe_fields(logs: DataFrame) -> DataFrame:
    """Media duration and audio flag of a probe log."""
    clock = "Duration: (\\d+):(\\d+):(\\d+(?:\\.\\d+)?)\\s*(?:,|\\n|$)"
    part = lambda i: F.nullif(F.regexp_extract("log", clock, i), F.lit(""))
    ms = part(1).cast("long") * 3_600_000 + part(2).cast("long") * 60_000 + F.round(part(3).cast("double") * 1000).cast("long")
    return logs.withColumns({"duration_ms": ms, "has_audio": F.col("log").rlike("(?m)^.*Stream #.* Audio:.*$")}).drop("log")


def recogniser_tokens(docs: DataFrame, language: str = "auto") -> DataFrame:
    """Recogniser JSON to token rows; a wrong language turns into an error row."""
    parsed = docs.select("asset_id", F.from_json("json", RECOGNISER_SCHEMA).alias("j"))
    got = F.coalesce(F.nullif("j.result.language", F.lit("")), F.lit(language))
    wrong = F.lit(False) if language == "auto" else ~got.isin(language, {"tr": "turkish"}.get(language, language))
    checked = parsed.withColumn("error", F.when(F.col("j").isNull() | F.col("j.transcription").isNull(), "invalid-json").when(wrong, "language-mismatch"))
    segments = checked.where("error IS NULL").select("asset_id", F.posexplode("j.transcription").alias("segment_idx", "s"))
    return segments.select("asset_id", "segment_idx", "s.offsets", F.posexplode("s.tokens").alias("token_idx", "t")).selectExpr(
        "asset_id", "CAST(segment_idx AS BIGINT) AS segment_idx", "CAST(token_idx AS BIGINT) AS token_idx", "t.text AS raw", "t.offsets.`from` AS from_ms", "t.offsets.`to` AS to_ms",
        "t.p AS p", "offsets.`from` AS segment_from", "offsets.`to` AS segment_to",
    )


def classifier_frames(docs: DataFrame, schema_name: str) -> tuple[DataFrame, DataFrame]:
    """Accepted frames and one verdict per file; a single broken frame rejects its file."""
    parsed = docs.select("asset_id", F.from_json("json", CLASS_SCHEMA).alias("j")).select("asset_id", "j.*")
    labels = ", ".join(f"'{label}'" for label in CLASS_LABELS)
    rising = "forall(sequence(1, greatest(size(frames) - 1, 1)), i -> i >= size(frames) OR frames[i].t > frames[i - 1].t)"
    each = f"forall(frames, f -> coalesce(f.t < duration_ms AND NOT isnan(f.s) AND f.s BETWEEN 0 AND 1 AND f.l IN ({labels}), false))"
    ok = (
        f"schema = '{schema_name}' AND sample_rate = {CLASS_RATE} AND window_ms = {CLASS_WINDOW_MS} AND hop_ms BETWEEN 300 AND 1200 AND duration_ms > 0 "
        f"AND size(frames) BETWEEN 1 AND duration_ms DIV 250 + 32 AND {rising} AND {each}"
    )
    judged = parsed.withColumn("accepted", F.expr(f"coalesce({ok}, false)"))
    frames = judged.where("accepted").select("asset_id", "duration_ms", F.explode("frames").alias("f")).select("asset_id", "duration_ms", "f.t", "f.s", "f.l")
    return frames, judged.select("asset_id", "accepted")


def tracker_samples(docs: DataFrame, max_samples: int = 300_000) -> tuple[DataFrame, DataFrame]:
    """Tracker JSON to samples (box in 0..1, centre form) and one verdict per file; ``docs`` carries the expected ``key``."""
    parsed = docs.select("asset_id", F.col("key").alias("want"), F.from_json("json", TRACK_SCHEMA).alias("j")).select("asset_id", "want", "j.*")
    box = "s.bbox.x >= 0 AND s.bbox.y >= 0 AND s.bbox.width > 0 AND s.bbox.height > 0 AND s.bbox.x + s.bbox.width <= 1 + 1e-6 AND s.bbox.y + s.bbox.height <= 1 + 1e-6"
    each = f"forall(samples, s -> coalesce(s.time_ms >= 0 AND s.confidence BETWEEN 0 AND 1 AND {box}, false))"
    ok = f"key = want AND width > 0 AND height > 0 AND fps > 0 AND size(samples) BETWEEN 1 AND {max_samples} AND {each}"
    judged = parsed.withColumn("accepted", F.expr(f"coalesce({ok}, false)"))
    rows = judged.where("accepted").select("asset_id", F.posexplode("samples").alias("sample_idx", "s")).selectExpr(
        "asset_id", "sample_idx", "s.time_ms", "s.bbox.x + s.bbox.width / 2 AS x", "s.bbox.y + s.bbox.height / 2 AS y", "s.bbox.width", "s.bbox.height", "s.confidence")
    best = F.max_by(F.struct("x", "y", "width", "height", "confidence"), F.struct(F.col("confidence"), -F.col("sample_idx")))
    return rows.groupBy("asset_id", "time_ms").agg(best.alias("b")).select("asset_id", "time_ms", "b.*"), judged.select("asset_id", "accepted")


def error_class(text: Column) -> tuple[Column, Column]:
    """Failure code and whether a retry can help, from tool output."""
    low = F.lower(text)
    rules = (
        ("disk_full", "no space left on device", True), ("permission_denied", "permission denied|access is denied", True),
        ("missing_media", "no such file or directory|could not find file", True),
        ("unsupported_media", "invalid data found|moov atom not found|unsupported codec", False),
        ("encoder_unavailable", "unknown encoder|encoder not found", False), ("filter_failed", "error initializing filter|no such filter", False),
    )
    code = retry = None
    for name, pattern, again in rules:
        hit = low.rlike(pattern)
        code = F.when(hit, name) if code is None else code.when(hit, name)
        retry = F.when(hit, F.lit(again)) if retry is None else retry.when(hit, F.lit(again))
    return code.otherwise("ffmpeg_failed"), retry.otherwise(F.lit(True))


def job_progress(lines: DataFrame, durations: DataFrame) -> DataFrame:
    """Progress snapshots of key=value logs, one per ``progress=`` line, with the values in force there."""
    split = lines.where("instr(trim(line), '=') > 0").selectExpr(
        "job_id", "seq", "substring_index(trim(line), '=', 1) AS key", "substring(trim(line), instr(trim(line), '=') + 1) AS value")
    positive = "IF(try_cast({0} AS DOUBLE) >= 0 AND NOT isnan(try_cast({0} AS DOUBLE)) AND try_cast({0} AS DOUBLE) < double('infinity'), try_cast({0} AS DOUBLE), NULL)"
    # Parsed values sit in structs so that an unreadable value replaces the older one with nothing.
    tagged = split.selectExpr(
        "*", "IF(key = 'frame', struct(try_cast(value AS BIGINT) AS v), NULL) AS k_frame", f"IF(key = 'fps', struct({positive.format('trim(value)')} AS v), NULL) AS k_fps",
        "IF(key = 'speed', struct(" + positive.format("trim(TRAILING 'x' FROM value)") + " AS v), NULL) AS k_speed",
        "IF(key = 'out_time_us', struct(coalesce(try_cast(value AS BIGINT), 0) DIV 1000 AS v), NULL) AS k_us",
        "IF(key = 'out_time_ms', struct(coalesce(try_cast(value AS BIGINT), 0) DIV 1000 AS v), NULL) AS k_ms",
    )
    state = running(
        tagged, ["job_id"], ["seq"], [Running(f"s_{k}", "last", F.col(f"k_{k}")) for k in ("frame", "fps", "speed", "us", "ms")], F.expr("seq DIV 100000"))
    done = state.where("key = 'progress' AND value IN ('continue', 'end')").join(durations, "job_id")
    encoded = "least(coalesce(s_us.v, s_ms.v, 0L), duration_ms)"
    return done.selectExpr(
        "job_id", "seq", f"{encoded} AS encoded_ms", f"IF(duration_ms = 0, 0.0D, least(99.9D, {encoded} / duration_ms * 100)) AS percent", "s_frame.v AS frame",
        "s_fps.v AS fps", "s_speed.v AS speed", f"IF(s_speed.v > 0, CAST(round((duration_ms - {encoded}) / s_speed.v) AS BIGINT), NULL) AS eta_ms", "value = 'end' AS finished")
