"""Media library, stored documents, caches and jobs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cuelattice.functions.scalars import field_hash
from cuelattice.kernel.fold import CHUNK_ROWS, Effect, ordered_fold
from cuelattice.kernel.scan import Running, running

# Media kinds by file extension.
VIDEO = ("mp4", "mov", "m4v", "mkv", "avi", "webm", "mxf", "ts", "mts", "m2ts", "wmv", "flv", "ogv")
AUDIO = ("wav", "mp3", "m4a", "aac", "flac", "ogg", "opus", "aiff", "aif", "wma")
IMAGE = ("png", "jpg", "jpeg", "webp", "gif", "bmp", "tif", "tiff", "avif", "heic", "heif", "svg")
SAMPLE_BYTES = 64 * 1024
MAX_SCAN_FILES, DEFAULT_DEPTH, MAX_DEPTH = 100_000, 8, 32


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, "\\.([^./\\\\]+)$", 1))


def media_kind(path: Column) -> Column:
    ext = extension(path)
    return F.when(ext.isin(*VIDEO), "video").when(ext.isin(*AUDIO), "audio").when(ext.isin(*IMAGE), "image")


def path_key(path: Column) -> Column:
    """Comparable path: forward slashes, case-folded for drive and network paths."""
    slashed = F.replace(path, F.lit("\\"), F.lit("/"))
    return F.when(slashed.rlike("(?i)^[a-z]:/") | slashed.startswith("//"), F.lower(slashed)).otherwise(slashed)


def file_name(path: Column) -> Column:
    return F.substring_index(F.replace(path, F.lit("\\"), F.lit("/")), "/", -1)


def list_files(spark: SparkSession, path: str) -> DataFrame:
    """Files under a root without their content."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return found.select("path", F.col("length").alias("size_bytes"), F.unix_millis("modificationTime").alias("modified_at_ms"))


def inspect_media(requested: DataFrame, listing: DataFrame) -> DataFrame:
    """Requested paths against a file listing: existence, kind, size and error; repeated paths once."""
    asked = requested.select(F.trim("path").alias("path")).withColumn("__key", path_key(F.col("path")))
    unique = asked.groupBy("__key").agg(F.min("path").alias("path"))
    known = listing.withColumn("__key", path_key(F.col("path"))).drop("path")
    joined = unique.join(known, "__key", "left").withColumn("kind", media_kind(F.col("path")))
    error = F.when(F.col("size_bytes").isNull(), "missing").when(F.col("kind").isNull(), "unsupported")
    return joined.select("path", file_name(F.col("path")).alias("file_name"), "kind", F.col("size_bytes").isNotNull().alias("exists"), "size_bytes", error.alias("error"))


def quick_hash_of(head: Column, tail: Column, size: Column) -> Column:
    """SHA-256 over a head, a tail (null if the head is all) and the little-endian size."""
    digits = F.lpad(F.hex(size), 16, "0")
    little = F.unhex(F.concat(*[F.substring(digits, i, 2) for i in range(15, 0, -2)]))
    return F.concat(F.lit("sha256:"), F.sha2(F.concat(head, F.coalesce(tail, F.lit(b"")), little), 256))


def quick_hash(content: Column, size: Column | None = None) -> Column:
    """Quick hash of a column with whole contents: the first and last 64 KiB and the size.

    Files too large for a column are read by ``sources.media_ranges``.
    """
    size = F.octet_length(content).cast("long") if size is None else size
    tail = F.when(size > SAMPLE_BYTES, F.substring(content, -SAMPLE_BYTES, SAMPLE_BYTES))
    return quick_hash_of(F.substring(content, 1, SAMPLE_BYTES), tail, size)


def search_candidates(listing: DataFrame, root: str, max_depth: int = DEFAULT_DEPTH, limit: int | None = None) -> DataFrame:
    """Media files below a root down to a depth (a desktop scan allows ``MAX_DEPTH`` at most).

    With a ``limit`` (a desktop scan stops at ``MAX_SCAN_FILES``) the first files in path order stay and
    ``truncated`` tells whether others were left out; without one all stay and nothing is sorted.
    """
    depth = F.size(F.split(F.ltrim(F.substring("path", len(root) + 1, 1_000_000), F.lit("/")), "/"))
    media = listing.where(F.col("path").startswith(root)).where(media_kind(F.col("path")).isNotNull()).withColumn("depth", depth).where(
        F.col("depth") <= max_depth)
    if limit is None:
        return media.withColumn("truncated", F.lit(False))
    total = media.agg(F.count(F.lit(1)).alias("__n"))
    return media.orderBy("path").limit(limit).join(F.broadcast(total)).withColumn("truncated", F.col("__n") > limit).drop("__n")


def relink(missing: DataFrame, found: DataFrame) -> DataFrame:
    """Tiered linkage of missing references to found files: name, then size, then content hash.

    Candidates come from two equi-joins (name, size); a known size or hash that differs rejects.
    ``found`` carries a hash column or is given one only for the survivors of the joins.
    """
    refs = missing.withColumn("name_key", F.lower(file_name(F.col("path"))))
    files = found.select(F.col("path").alias("found_path"), F.lower("file_name").alias("found_name"), F.col("size_bytes").alias("found_size"), F.col("quick_hash").alias("found_hash"))
    by_name = refs.join(files, F.col("name_key") == F.col("found_name"))
    by_size = refs.where("quick_hash IS NOT NULL AND size_bytes IS NOT NULL").join(
        files, (F.col("size_bytes") == F.col("found_size")) & (F.col("name_key") != F.col("found_name")))
    pairs = by_name.unionByName(by_size).where("size_bytes IS NULL OR size_bytes = found_size").where(
        "quick_hash IS NULL OR lower(trim(quick_hash)) = lower(trim(found_hash))")
    ranked = pairs.withColumn("confidence", F.expr("IF(quick_hash IS NOT NULL, 100, IF(size_bytes IS NOT NULL, 80, 60))"))
    tops = ranked.groupBy("asset_id").agg(F.max(F.struct("confidence")).alias("top"), F.count(F.lit(1)).alias("n_best"), F.min("found_path").alias("first_path"))
    # All candidates of one reference share its known fields, hence one confidence.
    outcome = refs.select("asset_id", "path").join(tops, "asset_id", "left")
    return outcome.selectExpr(
        "asset_id", "path", "CASE WHEN n_best IS NULL THEN 'unresolved' WHEN n_best = 1 THEN 'resolved' ELSE 'ambiguous' END AS outcome",
        "IF(n_best = 1, first_path, NULL) AS replacement_path", "top.confidence AS confidence", "coalesce(n_best, 0L) AS n_candidates")


def apply_relink(rows: DataFrame, resolved: DataFrame, column: str) -> DataFrame:
    """Replace a path column by its relinked path."""
    table = resolved.where("replacement_path IS NOT NULL").groupBy(path_key(F.col("path")).alias("__key")).agg(F.max("replacement_path").alias("__new"))
    return rows.withColumn("__key", path_key(F.col(column))).join(table, "__key", "left").withColumn(column, F.coalesce("__new", column)).drop("__key", "__new")


def missing_media(refs: DataFrame, listing: DataFrame) -> DataFrame:
    known = listing.select(path_key(F.col("path")).alias("__key")).distinct()
    return refs.withColumn("__key", path_key(F.col("path"))).join(known, "__key", "left_anti").drop("__key")


def import_media(inspections: DataFrame, existing: DataFrame) -> tuple[DataFrame, DataFrame]:
    """New assets and rejected inspections."""
    good = "error IS NULL AND kind IS NOT NULL AND size_bytes IS NOT NULL"
    known = existing.select(path_key(F.col("path")).alias("__key")).distinct()
    fresh = inspections.where(good).withColumn("__key", path_key(F.col("path"))).join(known, "__key", "left_anti").dropDuplicates(["__key"])
    return fresh.withColumn("asset_id", field_hash(F.lit("asset-v1"), F.col("__key"))).drop("__key"), inspections.where(f"NOT coalesce({good}, false)")


def analysis_key(schema: str, model: str, *fields: Column) -> Column:
    return field_hash(F.lit(schema), F.lit(model), *fields)


def reuse_cached(requests: DataFrame, cache: DataFrame, key: str = "cache_key") -> tuple[DataFrame, DataFrame]:
    """Requests answered by a valid cached result, and the work that is left."""
    valid = cache.where("valid").dropDuplicates([key])
    hits = requests.join(valid.drop("valid"), key)
    return hits, requests.join(valid.select(key), key, "left_anti")


def sync_library(media: DataFrame, paths: DataFrame, inspections: DataFrame) -> DataFrame:
    """Project media still used by the timeline plus newly imported files."""
    used = paths.select(path_key(F.col("path")).alias("__key")).distinct()
    kept = media.withColumn("__key", path_key(F.col("path"))).join(used, "__key", "left_semi").drop("__key")
    wanted = inspections.withColumn("__key", path_key(F.col("path"))).join(used, "__key", "left_semi").drop("__key")
    fresh, _ = import_media(wanted, kept)
    return kept.select("path", F.lit("kept").alias("origin")).unionByName(fresh.select("path", F.lit("imported").alias("origin")))


def cache_stats(files: DataFrame, keys: list[str]) -> DataFrame:
    """Complete and partial counts and bytes of recognised cache files."""
    name = file_name(F.col("path"))
    partial = name.startswith(".") & name.contains(".proxy.partial-") & name.endswith(".mp4")
    known = files.withColumn("__partial", partial).where(F.col("__partial") | name.endswith(".proxy.mp4"))
    return known.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("file_count"), F.sum(F.col("__partial").cast("long")).alias("partial_count"), F.sum("bytes").alias("total_bytes"))


def prune_plan(files: DataFrame, max_bytes: int, active: DataFrame, key: str = "cache_id") -> DataFrame:
    """Files to remove: every partial one, and the oldest while the cache is above its budget; files in use stay."""
    totals = files.groupBy(key).agg(F.sum("bytes").alias("__total"))
    free = files.join(active, [key, "path"], "left_anti")
    before = running(free, [key], ["modified", "path"], [Running("__before", "sum", F.col("bytes"), inclusive=False)], F.to_date("modified"))
    return before.join(totals, key).where(f"partial OR __total - coalesce(__before, 0) > {max_bytes}").drop("__before", "__total")


def recovery_listing(snapshots: DataFrame) -> DataFrame:
    """Invalid snapshots, snapshots of saved projects, and only the newest valid one without a path."""
    loose = "is_valid AND original_path IS NULL"
    newest = snapshots.where(loose).agg(F.max_by("snapshot_id", F.struct("updated_at_ms", "snapshot_id")).alias("__latest"))
    marked = snapshots.join(F.broadcast(newest))
    return marked.where(f"NOT ({loose}) OR snapshot_id = __latest").drop("__latest")


def latest_jobs(snapshots: DataFrame) -> DataFrame:
    rest = [c for c in snapshots.columns if c not in ("job_id",)]
    return snapshots.groupBy("job_id").agg(F.max_by(F.struct(*rest), "seq").alias("s")).select("job_id", "s.*")


def decode_documents(rows: DataFrame, file_format: str, version: int = 1) -> DataFrame:
    """Stored documents ``(project_id, revision, body)`` to document, kind and error.

    The checksum covers the canonical text of the document as it was stored.
    """
    j = lambda path: F.get_json_object("body", path)
    enveloped = F.coalesce(j("$.fileFormat") == file_format, F.lit(False))
    document = F.when(enveloped, j("$.document")).otherwise(F.col("body"))
    checksum = F.concat(F.lit("sha256:"), F.sha2(document, 256))
    error = (
        F.when(F.expr("try_parse_json(body) IS NULL"), "project_parse_failed")
        .when(enveloped & (j("$.formatVersion").cast("int") > version), "project_version_unsupported")
        .when(enveloped & ~(F.lower(F.trim(j("$.checksum"))) == checksum), "project_integrity_failed")
        .when(~document.startswith("{"), "invalid_project_document")
    )
    return rows.withColumns({
        "document": document, "kind": F.when(enveloped, j("$.kind")).otherwise("legacy"), "checksum": checksum, "error": error,
    })


def newest_valid(versions: DataFrame) -> DataFrame:
    """Primary copy when it is sound, else the backup; a newer-format primary is never replaced."""
    best = F.expr("min_by(struct(slot, document, error), struct(error IS NOT NULL, slot <> 'primary'))")
    primary = F.max(F.expr("IF(slot = 'primary', error, NULL)")).alias("primary_error")
    picked = versions.groupBy("project_id").agg(best.alias("b"), primary)
    stuck = "primary_error IS NOT NULL AND (primary_error = 'project_version_unsupported' OR b.error IS NOT NULL)"
    return picked.selectExpr("project_id", f"IF({stuck}, primary_error, NULL) AS error", f"IF({stuck}, NULL, b.document) AS document", f"NOT ({stuck}) AND b.slot <> 'primary' AS recovered")


def accept_revisions(attempts: DataFrame) -> DataFrame:
    """Serial optimistic saves: an attempt lands only when its base is the current head (or it names none)."""

    def step(state, row):
        order, base, checksum = row
        head = None if state is None else state[0]
        ok = base is None or (head is not None and base.strip().lower() == head.strip().lower())
        return [checksum if ok else head], [(order, ok)]

    fields = [T.StructField("attempt_no", T.LongType()), T.StructField("accepted", T.BooleanType())]
    return ordered_fold(attempts, ["project_id"], ["attempt_no"], ["attempt_no", "base_checksum", "checksum"], step, fields, chunk=F.expr("attempt_no DIV 100000"))


def debounce_writes(edits: DataFrame, delay_ms: int = 1_500, max_wait_ms: int = 15_000) -> DataFrame:
    """Write times of a debounced autosave: after a quiet delay, at the latest after the maximum wait.

    A quiet gap longer than the delay ends a burst, so bursts fold on their own.
    """
    order = ["at_ms", "revision"]
    seen = running(edits, ["project_id"], order, [Running("__p", "last", F.col("at_ms"), inclusive=False)], F.expr("at_ms DIV 3600000"))
    opened = seen.withColumn("__open", F.expr(f"IF(__p IS NULL OR at_ms - __p >= {delay_ms}, at_ms, NULL)"))
    bursts = running(opened, ["project_id"], order, [Running("burst", "last", F.col("__open"))], F.expr("at_ms DIV 3600000"))

    def step(state, row):
        at, revision = row
        if state is None:
            return [at, at, revision], []
        first, last, pending = state
        due = min(last + delay_ms, first + max_wait_ms)
        return ([at, at, revision], [(due, pending)]) if at >= due else ([first, at, revision], [])

    fields = [T.StructField("written_at_ms", T.LongType()), T.StructField("revision", T.LongType())]
    return ordered_fold(
        bursts, ["project_id", "burst"], order, ["at_ms", "revision"], step, fields,
        finish=lambda s: [] if s is None else [(min(s[1] + delay_ms, s[0] + max_wait_ms), s[2])]).drop("burst")


# Stage baselines as (constant, per source ms, low, high) and the bounds of the learned ratio.
STAGES = {"speech": (6_000, 0.12, 9_000, 900_000), "analysis": (14_000, 0.55, 22_000, 3_600_000), "planning": (2_500, 0, 2_500, 2_500), "ranking": (12_000, 0, 12_000, 12_000), "finalizing": (1_800, 0, 1_800, 1_800)}
RATIO_LOW, RATIO_HIGH, KEEP, LEARN = 0.35, 4.0, 0.72, 0.28


def stage_baseline(stage: str = "stage", source_ms: str = "source_ms") -> str:
    cases = " ".join(f"WHEN '{s}' THEN least({hi}.0D, greatest({lo}.0D, {base} + {source_ms} * {rate}D))" for s, (base, rate, lo, hi) in STAGES.items())
    return f"CASE {stage} {cases} END"


def learned_ratios(runs: DataFrame, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Smoothed observed/expected ratio per profile and stage over its run history.

    A step is a line clamped at both ends, and so is any run of steps: (slope, shift, least, most) is the effect of a run.
    """
    ready = runs.withColumn("observed", F.expr(f"least({RATIO_HIGH}D, greatest({RATIO_LOW}D, greatest(250, elapsed_ms) / ({stage_baseline()})))"))

    def step(state, row):
        ratio = 1.0 if state is None else state[0]
        return [min(RATIO_HIGH, max(RATIO_LOW, ratio * KEEP + row[0] * LEARN))], []

    def absorb(line, row):
        slope, shift, least, most = line
        least, most = (min(RATIO_HIGH, max(RATIO_LOW, bound * KEEP + row[0] * LEARN)) for bound in (least, most))
        return [slope * KEEP, shift * KEEP + row[0] * LEARN, least, most]

    def apply(line, state):
        slope, shift, least, most = line
        return [min(most, max(least, slope * (1.0 if state is None else state[0]) + shift))]

    # Every ratio lies between the limits, the first one (1.0) too.
    runs_of = Effect([1.0, 0.0, RATIO_LOW, RATIO_HIGH], absorb, apply)
    return ordered_fold(
        ready, ["profile_id", "stage"], ["run_no"], ["observed"], step, [T.StructField("ratio", T.DoubleType())],
        finish=lambda s: [] if s is None else [(s[0],)], chunk=F.expr("run_no DIV 100000"), chunk_rows=chunk_rows, effect=runs_of)


def expected_stage_ms(requests: DataFrame, ratios: DataFrame) -> DataFrame:
    """Expected time of each stage of a request under the learned profile."""
    stages = F.explode(F.array(*[F.lit(s) for s in STAGES])).alias("stage")
    return requests.select("*", stages).join(ratios, ["profile_id", "stage"], "left").withColumn("expected_ms", F.expr(f"({stage_baseline()}) * coalesce(ratio, 1.0D)")).drop("ratio")


def asset_checks(assets: DataFrame) -> DataFrame:
    ok = (
        "asset_id IS NOT NULL AND asset_id <> '' AND path IS NOT NULL AND path <> '' AND file_name IS NOT NULL AND kind IN ('video', 'image', 'audio') "
        "AND size_bytes IS NOT NULL AND size_bytes >= 0 AND quick_hash IS NOT NULL AND availability IN ('online', 'missing')"
    )
    return assets.withColumn("valid", F.expr(f"coalesce({ok}, false)"))


# Automation limits by kind, and loudness ranges.
MAX_POINTS, MAX_RENDER_MS = 20_000, 24 * 3_600_000
GAIN_CAP = {"volume": 4.0, "riderGain": 4.0, "duckGain": 1.0}
EASINGS = ("linear", "hold", "ease-in", "ease-out", "ease-in-out")
LOUDNESS_RANGE = {
    "integrated_lufs": (-70, -5), "true_peak_db": (-9, 0), "loudness_range": (1, 50), "measured_integrated_lufs": (-99, 0),
    "measured_true_peak_db": (-99, 99), "measured_loudness_range": (0, 99), "measured_threshold_lufs": (-99, 0), "target_offset_db": (-99, 99),
}


def automation_issues(points: DataFrame) -> DataFrame:
    """First problem per clip and kind: too many points, or a point out of range."""
    cap = " ".join(f"WHEN '{k}' THEN {v}" for k, v in GAIN_CAP.items())
    bad = f"time_ms > {MAX_RENDER_MS} OR value IS NULL OR isnan(value) OR value < 0 OR value > (CASE kind {cap} END) OR easing NOT IN ({', '.join(repr(e) for e in EASINGS)})"
    return points.groupBy("project_id", "clip_id", "kind").agg(F.count(F.lit(1)).alias("n"), F.max(F.expr(f"coalesce({bad}, true)")).alias("bad")).selectExpr(
        "project_id", "clip_id", "kind", f"CASE WHEN n > {MAX_POINTS} THEN 'too-many-points' WHEN bad THEN 'invalid-point' END AS code").where("code IS NOT NULL")


def loudness_pass_issues(passes: DataFrame) -> DataFrame:
    tests = [f"IF({c} IS NULL OR isnan({c}) OR {c} NOT BETWEEN {lo} AND {hi}, '{c}', NULL)" for c, (lo, hi) in LOUDNESS_RANGE.items() if c in passes.columns]
    return passes.withColumn("field", F.expr(f"explode(array_compact(array({', '.join(tests)})))"))


def normalize_ducking(settings: DataFrame) -> DataFrame:
    """Bounded ducking settings with distinct, trimmed source tracks."""
    safe = lambda c, d: f"IF({c} IS NULL OR isnan({c}) OR abs({c}) = double('infinity'), {d}, {c})"
    bounds = {"reduction_db": (-14, -30, 0, False), "lookahead_ms": (80, 0, 500, True), "attack_ms": (100, 10, 1000, True), "hold_ms": (160, 0, 1000, True), "release_ms": (650, 50, 3000, True), "min_confidence": (0.5, 0.2, 0.95, False)}
    columns = {}
    for name, (default, low, high, whole) in bounds.items():
        value = f"least({high}D, greatest({low}D, {safe(name, f'{default}D')}))"
        columns[name] = F.expr(f"CAST(floor({value} + 0.5D) AS BIGINT)" if whole else value)
    columns["source_tracks"] = F.expr("array_distinct(filter(transform(coalesce(source_tracks, array()), t -> trim(t)), t -> t <> ''))")
    columns["enabled"] = F.expr("coalesce(enabled, true)")
    return settings.withColumns(columns)


def clip_signature(*fields: Column) -> Column:
    """Deterministic signature of everything that makes an analysis stale."""
    return F.to_json(F.array(F.lit("clip-analysis-v1"), *[F.coalesce(f.cast("string"), F.lit("")) for f in fields]))
