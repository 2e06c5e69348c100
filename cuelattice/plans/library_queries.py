"""Registered queries over media libraries, documents, caches, jobs and tool logs."""

from __future__ import annotations

from pyspark.sql import functions as F

from cuelattice.functions.scalars import field_hash
from cuelattice.operators import library as B
from cuelattice.plans import tables as T
from cuelattice.plans.registry import query
from cuelattice.plans.tables import with_tables
from cuelattice.sources import logs as G
from cuelattice.sources.media_ranges import media_ranges, quick_hashes

KIND = "CASE WHEN ext IN (" + ", ".join(f"'{e}'" for e in B.VIDEO) + ") THEN 'video' WHEN ext IN (" + ", ".join(f"'{e}'" for e in B.AUDIO) + ") THEN 'audio' WHEN ext IN (" + ", ".join(f"'{e}'" for e in B.IMAGE) + ") THEN 'image' END"
# File names derived from pages: the last URL piece with one of several extensions.
FILES = "SELECT page_id, 'D:\\Media\\' || (page_id % 50) || '.' || ['mp4','WAV','txt','png','mkv'][page_id % 5 + 1] AS path, length(html) AS size_bytes FROM pages"


def _files(spark, sf):
    return spark.read.parquet(f"{sf}/pages.parquet").selectExpr(
        "page_id", "concat('D:\\\\Media\\\\', page_id % 50, '.', element_at(array('mp4','WAV','txt','png','mkv'), CAST(page_id % 5 AS INT) + 1)) AS path", "CAST(length(html) AS BIGINT) AS size_bytes")


def _listing(spark, sf):
    return _files(spark, sf).where("page_id % 50 < 40").groupBy("path").agg(F.max("size_bytes").alias("size_bytes"))


INSPECT = f"""WITH f AS ({FILES}), l AS (SELECT path, max(size_bytes) AS size_bytes FROM f WHERE page_id % 50 < 40 GROUP BY 1)
, u AS (SELECT path, any_value(lower(split_part(path, '.', 2))) AS ext FROM f GROUP BY 1)
, i AS (SELECT u.path, split_part(u.path, '\\', 3) AS file_name, {KIND} AS kind, l.path IS NOT NULL AS "exists", size_bytes, CASE WHEN l.path IS NULL THEN 'missing' WHEN ({KIND}) IS NULL THEN 'unsupported' END AS error FROM u LEFT JOIN l USING (path))"""


def _inspections(spark, sf):
    return B.inspect_media(_files(spark, sf).withColumn("path", F.concat(F.lit(" "), "path")), _listing(spark, sf))


@query("src_11_media_inventory", INSPECT + ' SELECT path, file_name, kind, "exists" AS found, size_bytes, error FROM i')
def _(spark, sf):
    return _inspections(spark, sf).withColumnRenamed("exists", "found")


@query("txt_10_path_keys", f"WITH f AS ({FILES}) SELECT page_id, lower(replace(path, '\\', '/')) AS path_key, {KIND} AS kind FROM (SELECT *, lower(split_part(path, '.', 2)) AS ext FROM f)")
def _(spark, sf):
    return _files(spark, sf).select("page_id", B.path_key(F.col("path")).alias("path_key"), B.media_kind(F.col("path")).alias("kind"))


LE = "unhex(" + " || ".join(f"substr(h, {i}, 2)" for i in range(15, 0, -2)) + ")"


@query("src_12_quick_hash", f"""WITH d AS (SELECT doc_id, encode(text) AS c, octet_length(encode(text)) AS n FROM documents), e AS (SELECT *, lpad(to_hex(n), 16, '0') AS h FROM d)
SELECT doc_id, 'sha256:' || sha256(CASE WHEN n > 65536 THEN c[1:65536] || c[n - 65535:n] ELSE c END || {LE}) AS quick_hash FROM e""")
def _(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", B.quick_hash(F.encode("text", "UTF-8")).alias("quick_hash"))


@query("src_12_quick_hash_files")
def _(spark, sf):
    """The given tables as the files they are: heads and tails by range reads."""
    return quick_hashes(media_ranges(spark, sf, "*.parquet")).select(B.file_name(F.col("path")).alias("file_name"), "size_bytes", "quick_hash", "error")


@query("src_13_search_roots", with_tables("media_found", """, l AS (SELECT '/root' || path AS path, len(string_split(path, '/')) - 2 AS depth FROM media_found WHERE split_part(path, '/', 3)::INT < 5)
SELECT path, depth::BIGINT AS depth, (SELECT count(*) FROM l) > 100000 AS truncated FROM l ORDER BY path LIMIT 100000"""))
def _(spark, sf):
    listing = T.media_found(spark, sf).where("CAST(split(path, '/')[2] AS INT) < 5").select(F.concat(F.lit("/root"), "path").alias("path"))
    return B.search_candidates(listing, "/root/new/").withColumn("depth", F.col("depth").cast("long"))


RELINK = """, r AS (SELECT *, lower(split_part(path, '/', 3)) AS nk FROM media_refs), p AS (
  SELECT r.asset_id, f.path AS fp FROM r JOIN media_found f ON lower(f.file_name) = nk WHERE (r.size_bytes IS NULL OR r.size_bytes = f.size_bytes) AND (r.quick_hash IS NULL OR r.quick_hash = f.quick_hash)
  UNION SELECT r.asset_id, f.path FROM r JOIN media_found f ON r.size_bytes = f.size_bytes WHERE r.quick_hash IS NOT NULL AND r.quick_hash = f.quick_hash)
, g AS (SELECT asset_id, count(*) AS n, min(fp) AS fp FROM p GROUP BY 1)
, o AS (SELECT r.asset_id, r.path, CASE WHEN n IS NULL THEN 'unresolved' WHEN n = 1 THEN 'resolved' ELSE 'ambiguous' END AS outcome, CASE WHEN n = 1 THEN fp END AS replacement_path,
   CASE WHEN n IS NULL THEN NULL WHEN quick_hash IS NOT NULL THEN 100 WHEN size_bytes IS NOT NULL THEN 80 ELSE 60 END AS confidence, coalesce(n, 0) AS n_candidates FROM r LEFT JOIN g USING (asset_id))"""


@query("join_11_relink", with_tables("media_refs media_found", RELINK + " SELECT asset_id, path, outcome, replacement_path, coalesce(confidence, 0)::BIGINT AS confidence, n_candidates::BIGINT AS n_candidates FROM o"))
def _(spark, sf):
    out = B.relink(T.media_refs(spark, sf), T.media_found(spark, sf))
    return out.withColumn("confidence", F.coalesce("confidence", F.lit(0)).cast("long"))


@query("join_12_apply_relink", with_tables("media_refs media_found clips", RELINK + """, t AS (SELECT path, max(replacement_path) AS np FROM o WHERE replacement_path IS NOT NULL GROUP BY 1)
SELECT project_id, clip_id, coalesce(np, '/old/' || (project_id % 40) || '.mp4') AS file FROM clips LEFT JOIN t ON t.path = '/old/' || (project_id % 40) || '.mp4'"""))
def _(spark, sf):
    resolved = B.relink(T.media_refs(spark, sf), T.media_found(spark, sf))
    clips = T.clips(spark, sf).select("project_id", "clip_id", F.expr("concat('/old/', project_id % 40, '.mp4') AS file"))
    return B.apply_relink(clips, resolved, "file")


@query("join_13_missing_media", with_tables("media_refs", "SELECT asset_id, path FROM media_refs WHERE path NOT IN (SELECT path FROM media_refs WHERE asset_id % 5 = 0)"))
def _(spark, sf):
    refs = T.media_refs(spark, sf).select("asset_id", "path")
    return B.missing_media(refs, refs.where("asset_id % 5 = 0").select("path"))


@query("join_14_import_media", INSPECT + """ SELECT path, 'new' AS what FROM i WHERE error IS NULL AND path NOT IN (SELECT path FROM f WHERE page_id % 50 IN (0, 1, 4, 10)) UNION ALL SELECT path, 'rejected' FROM i WHERE error IS NOT NULL""")
def _(spark, sf):
    existing = _files(spark, sf).where("page_id % 50 IN (0, 1, 4, 10)").select(F.expr("upper(path) AS path"))
    fresh, rejected = B.import_media(_inspections(spark, sf), existing)
    return fresh.select("path", F.lit("new").alias("what")).unionByName(rejected.select("path", F.lit("rejected").alias("what")))


@query("join_22_sync_library", INSPECT + """, m AS (SELECT DISTINCT path FROM f WHERE page_id % 50 IN (0, 1, 3, 4)), t AS (SELECT DISTINCT path FROM f WHERE page_id % 3 = 0)
, k AS (SELECT path FROM m WHERE path IN (SELECT path FROM t)) SELECT path, 'kept' AS origin FROM k UNION ALL SELECT path, 'imported' FROM i WHERE error IS NULL AND path IN (SELECT path FROM t) AND path NOT IN (SELECT path FROM k)""")
def _(spark, sf):
    files = _files(spark, sf)
    media = files.where("page_id % 50 IN (0, 1, 3, 4)").select("path").distinct()
    return B.sync_library(media, files.where("page_id % 3 = 0").select("path"), _inspections(spark, sf))


@query("join_18_cached_analysis", """WITH r AS (SELECT p_partkey, p_size, sha256('6:beat-1;2:v3;' || octet_length(encode(p_name)) || ':' || p_name || ';' || length(p_size::VARCHAR) || ':' || p_size || ';') AS k FROM part)
SELECT p_partkey, CASE WHEN k IN (SELECT k FROM r WHERE p_partkey % 6 = 0) THEN 'hit' ELSE 'work' END AS outcome, k AS cache_key FROM r""")
def _(spark, sf):
    requests = spark.read.parquet(f"{sf}/part.parquet").withColumn("cache_key", B.analysis_key("beat-1", "v3", F.col("p_name"), F.col("p_size"))).select("p_partkey", "cache_key")
    cache = requests.where("p_partkey % 3 = 0").select("cache_key", F.expr("p_partkey % 6 = 0 AS valid"))
    hits, work = B.reuse_cached(requests, cache)
    return hits.select("p_partkey", F.lit("hit").alias("outcome"), "cache_key").unionByName(work.select("p_partkey", F.lit("work").alias("outcome"), "cache_key"))


@query("hash_03_field_hash", "SELECT p_partkey, sha256(octet_length(encode(p_name)) || ':' || p_name || ';' || octet_length(encode(p_type)) || ':' || p_type || ';') AS h FROM part")
def _(spark, sf):
    return spark.read.parquet(f"{sf}/part.parquet").select("p_partkey", field_hash(F.col("p_name"), F.col("p_type")).alias("h"))


@query("hash_01_clip_signature", with_tables("clips", """SELECT project_id, clip_id, sha256('["clip-analysis-v1","' || clip_id || '","' || start_ms || '","' || duration_ms || '","' || trim_in_ms || '"]') AS signature FROM clips"""))
def _(spark, sf):
    return T.clips(spark, sf).select("project_id", "clip_id", F.sha2(B.clip_signature(F.col("clip_id"), F.col("start_ms"), F.col("duration_ms"), F.col("trim_in_ms")), 256).alias("signature"))


@query("agg_16_cache_stats", with_tables("cache_files", "SELECT partial AS cache_half, count(*)::BIGINT AS file_count, count(*) FILTER (partial)::BIGINT AS partial_count, sum(bytes)::BIGINT AS total_bytes FROM cache_files GROUP BY 1"))
def _(spark, sf):
    return B.cache_stats(T.cache_files(spark, sf).withColumn("cache_half", F.col("partial")), ["cache_half"])


@query("top_07_lru_prune", with_tables("cache_files", """, a AS (SELECT *, bytes % 7 = 0 AS active FROM cache_files), t AS (SELECT sum(bytes) AS total FROM a)
, w AS (SELECT *, coalesce(sum(bytes) OVER (ORDER BY modified, path ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS bf FROM a WHERE NOT active)
SELECT path, bytes, partial FROM w, t WHERE partial OR total - bf > 100000000"""))
def _(spark, sf):
    files = T.cache_files(spark, sf).withColumn("cache_id", F.lit(1))
    active = files.where("bytes % 7 = 0").select("cache_id", "path")
    return B.prune_plan(files, 100_000_000, active).select("path", "bytes", "partial")


SNAPS = "SELECT o_orderkey AS snapshot_id, o_custkey % 40 AS project_id, epoch_ms(o_orderdate) + o_orderkey AS updated_at_ms, CASE WHEN o_orderkey % 3 = 0 THEN '/p/' || o_orderkey END AS original_path, o_orderkey % 5 <> 0 AS is_valid FROM orders"


@query("top_08_recovery_listing", f"WITH s AS ({SNAPS}) SELECT * FROM s WHERE NOT (is_valid AND original_path IS NULL) OR snapshot_id = (SELECT arg_max(snapshot_id, (updated_at_ms, snapshot_id)) FROM s WHERE is_valid AND original_path IS NULL)")
def _(spark, sf):
    snaps = spark.read.parquet(f"{sf}/orders.parquet").selectExpr(
        "o_orderkey AS snapshot_id", "o_custkey % 40 AS project_id", "unix_millis(CAST(o_orderdate AS TIMESTAMP)) + o_orderkey AS updated_at_ms",
        "IF(o_orderkey % 3 = 0, concat('/p/', o_orderkey), NULL) AS original_path", "o_orderkey % 5 <> 0 AS is_valid")
    return B.recovery_listing(snaps)


@query("top_10_job_listing", with_tables("job_log", "SELECT job_id, max(seq) AS seq, arg_max(line, seq) AS line FROM job_log GROUP BY 1"))
def _(spark, sf):
    return B.latest_jobs(T.job_log(spark, sf).select("job_id", "seq", "line"))


PROGRESS = """, p AS (SELECT *, arg_max(CASE WHEN line LIKE 'frame=%' THEN TRY_CAST(split_part(line, '=', 2) AS BIGINT) END, seq) FILTER (line LIKE 'frame=%') OVER w AS frame,
  arg_max(TRY_CAST(split_part(line, '=', 2) AS BIGINT) // 1000, seq) FILTER (line LIKE 'out_time_us=%') OVER w AS us, arg_max(TRY_CAST(rtrim(split_part(line, '=', 2), 'x') AS DOUBLE), seq) FILTER (line LIKE 'speed=%') OVER w AS speed
  FROM job_log WINDOW w AS (PARTITION BY job_id ORDER BY seq ROWS UNBOUNDED PRECEDING)), d AS (SELECT job_id, max(seq) * 110 AS dur FROM job_log GROUP BY 1)
SELECT job_id, seq, least(coalesce(us, 0), dur) AS encoded_ms, round(least(99.9, least(coalesce(us, 0), dur) / dur::DOUBLE * 100), 6) AS percent, frame, round(speed, 6) AS speed,
  CASE WHEN speed > 0 THEN round((dur - least(coalesce(us, 0), dur)) / speed)::BIGINT END AS eta_ms FROM p JOIN d USING (job_id) WHERE line = 'progress=continue'"""


@query("str_01_job_progress", with_tables("job_log", PROGRESS), sized="events")
def _(spark, sf):
    log = T.job_log(spark, sf)
    durations = log.groupBy("job_id").agg((F.max("seq") * 110).alias("duration_ms"))
    out = G.job_progress(log, durations)
    return out.selectExpr("job_id", "seq", "encoded_ms", "round(percent, 6) AS percent", "frame", "round(speed, 6) AS speed", "eta_ms")


ATTEMPTS = "SELECT o_custkey AS project_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS attempt_no, 'C' || (o_orderkey % 4) AS checksum, CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE 'c' || ((o_orderkey + 1) % 4) END AS base_checksum FROM orders"


def _attempts(spark, sf):
    from cuelattice.kernel.scan import Running, running

    orders = spark.read.parquet(f"{sf}/orders.parquet").select("o_custkey", "o_orderkey")
    numbered = running(orders, ["o_custkey"], ["o_orderkey"], [Running("attempt_no", "count", F.lit(1))], F.expr("o_orderkey DIV 100000"))
    return numbered.selectExpr("o_custkey AS project_id", "attempt_no", "concat('C', o_orderkey % 4) AS checksum", "IF(o_orderkey % 5 = 0, NULL, concat('c', (o_orderkey + 1) % 4)) AS base_checksum")


@query("str_06_revision_check", f"""WITH RECURSIVE a AS ({ATTEMPTS}), w AS (SELECT project_id, attempt_no, base_checksum IS NULL AS ok, CASE WHEN base_checksum IS NULL THEN checksum END AS head FROM a WHERE attempt_no = 1 UNION ALL
 SELECT a.project_id, a.attempt_no, a.base_checksum IS NULL OR coalesce(lower(a.base_checksum) = lower(w.head), false), CASE WHEN a.base_checksum IS NULL OR coalesce(lower(a.base_checksum) = lower(w.head), false) THEN a.checksum ELSE w.head END
 FROM w JOIN a ON a.project_id = w.project_id AND a.attempt_no = w.attempt_no + 1) SELECT project_id, attempt_no, ok AS accepted FROM w""")
def _(spark, sf):
    return B.accept_revisions(_attempts(spark, sf))


DEB = """, e AS (SELECT user_id AS project_id, rn AS revision, rn * 700 + (event_id % 11) * 120 AS at_ms FROM ev), n AS (SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY at_ms, revision) AS i FROM e)
, w AS (SELECT project_id, i, at_ms AS f, at_ms AS l, revision AS r, NULL::BIGINT AS out_at, NULL::BIGINT AS out_r FROM n WHERE i = 1 UNION ALL
  SELECT n.project_id, n.i, CASE WHEN n.at_ms >= least(l + 1500, f + 15000) THEN n.at_ms ELSE f END, n.at_ms, n.revision, CASE WHEN n.at_ms >= least(l + 1500, f + 15000) THEN least(l + 1500, f + 15000) END, CASE WHEN n.at_ms >= least(l + 1500, f + 15000) THEN r END
  FROM w JOIN n ON n.project_id = w.project_id AND n.i = w.i + 1)
SELECT project_id, out_at AS written_at_ms, out_r AS revision FROM w WHERE out_at IS NOT NULL UNION ALL SELECT project_id, least(arg_max(l, i) + 1500, arg_max(f, i) + 15000), arg_max(r, i) FROM w GROUP BY 1"""


def _dirty(spark, sf):
    return T.numbered_events(spark, sf).selectExpr("user_id AS project_id", "rn AS revision", "rn * 700 + (event_id % 11) * 120 AS at_ms")


@query("str_05_debounced_writes", with_tables("ev", DEB, recursive=True), sized="events")
def _(spark, sf):
    return B.debounce_writes(_dirty(spark, sf))


def _stored(spark, sf):
    """Stored documents of every order: sound, tampered, too new, legacy and broken ones."""
    doc = "concat('{\"id\":', o_orderkey, '}')"
    body = (
        f"CASE o_orderkey % 5 WHEN 0 THEN concat('{{\"fileFormat\":\"clip-project\",\"formatVersion\":1,\"kind\":\"project\",\"checksum\":\"SHA256:', sha2({doc}, 256), '\",\"document\":', {doc}, '}}') "
        f"WHEN 1 THEN concat('{{\"fileFormat\":\"clip-project\",\"formatVersion\":1,\"kind\":\"project\",\"checksum\":\"sha256:00\",\"document\":', {doc}, '}}') "
        f"WHEN 2 THEN concat('{{\"fileFormat\":\"clip-project\",\"formatVersion\":9,\"kind\":\"project\",\"checksum\":\"x\",\"document\":', {doc}, '}}') WHEN 3 THEN {doc} ELSE '{{broken' END"
    )
    return spark.read.parquet(f"{sf}/orders.parquet").select(F.col("o_orderkey").alias("revision"), F.col("o_custkey").alias("project_id"), F.expr(body).alias("body"))


_ERR = "CASE o_orderkey % 5 WHEN 1 THEN 'project_integrity_failed' WHEN 2 THEN 'project_version_unsupported' WHEN 4 THEN 'project_parse_failed' END"


@query("src_14_stored_documents", f"SELECT o_orderkey AS revision, {_ERR} AS error, CASE WHEN o_orderkey % 5 < 3 THEN 'project' ELSE 'legacy' END AS kind FROM orders")
def _(spark, sf):
    return B.decode_documents(_stored(spark, sf), "clip-project").select("revision", "error", "kind")


@query("hash_02_document_checksum", "SELECT o_orderkey AS revision, 'sha256:' || sha256('{\"id\":' || o_orderkey || '}') AS checksum FROM orders WHERE o_orderkey % 5 < 4")
def _(spark, sf):
    return B.decode_documents(_stored(spark, sf), "clip-project").where("revision % 5 < 4").select("revision", "checksum")


@query("str_07_newest_valid_version", """SELECT o_orderkey AS project_id, CASE o_orderkey % 5 WHEN 2 THEN 'project_version_unsupported' WHEN 1 THEN CASE WHEN o_orderkey % 2 = 1 THEN 'project_integrity_failed' END WHEN 4 THEN CASE WHEN o_orderkey % 2 = 1 THEN 'project_parse_failed' END END AS error,
 o_orderkey % 5 IN (1, 4) AND o_orderkey % 2 = 0 AS recovered FROM orders""")
def _(spark, sf):
    primary = B.decode_documents(_stored(spark, sf), "clip-project").select(F.col("revision").alias("project_id"), F.lit("primary").alias("slot"), "document", "error")
    backup = primary.where("project_id % 2 = 0").select("project_id", F.lit("backup").alias("slot"), F.lit("{}").alias("document"), F.lit(None).cast("string").alias("error"))
    return B.newest_valid(primary.unionByName(backup)).select("project_id", "error", "recovered")


RUNS = """, r AS (SELECT user_id AS profile_id, ['speech','analysis','planning','ranking','finalizing'][event_id % 5 + 1] AS stage, rn AS run_no, value * 400 AS elapsed, rn * 1000 AS src FROM ev)
, b AS (SELECT *, least(4, greatest(0.35, greatest(250, elapsed) / CASE stage WHEN 'speech' THEN least(900000, greatest(9000, 6000 + src * 0.12)) WHEN 'analysis' THEN least(3600000, greatest(22000, 14000 + src * 0.55)) WHEN 'planning' THEN 2500 WHEN 'ranking' THEN 12000 ELSE 1800 END))::DOUBLE AS o,
   row_number() OVER (PARTITION BY user_id, stage ORDER BY run_no) AS i FROM (SELECT *, profile_id AS user_id FROM r))
, w AS (SELECT profile_id, stage, i, least(4, greatest(0.35, 0.72 + o * 0.28))::DOUBLE AS q FROM b WHERE i = 1 UNION ALL SELECT b.profile_id, b.stage, b.i, least(4, greatest(0.35, w.q * 0.72 + b.o * 0.28)) FROM w JOIN b ON b.profile_id = w.profile_id AND b.stage = w.stage AND b.i = w.i + 1)
, q AS (SELECT profile_id, stage, arg_max(q, i) AS ratio FROM w GROUP BY 1, 2)
SELECT profile_id, stage, round(CASE stage WHEN 'speech' THEN 13200 WHEN 'analysis' THEN 47000 WHEN 'planning' THEN 2500 WHEN 'ranking' THEN 12000 ELSE 1800 END * coalesce(ratio, 1), 4) AS expected_ms FROM (SELECT profile_id, unnest(['speech','analysis','planning','ranking','finalizing']) AS stage FROM (SELECT DISTINCT profile_id FROM r)) p LEFT JOIN q USING (profile_id, stage)"""


@query("str_08_stage_durations", with_tables("ev", RUNS, recursive=True), sized="events")
def _(spark, sf):
    runs = T.numbered_events(spark, sf).selectExpr(
        "user_id AS profile_id", "element_at(array('speech','analysis','planning','ranking','finalizing'), CAST(event_id % 5 AS INT) + 1) AS stage", "rn AS run_no", "value * 400 AS elapsed_ms", "rn * 1000 AS source_ms")
    requests = runs.select("profile_id").distinct().withColumn("source_ms", F.lit(60_000))
    return B.expected_stage_ms(requests, B.learned_ratios(runs)).selectExpr("profile_id", "stage", "round(expected_ms, 4) AS expected_ms")


_MSG = "['No space left on device','Access is denied','No such file or directory','moov atom not found','Unknown encoder','Error initializing filter','odd'][{0} + 1]"


@query("prj_17_error_class", f"""WITH m AS (SELECT o_orderkey, lower({_MSG.format('o_orderkey % 7')} || chr(10) || {_MSG.format('o_custkey % 7')}) AS t FROM orders)
, c AS (SELECT o_orderkey, CASE WHEN contains(t, 'no space left') THEN 'disk_full' WHEN contains(t, 'access is denied') THEN 'permission_denied' WHEN contains(t, 'no such file') THEN 'missing_media' WHEN contains(t, 'moov atom') THEN 'unsupported_media' WHEN contains(t, 'unknown encoder') THEN 'encoder_unavailable' WHEN contains(t, 'error initializing') THEN 'filter_failed' ELSE 'ffmpeg_failed' END AS code FROM m)
SELECT o_orderkey, code, code NOT IN ('unsupported_media', 'encoder_unavailable', 'filter_failed') AS retryable FROM c""")
def _(spark, sf):
    pick = "element_at(array('No space left on device','Access is denied','No such file or directory','moov atom not found','Unknown encoder','Error initializing filter','odd'), CAST({0} AS INT) + 1)"
    rows = spark.read.parquet(f"{sf}/orders.parquet").select("o_orderkey", F.expr(f"concat({pick.format('o_orderkey % 7')}, '\n', {pick.format('o_custkey % 7')}) AS t"))
    code, retry = G.error_class(F.col("t"))
    return rows.select("o_orderkey", code.alias("code"), retry.alias("retryable"))


@query("prj_24_asset_check", "SELECT p_partkey, p_partkey % 6 <> 0 AND p_partkey % 7 <> 0 AND p_partkey % 11 <> 0 AS valid FROM part")
def _(spark, sf):
    assets = spark.read.parquet(f"{sf}/part.parquet").selectExpr(
        "p_partkey", "IF(p_partkey % 6 = 0, '', concat('a', p_partkey)) AS asset_id", "concat('/m/', p_name) AS path", "p_name AS file_name", "IF(p_partkey % 7 = 0, 'text', 'video') AS kind",
        "p_size AS size_bytes", "IF(p_partkey % 11 = 0, NULL, 'h') AS quick_hash", "'online' AS availability")
    return B.asset_checks(assets).select("p_partkey", "valid")


@query("prj_26_audio_limits", with_tables("loudness", """, k AS (SELECT asset_id AS project_id, 'c1' AS clip_id, ['volume','riderGain','duckGain'][at_ms // 100 % 3 + 1] AS kind, (loudness_db + 60) / (10 + asset_id % 9) AS v FROM loudness)
SELECT project_id::VARCHAR AS id, kind || ':invalid-point' AS issue FROM k GROUP BY project_id, kind HAVING bool_or(v > CASE kind WHEN 'duckGain' THEN 1 ELSE 4 END)
UNION ALL SELECT 'p' || asset_id, 'integrated_lufs' FROM loudness GROUP BY asset_id HAVING -80 + max(at_ms) / 200.0 NOT BETWEEN -70 AND -5"""))
def _(spark, sf):
    loud = T.loudness(spark, sf)
    points = loud.selectExpr("asset_id AS project_id", "'c1' AS clip_id", "element_at(array('volume','riderGain','duckGain'), CAST(at_ms DIV 100 % 3 AS INT) + 1) AS kind", "at_ms AS time_ms", "(loudness_db + 60) / (10 + asset_id % 9) AS value", "'linear' AS easing")
    passes = loud.groupBy("asset_id").agg(F.expr("-80 + max(at_ms) / 200.0D AS integrated_lufs"))
    return B.automation_issues(points).selectExpr("CAST(project_id AS STRING) AS id", "concat(kind, ':', code) AS issue").unionByName(
        B.loudness_pass_issues(passes).selectExpr("concat('p', asset_id) AS id", "field AS issue"))


@query("prj_22_duck_settings", """SELECT p_partkey, greatest(-30, least(0, -p_size * 1.0))::DOUBLE AS reduction_db, CASE WHEN p_partkey % 4 = 0 THEN 80 ELSE least(500, p_size * 20) END::BIGINT AS lookahead_ms, 'a,b' AS tracks FROM part""")
def _(spark, sf):
    raw = spark.read.parquet(f"{sf}/part.parquet").selectExpr(
        "p_partkey", "CAST(NULL AS BOOLEAN) AS enabled", "-p_size * 1.0D AS reduction_db", "IF(p_partkey % 4 = 0, double('NaN'), p_size * 20.0D) AS lookahead_ms", "100.0D AS attack_ms", "160.0D AS hold_ms", "650.0D AS release_ms",
        "0.5D AS min_confidence", "array(' a', 'b ', '', 'a') AS source_tracks")
    return B.normalize_ducking(raw).selectExpr("p_partkey", "reduction_db", "lookahead_ms", "array_join(source_tracks, ',') AS tracks")


# --- tool logs and JSON ------------------------------------------------------------


@query("src_18_loudness_log", with_tables("loudness", "SELECT asset_id, at_ms, loudness_db FROM loudness"))
def _(spark, sf):
    loud = T.loudness(spark, sf)
    lines = loud.selectExpr("asset_id", "at_ms AS line_no", "concat('[Parsed_ebur128_0 @ 0x1] t: ', CAST(at_ms / 1000.0D AS STRING), '  TARGET:-23 LUFS  M: ', CAST(loudness_db AS STRING), ' S:-30') AS line").unionByName(
        loud.selectExpr("asset_id", "at_ms AS line_no", "'size=N/A time=00:00:01 M: none' AS line"))
    durations = loud.groupBy("asset_id").agg(F.max("at_ms").alias("duration_ms"))
    return G.loudness_points(lines, durations).select("asset_id", "at_ms", "loudness_db")


@query("src_19_loudness_measurement", """SELECT p_partkey, CASE WHEN p_partkey % 4 = 3 THEN 'unmeasurable' WHEN p_partkey % 4 = 2 THEN 'parse-failed' END AS error, CASE WHEN p_partkey % 4 < 2 THEN -p_size / 2.0 END::DOUBLE AS input_i FROM part""")
def _(spark, sf):
    tail = "concat('{\"input_i\": \"', CAST(-p_size / 2.0D AS STRING), '\", \"input_tp\" : -1.5, \"input_lra\":\"3\", \"input_thresh\":\"-40\", \"target_offset\":\"', IF(p_partkey % 4 = 3, 'inf', '0.1'), '\"}')"
    logs = spark.read.parquet(f"{sf}/part.parquet").select("p_partkey", F.expr(f"concat('noise {{x}} {{\"input_i\": \"-99\"}}\n', IF(p_partkey % 4 = 2, '', {tail}), '\ndone {{y}}') AS log"))
    return G.loudness_measurement(logs).selectExpr("p_partkey", "error", "IF(error IS NULL, input_i, NULL) AS input_i")


@query("src_20_probe_fields", "SELECT p_partkey, CASE WHEN p_partkey % 5 > 0 THEN p_partkey % 3 * 3600000 + p_size % 60 * 60000 + 12340 END::BIGINT AS duration_ms, p_partkey % 2 = 0 AS has_audio FROM part")
def _(spark, sf):
    logs = spark.read.parquet(f"{sf}/part.parquet").select("p_partkey", F.expr(
        "concat('Input #0\n  Duration: ', IF(p_partkey % 5 = 0, 'N/A', format_string('%02d:%02d:12.34', p_partkey % 3, p_size % 60)), ', start: 0\n  Stream #0:', p_partkey % 2, IF(p_partkey % 2 = 0, ': Audio: aac', ': Video: h264'), '\n') AS log"))
    return G.probe_fields(logs)


@query("src_15_recogniser_json", with_tables("words", "SELECT asset_id, word_idx // 17 AS segment_idx, row_number() OVER (PARTITION BY asset_id, word_idx // 17 ORDER BY word_idx) - 1 AS token_idx, ' ' || text AS raw, start_ms AS from_ms, end_ms AS to_ms, confidence AS p FROM words WHERE asset_id % 4 > 0"), sized="documents")
def _(spark, sf):
    seg = T.words(spark, sf).groupBy("asset_id", F.expr("word_idx DIV 17 AS s")).agg(F.expr(
        "transform(array_sort(collect_list(struct(word_idx, text, start_ms, end_ms, confidence))), w -> struct(concat(' ', w.text) AS text, struct(w.start_ms AS `from`, w.end_ms AS `to`) AS offsets, w.confidence AS p)) AS tokens"))
    docs = seg.groupBy("asset_id").agg(F.expr(
        "to_json(struct(struct(IF(first(asset_id) % 4 = 0, 'de', 'tr') AS language) AS result, transform(array_sort(collect_list(struct(s, tokens))), x -> struct(struct(0L AS `from`, 9L AS `to`) AS offsets, '' AS text, x.tokens AS tokens)) AS transcription)) AS json"))
    return G.recogniser_tokens(docs, "tr").select("asset_id", "segment_idx", "token_idx", "raw", "from_ms", "to_ms", "p")


@query("src_16_classifier_json", with_tables("class_frames", "SELECT asset_id, t, s, l FROM class_frames WHERE asset_id % 3 > 0"))
def _(spark, sf):
    docs = T.class_frames(spark, sf).groupBy("asset_id").agg(F.expr(
        "to_json(struct('frames-v1' AS schema, 16000 AS sample_rate, 960 AS window_ms, IF(first(asset_id) % 3 = 0, 10, 480) AS hop_ms, max(t) + 960 AS duration_ms, array_sort(collect_list(struct(t, s, l))) AS frames)) AS json"))
    return G.classifier_frames(docs, "frames-v1")[0].select("asset_id", "t", "s", "l")


@query("src_17_tracker_json", with_tables("track_samples", "SELECT asset_id, time_ms, round(x, 6) AS x, round(y, 6) AS y, confidence FROM track_samples WHERE asset_id % 3 > 0"))
def _(spark, sf):
    docs = T.track_samples(spark, sf).groupBy("asset_id").agg(F.expr(
        "to_json(struct(IF(first(asset_id) % 3 = 0, 'other', 'k1') AS key, 1920 AS width, 1080 AS height, 30.0D AS fps, array_sort(collect_list(struct(time_ms, confidence, struct(x - width / 2 AS x, y - height / 2 AS y, width, height) AS bbox))) AS samples)) AS json"), F.lit("k1").alias("key"))
    return G.tracker_samples(docs)[0].selectExpr("asset_id", "time_ms", "round(x, 6) AS x", "round(y, 6) AS y", "confidence")
