"""Thin registered queries of this folder: given tables to transcript records, operator, result columns."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cuelattice.llm.byte_bpe import decode_tokens, encode_transcripts
from cuelattice.llm.cap_filters import embedding_groups
from cuelattice.llm.dialogue_repair import dialogue_report, repair_dialogues
from cuelattice.llm.exact_dedup import exact_duplicates
from cuelattice.llm.fixity import fixity_audit, warc_records
from cuelattice.llm.language_id import fit_languages, label_languages
from cuelattice.llm.mixing import mixture_copies
from cuelattice.llm.pair_bitmaps import align_tokenizers, read_tokenizers
from cuelattice.llm.personal_data import find_personal_data, fit_tagger
from cuelattice.llm.secret_scan import find_secrets
from cuelattice.llm.sharding import interleave_shards
from cuelattice.llm.simhash import simhash_groups
from cuelattice.llm.url_filter import Rule, fit_segmenter, fit_url_model, judge_urls, url_parts, word_counts
from cuelattice.llm.vocabulary import Vocabulary, read_vocabulary

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def transcripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents table as transcript records."""
    return spark.read.parquet(f"{sf_dir}/documents.parquet").selectExpr(
        "doc_id AS asset_id", "text AS transcript", "lang AS language", "source AS source_name")


def vocabulary(spark: SparkSession) -> Vocabulary:
    return read_vocabulary(spark, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def joined(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def base_of(spans: Column) -> Column:
    return F.filter(spans, lambda s: s["base"])


def base_count(kind: str) -> Column:
    return F.size(F.filter("spans", lambda s: s["base"] & (s["kind"] == kind))).cast("long").alias(f"n_{kind}")


def span_columns(*kinds: str) -> list[Column]:
    return [
        F.col("asset_id").alias("doc_id"), *[base_count(kind) for kind in kinds],
        F.sha2(joined(base_of(F.col("spans"))), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"),
    ]


@query
def op1_simhash_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_groups(transcripts(spark, sf_dir)).select(F.col("asset_id").alias("doc_id"), "fingerprint", "component_id")


@query
def op2_embedding_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_groups(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


@query
def op3_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixture_copies(transcripts(spark, sf_dir)).selectExpr(
        "asset_id AS doc_id", "size", "source_size", "target", "taken", "copies")


def held_out(asset_id: str) -> Column:
    """The rows of which language ID learns nothing."""
    return F.coalesce(F.crc32(F.col(asset_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


@query
def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = transcripts(spark, sf_dir)
    model = fit_languages(rows.where(~held_out("asset_id")))
    return label_languages(rows, model).select(
        F.col("asset_id").alias("doc_id"), held_out("asset_id").alias("held_out"), F.col("language").alias("lang_pred"), "score")


@query
def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_duplicates(transcripts(spark, sf_dir)).selectExpr(
        "asset_id AS doc_id", "keep_id", "group_size", "kept", "text_sha256")


@query
def op6_find_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_secrets(transcripts(spark, sf_dir), vocabulary(spark)).select(*span_columns("assign", "access", "hex"))


@query
def op7_warc_fixity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Archives of all pages against a second copy in which records by their address have decayed or are lost."""
    records = warc_records(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    fate = F.substr(F.md5(F.col("record_id").cast("string")), F.lit(1), F.lit(2))
    decayed = F.concat(F.substr(F.col("record"), F.lit(1), F.octet_length("record") - 5), F.lit(b"?\r\n\r\n"))
    second = records.where(fate != "07").withColumn("record", F.when(fate.isin("1f", "a3"), decayed).otherwise(F.col("record")))
    return fixity_audit(records, second)


@query
def op8_interleave_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return interleave_shards(transcripts(spark, sf_dir)).select(
        F.col("asset_id").alias("doc_id"), "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"))


@query
def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = vocabulary(spark)
    decoded = decode_tokens(encode_transcripts(transcripts(spark, sf_dir), words), words)
    return decoded.select(
        F.col("asset_id").alias("doc_id"), F.size("token_ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("token_ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("content", 256).alias("decoded_sha256"))


@query
def op10_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = transcripts(spark, sf_dir)
    return find_personal_data(rows, fit_tagger(rows)).select(*span_columns("email", "ip", "card", "phone"))


#: Rules on hosts and paths.
URL_RULES = (Rule("block", "net"), Rule("allow", "example.net", "/en/"), Rule("block", "example.com", "/de/"), Rule("allow", "org", "/fr/"))


@query
def op11_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    host, path = url_parts(F.col("url"))
    segmenter = fit_segmenter(word_counts(pages, "html"))
    model = fit_url_model(pages.select(host.alias("host"), path.alias("path")), segmenter)
    return judge_urls(pages.select("page_id", "url"), URL_RULES, model).drop("url")


def damaged(conversations: DataFrame) -> DataFrame:
    """Conversations as dialogues, with the faults that the check sum of a row's key puts in."""
    key = F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")])
    fate = F.crc32(key.cast("binary")) % 20
    text = F.coalesce("text", F.lit(" "))
    return conversations.where(fate != 0).select(
        F.col("conv_id").alias("doc_id"), F.col("turn").alias("cue_idx"),
        F.when(fate == 4, "user").otherwise(F.coalesce("role", F.lit(" "))).alias("speaker_id"),
        F.when(fate == 1, "").when(fate == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias("text"),
        F.explode(F.array_repeat(F.lit(0), F.when(fate == 3, 2).otherwise(1))).alias("copy"))


@query
def op12_dialogue_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    report = dialogue_report(repair_dialogues(damaged(conversations)))
    counts = [F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    own = conversations.select("conv_id").distinct()
    return own.join(report, own.conv_id.eqNullSafe(report.doc_id), "left").select(
        "conv_id", *counts, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256"))


@query
def op13_pair_bitmaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokenizers = read_tokenizers(spark, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"), public_tokenizers.PATTERN)
    digest = F.when(F.col("n_a") == 0, "").otherwise(F.sha2(F.col("groups").cast("binary"), 256))
    scored, _ = align_tokenizers(transcripts(spark, sf_dir), tokenizers, keep={"groups_sha256": digest})
    return scored.withColumnRenamed("asset_id", "doc_id")


ORACLES["op3_mix_sources"] = r"""
WITH d AS (SELECT doc_id, source, CASE WHEN text IS NULL THEN 0 ELSE len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) END::BIGINT AS size,
  substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 3) AS part FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, [5, 2, 1][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS weight, source_size * 3 AS ceiling FROM s),
l AS (SELECT *, (sum(source_size) OVER () - coalesce(sum(ceiling) OVER o, 0))::DOUBLE / (sum(weight) OVER () - coalesce(sum(weight) OVER o, 0))::DOUBLE AS level
  FROM w WINDOW o AS (ORDER BY ceiling / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
f AS (SELECT arg_min(level, ceiling / weight) AS level FROM l WHERE level * weight <= ceiling),
t AS (SELECT l.source, l.source_size, CASE WHEN f.level IS NULL THEN ceiling::DOUBLE ELSE least(ceiling::DOUBLE, f.level * weight) END AS target FROM l, f),
r AS (SELECT d.doc_id, d.source, d.size, t.source_size, t.target, CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0.0 END AS rate,
  row_number() OVER (PARTITION BY d.source ORDER BY d.size, d.part, d.doc_id NULLS LAST) - 1 AS by_size, count(*) OVER (PARTITION BY d.source) AS n
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
c AS (SELECT *, CASE WHEN by_size % 2 = 0 THEN by_size // 2 ELSE n - 1 - by_size // 2 END AS place,
  ('0x' || substr(md5('7:' || CASE WHEN source IS NULL THEN 'none' ELSE 's' || source END), 1, 5))::BIGINT::DOUBLE / 1048576.0 AS offset_ FROM r),
k AS (SELECT *, (floor((place + 1) * rate + offset_) - floor(place * rate + offset_))::BIGINT AS copies FROM c)
SELECT doc_id, size, source_size, target, copies * size AS taken, copies FROM k
"""

ORACLES["op5_exact_dedup"] = r"""
WITH d AS (SELECT doc_id, length(coalesce(text, '')) AS n, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256 FROM documents)
SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size,
  row_number() OVER w = 1 AS kept, text_sha256
FROM d WINDOW w AS (PARTITION BY text_sha256 ORDER BY n DESC, doc_id)
"""

ORACLES["op7_warc_fixity"] = r"""
WITH r AS (SELECT page_id // 500 AS archive, page_id, encode('WARC/1.1' || chr(13) || chr(10) || 'WARC-Type: response' || chr(13) || chr(10) || 'WARC-Record-ID: <urn:page:'
    || page_id || '>' || chr(13) || chr(10) || 'WARC-Target-URI: ' || coalesce(url, '') || chr(13) || chr(10) || 'Content-Length: '
    || octet_length(encode(coalesce(html, ''))) || chr(13) || chr(10) || chr(13) || chr(10) || coalesce(html, '') || chr(13) || chr(10) || chr(13) || chr(10)) AS record,
  substr(md5(page_id::VARCHAR), 1, 2) AS fate FROM pages),
o AS (SELECT *, (sum(octet_length(record)) OVER (PARTITION BY archive ORDER BY page_id) - octet_length(record))::BIGINT AS "offset" FROM r)
SELECT archive, "offset", sha256(record) AS digest_a,
  CASE WHEN fate <> '07' THEN sha256(record[1:octet_length(record) - 5] || encode('?' || chr(13) || chr(10) || chr(13) || chr(10))) END AS digest_b,
  CASE WHEN fate = '07' THEN 'missing in b' ELSE 'changed' END AS finding
FROM o WHERE fate IN ('07', '1f', 'a3')
"""


def _priced(value: str, cost: int, edit: str) -> str:
    """SQL: a value of six digits of cost and an audit, after one more edit."""
    return f"lpad((substr({value}, 1, 6)::INT + {cost})::VARCHAR, 6, '0') || substr({value}, 7) || '{edit}'"


def _inserted(*values: str) -> str:
    """SQL: the four values with inserted cues, in columns v0 to v3."""
    asked = f"least({values[2]}, " + ", ".join(_priced(values[k], 2, "I") for k in (0, 1, 3)) + ")"
    twice = ", ".join(_priced(values[k], 4, "II") for k in (0, 1))
    return f"{values[0]} AS v0, {values[1]} AS v1, {asked} AS v2, least({values[3]}, {_priced(values[2], 2, 'I')}, {twice}) AS v3"


def _kept_sql(state: int, kind: str, cost: int, edit: str) -> str:
    where = f"kind = '{kind}' AND " if edit == "K" else ""
    return f"CASE WHEN {where}fault NOT IN ('blank', 'duplicate') THEN {_priced(f'v{state}', cost, edit).replace(f'+ {cost}', f'+ {cost} + (fault = {chr(39)}truncated{chr(39)})::INT')} END"


_MOVES = {
    "w0": [_priced("v0", 3, "D")],
    "w1": [_priced("v1", 3, "D"), _kept_sql(0, "s", 0, "K")],
    "w2": [_priced("v2", 3, "D"), *[_kept_sql(k, "u", *edit) for k in (0, 1, 3) for edit in ((0, "K"), (2, "R"))]],
    "w3": [_priced("v3", 3, "D"), *[_kept_sql(2, "a", *edit) for edit in ((0, "K"), (2, "R"))]],
}

ORACLES["op12_dialogue_repair"] = rf"""
WITH RECURSIVE c AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS k FROM conversations),
x AS (SELECT *, xor(list_reduce(list_concat([4294967295::BIGINT], flatten(list_transform(range(length(k)), lambda i: [ascii(substr(k, i + 1, 1))::BIGINT, 0, 0, 0, 0, 0, 0, 0]))),
  lambda a, e: xor(xor(a, e) >> 1, 3988292384 * (xor(a, e) & 1))), 4294967295) % 20 AS fate FROM c),
d AS (SELECT conv_id, turn, CASE WHEN fate = 4 THEN 'user' ELSE role END AS role,
  CASE fate WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(range(CASE fate WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy FROM x),
o AS (SELECT *, row_number() OVER w AS i, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) AS said, left(role, 1) AS kind,
  lag(left(role, 1)) OVER w AS before FROM d WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, md5(text), copy)),
r AS (SELECT *, CASE WHEN NOT regexp_matches(text, '[^ 	-
]') THEN 'blank' WHEN said > 1 THEN 'duplicate'
  WHEN NOT regexp_matches(text, '[.!?][ 	-
]*$') THEN 'truncated' ELSE '' END AS fault FROM o),
n AS (SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
  count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (before IS NOT NULL AND before || kind NOT IN ('su', 'ua', 'au')) AS illegal FROM r GROUP BY conv_id),
f AS (SELECT conv_id, 0::BIGINT AS i, '000000' AS v0, NULL::VARCHAR AS v1, '000002I' AS v2, '000004II' AS v3 FROM n
  UNION ALL SELECT conv_id, i, {_inserted('w0', 'w1', 'w2', 'w3')}
  FROM (SELECT f.conv_id, r.i, {', '.join(f'least({", ".join(values)}) AS {name}' for name, values in _MOVES.items())}
    FROM f JOIN r ON r.conv_id IS NOT DISTINCT FROM f.conv_id AND r.i = f.i + 1)),
b AS (SELECT f.conv_id, least(v0, v3) AS v FROM f JOIN n ON f.conv_id IS NOT DISTINCT FROM n.conv_id AND f.i = n.n),
a AS (SELECT conv_id, substr(v, 1, 6)::BIGINT AS cost, substr(v, 7) AS audit FROM b),
w AS (SELECT conv_id, audit, 0 AS p, 1::BIGINT AS i, 0 AS st, []::VARCHAR[] AS said FROM a
  UNION ALL SELECT conv_id, audit, p + 1, CASE WHEN e = 'I' THEN i ELSE i + 1 END, CASE WHEN e = 'D' THEN st WHEN e = 'K' AND kind = 's' THEN 1 WHEN st = 2 THEN 3 ELSE 2 END,
    CASE e WHEN 'D' THEN said WHEN 'K' THEN list_append(said, role || ':' || text) ELSE list_append(said, CASE WHEN st = 2 THEN 'assistant' ELSE 'user' END || ':' || CASE WHEN e = 'R' THEN text ELSE '' END) END
  FROM (SELECT w.*, substr(w.audit, w.p + 1, 1) AS e, r.kind, r.role, r.text FROM w LEFT JOIN r ON r.conv_id IS NOT DISTINCT FROM w.conv_id AND r.i = w.i WHERE w.p < length(w.audit))),
z AS (SELECT conv_id, sha256(array_to_string(said, chr(10))) AS repaired_sha256 FROM w WHERE p = length(audit))
SELECT q.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  coalesce(cost, 0) AS cost, coalesce(audit, '') AS audit, coalesce(repaired_sha256, sha256('')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) q LEFT JOIN n ON q.conv_id IS NOT DISTINCT FROM n.conv_id
  LEFT JOIN a ON q.conv_id IS NOT DISTINCT FROM a.conv_id LEFT JOIN z ON q.conv_id IS NOT DISTINCT FROM z.conv_id
"""
