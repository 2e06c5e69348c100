"""Registered queries over words, cues and caption files."""

from __future__ import annotations

from pyspark.sql import functions as F

from cuelattice.functions import lexicons as L
from cuelattice.functions import scalars as X
from cuelattice.kernel.scan import TEXT_SHARE, dealt
from cuelattice.operators import captions as C
from cuelattice.plans import tables as T
from cuelattice.plans.registry import query
from cuelattice.plans.tables import with_tables
from cuelattice.session import cut_lineage
from cuelattice.sources import caption_text as K

CLEAN = ", ct AS (SELECT * REPLACE (regexp_replace(trim(text), '\\s*\\n\\s*', chr(10), 'g') AS text) FROM cue_turns)"


def _cues(spark, sf):
    """Cues without blank lines, so that a written file reads back unchanged."""
    return T.cue_turns(spark, sf).withColumn("text", F.regexp_replace(F.trim("text"), "\\s*\\n\\s*", "\n"))


def _clock(ms: str, sep: str) -> str:
    return f"printf('%02d:%02d:%02d{sep}%03d', ({ms}) // 3600000, ({ms}) % 3600000 // 60000, ({ms}) % 60000 // 1000, ({ms}) % 1000)"


@query("src_01_caption_files", """SELECT path, format_hint, CASE WHEN error IS NULL THEN text END AS text, error FROM (
  SELECT '/captions/' || doc_id || ['.srt', '.VTT', '.ass'][1 + doc_id % 3] AS path, ['srt', 'vtt', 'ass'][1 + doc_id % 3] AS format_hint, text,
    CASE WHEN doc_id % 7 = 0 THEN 'invalid-utf8' END AS error FROM documents)""")
def _(spark, sf):
    """Documents as caption files of three kinds: some with a byte order mark, some with a stray byte."""
    bytes_ = "concat(IF(doc_id % 4 = 0, X'EFBBBF', X''), CAST(text AS BINARY), IF(doc_id % 7 = 0, X'FF', X''))"
    files = spark.read.parquet(f"{sf}/documents.parquet").selectExpr(
        "concat('/captions/', doc_id, element_at(array('.srt', '.VTT', '.ass'), CAST(doc_id % 3 AS INT) + 1)) AS path", f"{bytes_} AS content")
    return K.caption_texts(files.withColumn("length", F.octet_length("content").cast("long")))


@query("src_07_write_srt", with_tables("cue_turns", CLEAN + f"""
SELECT doc_id, string_agg(cue_id || chr(13) || chr(10) || {_clock('start_ms', ',')} || ' --> ' || {_clock('end_ms', ',')} || chr(13) || chr(10) || text, chr(13) || chr(10) || chr(13) || chr(10) ORDER BY cue_idx) || chr(13) || chr(10) AS text FROM ct GROUP BY 1"""), sized="conversations")
def _(spark, sf):
    return K.write_srt(_cues(spark, sf))


@query("src_03_parse_srt", with_tables("cue_turns", CLEAN + "SELECT doc_id, cue_id, start_ms, end_ms, text FROM ct"), sized="conversations")
def _(spark, sf):
    noisy = K.write_srt(_cues(spark, sf)).withColumn("text", F.concat(F.lit("﻿not a cue\r\n\r\n"), "text", F.lit("\r\nbroken\r\n00:00 --> x\r\n")))
    return K.parse_srt(noisy).select("doc_id", "cue_id", "start_ms", "end_ms", "text")


VTT_CUES = CLEAN + f""", vb AS (SELECT *, CASE WHEN cue_idx % 3 = 0 THEN '' ELSE cue_id || chr(10) END || {_clock('start_ms', '.')} || ' --> ' || {_clock('end_ms', '.')} || ' line:' || cue_idx || chr(10) ||
 '<v ' || speaker_id || '>' || CASE WHEN cue_idx % 2 = 0 THEN '<c.loud>' || text || '</c>' ELSE text END || '</v>' || chr(10) AS b FROM ct)"""


def _vtt(spark, sf):
    cues = _cues(spark, sf).withColumns({
        "speaker": F.col("speaker_id"), "style": F.expr("IF(cue_idx % 2 = 0, 'loud', NULL)"), "settings": F.expr("concat('line:', cue_idx)"),
        "cue_id": F.expr("IF(cue_idx % 3 = 0, '', cue_id)"),
    })
    return K.write_vtt(cues)


@query("src_08_write_vtt", with_tables("cue_turns", VTT_CUES + "SELECT doc_id, 'WEBVTT' || chr(10) || chr(10) || string_agg(b, chr(10) ORDER BY cue_idx) AS text FROM vb GROUP BY 1"), sized="conversations")
def _(spark, sf):
    return _vtt(spark, sf)


@query("src_04_parse_vtt", with_tables("cue_turns", CLEAN + """
SELECT doc_id, CASE WHEN cue_idx % 3 > 0 THEN cue_id END AS cue_id, start_ms, end_ms, text, speaker_id AS speaker, CASE WHEN cue_idx % 2 = 0 THEN 'loud' END AS style, 'line:' || cue_idx AS settings FROM ct
UNION ALL SELECT DISTINCT doc_id, 'NOTE', NULL, NULL, 'made by hand', NULL, NULL, NULL FROM ct"""), sized="conversations")
def _(spark, sf):
    docs = _vtt(spark, sf).withColumn("text", F.regexp_replace("text", "^WEBVTT\n", "WEBVTT demo\nKind: captions\n\nNOTE made by hand\n"))
    cues, notes = K.parse_vtt(docs)
    columns = ["doc_id", "cue_id", "start_ms", "end_ms", "text", "speaker", "style", "settings"]
    blocks = notes.selectExpr("doc_id", "type AS cue_id", "CAST(NULL AS BIGINT) AS start_ms", "CAST(NULL AS BIGINT) AS end_ms", "text",
                              "CAST(NULL AS STRING) AS speaker", "CAST(NULL AS STRING) AS style", "CAST(NULL AS STRING) AS settings")
    return cues.select(*columns).unionByName(blocks)


def _cs(ms: str) -> str:
    cs = f"(({ms} + 5) // 10)"
    return f"printf('%d:%02d:%02d.%02d', {cs} // 360000, {cs} % 360000 // 6000, {cs} % 6000 // 100, {cs} % 100)"


ASS_HEAD = "\r\n".join(["[Script Info]", "ScriptType: v4.00+", "", "[V4+ Styles]", "Format: " + ", ".join(K.ASS_STYLE_FIELDS), "Style: " + K.DEFAULT_STYLE, "", "[Events]", "Format: " + ", ".join(K.ASS_EVENT_FIELDS), ""])
_HEAD_SQL = "'" + ASS_HEAD.replace("\r\n", "' || chr(13) || chr(10) || '") + "'"


def _ass(spark, sf):
    cues = _cues(spark, sf).withColumns({"speaker": F.col("speaker_id"), "tags": F.expr("IF(cue_idx % 2 = 0, '{\\\\fad(100,200)\\\\b1}', '')")})
    return K.write_ass(cues)


@query("src_09_write_ass", with_tables("cue_turns", CLEAN + f"""
SELECT doc_id, {_HEAD_SQL} || string_agg('Dialogue: 0,' || {_cs('start_ms')} || ',' || {_cs('end_ms')} || ',Default,' || speaker_id || ',0,0,0,,' ||
  CASE WHEN cue_idx % 2 = 0 THEN '{{\\fad(100,200)\\b1}}' ELSE '' END || replace(replace(replace(replace(text, '\\', '\\\\'), '{{', '\\{{'), '}}', '\\}}'), chr(10), '\\N'), chr(13) || chr(10) ORDER BY cue_idx) || chr(13) || chr(10) AS text FROM ct GROUP BY 1"""), sized="conversations")
def _(spark, sf):
    return _ass(spark, sf)


@query("src_05_parse_ass", with_tables("cue_turns", CLEAN + """
SELECT doc_id, 'Dialogue' AS event_type, (start_ms + 5) // 10 * 10 AS start_ms, (end_ms + 5) // 10 * 10 AS end_ms, text, speaker_id AS speaker, 'Default' AS style FROM ct
UNION ALL SELECT DISTINCT doc_id, 'Style', NULL, NULL, 'Arial', NULL, 'Default' FROM ct UNION ALL SELECT DISTINCT doc_id, 'Info', NULL, NULL, 'v4.00+', NULL, 'ScriptType' FROM ct"""), sized="conversations")
def _(spark, sf):
    lines = K.ass_lines(_ass(spark, sf))
    nothing = "CAST(NULL AS BIGINT) AS start_ms", "CAST(NULL AS BIGINT) AS end_ms"
    styles = K.ass_styles(lines).selectExpr("doc_id", "'Style' AS event_type", *nothing, "font_name AS text", "CAST(NULL AS STRING) AS speaker", "name AS style")
    info = K.ass_script_info(lines).selectExpr("doc_id", "'Info' AS event_type", *nothing, "value AS text", "CAST(NULL AS STRING) AS speaker", "key AS style")
    events = K.ass_events(lines).select("doc_id", "event_type", "start_ms", "end_ms", "text", "speaker", "style")
    return events.unionByName(styles).unionByName(info)


@query("src_06_ass_overrides", with_tables("cue_turns", CLEAN + """
SELECT doc_id, cue_idx, (cue_idx * 100)::DOUBLE AS fade_in_ms, (cue_idx + 12.5)::DOUBLE AS pos_x, (-cue_idx)::DOUBLE AS pos_y, cue_idx % 2 = 1 AS bold, (20 + cue_idx)::DOUBLE AS font_size,
 '&H00FFFF' AS primary_color, 'Mono ' || cue_idx AS font_name, text || chr(10) || '{plain} x' AS text FROM ct"""))
def _(spark, sf):
    raw = _cues(spark, sf).withColumn("raw", F.concat(
        F.expr("concat('{\\\\fad(', cue_idx * 100, ', 50)\\\\pos(', cue_idx + 12.5, ',', -cue_idx, ')}{\\\\b', cue_idx % 2, '\\\\fs', 20 + cue_idx, '\\\\c&H00FFFF\\\\fnMono ', cue_idx, '}')"),
        K.escape_ass(F.col("text")), F.lit("\\N{\\an8}\\{plain\\} x")))
    tags = raw.withColumn("o", K.ass_overrides(F.col("raw")))
    return tags.select("doc_id", "cue_idx", "o.fade_in_ms", "o.pos_x", "o.pos_y", "o.bold", "o.font_size", "o.primary_color", "o.font_name", K.ass_decode(F.col("raw")).alias("text"))


@query("src_02_detect_format", """SELECT conv_id AS doc_id, turn, CASE turn % 3 WHEN 0 THEN 'vtt' WHEN 1 THEN 'ass' ELSE 'srt' END AS format FROM conversations""")
def _(spark, sf):
    docs = spark.read.parquet(f"{sf}/conversations.parquet").withColumn("body", F.expr(
        "concat(CASE turn % 3 WHEN 0 THEN '﻿  WEBVTT\n\n' WHEN 1 THEN '; note\n[Events]\n' ELSE '1\n' END, text)"))
    return docs.select(F.col("conv_id").alias("doc_id"), "turn", K.detect_format(F.col("body")).alias("format"))


@query("src_10_convert_dispatch", with_tables("cue_turns", CLEAN + """
SELECT doc_id, CASE WHEN doc_id % 3 = 2 THEN (start_ms + 5) // 10 * 10 ELSE start_ms END AS start_ms, CASE WHEN doc_id % 3 = 2 THEN (end_ms + 5) // 10 * 10 ELSE end_ms END AS end_ms, text FROM ct"""), sized="conversations")
def _(spark, sf):
    cues = _cues(spark, sf)
    files = [K.write_captions(cues.where(f"doc_id % 3 = {i}"), kind) for i, kind in enumerate(("srt", "vtt", "ass"))]
    # Written once, since each format's reader passes over all files, and dealt, since parsing is far more work than the bytes of the texts tell.
    docs = dealt(cut_lineage(files[0].unionByName(files[1]).unionByName(files[2])), ["doc_id"], TEXT_SHARE, meet=False)
    return K.parse_captions(docs).select("doc_id", "start_ms", "end_ms", "text")


@query("txt_07_caption_clocks", f"""
SELECT o_orderkey, {_clock('ms', ',')} AS srt, {_clock('ms', '.')} AS vtt, {_cs('ms')} AS ass, ms AS parsed, CASE WHEN ms % 3600000 // 60000 < 60 THEN ms % 3600000 END AS short_parsed
FROM (SELECT o_orderkey, CAST(floor(o_totalprice * 37) AS BIGINT) AS ms FROM orders)""")
def _(spark, sf):
    base = spark.read.parquet(f"{sf}/orders.parquet").select("o_orderkey", F.expr("CAST(floor(o_totalprice * 37) AS BIGINT) AS ms"))
    shown = base.select("o_orderkey", "ms", K.clock_text(F.col("ms")).alias("srt"), K.clock_text(F.col("ms"), ".").alias("vtt"), K.ass_clock_text(F.col("ms")).alias("ass"))
    return shown.select("o_orderkey", "srt", "vtt", "ass", K.clock_ms(F.col("srt")).alias("parsed"),
                        K.clock_ms(F.expr("substring(vtt, instr(vtt, ':') + 1)"), short=True).alias("short_parsed"))


@query("txt_09_ass_colors", """SELECT c_custkey, printf('&H00%02X%02X%02X', c_custkey % 251, c_custkey % 241, c_custkey % 239) AS css, CASE WHEN c_custkey % 5 > 0 THEN printf('&H%06X', c_custkey) END AS native,
 replace(c_name, '#', ' x') AS field FROM customer""")
def _(spark, sf):
    rows = spark.read.parquet(f"{sf}/customer.parquet")
    return rows.select(
        "c_custkey", K.ass_color(F.expr("format_string('#%02x%02x%02x', c_custkey % 239, c_custkey % 241, c_custkey % 251)")).alias("css"),
        K.ass_color(F.expr("IF(c_custkey % 5 > 0, format_string(' &h%06x& ', c_custkey), 'red')")).alias("native"),
        K.sanitize_ass_field(F.expr("replace(c_name, '#', ',\r\nx')")).alias("field"))


# --- words ------------------------------------------------------------------------


@query("prj_03_confidence_band", with_tables("words", "SELECT asset_id, CASE WHEN confidence < 0.72 THEN 'low' WHEN confidence < 0.86 THEN 'review' ELSE 'high' END AS band, count(*)::BIGINT AS n FROM words GROUP BY 1, 2"))
def _(spark, sf):
    return T.words(spark, sf).groupBy("asset_id", C.confidence_band(F.col("confidence")).alias("band")).agg(F.count("*").alias("n"))


BROKEN = """, bw AS (SELECT asset_id, word_idx, CASE WHEN word_idx % 97 = 5 THEN '  ' ELSE text END AS text, CASE WHEN word_idx % 89 = 7 THEN start_ms - 9000 ELSE start_ms END AS start_ms,
  CASE WHEN word_idx % 83 = 3 THEN start_ms - 1 ELSE end_ms END AS end_ms, confidence * 1.02 AS confidence FROM words)
, pv AS (SELECT *, lag(start_ms) OVER (PARTITION BY asset_id ORDER BY word_idx) AS p FROM bw)"""


@query("prj_04_validate_words", with_tables("words", BROKEN + """
SELECT asset_id, word_idx, 'text' AS field FROM pv WHERE trim(text) = '' UNION ALL SELECT asset_id, word_idx, 'timing' FROM pv WHERE start_ms < 0 OR end_ms < start_ms
UNION ALL SELECT asset_id, word_idx, 'confidence' FROM pv WHERE confidence > 1 UNION ALL SELECT asset_id, word_idx, 'order' FROM pv WHERE start_ms < p"""), sized="documents")
def _(spark, sf):
    broken = T.words(spark, sf).selectExpr(
        "asset_id", "word_idx", "IF(word_idx % 97 = 5, '  ', text) AS text", "IF(word_idx % 89 = 7, start_ms - 9000, start_ms) AS start_ms",
        "IF(word_idx % 83 = 3, start_ms - 1, end_ms) AS end_ms", "confidence * 1.02D AS confidence")
    return C.word_issues(broken)


@query("txt_01_tokenize", "SELECT doc_id, len(list_filter(string_split_regex(text, '\\s+'), lambda t: t <> ''))::BIGINT AS n, array_to_string(list_filter(string_split_regex(text, '\\s+'), lambda t: t <> ''), ' ') AS joined FROM documents")
def _(spark, sf):
    tokens = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", X.tokenize(F.col("text")).alias("t"))
    return tokens.select("doc_id", F.size("t").cast("long").alias("n"), F.array_join("t", " ").alias("joined"))


_NORM = "regexp_replace(lower(strip_accents({0})), '[^\\p{{L}}\\p{{N}}]+', '', 'g')"


@query("txt_02_normalized_token", with_tables("words", f"SELECT {_NORM.format('text')} AS token, count(*)::BIGINT AS n FROM words GROUP BY 1"))
def _(spark, sf):
    return T.words(spark, sf).groupBy(X.normalized_token(F.col("text")).alias("token")).agg(F.count("*").alias("n"))


_TURK = "regexp_replace(lower(translate({0}, 'Iİ', 'ıi')), '[^\\p{{L}}]', '', 'g')"


@query("txt_03_turkish_token", with_tables("words", f"SELECT {_TURK.format('text')} AS token, count(*)::BIGINT AS n FROM words GROUP BY 1"))
def _(spark, sf):
    return T.words(spark, sf).groupBy(X.turkish_token(F.col("text")).alias("token")).agg(F.count("*").alias("n"))


_SWAP = "CASE WHEN word_idx % 19 = 3 THEN 'Eee,' WHEN word_idx % 23 = 4 THEN 'YANİ' WHEN word_idx % 29 = 5 THEN 'hımm' WHEN word_idx % 31 = 6 THEN 'hm' ELSE text END"
_CTX = ", ".join(f"'{w}'" for w in L.CONTEXTUAL_WORDS)
_SOUNDS = ", ".join(f"'{w}'" for w in C.RECOGNISER_SOUNDS)
_FILL = f"CASE WHEN tk IN ({_CTX}) THEN 'contextual-word' WHEN regexp_matches(tk, '{L.FILLER_PATTERN}') THEN 'filler-word' END"


def _spoken(spark, sf):
    return T.words(spark, sf).withColumn("text", F.expr(_SWAP))


@query("txt_04_filler_class", with_tables("words", f""", sw AS (SELECT {_TURK.format('x')} AS tk FROM (SELECT {_SWAP} AS x FROM words))
SELECT {_FILL} AS planner, CASE WHEN regexp_matches(tk, '^(e{{2,10}}|ı{{2,10}})$') OR tk IN ({_SOUNDS}) THEN 'high-confidence' WHEN tk IN ({_CTX}) THEN 'contextual' END AS recogniser, count(*)::BIGINT AS n
FROM sw GROUP BY 1, 2"""))
def _(spark, sf):
    return _spoken(spark, sf).groupBy(C.filler_class(F.col("text")).alias("planner"), C.recogniser_filler_class(F.col("text")).alias("recogniser")).agg(F.count("*").alias("n"))


SUGGEST = f""", sw AS (SELECT asset_id, word_idx, start_ms, end_ms, confidence, x AS text, {_TURK.format('x')} AS tk FROM (SELECT *, {_SWAP} AS x FROM words))
, extra AS (SELECT asset_id, start_ms, end_ms, confidence FROM segments UNION ALL SELECT asset_id, end_ms + 300, end_ms + 700, confidence FROM segments)
, sg AS (SELECT asset_id, start_ms, max(end_ms) AS end_ms, max(confidence) AS confidence FROM extra GROUP BY 1, 2)
, nb AS (SELECT g.*, duration_ms, lag(g.end_ms) OVER w AS pe, lag(g.confidence) OVER w AS pc, lead(g.start_ms) OVER w AS ns FROM sg g JOIN assets USING (asset_id) WINDOW w AS (PARTITION BY asset_id ORDER BY g.start_ms))
, sil AS (SELECT asset_id, CASE WHEN pe IS NULL THEN 0 ELSE least(duration_ms, pe + 160) END AS s, greatest(0, start_ms - 120) AS e, least(confidence, coalesce(pc, confidence)) AS c FROM nb
  UNION ALL SELECT asset_id, least(duration_ms, end_ms + 160), duration_ms, confidence FROM nb WHERE ns IS NULL)
SELECT asset_id, s AS start_ms, e AS end_ms, 'silence' AS kind, round(c, 6) AS confidence, true AS default_selected, 'silence:' || s || ':' || e || ':gap' AS suggestion_id FROM sil WHERE e - s >= 700
UNION ALL SELECT asset_id, s, e, kind, round(confidence * CASE WHEN kind = 'contextual-word' THEN 0.65 ELSE 1 END, 6), kind = 'filler-word' AND confidence >= 0.72, kind || ':' || s || ':' || e || ':' || left(tk, 20)
  FROM (SELECT sw.*, {_FILL} AS kind, greatest(0, start_ms - 60) AS s, least(duration_ms, end_ms + 60) AS e FROM sw JOIN assets USING (asset_id)) WHERE kind IS NOT NULL
UNION ALL SELECT asset_id, start_ms, end_ms, 'possible-filler-sound', round(confidence * 0.65, 6), false, 'possible-filler-sound:' || start_ms || ':' || end_ms || ':gap' FROM sg
  WHERE end_ms - start_ms BETWEEN 180 AND 1200 AND NOT EXISTS (SELECT 1 FROM words w WHERE w.asset_id = sg.asset_id AND w.end_ms > sg.start_ms AND w.start_ms < sg.end_ms)"""


@query("win_08_edit_suggestions", with_tables("words segments assets", SUGGEST), sized="documents")
def _(spark, sf):
    extra = T.segments(spark, sf).selectExpr(
        "asset_id", "explode(array(struct(start_ms, end_ms), struct(end_ms + 300 AS start_ms, end_ms + 700 AS end_ms))) AS s", "confidence"
    ).select("asset_id", "s.*", "confidence")
    out = C.edit_suggestions(extra, _spoken(spark, sf), T.assets(spark, sf))
    return out.select("asset_id", "start_ms", "end_ms", "kind", F.round("confidence", 6).alias("confidence"), "default_selected", "suggestion_id")


# --- dictionary ----------------------------------------------------------------------


def _dictionary(spark, sf):
    """Terms made from benchmark texts: a misspelt first word, and a phrase of two words as variant."""
    return spark.read.parquet(f"{sf}/benchmark.parquet").withColumn("t", F.expr("filter(split(text, '\\\\s+'), x -> x <> '')")).where("size(t) > 4").selectExpr(
        "concat('e', item_id) AS entry_id", "item_id AS entry_ord", "concat(t[0], 'xq') AS canonical", "array(concat(t[2], ' ', t[3]), t[4]) AS variants",
        "'term' AS category", "IF(item_id % 3 = 0, 'tr', 'en') AS language")


# The oracle's edit distance counts bytes, so letters that stay outside ASCII get a one-byte stand-in.
_COMPACT = "translate(regexp_replace(lower(strip_accents({0})), '[^\\p{{L}}\\p{{N}}]+', '', 'g'), 'ßœæø', '#$%&')"
_SPACED = "translate(trim(regexp_replace(regexp_replace(lower(strip_accents({0})), '[^\\p{{L}}\\p{{N}}\\s]+', '', 'g'), '\\s+', ' ', 'g')), 'ßœæø', '#$%&')"
DICT = f""", dt AS (SELECT item_id, list_filter(string_split_regex(text, '\\s+'), lambda x: x <> '') AS t FROM benchmark)
, fm0 AS (SELECT item_id AS entry_ord, t[1] || 'xq' AS canonical, CASE WHEN item_id % 3 = 0 THEN 'tr' ELSE 'en' END AS language, list_distinct([t[1] || 'xq', t[3] || ' ' || t[4], t[5]]) AS d, [t[1] || 'xq', t[3] || ' ' || t[4], t[5]] AS fl FROM dt WHERE len(t) > 4)
, fm1 AS (SELECT *, unnest(fl) AS form, unnest([0, 1, 2]) AS o FROM fm0)
, fm AS (SELECT entry_ord, canonical, language, form, min(o) AS form_ord, CASE WHEN min(o) = 1 THEN 2 ELSE 1 END AS fw, any_value({_SPACED.format('form')}) AS fs, any_value({_COMPACT.format('form')}) AS fc FROM fm1 GROUP BY 1, 2, 3, 4)
, w1 AS (SELECT asset_id, row_number() OVER (PARTITION BY asset_id ORDER BY word_idx) - 1 AS i, text, lead(text) OVER w AS t2, lead(text, 2) OVER w AS t3 FROM words WINDOW w AS (PARTITION BY asset_id ORDER BY word_idx))
, rn AS (SELECT asset_id, i, 1 AS n, text AS x FROM w1 UNION ALL SELECT asset_id, i, 2, text || ' ' || t2 FROM w1 WHERE t2 IS NOT NULL UNION ALL SELECT asset_id, i, 3, text || ' ' || t2 || ' ' || t3 FROM w1 WHERE t3 IS NOT NULL)
, tx AS (SELECT x, n, {_SPACED.format('x')} AS xs, {_COMPACT.format('x')} AS xc FROM rn GROUP BY 1, 2)
, mt AS (SELECT x, n, entry_ord, form_ord, canonical, language, d FROM (SELECT tx.*, fm.*, least(
    CASE WHEN abs(len(xs) - len(fs)) > 0.34 * greatest(len(xs), len(fs), 1) THEN 9 ELSE levenshtein(xs, fs) / greatest(len(xs), len(fs), 1)::DOUBLE END,
    CASE WHEN abs(len(xc) - len(fc)) > 0.34 * greatest(len(xc), len(fc), 1) THEN 9 ELSE levenshtein(xc, fc) / greatest(len(xc), len(fc), 1)::DOUBLE END) AS d
  FROM tx JOIN fm ON n BETWEEN greatest(1, fw - 1) AND fw + 1 AND x <> canonical AND abs(len(xc) - len(fc)) <= 6) WHERE d <= 0.34 AND NOT (len(xc) < 3 AND d > 0))
, hit AS (SELECT asset_id, i AS first_idx, rn.n AS n_words, x AS input_text, entry_ord, form_ord, canonical, language, d FROM rn JOIN mt USING (x, n))"""


@query("join_16_fuzzy_dictionary", with_tables("words", DICT + "SELECT asset_id, first_idx, n_words::BIGINT AS n_words, input_text, canonical, form_ord::BIGINT AS form_ord, round(1 - d, 6) AS score FROM hit"), sized="documents")
def _(spark, sf):
    out = C.dictionary_matches(T.words(spark, sf), _dictionary(spark, sf))
    return out.select("asset_id", "first_idx", F.col("n_words").cast("long").alias("n_words"), "input_text", "canonical", F.col("form_ord").cast("long").alias("form_ord"), F.expr("round(1 - distance, 6) AS score"))


PICK = DICT + """, rk AS (SELECT *, first_idx + n_words AS til, row_number() OVER (PARTITION BY asset_id ORDER BY d, n_words DESC, first_idx, entry_ord, form_ord) AS r FROM hit)
, wk AS (SELECT DISTINCT asset_id, 0::BIGINT AS k, []::BIGINT[] AS occ, NULL::BIGINT AS got FROM rk UNION ALL
  SELECT w.asset_id, w.k + 1, CASE WHEN list_has_any(w.occ, range(r.first_idx, r.til)) THEN w.occ ELSE list_concat(w.occ, range(r.first_idx, r.til)) END,
   CASE WHEN list_has_any(w.occ, range(r.first_idx, r.til)) THEN NULL ELSE r.r END FROM wk w JOIN rk r ON r.asset_id = w.asset_id AND r.r = w.k + 1)
, sel AS (SELECT rk.* FROM rk JOIN wk ON wk.asset_id = rk.asset_id AND wk.got = rk.r)"""


@query("top_01_span_selection", with_tables("words", PICK + "SELECT asset_id, first_idx, n_words::BIGINT AS n_words, input_text, canonical, round(1 - d, 6) AS score FROM sel", recursive=True), sized="documents")
def _(spark, sf):
    out = C.select_suggestions(C.dictionary_matches(T.words(spark, sf), _dictionary(spark, sf)))
    return out.select("asset_id", "first_idx", F.col("n_words").cast("long").alias("n_words"), "input_text", "canonical", F.round("score", 6).alias("score"))


LANG = """, cov AS (SELECT asset_id, i + unnest(range(0, rn.n)) AS word_idx, language, entry_ord, form_ord FROM rn JOIN tx USING (x, n) JOIN fm ON xc = fc AND n BETWEEN greatest(1, fw - 1) AND fw + 1)
, dl AS (SELECT asset_id, word_idx, arg_max(language, (entry_ord, form_ord)) AS dict_language FROM cov GROUP BY 1, 2)"""


def _ranked_words(spark, sf):
    """Words renumbered without holes, as runs count them."""
    from cuelattice.kernel.scan import Running, running

    words = T.words(spark, sf)
    return running(words, ["asset_id"], ["word_idx"], [Running("__rn", "count", F.lit(1))], F.expr("word_idx DIV 100000")).withColumn(
        "word_idx", F.col("__rn") - 1).drop("__rn")


@query("join_17_dictionary_language", with_tables("words", DICT + LANG + "SELECT asset_id, word_idx, dict_language FROM dl"), sized="documents")
def _(spark, sf):
    return C.dictionary_languages(_ranked_words(spark, sf), _dictionary(spark, sf))


_TRL, _ENL = (", ".join(f"'{w}'" for w in words) for words in (L.TURKISH_LEXICON, L.ENGLISH_LEXICON))
MARK = f""", wl AS (SELECT w.asset_id, row_number() OVER (PARTITION BY w.asset_id ORDER BY w.word_idx) - 1 AS word_idx, w.text, w.confidence, {_NORM.format('w.text')} AS tk FROM words w)
, mk AS (SELECT wl.*, dict_language, tk IN ({_TRL}) AS tr, tk IN ({_ENL}) AS en, regexp_matches(text, '[çğıöşüÇĞÖŞÜ]') AS lt FROM wl LEFT JOIN dl USING (asset_id, word_idx))
, lb AS (SELECT *, coalesce(dict_language, CASE WHEN tr <> en THEN CASE WHEN en THEN 'en' ELSE 'tr' END END, CASE WHEN lt THEN 'tr' END, 'en') AS label,
   CASE WHEN dict_language IS NOT NULL THEN 'dictionary' WHEN tr <> en THEN 'lexicon' WHEN lt THEN 'heuristic' ELSE 'inherited' END AS source FROM mk)"""


@query("txt_05_code_switch", with_tables("words", DICT + LANG + MARK + "SELECT asset_id, label, source, label <> 'en' AS is_code_switch, count(*)::BIGINT AS n, sum(word_idx)::BIGINT AS idx_sum FROM lb GROUP BY 1, 2, 3, 4"), sized="documents")
def _(spark, sf):
    words = _ranked_words(spark, sf)
    marked = C.code_switch(words, C.dictionary_languages(words, _dictionary(spark, sf)), "en")
    return marked.groupBy("asset_id", "label", "source", "is_code_switch").agg(F.count("*").alias("n"), F.sum("word_idx").alias("idx_sum"))


@query("agg_02_word_quality", with_tables("words", PICK + LANG + MARK + """, cv AS (SELECT asset_id, unnest(range(first_idx, til)) AS word_idx, canonical FROM sel)
SELECT lb.asset_id, CASE WHEN confidence < 0.72 THEN 'low' WHEN confidence < 0.86 THEN 'review' ELSE 'high' END AS band, confidence < 0.86 OR canonical IS NOT NULL AS needs_review, label, count(*)::BIGINT AS n,
 count(canonical)::BIGINT AS suggested FROM lb LEFT JOIN cv USING (asset_id, word_idx) GROUP BY 1, 2, 3, 4""", recursive=True), sized="documents")
def _(spark, sf):
    quality = C.word_quality(_ranked_words(spark, sf), _dictionary(spark, sf), "en")
    return quality.groupBy("asset_id", "band", "needs_review", "label").agg(F.count("*").alias("n"), F.count("suggestion").alias("suggested"))


@query("agg_01_qa_summary", with_tables("words cue_turns", PICK + LANG + MARK + """, cv AS (SELECT asset_id, unnest(range(first_idx, til)) AS word_idx, canonical FROM sel)
, qs AS (SELECT lb.asset_id, count(*) AS word_count, count(*) FILTER (confidence < 0.86 OR canonical IS NOT NULL) AS review_count, count(*) FILTER (confidence < 0.72) AS low_count, count(*) FILTER (label <> 'en') AS switch_count FROM lb LEFT JOIN cv USING (asset_id, word_idx) GROUP BY 1)
, sc AS (SELECT asset_id, count(*) AS suggestion_count FROM sel GROUP BY 1)
, cu AS (SELECT doc_id AS asset_id, count(*) AS cue_count, count(*) FILTER (cue_idx % 2 = 1) AS missing_translation_count FROM cue_turns GROUP BY 1)
SELECT asset_id, word_count::BIGINT AS word_count, review_count::BIGINT AS review_count, low_count::BIGINT AS low_count, switch_count::BIGINT AS switch_count, coalesce(suggestion_count, 0)::BIGINT AS suggestion_count,
 coalesce(cue_count, 0)::BIGINT AS cue_count, coalesce(missing_translation_count, 0)::BIGINT AS missing_translation_count FROM qs LEFT JOIN sc USING (asset_id) LEFT JOIN cu USING (asset_id)""", recursive=True), sized="documents conversations")
def _(spark, sf):
    words, terms = _ranked_words(spark, sf), _dictionary(spark, sf)
    # Two branches read the suggestions.
    chosen = cut_lineage(C.select_suggestions(C.dictionary_matches(words, terms)).select("asset_id", "first_idx", "last_idx", "canonical"))
    quality = C.word_quality(words, terms, "en", chosen).groupBy("asset_id").agg(
        F.count("*").alias("word_count"), F.expr("count_if(needs_review) AS review_count"), F.expr("count_if(band = 'low') AS low_count"),
        F.expr("count_if(is_code_switch) AS switch_count"))
    suggestions = chosen.groupBy("asset_id").agg(F.count("*").alias("suggestion_count"))
    cues = T.cue_turns(spark, sf)
    shown = C.bilingual_cues(cues, cues.where("cue_idx % 2 = 0").select("doc_id", "cue_id", "text")).groupBy(F.col("doc_id").alias("asset_id")).agg(
        F.count("*").alias("cue_count"), F.expr("count_if(translation_missing) AS missing_translation_count"))
    out = quality.join(suggestions, ["asset_id"], "left").join(shown, ["asset_id"], "left")
    return out.na.fill(0, ["suggestion_count", "cue_count", "missing_translation_count"])


# --- cues ----------------------------------------------------------------------------


CUES = """, n AS (SELECT *, row_number() OVER (PARTITION BY asset_id ORDER BY start_ms, word_idx) AS i FROM words)
, st AS (SELECT asset_id, i, start_ms AS f, end_ms AS e, speaker_id AS sp, 1 AS c, 1 AS g FROM n WHERE i = 1 UNION ALL
 SELECT n.asset_id, n.i, CASE WHEN x THEN n.start_ms ELSE f END, n.end_ms, n.speaker_id, CASE WHEN x THEN 1 ELSE c + 1 END, CASE WHEN x THEN g + 1 ELSE g END
 FROM (SELECT st.*, n.asset_id AS a2, n.i AS i2, n.start_ms, n.end_ms, n.speaker_id, n.i AS ni, st.sp <> n.speaker_id OR n.start_ms - st.e > 900 OR n.end_ms - st.f > 6000 OR st.c >= 14 AS x
   FROM st JOIN n ON n.asset_id = st.asset_id AND n.i = st.i + 1) q JOIN n ON n.asset_id = q.a2 AND n.i = q.i2)
SELECT n.asset_id, 'speaker-cue-' || g AS cue_id, min(n.start_ms) AS start_ms, max(n.end_ms) AS end_ms, any_value(n.speaker_id) AS speaker_id, count(*)::BIGINT AS n_words, string_agg(n.text, ' ' ORDER BY n.i) AS text
FROM st JOIN n ON n.asset_id = st.asset_id AND n.i = st.i GROUP BY n.asset_id, g"""


@query("win_07_cue_building", with_tables("words", CUES, recursive=True), sized="documents")
def _(spark, sf):
    return C.build_cues(T.words(spark, sf)).select("asset_id", "cue_id", "start_ms", "end_ms", "speaker_id", "n_words", "text")


LANES = """, oc AS (SELECT doc_id, cue_idx, start_ms, end_ms + 9000 AS end_ms, row_number() OVER (PARTITION BY doc_id ORDER BY start_ms, end_ms, cue_idx) AS i FROM cue_turns)
, ln AS (SELECT doc_id, 1::BIGINT AS i, cue_idx, [end_ms] AS lanes, 0::BIGINT AS lane FROM oc WHERE i = 1 UNION ALL
 SELECT doc_id, i, cue_idx, list_concat(lanes[:p - 1], [end_ms], lanes[p + 1:]), p - 1 FROM (SELECT oc.doc_id, oc.i, oc.cue_idx, oc.end_ms, ln.lanes,
   coalesce(list_min(list_filter(range(1, len(ln.lanes) + 1), lambda z: ln.lanes[z] <= oc.start_ms)), len(ln.lanes) + 1) AS p FROM ln JOIN oc ON oc.doc_id = ln.doc_id AND oc.i = ln.i + 1))
SELECT doc_id, cue_idx, lane FROM ln"""


@query("win_28_lane_packing", with_tables("cue_turns", LANES, recursive=True), sized="conversations")
def _(spark, sf):
    return C.pack_lanes(T.cue_turns(spark, sf).withColumn("end_ms", F.col("end_ms") + 9000))


@query("win_29_spoken_only", with_tables("words", """, m AS (SELECT asset_id, word_idx, CASE word_idx % 11 WHEN 3 THEN '(' || text WHEN 5 THEN text || ')' ELSE text END AS t FROM words WHERE NOT regexp_matches(text, '[][(){}*♪♫]'))
, c AS (SELECT *, sum(CASE WHEN word_idx % 11 = 3 THEN 1 ELSE 0 END) OVER (PARTITION BY asset_id ORDER BY word_idx) AS op, row_number() OVER (PARTITION BY asset_id ORDER BY word_idx) AS i FROM m)
, d AS (SELECT asset_id, i, word_idx, CASE WHEN word_idx % 11 = 3 THEN 1 ELSE 0 END AS depth, word_idx % 11 <> 3 AS keep FROM c WHERE i = 1 UNION ALL
 SELECT c.asset_id, c.i, c.word_idx, CASE WHEN c.word_idx % 11 = 3 THEN d.depth + 1 WHEN c.word_idx % 11 = 5 THEN greatest(d.depth - 1, 0) ELSE d.depth END, d.depth = 0 AND c.word_idx % 11 <> 3 FROM d JOIN c ON c.asset_id = d.asset_id AND c.i = d.i + 1)
SELECT asset_id, word_idx, t AS text FROM d JOIN m USING (asset_id, word_idx) WHERE keep AND regexp_matches(t, '[\\p{L}\\p{N}]')""", recursive=True), sized="documents")
def _(spark, sf):
    words = T.words(spark, sf).where("NOT text RLIKE '[\\\\[\\\\](){}*♪♫]'").withColumn(
        "text", F.expr("CASE word_idx % 11 WHEN 3 THEN concat('(', text) WHEN 5 THEN concat(text, ')') ELSE text END"))
    return C.spoken_only(words)


TOKENS = """, al AS (SELECT asset_id, word_idx, text, start_ms, end_ms, confidence, length(text) // 2 AS h FROM words WHERE regexp_matches(text, '^[A-Za-z]{4,}$'))
SELECT asset_id, word_idx // 17 AS segment_idx, row_number() OVER (PARTITION BY asset_id, word_idx // 17 ORDER BY word_idx) AS word_no, text, start_ms, end_ms,
 round((confidence * h + (1 - confidence) * (length(text) - h)) / length(text), 6) AS confidence FROM al"""


@query("agg_10_token_words", with_tables("words", TOKENS), sized="documents")
def _(spark, sf):
    """Each plain word is cut into a leading token and a continuation, plus a special token that must vanish."""
    words = T.words(spark, sf).where("text RLIKE '^[A-Za-z]{4,}$'").withColumn("h", F.expr("length(text) DIV 2"))
    tokens = words.selectExpr(
        "asset_id", "word_idx DIV 17 AS segment_idx", "0L AS segment_from", "10000L AS segment_to",
        "explode(array(struct(word_idx * 3 AS token_idx, concat(' ', left(text, CAST(h AS INT))) AS raw, start_ms AS from_ms, start_ms + 100 AS to_ms, confidence AS p), "
        "struct(word_idx * 3 + 1 AS token_idx, substring(text, CAST(h AS INT) + 1) AS raw, start_ms + 100 AS from_ms, end_ms AS to_ms, 1 - confidence AS p), "
        "struct(word_idx * 3 + 2 AS token_idx, ' [noise]' AS raw, 0L AS from_ms, 99999999L AS to_ms, 1.0D AS p))) AS k"
    ).select("asset_id", "segment_idx", "segment_from", "segment_to", "k.*")
    return C.words_from_tokens(tokens).withColumn("confidence", F.round("confidence", 6))


@query("agg_11_transcript", with_tables("words", """SELECT asset_id, seg_idx, substr(string_agg(CASE WHEN regexp_matches(t, '[\\p{L}\\p{N}]') THEN ' ' || t ELSE t END, '' ORDER BY word_idx),
  CASE WHEN regexp_matches(arg_min(t, word_idx), '[\\p{L}\\p{N}]') THEN 2 ELSE 1 END) AS transcript FROM (SELECT asset_id, word_idx // 17 AS seg_idx, word_idx, CASE WHEN word_idx % 13 = 4 THEN '!?' ELSE text END AS t FROM words) GROUP BY 1, 2"""))
def _(spark, sf):
    words = T.words(spark, sf).selectExpr("asset_id", "word_idx DIV 17 AS seg_idx", "word_idx", "IF(word_idx % 13 = 4, '!?', text) AS text")
    return C.transcript(words, ["asset_id", "seg_idx"], ["word_idx"])


@query("agg_21_dominant_speaker", with_tables("words", """, c AS (SELECT asset_id, word_idx // 40 AS block, speaker_id, count(*) AS n, min(word_idx) AS f FROM words GROUP BY 1, 2, 3)
SELECT asset_id, block, arg_max(speaker_id, (n, -f)) AS speaker_id FROM c GROUP BY 1, 2"""))
def _(spark, sf):
    return C.dominant_speaker(T.words(spark, sf).withColumn("block", F.expr("word_idx DIV 40")), ["asset_id", "block"])


BI = ", tr AS (SELECT doc_id, cue_id, concat('T:', text) AS text FROM cue_turns WHERE cue_idx % 2 = 0)"


@query("join_06_bilingual_cues", with_tables("cue_turns", BI + """
SELECT c.doc_id, c.cue_id, trim(c.text) AS source_text, coalesce(trim(t.text), '') AS translated_text, CASE WHEN t.text IS NULL THEN trim(c.text) ELSE trim(t.text) || ' / ' || trim(c.text) END AS display_text, t.text IS NULL AS translation_missing
FROM cue_turns c LEFT JOIN tr t USING (doc_id, cue_id)"""), sized="conversations")
def _(spark, sf):
    cues = T.cue_turns(spark, sf)
    translated = cues.where("cue_idx % 2 = 0").selectExpr("doc_id", "cue_id", "concat('T:', text) AS text")
    return C.bilingual_cues(cues, translated, "translation-first", " / ").select(
        "doc_id", "cue_id", F.trim("text").alias("source_text"), "translated_text", "display_text", "translation_missing")


@query("join_07_display_cues", with_tables("cue_turns", BI + """
SELECT c.doc_id, c.cue_id, CASE WHEN t.text IS NULL THEN trim(c.text) ELSE trim(c.text) || chr(10) || trim(t.text) END AS text, t.text IS NULL AS translation_missing FROM cue_turns c LEFT JOIN tr t USING (doc_id, cue_id)"""), sized="conversations")
def _(spark, sf):
    cues = T.cue_turns(spark, sf)
    translated = cues.where("cue_idx % 2 = 0").selectExpr("doc_id", "cue_id", "concat('T:', text) AS text")
    return C.display_cues(cues, translated, True).select("doc_id", "cue_id", "text", "translation_missing")


@query("prj_13_import_cues", with_tables("cue_turns", """
, w AS (SELECT doc_id, cue_idx, CASE WHEN cue_idx % 2 = 0 THEN 'scene' ELSE cue_id END AS want, CASE WHEN cue_idx % 3 = 0 THEN upper(speaker_id) ELSE ' ' || speaker_id || ' ' END AS sp FROM cue_turns)
, r AS (SELECT *, row_number() OVER (PARTITION BY doc_id, want ORDER BY cue_idx) AS k FROM w)
, s AS (SELECT doc_id, lower(translate(trim(sp), 'Iİ', 'ıi')) AS key, min(cue_idx) AS f FROM w GROUP BY 1, 2), sn AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY f) AS n FROM s)
SELECT r.doc_id, r.cue_idx, CASE WHEN k = 1 THEN want ELSE want || '-' || k END AS cue_id, 'speaker-' || n AS speaker_id FROM r JOIN sn ON sn.doc_id = r.doc_id AND sn.key = lower(translate(trim(r.sp), 'Iİ', 'ıi'))"""), sized="conversations")
def _(spark, sf):
    cues = T.cue_turns(spark, sf).selectExpr(
        "doc_id", "cue_idx", "IF(cue_idx % 2 = 0, ' scene ', cue_id) AS cue_id", "IF(cue_idx % 3 = 0, upper(speaker_id), concat(' ', speaker_id, ' ')) AS speaker")
    named = C.unique_ids(cues, ["doc_id"], "cue_idx", "cue_id", "cue-")
    people = C.speaker_ids(cues)
    keyed = named.withColumn("speaker_key", F.lower(F.translate(F.trim("speaker"), "Iİ", "ıi")))
    return keyed.join(people, ["doc_id", "speaker_key"]).select("doc_id", "cue_idx", "cue_id", "speaker_id")


@query("prj_14_normalize_cues", with_tables("cue_turns", """
SELECT doc_id, cue_idx, CASE WHEN row_number() OVER (PARTITION BY doc_id ORDER BY cue_idx) = 1 THEN 'x' ELSE 'x-' || row_number() OVER (PARTITION BY doc_id ORDER BY cue_idx) END AS cue_id,
 greatest(0, start_ms - 500) AS start_ms, greatest(greatest(0, start_ms - 500) + 1, end_ms - 4000) AS end_ms FROM cue_turns WHERE cue_idx % 5 <> 3"""), sized="conversations")
def _(spark, sf):
    cues = T.cue_turns(spark, sf).selectExpr("doc_id", "cue_idx", "'x' AS cue_id", "IF(cue_idx % 5 = 3, NULL, start_ms - 500) AS start_ms", "end_ms - 4000 AS end_ms", "text")
    valid = cues.where("cue_id <> '' AND start_ms IS NOT NULL AND end_ms IS NOT NULL").selectExpr(
        "doc_id", "cue_idx", "cue_id", "greatest(0L, start_ms) AS start_ms", "end_ms").withColumn("end_ms", F.expr("greatest(start_ms + 1, end_ms)"))
    return C.unique_ids(valid, ["doc_id"], "cue_idx", "cue_id", "cue-").select("doc_id", "cue_idx", "cue_id", "start_ms", "end_ms")


@query("prj_15_spread_words", with_tables("cue_turns", """, k AS (SELECT *, list_filter(string_split_regex(text, '\\s+'), lambda x: x <> '') AS t FROM cue_turns)
, e AS (SELECT doc_id, cue_id, start_ms, end_ms, len(t) AS n, unnest(t) AS text, unnest(range(0, len(t))) AS word_idx FROM k)
SELECT doc_id, cue_id, word_idx, text, floor(start_ms + greatest(1, end_ms - start_ms) * word_idx / n::DOUBLE + 0.5)::BIGINT AS start_ms, floor(start_ms + greatest(1, end_ms - start_ms) * (word_idx + 1) / n::DOUBLE + 0.5)::BIGINT AS end_ms FROM e"""), sized="conversations")
def _(spark, sf):
    return C.spread_words(T.cue_turns(spark, sf))


@query("prj_16_filter_cues", with_tables("cue_turns", BI + """
SELECT c.doc_id, c.cue_id FROM cue_turns c LEFT JOIN tr t USING (doc_id, cue_id) WHERE start_ms < 60000 AND end_ms > 2000 AND contains(lower(concat_ws(' ', c.text, t.text, c.speaker_id)), 'use') AND t.text IS NULL"""), sized="conversations")
def _(spark, sf):
    cues = T.cue_turns(spark, sf).where("start_ms < 60000 AND end_ms > 2000")
    translated = T.cue_turns(spark, sf).where("cue_idx % 2 = 0").selectExpr("doc_id", "cue_id", "concat('T:', text) AS text")
    shown = C.bilingual_cues(cues, translated)
    return shown.where("contains(lower(concat_ws(' ', text, translated_text, speaker_id)), 'use') AND translation_missing").select("doc_id", "cue_id")


@query("prj_18_reassign_speaker", with_tables("cue_turns", "SELECT doc_id, cue_id, CASE WHEN cue_idx % 3 = 0 THEN 'guest' WHEN cue_idx % 3 = 1 THEN NULL ELSE speaker_id END AS speaker_id FROM cue_turns"), sized="conversations")
def _(spark, sf):
    cues = T.cue_turns(spark, sf)
    edits = cues.where("cue_idx % 3 < 2").selectExpr("doc_id", "cue_id", "IF(cue_idx % 3 = 0, 'guest', NULL) AS new_speaker", "true AS edited")
    return cues.join(edits, ["doc_id", "cue_id"], "left").selectExpr("doc_id", "cue_id", "IF(edited, new_speaker, speaker_id) AS speaker_id")


@query("prj_19_upsert_translation", with_tables("cue_turns", BI + """
SELECT doc_id, cue_id, CASE WHEN cue_idx % 4 = 2 THEN 'U:' || text ELSE 'T:' || text END AS text FROM cue_turns WHERE cue_idx % 2 = 0 AND cue_idx % 4 <> 0 OR cue_idx % 4 = 0 AND false"""), sized="conversations")
def _(spark, sf):
    cues = T.cue_turns(spark, sf)
    base = cues.where("cue_idx % 2 = 0").selectExpr("doc_id", "cue_id", "concat('T:', text) AS text")
    edits = cues.where("cue_idx % 2 = 0").selectExpr("doc_id", "cue_id", "explode(array(struct(0 AS edit_no, 'draft' AS text), struct(1 AS edit_no, IF(cue_idx % 4 = 0, '  ', concat('U:', text)) AS text))) AS e").select("doc_id", "cue_id", "e.*")
    return C.upsert_translations(base, edits)


@query("prj_20_dictionary_entries", "SELECT item_id, trim(list_filter(string_split_regex(text, '\\s+'), lambda x: x <> '')[1]) AS canonical, array_to_string(list_filter(list_transform(string_split_regex(text, '[,;\\n]'), lambda x: trim(x)), lambda x: x <> ''), '|') AS variants FROM benchmark")
def _(spark, sf):
    return spark.read.parquet(f"{sf}/benchmark.parquet").selectExpr(
        "item_id", "trim(filter(split(text, '\\\\s+'), x -> x <> '')[0]) AS canonical", "array_join(filter(transform(split(text, '[,;\\\\n]'), x -> trim(x)), x -> x <> ''), '|') AS variants")


@query("join_21_caption_round_trip", with_tables("cue_turns", """
SELECT doc_id, cue_id, start_ms + 100 AS start_ms, CASE WHEN cue_idx % 2 = 0 THEN 'Default' END AS style, 'Label ' || speaker_id AS speaker, text FROM cue_turns"""), sized="conversations")
def _(spark, sf):
    cues = T.cue_turns(spark, sf)
    source = cues.selectExpr("doc_id", "cue_idx", "IF(cue_idx % 3 = 0, NULL, cue_id) AS cue_id", "IF(cue_idx % 2 = 0, 'Default', NULL) AS style")
    labels = cues.select("doc_id", "speaker_id").distinct().withColumn("label", F.concat(F.lit("Label "), "speaker_id"))
    by_id = source.where("cue_id IS NOT NULL").select("doc_id", "cue_id", F.struct("style").alias("a"))
    by_place = source.select("doc_id", "cue_idx", F.struct("style").alias("b"))
    edited = cues.withColumn("start_ms", F.col("start_ms") + 100)
    joined = edited.join(by_id, ["doc_id", "cue_id"], "left").join(by_place, ["doc_id", "cue_idx"], "left").join(labels, ["doc_id", "speaker_id"], "left")
    return joined.selectExpr("doc_id", "cue_id", "start_ms", "coalesce(a, b).style AS style", "label AS speaker", "text")


@query("edt_23_edit_word", with_tables("cue_turns", """
SELECT doc_id, cue_id, CASE WHEN cue_idx % 2 = 0 THEN greatest(0, start_ms - 50) ELSE start_ms END AS start_ms, end_ms FROM cue_turns"""), sized="conversations")
def _(spark, sf):
    cues = T.cue_turns(spark, sf)
    words = C.spread_words(cues)
    edits = words.join(cues.select("doc_id", "cue_id", "cue_idx"), ["doc_id", "cue_id"]).where("cue_idx % 2 = 0 AND word_idx = 0").selectExpr(
        "doc_id", "cue_id", "word_idx", "concat('T:', text) AS text", "greatest(0L, start_ms - 50) AS start_ms", "end_ms")
    return C.edit_words(words, cues, edits)[1].select("doc_id", "cue_id", "start_ms", "end_ms")


def _edited(spark, sf):
    cues = T.cue_turns(spark, sf)
    words = C.spread_words(cues).withColumns({"word_id": F.expr("concat(cue_id, '-w', word_idx)"), "confidence": F.lit(0.9)})
    edits = cues.selectExpr(
        "doc_id", "cue_id", "start_ms AS cue_start", "end_ms AS cue_end",
        "array_join(filter(transform(filter(split(text, '\\\\s+'), x -> x <> ''), (x, i) -> IF(i % 7 = 3, upper(x), IF(i % 11 = 5, '', IF(i % 13 = 6, concat(x, ' new'), x)))), x -> x <> ''), ' ') AS edited_text")
    return words, edits


@query("win_30_edit_alignment", sized="conversations")
def _(spark, sf):
    words, edits = _edited(spark, sf)
    return C.align_edited_text(words, edits, ["doc_id", "cue_id"])


@query("win_31_apply_suggestion", sized="conversations")
def _(spark, sf):
    words, _ = _edited(spark, sf)
    chosen = words.where("word_idx = 1").selectExpr("doc_id", "cue_id", "0L AS first_idx", "1L AS last_idx", "'Replaced Term' AS canonical")
    text = C.apply_suggestion_text(words, chosen, ["doc_id", "cue_id"])
    spans = T.cue_turns(spark, sf).selectExpr("doc_id", "cue_id", "start_ms AS cue_start", "end_ms AS cue_end")
    # The texts are made from the words; written once, they are not made again for each branch that reads them.
    return C.align_edited_text(words, cut_lineage(text.join(spans, ["doc_id", "cue_id"])), ["doc_id", "cue_id"])


@query("txt_06_edit_distance", """SELECT l.item_id AS a, r.item_id AS b, round(levenshtein(l.text, r.text) / greatest(length(l.text), length(r.text), 1)::DOUBLE, 6) AS d
FROM benchmark l JOIN benchmark r ON r.item_id = l.item_id + 7 WHERE regexp_matches(l.text || r.text, '^[ -~\\n]*$')""")
def _(spark, sf):
    """Whole texts of items seven apart, met by their ids."""
    items = spark.read.parquet(f"{sf}/benchmark.parquet")
    left = items.select(F.col("item_id").alias("a"), F.col("text").alias("a_text"), (F.col("item_id") + 7).alias("b"))
    pairs = left.join(items.select(F.col("item_id").alias("b"), F.col("text").alias("b_text")), "b")
    return pairs.where("concat(a_text, b_text) RLIKE '^[ -~\\\\n]*$'").select("a", "b", F.round(X.edit_distance_ratio(F.col("a_text"), F.col("b_text")), 6).alias("d"))


UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@query("txt_06_spelling_pairs", f"""WITH w AS (SELECT DISTINCT s, length(s) AS n FROM (
  SELECT regexp_replace(translate(x, '{UPPER}', '{LOWER}'), '[^a-z0-9]', '?', 'g') AS s FROM (SELECT unnest(regexp_split_to_array(text, '[ \\n\\t\\r]+')) AS x FROM conversations)) WHERE s <> ''),
m AS (SELECT *, unnest(range(n, n // 4 * 5 + 5)) AS partner FROM w),
p AS (SELECT m.s AS x, w.s AS y, w.n FROM m JOIN w ON w.n = m.partner AND w.n - m.n <= floor(0.2 * w.n + 1e-9) AND (m.n < w.n OR m.s < w.s))
SELECT least(x, y) AS "left", greatest(x, y) AS "right", round(d / n::DOUBLE, 6) AS distance FROM (SELECT *, levenshtein(x, y) AS d FROM p) WHERE d <= floor(0.2 * n + 1e-9)""")
def _(spark, sf):
    """Like spellings among the words of all cues; letters outside a-z stand as a question mark, in the oracle too."""
    spelled = F.regexp_replace(F.translate("word", UPPER, LOWER), "[^a-z0-9]", "?")
    words = T.cue_turns(spark, sf).select(F.explode(F.split("text", "[ \\n\\t\\r]+")).alias("word")).select(spelled.alias("text"))
    return C.spelling_pairs(words, 0.2).withColumn("distance", F.round("distance", 6))


@query("txt_08_safe_id", "SELECT doc_id, coalesce(nullif(left(regexp_replace(text, '[^a-zA-Z0-9_-]+', '-', 'g'), 48), ''), 'cue') AS slug FROM documents")
def _(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", X.safe_id(F.col("text")).alias("slug"))
