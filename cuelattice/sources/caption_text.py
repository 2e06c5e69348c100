"""Caption files: detection, SRT / WebVTT / ASS parsing and writing, as row-local column work.

SRT and WebVTT split into blank-line blocks inside the row and explode once, so
parsing needs no shuffle. ASS carries section state over the lines of a file.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cuelattice.kernel.scan import Running, running

MAX_BYTES = 32 * 1024 * 1024
EXTENSIONS = ("srt", "vtt", "ass")
BLANK = "\\n(?:[^\\S\\n]*\\n)+"
CLOCK = "^(?:(\\d+):)?(\\d{1,2}):(\\d{1,2})(?:\\.(\\d{1,3}))?$"
TIMING = "^\\s*(\\S+)\\s+-->\\s+(\\S+)(?:\\s+(.*?))?\\s*$"
# The field order of the ASS sections.
ASS_STYLE_FIELDS = (
    "Name", "Fontname", "Fontsize", "PrimaryColour", "SecondaryColour", "OutlineColour", "BackColour", "Bold", "Italic",
    "Underline", "StrikeOut", "ScaleX", "ScaleY", "Spacing", "Angle", "BorderStyle", "Outline", "Shadow", "Alignment",
    "MarginL", "MarginR", "MarginV", "Encoding",
)
ASS_EVENT_FIELDS = ("Layer", "Start", "End", "Style", "Name", "MarginL", "MarginR", "MarginV", "Effect", "Text")


def caption_texts(files: DataFrame, most_bytes: int | None = None) -> DataFrame:
    """Texts of the caption files among ``files(path, length, content)``: ``(path, format_hint, text, error)``.

    A byte order mark goes, content that is not UTF-8 becomes an error row, and so do files above ``most_bytes`` if
    that is given (a desktop import stops at ``MAX_BYTES``). On a listing of binary files the length test is pushed
    down, so oversized content is never loaded.
    """
    hint = F.lower(F.regexp_extract("path", "\\.([^./]+)$", 1))
    listed = files.withColumn("format_hint", hint).where(F.col("format_hint").isin(*EXTENSIONS))
    fine = listed if most_bytes is None else listed.where(F.col("length") <= most_bytes)
    raw = fine.select("path", "format_hint", F.try_validate_utf8(F.col("content").cast("string")).alias("raw"))
    texts = raw.select("path", "format_hint", F.regexp_replace("raw", "^\\uFEFF", "").alias("text"), F.when(F.col("raw").isNull(), F.lit("invalid-utf8")).alias("error"))
    if most_bytes is None:
        return texts
    large = listed.where(F.col("length") > most_bytes).select("path", "format_hint", F.lit(None).cast("string").alias("text"), F.lit("too-large").alias("error"))
    return texts.unionByName(large)


def read_caption_files(spark: SparkSession, path: str, most_bytes: int | None = None) -> DataFrame:
    """``caption_texts`` of all files below a path."""
    return caption_texts(spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path), most_bytes)


def detect_format(text: Column) -> Column:
    body = F.regexp_replace(F.regexp_replace(text, "^\\uFEFF", ""), "^\\s+", "")
    return (
        F.when(body.rlike("^WEBVTT(?:[ \\t\\r\\n]|$)"), "vtt")
        .when(body.rlike("(?im)^\\[(?:Script Info|Events)\\]"), "ass")
        .otherwise("srt")
    )


def clock_ms(text: Column, short: bool = False) -> Column:
    """Milliseconds of ``h:mm:ss.mmm``; null when malformed. ``short`` allows a missing hour."""
    value = F.regexp_replace(F.trim(text), "^([^,]*),", "$1.")
    pieces = [F.regexp_extract(value, CLOCK, i) for i in range(1, 5)]
    hours, minutes, seconds, fraction = pieces
    good = value.rlike(CLOCK) & (minutes.cast("int") <= 59) & (seconds.cast("int") <= 59)
    if not short:
        good = good & (hours != "")
    total = (
        F.coalesce(F.nullif(hours, F.lit("")).cast("long"), F.lit(0)) * 3_600_000
        + minutes.cast("long") * 60_000 + seconds.cast("long") * 1_000 + F.rpad(fraction, 3, "0").cast("long")
    )
    return F.when(good, total)


def clock_text(ms: Column, separator: str = ",") -> Column:
    return F.format_string(
        f"%02d:%02d:%02d{separator}%03d", F.floor(ms / 3_600_000), F.floor(ms % 3_600_000 / 60_000),
        F.floor(ms % 60_000 / 1_000), (ms % 1_000).cast("long"),
    )


def ass_clock_text(ms: Column) -> Column:
    """Centisecond clock; rounded once so a carry reaches the seconds."""
    cs = F.floor(ms / 10 + 0.5)
    return F.format_string("%d:%02d:%02d.%02d", F.floor(cs / 360_000), F.floor(cs % 360_000 / 6_000), F.floor(cs % 6_000 / 100), (cs % 100).cast("long"))


def _lines(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, "^\\uFEFF", ""), "\\r\\n?", "\n")


def _blocks(docs: DataFrame, short: bool) -> DataFrame:
    """Blank-line blocks with their first timing line, the line before it and the text after it."""
    blocks = docs.select("doc_id", F.posexplode(F.split(F.regexp_replace(_lines(F.col("text")), "^\\s*\\n", ""), BLANK)).alias("block", "body"))
    rows = blocks.withColumn("rows", F.split("body", "\n"))

    def timed(line: Column) -> Column:
        start, end = (clock_ms(F.regexp_extract(line, TIMING, i), short) for i in (1, 2))
        return start.isNotNull() & end.isNotNull() & (end >= start)

    at = F.array_position(F.transform("rows", timed), True)
    placed = rows.withColumn("at", at.cast("int"))
    line = F.element_at("rows", F.when(F.col("at") > 0, F.col("at")).otherwise(1))
    return placed.select(
        "doc_id", "block", "rows", "at",
        F.when(F.col("at") > 1, F.element_at("rows", F.greatest(F.col("at") - 1, F.lit(1)))).alias("before"),
        clock_ms(F.regexp_extract(line, TIMING, 1), short).alias("start_ms"),
        clock_ms(F.regexp_extract(line, TIMING, 2), short).alias("end_ms"),
        F.trim(F.regexp_extract(line, TIMING, 3)).alias("settings"),
        F.array_join(F.slice("rows", F.col("at") + 1, F.size("rows")), "\n").alias("text"),
    )


def _trim_end(text: Column) -> Column:
    return F.regexp_replace(text, "\\n+$", "")


def parse_srt(docs: DataFrame) -> DataFrame:
    """``(doc_id, text)`` to cues; blocks without a valid timing line are skipped."""
    cues = _blocks(docs, short=False).where("at > 0")
    return cues.select(
        "doc_id", F.col("block").alias("cue_idx"), F.nullif(F.trim("before"), F.lit("")).alias("cue_id"),
        "start_ms", "end_ms", _trim_end(F.col("text")).alias("text"),
    )


VOICE = "(?s)^<v((?:\\.[A-Za-z0-9_-]+)*)(?:\\s+([^>]*))?>(.*?)(?:</v>)?$"
CLASS = "(?s)^<c((?:\\.[A-Za-z0-9_-]+)+)>(.*?)</c>$"
VTT_BLOCK = "^(NOTE|STYLE|REGION)(?:[ \\t]+(.*))?$"


def parse_vtt(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Cues and NOTE/STYLE/REGION blocks. A file without the header yields one block of type ERROR."""
    checked = docs.withColumn("text", _lines(F.col("text")))
    head = F.trim(F.element_at(F.split("text", "\n"), 1))
    valid = checked.where(head.rlike("^WEBVTT(?:[ \\t].*)?$"))
    blocks = _blocks(valid, short=True).where("block > 0")
    note_at = F.array_position(F.transform("rows", lambda r: r.rlike(VTT_BLOCK)), True).cast("int")
    marked = blocks.withColumn("note", note_at)
    is_note = (F.col("note") > 0) & ((F.col("at") == 0) | (F.col("note") < F.col("at")))
    note_line = F.element_at("rows", F.when(F.col("note") > 0, F.col("note")).otherwise(1))
    first = F.regexp_extract(note_line, VTT_BLOCK, 2)
    rest = F.slice("rows", F.greatest(F.col("note"), F.lit(0)) + 1, F.size("rows"))
    notes = marked.where(is_note).select(
        "doc_id", "block", F.regexp_extract(note_line, VTT_BLOCK, 1).alias("type"),
        _trim_end(F.array_join(F.when(first != "", F.concat(F.array(first), rest)).otherwise(rest), "\n")).alias("text"),
    )
    bad = checked.where(~head.rlike("^WEBVTT(?:[ \\t].*)?$")).select(
        "doc_id", F.lit(0).alias("block"), F.lit("ERROR").alias("type"), F.lit("missing WEBVTT header").alias("text")
    )
    raw = _trim_end(F.col("text"))
    voiced = marked.where(~is_note & (F.col("at") > 0)).select(
        "doc_id", F.col("block").alias("cue_idx"), F.nullif(F.col("before"), F.lit("")).alias("cue_id"), "start_ms", "end_ms",
        F.nullif(F.col("settings"), F.lit("")).alias("settings"),
        F.when(raw.rlike(VOICE), F.regexp_extract(raw, VOICE, 2)).alias("annotation"),
        F.when(raw.rlike(VOICE), F.regexp_extract(raw, VOICE, 1)).alias("voice_classes"),
        F.when(raw.rlike(VOICE), F.regexp_extract(raw, VOICE, 3)).otherwise(raw).alias("inner"),
    )
    unescaped = F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace("annotation", "(?i)&gt;", ">"), "(?i)&lt;", "<"), "(?i)&amp;", "&"))
    classes = F.when(F.col("inner").rlike(CLASS), F.filter(F.split(F.regexp_extract("inner", CLASS, 1), "\\."), lambda c: c != ""))
    cues = voiced.select(
        "doc_id", "cue_idx", "cue_id", "start_ms", "end_ms",
        F.when(F.col("inner").rlike(CLASS), F.regexp_extract("inner", CLASS, 2)).otherwise(F.col("inner")).alias("text"),
        F.nullif(unescaped, F.lit("")).alias("speaker"), classes.alias("classes"), classes.getItem(0).alias("style"), "settings",
        F.filter(F.split("voice_classes", "\\."), lambda c: c != "").alias("voice_classes"),
    )
    return cues, notes.unionByName(bad)


# --- ASS ------------------------------------------------------------------------


def _ass_fields(format_line: Column, payload: Column) -> Column:
    """Map of canonical field name to value; the last field keeps its commas."""
    names = F.filter(
        F.transform(F.split(format_line, ","), lambda f: F.regexp_replace(F.lower(F.trim(f)), "[^a-z0-9]", "")), lambda f: f != ""
    )
    count = F.size(names)
    parts = F.split(payload, ",", -1)
    head = F.transform(F.slice(parts, 1, F.greatest(count - 1, F.lit(0))), lambda p: F.trim(p))
    last = F.array_join(F.slice(parts, F.greatest(count, F.lit(1)), F.greatest(F.size(parts) - count + 1, F.lit(0))), ",")
    values = F.concat(head, F.array(last))
    padded = F.concat(values, F.array_repeat(F.lit(""), F.greatest(count - F.size(values), F.lit(0))))
    return F.map_from_entries(F.array_distinct(F.arrays_zip(names.alias("k"), F.slice(padded, 1, count).alias("v"))))


def ass_lines(docs: DataFrame) -> DataFrame:
    """Lines of ASS files with their section and the field format in force."""
    lines = docs.select("doc_id", F.posexplode(F.split(_lines(F.col("text")), "\n")).alias("line_no", "line"))
    bare = F.trim("line")
    parts = lines.withColumn("__section", F.when(bare.rlike("^\\[[^\\]]+\\]$"), F.lower(F.regexp_extract(bare, "^\\[([^\\]]+)\\]$", 1))))
    scanned = running(parts, ["doc_id"], ["line_no"], [Running("section", "last", F.col("__section"))], F.expr("line_no DIV 100000"))
    declared = F.when(F.col("line").rlike("(?i)^Format\\s*:"), F.regexp_extract("line", "(?i)^Format\\s*:\\s*(.*)$", 1))
    named = declared.rlike("[^,\\s]")
    is_event = F.col("section") == "events"
    is_style = F.col("section").isin("v4+ styles", "v4 styles")
    formats = scanned.withColumns({"__ef": F.when(is_event & named, declared), "__sf": F.when(is_style & named, declared)})
    formats = running(
        formats, ["doc_id"], ["line_no"], [Running("event_format", "last", F.col("__ef")), Running("style_format", "last", F.col("__sf"))],
        F.expr("line_no DIV 100000"),
    )
    return formats.where(F.col("__section").isNull() & (bare != "") & ~bare.startswith(";")).select(
        "doc_id", "line_no", "line", "section",
        F.coalesce("event_format", F.lit(", ".join(ASS_EVENT_FIELDS))).alias("event_format"),
        F.coalesce("style_format", F.lit(", ".join(ASS_STYLE_FIELDS))).alias("style_format"),
    )


def ass_script_info(lines: DataFrame) -> DataFrame:
    """Header key/value pairs, the last value of a key."""
    pairs = lines.where("section = 'script info' AND instr(line, ':') > 1").select(
        "doc_id", "line_no", F.trim(F.substring_index("line", ":", 1)).alias("key"), F.trim(F.expr("substring(line, instr(line, ':') + 1)")).alias("value")
    ).where("key <> ''")
    return pairs.groupBy("doc_id", "key").agg(F.max_by("value", "line_no").alias("value"))


def ass_styles(lines: DataFrame) -> DataFrame:
    found = lines.where(F.col("section").isin("v4+ styles", "v4 styles") & F.col("line").rlike("(?i)^Style\\s*:")).select(
        "doc_id", "line_no", _ass_fields(F.col("style_format"), F.regexp_extract("line", "(?i)^Style\\s*:\\s*(.*)$", 1)).alias("f")
    )
    number = lambda *names: F.coalesce(*[F.expr(f"try_cast(f['{n}'] AS DOUBLE)") for n in names])
    return found.select(
        "doc_id", F.col("line_no").alias("style_idx"), F.trim(F.col("f")["name"]).alias("name"), F.col("f")["fontname"].alias("font_name"),
        number("fontsize").alias("font_size"), F.coalesce(F.col("f")["primarycolour"], F.col("f")["primarycolor"]).alias("primary_color"),
        (number("bold") != 0).alias("bold"), (number("italic") != 0).alias("italic"), number("alignment").alias("alignment"),
        number("marginv", "margint").alias("margin_v"), F.col("f").alias("fields"),
    ).where("name <> ''")


def ass_decode(raw: Column) -> Column:
    """Drop override blocks and decode ``\\N``, ``\\h`` and escaped braces."""
    mark = "\ue000"
    shielded = F.replace(raw, F.lit("\\\\"), F.lit(mark))
    shown = F.regexp_replace(shielded, "(?<!\\\\)\\{\\s*[\\\\\ue000][^}]*\\}", "")
    breaks = F.regexp_replace(shown, "\\\\[Nn]", "\n")
    spaces = F.regexp_replace(breaks, "\\\\h", "\u00a0")
    braces = F.regexp_replace(spaces, "\\\\([{}])", "$1")
    return F.replace(braces, F.lit(mark), F.lit("\\"))


def ass_overrides(raw: Column) -> Column:
    """Animations and style overrides of the leading tag blocks as one struct."""
    tags = F.regexp_replace(F.regexp_extract(raw, "^((?:\\{\\s*\\\\[^}]*\\})+)", 1), "[{}]", "")
    value = lambda pattern, group=1: F.nullif(F.regexp_extract(tags, pattern, group), F.lit(""))
    flag = lambda letter: (value(f"(?i)\\\\{letter}(-?1|0)(?=\\\\|$)") != "0")
    num = "\\s*(-?[\\d.]+)\\s*"
    move = f"(?i)\\\\move\\({num},{num},{num},{num}(?:,\\s*(\\d+)\\s*,\\s*(\\d+))?\\s*\\)"
    fade = "(?i)\\\\fad\\(\\s*(\\d+)\\s*,\\s*(\\d+)\\s*\\)"
    place = f"(?i)\\\\pos\\({num},{num}\\)"
    real = lambda pattern, group=1: value(pattern, group).cast("double")
    return F.struct(
        real(fade, 1).alias("fade_in_ms"), real(fade, 2).alias("fade_out_ms"),
        *[real(move, i + 1).alias(n) for i, n in enumerate(("from_x", "from_y", "to_x", "to_y", "move_start_ms", "move_end_ms"))],
        real(place, 1).alias("pos_x"), real(place, 2).alias("pos_y"),
        flag("b").alias("bold"), flag("i").alias("italic"), flag("u").alias("underline"), flag("s").alias("strike_out"),
        F.trim(value("(?i)\\\\fn([^\\\\}]+)")).alias("font_name"), real("(?i)\\\\fs([\\d.]+)").alias("font_size"),
        value("(?i)\\\\1?c(&H[0-9A-F]{6,8}&?)").alias("primary_color"), value("(?i)\\\\3c(&H[0-9A-F]{6,8}&?)").alias("outline_color"),
        real("(?i)\\\\bord([\\d.]+)").alias("outline"), real("(?i)\\\\shad([\\d.]+)").alias("shadow"), real("(?i)\\\\an([1-9])").alias("alignment"),
    )


def ass_events(lines: DataFrame) -> DataFrame:
    pattern = "(?i)^(Dialogue|Comment)\\s*:\\s*(.*)$"
    found = lines.where((F.col("section") == "events") & F.col("line").rlike(pattern)).select(
        "doc_id", "line_no", F.initcap(F.regexp_extract("line", pattern, 1)).alias("event_type"),
        _ass_fields(F.col("event_format"), F.regexp_extract("line", pattern, 2)).alias("f"),
    )
    strict = "^\\s*\\d+:\\d{1,2}:\\d{1,2}\\.\\d{1,3}\\s*$"
    at = lambda name: F.when(F.col("f")[name].rlike(strict), clock_ms(F.col("f")[name]))
    number = lambda name: F.expr(f"try_cast(f['{name}'] AS DOUBLE)")
    return found.select(
        "doc_id", F.col("line_no").alias("cue_idx"), "event_type", at("start").alias("start_ms"), at("end").alias("end_ms"),
        ass_decode(F.col("f")["text"]).alias("text"), F.nullif(F.trim(F.coalesce(F.col("f")["name"], F.col("f")["actor"])), F.lit("")).alias("speaker"),
        F.nullif(F.trim(F.col("f")["style"]), F.lit("")).alias("style"), number("layer").alias("layer"), number("marginl").alias("margin_l"),
        number("marginr").alias("margin_r"), number("marginv").alias("margin_v"), F.col("f")["effect"].alias("effect"),
        F.col("f")["text"].alias("raw_text"), ass_overrides(F.col("f")["text"]).alias("overrides"),
    ).where("start_ms IS NOT NULL AND end_ms >= start_ms")


# --- writing --------------------------------------------------------------------


def _checked(cues: DataFrame) -> DataFrame:
    """Rounded cue times; a cue with impossible times fails the job."""
    bad = (F.col("start_ms") < 0) | (F.col("end_ms") < F.col("start_ms")) | F.col("start_ms").isNull() | F.col("end_ms").isNull()
    guard = lambda c: F.when(bad, F.raise_error(F.lit("caption cue has invalid times"))).otherwise(F.floor(F.col(c) + 0.5))
    return cues.withColumns({"__s": guard("start_ms"), "__e": guard("end_ms")})


def _files(blocks: DataFrame, head: Column, glue: str, tail: Column) -> DataFrame:
    """One text per document; a document is one file, bounded by the file size limit."""
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("cue_idx", "block"))), lambda b: b["block"])
    return blocks.groupBy("doc_id").agg(F.concat(head, F.array_join(ordered, glue), tail).alias("text"))


def _flat(text: Column) -> Column:
    return F.regexp_replace(text, "[\\r\\n]+", " ")


def write_srt(cues: DataFrame, newline: str = "\r\n") -> DataFrame:
    id_text = F.when(F.trim(F.coalesce("cue_id", F.lit(""))) == "", (F.col("cue_idx") + 1).cast("string")).otherwise(_flat(F.trim("cue_id")))
    block = F.concat(id_text, F.lit(newline), clock_text(F.col("__s")), F.lit(" --> "), clock_text(F.col("__e")), F.lit(newline), F.regexp_replace("text", "\\r\\n?", "\n"))
    return _files(_checked(cues).select("doc_id", "cue_idx", block.alias("block")), F.lit(""), newline * 2, F.lit(newline))


def write_vtt(cues: DataFrame, header: str = "", newline: str = "\n") -> DataFrame:
    """``speaker``, ``style`` and ``settings`` columns are optional."""
    have = lambda c: F.col(c) if c in cues.columns else F.lit(None).cast("string")
    body = F.regexp_replace("text", "\\r\\n?", "\n")
    style = have("style")
    classed = F.when(style.rlike("^[A-Za-z0-9_-]+$"), F.concat(F.lit("<c."), style, F.lit(">"), body, F.lit("</c>"))).otherwise(body)
    escaped = F.trim(_flat(F.replace(F.replace(F.replace(have("speaker"), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))))
    voiced = F.when(have("speaker") != "", F.concat(F.lit("<v "), escaped, F.lit(">"), classed, F.lit("</v>"))).otherwise(classed)
    settings = F.trim(_flat(F.coalesce(have("settings"), F.lit(""))))
    first = F.when(F.trim(F.coalesce("cue_id", F.lit(""))) != "", F.concat(_flat(F.col("cue_id")), F.lit(newline))).otherwise(F.lit(""))
    timing = F.concat(clock_text(F.col("__s"), "."), F.lit(" --> "), clock_text(F.col("__e"), "."), F.when(settings != "", F.concat(F.lit(" "), settings)).otherwise(F.lit("")))
    block = F.concat(first, timing, F.lit(newline), F.replace(voiced, F.lit("\n"), F.lit(newline)), F.lit(newline))
    title = F.lit("WEBVTT" + (f" {header}" if header else "") + newline * 2)
    return _files(_checked(cues).select("doc_id", "cue_idx", block.alias("block")), title, newline, F.lit(""))


def sanitize_ass_field(text: Column, fallback: str = "") -> Column:
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit(fallback)), "[\\r\\n,]+", " "))


def ass_color(text: Column) -> Column:
    """``&H`` and ``#rrggbb`` colours in canonical form; null for anything else."""
    value = F.trim(text)
    native = F.regexp_extract(value, "(?i)^&H([0-9A-F]{6}|[0-9A-F]{8})&?$", 1)
    css = F.regexp_extract(value, "(?i)^#([0-9A-F]{6})$", 1)
    swapped = F.concat(F.lit("&H00"), F.substring(css, 5, 2), F.substring(css, 3, 2), F.substring(css, 1, 2))
    return F.when(native != "", F.concat(F.lit("&H"), F.upper(native))).when(css != "", F.upper(swapped))


def escape_ass(text: Column) -> Column:
    out = F.replace(F.regexp_replace(text, "\\r\\n?", "\n"), F.lit("\\"), F.lit("\\\\"))
    for plain, code in (("{", "\\{"), ("}", "\\}"), ("\n", "\\N")):
        out = F.replace(out, F.lit(plain), F.lit(code))
    return out


# Fixed value: the style written when a document brings none.
DEFAULT_STYLE = "Default,Arial,48,&H00FFFFFF,&H000000FF,&H00000000,&H64000000,0,0,0,0,100,100,0,0,1,2,0,2,30,30,30,1"


def write_ass(cues: DataFrame, newline: str = "\r\n", styles: str = DEFAULT_STYLE) -> DataFrame:
    """``speaker``, ``style``, ``layer``, margins and ``tags`` columns are optional."""
    have = lambda c: F.col(c) if c in cues.columns else F.lit(None).cast("string")
    whole = lambda c: F.floor(F.greatest(F.lit(0.0), F.least(F.lit(9999.0), F.coalesce(have(c).cast("double"), F.lit(0.0)))) + 0.5).cast("string")
    style = sanitize_ass_field(have("style"), "Default")
    line = F.concat(
        F.coalesce(F.when(have("event_type") == "Comment", F.lit("Comment")), F.lit("Dialogue")), F.lit(": "),
        F.concat_ws(
            ",", whole("layer"), ass_clock_text(F.col("__s")), ass_clock_text(F.col("__e")), F.when(style == "", F.lit("Default")).otherwise(style),
            sanitize_ass_field(have("speaker")), whole("margin_l"), whole("margin_r"), whole("margin_v"), sanitize_ass_field(have("effect")),
            F.concat(F.coalesce(have("tags"), F.lit("")), escape_ass(F.col("text"))),
        ),
    )
    top = newline.join(
        ["[Script Info]", "ScriptType: v4.00+", "", "[V4+ Styles]", "Format: " + ", ".join(ASS_STYLE_FIELDS), "Style: " + styles, "",
         "[Events]", "Format: " + ", ".join(ASS_EVENT_FIELDS), ""]
    )
    return _files(_checked(cues).select("doc_id", "cue_idx", line.alias("block")), F.lit(top), newline, F.lit(newline))


def parse_captions(docs: DataFrame) -> DataFrame:
    """Cues of mixed formats; ``docs(doc_id, text)`` is routed by the detected format."""
    kinds = docs.withColumn("format", detect_format(F.col("text")))
    columns = ["doc_id", "cue_idx", "start_ms", "end_ms", "text"]
    parts = [
        parse_srt(kinds.where("format = 'srt'")).select(*columns),
        parse_vtt(kinds.where("format = 'vtt'"))[0].select(*columns),
        ass_events(ass_lines(kinds.where("format = 'ass'"))).select(*columns),
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def write_captions(cues: DataFrame, format_name: str) -> DataFrame:
    return {"srt": write_srt, "vtt": write_vtt, "ass": write_ass}[format_name](cues)
