"""Column-level helpers: numbers, gains, easing, clocks, tokens, hashes, arrays."""

from __future__ import annotations

import unicodedata
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

MIN_CLIP_MS = 1000.0 / 120.0


# --- numbers -----------------------------------------------------------------


def clamp(value: Column, low: float | Column, high: float | Column) -> Column:
    """Bound a value; the upper bound wins when the bounds cross."""
    low = low if isinstance(low, Column) else F.lit(low)
    high = high if isinstance(high, Column) else F.lit(high)
    return F.when(value.isNotNull(), F.least(high, F.greatest(low, value)))


def is_finite(value: Column) -> Column:
    v = value.cast("double")
    return v.isNotNull() & ~F.isnan(v) & (F.abs(v) != F.lit(float("inf")))


def finite_or(value: Column, default: float | None) -> Column:
    return F.when(is_finite(value), value).otherwise(F.lit(default))


def round_half_up(value: Column) -> Column:
    """Ties go toward plus infinity, as integer milliseconds."""
    return F.floor(value + F.lit(0.5))


def round_away(value: Column, scale: int = 0) -> Column:
    """Ties go away from zero."""
    return F.round(value, scale)


def gain_to_db(gain: Column) -> Column:
    g = clamp(finite_or(gain, 0.0), 0.0, 4.0)
    return F.when(g == 0, F.lit(float("-inf"))).otherwise(20 * F.log10(g))


def db_to_gain(db: Column) -> Column:
    return F.when(is_finite(db), clamp(F.pow(F.lit(10.0), db / 20), 0.0, 4.0)).otherwise(F.lit(0.0))


def floor_db(gain: Column) -> Column:
    return 20 * F.log10(F.greatest(gain, F.lit(1e-6)))


def sigmoid(logit: Column) -> Column:
    return 1 / (1 + F.exp(-clamp(logit.cast("double"), -60.0, 60.0)))


# --- easing ------------------------------------------------------------------


def ease(progress: Column, kind: Column) -> Column:
    x = clamp(progress, 0.0, 1.0)
    return (
        F.when(kind == "hold", F.lit(0.0))
        .when(kind == "ease-in", x * x)
        .when(kind == "ease-out", 1 - (1 - x) * (1 - x))
        .when(kind == "ease-in-out", F.when(x < 0.5, 2 * x * x).otherwise(1 - F.pow(2 - 2 * x, F.lit(2.0)) / 2))
        .otherwise(x)
    )


def ease_out_cubic(x: Column) -> Column:
    return 1 - F.pow(1 - clamp(x, 0.0, 1.0), F.lit(3.0))


def ease_in_cubic(x: Column) -> Column:
    return F.pow(clamp(x, 0.0, 1.0), F.lit(3.0))


# Fixed values of the overshoot and bounce curves.
BACK_OVERSHOOT = 1.70158
BOUNCE_SCALE, BOUNCE_SPAN = 7.5625, 2.75
BOUNCE_ARCS = ((1.0, 0.0, 0.0), (2.0, 1.5, 0.75), (2.5, 2.25, 0.9375), (None, 2.625, 0.984375))


def ease_out_back(x: Column) -> Column:
    u = clamp(x, 0.0, 1.0) - 1
    return 1 + (BACK_OVERSHOOT + 1) * F.pow(u, F.lit(3.0)) + BACK_OVERSHOOT * F.pow(u, F.lit(2.0))


def ease_out_bounce(x: Column) -> Column:
    t = clamp(x, 0.0, 1.0)
    arcs = [(until, BOUNCE_SCALE * F.pow(t - shift / BOUNCE_SPAN, F.lit(2.0)) + lift) for until, shift, lift in BOUNCE_ARCS]
    out = None
    for until, curve in arcs:
        if until is None:
            return out.otherwise(curve)
        hit = t < until / BOUNCE_SPAN
        out = F.when(hit, curve) if out is None else out.when(hit, curve)
    return out


def source_time(trim_in: Column, local: Column, speed: Column) -> Column:
    return trim_in + local * speed


def post_speed_ms(duration_ms: Column, rate: Column) -> Column:
    return F.greatest(round_away(duration_ms / rate).cast("long"), F.lit(1))


def samples_to_ms(samples: Column, rate: int = 22_050) -> Column:
    return F.floor((samples * 1000 + rate // 2) / F.lit(rate)).cast("long")


# --- text --------------------------------------------------------------------


def tokenize(text: Column) -> Column:
    return F.filter(F.split(text, r"\s+"), lambda t: t != "")


def _latin_folding() -> tuple[str, str]:
    """Single-letter compatibility foldings of the Latin blocks, derived from Unicode data."""
    sources, targets = [], []
    for point in [*range(0x80, 0x250), *range(0x1E00, 0x1F00)]:
        char = chr(point)
        folded = "".join(c for c in unicodedata.normalize("NFKD", char) if not 0x300 <= ord(c) <= 0x36F).lower()
        if len(folded) == 1 and folded != char:
            sources.append(char)
            targets.append("i" if folded == "ı" else folded)
    sources.append("ı") if "ı" not in sources else None
    targets.append("i") if len(targets) < len(sources) else None
    return "".join(sources), "".join(targets)


_FOLD_FROM, _FOLD_TO = _latin_folding()
_NOT_LATIN = "[^\\u0000-\\u024F\\u0300-\\u036F\\u1E00-\\u1EFF\\u2010-\\u2027]|[ĲĳŉĿŀǄ-ǌǱ-ǳẚ¼-¾]"


def _fold_scripts(texts: pd.Series) -> pd.Series:
    def fold(text: str) -> str:
        plain = "".join(c for c in unicodedata.normalize("NFKD", text) if not 0x300 <= ord(c) <= 0x36F)
        return plain.lower().replace("ı", "i")

    return texts.map(fold, na_action="ignore")


def fold_text(text: Column, any_script: bool = False) -> Column:
    """Compatibility-fold and lower-case. Latin text stays in the JVM; with
    ``any_script`` other text goes through an Arrow UDF (it sees nulls otherwise)."""
    latin = F.lower(F.regexp_replace(F.translate(text, _FOLD_FROM, _FOLD_TO), "[\\u0300-\\u036F]", ""))
    if not any_script:
        return latin
    fold_scripts = F.pandas_udf(_fold_scripts, "string")
    return F.coalesce(fold_scripts(F.when(text.rlike(_NOT_LATIN), text)), latin)


def normalized_token(text: Column, any_script: bool = False) -> Column:
    return F.regexp_replace(fold_text(text, any_script), r"[^\p{L}\p{N}]+", "")


def normalized_phrase(text: Column, any_script: bool = False) -> Column:
    spaced = F.regexp_replace(fold_text(text, any_script), r"[^\p{L}\p{N}\s]+", "")
    return F.trim(F.regexp_replace(spaced, r"\s+", " "))


def compact_phrase(text: Column, any_script: bool = False) -> Column:
    return F.regexp_replace(normalized_phrase(text, any_script), " ", "")


def plain_token(text: Column) -> Column:
    """Lower-case letters and digits only, marks kept."""
    return F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]", "")


def turkish_token(text: Column) -> Column:
    return F.regexp_replace(F.lower(F.translate(text, "Iİ", "ıi")), r"[^\p{L}]", "")


def edit_distance_ratio(left: Column, right: Column) -> Column:
    return F.levenshtein(left, right) / F.greatest(F.length(left), F.length(right), F.lit(1))


def safe_id(text: Column, limit: int = 48) -> Column:
    slug = F.substring(F.regexp_replace(text, "[^a-zA-Z0-9_-]+", "-"), 1, limit)
    return F.when(slug == "", F.lit("cue")).otherwise(slug)


# --- hashes and arrays -------------------------------------------------------


def field_hash(*fields: Column) -> Column:
    """SHA-256 over length-prefixed fields, so no two field lists collide by joining."""
    parts = []
    for field in fields:
        text = F.coalesce(field.cast("string"), F.lit(""))
        parts += [F.octet_length(text).cast("string"), F.lit(":"), text, F.lit(";")]
    return F.sha2(F.concat(*parts), 256)


def partition_interval(start: Column, end: Column, count: Column) -> Column:
    """``count`` rounded sub-intervals as an array of structs."""
    span = F.greatest(start, end) - start
    return F.when(
        count > 0,
        F.transform(
            F.sequence(F.lit(0), count.cast("int") - 1),
            lambda i: F.struct(
                round_half_up(start + span * i / count).alias("start_ms"),
                round_half_up(start + span * (i + 1) / count).alias("end_ms"),
            ),
        ),
    ).otherwise(F.array().cast("array<struct<start_ms:bigint,end_ms:bigint>>"))


def any_of(column: Column, words: Sequence[str]) -> Column:
    return column.isin(list(words))
