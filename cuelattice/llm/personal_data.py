"""Personal data in transcripts: fixed forms, and a trained character tagger for what they miss."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cuelattice.llm.byte_bpe import _slices
from cuelattice.llm.records import arrow_batches, only
from cuelattice.llm.secret_scan import SPAN, _ARROW_SPANS
from cuelattice.llm.tagger import DIGIT, SIGNS, Tagger, best_tags, classes, emissions, tag_names, train_tagger

KINDS = ("email", "ip", "card", "phone")
AT = 1 + SIGNS.index("@")

#: Fixed patterns of the base kinds. What precedes @ is found from the sign backwards, so long runs cost one look.
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def _digits(text: str) -> list[int]:
    return [ord(c) - 48 for c in text if "0" <= c <= "9"]


def luhn(digits: list[int]) -> bool:
    doubled = [d * 2 - 9 * (d > 4) for d in digits[-2::-2]]
    return (sum(doubled) + sum(digits[-1::-2])) % 10 == 0


def valid(kind: str, text: str) -> bool:
    """The test that a match of a kind must pass."""
    if kind == "ip":
        return all(int(part.lstrip("0")[:4] or "0") <= 255 for part in text.split("."))
    digits = _digits(text)
    if kind == "card":
        return 13 <= len(digits) <= 19 and luhn(digits)
    return kind == "email" or 9 <= len(digits) <= 15


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost e-mail addresses without overlap: the run of name signs before each @ and the domain after it."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        domain = DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            yield start, domain.end()
            done = domain.end()
        at = text.find("@", max(at + 1, done))


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Spans of the fixed kinds: leftmost matches without overlap in each kind, those that fail their test dropped."""
    found = [("email", s, e) for s, e in emails(text)]
    for kind, pattern in (("ip", IP), ("card", CARD), ("phone", PHONE)):
        found += [(kind, m.start(), m.end()) for m in pattern.finditer(text) if valid(kind, m[0])]
    return found


SHAPES = {"email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+"), "ip": re.compile(r"[0-9]+(?:\.[0-9]+){3}"), "card": re.compile(r"[0-9](?:[\x20-]?[0-9])+"), "phone": re.compile(r"\+?[0-9(][\x20().0-9-]+[0-9]")}


def training_windows(texts: list[str], width: int, seed: int = 2) -> tuple[np.ndarray, np.ndarray]:
    """Class and tag rows from the labelled spans of some texts.

    Each base span gives windows at random places around it. Because patterns join numbers that stand side by
    side, windows are also made of two labelled spans with a sign between them, in the text around the first; and
    for each span there is a window without one.
    """
    rng = np.random.default_rng(seed)
    marked = [(text, kind, s, e) for text in texts for kind, s, e in base_spans(text) if e - s < width - 8]
    names = tag_names(KINDS)
    points, tags = [], []

    def add(text: str, spans: list[tuple[str, int, int]], at: int) -> None:
        own, row = classes(text[at : at + width]), np.zeros(width, np.int64)
        padded = np.zeros(width, np.int64)
        padded[: len(own)] = own
        for kind, s, e in spans:
            if s >= at and e <= at + width:
                row[s - at], row[s - at + 1 : e - at] = names.index(f"B-{kind}"), names.index(f"I-{kind}")
        points.append(padded)
        tags.append(row)

    for text, kind, s, e in marked:
        spans = base_spans(text[max(0, s - 2 * width) : e + 2 * width])
        shift = max(0, s - 2 * width)
        spans = [(k, a + shift, b + shift) for k, a, b in spans]
        add(text, spans, max(0, s - int(rng.integers(0, width - (e - s)))))
        other, kind2, s2, e2 = marked[int(rng.integers(0, len(marked)))]
        gap = (" ", " ", ", ", "\n", " / ")[int(rng.integers(0, 5))]
        left, right = text[max(0, s - 20) : s], text[e : e + 20]
        joined = left + text[s:e] + gap + other[s2:e2] + right
        if len(joined) <= width:
            place = len(left)
            add(joined, [(kind, place, place + e - s), (kind2, place + e - s + len(gap), place + e - s + len(gap) + e2 - s2)], 0)
        plain = int(rng.integers(0, max(1, len(text) - width)))
        if not base_spans(text[max(0, plain - 40) : plain + width + 40]):
            add(text, [], plain)
    return np.array(points).reshape(-1, width), np.array(tags).reshape(-1, width)


def fit_tagger(transcripts: DataFrame, most_texts: int = 400, width: int = 64, steps: int = 160) -> Tagger | None:
    """Tagger trained on the base spans of ``most_texts`` transcripts that have some, or None if none has.

    The sample is bounded and seeded: transcripts with an @ or a digit run, in the order of their id's hash.
    Only pieces around labelled spans come to the driver.
    """
    df = only(transcripts, "asset_id", "transcript").where(F.col("transcript").rlike(r"@|[0-9]{3}"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, pieces = [], []
            for key, text in zip(batch.column("key"), batch.column("transcript"), strict=True):
                own = text.as_py()
                for _, s, e in base_spans(own)[:1]:
                    ids.append(key.as_py())
                    pieces.append(own[max(0, s - 4 * width) : e + 4 * width])
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(pieces, pa.string())], ["key", "piece"])

    keyed = df.select(F.xxhash64(F.col("asset_id").cast("string"), "transcript").alias("key"), "transcript")
    sample = keyed.mapInArrow(cut, "key long, piece string").orderBy("key", "piece").limit(most_texts).toPandas()
    points, tags = training_windows(list(sample["piece"]), width)
    return train_tagger(KINDS, points, tags, steps=steps) if len(points) else None


def tagged_spans(texts: list[str], tagger: Tagger, width: int, batch: int = 256) -> list[list[tuple[str, int, int]]]:
    """Spans that the tagger finds in each text.

    Windows of ``width`` characters start every half width. Every kind has a digit or an @, so windows without
    either hold nothing and are left out; the others are scored together. Where windows overlap, a character's
    scores are their mean, weighted by how far it is from the window's edge, and one best path is taken over each
    stretch of windows, so no span is decided by a window that cuts it.
    """
    half = width // 2
    ramp = np.minimum(np.arange(1, width + 1), np.arange(width, 0, -1)).astype(np.float32)[:, None]
    own = [classes(text) for text in texts]
    jobs: list[tuple[int, int]] = []
    for k, row in enumerate(own):
        hits = np.flatnonzero((row == DIGIT) | (row == AT)) // half
        jobs += [(k, int(w) * half) for w in np.unique(np.concatenate((hits, np.maximum(hits - 1, 0))))]
    parts: list[np.ndarray] = []
    for at in range(0, len(jobs), batch):
        rows = np.zeros((len(jobs[at : at + batch]), width), np.int64)
        for i, (k, start) in enumerate(jobs[at : at + batch]):
            piece = own[k][start : start + width]
            rows[i, : len(piece)] = piece
        parts.extend(emissions(tagger, rows).transpose(1, 0, 2))
    stretches: list[tuple[int, int, np.ndarray]] = []
    at = 0
    while at < len(jobs):
        end = at + 1
        while end < len(jobs) and jobs[end] == (jobs[at][0], jobs[end - 1][1] + half):
            end += 1
        k, start = jobs[at]
        length = min(jobs[end - 1][1] + width, len(own[k])) - start
        sums, weight = np.zeros((length + width, len(tagger.tags)), np.float32), np.zeros((length + width, 1), np.float32)
        for i in range(at, end):
            x = jobs[i][1] - start
            sums[x : x + width] += parts[i] * ramp
            weight[x : x + width] += ramp
        stretches.append((k, start, sums[:length] / weight[:length]))
        at = end
    found: list[list[tuple[str, int, int]]] = [[] for _ in texts]
    for (k, start, _), tags in zip(stretches, best_tags(tagger, [s[2] for s in stretches]), strict=True):
        begins = np.flatnonzero(tags % 2 == 1)
        for b in begins:
            e = b + 1
            while e < len(tags) and tags[e] == tags[b] + 1:
                e += 1
            found[k].append((KINDS[(int(tags[b]) - 1) // 2], start + int(b), start + int(e)))
    return found


def all_spans(texts: list[str], tagger: Tagger | None, width: int) -> list[list[dict]]:
    tagged = tagged_spans(texts, tagger, width) if tagger else [[] for _ in texts]
    result = []
    for text, extra in zip(texts, tagged, strict=True):
        base = base_spans(text)
        spans = [{"kind": k, "start": s, "end": e, "base": True} for k, s, e in base]
        taken = sorted((s, e) for _, s, e in base)
        starts = [s for s, _ in taken]
        reach = np.maximum.accumulate([e for _, e in taken]) if taken else np.zeros(0)
        for kind, s, e in extra:
            # The path decides where spans lie; a test of the kind follows, as for base spans.
            before = int(np.searchsorted(starts, e))
            if (before and reach[before - 1] > s) or not SHAPES[kind].fullmatch(text[s:e]) or not valid(kind, text[s:e]):
                continue
            spans.append({"kind": kind, "start": s, "end": e, "base": False})
        result.append(sorted(spans, key=lambda x: (KINDS.index(x["kind"]), x["start"])))
    return result


def find_personal_data(transcripts: DataFrame, tagger: Tagger | None, width: int = 96, batch_chars: int = 1_000_000) -> DataFrame:
    """Personal data in whole transcripts.

    Needs ``asset_id`` and ``transcript``; returns ``asset_id`` and ``spans``, an array of
    (kind, start, end, base) in code points, end exclusive, ordered by kind (email, ip, card, phone) and start.
    Fixed patterns give the spans with ``base`` true. The tagger, a character-level bidirectional LSTM with CRF
    transitions from ``fit_tagger``, adds spans that overlap none of them and pass the test of their kind: numbers
    that a pattern joined with a neighbour and then rejected, above all.

    Defined cases: null or empty transcript: no spans; without a tagger only base spans; rows that repeat an id
    stay separate; very long texts are read whole, in windows; an empty table gives an empty result; other columns
    are ignored.
    """
    df = only(transcripts, "asset_id", "transcript")
    arrow_batches(df.sparkSession)
    shared: Broadcast = df.sparkSession.sparkContext.broadcast(tagger)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _slices(batches):
            texts = [text.as_py() or "" for text in part.column("transcript")]
            spans: list[list[dict]] = []
            while len(spans) < len(texts):
                own, size = [], 0
                for text in texts[len(spans) :]:
                    if own and size + len(text) > batch_chars:
                        break
                    own.append(text)
                    size += len(text)
                spans += all_spans(own, shared.value, width)
            yield pa.RecordBatch.from_arrays([part.column("asset_id"), pa.array(spans, _ARROW_SPANS)], ["asset_id", "spans"])

    return df.mapInArrow(run, T.StructType([df.schema["asset_id"], T.StructField("spans", T.ArrayType(SPAN))]))
