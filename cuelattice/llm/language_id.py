"""Language of transcripts: scripts narrow the candidates, Viterbi over word scores labels spans."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cuelattice.llm.records import arrow_batches, only
from cuelattice.session import cut_lineage

#: Letter features of the model are hashed to this many values, so a model has languages * FEATURES numbers.
FEATURES = 1 << 16
UNKNOWN = "und"

#: First and last code point of the ranges in which a script's letters lie; other letters are script 0.
SCRIPT_RANGES = (
    ("latin", 0x0041, 0x024F), ("greek", 0x0370, 0x03FF), ("cyrillic", 0x0400, 0x052F), ("armenian", 0x0530, 0x058F),
    ("hebrew", 0x0590, 0x05FF), ("arabic", 0x0600, 0x077F), ("devanagari", 0x0900, 0x097F), ("bengali", 0x0980, 0x09FF),
    ("gurmukhi", 0x0A00, 0x0A7F), ("gujarati", 0x0A80, 0x0AFF), ("tamil", 0x0B80, 0x0BFF), ("telugu", 0x0C00, 0x0C7F),
    ("kannada", 0x0C80, 0x0CFF), ("malayalam", 0x0D00, 0x0D7F), ("thai", 0x0E00, 0x0E7F), ("georgian", 0x10A0, 0x10FF),
    ("hangul", 0x1100, 0x11FF), ("latin", 0x1E00, 0x1EFF), ("greek", 0x1F00, 0x1FFF), ("kana", 0x3040, 0x30FF),
    ("han", 0x3400, 0x9FFF), ("hangul", 0xAC00, 0xD7AF), ("han", 0x20000, 0x323AF),
)
SCRIPTS = ("other", *dict.fromkeys(name for name, _, _ in SCRIPT_RANGES))


@lru_cache(maxsize=1)
def _tables() -> tuple[np.ndarray, np.ndarray]:
    """By code point: the lower-case letter (0: no letter) and the script."""
    lower = np.zeros(0x110000, dtype=np.uint32)
    for point in range(0x110000):
        sign = chr(point)
        if sign.isalpha():
            small = sign.lower()
            lower[point] = ord(small) if len(small) == 1 else point
    script = np.zeros(0x110000, dtype=np.uint8)
    for name, first, last in SCRIPT_RANGES:
        script[first : last + 1] = SCRIPTS.index(name)
    return lower, script


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def letter_features(low: np.ndarray) -> np.ndarray:
    """One feature per letter: the letter between its neighbours, a word's edge being no letter. Hashed."""
    edged = np.concatenate(([0], low, [0])).astype(np.uint64)
    mixed = edged[1:-1] * np.uint64(0x9E3779B97F4A7C15) + edged[:-2] * np.uint64(0xC2B2AE3D27D4EB4F) + edged[2:] * np.uint64(0x165667B19E3779F9)
    mixed ^= mixed >> np.uint64(29)
    return ((mixed * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(48)).astype(np.int64)[low > 0]


@dataclass(frozen=True)
class LanguageModel:
    """Log-likelihoods (feature, language) and which languages use which script."""

    languages: tuple[str, ...]
    scores: np.ndarray
    uses: np.ndarray


def fit_languages(transcripts: DataFrame, least_script_share: float = 0.001, most_languages: int = 512) -> LanguageModel:
    """Count letter features and scripts of every labelled transcript, by language.

    Needs ``transcript`` and ``language``; rows where either is null teach nothing. Tasks add up their rows in
    arrays of fixed size and only those sums are shuffled. What comes to the driver has languages * (FEATURES +
    scripts) numbers at most, and more than ``most_languages`` labels are an error, so the model that tasks get has
    a known size. A language is a candidate for a script that has at least ``least_script_share`` of its letters.
    """
    rows = only(transcripts, "transcript", "language").where("transcript IS NOT NULL AND language IS NOT NULL")
    arrow_batches(rows.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lower, script = _tables()
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for text, language in zip(batch.column("transcript"), batch.column("language"), strict=True):
                points = _points(text.as_py())
                low = lower[points]
                held = sums.setdefault(language.as_py(), np.zeros(FEATURES + len(SCRIPTS), dtype=np.int64))
                held[:FEATURES] += np.bincount(letter_features(low), minlength=FEATURES)
                held[FEATURES:] += np.bincount(script[points[low > 0]], minlength=len(SCRIPTS))
        for language, held in sums.items():
            at = np.flatnonzero(held)
            yield pa.RecordBatch.from_arrays([pa.array([language] * len(at), pa.string()), pa.array(at, pa.int64()), pa.array(held[at], pa.int64())], ["language", "feature", "n"])

    summed = cut_lineage(rows.mapInArrow(count, "language string, feature long, n long").groupBy("language", "feature").agg(F.sum("n").alias("n")))
    labels = summed.agg(F.count_distinct("language")).first()[0]
    if labels > most_languages:
        raise ValueError(f"{labels} language labels, at most {most_languages} can be learned")
    counted = summed.toPandas()
    languages = tuple(sorted(counted["language"].unique()))
    sums = np.zeros((FEATURES + len(SCRIPTS), len(languages)))
    sums[counted["feature"].to_numpy(dtype=np.int64), [languages.index(x) for x in counted["language"]]] = counted["n"]
    features, scripts = sums[:FEATURES] + 0.5, sums[FEATURES:]
    scores = np.log(features / features.sum(0, keepdims=True)).astype(np.float32) if languages else np.zeros((FEATURES, 0), np.float32)
    return LanguageModel(languages, scores, scripts >= least_script_share * np.maximum(scripts.sum(0, keepdims=True), 1))


def word_scores(points: np.ndarray, model: LanguageModel, slice_points: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each word (a run of letters) and its score in each language, in slices of bounded size."""
    lower, script = _tables()
    letter = lower[points] > 0
    starts = np.flatnonzero(letter & ~np.concatenate(([False], letter[:-1])))
    ends = np.flatnonzero(letter & ~np.concatenate((letter[1:], [False]))) + 1
    total = np.zeros((len(starts), len(model.languages)), dtype=np.float32)
    first = 0
    while first < len(starts):
        last = max(first + 1, int(np.searchsorted(ends, starts[first] + slice_points)))
        own = points[starts[first] : ends[last - 1]]
        low = lower[own]
        at = np.cumsum(low > 0)[starts[first:last] - starts[first]] - 1
        total[first:last] = np.add.reduceat(model.scores[letter_features(low)], at, axis=0)
        first = last
    # A script that some languages use leaves only those as candidates.
    uses = model.uses[script[points[starts]]]
    uses |= ~uses.any(1, keepdims=True)
    total[~uses] = -1e6
    return starts, ends, total


def best_paths(scores: np.ndarray, firsts: np.ndarray, counts: np.ndarray, penalty: float) -> np.ndarray:
    """Viterbi for many texts at once: text i has the ``counts[i]`` rows of ``scores`` from ``firsts[i]``.

    A path pays ``penalty`` for each change of language. Step t handles the t-th word of every text that has one.
    """
    order = np.argsort(-counts, kind="stable")
    firsts, counts = firsts[order], counts[order]
    longest = int(counts[0]) if len(counts) else 0
    alive = np.searchsorted(-counts, -np.arange(1, longest + 1), side="right")
    value = np.zeros((len(counts), scores.shape[1]), dtype=np.float64)
    from_best = np.zeros(len(scores), dtype=np.uint8 if scores.shape[1] < 256 else np.int32)
    stays = np.ones(scores.shape, dtype=bool)
    for t in range(longest):
        n = alive[t]
        rows = firsts[:n] + t
        if t:
            v = value[:n]
            best = v.argmax(1)
            switched = v[np.arange(n), best] - penalty
            stay = v >= switched[:, None]
            from_best[rows], stays[rows] = best, stay
            value[:n] = np.where(stay, v, switched[:, None])
        value[:n] += scores[rows]
    labels = np.zeros(len(scores), dtype=np.int32)
    state = value.argmax(1)
    for t in range(longest - 1, -1, -1):
        n = alive[t]
        rows = firsts[:n] + t
        labels[rows] = state[:n]
        state[:n] = np.where(stays[rows, state[:n]], state[:n], from_best[rows])
    return labels


def label_texts(texts: list[str], model: LanguageModel, penalty: float, slice_points: int) -> list[tuple[str, float, list[dict]]]:
    """Language, score and spans of each text."""
    if not model.languages:
        return [(UNKNOWN, 0.0, [])] * len(texts)
    words = [word_scores(_points(text), model, slice_points) for text in texts]
    counts = np.array([len(w[0]) for w in words], dtype=np.int64)
    firsts = np.cumsum(counts) - counts
    labels = best_paths(np.concatenate([w[2] for w in words]), firsts, counts, penalty)
    found = []
    for (starts, ends, _), first, n in zip(words, firsts, counts, strict=True):
        if not n:
            found.append((UNKNOWN, 0.0, []))
            continue
        own = labels[first : first + n]
        letters = np.bincount(own, weights=ends - starts, minlength=len(model.languages))
        turns = np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1])))
        closes = np.concatenate((turns[1:], [n])) - 1
        spans = [{"start": int(starts[a]), "end": int(ends[b]), "language": model.languages[own[a]]} for a, b in zip(turns, closes, strict=True)]
        best = int(letters.argmax())
        found.append((model.languages[best], float(letters[best] / letters.sum()), spans))
    return found


def label_languages(transcripts: DataFrame, model: LanguageModel, switch_penalty: float = 12.0, batch_points: int = 1_000_000, passing: Sequence[str] = ()) -> DataFrame:
    """Language of whole transcripts, and spans where it changes.

    Reads only ``transcript``; returns ``asset_id`` and the columns named in ``passing``, ``language`` (that of most letters; ``und`` without letters),
    ``score`` (its share of the letters, 0 for ``und``) and ``spans``, an array of (start, end, language) in code
    points, one per run of words with one label.

    A word's script narrows the languages it may have. Its score in each is the log-likelihood of its letters, and
    the best sequence of labels pays ``switch_penalty`` for each change, so a foreign name does not cut a text but
    a foreign sentence does. About ``batch_points`` characters are scored at a time; longer texts in slices.

    Defined cases: null, empty and letterless texts are ``und``; without a learned language everything is;
    languages that tie are taken in alphabetical order; rows that repeat an id stay separate; an empty table gives
    an empty result; other columns are ignored.
    """
    keep = list(dict.fromkeys(["asset_id", *passing]))
    df = only(transcripts, *dict.fromkeys([*keep, "transcript"]))
    arrow_batches(df.sparkSession)
    shared: Broadcast = df.sparkSession.sparkContext.broadcast(model)
    spans_type = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("language", pa.string())]))
    schema = T.StructType([*[df.schema[name] for name in keep], *T._parse_datatype_string("language string, score double, spans array<struct<start:int,end:int,language:string>>").fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = shared.value
        most = max(1, 4 * batch_points // max(4, len(held.languages)))
        for batch in batches:
            texts = [text.as_py() or "" for text in batch.column("transcript")]
            order = sorted(range(len(texts)), key=lambda i: len(texts[i]))
            while order:
                # Texts of like length go together: the steps of the path search are those of the longest.
                own, size = [], 0
                while order and (not own or size + len(texts[order[-1]]) <= most):
                    own.append(order.pop())
                    size += len(texts[own[-1]])
                found = label_texts([texts[i] for i in own], held, switch_penalty, most)
                yield pa.RecordBatch.from_arrays(
                    [*[batch.column(name).take(pa.array(own)) for name in keep], pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64()), pa.array([f[2] for f in found], spans_type)],
                    [*keep, "language", "score", "spans"])

    return df.mapInArrow(run, schema)
