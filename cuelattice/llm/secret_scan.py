"""Secrets in transcripts: fixed forms, and random strings found by how badly a vocabulary compresses them."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from cuelattice.llm.byte_bpe import _slices
from cuelattice.llm.records import arrow_batches, only
from cuelattice.llm.vocabulary import Vocabulary

#: Fixed patterns of the base kinds, in the order their names are listed in results.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
KINDS = ("assign", "access", "hex", "random")

#: Strings that could be random: letters, digits and base64 signs. Then what is excluded: known digests and identifiers.
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{16,}")
DIGEST = re.compile(r"(?:0x)?(?:[0-9a-fA-F]{32}|[0-9a-fA-F]{40}|[0-9a-fA-F]{56}|[0-9a-fA-F]{64}|[0-9a-fA-F]{96}|[0-9a-fA-F]{128})")
UUID = re.compile(r"[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}")
#: A candidate's parts between signs. Numbers (two letters at most) are identifiers whatever their ratio.
PIECE = re.compile(r"[A-Za-z0-9]+")
NUMBER = re.compile(r"[0-9]*(?:[A-Za-z][0-9]*){0,2}")
#: Letters of one case, or capitalised: what a word could be.
WORD = re.compile(r"[A-Za-z]?[a-z]+|[A-Z]+")
#: A short name before a random part, as in ``ghp_``, belongs to it.
PREFIX = re.compile(r"[A-Za-z]{1,4}_")
SHORTEST, NEUTRAL = 16, 3

SPAN = T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("base", T.BooleanType())])
_ARROW_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("base", pa.bool_())]))


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Spans of the fixed kinds: leftmost matches without overlap in each kind, those that fail their test dropped."""
    found = [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    found += [("access", m.start(), m.end()) for m in ACCESS.finditer(text) if len(m[0]) >= 20]
    found += [("hex", m.start(), m.end()) for m in HEX.finditer(text) if len(m[0]) >= 24]
    return found


def random_spans(text: str, encoding: tiktoken.Encoding, most_ratio: float, word_ratio: float) -> list[tuple[str, int, int]]:
    """Strings with few characters per token that are no known digest or identifier.

    Every part between signs is judged by itself, so that a key inside a path is not averaged away: a part that
    could be a word by ``word_ratio`` if it has 16 letters, any other by ``most_ratio``. Neighbouring random parts are one
    string (base64 has signs anywhere), with what has up to three characters between them.
    """
    found = []
    for m in CANDIDATE.finditer(text):
        word = m[0].strip("=-_/+")
        if len(word) < SHORTEST or DIGEST.fullmatch(word):
            continue
        start = m.start() + m[0].index(word)
        uuids = [u.span() for u in UUID.finditer(word)]
        group: list[re.Match] = []

        def close() -> None:
            if sum(len(p[0]) for p in group) >= SHORTEST:
                first, last = group[0].start(), group[-1].end()
                prefix = PREFIX.fullmatch(word, max(0, word.rfind("/", 0, first) + 1), first)
                found.append(("random", start + (prefix.start() if prefix else first), start + last))
            group.clear()

        for piece in PIECE.finditer(word):
            part = piece[0]
            known = DIGEST.fullmatch(part) or NUMBER.fullmatch(part) or any(x <= piece.start() < y for x, y in uuids)
            could_be_word = WORD.fullmatch(part) is not None
            if len(part) <= NEUTRAL:
                continue
            judged = not known and (len(part) >= SHORTEST or not could_be_word)
            if judged and len(part) <= (word_ratio if could_be_word else most_ratio) * len(encoding.encode_ordinary(part)):
                group.append(piece)
            else:
                close()
        close()
    return found


def all_spans(text: str, encoding: tiktoken.Encoding, most_ratio: float, word_ratio: float) -> list[dict]:
    base = base_spans(text)
    spans = [{"kind": k, "start": s, "end": e, "base": True} for k, s, e in base]
    taken = sorted((s, e) for _, s, e in base)
    at = 0
    for k, s, e in random_spans(text, encoding, most_ratio, word_ratio):
        while at < len(taken) and taken[at][1] <= s:
            at += 1
        if not any(x < e and s < y for x, y in taken[max(0, at - 3): at + 3]):
            spans.append({"kind": k, "start": s, "end": e, "base": False})
    return sorted(spans, key=lambda x: (x["start"], KINDS.index(x["kind"])))


def find_secrets(transcripts: DataFrame, vocabulary: Vocabulary, most_ratio: float = 2.0, word_ratio: float = 1.75) -> DataFrame:
    """Secrets in whole transcripts.

    Needs ``asset_id`` and ``transcript``; returns ``asset_id`` and ``spans``, an array of
    (kind, start, end, base) in code points, end exclusive, ordered by start and then by kind. Kinds ``assign``
    (a named secret and its value), ``access`` (access key ids) and ``hex`` (long hexadecimal strings) are fixed
    patterns and have ``base`` true. The method adds ``random``: strings of 16 letters and digits or more that the
    vocabulary splits into so many tokens that they have at most ``most_ratio`` characters each, as no word of a
    known language has; letters of one case could be a word and have at most ``word_ratio``. Parts between signs are
    judged one by one, neighbouring random ones are one string. Digests of known length, UUIDs and numbers with at most
    two letters are excluded, and so is what overlaps a base span.

    Each transcript is read where it is, in one pass per pattern. Defined cases: null or empty transcript: no
    spans; rows that repeat an id stay separate; an empty table gives an empty result; other columns are ignored.
    """
    df = only(transcripts, "asset_id", "transcript")
    arrow_batches(df.sparkSession)
    key = df.schema["asset_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding = vocabulary.encoding()
        for part in _slices(batches):
            spans = [all_spans(text.as_py() or "", encoding, most_ratio, word_ratio) for text in part.column("transcript")]
            yield pa.RecordBatch.from_arrays([part.column("asset_id"), pa.array(spans, _ARROW_SPANS)], ["asset_id", "spans"])

    return df.mapInArrow(run, T.StructType([key, T.StructField("spans", T.ArrayType(SPAN))]))
