"""URL filters: host and path rules first, then naive Bayes over words that Viterbi finds in names."""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import lru_cache
from math import log

import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cuelattice.llm.records import arrow_batches, only, without
from cuelattice.session import cut_lineage

#: Letters of a name between its signs and digits.
PIECE = re.compile(r"[^\W\d_]+")
#: Longest word of the unigram model, and the least share of all words (of all tokens) that a word of a model has:
#: a model has at most 1 / share entries, whatever the size of the corpus.
LONGEST, LEAST_SHARE = 24, 1e-6
#: Words of hosts that nobody wants in a corpus; the examples the classifier starts from.
UNWANTED = ("adult", "ads", "bets", "betting", "casino", "cheap", "escort", "jackpot", "malware", "phishing", "pills", "poker", "porn", "slots", "spam", "torrent", "viagra", "warez", "xxx")


@dataclass(frozen=True)
class Rule:
    """Verdict on a host with its subdomains and on paths that begin with ``path``."""

    verdict: str
    host: str
    path: str = "/"


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url; both empty if it is null or has no ``://``."""
    there = F.coalesce(url.contains("://"), F.lit(False))
    after = F.regexp_extract(url, r"(?s)\A.*?://(.*)\z", 1)
    host = F.translate(F.regexp_extract(after, r"(?s)\A([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    path = F.regexp_extract(after, r"(?s)\A[^/?#]*([^?#]*)", 1)
    return F.when(there, host).otherwise(""), F.when(there, path).otherwise("")


def fitting_rule(host: Column, path: Column, rules: Sequence[Rule]) -> Column:
    """``name`` and ``verdict`` of the longest rule that fits, else null. Of equally long rules the first one listed counts."""
    best = F.lit(None).cast("struct<name: string, verdict: string>")
    for rule in sorted(rules, key=lambda r: len(r.host) + len(r.path)):
        fits = ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)
        best = F.when(fits, F.struct(F.lit(rule.host + rule.path).alias("name"), F.lit(rule.verdict).alias("verdict"))).otherwise(best)
    return best


def word_counts(texts: DataFrame, text: str) -> DataFrame:
    """``word`` and ``n`` of all words of one script's letters in a text column, lower-cased; tags of a page don't count."""
    bare = F.lower(F.regexp_replace(F.col(text), r"(?s)<(script|style)\b.*?</\1>|<[^>]*>|&\w+;", " "))
    words = F.explode(F.regexp_extract_all(bare, F.lit(r"(\p{L}+)")))
    return texts.select(words.alias("word")).where(F.length("word") <= LONGEST).groupBy("word").agg(F.count("*").alias("n"))


def _bounded(counts: DataFrame, key: str) -> tuple[dict[str, float], float]:
    """Rows of a count table with at least ``LEAST_SHARE`` of all counts, and the sum of all; at most a million rows."""
    counts = cut_lineage(counts)
    total = counts.agg(F.sum("n")).first()[0] or 0
    held = counts.where(F.col("n") >= LEAST_SHARE * total).select(key, "n").toPandas()
    return dict(zip(held[key], held["n"].astype(float), strict=True)), float(total)


@dataclass(frozen=True)
class Segmenter:
    """Broadcast costs of words; ``words()`` is for use inside tasks."""

    costs: Broadcast

    def words(self, piece: str) -> tuple[str, ...]:
        return _segmented(self.costs, piece)


@lru_cache(maxsize=1 << 16)
def _segmented(costs: Broadcast, piece: str) -> tuple[str, ...]:
    return tuple(segment(piece, *costs.value))


def segment(piece: str, costs: dict[str, float], unknown: float) -> list[str]:
    """Cheapest split of a piece into words (unigram Viterbi); of equally cheap ones that with the longest last word.

    A known word costs minus the logarithm of its share; what no word covers costs ``unknown`` once and the logarithm
    of 26 a letter, so names that are no words stay together.
    """
    n, letter = len(piece), log(26)
    least = [0.0] + [float("inf")] * n
    # Where the last word begins, and the cost if it is an unknown one still open.
    back, gap, gap_back = [0] * (n + 1), [float("inf")] * (n + 1), [0] * (n + 1)
    for end in range(1, n + 1):
        opened, going = least[end - 1] + unknown + letter, gap[end - 1] + letter
        gap[end], gap_back[end] = (going, gap_back[end - 1]) if going <= opened else (opened, end - 1)
        least[end], back[end] = gap[end], gap_back[end]
        for start in range(max(0, end - LONGEST), end):
            cost = costs.get(piece[start:end])
            if cost is not None and least[start] + cost < least[end]:
                least[end], back[end] = least[start] + cost, start
    out, at = [], n
    while at:
        out.append(piece[back[at] : at])
        at = back[at]
    return out[::-1]


def fit_segmenter(counts: DataFrame) -> Segmenter:
    """Unigram model from ``word`` and ``n``; words with less than a millionth of all counts are left out."""
    held, total = _bounded(counts, "word")
    costs = {word: log(total / n) for word, n in held.items()}
    return Segmenter(counts.sparkSession.sparkContext.broadcast((costs, log(max(total, 1.0)))))


def name_tokens(rows: DataFrame, segmenter: Segmenter, keep: Sequence[str] = ()) -> DataFrame:
    """``rows`` with ``tokens``: the words in the host's and in the path's names, path words with a slash before them."""
    names = ["host", "path", *keep]
    frame = only(rows, *names)
    arrow_batches(frame.sparkSession)

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for host, path in zip(batch.column("host").to_pylist(), batch.column("path").to_pylist(), strict=True):
                own = [w for piece in PIECE.findall(host or "") for w in segmenter.words(piece.lower())]
                out.append(own + ["/" + w for piece in PIECE.findall(path or "") for w in segmenter.words(piece.lower())])
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in names], pa.array(out, pa.list_(pa.string()))], [*names, "tokens"])

    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in frame.schema.fields)
    return frame.mapInArrow(split, f"{types}, tokens array<string>")


@dataclass(frozen=True)
class UrlModel:
    """Segmenter, prior log odds of block, and broadcast log odds of tokens."""

    segmenter: Segmenter
    prior: float
    odds: Broadcast


def fit_url_model(urls: DataFrame, segmenter: Segmenter, unwanted: Sequence[str] = UNWANTED, smoothing: float = 1.0) -> UrlModel:
    """Multinomial naive Bayes of names, from ``host`` and ``path`` and, if there, a boolean ``block``.

    Without ``block`` (or where it is null) a url is an example of block if one of its host words is ``unwanted``. All
    urls are counted; a token's share in a class is drawn towards its share in all urls with the weight of ``smoothing``
    tokens, so a token is evidence only for the class in which it is relatively more frequent. Tokens with less than a
    millionth of all counts are left out of the model.
    """
    given = [c for c in urls.columns if c == "block"]
    split = name_tokens(urls, segmenter, given)
    named = F.arrays_overlap("tokens", F.lit(list(unwanted)))
    label = F.coalesce(*[F.col(c) for c in given], named).alias("block")
    counted = split.select(label, "tokens").groupBy("block").agg(F.count("*").alias("urls"), F.sum(F.size("tokens")).alias("tokens")).collect()
    urls_of = {row["block"]: row["urls"] for row in counted}
    size = {row["block"]: row["tokens"] for row in counted}
    tokens = split.select(label, F.explode("tokens").alias("token")).groupBy("token").agg(
        F.count("*").alias("n"), F.count_if("block").alias("blocked"))
    total = sum(size.values())
    held = tokens.where(F.col("n") >= LEAST_SHARE * total).toPandas()
    odds = {}
    for token, n, blocked in zip(held["token"], held["n"].astype(float), held["blocked"].astype(float), strict=True):
        drawn = smoothing * n / total
        bad, good = ((k + drawn) / (size.get(c, 0) + smoothing) for c, k in ((True, blocked), (False, n - blocked)))
        odds[token] = log(bad / good)
    prior = log((urls_of.get(True, 0) + 1) / (urls_of.get(False, 0) + 1))
    return UrlModel(segmenter, prior, urls.sparkSession.sparkContext.broadcast(odds))


def judge_urls(rows: DataFrame, rules: Sequence[Rule], model: UrlModel) -> DataFrame:
    """``rows`` with ``host``, ``path``, ``rule``, ``verdict`` (``block`` or ``allow``) and ``block_odds``.

    ``rows`` has ``url``; the project keeps no web addresses in its records, so the operator is general. Other columns
    pass through, except those named like a result. The host is what follows the first ``://`` up to ``/``, ``?``,
    ``#`` or the end, A-Z lower-cased; the path what follows it up to ``?``, ``#`` or the end; null and other urls have
    both empty, which no rule fits and which hold no token, so the prior decides. The longest fitting rule gives the
    verdict; elsewhere a url is blocked if the log odds of its tokens (``block_odds``, natural logarithm) exceed 0.

    One pass, row by row: no shuffle, no state but the two models, which have at most a million entries each.
    """
    url = F.col("url").cast("string")
    host, path = url_parts(url)
    own = without(rows, "host", "path", "rule", "verdict", "block_odds", "tokens", "_row")
    parted = own.select(F.struct(*[F.col(f"`{c}`") for c in own.columns]).alias("_row"), host.alias("host"), path.alias("path"))
    segmenter, odds, prior = model.segmenter, model.odds, model.prior

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = odds.value
        for batch in batches:
            out = []
            for host, path in zip(batch.column("host").to_pylist(), batch.column("path").to_pylist(), strict=True):
                found = sum(held.get(w, 0.0) for piece in PIECE.findall(host) for w in segmenter.words(piece.lower()))
                found += sum(held.get("/" + w, 0.0) for piece in PIECE.findall(path) for w in segmenter.words(piece.lower()))
                out.append(prior + found)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.float64())], [*batch.schema.names, "block_odds"])

    arrow_batches(rows.sparkSession)
    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in parted.schema.fields)
    scored = parted.mapInArrow(score, f"{types}, block_odds double").withColumn("_rule", fitting_rule(F.col("host"), F.col("path"), rules))
    by_method = F.when(F.col("block_odds") > 0, "block").otherwise("allow")
    return scored.select("_row.*", "host", "path", F.col("_rule.name").alias("rule"), F.coalesce("_rule.verdict", by_method).alias("verdict"), "block_odds")
