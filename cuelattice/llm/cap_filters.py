"""Embedding near-duplicates by spherical-cap filters of structured random product codes."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cuelattice.llm.buckets import Arrays, bucket_pairs
from cuelattice.llm.components import components
from cuelattice.llm.records import arrow_batches, only
from cuelattice.session import cut_lineage


@lru_cache(maxsize=8)
def _caps(dimension: int) -> tuple[np.ndarray, np.ndarray]:
    """Angles from 0 to pi, and the share of the unit sphere within each of a direction."""
    angles = np.linspace(0, math.pi, 20_001)
    density = np.sin(angles) ** (dimension - 2)
    share = np.concatenate(([0.0], np.cumsum((density[1:] + density[:-1]) / 2)))
    return angles, share / share[-1]


@dataclass(frozen=True)
class CapPlan:
    """Cap height in units of 1 / sqrt(dimension), number of product codes, blocks of a code and words of a block."""

    height: float
    codes: int
    blocks: int
    words: int


def plan_caps(rows: int, dimension: int, cosine: float, occupancy: int, common: float, codes: int, most_words: int = 512) -> CapPlan:
    """Filters for ``rows`` vectors of a dimension, a rule that is the same at every size.

    Rotations make every filter a uniform direction on the sphere, so shares are those of spherical caps; dimensions
    below 4 count as 4.

    The cap is as high as leaves ``occupancy`` unrelated vectors in a filter; the number of filters is what gives
    a pair at exactly ``cosine`` an expected ``common`` filters in common (closer pairs have more). The filters are
    dealt to ``codes`` product codes with rotations of their own: filters of one code share words, so a pair that
    is unlucky in one is not so in the others. A code has ``words ** blocks`` filters, in two blocks until a block
    needs more than ``most_words`` words.
    """
    share = min(0.25, occupancy / max(rows, 1))
    n = max(4, dimension)
    angles, within = _caps(n)
    top = float(np.interp(share, within, angles))
    low = math.cos(top)
    # The product with one vector is cos(x); that with the other then depends on a direction in one dimension less.
    x = np.linspace(0, top, 4001)[1:]
    need = np.clip((low - cosine * np.cos(x)) / (math.sqrt(1 - cosine * cosine) * np.sin(x)), -1, 1)
    other = np.interp(np.arccos(need), *_caps(n - 1))
    density = np.sin(x) ** (n - 2) / np.sum((np.sin(angles) ** (n - 2))[1:] * (angles[1] - angles[0]))
    both = float(np.sum(density * other) * (x[1] - x[0]))
    low *= math.sqrt(dimension)
    filters = common / max(both, 1e-300) / codes
    blocks = 2
    while filters ** (1 / blocks) > most_words:
        blocks += 1
    return CapPlan(low, codes, blocks, max(2, math.ceil(filters ** (1 / blocks))))


@lru_cache(maxsize=8)
def code_books(dimension: int, plan: CapPlan, seed: int) -> list[tuple[np.ndarray, tuple[np.ndarray, ...]]]:
    """Rotation and blocks of random unit words of each code; a filter direction is one word of every block."""
    cuts = np.linspace(0, dimension, min(plan.blocks, dimension) + 1).astype(int)
    codes = []
    for code in range(plan.codes):
        rng = np.random.default_rng((seed, dimension, code))
        rotation, _ = np.linalg.qr(rng.standard_normal((dimension, dimension)))
        books = []
        for a, b in zip(cuts, cuts[1:], strict=False):
            words = rng.standard_normal((plan.words, b - a))
            books.append(words / np.linalg.norm(words, axis=1, keepdims=True) / math.sqrt(len(cuts) - 1))
        codes.append((rotation, tuple(books)))
    return codes


def decoded(unit: np.ndarray, plan: CapPlan, seed: int) -> np.ndarray:
    """Numbers of all filters that a unit vector falls into, over all codes."""
    height, size = plan.height / math.sqrt(len(unit)), plan.words ** plan.blocks
    return np.concatenate([filters_of(unit @ rotation, books, height) + code * size for code, (rotation, books) in enumerate(code_books(len(unit), plan, seed))])


def filters_of(vector: np.ndarray, books: tuple[np.ndarray, ...], height: float) -> np.ndarray:
    """List decoding: numbers of all filters whose direction has a product of ``height`` or more with the unit vector.

    Blocks are taken in turn, and a choice of words goes on only if the best words of the blocks to come could
    still lift it to the height.
    """
    at, parts = 0, []
    for book in books:
        parts.append(book @ vector[at : at + book.shape[1]])
        at += book.shape[1]
    rest = np.cumsum([p.max() for p in parts[::-1]])[::-1]
    sums, found = np.zeros(1), np.zeros(1, dtype=np.int64)
    for k, part in enumerate(parts):
        bound = height - (rest[k + 1] if k + 1 < len(parts) else 0.0)
        grid = sums[:, None] + part[None, :]
        i, j = np.nonzero(grid >= bound)
        sums, found = grid[i, j], found[i] * len(part) + j
    return found


def close_pairs(cosine: float):
    """Comparison for ``bucket_pairs``: all pairs of a group with at least that cosine, in double precision."""

    def compare(held: Arrays, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for start, size in zip(starts, sizes, strict=True):
            node = held["node"][start : start + size]
            unit = np.stack(held["vector"][start : start + size]).astype(np.float64)
            unit /= np.linalg.norm(unit, axis=1, keepdims=True)
            if "_side" in held and len(np.unique(side := held["_side"][start : start + size])) == 2:
                one, two = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
                i, j = np.nonzero(unit[one] @ unit[two].T >= cosine)
                i, j = one[i], two[j]
            else:
                i, j = np.nonzero(np.triu(unit @ unit.T >= cosine, 1))
            left.append(np.minimum(node[i], node[j]))
            right.append(np.maximum(node[i], node[j]))
        return np.concatenate(left), np.concatenate(right)

    return compare


def embedding_groups(
    embeddings: DataFrame, cosine: float = 0.9, occupancy: int = 32, common: float = 20.0, codes: int = 16, seed: int = 3, most: int = 1024,
) -> DataFrame:
    """Group vectors linked by a cosine of at least ``cosine``.

    The project stores no embeddings, so this operator is general: it needs ``vec_id`` and ``embedding`` (array of
    floats or doubles) and returns one row per vector: ``vec_id``, ``n_links`` (other vectors linked directly),
    ``component_id`` (smallest vec_id reachable, its own included) and ``kept`` (vec_id = component_id).

    Equal vectors are one before the search. Every vector is list-decoded to all filters of a random product code
    whose direction is within its cap, vectors are joined on filters, and pairs that meet are verified in double
    precision, so no link is below the threshold. A pair at the threshold has ``common`` filters in common on
    average, so the search is probabilistic: measured recall is in the tests and above 0.99. Filters of any size
    are compared in bounded blocks (``bucket_pairs``); nothing is capped.

    Defined cases: vectors that are null, empty, zero or hold null or non-finite components link with nothing and
    are their own component; vectors of different length never link; a null vec_id is ignored in the smallest
    (``kept`` is false for it); rows that repeat an id are vectors of their own, and all those whose vec_id is the
    component's are kept; an empty table gives an empty result; other columns are ignored.
    """
    rows = only(embeddings, "vec_id", "embedding").select("vec_id", F.col("embedding").alias("_v"))
    arrow_batches(rows.sparkSession)
    element = rows.schema["_v"].dataType.elementType
    square = F.aggregate("_v", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    sound = F.coalesce(F.forall("_v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & (square > 0) & (square < float("inf")), F.lit(False))
    rows = rows.withColumn("_ok", sound)
    grouped = rows.where("_ok").groupBy("_v").agg(F.min("vec_id").alias("least"), F.count("*").alias("copies"))
    # Written, so that the numbers given to distinct vectors stay the same for all readers.
    distinct = cut_lineage(grouped.withColumn("node", F.monotonically_increasing_id()))
    plans = {r.n: plan_caps(r["count"], r.n, cosine, occupancy, common, codes) for r in distinct.groupBy(F.size("_v").alias("n")).count().collect()}

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                vectors = [np.asarray(v.values) for v in part.column("_v")]
                filters = [decoded(v / np.linalg.norm(v), plans[len(v)], seed) for v in (x.astype(np.float64) for x in vectors)]
                times = [len(f) for f in filters]
                lengths = np.repeat([len(v) for v in vectors], times)
                values = pa.array(np.concatenate([np.tile(v, n) for v, n in zip(vectors, times, strict=True)]))
                offsets = np.concatenate(([0], np.cumsum(lengths))).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(lengths, pa.int64()), pa.array(np.concatenate(filters), pa.int64()),
                     pa.array(np.repeat(part.column("node").to_numpy(), times), pa.int64()), pa.ListArray.from_arrays(offsets, values)],
                    ["length", "filter", "node", "vector"])

    schema = f"length long, filter long, node long, vector array<{element.simpleString()}>"
    met = distinct.select("node", "_v").mapInArrow(decode, schema)
    links = cut_lineage(bucket_pairs(met, ["length", "filter"], "node", close_pairs(cosine), most))
    both = links.union(links.selectExpr("b AS a", "a AS b"))
    counts = distinct.select(F.col("node").alias("b"), "copies")
    degrees = both.join(counts, "b").groupBy("a").agg(F.sum("copies").alias("near")).withColumnRenamed("a", "node")
    members = components(links).join(distinct.select("node", "least"), "node")
    groups = members.groupBy("root").agg(F.min("least").alias("component_id"))
    linked = members.join(groups, "root").select("node", "component_id").join(degrees, "node")
    known = cut_lineage(distinct.select("node", "_v", "least", "copies").join(linked, "node", "left").select(
        "_v", (F.col("copies") - 1 + F.coalesce("near", F.lit(0))).alias("n_links"), F.coalesce("component_id", "least").alias("component_id")))
    result = [F.col("vec_id"), F.col("n_links").cast("long"), F.col("component_id")]
    out = rows.where("_ok").join(known, "_v").select(*result).unionByName(
        rows.where("NOT _ok").withColumns({"n_links": F.lit(0), "component_id": F.col("vec_id")}).select(*result))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
