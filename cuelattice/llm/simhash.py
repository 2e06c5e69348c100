"""SimHash near-duplicates of transcripts by covering locality-sensitive hashing."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cuelattice.llm.buckets import Arrays, bucket_pairs
from cuelattice.llm.components import components
from cuelattice.llm.records import arrow_batches, only, without
from cuelattice.session import cut_lineage

BITS = 64
#: Shingle hashes added up at a time.
STRIDE = 8192


def shingle_hashes(text: bytes, words: int) -> np.ndarray:
    """XXH64 (seed 42) of every run of ``words`` words, lower-cased A-Z, space-joined; of all words if they are fewer."""
    own = text.lower().split()
    if not own:
        return np.zeros(0, dtype=np.uint64)
    ends = np.cumsum(np.fromiter(map(len, own), dtype=np.int64, count=len(own)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    k = min(words, len(own))
    joined, digest = memoryview(b" ".join(own)), xxhash.xxh64_intdigest
    spans = zip(starts[: len(own) - k + 1].tolist(), ends[k - 1 :].tolist(), strict=True)
    return np.fromiter((digest(joined[a:b], 42) for a, b in spans), dtype=np.uint64, count=len(own) - k + 1)


def fingerprint(hashes: np.ndarray) -> int:
    """Bits set in more than half of the hashes, as a signed 64-bit number; 0 without hashes."""
    sums = np.zeros(BITS, dtype=np.int64)
    for at in range(0, len(hashes), STRIDE):
        sums += np.unpackbits(hashes[at : at + STRIDE].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * sums > len(hashes), bitorder="little").view("<i8")[0])


def fingerprints(transcripts: DataFrame, words: int = 4) -> DataFrame:
    """``asset_id`` and ``bits`` (the fingerprint as a long) of every transcript, from its whole text."""
    df = only(transcripts, "asset_id", "transcript").select("asset_id", F.col("transcript").cast("binary").alias("transcript"))
    schema = T.StructType([df.schema["asset_id"], T.StructField("bits", T.LongType())])
    arrow_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bits = [fingerprint(shingle_hashes(text.as_py() or b"", words)) for text in batch.column("transcript")]
            yield pa.RecordBatch.from_arrays([batch.column("asset_id"), pa.array(bits, pa.int64())], ["asset_id", "bits"])

    return df.mapInArrow(run, schema)


def covering_masks(radius: int, seed: int = 5) -> list[int]:
    """Masks of which one misses any ``radius`` given positions of a fingerprint.

    Each position gets a non-zero vector of ``radius + 1`` bits, evenly and in a seeded order. Mask v, for every
    non-zero v of as many bits, has the positions whose vector has an odd product with v. The vectors of ``radius``
    positions leave some v with which all of them have an even product, so mask v misses them, and fingerprints
    that differ in those positions alone are equal under it. There are 2 ** (radius + 1) - 1 masks, each of about
    half the positions.
    """
    count = (1 << (radius + 1)) - 1
    vectors = 1 + np.random.default_rng(seed).permutation(BITS) % count
    masks = [sum(1 << p for p in range(BITS) if (int(vectors[p]) & v).bit_count() & 1) for v in range(1, count + 1)]
    return [mask - (1 << BITS) if mask >> (BITS - 1) else mask for mask in masks]


def linked_forest(radius: int):
    """Comparison for ``bucket_pairs``: links that connect what is within ``radius`` bits in a group, no more than needed."""

    def compare(held: Arrays, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        bits = held["bits"].view(np.uint64)
        two = starts[sizes == 2]
        close = two[np.bitwise_count(bits[two] ^ bits[two + 1]) <= radius]
        left, right = [close], [close + 1]
        for start, size in zip(starts[sizes > 2], sizes[sizes > 2], strict=True):
            own, todo = bits[start : start + size], np.arange(size)
            while len(todo):
                queue, todo = [todo[0]], todo[1:]
                while queue and len(todo):
                    at = queue.pop()
                    near = np.bitwise_count(own[todo] ^ own[at]) <= radius
                    if near.any():
                        new, todo = todo[near], todo[~near]
                        left.append(np.full(len(new), start + at))
                        right.append(start + new)
                        queue.extend(new)
        return held["bits"][np.concatenate(left)], held["bits"][np.concatenate(right)]

    return compare


def near_fingerprints(distinct: DataFrame, radius: int, most: int = 2048) -> DataFrame:
    """Links (a, b) that connect the distinct fingerprints ``bits`` within ``radius`` of each other.

    Every fingerprint is in one bucket of each mask, so any two within the radius meet in one; groups of close
    fingerprints are linked by trees, not by all pairs.
    """
    masks = covering_masks(radius)
    table = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(len(masks) - 1).cast("long")))
    rows = distinct.select("bits", table.alias("mask")).withColumn(
        "under", F.col("bits").bitwiseAND(F.element_at(F.array(*[F.lit(m).cast("long") for m in masks]), (F.col("mask") + 1).cast("int"))))
    return bucket_pairs(rows, ["mask", "under"], "bits", linked_forest(radius), most)


def simhash_groups(transcripts: DataFrame, words: int = 4, radius: int = 4, most: int = 2048) -> DataFrame:
    """Group transcripts whose SimHash fingerprints are linked by steps of ``radius`` differing bits or fewer.

    Needs ``asset_id`` and ``transcript``; returns ``asset_id``, ``bits`` (the 64-bit fingerprint of all runs of
    ``words`` words, repeats included, as a long), ``fingerprint`` (16 hexadecimal digits) and ``component_id``: the
    smallest asset_id of the group, the row's own included. The search is exact: covering masks miss no link.

    Copies are one fingerprint before the search, which sees distinct fingerprints only, and bucket sizes are
    bounded by blocks (``bucket_pairs``). Groups come from ``components``.

    Defined cases: null and empty transcripts have fingerprint 0 and are linked like others; a transcript of fewer
    words is one run; null asset_ids are ignored in the smallest, which is null if a group has no other; rows that
    repeat an id stay separate; an empty table gives an empty result; other columns are ignored.
    """
    rows = cut_lineage(fingerprints(transcripts, words))
    distinct = cut_lineage(rows.groupBy("bits").agg(F.min("asset_id").alias("least")))
    grouped = components(near_fingerprints(distinct, radius, most))
    members = grouped.join(distinct, grouped["node"] == distinct["bits"]).select("bits", "root", "least")
    groups = members.groupBy("root").agg(F.min("least").alias("component_id"))
    joined = members.join(groups, "root").select("bits", "component_id")
    # Written, so that the last join deals both its sides anew and can split a fingerprint with very many rows.
    ids = cut_lineage(distinct.join(joined, "bits", "left").select("bits", F.coalesce("component_id", "least").alias("component_id")))
    return rows.join(ids, "bits").select("asset_id", "bits", F.lower(F.lpad(F.hex("bits"), 16, "0")).alias("fingerprint"), "component_id")


def plan_samples(rows: int, similarity: float, farthest: int, meeting: float, occupancy: int) -> tuple[int, int]:
    """Positions of a sample and number of samples of the 128 bits for ``rows`` texts, a rule that is the same at every size.

    A sample has as many positions as leave about ``occupancy`` unrelated fingerprints with equal bits there. Of a
    pair at exactly ``similarity`` each bit differs with the same probability; there are so many samples that the
    pair is within ``farthest`` bits and equal in one sample at least with a probability of ``meeting``.
    """
    total = 2 * BITS
    positions = min(total, max(0, math.ceil(math.log2(max(1, rows / occupancy)))))
    differs = math.acos(min(1.0, 2 * similarity / (1 + similarity))) / math.pi
    d = range(min(farthest, total) + 1)
    share = np.array([math.comb(total, k) * differs**k * (1 - differs) ** (total - k) for k in d])
    equal = np.array([math.comb(total - k, positions) / math.comb(total, positions) for k in d])
    if share.sum() <= meeting:
        raise ValueError(f"pairs of similarity {similarity} are within {farthest} bits with a probability of {share.sum():.4f} only, below {meeting}")

    def chance(samples: int) -> float:
        return float((share * (1 - (1 - equal) ** samples)).sum())

    most = 1
    while chance(most) < meeting:
        most *= 2
    least = most // 2
    while most - least > 1:
        middle = (least + most) // 2
        least, most = (least, middle) if chance(middle) >= meeting else (middle, most)
    return positions, most


def sample_masks(positions: int, samples: int, seed: int = 5) -> np.ndarray:
    """Seeded samples of ``positions`` of the 128 bits: a mask of ``bits`` and one of ``more`` (as longs) for each."""
    rng = np.random.default_rng(seed)
    chosen = np.zeros((samples, 2 * BITS), dtype=np.uint8)
    for row in chosen:
        row[rng.permutation(2 * BITS)[:positions]] = 1
    return np.packbits(chosen, axis=1, bitorder="little").view("<i8")


#: Low bits of a bucket's number that hold the number of its sample; the others are a hash of the sampled bits.
SAMPLE_BITS = 16


def _near(held: Arrays, start: int, size: int, farthest: int, under: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs (i < j) of a bucket and their distance, of those within ``farthest`` bits that have different roots and meet for the first time.

    A pair that is equal under an earlier sample was in one bucket there.
    """
    bits, more, root = (held[c][start : start + size].view(np.uint64) for c in ("bits", "more", "root"))
    apart = np.bitwise_count(bits[:, None] ^ bits[None, :])
    apart += np.bitwise_count(more[:, None] ^ more[None, :])
    i, j = np.nonzero(np.triu((apart <= farthest) & (root[:, None] != root[None, :]), 1))
    for mask, beyond in under[: held["bucket"][start] & ((1 << SAMPLE_BITS) - 1)]:
        if not len(i):
            break
        new = ((bits[i] ^ bits[j]) & mask | (more[i] ^ more[j]) & beyond) != 0
        i, j = i[new], j[new]
    return i, j, apart[i, j]


def partners(farthest: int, masks: np.ndarray):
    """Comparison for ``bucket_pairs``: (node, bucket) of every row with a partner in its bucket; not the pairs."""
    under = masks.view(np.uint64)

    def compare(held: Arrays, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        found = [np.zeros(0, np.int64)]
        for start, size in zip(starts.tolist(), sizes.tolist(), strict=True):
            i, j, _ = _near(held, start, size, farthest, under)
            if len(i):
                found.append(start + np.union1d(i, j))
        at = np.concatenate(found)
        return held["node"][at], held["bucket"][at]

    return compare


def similar_forest(farthest: int, similarity: float, masks: np.ndarray):
    """Comparison for ``bucket_pairs``: verified links that connect what is similar in a bucket, no more than needed.

    A pair within ``farthest`` bits is verified on its shingle sets unless it is connected by then, or has met under
    an earlier sample, where it was verified.
    """
    under = masks.view(np.uint64)

    def compare(held: Arrays, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        left, right = [], []
        sets = held["shingles"]
        for start, size in zip(starts.tolist(), sizes.tolist(), strict=True):
            i, j, apart = _near(held, start, size, farthest, under)
            nearest = np.argsort(apart, kind="stable")
            parent = {}

            def top(x: int) -> int:
                while x in parent:  # noqa: B023
                    x = parent[x]  # noqa: B023
                return x

            roots = held["root"][start : start + size].tolist()
            for x, y in zip(i[nearest].tolist(), j[nearest].tolist(), strict=True):
                p, q = top(roots[x]), top(roots[y])
                if p == q:
                    continue
                a, b = sets[start + x], sets[start + y]
                if min(len(a), len(b)) < similarity * max(len(a), len(b)):
                    continue
                shared = len(np.intersect1d(a, b, assume_unique=True))
                if shared >= similarity * (len(a) + len(b) - shared):
                    parent[p] = q
                    left.append(start + x)
                    right.append(start + y)
        node = held["node"]
        a, b = node[np.array(left, dtype=np.int64)], node[np.array(right, dtype=np.int64)]
        return np.minimum(a, b), np.maximum(a, b)

    return compare


def rounds_of(samples: int) -> list[tuple[int, int]]:
    """Samples (from, to) of each round: few at first, so that dense groups are one before most samples are dealt."""
    ends = [0]
    while ends[-1] < samples:
        ends.append(min(samples, ends[-1] + min(64, 2 * 4 ** (len(ends) - 1))))
    return list(zip(ends[:-1], ends[1:], strict=True))


def remixed(hashes: np.ndarray) -> np.ndarray:
    """Other hashes of the same shingles, for a second fingerprint."""
    x = hashes + np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_sets(texts: DataFrame, words: int) -> DataFrame:
    """``node`` and ``shingles``: the sorted distinct shingle hashes of ``transcript`` (binary)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                sets = [np.unique(shingle_hashes(text.as_py() or b"", words)).view(np.int64) for text in part.column("transcript")]
                yield pa.RecordBatch.from_arrays([part.column("node"), pa.array(sets, pa.list_(pa.int64()))], ["node", "shingles"])

    return texts.select("node", "transcript").mapInArrow(run, "node long, shingles array<long>")


def _bucketed(rows: DataFrame, masks: np.ndarray, low: int, high: int) -> DataFrame:
    """A row per text and sample: its numbers, and the ``bucket`` of equal sampled bits, which names the sample in its low bits."""
    sample = F.explode(F.sequence(F.lit(low).cast("long"), F.lit(high - 1).cast("long"))).alias("_sample")

    def part(own: str, column: np.ndarray) -> Column:
        return F.col(own).bitwiseAND(F.element_at(F.array(*[F.lit(m).cast("long") for m in column[low:high].tolist()]), (F.col("_sample") - low + 1).cast("int")))

    hashed = F.xxhash64("_sample", part("bits", masks[:, 0]), part("more", masks[:, 1]))
    bucket = hashed.bitwiseAND(F.lit(-1 << SAMPLE_BITS).cast("long")).bitwiseOR(F.col("_sample")).alias("bucket")
    return rows.select("*", sample).select("node", "bits", "more", "root", bucket)


def near_duplicates(
    transcripts: DataFrame, words: int = 5, similarity: float = 0.8, farthest: int = 34, meeting: float = 0.999, occupancy: int = 256, most: int = 2048,
) -> DataFrame:
    """Mark transcripts whose shingle sets are similar, found by SimHash and verified.

    Needs ``asset_id`` and ``transcript`` and returns every row with all its columns plus ``component_id`` (smallest
    asset_id of its group) and ``kept`` (true for exactly one row of each group). Transcripts are linked if the sets
    of their ``words``-word shingles have a Jaccard similarity of ``similarity`` or more; equal texts are one node.

    Fingerprints of the sets have 128 bits. Candidates are equal in one of several seeded samples of the positions and
    differ in at most ``farthest`` bits. The positions of a sample grow with the logarithm of the rows, so that about
    ``occupancy`` unrelated fingerprints share a bucket, and the samples with them (``plan_samples``), so that a pair
    at ``similarity`` becomes a candidate with a probability of ``meeting`` at every size.

    Samples are dealt in rounds. A round deals a row of five numbers per text and sample and keeps the rows that have
    a partner of another group in their bucket that they meet for the first time; only these meet their shingle sets, bucket by bucket, where every
    candidate is verified that is not connected by then, and only links that connect leave the task. So no unverified
    pair is ever a row, a group of many near copies needs no pair of each two, and every pair that meets is
    verified or connected. Groups are contracted between the rounds. Measured recall is in the README.

    Defined cases: texts without words are grouped if they are equal; null transcripts count as empty; rows that
    repeat an id and a text are equal texts, one of which stays; null asset_ids come last in the smallest; an empty
    table gives an empty result; an input column named like a result column is replaced.
    """
    own = without(transcripts, "component_id", "kept")
    arrow_batches(own.sparkSession)
    text = F.coalesce("transcript", F.lit(""))
    keyed = own.withColumn("_key", F.sha2(text.cast("binary"), 256))
    kind = own.schema["asset_id"]
    schema = T.StructType([kind, T.StructField("_key", T.StringType()), T.StructField("bits", T.LongType()), T.StructField("more", T.LongType()), T.StructField("some", T.BooleanType())])

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bits, more, some = [], [], []
            for text in batch.column("transcript"):
                hashes = np.unique(shingle_hashes(text.as_py(), words))
                bits.append(fingerprint(hashes))
                more.append(fingerprint(remixed(hashes)))
                some.append(len(hashes) > 0)
            yield pa.RecordBatch.from_arrays([batch.column("asset_id"), batch.column("_key"), pa.array(bits, pa.int64()), pa.array(more, pa.int64()), pa.array(some, pa.bool_())], ["asset_id", "_key", "bits", "more", "some"])

    marked = keyed.select("asset_id", "_key", text.cast("binary").alias("transcript")).mapInArrow(mark, schema)
    first = F.min(F.struct(F.col("asset_id").isNull().alias("none"), F.col("asset_id").alias("id")))
    distinct = marked.groupBy("_key").agg(F.first("bits").alias("bits"), F.first("more").alias("more"), F.first("some").alias("some"), first.alias("least"), F.count("*").alias("copies"))
    # Written, so that the numbers given to distinct texts stay the same for all readers.
    nodes = cut_lineage(distinct.withColumn("node", F.monotonically_increasing_id()))
    masks = sample_masks(*plan_samples(nodes.count(), similarity, farthest, meeting, occupancy))
    roots = nodes.where("some").select("node", "bits", "more", F.col("node").alias("root"))
    links = sets = None
    for low, high in rounds_of(len(masks)):
        flagged = cut_lineage(bucket_pairs(_bucketed(roots, masks, low, high), ["bucket"], "node", partners(farthest, masks), most).toDF("node", "bucket"))
        wanted = flagged.select("node").distinct()
        if sets is not None:
            wanted = wanted.join(sets, "node", "left_anti")
        keys = nodes.join(wanted, "node", "left_semi").select("node", "_key")
        texts = keyed.select("_key", text.cast("binary").alias("transcript")).join(keys, "_key").groupBy("node").agg(F.first("transcript").alias("transcript"))
        more_sets = cut_lineage(shingle_sets(texts, words))
        sets = more_sets if sets is None else sets.union(more_sets)
        full = flagged.join(roots, "node").join(sets, "node")
        found = bucket_pairs(full, ["bucket"], "node", similar_forest(farthest, similarity, masks), most)
        links = found if links is None else cut_lineage(links.union(found))
        grouped = components(links)
        roots = cut_lineage(nodes.where("some").select("node", "bits", "more").join(grouped, "node", "left").select("node", "bits", "more", F.coalesce("root", "node").alias("root")))
    members = roots.select("node", "root").join(nodes.select("node", "least"), "node")
    place = F.struct(F.col("least.none").alias("none"), F.col("least.id").alias("id"), F.col("node").alias("node"))
    groups = members.groupBy("root").agg(F.min(place).alias("best"))
    grouped = members.join(groups, "root").select("node", "best")
    # Dealt by node so far, so the last join deals both its sides anew and can split a text with very many rows.
    decided = nodes.join(grouped, "node", "left").select(
        "_key", F.coalesce("best.id", "least.id").alias("component_id"), F.coalesce(F.col("best.node") == F.col("node"), F.lit(True)).alias("_best"),
        F.col("least.id").alias("_least"), "copies")
    out = keyed.join(decided, "_key")
    stays = F.col("_best") & F.col("asset_id").eqNullSafe(F.col("_least"))
    single = out.where("copies = 1").withColumn("kept", stays)
    several = out.where("copies > 1").withColumn("_spread", F.md5(F.concat_ws("|", "_key", F.coalesce(F.col("asset_id").cast("string"), F.lit("null"))))).withColumn(
        "kept", stays & (F.row_number().over(Window.partitionBy("_spread").orderBy("_key")) == 1))
    names = [F.col(f"`{n}`") for n in [*own.columns, "component_id", "kept"]]
    return single.select(*names).unionByName(several.select(*names))
