"""Alignment of two tokenizers over transcripts, scored by an inverted index of token pairs in document bitmaps."""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator, Mapping
from dataclasses import dataclass
from functools import lru_cache
from pathlib import Path
from typing import Any

import numpy as np
import pyarrow as pa
import sentencepiece
import tiktoken
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cuelattice.llm.records import arrow_batches, only
from cuelattice.session import cut_lineage

#: The mark of a space and of a byte in pieces.
SPACE_MARK, BYTE_PIECE = "▁", re.compile(r"<0x([0-9A-F]{2})>")
#: Documents of one bitmap (Spark's bitmaps have as many bits) and the bytes of text after which the next one begins.
BITMAP_DOCS, BLOCK_BYTES = 32768, 16 << 20
#: Bytes of a whole bitmap; a list of at most this many bytes is kept as a list.
BITMAP_BYTES = BITMAP_DOCS // 8
#: Largest tokenizer file that is broadcast.
MOST_BYTES = 32 << 20
#: Characters whose classes no version of Unicode has changed since long ago.
SETTLED = re.compile("[\t\n\r\\x20-\\x7e¡-¬®-ȗΑ-ΡΣ-ώА-я‐-‧ぁ-ゔァ-ヺ一-龥가-힣]*")


@dataclass(frozen=True)
class TokenizerPair:
    """Broadcast files of the byte-level tokenizer A and the piece tokenizer B; ``built()`` is for use inside tasks."""

    a: Broadcast
    b: Broadcast
    pattern: str

    def built(self) -> _Pair:
        return _built(self.a.value, self.b.value, self.pattern)


def _byte_letters() -> dict[str, int]:
    """The letters in which byte-level vocabularies write bytes: printable ones as they are, the others from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    shifted = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(shifted)}


class _Pair:
    """Both tokenizers and the bytes of their tokens."""

    def __init__(self, a: bytes, b: bytes, pattern: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.exact = Tokenizer.from_str(a.decode())
        self.exact.encode_special_tokens = True
        letters, special = _byte_letters(), {t["content"] for t in json.loads(a).get("added_tokens", [])}
        spelled = {token: bytes(letters[c] for c in token) for token in self.exact.get_vocab() if token not in special}
        ids = self.exact.get_vocab()
        self.a_bytes = [b""] * (max(ids.values()) + 1)
        for token, raw in spelled.items():
            self.a_bytes[ids[token]] = raw
        # The order of merges is the order of ids, so ids are ranks.
        self.fast = tiktoken.Encoding("pair", pat_str=pattern, mergeable_ranks={raw: ids[t] for t, raw in spelled.items()}, special_tokens={})
        self.pieces = sentencepiece.SentencePieceProcessor(model_proto=b)
        self.b_bytes = [self._piece(k) for k in range(self.pieces.get_piece_size())]
        self.a_sizes = np.array([len(t) for t in self.a_bytes], dtype=np.int64)
        self.b_sizes = np.array([len(t) for t in self.b_bytes], dtype=np.int64)

    def _piece(self, k: int) -> bytes:
        piece = self.pieces.id_to_piece(k)
        byte = BYTE_PIECE.fullmatch(piece)
        return bytes([int(byte[1], 16)]) if byte else piece.replace(SPACE_MARK, " ").encode()

    def encode(self, text: str | None) -> tuple[np.ndarray, np.ndarray] | None:
        """Ids of A for a space and the text, and of B for the text; None where their bytes are not those of both."""
        if not text:
            return None
        spaced = " " + text
        raw = spaced.encode()
        a = self.fast.encode_ordinary(spaced) if SETTLED.fullmatch(text) else self.exact.encode(spaced, add_special_tokens=False).ids
        b = self.pieces.encode(text, num_threads=1)
        if b"".join(map(self.a_bytes.__getitem__, a)) != raw or b"".join(map(self.b_bytes.__getitem__, b)) != raw:
            return None
        return np.array(a, dtype=np.int64), np.array(b, dtype=np.int64)


@lru_cache(maxsize=2)
def _built(a: bytes, b: bytes, pattern: str) -> _Pair:
    return _Pair(a, b, pattern)


def read_tokenizers(spark: SparkSession, a_path: str, b_path: str, pattern: str) -> TokenizerPair:
    """A from a byte-level BPE file (json) with its pre-token pattern, B from a piece model, both read by the driver."""
    files = [Path(path).read_bytes() for path in (a_path, b_path)]
    if max(map(len, files)) > MOST_BYTES:
        raise ValueError(f"a tokenizer file has more than {MOST_BYTES} bytes")
    return TokenizerPair(spark.sparkContext.broadcast(files[0]), spark.sparkContext.broadcast(files[1]), pattern)


def common_ends(pair: _Pair, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Positions in ``a`` and ``b`` of the tokens that end at the same byte, link by link, and those bytes.

    A token without bytes ends where the one before it does, so several tokens may end together; each pair is a link.
    """
    a_ends, b_ends = np.cumsum(pair.a_sizes[a]), np.cumsum(pair.b_sizes[b])
    left, right = np.searchsorted(b_ends, a_ends, "left"), np.searchsorted(b_ends, a_ends, "right")
    met = right - left
    inside = np.arange(met.sum()) - np.repeat(np.cumsum(met) - met, met)
    return np.repeat(np.arange(len(a)), met), np.repeat(left, met) + inside, np.repeat(a_ends, met)


def _cut(ids: np.ndarray, last: np.ndarray) -> list[str]:
    """Ids of each group, comma-joined; ``last`` are the positions of the groups' last ids."""
    words, at, out = list(map(str, ids.tolist())), 0, []
    for end in last.tolist():
        out.append(words[at] if end == at else ",".join(words[at : end + 1]))
        at = end + 1
    return out


def groups_text(a: np.ndarray, b: np.ndarray, a_at: np.ndarray, b_at: np.ndarray, offsets: np.ndarray) -> tuple[int, str]:
    """Number of groups and the groups as ``a1,a2|b1;a3|b2,b3``; a group ends at the last tokens of a common offset."""
    last = np.flatnonzero(np.diff(offsets, append=-1))
    return len(last), ";".join(f"{x}|{y}" for x, y in zip(_cut(a, a_at[last]), _cut(b, b_at[last]), strict=True))


def _containers(slots: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    """Compressed bitmaps: the sorted 16-bit slots of each run, or its whole bitmap where that is shorter."""
    flat = np.ascontiguousarray(slots.astype("<u2"))
    sizes = 2 * (ends - starts)
    dense = np.flatnonzero(sizes >= BITMAP_BYTES)
    if not len(dense):
        offsets = np.append(2 * starts, 2 * ends[-1:]).astype(np.int32)
        return pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(flat.tobytes())])
    whole = {}
    for k in dense.tolist():
        bits = np.zeros(BITMAP_DOCS, dtype=np.uint8)
        bits[flat[starts[k] : ends[k]]] = 1
        whole[k] = np.packbits(bits, bitorder="little").tobytes()
    raw = flat.tobytes()
    return pa.array([whole.get(k) or raw[2 * starts[k] : 2 * ends[k]] for k in range(len(starts))], pa.binary())


def _postings(pairs: np.ndarray, slots: np.ndarray, block: int) -> Iterator[pa.RecordBatch]:
    """Postings of a block: for each pair the bitmap of its documents (plane -1), and for every bit of the links of a
    document beyond its first one a plane with the documents in which the bit is set."""
    keys = (pairs << 15) | slots
    keys.sort()
    starts = np.flatnonzero(np.diff(keys, prepend=-1))
    times = np.diff(np.append(starts, len(keys))) - 1
    keys = keys[starts]
    for plane in range(-1, int(times.max()).bit_length() if len(times) else -1):
        held = keys if plane < 0 else keys[(times >> plane) & 1 == 1]
        if not len(held):
            continue
        of = held >> 15
        first = np.flatnonzero(np.diff(of, prepend=-1))
        last = np.append(first[1:], len(of))
        docs = (held & 32767).astype(np.uint16)
        for at in range(0, len(first), 1 << 16):
            some, their = first[at : at + (1 << 16)], last[at : at + (1 << 16)]
            base = some[0]
            yield pa.RecordBatch.from_arrays(
                [pa.array(of[some], pa.int64()), pa.array(np.full(len(some), block), pa.int64()), pa.array(np.full(len(some), plane), pa.int32()),
                 _containers(docs[base : their[-1]], some - base, their - base)],
                ["pair", "block", "plane", "bitmap"])


def _slots(bitmap: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All documents of some compressed bitmaps, one after the other, and the number of each."""
    ends = np.frombuffer(bitmap.buffers()[1], dtype=np.int32)[bitmap.offset : bitmap.offset + len(bitmap) + 1]
    sizes = np.diff(ends)
    dense = np.flatnonzero(sizes == BITMAP_BYTES)
    if not len(dense):
        return np.frombuffer(bitmap.buffers()[2], dtype="<u2", count=ends[-1] // 2)[ends[0] // 2 :].astype(np.int64), sizes // 2
    parts = [np.flatnonzero(np.unpackbits(np.frombuffer(x, np.uint8), bitorder="little")) if len(x) == BITMAP_BYTES else np.frombuffer(x, "<u2") for x in bitmap.to_pylist()]
    return np.concatenate(parts).astype(np.int64), np.array([len(p) for p in parts])


def popcount(bitmap: str) -> Column:
    """Documents of a compressed bitmap."""
    size = F.octet_length(bitmap)
    return F.when(size == BITMAP_BYTES, F.bitmap_count(bitmap)).otherwise((size / 2).cast("long"))


def pair_statistics(postings: DataFrame, b_size: int) -> DataFrame:
    """``pair``, ``part``, ``doc_count``, ``link_count`` and ``best`` (no pair of its B id has more links), for each
    part of the index in which a pair occurs.

    Blocks hold different documents, so the union of a pair's bitmaps has the sum of their bits: each is counted where
    it lies and only numbers are shuffled, with sums before the shuffle. The parts, of 256 written partitions each,
    are there so that the postings of a pair that occurs everywhere are no single key later.
    """
    bits = popcount("bitmap")
    weight = F.when(F.col("plane") < 0, 1).otherwise(F.call_function("shiftleft", F.lit(1).cast("long"), F.greatest("plane", F.lit(0))))
    parts = cut_lineage(postings.groupBy("pair", _part().alias("part")).agg(
        F.sum(F.when(F.col("plane") < 0, bits).otherwise(0)).alias("docs"), F.sum(bits * weight).alias("links")))
    counted = parts.groupBy("pair").agg(F.sum("docs").alias("doc_count"), F.sum("links").alias("link_count")).withColumn("_b", F.col("pair") % b_size)
    highest = counted.groupBy("_b").agg(F.max("link_count").alias("_highest"))
    whole = counted.join(highest, "_b").select("pair", "doc_count", "link_count", (F.col("link_count") == F.col("_highest")).alias("best"))
    return parts.select("pair", "part").join(whole, "pair")


def _part() -> Column:
    """A block's number begins with that of the partition that wrote it."""
    return F.shiftright("block", 40)


def _scores(postings: DataFrame, statistics: DataFrame) -> DataFrame:
    """What the postings return to documents: ``block``, ``slot``, ``count_sum`` and ``n_best``.

    Postings meet the statistics by pair and part and go back to their block, where a task adds them up in two arrays
    of one block.
    """
    narrow = statistics.select("pair", "part", "link_count", "best")
    met = postings.withColumn("part", _part()).join(narrow, ["pair", "part"]).select("block", "plane", "bitmap", "link_count", "best")

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, sums, best = None, np.zeros(BITMAP_DOCS, np.int64), np.zeros(BITMAP_DOCS, np.int64)

        def out() -> pa.RecordBatch:
            slots = np.flatnonzero(sums)
            return pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(slots), block), pa.int64()), pa.array(slots, pa.int32()), pa.array(sums[slots], pa.int64()), pa.array(best[slots], pa.int64())],
                ["block", "slot", "count_sum", "n_best"])

        for batch in batches:
            if not batch.num_rows:
                continue
            own = batch.column("block").to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(own)) + 1).tolist(), len(own)]
            slots, sizes = _slots(batch.column("bitmap"))
            times = np.left_shift(1, np.maximum(batch.column("plane").to_numpy(), 0)).astype(np.int64)
            counts = batch.column("link_count").to_numpy() * times
            bests = batch.column("best").to_numpy(zero_copy_only=False).astype(np.int64) * times
            ends = np.append(0, np.cumsum(sizes))
            for low, high in zip(cuts[:-1], cuts[1:], strict=True):
                if own[low] != block:
                    if block is not None:
                        yield out()
                    block = own[low]
                    sums[:], best[:] = 0, 0
                some = slots[ends[low] : ends[high]]
                np.add.at(sums, some, np.repeat(counts[low:high], sizes[low:high]))
                np.add.at(best, some, np.repeat(bests[low:high], sizes[low:high]))
        if block is not None:
            yield out()

    return met.repartition("block").sortWithinPartitions("block").mapInArrow(add, "block long, slot int, count_sum long, n_best long")


#: What one row of the stored index holds: a document, or a posting.
_INDEX = "asset_id {id}, n_a long, n_b long, n_groups long, n_links long, groups string, slot int, pair long, block long, plane int, bitmap binary"


def align_tokenizers(records: DataFrame, tokenizers: TokenizerPair, keep: Mapping[str, Column] | None = None, block_bytes: int = BLOCK_BYTES) -> tuple[DataFrame, DataFrame]:
    """Align the tokens of two tokenizers in every transcript and score each document by corpus-wide pair counts.

    ``records`` has ``asset_id`` and ``transcript``; other columns are ignored. Special tokens are ordinary text.
    A encodes a space and the transcript, B the transcript, to which it adds the space itself. Offsets where tokens of
    both end cut the bytes into groups; each pair of tokens that end together is a link. A transcript that is null or
    empty, or in which the joined bytes of A or B differ from space and transcript, has no tokens.

    Returns two tables. Documents: ``asset_id``, ``n_a``, ``n_b``, ``n_groups``, ``n_links``, ``n_best`` (links whose
    pair is the most frequent of its B id, ties included), ``count_sum`` (links of all pairs it holds, link by link) and
    ``groups`` (ids as ``a1,a2|b1;a3|b2``), or the columns ``keep`` derives from these in its place. Pairs: ``a_id``,
    ``b_id``, ``doc_count``, ``link_count``. Rows are not merged by ``asset_id``; null ids stay null; empty tables give
    two empty ones.

    Transcripts are encoded once. A task numbers its documents in blocks and writes, beside the document rows, an
    inverted index: for each pair and block a compressed bitmap of documents and planes for repeated links. Pair
    counts are popcounts, documents get their scores back through the postings. Transcripts are never shuffled, and
    a task holds the links of one block of ``block_bytes`` of text (or of one transcript, if that is longer). Memory
    does not grow with the corpus.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    arrow_batches(records.sparkSession)
    rows = only(records, "asset_id", "transcript")
    ddl = _INDEX.format(id=rows.schema["asset_id"].dataType.simpleString())
    schema = to_arrow_schema(StructType.fromDDL(ddl))
    b_size = sentencepiece.SentencePieceProcessor(model_proto=tokenizers.b.value).get_piece_size()

    def filled(batch: pa.RecordBatch) -> pa.RecordBatch:
        own = set(batch.schema.names)
        return pa.RecordBatch.from_arrays([batch.column(f.name) if f.name in own else pa.nulls(batch.num_rows, f.type) for f in schema], schema=schema)

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        pair = tokenizers.built()
        block, slot, size = TaskContext.get().partitionId() << 32, 0, 0
        pairs: list[np.ndarray] = []
        at: list[np.ndarray] = []

        def flushed() -> Iterator[pa.RecordBatch]:
            if pairs:
                yield from map(filled, _postings(np.concatenate(pairs), np.concatenate(at), block))

        for batch in batches:
            docs: list[dict[str, Any]] = []
            held = 0
            for asset, text in zip(batch.column("asset_id").to_pylist(), batch.column("transcript"), strict=True):
                encoded = pair.encode(text.as_py())
                row = {"asset_id": asset, "n_a": 0, "n_b": 0, "n_groups": 0, "n_links": 0, "groups": "", "slot": slot, "block": block}
                if encoded is not None:
                    a, b = encoded
                    a_at, b_at, offsets = common_ends(pair, a, b)
                    n_groups, groups = groups_text(a, b, a_at, b_at, offsets)
                    row |= {"n_a": len(a), "n_b": len(b), "n_groups": n_groups, "n_links": len(a_at), "groups": groups}
                    pairs.append(a[a_at] * b_size + b[b_at])
                    at.append(np.full(len(a_at), slot, dtype=np.int64))
                    size += len(text.as_buffer())
                    held += len(groups)
                docs.append(row)
                slot += 1
                if slot == BITMAP_DOCS or size >= block_bytes:
                    yield from flushed()
                    block, slot, size = block + 1, 0, 0
                    pairs.clear()
                    at.clear()
                if held >= 4 << 20:
                    yield pa.RecordBatch.from_pylist(docs, schema=schema)
                    docs, held = [], 0
            if docs:
                yield pa.RecordBatch.from_pylist(docs, schema=schema)
        yield from flushed()

    derived = keep if keep is not None else {"groups": F.col("groups")}
    stored = [F.col(c) for c in ("asset_id", "n_a", "n_b", "n_groups", "n_links", "slot", "pair", "block", "plane", "bitmap")]
    table = cut_lineage(rows.mapInArrow(index, ddl).select(*stored, *[F.when(F.col("pair").isNull(), column).alias(name) for name, column in derived.items()]))
    postings = table.where("pair IS NOT NULL").select("pair", "block", "plane", "bitmap")
    statistics = cut_lineage(pair_statistics(postings, b_size))
    scores = _scores(postings, statistics)
    docs = table.where("pair IS NULL").select("asset_id", "n_a", "n_b", "n_groups", "n_links", "block", "slot", *derived)
    zero = F.lit(0).cast("long")
    scored = docs.join(scores, ["block", "slot"], "left").select(
        "asset_id", "n_a", "n_b", "n_groups", "n_links", F.coalesce("n_best", zero).alias("n_best"), F.coalesce("count_sum", zero).alias("count_sum"), *derived)
    pairs_out = statistics.dropDuplicates(["pair"]).select(F.floor(F.col("pair") / b_size).cast("int").alias("a_id"), (F.col("pair") % b_size).cast("int").alias("b_id"), "doc_count", "link_count")
    return scored, pairs_out
