"""Byte-level BPE encoding of transcripts by overlapping chunks, and decoding."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cuelattice.llm.records import arrow_batches, only
from cuelattice.llm.vocabulary import Vocabulary

#: Rows of one output batch.
ROWS_OUT = 256


def _slices(batches: Iterator[pa.RecordBatch], rows: int = ROWS_OUT) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)


def _encoded(df: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """Replace ``_text`` by ``token_ids``."""
    arrow_batches(df.sparkSession)
    keep = [f for f in df.schema.fields if f.name != "_text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding = vocabulary.encoding()
        for part in _slices(batches):
            ids = [encoding.encode_ordinary(text.as_py()) for text in part.column("_text")]
            columns = [part.column(f.name) for f in keep]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(ids, pa.list_(pa.int32()))], [*[f.name for f in keep], "token_ids"])

    return df.mapInArrow(run, T.StructType([*keep, T.StructField("token_ids", T.ArrayType(T.IntegerType()))]))


def scan_boundaries(text: str, pattern: str) -> list[int]:
    """Ends of the pre-tokens of ``text`` that the cut at its end can't have changed, after a non-space character."""
    spaces = regex.compile(pattern.replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}"))
    ends = [m.end() for m in spaces.finditer(text)]
    return [p for p in ends if p < len(text) and not text[p - 1].isspace()]


def _scanned(chunks: DataFrame, pattern: str, chunk_chars: int, overlap_chars: int) -> DataFrame:
    """Add ``_head`` and ``_tail``: boundaries within the overlap at a chunk's start and at its end, from their zone's start."""
    keep = chunks.schema.fields

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _slices(batches):
            heads, tails = [], []
            for text in part.column("_text"):
                ends = scan_boundaries(text.as_py(), pattern)
                heads.append([p for p in ends if p < overlap_chars])
                tails.append([p - chunk_chars for p in ends if p >= chunk_chars])
            yield pa.RecordBatch.from_arrays(
                [*[part.column(f.name) for f in keep], pa.array(heads, pa.list_(pa.int32())), pa.array(tails, pa.list_(pa.int32()))],
                [*[f.name for f in keep], "_head", "_tail"])

    ints = T.ArrayType(T.IntegerType())
    return chunks.mapInArrow(run, T.StructType([*keep, T.StructField("_head", ints), T.StructField("_tail", ints)]))


def stitched_pieces(rows: DataFrame, pattern: str, chunk_chars: int, overlap_chars: int) -> DataFrame:
    """Cut long texts (``_row``, ``_text``, ...) into pieces that begin and end at pre-token boundaries.

    Every chunk is pre-tokenised from its own start. A chunk that starts inside a pre-token goes astray at first;
    where it and its predecessor both have a boundary in their overlap they agree from there on, for the pattern
    looks at nothing before a pre-token. The first such place is the cut. Chunks without one stay in one piece
    with their predecessor.
    """
    c, o = chunk_chars, overlap_chars
    chunk = F.transform(
        F.sequence(F.lit(0), (F.ceil(F.length("_text") / c) - 1).cast("int")),
        lambda k: F.struct(k.alias("k"), F.substr(F.col("_text"), (k * c + 1).cast("int"), F.lit(c + o)).alias("text")))
    others = [n for n in rows.columns if n != "_text"]
    chunks = rows.select(*others, F.explode(chunk).alias("_c")).select(*others, F.col("_c.k").alias("_k"), F.col("_c.text").alias("_text"))
    scanned = _scanned(chunks.repartition("_row", "_k"), pattern, c, o)
    along = Window.partitionBy("_row").orderBy("_k")
    to_next = F.array_min(F.array_intersect("_tail", F.lead("_head").over(along)))
    cut = scanned.withColumn("_to", to_next).withColumn("_from", F.lag("_to").over(along)).drop("_head", "_tail")
    start = F.coalesce("_from", F.lit(0))
    own = cut.withColumn("_piece", F.count("_from").over(along)).withColumn(
        "_text", F.substr(F.col("_text"), start + 1, F.lit(c) + F.coalesce("_to", F.lit(0)) - start))
    parts = F.array_sort(F.collect_list(F.struct("_k", "_text")))
    return own.groupBy(*others, "_piece").agg(F.array_join(F.transform(parts, lambda p: p["_text"]), "").alias("_text"))


def encode_transcripts(transcripts: DataFrame, vocabulary: Vocabulary, chunk_chars: int = 32_768, overlap_chars: int = 1_024) -> DataFrame:
    """Token ids of whole transcripts, each match of the pre-token pattern encoded by itself, no special tokens.

    Needs ``asset_id`` and ``transcript``; returns ``asset_id`` and ``token_ids`` (array<int>), one row per
    transcript. Texts up to ``chunk_chars`` characters are one chunk and are encoded where they are read. Longer
    ones are cut into overlapping chunks that many tasks pre-tokenise, stitched where the boundaries of two
    neighbours meet again, and encoded piece by piece; a text's ids come together in order at the end.

    Defined cases: null or empty transcript: no ids; a text without any boundary is one piece; rows that repeat an
    id stay separate rows; an empty table gives an empty result; other columns are ignored.
    """
    if not 0 < overlap_chars < chunk_chars:
        raise ValueError("overlap_chars must lie between 0 and chunk_chars")
    rows = only(transcripts, "asset_id", "transcript").select("asset_id", F.coalesce("transcript", F.lit("")).alias("_text"))
    short = _encoded(rows.where(F.length("_text") <= chunk_chars), vocabulary)
    long = rows.where(F.length("_text") > chunk_chars).withColumn("_row", F.monotonically_increasing_id())
    pieces = _encoded(stitched_pieces(long, vocabulary.pattern, chunk_chars, overlap_chars), vocabulary)
    joined = pieces.groupBy("_row").agg(
        F.first("asset_id").alias("asset_id"),
        F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("_piece", "token_ids"))), lambda p: p["token_ids"])).alias("token_ids"))
    return short.unionByName(joined.select("asset_id", "token_ids"))


def decode_tokens(tokens: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """Add ``content`` (binary): the bytes of ``token_ids`` one after the other; null ids are no bytes.

    All columns pass through; one named ``content`` is replaced.
    """
    df = tokens.drop("content")
    arrow_batches(df.sparkSession)
    keep = df.schema.fields

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding = vocabulary.encoding()
        for part in _slices(batches):
            content = [encoding.decode_bytes(ids.as_py() or []) for ids in part.column("token_ids")]
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(content, pa.binary())], [*[f.name for f in keep], "content"])

    return df.mapInArrow(run, T.StructType([*keep, T.StructField("content", T.BinaryType())]))
