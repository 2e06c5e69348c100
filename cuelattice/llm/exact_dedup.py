"""Exact duplicates of transcripts by two-pass Bloom filtering."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cuelattice.llm.records import WHITE_SPACE, salted_join, without
from cuelattice.session import cut_lineage

#: Bits of one filter block: what one bitmap of ``bitmap_construct_agg`` holds.
BLOCK_BITS = 32_768
PROBES = 4
OWN = ("keep_id", "group_size", "kept", "text_sha256")


def _bare(text: Column) -> Column:
    out = F.coalesce(text, F.lit(""))
    for sign in WHITE_SPACE:
        out = F.replace(out, F.lit(sign), F.lit(""))
    return out


def _probes(rows: DataFrame, blocks: int) -> DataFrame:
    """``rows`` with the filter block and the bits of their ``_digest``."""
    mixed = F.xxhash64("_digest", F.lit("probe"))
    bits = [F.shiftrightunsigned(mixed, 15 * k).bitwiseAND(F.lit(BLOCK_BITS - 1)).cast("int") for k in range(PROBES)]
    return rows.withColumns({"_block": F.pmod("_digest", F.lit(blocks)), "_bits": F.array(*bits)})


def _blocks(rows: int, bits_per_row: int) -> int:
    return max(1, -(-rows * bits_per_row // BLOCK_BITS))


def _bitmaps(bits: DataFrame) -> DataFrame:
    """One bitmap per block of its ``_bit`` values. Bits move to their block, so no task holds bitmaps of all blocks."""
    return bits.repartition("_block").groupBy("_block").agg(F.bitmap_construct_agg(F.col("_bit").cast("long")).alias("_map"))


def repeated_bits(probes: DataFrame) -> DataFrame:
    """First pass: the filter, one bitmap per block, of the bits that at least two rows set.

    Rows are counted per bit before a shuffle, so a text with any number of copies sends one row per task.
    """
    set_bits = probes.select("_block", F.explode(F.array_distinct("_bits")).alias("_bit"))
    return _bitmaps(set_bits.groupBy("_block", "_bit").count().where("count > 1"))


def possible_repeats(digests: DataFrame, bits_per_row: int) -> DataFrame:
    """Second pass: each ``_digest`` all of whose bits two or more rows set, once.

    Digests meet their block of the filter, whatever its size; copies of one text are spread over salts.
    """
    probes = _probes(digests, _blocks(digests.count(), bits_per_row))
    met = salted_join(probes, repeated_bits(probes), "_block", F.monotonically_increasing_id())
    return met.where(_held()).select("_digest").distinct()


def _is_set(bitmap: Column, bit: Column) -> Column:
    byte = F.conv(F.hex(F.substr(bitmap, (F.shiftright(bit, 3) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    masks = F.array(*[F.lit(1 << k) for k in range(8)])
    return byte.bitwiseAND(F.element_at(masks, F.pmod(bit, F.lit(8)).cast("int") + 1)) != 0


def _held() -> Column:
    """Whether all bits of a row are in its block's bitmap."""
    tests = [_is_set(F.col("_map"), F.col("_bits")[k]) for k in range(PROBES)]
    return reduce(lambda a, b: a & b, tests)


def exact_duplicates(transcripts: DataFrame, bits_per_row: int = 16, filter_bytes: int = 64 << 20) -> DataFrame:
    """Mark exact copies of transcripts; texts are equal when they are identical without white space.

    Needs ``asset_id`` and ``transcript`` and returns every row with all its columns plus

    ``keep_id``      asset_id of the row of its group that stays: most code points, then smallest id (null last)
    ``group_size``   rows with that text
    ``kept``         true for exactly one row of each group
    ``text_sha256``  digest of the text without white space

    Both passes read 64-bit digests, written once, never texts. The first builds a blocked Bloom filter of the bits
    that two or more rows set, ``bits_per_row`` bits a row; in the second the digests meet it block by block, and
    those whose bits are all in it may be repeated. They go to the rows as one more filter, with as many bits for
    each of them but never more than ``filter_bytes``, so it is always broadcast. A row outside it has no copy
    and passes straight through, with its payload and without a shuffle. Only the others are grouped, by their whole
    digest, so a false positive costs a shuffle and never a wrong answer. ``filter_bytes`` holds 33 million repeated texts
    at 16 bits (rows let in wrongly: 0.2 %); with four times as many it has 4 bits for each (16 %), with ever more
    repeated texts ever more single rows take the way of the repeated ones.

    Defined cases: a null transcript counts as empty; empty texts are one group; rows that repeat an id and a text
    are members of the group and one of them is kept; an empty table gives an empty result; an input column
    with the name of a result column is replaced.
    """
    rows = without(transcripts, *OWN)
    digests = cut_lineage(rows.select(F.xxhash64(_bare(F.col("transcript"))).alias("_digest")))
    repeats = cut_lineage(possible_repeats(digests, bits_per_row))
    blocks = min(_blocks(repeats.count(), bits_per_row), max(1, filter_bytes * 8 // BLOCK_BITS))
    known = _bitmaps(_probes(repeats, blocks).select("_block", F.explode(F.array_distinct("_bits")).alias("_bit")))
    bare = _bare(F.col("transcript"))
    marks = rows.withColumns({"text_sha256": F.sha2(bare.cast("binary"), 256), "_n_chars": F.length(F.coalesce("transcript", F.lit(""))), "_digest": F.xxhash64(bare)})
    probed = _probes(marks, blocks).join(F.broadcast(known), "_block", "left").withColumn(
        "_again", F.coalesce(_held(), F.lit(False))).drop("_map", "_block", "_bits", "_digest")
    names = [*rows.columns, *OWN]
    single = probed.where("not _again").withColumns({
        "keep_id": F.col("asset_id"), "group_size": F.lit(1).cast("long"), "kept": F.lit(True)})
    several = probed.where("_again")
    order = F.struct((-F.col("_n_chars")).alias("fewer"), F.col("asset_id").isNull().alias("none"), F.col("asset_id").alias("id"))
    best = several.groupBy("text_sha256").agg(F.count("*").alias("group_size"), F.min(order).alias("_best"))
    # Rows of one id and text are told apart in a partitioning of their own: copies of a text spread by id.
    spread = F.md5(F.concat_ws("|", "text_sha256", F.coalesce(F.col("asset_id").cast("string"), F.lit("null"))))
    grouped = salted_join(several, best, "text_sha256", F.col("asset_id")).withColumn("_spread", spread)
    first = F.row_number().over(Window.partitionBy("_spread").orderBy(F.desc("_n_chars"))) == 1
    marked = grouped.withColumns({
        "keep_id": F.col("_best.id"),
        "kept": first & F.col("asset_id").eqNullSafe(F.col("_best.id")) & (F.col("_best.fewer") == -F.col("_n_chars")),
    })
    return single.select(*[F.col(f"`{n}`") for n in names]).unionByName(marked.select(*[F.col(f"`{n}`") for n in names]))
