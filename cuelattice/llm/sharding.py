"""Sharding transcripts by proportional stratified interleaving."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cuelattice.llm.records import only
from cuelattice.session import cut_lineage


def interleave_shards(transcripts: DataFrame, shards: int = 16, seed: int = 11, parts: int = 1024) -> DataFrame:
    """Put transcripts into shards of equal row counts that all match the mixture of sources.

    Needs ``asset_id``, ``source_name`` and ``transcript``; returns one row per transcript: ``asset_id``,
    ``size`` (UTF-8 bytes plus 1), ``text_crc32``, ``shard`` (0 to shards - 1) and ``slot`` (0, 1, ... within the
    shard). Row counts of shards differ by one at most, and a source's rows in two shards by two at most.

    Rows of a source are shuffled by a seeded hash and ranked; the fractional rank (rank + 0.5) / rows of the
    source orders all rows, and that order is cut into equal runs. Both rankings are sums of counts over ``parts``
    equal slices (of the hash, of the fractional rank) plus a rank inside the slice: the shuffle makes slices even
    whatever a source's share, so neither a source nor the table is in one task. Equal texts are not kept together.

    Defined cases: null transcript: size 1, crc32 of nothing (0); null source_name is a source; equal rows are
    interchangeable and each gets its own slot; an empty table gives an empty result; other columns are ignored.
    """
    text = F.coalesce("transcript", F.lit("")).cast("binary")
    # The id carries the shuffle, the text's hash tells rows of one id apart.
    mixed = F.xxhash64(F.lit(seed), F.col("asset_id").cast("string"), F.xxhash64(text))
    rows = only(transcripts, "asset_id", "source_name", "transcript").select(
        "asset_id", F.col("source_name").isNotNull().alias("_known"), F.coalesce("source_name", F.lit("")).alias("_name"),
        (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), mixed.alias("_mixed"),
    ).withColumn("_slice", F.shiftrightunsigned("_mixed", 40) % parts)
    rows = cut_lineage(rows)
    source = ["_known", "_name"]
    per_slice = rows.groupBy(*source, "_slice").agg(F.count("*").alias("_rows"))
    along = Window.partitionBy(*source)
    starts = per_slice.withColumns({
        "_start": F.sum("_rows").over(along.orderBy("_slice")) - F.col("_rows"), "_all": F.sum("_rows").over(along)}).drop("_rows")
    tie = ["_mixed", "asset_id", "size", "text_crc32"]
    within = F.row_number().over(Window.partitionBy(*source, "_slice").orderBy(*tie)) - 1
    placed = rows.withColumn("_in", within).join(starts, [*source, "_slice"]).withColumn(
        "_share", (F.col("_start") + F.col("_in") + 0.5) / F.col("_all"))
    placed = cut_lineage(placed.select(
        "asset_id", "size", "text_crc32", "_known", "_name", "_mixed", "_share", F.floor(F.col("_share") * parts).alias("_run")))
    runs = placed.groupBy("_run").agg(F.count("*").alias("_rows"))
    # One row per run, at most `parts` rows, in these windows.
    heads = runs.withColumns({
        "_head": F.sum("_rows").over(Window.orderBy("_run")) - F.col("_rows"), "_total": F.sum("_rows").over(Window.partitionBy())}).drop("_rows")
    order = ["_share", F.desc("_known"), "_name", *tie]
    placed = placed.withColumn("_in", F.row_number().over(Window.partitionBy("_run").orderBy(*order)) - 1).join(heads, "_run")
    place = (F.col("_head") + F.col("_in")).cast("long")
    cut = F.expr(f"(_place * {shards}) div _total")
    first = F.expr(f"(shard * _total + {shards - 1}) div {shards}")
    return placed.withColumn("_place", place).withColumn("shard", cut).withColumn("slot", F.col("_place") - first).select(
        "asset_id", "size", "text_crc32", F.col("shard").cast("int").alias("shard"), "slot")
