"""What the operators of this folder share: the transcript record and a few column helpers.

A transcript row has ``asset_id``, ``transcript`` (whole text), ``language`` and ``source_name`` (the file or
engine it was imported from); operators name the columns they need and ignore or pass through the others.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space between words and the words themselves.
WHITE_SPACE = " \t\n\u000b\f\r"
WORD = r"[^\x20\x09-\x0D]+"


def without(df: DataFrame, *taken: str) -> DataFrame:
    """``df`` without columns whose names an operator's own result columns use (case does not count)."""
    lost = {name.lower() for name in taken}
    return df.select(*[F.col(f"`{name}`") for name in df.columns if name.lower() not in lost])


def word_count(text: Column) -> Column:
    """Number of words of a text, 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def only(df: DataFrame, *names: str) -> DataFrame:
    """The named columns alone, so that extra columns can clash with nothing."""
    return df.select(*[F.col(f"`{name}`") for name in names])


def salted_join(rows: DataFrame, groups: DataFrame, key: str, spread: Column, salts: int = 16) -> DataFrame:
    """Inner join of rows with one row per group, where a group may own a large share of the rows.

    Each group's row is repeated for every salt and the group's rows are spread over them, so one task reads a
    ``salts``-th of the largest group at most; what is still too large is left to the skew join of Spark.
    """
    salted = groups.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return rows.withColumn("_salt", F.pmod(F.xxhash64(spread), F.lit(salts)).cast("int")).join(salted, [key, "_salt"]).drop("_salt")


#: Bytes of one Arrow batch between Spark and a Python worker.
BATCH_BYTES = 8 << 20


def arrow_batches(spark: SparkSession, most: int = BATCH_BYTES) -> None:
    """Keep Arrow batches small in this session, so that rows with long texts need little memory beside the heap.

    A lower limit that the session already has stays.
    """
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if int(str(spark.conf.get(name)).rstrip("bB") or 0) > most:
        spark.conf.set(name, str(most))
