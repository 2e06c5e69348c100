"""A byte-level BPE vocabulary, read once on the driver and built once in each Python worker."""

from __future__ import annotations

import base64
from dataclasses import dataclass
from functools import lru_cache
from pathlib import Path

import tiktoken
from pyspark import Broadcast
from pyspark.sql import SparkSession

#: A ranks file has one short line per token id: far below this, whatever the corpus.
MOST_BYTES = 32 << 20


@dataclass(frozen=True)
class Vocabulary:
    """Broadcast ranks file and pre-token pattern; ``encoding()`` is for use inside tasks."""

    ranks: Broadcast
    pattern: str

    def encoding(self) -> tiktoken.Encoding:
        return _built(self.ranks.value, self.pattern)


@lru_cache(maxsize=4)
def _built(ranks: bytes, pattern: str) -> tiktoken.Encoding:
    merged = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, ranks.splitlines())}
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=merged, special_tokens={})


def read_vocabulary(spark: SparkSession, path: str, pattern: str) -> Vocabulary:
    """Vocabulary from a ranks file (``base64 rank`` lines) that the driver can read."""
    ranks = Path(path).read_bytes()
    if len(ranks) > MOST_BYTES:
        raise ValueError(f"{path}: {len(ranks)} bytes are too many for a ranks file")
    return Vocabulary(spark.sparkContext.broadcast(ranks), pattern)
