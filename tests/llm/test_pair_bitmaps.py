"""Tokenizer alignment against a plain version, and on awkward tables."""

import collections
import random
import re

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from cuelattice.llm import pair_bitmaps
from cuelattice.llm.pair_bitmaps import align_tokenizers, read_tokenizers

SCHEMA = "asset_id long, transcript string, pair string, groups string"
A_FILE, B_FILE = (public_tokenizers.path(name) for name in ("byte_bpe_50k.json", "piece_bpe_32k.model"))


@pytest.fixture(scope="module")
def tokenizers(spark):
    return read_tokenizers(spark, A_FILE, B_FILE, public_tokenizers.PATTERN)


@pytest.fixture(scope="module")
def plain():
    a = Tokenizer.from_file(A_FILE)
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=B_FILE)
    letters = {chr(c): c for c in [*range(33, 127), *range(161, 173), *range(174, 256)]}
    for code in range(256):
        if code not in letters.values():
            letters[chr(256 + len(letters) - 188)] = code
    spelled = {k: v for v, k in a.get_vocab().items()}

    def b_bytes(k):
        piece = b.id_to_piece(k)
        byte = re.fullmatch("<0x(..)>", piece)
        return bytes([int(byte[1], 16)]) if byte else piece.replace("▁", " ").encode()

    def align(text):
        if not text:
            return None
        own_a, own_b = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
        bytes_a, bytes_b = [bytes(letters[c] for c in spelled[k]) for k in own_a], [b_bytes(k) for k in own_b]
        if not b"".join(bytes_a) == b"".join(bytes_b) == (" " + text).encode():
            return None
        ends_a, ends_b = np.cumsum([len(x) for x in bytes_a]).tolist(), np.cumsum([len(x) for x in bytes_b]).tolist()
        groups, i, j = [], 0, 0
        for end in sorted({*ends_a} & {*ends_b}):
            x, y = ends_a.index(end, i) + 1, ends_b.index(end, j) + 1
            groups.append((own_a[i:x], own_b[j:y]))
            i, j = x, y
        return len(own_a), len(own_b), groups

    return align


def awkward_texts(n=60, seed=3):
    rng = random.Random(seed)
    fixed = [None, "", " ", "one", "one", "  spaces   and\ttabs\n\n ", "<|endoftext|> and <s> <0x41>", "▁mark", "日本語のテキスト", "😀 ünïcödé ñ", "ﬁ ½ ﷺ", "İstanbul ığ", "a\x00b", "\u200bzero", "long " * 9000]
    return fixed + [" ".join(rng.choice(["the", "cat", "Übung", "naïve", "data", "😀", "x1y2", "...", "Straße", "ction"]) for _ in range(rng.randrange(1, 60))) for _ in range(n)]


@pytest.mark.parametrize("block_bytes", [1 << 24, 200])
def test_alignment_counts_and_scores_match_the_plain_version(spark, tokenizers, plain, block_bytes):
    texts = dict(enumerate(awkward_texts()))
    table = spark.createDataFrame([(k, t, "x", "y") for k, t in texts.items()], SCHEMA).repartition(3)
    scored, pairs = align_tokenizers(table, tokenizers, block_bytes=block_bytes)
    aligned = {k: plain(t) for k, t in texts.items()}
    links = {k: [(a[-1], b[-1]) for a, b in own[2]] if own else [] for k, own in aligned.items()}
    count = collections.Counter(x for own in links.values() for x in own)
    docs = collections.Counter(x for own in links.values() for x in set(own))
    best = {b: max(n for (_, other), n in count.items() if other == b) for _, b in count}
    assert {(r.a_id, r.b_id): (r.doc_count, r.link_count) for r in pairs.collect()} == {x: (docs[x], n) for x, n in count.items()}
    got = {r.asset_id: r for r in scored.collect()}
    assert set(got) == set(texts)
    for k, own in aligned.items():
        text = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in own[2]) if own else ""
        expected = (own[0], own[1], len(own[2]), len(links[k])) if own else (0, 0, 0, 0)
        assert (got[k].n_a, got[k].n_b, got[k].n_groups, got[k].n_links) == expected, texts[k]
        assert got[k].groups == text
        assert (got[k].n_best, got[k].count_sum) == (sum(count[x] == best[x[1]] for x in links[k]), sum(count[x] for x in links[k]))


def test_the_quick_encoder_gives_the_ids_of_the_file(tokenizers):
    pair = tokenizers.built()
    rng = random.Random(9)
    letters = [chr(c) for c in range(0x20, 0x9FFF) if pair_bitmaps.SETTLED.fullmatch(chr(c))] + list("\n\t \r'")
    for _ in range(400):
        text = "".join(rng.choice(letters if rng.random() < 0.5 else "the cat's 12 dogs,\n  ") for _ in range(rng.randrange(1, 80)))
        assert pair_bitmaps.SETTLED.fullmatch(text)
        assert pair.fast.encode_ordinary(" " + text) == pair.exact.encode(" " + text, add_special_tokens=False).ids, text


def test_dense_bitmaps_and_planes_count_like_lists():
    rng = np.random.default_rng(4)
    pairs = np.concatenate([np.full(9000, 5), np.full(30, 7), np.full(40_000, 9)])
    slots = np.concatenate([rng.integers(0, 3000, 9000), rng.integers(0, 32768, 30), rng.integers(0, 32768, 40_000)])
    times = collections.Counter(zip(pairs.tolist(), slots.tolist(), strict=True))
    got = collections.Counter()
    for batch in pair_bitmaps._postings(pairs, slots, 1):
        held, sizes = pair_bitmaps._slots(batch.column("bitmap"))
        assert any(len(x) == pair_bitmaps.BITMAP_BYTES for x in batch.column("bitmap").to_pylist()) or batch.column("plane")[0].as_py() > 0
        weight = np.repeat(np.left_shift(1, np.maximum(batch.column("plane").to_numpy(), 0)), sizes)
        for pair, slot, n in zip(np.repeat(batch.column("pair").to_numpy(), sizes).tolist(), held.tolist(), weight.tolist(), strict=True):
            got[pair, slot] += n
    assert got == times


def test_empty_and_null_rows(spark, tokenizers):
    scored, pairs = align_tokenizers(spark.createDataFrame([], SCHEMA), tokenizers)
    assert scored.count() == pairs.count() == 0
    scored, pairs = align_tokenizers(spark.createDataFrame([(None, None, "x", "y"), (None, "", "x", "y"), (3, "word", None, None), (3, "word", None, None)], SCHEMA), tokenizers)
    assert sorted((r.asset_id or 0, r.n_a, r.n_best, r.count_sum) for r in scored.collect()) == [(0, 0, 0, 0), (0, 0, 0, 0), (3, 1, 1, 2), (3, 1, 1, 2)]
    assert [tuple(r)[2:] for r in pairs.collect()] == [(2, 2)]
