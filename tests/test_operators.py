"""Operators whose results the SQL oracle cannot express, against plain Python models and fixed cases."""

import functools
import itertools
import math
import random
import tracemalloc

import pyarrow as pa
import pytest
from conftest import rows
from pyspark.sql import functions as F

from cuelattice.kernel.scan import hot_keys
from cuelattice.operators import camera as A
from cuelattice.operators import captions as C
from cuelattice.operators import highlights as H
from cuelattice.operators import library as B
from cuelattice.operators import timeline as M
from cuelattice.plans import load_all
from cuelattice.plans.registry import QUERIES
from cuelattice.sources import caption_text as K

BOTH = pytest.mark.parametrize("hot", [False, True])


@BOTH
def test_simplify_keeps_error_below_tolerance(spark, hot):
    rnd = random.Random(4)
    level, points = 0.0, []
    for i in range(120):
        level += rnd.uniform(-1.5, 1.5)
        points.append((1, i * 32, level))
    df = spark.createDataFrame(points[:40] if hot else points, "asset_id long, at_ms long, gain_db double")
    with hot_keys(hot):
        kept = rows(A.simplify_gain(df, 1.0), "at_ms", "gain_db")
    source = points[:40] if hot else points

    def model(lo, hi):
        worst, where = 1.0, None
        for i in range(lo + 1, hi):
            u = (source[i][1] - source[lo][1]) / (source[hi][1] - source[lo][1])
            miss = abs(source[i][2] - (source[lo][2] + (source[hi][2] - source[lo][2]) * u))
            if miss > worst:
                worst, where = miss, i
        return set() if where is None else {where} | model(lo, where) | model(where, hi)

    last = len(source) - 1
    assert [t for t, _ in kept] == [source[i][1] for i in sorted({0, last} | model(0, last))]


def test_simplify_a_series_of_a_million_points(spark):
    """Saw teeth of 500 points: every tip is kept and nothing else."""
    table = spark.range(1_000_001).selectExpr("1L AS asset_id", "id AS at_ms", "IF((id DIV 500) % 2 = 0, id % 500, 500 - id % 500) / 10.0D AS gain_db")
    with hot_keys(False):
        kept = [r.at_ms for r in A.simplify_gain(table, 0.35).orderBy("at_ms").collect()]
    assert kept == list(range(0, 1_000_001, 500))


def test_smart_cuts_respect_shot_lengths(spark):
    markers = spark.createDataFrame([(1, "a", i * 500, 0.5 + (i % 4 == 0) * 0.4, i % 4 == 0, 1_000.0 + i * 500) for i in range(30)],
                                    "project_id long, clip_id string, source_ms long, confidence double, downbeat boolean, timeline_ms double")
    ranges = spark.createDataFrame([(1, "a", 1_000.0, 16_000.0)], "project_id long, clip_id string, range_start double, range_end double")
    cuts = [c for (c,) in rows(M.smart_beat_cuts(markers, ranges, ["project_id", "clip_id"], 700.0, 2_500.0), "cut_ms")]
    edges = [1_000.0, *cuts, 16_000.0]
    gaps = [b - a for a, b in zip(edges, edges[1:])]
    assert cuts and all(700 <= g <= 2_500 for g in gaps[:-1]) and 700 <= gaps[-1] <= 2_500 * 1.35


def test_edited_text_keeps_and_retimes_words(spark):
    words = spark.createDataFrame([(1, i, f"w{i}", t, i * 100, i * 100 + 80, 0.5) for i, t in enumerate("the quick brown fox".split())],
                                  "cue long, word_idx long, word_id string, text string, start_ms long, end_ms long, confidence double")
    edits = spark.createDataFrame([(1, "The quick red nice fox jumps", 0, 1_000)], "cue long, edited_text string, cue_start long, cue_end long")
    got = rows(C.align_edited_text(words, edits, ["cue"]), "word_idx", "word_id", "text", "start_ms", "end_ms", "confidence", "edited")
    assert got == [
        (0, "w0", "The", 0, 80, 1.0, True), (1, "w1", "quick", 100, 180, 0.5, False), (2, "edited-word-1", "red", 200, 240, 1.0, True),
        (3, "edited-word-2", "nice", 240, 280, 1.0, True), (4, "w3", "fox", 300, 380, 0.5, False), (5, "edited-word-3", "jumps", 380, 460, 1.0, True),
    ]


def test_crossing_of_release_and_attack(spark):
    target = [(1, "m", 0, 10_000, "v", 0.5, -14.0, 80, 100, 160, 650)]
    targets = spark.createDataFrame(target, "project_id long, clip_id string, start_ms long, duration_ms long, source_track string, min_confidence double, reduction_db double, lookahead_ms long, attack_ms long, hold_ms long, release_ms long")
    speech = spark.createDataFrame([(1, "m", 2_000, 3_000), (1, "m", 3_600, 4_000)], "project_id long, clip_id string, start_ms long, end_ms long")
    points = dict(rows(M.duck_envelope(targets, speech), "time_ms", "value"))
    meet = (1 + 3_160 / 650 + 3_420 / 100) / (1 / 650 + 1 / 100)
    at = min(points, key=lambda t: abs(t - meet))
    assert abs(at - meet) < 1e-3
    depth = 10 ** (-14 / 20)
    assert math.isclose(points[at], depth + (1 - depth) * (meet - 3_160) / 650, abs_tol=1e-4)
    assert points[0.0] == points[10_000.0] == 1.0


def test_face_clusters_wait_then_fill_back(spark):
    face = [[0.4, 0.4, 0.1, 0.1]]
    frames = [(1, t * 1_000, face if t >= 2 else []) for t in range(8)]
    df = spark.createDataFrame(frames, "asset_id long, time_ms long, faces array<array<double>>")
    got = rows(A.cluster_faces(df), "time_ms", "confidence")
    # The third hit activates the cluster; that frame was matched while nothing was active yet.
    assert got == [(t * 1_000, 0.4 if t < 4 else 0.35 if t == 4 else 1.0) for t in range(8)]


def test_camera_stays_inside_the_source(spark):
    rnd = random.Random(8)
    data = [(1, i * 100, 0.3 + rnd.random() * 0.4, 0.3 + rnd.random() * 0.4, 0.2, 0.3, 0.9, i) for i in range(60)]
    df = spark.createDataFrame(data, "asset_id long, time_ms long, x double, y double, width double, height double, confidence double, sample_idx long")
    held, verdict = A.hold_samples(A.accepted_samples(df))
    assert verdict.first().error is None
    path = A.camera_path(A.smooth_samples(held), 1920, 1080)
    assert path.count() == 180
    outside = "center_x - crop_w / 2 < -1e-5 OR center_x + crop_w / 2 > 1 + 1e-5 OR center_y - crop_h / 2 < -1e-5 OR center_y + crop_h / 2 > 1 + 1e-5"
    assert path.where(outside).count() == 0


def test_tracking_gap_fails_the_series(spark):
    df = spark.createDataFrame([(1, t, 0.5, 0.5, 0.1, 0.1, 0.9 if t == 0 else 0.1) for t in (0, 500, 1_000)], "asset_id long, time_ms long, x double, y double, width double, height double, confidence double")
    assert A.hold_samples(df)[1].first().error == "TRACKING_GAP"
    assert A.hold_samples(df, hold_all=True)[1].first().error is None


def test_planner_bounds_and_overlap(spark):
    assets = spark.createDataFrame([(1, 180_000)], "asset_id long, duration_ms long")
    words = spark.range(400).selectExpr("1L AS asset_id", "id AS word_idx", "IF(id % 12 = 0, 'neden?', 'kelime') AS text", "id * 450 AS start_ms", "id * 450 + 300 AS end_ms", "0.8D AS confidence")
    segments = spark.range(20).selectExpr("1L AS asset_id", "id * 9000 AS start_ms", "id * 9000 + 8000 AS end_ms", "0.9D AS confidence")
    empty = spark.createDataFrame([], "asset_id long, at_ms long, confidence double, downbeat boolean, score double, kind string")
    beats, events, kept = empty.select("asset_id", "at_ms", "confidence", "downbeat"), empty.select("asset_id", "at_ms", "score", "kind"), empty.select("asset_id", "at_ms", "score")
    plan = H.plan_highlights(assets, words, segments, beats, events, kept).collect()
    assert 1 <= len(plan) <= 6
    for p in plan:
        assert 15_000 <= p.end_ms - p.start_ms <= 45_000 and 0 <= p.start_ms and p.end_ms <= 180_000 and 0 <= p.score <= 100 and len(p.transcript) <= 1_200
    for i, a in enumerate(plan):
        for b in plan[i + 1 :]:
            assert not H.overlap_share_conflict((a.start_ms, a.end_ms), (b.start_ms, b.end_ms))


def test_caption_files_are_checked(spark, tmp_path):
    (tmp_path / "a.srt").write_bytes("﻿1\r\n00:00:01,000 --> 00:00:02,500\r\nHi\r\n".encode())
    (tmp_path / "b.vtt").write_bytes(b"\xff\xfe\x00bad")
    (tmp_path / "c.txt").write_text("ignored")
    files = K.read_caption_files(spark, str(tmp_path))
    assert rows(files.select(F.substring_index("path", "/", -1).alias("n"), F.coalesce("error", F.lit("-")).alias("e")), "n", "e") == [("a.srt", "-"), ("b.vtt", "invalid-utf8")]
    cues = K.parse_srt(files.where("error IS NULL").withColumn("doc_id", F.lit(1)))
    assert rows(cues, "cue_id", "start_ms", "end_ms", "text") == [("1", 1_000, 2_500, "Hi")]


def test_bad_cue_times_fail_the_export(spark):
    cues = spark.createDataFrame([(1, 0, "a", 500, 100, "x")], "doc_id long, cue_idx long, cue_id string, start_ms long, end_ms long, text string")
    with pytest.raises(Exception, match="invalid times"):
        K.write_srt(cues).collect()


def _rounds(monkeypatch):
    """Counts the tables that a fold writes."""
    from cuelattice.kernel import fold

    written = []
    real = fold.cut_lineage
    monkeypatch.setattr(fold, "cut_lineage", lambda df: written.append(1) or real(df))
    return written


def test_spoken_only_in_chunks(spark, monkeypatch):
    """Chunks of any size give what one pass gives, and their number does not change how many tables are written."""
    rnd = random.Random(5)
    signs = ["a", "b ", "c", "(", ")", "[", "]", "{", "}", "*", "♪"]
    data = [(k, i, "".join(rnd.choices(signs, [6, 3, 6, 1, 2, 1, 2, 1, 2, 1, 1], k=rnd.randrange(0, 7)))) for k in range(3) for i in range(150)]
    words = spark.createDataFrame(data, "asset_id long, word_idx long, text string")
    with hot_keys(False):
        want = rows(C.spoken_only(words), "asset_id", "word_idx", "text")
    written, counts = _rounds(monkeypatch), []
    for size in (30, 4):
        written.clear()
        with hot_keys(True):
            assert rows(C.spoken_only(words, chunk_rows=size), "asset_id", "word_idx", "text") == want
        counts.append(len(written))
    assert counts[0] == counts[1]
    assert {r[0] for r in want} == {0, 1, 2}


def test_learned_ratios_in_chunks(spark, monkeypatch):
    rnd = random.Random(6)
    data = [("p", "planning", i, float(rnd.choice([10, 900, 2500, 9_000, 40_000])), 60_000) for i in range(80)]
    runs = spark.createDataFrame(data, "profile_id string, stage string, run_no long, elapsed_ms double, source_ms long")
    ratio = 1.0
    for row in data:
        ratio = min(4.0, max(0.35, ratio * 0.72 + min(4.0, max(0.35, max(250, row[3]) / 2500)) * 0.28))
    written, counts = _rounds(monkeypatch), []
    for hot, size in ((False, 10**6), (True, 30), (True, 3)):
        written.clear()
        with hot_keys(hot):
            assert B.learned_ratios(runs, chunk_rows=size).first().ratio == pytest.approx(ratio, abs=1e-12)
        counts.append(len(written))
    assert counts[1] == counts[2]


def test_spoken_only_carries_brackets(spark):
    words = spark.createDataFrame([(1, i, t) for i, t in enumerate(["hi", "(loud", "noise)", "there", "♪", "la", "♪", "*bang*", "end)"])], "asset_id long, word_idx long, text string")
    assert rows(C.spoken_only(words), "word_idx", "text") == [(0, "hi"), (3, "there"), (8, "end)")]


def test_unique_ids_avoid_taken_suffixes(spark):
    cues = spark.createDataFrame([(1, i, c) for i, c in enumerate(["a", "a-2", "a", "", "a"])], "doc_id long, cue_idx long, cue_id string")
    assert rows(C.unique_ids(cues, ["doc_id"], "cue_idx", "cue_id", "cue-"), "cue_idx", "cue_id") == [(0, "a"), (1, "a-2"), (2, "a-3"), (3, "cue-4"), (4, "a-4")]


@pytest.mark.parametrize("hot", [False, True])
def test_smart_cuts_are_the_best_chain(spark, hot):
    """Against every chain of up to ten markers."""
    rnd = random.Random(11)
    markers, spans = [], []
    for clip in range(12):
        start, end = 0.0, float(rnd.randrange(4_000, 9_000))
        spans.append((1, f"c{clip}", start, end))
        for at in sorted(rnd.sample(range(500, int(end) - 500, 50), 9)):
            markers.append((1, f"c{clip}", at, rnd.randrange(100) / 100, rnd.random() < 0.3, float(at)))
    m = spark.createDataFrame(markers, "project_id long, clip_id string, source_ms long, confidence double, downbeat boolean, timeline_ms double")
    r = spark.createDataFrame(spans, "project_id long, clip_id string, range_start double, range_end double")
    with hot_keys(hot):
        got = {}
        for clip, at in rows(M.smart_beat_cuts(m, r, ["project_id", "clip_id"], 700.0, 2_500.0), "clip_id", "cut_ms"):
            got.setdefault(clip, []).append(at)

    def score(chain, gains, end):
        total, last = 0.0, 0.0
        for at in [*chain, end]:
            shot = at - last
            if not 700 <= shot <= 2_500 * (1.35 if at == end else 1):
                return None
            total, last = total + gains.get(at, 0.0) - abs(shot - 1_600) / 1_600 * 0.28, at
        return total

    for _, clip, _, end in spans:
        gains = {at: c + (0.45 if d else 0) for _, k, _, c, d, at in markers if k == clip and 700 <= at <= end - 700}
        scores = [s for n in range(len(gains) + 1) for chain in itertools.combinations(sorted(gains), n) if (s := score(chain, gains, end)) is not None]
        if scores:
            assert math.isclose(score(got.get(clip, []), gains, end), max(scores), abs_tol=1e-9)
        else:
            assert clip not in got


def test_edited_text_keeps_speakers_and_marks(spark):
    words = spark.createDataFrame(
        [(1, 0, "a0", "one", 0, 90, 0.5, "s1", "en", False), (1, 1, "a1", "two", 100, 190, 0.6, "s1", "en", True), (1, 2, "a2", "three", 200, 290, 0.7, "s2", "tr", False), (1, 3, "a3", "four", 400, 490, 0.8, "s2", "tr", False)],
        "cue long, word_idx long, word_id string, text string, start_ms long, end_ms long, confidence double, speaker_id string, language string, edited boolean")
    edits = spark.createDataFrame([(1, "zero one two 3 and four", 0, 1_000), (2, "new words", 50, 60)], "cue long, edited_text string, cue_start long, cue_end long")
    got = rows(C.align_edited_text(words, edits, ["cue"]), "cue", "word_idx", "word_id", "start_ms", "end_ms", "speaker_id", "language", "edited")
    assert got == [
        (1, 0, "edited-word-1", -0, 1, "s1", None, True), (1, 1, "a0", 0, 90, "s1", "en", False), (1, 2, "a1", 100, 190, "s1", "en", True),
        (1, 3, "edited-word-2", 200, 245, "s2", None, True), (1, 4, "edited-word-3", 245, 290, "s2", None, True), (1, 5, "a3", 400, 490, "s2", "tr", False),
        (2, 0, "edited-word-1", 50, 55, None, None, True), (2, 1, "edited-word-2", 55, 60, None, None, True),
    ]


def test_face_clusters_switch_and_evict(spark):
    """A second face takes over once it is seen more often; the first cluster seen is evicted for new ones."""
    away = [[0.05 + 0.03 * (k % 30), 0.05 + 0.3 * (k // 30), 0.01, 0.01] for k in range(60)]
    frames = [(1, t * 1_000, [[0.4, 0.4, 0.1, 0.1]] if t < 5 else [away[t % 60]] if t < 40 else [[0.7, 0.2, 0.1, 0.1]]) for t in range(90)]
    df = spark.createDataFrame(frames, "asset_id long, time_ms long, faces array<array<double>>")
    got = rows(A.cluster_faces(df), "time_ms", "left", "confidence")
    first, second = 0.45 - 0.105, 0.75 - 0.105
    assert len(got) == 90 and all(math.isclose(left, first) for t, left, _ in got if t < 42_000)
    assert all(math.isclose(left, second) for t, left, _ in got if t >= 46_000)


def test_planner_options_have_defaults_and_are_bounded(spark):
    assets = spark.createDataFrame([(1, 200_000), (2, 5_000)], "asset_id long, duration_ms long")
    default = H.normalize_options(assets).orderBy("asset_id").collect()
    named = H.normalize_options(assets, H.PlannerOptions(30_000, 15_000, 45_000, 6, 700)).orderBy("asset_id").collect()
    assert default == named and len(default) == 2
    assert H.normalize_options(assets, H.PlannerOptions(max_candidates=2)).collect() != default


def test_extra_lexicons_label_words(spark):
    words = spark.createDataFrame([(1, 0, "kediyle"), (1, 1, "hello"), (1, 2, "zumba")], "asset_id long, word_idx long, text string")
    marked = spark.createDataFrame([], "asset_id long, word_idx long, dict_language string")

    def labels(**extra):
        return {r.text: (r.label, r.source) for r in C.code_switch(words, marked, "tr", **extra).collect()}

    assert labels()["zumba"] == ("tr", "inherited")
    assert labels(english=("zumba",))["zumba"] == ("en", "lexicon")
    assert labels(turkish=("zumba",))["zumba"] == ("tr", "lexicon")
    assert labels(english=("zumba",), turkish=("zumba",))["zumba"] == ("tr", "inherited")


def plain_edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
    return row[-1]


@pytest.mark.parametrize("most", [0.0, 0.34, 0.6, 1.0])
def test_fuzzy_dictionary_misses_no_form(spark, most):
    rng = random.Random(3)
    texts = ["".join(rng.choice("abc") for _ in range(rng.randrange(1, 9))) for _ in range(40)]
    words = spark.createDataFrame([(1, k, t) for k, t in enumerate(texts)], "asset_id long, word_idx long, text string")
    terms = ["".join(rng.choice("abc ") for _ in range(rng.randrange(2, 10))).strip() or "a" for _ in range(12)]
    dictionary = spark.createDataFrame([(f"e{k}", k, t, [], "term", "en") for k, t in enumerate(terms)], "entry_id string, entry_ord int, canonical string, variants array<string>, category string, language string")
    want = {}
    for k, form in enumerate(terms):
        size = max(1, len(form.split()))
        for first in range(len(texts)):
            for n in range(max(1, size - 1), size + 2):
                run = " ".join(texts[first : first + n])
                if first + n > len(texts) or run == form:
                    continue
                spaced, plain = " ".join(form.split()), "".join(form.split())
                compact = run.replace(" ", "")
                distance = min(plain_edits(run, spaced) / max(len(run), len(spaced), 1), plain_edits(compact, plain) / max(len(compact), len(plain), 1))
                if distance <= most and not (len(compact) < 3 and distance > 0):
                    want[first, n, k] = round(distance, 9)
    got = C.dictionary_matches(words, dictionary, most).collect()
    assert {(r.first_idx, r.n_words, r.entry_ord): round(r.distance, 9) for r in got} == want
    assert len(got) == len(want)


def test_alignment_is_the_tables_and_needs_little_memory():
    """Anchors equal those of a recursion over the whole table; a cue of 20 000 words does not need that table."""
    def plain(a, b):
        @functools.cache
        def longest(i, j):
            if i == len(a) or j == len(b):
                return 0
            return longest(i + 1, j + 1) + 1 if a[i] == b[j] else max(longest(i + 1, j), longest(i, j + 1))

        pairs, i, j = [], 0, 0
        while i < len(a) and j < len(b):
            if a[i] == b[j]:
                pairs.append((i, j))
            same = a[i] == b[j]
            old_first = longest(i + 1, j) >= longest(i, j + 1)
            i, j = i + (same or old_first), j + (same or not old_first)
        return pairs

    rnd = random.Random(12)
    for _ in range(400):
        a, b = (rnd.choices("abcdef"[: rnd.randrange(1, 7)], k=rnd.randrange(0, 14)) for _ in range(2))
        assert C._align(a, b) == plain(a, b)
    old = [f"w{rnd.randrange(3_000)}" for _ in range(20_000)]
    new = [w for w in old if rnd.random() > 0.05]
    tracemalloc.start()
    pairs = C._align(old, new)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(pairs) == len(new) and all(old[i] == new[j] for i, j in pairs) and peak < 100 << 20


@pytest.mark.parametrize("most", [0.0, 0.2, 0.34, 0.49])
def test_spelling_pairs_match_all_pairs(spark, most):
    rng = random.Random(5)
    texts = {"".join(rng.choice("abé漢 ") for _ in range(rng.randint(1, 9))) for _ in range(150)}
    for text in list(texts)[:40]:
        k = rng.randrange(len(text))
        texts |= {text[:k] + text[k + 1 :], text[:k] + "b" + text[k:], text[:k] + "a" + text[k + 1 :]}
    texts.discard("")

    def edits(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row, last = [i], row
            for j, y in enumerate(b, 1):
                row.append(min(last[j] + 1, row[j - 1] + 1, last[j - 1] + (x != y)))
        return row[-1]

    table = spark.createDataFrame([(t,) for t in [*texts, *texts, None, ""]], "text string")
    got = C.spelling_pairs(table, most).collect()
    wanted = {}
    for a, b in itertools.combinations(sorted(texts), 2):
        longer = max(len(a), len(b))
        if abs(len(a) - len(b)) <= most * longer and (d := edits(a, b)) <= most * longer + 1e-9:
            wanted[a, b] = d / longer
    assert len(got) == len(wanted) and {(r.left, r.right): r.distance for r in got} == pytest.approx(wanted)
    assert C.spelling_pairs(table.limit(0), most).count() == 0


def test_dictionary_comparisons_run_once_for_all_who_read_the_matches(spark):
    words = spark.createDataFrame([(1, 0, "kubernets"), (1, 1, "is")], "asset_id long, word_idx long, text string")
    terms = spark.createDataFrame([("e", 0, "Kubernetes", ["k8s"], "term", "en")], "entry_id string, entry_ord long, canonical string, variants array<string>, category string, language string")
    found = C.dictionary_matches(words, terms)
    assert "levenshtein" not in found._jdf.queryExecution().executedPlan().toString()
    chosen = C.select_suggestions(found)
    assert [r["canonical"] for r in chosen.collect()] == ["Kubernetes"]
    timed = words.selectExpr("*", "word_idx * 100 AS start_ms", "word_idx * 100 + 50 AS end_ms", "0.9D AS confidence")
    assert rows(C.word_quality(timed, terms, "en", chosen), "word_idx", "needs_review") == rows(C.word_quality(timed, terms, "en"), "word_idx", "needs_review")


ODD_WORDS = ["Ab,c", "\u2014", "I\u0307zmir", "x", "a\x0bb", "\u039f\u0394\u039f\u03a3", ".\u03a3", "e\u0301t\u00e9", "\u0301q", "!", "Stra\u00dfe", "\ufb01n", "7", "\U0001d400z", None, "end"]


@pytest.mark.parametrize("hot", [False, True])
def test_runs_are_put_together_from_folded_words(spark, hot):
    words = spark.createDataFrame([(1, k, t) for k, t in enumerate(ODD_WORDS)], "asset_id long, word_idx long, text string")
    with hot_keys(hot):
        runs = C.word_runs(words, 3, pairs=True)
        # A word is folded by itself, not again in each run that holds it.
        assert "translate(array_join" not in runs._jdf.queryExecution().optimizedPlan().toString()
        whole = runs.select("*", C.normalized_phrase(F.col("input_text")).alias("s"), C.compact_phrase(F.col("input_text")).alias("c"))
        found = whole.withColumn("p", F.expr(C._pair_mask("c"))).collect()
    assert len(found) > 40
    for r in found:
        assert (r.spaced, r.compact, r.pairs) == (r.s, r.c, r.p), r.input_text


def test_fuzzy_dictionary_writes_matches_and_no_other_runs(spark, monkeypatch):
    rng = random.Random(4)
    texts = ["".join(rng.choice("bcd") for _ in range(12)) for _ in range(60)] + ["kubernets"]
    words = spark.createDataFrame([(1, k, t) for k, t in enumerate(texts)], "asset_id long, word_idx long, text string")
    terms = spark.createDataFrame([("e", 0, "Kubernetes", [], "term", "en")], "entry_id string, entry_ord long, canonical string, variants array<string>, category string, language string")
    written, cut = [], C.cut_lineage
    monkeypatch.setattr(C, "cut_lineage", lambda df: written.append(cut(df)) or written[-1])
    found = C.dictionary_matches(words, terms)
    assert found.count() == 1
    assert [df.count() for df in written if "input_text" in df.columns] == [1]


def test_dictionary_language_folds_no_run(spark):
    words = spark.createDataFrame([(1, 0, "De"), (1, 1, "ploy"), (1, 2, "it")], "asset_id long, word_idx long, text string")
    terms = spark.createDataFrame([("e", 0, "deploy", [], "term", "en")], "entry_id string, entry_ord long, canonical string, variants array<string>, category string, language string")
    found = C.dictionary_languages(words, terms)
    assert "translate(array_join" not in found._jdf.queryExecution().optimizedPlan().toString()
    assert rows(found, "word_idx", "dict_language") == [(0, "en"), (1, "en")]


def test_code_switch_folds_each_word_once(spark):
    words = spark.createDataFrame([(1, 0, "ve"), (1, 1, "actually"), (1, 2, "zqx"), (1, 3, "\u015feq"), (1, 4, "zz")], "asset_id long, word_idx long, text string")
    marked = spark.createDataFrame([(1, 4, "tr")], "asset_id long, word_idx long, dict_language string")
    found = C.code_switch(words, marked, "en")
    assert found._jdf.queryExecution().optimizedPlan().toString().count("translate(") == 1
    assert rows(found, "word_idx", "label", "source", "is_code_switch") == [
        (0, "tr", "lexicon", True), (1, "en", "lexicon", False), (2, "en", "inherited", False), (3, "tr", "heuristic", True), (4, "tr", "dictionary", True)]


@pytest.mark.parametrize("hot", [False, True])
def test_words_from_tokens_are_built_once(spark, hot):
    raw = [(1, 0, 0, " Al"), (1, 0, 1, "pha"), (1, 0, 2, " [noise]"), (1, 0, 3, " beta"), (1, 1, 4, "gam"), (1, 1, 5, "ma"), (None, 0, 6, " lost")]
    tokens = spark.createDataFrame([(*r, None, None, 0.5, 0, 1000) for r in raw],
                                   "asset_id long, segment_idx long, token_idx long, raw string, from_ms long, to_ms long, p double, segment_from long, segment_to long")
    with hot_keys(hot):
        found = C.words_from_tokens(tokens)
        if not hot:
            assert found._jdf.queryExecution().optimizedPlan().toString().count("collect_list") == 1
        assert rows(found, "asset_id", "segment_idx", "word_no", "text", "start_ms", "end_ms", "confidence") == [
            (1, 0, 1, "Alpha", 0, 500, 0.5), (1, 0, 2, "beta", 500, 1000, 0.5), (1, 1, 1, "gamma", 0, 1000, 0.5)]


def test_anchors_leave_a_task_a_few_cues_at_a_time(spark):
    """As Python objects, the anchors of a whole Arrow batch took gigabytes."""

    class Cues:
        schema = spark.range(1).selectExpr("id AS doc_id", "'a' AS cue_id").schema

        def select(self, *_):
            return self

        def mapInArrow(self, run, _):  # noqa: N802
            return run

    texts = [["a", "b", "c", "d"], ["b", "x", "d", "e"]]
    cues = pa.RecordBatch.from_pydict({"doc_id": list(range(1000)), "cue_id": ["c"] * 1000, "old_tokens": [texts[0]] * 1000, "new_tokens": [texts[1]] * 1000})
    out = list(C.token_anchors(Cues(), ["doc_id", "cue_id"])(iter([cues])))
    assert max(part.num_rows for part in out) <= 2 * C.ANCHOR_CUES
    assert sorted((r["doc_id"], r["new_idx"], r["old_idx"]) for part in out for r in part.to_pylist()) == [(k, *p) for k in range(1000) for p in ((0, 1), (2, 3))]


def test_recogniser_json_deals_texts_and_not_words(spark, tmp_path):
    """Words of a document are gathered where its text is; only the texts are shuffled."""
    spark.createDataFrame([(k, "a b c d e " * 20, "en", "s", 200) for k in range(40)], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    load_all()
    plan = QUERIES["src_15_recogniser_json"](spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1
    assert QUERIES["src_15_recogniser_json"](spark, str(tmp_path)).count() == 30 * 100


def test_caption_files_are_parsed_in_tasks_of_their_own(spark, tmp_path):
    """Parsing is far more work than its few bytes tell, which one merged task would do alone."""
    spark.createDataFrame([(k, t, "user", f"line {k} {t}") for k in range(40) for t in range(3)], "conv_id long, turn long, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    load_all()
    out = QUERIES["src_10_convert_dispatch"](spark, str(tmp_path))
    busy = out.withColumn("task", F.spark_partition_id()).groupBy("doc_id").agg(F.min("task").alias("task")).select("task").distinct().count()
    assert out.count() == 120 and busy > 3


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@BOTH
def test_split_keyframes_reads_cut_clips_only_and_needs_no_scan(spark, hot):
    frames = spark.createDataFrame(
        [(1, "c1", "pan", 0, 0.0, "linear", 0), (1, "c1", "pan", 100, 1.0, "linear", 1), (1, "c1", "pan", 100, 2.0, "hold", 2), (1, "c1", "scale", 50, 3.0, "hold", 3),
         (1, "c1", "volume", 80, 4.0, "hold", 4), (1, "c1", "volume", 80, 5.0, "linear", 5), (1, "c2", "pan", 0, 9.0, "linear", 0)],
        "project_id long, clip_id string, property string, time_ms long, value double, easing string, ordinal long")
    cuts = spark.createDataFrame([(1, "c1", "c1b", 50)], "project_id long, clip_id string, new_id string, cut_ms long")
    with hot_keys(hot):
        out = M.split_keyframes(frames, cuts)
    assert "Window" not in plan_of(out)
    found = rows(out.where("property <> 'volume' OR time_ms IN (0, 50)"), "clip_id", "property", "time_ms", "value", "easing")
    assert found == sorted([
        ("c1", "pan", 0.0, 0.0, "linear"), ("c1", "pan", 50.0, 1.0, "linear"), ("c1b", "pan", 0.0, 1.0, "linear"), *[f for f in found if f[1:3] == ("pan", 50.0) and f[0] == "c1b"],
        ("c1", "scale", 50.0, 3.0, "hold"), ("c1b", "scale", 0.0, 3.0, "hold"),
        ("c1", "volume", 50.0, 5.0, "hold"), ("c1b", "volume", 0.0, 5.0, "hold")])


@BOTH
def test_deleted_ranges_are_merged_once(spark, hot):
    clips = spark.createDataFrame(
        [(1, "c1", "t1", 1000, 5000, 0, 1.0), (1, "c2", "t1", 7000, 900, 0, 1.0), (1, "c3", "t2", 7000, 900, 0, 1.0), (2, "c1", "t1", 0, 5000, 0, 1.0)],
        "project_id long, clip_id string, track_id string, start_ms long, duration_ms long, trim_in_ms long, speed double")
    tracks = spark.createDataFrame([(1, "t1", False), (1, "t2", False), (2, "t1", True)], "project_id long, track_id string, locked boolean")
    ranges = spark.createDataFrame([(1, "c1", 1000, 2000), (1, "c1", 1500, 2500), (1, "c1", 4000, 4998), (2, "c1", 0, 100)], "project_id long, clip_id string, start_ms long, end_ms long")
    with hot_keys(hot):
        out = M.delete_ranges(clips, tracks, ranges, ripple=True)
    assert "Window" not in plan_of(out)
    assert rows(out, "project_id", "clip_id", "start_ms", "duration_ms", "trim_in_ms") == [
        (1, "c1", 1000, 1000, 0.0), (1, "c1~1", 2000, 1500, 2500.0), (1, "c2", 4500, 900, 0.0), (1, "c3", 7000, 900, 0.0), (2, "c1", 0, 5000, 0.0)]


@BOTH
def test_sounds_without_words_are_found_without_pairs(spark, hot):
    sounds = [(1, 0, 1000, 0.5), (1, 2000, 2500, 0.5), (1, 3000, 3100, 0.5), (1, 4000, 5000, 0.5), (2, 100, 600, 0.5)]
    said = [(1, 100, 2000, "one", 0.9), (1, 2500, 2600, "two", 0.9), (1, 1000, 4001, "far", 0.9)]
    segments = spark.createDataFrame(sounds, "asset_id long, start_ms long, end_ms long, confidence double")
    assets = spark.createDataFrame([(1, 9000), (2, 9000)], "asset_id long, duration_ms long")
    for taken in ([0, 1], [0, 1, 2]):
        words = spark.createDataFrame([said[i] for i in taken], "asset_id long, start_ms long, end_ms long, text string, confidence double")
        with hot_keys(hot):
            out = C.edit_suggestions(segments, words, assets)
        assert "__bin" not in plan_of(out)
        want = [(a, s, e) for a, s, e, _ in sounds if 180 <= e - s <= 1200 and not any(said[i][0] == a and said[i][2] > s and said[i][1] < e for i in taken)]
        assert rows(out.where("kind = 'possible-filler-sound'"), "asset_id", "start_ms", "end_ms") == sorted(want)


def test_candidates_are_scored_once_before_they_are_picked(spark, monkeypatch):
    spans = [(1, 1_000 * i, 1_000 * i + 1_500, 50 + i * 7 % 40, 0, i) for i in range(12)]
    scored = spark.createDataFrame(spans, "asset_id long, start_ms long, end_ms long, score long, kind int, anchor_ms long")
    read, pick = [], H.greedy_suppress
    monkeypatch.setattr(H, "greedy_suppress", lambda df, *a, **b: read.append(df.inputFiles()) or pick(df, *a, **b))
    options = spark.createDataFrame([(1, 20)], "asset_id long, max_candidates long")
    kept = H.suppress_candidates(scored, options)
    # They come from the written table, so measuring and picking do not run the scoring twice.
    assert read[0] and all("/cut-" in f for f in read[0])
    left, best = [], sorted(spans, key=lambda s: (-s[3], s[1]))
    for s in best:
        if not any(H.overlap_share_conflict((o[1], o[2]), (s[1], s[2])) for o in left):
            left.append(s)
    assert rows(kept, "start_ms", "score") == sorted((s[1], s[3]) for s in left)
