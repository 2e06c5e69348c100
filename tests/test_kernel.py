"""Kernels: the plan for huge keys must give exactly what the plain plan and a plain loop give."""

import random

import pytest
from conftest import rows
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cuelattice.kernel.fold import ordered_fold
from cuelattice.kernel.intervals import complement, merge_intervals, overlap_join, step_function
from cuelattice.kernel import scan
from cuelattice.kernel.ranges import range_max, range_sums, top_n
from cuelattice.kernel.scan import Running, as_of, hot_keys, nearest_rank, running, time_chunk
from cuelattice.kernel.suppress import greedy_suppress

BOTH = pytest.mark.parametrize("hot", [False, True])


def series(spark, n=300, seed=7, span=20_000):
    rnd = random.Random(seed)
    data = [(i % 3, rnd.randrange(span), i, rnd.randrange(100)) for i in range(n)]
    return data, spark.createDataFrame(data, "k long, t long, i long, v long")


@BOTH
def test_running_matches_loop(spark, hot):
    data, df = series(spark)
    specs = [
        Running("s", "sum", F.col("v")), Running("m", "max", F.col("v"), inclusive=False),
        Running("p", "last", F.when(F.col("v") > 50, F.col("v")), inclusive=False), Running("n", "last", F.col("v"), inclusive=False, reverse=True),
    ]
    with hot_keys(hot):
        got = rows(running(df, ["k"], ["t", "i"], specs, time_chunk("t", 500)), "k", "t", "i", "s", "m", "p", "n")
    want = []
    for key in range(3):
        mine = sorted((t, i, v) for k, t, i, v in data if k == key)
        for at, (t, i, v) in enumerate(mine):
            before = [x[2] for x in mine[:at]]
            big = [x for x in before if x > 50]
            want.append((key, t, i, sum(before) + v, max(before, default=None), big[-1] if big else None, mine[at + 1][2] if at + 1 < len(mine) else None))
    key = lambda r: tuple((x is None, x) for x in r)
    assert sorted(got, key=key) == sorted(want, key=key)


@BOTH
def test_merge_and_complement(spark, hot):
    rnd = random.Random(3)
    spans = [(k, s, s + rnd.randrange(1, 900)) for k in range(2) for s in (rnd.randrange(30_000) for _ in range(60))]
    df = spark.createDataFrame(spans, "k long, start_ms long, end_ms long")
    with hot_keys(hot):
        merged = merge_intervals(df, ["k"], width=700)
        got = rows(merged, "k", "start_ms", "end_ms")
        gaps = rows(complement(merged, spark.createDataFrame([(0, 40_000), (1, 40_000)], "k long, duration_ms long"), ["k"], width=700), "k", "start_ms", "end_ms")
    want, holes = [], []
    for key in range(2):
        cursor = 0
        for _, s, e in sorted(x for x in spans if x[0] == key):
            if want and want[-1][0] == key and s <= want[-1][2]:
                want[-1] = (key, want[-1][1], max(want[-1][2], e))
            else:
                want.append((key, s, e))
        for _, s, e in [w for w in want if w[0] == key]:
            if s > cursor:
                holes.append((key, cursor, s))
            cursor = e
        holes.append((key, cursor, 40_000))
    assert got == sorted(want)
    assert gaps == sorted(holes)


@BOTH
def test_as_of(spark, hot):
    frames = spark.createDataFrame([(1, 100, "a"), (1, 900, "b"), (1, 5_000, "c")], "k long, f long, name string")
    asked = spark.createDataFrame([(1, t) for t in (0, 100, 500, 900, 4_999, 9_000)], "k long, q long")
    with hot_keys(hot):
        got = rows(as_of(asked, frames, ["k"], "q", "f", ["name"], width=300).selectExpr("q", "prev.name AS p", "next.name AS n").na.fill("-"), "q", "p", "n")
    assert got == [(0, "-", "a"), (100, "a", "b"), (500, "a", "b"), (900, "b", "c"), (4_999, "b", "c"), (9_000, "c", "-")]


def test_overlap_join_counts_each_pair_once(spark):
    rnd = random.Random(5)
    left = [(1, i, s, s + rnd.randrange(1, 3_000)) for i, s in enumerate(rnd.randrange(20_000) for _ in range(80))]
    right = [(1, i, s, s + rnd.randrange(1, 3_000)) for i, s in enumerate(rnd.randrange(20_000) for _ in range(80))]
    a = spark.createDataFrame(left, "k long, a long, s long, e long")
    b = spark.createDataFrame(right, "k long, b long, s2 long, e2 long")
    for closed in (False, True):
        got = rows(overlap_join(a, b, ["k"], ("s", "e"), ("s2", "e2"), 500, closed), "a", "b")
        hit = (lambda s, e, x, y: e >= x and s <= y) if closed else (lambda s, e, x, y: e > x and s < y)
        assert got == sorted((i, j) for _, i, s, e in left for _, j, x, y in right if hit(s, e, x, y))


def test_step_function(spark):
    df = spark.createDataFrame([(1, 0, 10, 5), (1, 4, 6, 9), (1, 20, 30, 1)], "k long, s long, e long, v long")
    assert rows(step_function(df, ["k"], "s", "e", "v", 7), "lo", "hi", "level") == [(0, 4, 5), (4, 6, 9), (6, 10, 5), (20, 30, 1)]


@BOTH
def test_range_sums_and_max(spark, hot):
    rnd = random.Random(9)
    points = [(1, rnd.randrange(30_000), rnd.randrange(100)) for _ in range(200)]
    spans = sorted({(1, s, s + rnd.randrange(0, 12_000)) for s in (rnd.randrange(25_000) for _ in range(60))})
    p = spark.createDataFrame(points, "k long, t long, v long")
    w = spark.createDataFrame(spans, "k long, start_ms long, end_ms long")
    with hot_keys(hot):
        sums = rows(range_sums(w, p, ["k"], "t", {"c": ("v", "closed"), "b": ("v", "before_end"), "u": ("v", "until_start")}, 900), "start_ms", "end_ms", "c", "b", "u")
    tops = rows(range_max(w, p, ["k"], "t", "v", "m", 1_000), "start_ms", "end_ms", "m")
    total = lambda f: sum(v for _, t, v in points if f(t))
    assert sums == [(s, e, total(lambda t: s <= t <= e), total(lambda t: t < e), total(lambda t: t <= s)) for _, s, e in spans]
    best = {(s, e): max((v for _, t, v in points if s <= t <= e), default=None) for _, s, e in spans}
    assert tops == sorted((s, e, m) for (s, e), m in best.items() if m is not None)


@BOTH
def test_nearest_rank(spark, hot):
    values = [5.0, 1.0, 3.0, 3.0, 9.5, -2.0, 7.25]
    df = spark.createDataFrame([(1, v) for v in values], "k long, v double")
    with hot_keys(hot):
        got = nearest_rank(df, ["k"], "v", {"a": 0.5, "b": 0.9, "c": 0.0}).first()
    s = sorted(values)
    pick = lambda q: s[int((len(s) - 1) * q + 0.5)]
    assert (got.n_values, got.a, got.b, got.c) == (7, pick(0.5), pick(0.9), pick(0.0))


def test_fold_chunks_equal_sequential(spark):
    """A greedy spacing fold, with the key cut into many row chunks."""
    data, df = series(spark, 240, 11, 6_000)

    def step(state, row):
        return (row[0], [(row[0],)]) if state is None or row[0] - state >= 37 else (state, [])

    fields = [T.StructField("t", T.LongType())]
    outcomes = []
    for hot, size in ((False, 10**6), (True, 17)):
        with hot_keys(hot):
            outcomes.append(rows(ordered_fold(df, ["k"], ["t", "i"], ["t"], step, fields, chunk=time_chunk("t", 400), chunk_rows=size), "k", "t"))
    want = []
    for key in range(3):
        last = None
        for t in sorted(t for k, t, _, _ in data if k == key):
            if last is None or t - last >= 37:
                want.append((key, t))
                last = t
    assert outcomes[0] == outcomes[1] == sorted(want)


def test_suppression_rounds_equal_sequential(spark):
    rnd = random.Random(2)
    cand = [(1, i, s, s + 50, -rnd.randrange(40)) for i, s in enumerate(rnd.randrange(2_500) for _ in range(160))]
    df = spark.createDataFrame(cand, "k long, i long, s long, e long, neg long")
    conflict = lambda a, b: abs(a[0] - b[0]) < 50
    outcomes = []
    for hot, size in ((False, 10**6), (True, 9)):
        with hot_keys(hot):
            outcomes.append(rows(greedy_suppress(df, ["k"], "s", "e", ["neg", "i"], conflict, chunk_rows=size, width=400), "i"))
    kept = []
    for _, i, s, _, _ in sorted(cand, key=lambda c: (c[4], c[1])):
        if all(abs(s - o) >= 50 for _, o in kept):
            kept.append((i, s))
    assert outcomes[0] == outcomes[1] == sorted((i,) for i, _ in kept)


def test_top_n(spark):
    df = spark.range(100).selectExpr("id % 2 AS k", "id AS v")
    assert rows(top_n(df, ["k"], [F.col("v").desc()], 3, F.expr("v DIV 10")), "k", "v") == [(0, 94), (0, 96), (0, 98), (1, 95), (1, 97), (1, 99)]


def test_hot_key_is_measured(spark):
    """Without a fixed choice the scan measures its input; a third of all rows in one key gives the same result."""
    df = spark.range(3_000).selectExpr("IF(id % 3 = 0, 0L, id) AS k", "id AS t", "1 AS v")


    plain = running(df, ["k"], ["t"], [Running("s", "sum", F.col("v"))], time_chunk("t", 100)).agg(F.sum("s")).first()[0]
    limit, scan.is_hot.__defaults__ = scan.is_hot.__defaults__, (500,)
    try:
        split = running(df, ["k"], ["t"], [Running("s", "sum", F.col("v"))], time_chunk("t", 100)).agg(F.sum("s")).first()[0]
    finally:
        scan.is_hot.__defaults__ = limit
    assert plain == split == sum(range(1, 1_001)) + 2_000


@pytest.mark.parametrize("size", [10**6, 3])
def test_suppression_looks_back_as_far_as_the_longest_span(spark, size):
    """Long spans far before a short one still suppress it, in both plans."""
    from cuelattice.operators.highlights import overlap_share_conflict

    spans = [(1, 0, 180_000, 0), (1, 70_000, 250_000, 1), (1, 170_000, 190_000, 2), (1, 400_000, 401_000, 3), (1, 400_100, 401_100, 4), (1, 900_000, 1_300_000, 5), (1, 1_200_000, 1_290_000, 6)]
    df = spark.createDataFrame(spans, "k long, s long, e long, i long")
    with hot_keys(size < 10):
        kept = rows(greedy_suppress(df, ["k"], "s", "e", ["i"], overlap_share_conflict, chunk_rows=size, width=60_000), "i")
    chosen = []
    for _, s, e, i in spans:
        if not any(overlap_share_conflict((a, b), (s, e)) for a, b, _ in chosen):
            chosen.append((s, e, i))
    assert kept == sorted((i,) for _, _, i in chosen)


def test_sparse_waveform_peaks_keep_their_distance(spark):
    """The least distance follows the sample spacing, however sparse the waveform is."""
    from cuelattice.operators.highlights import waveform_energy_events

    values = [0.05, 0.9, 0.05, 0.8, 0.05, 0.05, 0.05, 0.7, 0.05, 0.05]
    wave = spark.createDataFrame([(1, i, v) for i, v in enumerate(values)], "asset_id long, idx long, value double")
    assets = spark.createDataFrame([(1, 5_200)], "asset_id long, duration_ms long")
    assert rows(waveform_energy_events(wave, assets), "at_ms") == [(780,), (3_900,)]


def test_long_dictionary_form_blocks_every_word_it_covers(spark):
    from cuelattice.operators.captions import select_suggestions

    matches = spark.createDataFrame([(1, 0, 20, 21, 0.0, 0, 0), (1, 18, 19, 2, 0.1, 1, 0), (1, 21, 22, 2, 0.2, 2, 0)],
                                    "asset_id long, first_idx long, last_idx long, n_words int, distance double, entry_ord int, form_ord int")
    assert rows(select_suggestions(matches), "first_idx") == [(0,), (21,)]


def test_measured_sources_do_not_hide_large_frames(spark):
    """A scan relies on the measured source only if it stays far below its own limit."""
    df = spark.range(100).selectExpr("1L AS k", "id AS t")
    with scan.sized_for((df, ["k"])):
        assert not scan.is_hot(df, ["k"], 100 * scan.FAN_OUT)
        assert scan.is_hot(df, ["k"], 99)
        assert not scan.is_hot(df, ["k"], 100)


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_words_are_dealt_by_document_before_they_are_exploded(spark, tmp_path):
    from cuelattice.kernel.scan import dealt, sized_for
    from cuelattice.plans import tables

    spark.createDataFrame([(k, "one two three four") for k in range(9)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    documents = spark.read.parquet(f"{tmp_path}/documents.parquet")
    assert dealt(documents, ["doc_id"]) is documents
    with sized_for((documents, ["doc_id"], F.expr("size(split(text, ' '))"))):
        words = tables.words(spark, str(tmp_path))
        counted = running(words, ["asset_id"], ["word_idx"], [Running("n", "count", F.lit(1))], F.lit(0))
    plan = _plan(counted)
    assert plan.count("Exchange") == 1 and plan.index("Generate") < plan.index("Exchange")
    assert sorted(r[0] for r in counted.groupBy("asset_id").agg(F.max("n")).select("max(n)").collect()) == [4] * 9
    with sized_for((documents, ["doc_id"], F.lit(1_000_000))):
        assert dealt(documents, ["doc_id"]) is documents


def test_range_sums_of_dealt_points_and_windows_shuffle_nothing(spark):
    points = spark.createDataFrame([("a", 5, 1), ("a", 5, 2), ("a", 9, 4), ("b", 5, 8)], "k string, t long, v long").repartition(3, "k")
    windows = spark.createDataFrame([("a", 5, 9), ("a", 6, 9), ("b", 0, 4)], "k string, start_ms long, end_ms long").repartition(3, "k")
    with hot_keys(False):
        sums = range_sums(windows, points, ["k"], "t", {"c": ("v", "closed"), "b": ("v", "before_end")})
    assert _plan(sums).count("Exchange") == 2
    assert rows(sums, "k", "start_ms", "c", "b") == [("a", 5, 7, 3), ("a", 6, 4, 3), ("b", 0, 0, 0)]


def test_dealt_tables_join_on_more_than_their_key_without_a_shuffle(spark):
    data = [(i % 20, i, i % 7) for i in range(400)]
    df = spark.createDataFrame(data, "k long, t long, v long")
    with scan.sized_for((df, ["k"])), pytest.MonkeyPatch.context() as patched:
        left, right = scan.dealt(df, ["k"]), scan.dealt(df.withColumnRenamed("v", "w"), ["k"])
        patched.setattr(spark.conf, "set", lambda *a: None)
        joined = left.hint("merge").join(right, ["k", "t"])
        plan = joined._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning") == 2 and "ENSURE_REQUIREMENTS" not in plan
        assert rows(joined, "k", "t", "v", "w") == sorted((k, t, v, v) for k, t, v in data)


def test_a_fold_of_scanned_rows_stays_in_their_task(spark):
    data, df = series(spark)

    def step(state, row):
        total = (state or 0) + row[0]
        return total, [(row[0], total)]

    fields = [T.StructField("v", T.LongType()), T.StructField("total", T.LongType())]
    with hot_keys(False):
        seen = running(df, ["k"], ["t", "i"], [Running("g", "max", F.floor(F.col("t") / 5_000))], time_chunk("t"))
        here = ordered_fold(seen, ["k", "g"], ["t", "i"], ["v"], step, fields, in_place=True)
        moved = ordered_fold(seen, ["k", "g"], ["t", "i"], ["v"], step, fields)
    assert rows(here, "k", "g", "v", "total") == rows(moved, "k", "g", "v", "total")
    assert "REPARTITION" not in here._jdf.queryExecution().executedPlan().toString()
    assert "REPARTITION" in moved._jdf.queryExecution().executedPlan().toString()
