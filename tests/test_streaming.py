"""A drained stream gives what the batch form gives."""

import numpy as np
import pandas as pd
from conftest import rows
from pyspark.sql import functions as F

from cuelattice.operators import library as B
from cuelattice.operators import series as S
from cuelattice.streaming import jobs as J
from cuelattice.streaming import ordered
from cuelattice.streaming.drain import drain


def replay(spark, df, folder, parts=3):
    """Write in time order as several files and read them one per trigger."""
    path = str(folder)
    for i in range(parts):
        df.where(F.col("part") == i).drop("part").coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(df.drop("part").schema).option("maxFilesPerTrigger", 1).parquet(path)


def test_bucket_peaks(spark, tmp_path):
    df = spark.range(600).selectExpr("id % 2 AS asset_id", "id * 100 AS at_ms", "CAST((id * 37) % 60 AS DOUBLE) AS loudness_db", "CAST(id DIV 200 AS INT) AS part")
    got = rows(drain(J.bucket_peaks_stream(replay(spark, df, tmp_path)), spark), "asset_id", "at_ms", "loudness_db")
    want = [r for r in rows(S.bucket_peaks(df), "asset_id", "at_ms", "loudness_db") if (r[1] // 250 + 1) * 250 <= 59_900 - 10_000]
    assert got == want


def test_speech_segments(spark, tmp_path):
    speech = "CASE WHEN id % 60 < 25 THEN 0.9D WHEN id % 60 = 30 THEN 0.4D ELSE 0.1D END"
    df = spark.range(400).selectExpr("1L AS asset_id", "id * 32 AS at_ms", "(id + 1) * 32 AS end_ms", f"{speech} AS speech_probability", "CAST(id DIV 150 AS INT) AS part")
    got = rows(drain(J.speech_segments_stream(replay(spark, df, tmp_path)), spark), "start_ms", "end_ms")
    batch = rows(S.speech_segments(df.drop("part")), "start_ms", "end_ms")
    padded = [(max(0, s - S.PAD_MS), e + S.PAD_MS) for s, e in got]
    assert padded == batch[: len(padded)] and len(padded) >= len(batch) - 1


def test_a_key_with_more_rows_than_a_batch_holds(spark, tmp_path):
    """One asset, Arrow batches of 100 rows, files out of order inside the lateness: the fold still sees time order."""
    speech = "CASE WHEN id % 60 < 25 THEN 0.9D WHEN id % 60 = 30 THEN 0.4D ELSE 0.1D END"
    df = spark.range(3000).selectExpr("1L AS asset_id", "id * 32 AS at_ms", "(id + 1) * 32 AS end_ms", f"{speech} AS speech_probability", "CAST(id DIV 1000 AS INT) AS part")
    late = df.withColumn("part", F.expr("CASE WHEN at_ms % 5 = 0 AND part < 2 THEN part + 1 ELSE part END"))
    end = spark.sql("SELECT 9L AS asset_id, 9000000L AS at_ms, 9000032L AS end_ms, 0.0D AS speech_probability, 3 AS part")
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, "100")
    try:
        stream = J.speech_segments_stream(replay(spark, late.unionByName(end), tmp_path, 4), "60 seconds", 1_000, 3_200, wait=True)
        got = rows(drain(stream, spark).where("asset_id = 1"), "start_ms", "end_ms")
    finally:
        spark.conf.set(name, before)
    batch = rows(S.speech_segments(df.drop("part")), "start_ms", "end_ms")
    assert len(got) == len(batch) > 40
    # The last span ends with the asset, where padding can't go further.
    assert [(max(0, s - S.PAD_MS), min(e + S.PAD_MS, 96_000)) for s, e in got] == batch


def test_smoothing(spark, tmp_path):
    df = spark.range(600).selectExpr(
        "id % 2 AS asset_id", "id * 20 AS time_ms", "0.3D + (id * 17 % 41) / 100.0D AS x", "0.3D + (id * 23 % 41) / 100.0D AS y", "0.2D AS width", "0.3D AS height",
        "(id * 37 % 101) / 100.0D AS confidence", "IF(id % 4 = 0, 'held', 'tracked') AS state", "CAST(id DIV 200 AS INT) AS part")
    end = spark.sql("SELECT 9L AS asset_id, 900000L AS time_ms, 0.5D AS x, 0.5D AS y, 0.2D AS width, 0.3D AS height, 1.0D AS confidence, 'tracked' AS state, 3 AS part")
    stream = J.smoothing_stream(replay(spark, df.unionByName(end), tmp_path, 4), bucket_ms=700)
    got = {(r.asset_id, r.time_ms): (round(r.x, 9), round(r.y, 9)) for r in drain(stream, spark).where("asset_id < 9").collect()}
    held = {}
    for r in df.collect():
        held.setdefault(r.asset_id, []).append(r)
    want = {}
    for asset, own in held.items():
        for c in own:
            near = [n for n in own if abs(n.time_ms - c.time_ms) <= 280]
            weights = np.array([np.exp(-abs(n.time_ms - c.time_ms) / 280) * (max(0.2, n.confidence) if n.state == "tracked" else 0.15) for n in near])
            x, y = (J.robust_mean(np.array([n[f] for n in near]), weights, J.TOLERANCES[f]) for f in ("x", "y"))
            want[asset, c.time_ms] = (round(min(0.9, max(0.1, x)), 9), round(min(0.85, max(0.15, y)), 9))
    assert got == want


def test_revisions(spark, tmp_path):
    df = spark.range(60).selectExpr("id % 4 AS project_id", "id AS attempt_no", "IF(id % 7 = 0, NULL, concat('c', (id + 2) % 5)) AS base_checksum", "concat('C', id % 5) AS checksum", "CAST(id DIV 25 AS INT) AS part")
    got = rows(drain(J.accept_revisions_stream(replay(spark, df, tmp_path)), spark), "project_id", "attempt_no", "accepted")
    assert got == rows(B.accept_revisions(df.drop("part")), "project_id", "attempt_no", "accepted")


def test_debounced_writes(spark, tmp_path):
    df = spark.range(80).selectExpr("1L AS project_id", "id * 400 + IF(id % 13 = 0, 0, 100) + (id DIV 20) * 9000 AS at_ms", "id AS revision", "CAST(id DIV 30 AS INT) AS part")
    got = rows(drain(J.debounced_writes_stream(replay(spark, df, tmp_path)), spark), "written_at_ms", "revision")
    batch = rows(B.debounce_writes(df.drop("part")), "written_at_ms", "revision")
    assert got == batch[: len(got)] and len(got) >= len(batch) - 1


def test_job_progress(spark, tmp_path):
    line = "CASE id % 4 WHEN 0 THEN concat('frame=', id) WHEN 1 THEN concat('out_time_us=', id * 1000) WHEN 2 THEN 'speed=2x' ELSE 'progress=continue' END"
    df = spark.range(48).selectExpr("1L AS job_id", "id AS seq", f"{line} AS line", "CAST(id DIV 17 AS INT) AS part")
    got = rows(drain(J.job_progress_stream(replay(spark, df, tmp_path)), spark), "seq", "encoded_ms", "frame", "speed")
    assert got == [(s, s - 2, s - 3, 2.0) for s in range(3, 48, 4)]


def test_events_come_one_batch_a_slice_however_many_files(spark, tmp_path):
    from pyspark.sql import functions as F

    from cuelattice.plans.stream_queries import SLICES, _events

    events = spark.range(600).selectExpr(
        "id AS event_id", "CAST(timestamp_seconds(id * 3600) AS TIMESTAMP_NTZ) AS ts", "id % 7 AS user_id", "'a' AS event_type", "id * 1.0D AS value", "'' AS props")
    # Three files split by time, so that most slices touch one of them only.
    events.repartitionByRange(3, "event_id").write.parquet(f"{tmp_path}/events.parquet")
    batches = []
    query = _events(spark, str(tmp_path)).writeStream.foreachBatch(
        lambda df, _: batches.append(df.agg(F.count("*"), F.min("ms"), F.max("ms")).first())).trigger(availableNow=True).option(
        "checkpointLocation", f"{tmp_path}/state").start()
    query.awaitTermination()
    assert len(batches) == SLICES + 1
    assert sum(b[0] for b in batches) == 601
    assert all(a[2] < b[1] for a, b in zip(batches, batches[1:], strict=False))


class _Handle:
    """State of one key that counts the calls made to it."""

    def __init__(self):
        self.calls, self.maps, self.values, self.timers = 0, {}, {}, []

    def getMapState(self, name, *_):  # noqa: N802
        return _State(self, self.maps)

    def getValueState(self, name, _):  # noqa: N802
        return _State(self, self.values, name)

    def registerTimer(self, at):  # noqa: N802
        self.calls += 1
        self.timers.append(at)


class _State:
    def __init__(self, handle, held, name=None):
        self.handle, self.held, self.name = handle, held, name

    def _call(self, result=None):
        self.handle.calls += 1
        return result

    def get(self):
        return self._call(self.held.get(self.name))

    def update(self, value):
        self._call(self.held.update({self.name: value}))

    def clear(self):
        self._call(self.held.pop(self.name, None))

    def exists(self):
        return self._call(self.name in self.held)

    def keys(self):
        return self._call(list(self.held))

    def getValue(self, key):  # noqa: N802
        return self._call(self.held.get(key))

    def updateValue(self, key, value):  # noqa: N802
        self._call(self.held.update({key: value}))

    def removeKey(self, key):  # noqa: N802
        self._call(self.held.pop(key))


class _Clock:
    def __init__(self, now):
        self.now = now

    def getCurrentWatermarkInMs(self):  # noqa: N802
        return self.now

    def getExpiryTimeInMs(self):  # noqa: N802
        return self.now


def _sums(n, order, page, monkeypatch):
    """Running sums of n rows an hour apart, delivered in two calls in the given order and closed in two steps."""
    monkeypatch.setattr(ordered, "PAGE_ROWS", page)

    def step(rows, state, _):
        total, out = state[0] if state else 0, []
        for at, value in rows:
            total += value
            out.append((at, total))
        return out, (total, at)

    fold = ordered.Fold({"at": "bigint", "value": "bigint"}, "total long, at long", step, lambda state: state[1] + 4_000_000, lambda state: [(-1, state[0])])
    handle, processor = _Handle(), ordered._Ordered(fold, 60_000, True, ["key", "at", "total"])
    processor.init(handle)
    frame = pd.DataFrame({"at": [float(i * 3_600_000) for i in order], "value": order}).astype({"at": "int64"})
    frame.loc[len(frame)] = [None, 5]
    got = []
    for part in (frame.iloc[: n // 2], frame.iloc[n // 2 :]):
        got += list(processor.handleInputRows((1,), iter([part]), _Clock(0)))
    for now in (n // 3 * 3_600_000 + 60_000, n * 3_600_000 + 400_000):
        got += list(processor.handleExpiredTimer((1,), _Clock(now), _Clock(now)))
    return [tuple(int(v) for v in row[1:]) for f in got for row in f.itertuples(index=False)], handle


def test_calls_to_the_state_of_a_small_key_do_not_grow_with_its_buckets(monkeypatch):
    n = 200
    order = [(i * 77) % n for i in range(n)]
    want = [(i * 3_600_000, i * (i + 1) // 2) for i in range(n)] + [(-1, n * (n - 1) // 2)]
    got, handle = _sums(n, order, 4096, monkeypatch)
    assert got == want and handle.calls < 30 and not handle.maps and not handle.values
    # Beyond a page rows go to the buckets of the map state, with the same result.
    spilled, many = _sums(n, order, 30, monkeypatch)
    assert spilled == want and many.calls > n and not many.maps and not many.values
