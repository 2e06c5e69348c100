"""Frame scores against a plain loop, in one stream and in sections; range reads of media files."""

import hashlib
import os

import numpy as np
import pytest

from cuelattice.operators import scoring as M
from cuelattice.operators.library import SAMPLE_BYTES
from cuelattice.sources import media_ranges as R

TABLE = (0.0, 0.9, 0.1, 0.7, 0.3, 1.0, 0.2, 0.6)


def plain(samples):
    """(frame, count, score) of the tabled model over one asset."""
    padded, state, out = np.concatenate((np.zeros(M.CONTEXT, np.float32), np.clip(samples, -1, 1))), 0.0, []
    for frame in range(-(-len(samples) // M.FRAME)):
        window = padded[frame * M.FRAME : frame * M.FRAME + M.CONTEXT + M.FRAME]
        state = 0.5 * state + 0.5 * TABLE[min(len(TABLE) - 1, int(np.abs(window).max() * len(TABLE)))]
        out.append((frame, min(M.FRAME, len(samples) - frame * M.FRAME), round(state, 9)))
    return out


@pytest.fixture(scope="module")
def audio():
    rng = np.random.default_rng(8)
    sizes = {1: 512 * 300 + 17, 2: 512 * 64, 3: 511, 4: 1, 5: 512 * 3}
    return {k: (rng.normal(0, 0.3, n) * (1 + np.sin(np.arange(n) / 900))).astype(np.float32) for k, n in sizes.items()}


@pytest.fixture(scope="module")
def pcm(spark, audio):
    rng, rows = np.random.default_rng(2), [(6, 0, []), (6, 1, None)]
    for asset, samples in audio.items():
        cuts = np.sort(rng.integers(0, len(samples) + 1, 40)) if len(samples) > 100 else []
        rows += [(asset, no, part.tolist()) for no, part in enumerate(np.split(samples, cuts))]
    return spark.createDataFrame(rows, "asset_id long, chunk_no long, samples array<float>").repartition(5)


@pytest.mark.parametrize("section", [None, 64, 7])
def test_scores_are_those_of_a_loop(spark, pcm, audio, section):
    model = M.frame_model(spark, np.array(TABLE, dtype="<f8").tobytes(), M.PeakTable.build)
    found = {}
    for r in M.score_frames(pcm, model, section, warm_up=40).collect():
        found.setdefault(r.asset_id, []).append((r.frame_idx, r.sample_count, round(r.probability, 9)))
        assert r.at_ms == r.frame_idx * 32
    assert {k: sorted(v) for k, v in found.items()} == {k: plain(v) for k, v in audio.items()}


def test_bad_samples_models_and_empty_tables(spark, pcm):
    model = M.frame_model(spark, np.array(TABLE, dtype="<f8").tobytes(), M.PeakTable.build)
    assert M.score_frames(pcm.limit(0), model).count() == 0
    with pytest.raises(Exception, match="not finite"):
        M.score_frames(spark.createDataFrame([(1, 0, [0.0, float("nan")])], "asset_id long, chunk_no long, samples array<float>"), model).count()
    with pytest.raises(ValueError, match="too many"):
        M.frame_model(spark, b"12345", M.PeakTable.build, most_bytes=4)


def test_a_worker_builds_a_model_once(spark):
    model = M.frame_model(spark, np.array(TABLE, dtype="<f8").tobytes(), M.PeakTable.build)
    assert model.built() is model.built()


def quick(path, size):
    with open(path, "rb") as file:
        material = file.read(SAMPLE_BYTES)
        if size > SAMPLE_BYTES:
            file.seek(size - SAMPLE_BYTES)
            material += file.read(SAMPLE_BYTES)
    return "sha256:" + hashlib.sha256(material + size.to_bytes(8, "little")).hexdigest()


def test_quick_hashes_of_files_of_any_size(spark, tmp_path):
    sizes = {"empty.mp4": 0, "short.wav": 100, "even.mp4": SAMPLE_BYTES, "over.mov": SAMPLE_BYTES + 1, "sub/long.mkv": 5 << 30}
    (tmp_path / "sub").mkdir()
    for name, size in sizes.items():
        with open(tmp_path / name, "wb") as file:
            file.write(os.urandom(min(size, 200_000)))
            # Of the long file only the ends are written: the file system keeps no blocks between them.
            file.truncate(size)
            if size > 1 << 20:
                file.seek(size - 9)
                file.write(b"the end!!")
    got = {os.path.basename(r.path): r for r in R.quick_hashes(R.media_ranges(spark, str(tmp_path), files_per_partition=2)).collect()}
    assert {k: (r.size_bytes, r.quick_hash, r.error) for k, r in got.items()} == {
        os.path.basename(n): (s, quick(tmp_path / n, s), None) for n, s in sizes.items()}
    assert R.media_ranges(spark, str(tmp_path), files_per_partition=2).rdd.getNumPartitions() == 3
    assert [os.path.basename(r.path) for r in R.media_ranges(spark, str(tmp_path), "*.wav").collect()] == ["short.wav"]


def test_a_file_that_goes_is_a_row_with_an_error(spark, tmp_path):
    (tmp_path / "a.mp4").write_bytes(b"1")
    (tmp_path / "b.mp4").write_bytes(b"2")
    reader = R._RangeReader({"path": f"file://{tmp_path}"})
    groups = reader.partitions()
    os.rename(tmp_path / "b.mp4", tmp_path / "c.mp4")
    rows = [row for group in groups for batch in reader.read(group) for row in batch.to_pylist()]
    assert [(os.path.basename(r["path"]), r["head"], r["error"]) for r in rows] == [("a.mp4", b"1", None), ("b.mp4", None, "missing")]
