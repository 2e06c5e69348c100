"""Registered queries give the same rows when every key counts as huge."""

import pytest

from cuelattice.kernel.scan import hot_keys
from cuelattice.plans import load_all
from cuelattice.plans.registry import QUERIES

load_all()
SF = "/root/testdata/sf0.001"
NAMES = ["win_01_merge_intervals", "win_03_hysteresis_segments", "win_12_gain_envelope", "win_13_simplify_envelope", "win_23_face_clusters", "edt_14_smart_beat_cuts", "top_02_distance_suppression", "agg_13_interval_coverage",
         "win_05_near_duplicate_merge", "win_07_cue_building", "win_08_edit_suggestions", "win_16_ducking_envelope", "win_19_robust_smoothing", "win_28_lane_packing", "win_29_spoken_only",
         "edt_11_delete_ranges", "join_03_active_at_time", "agg_04_waveform_peaks"]


def plain(df):
    return sorted(str(tuple(round(x, 6) if isinstance(x, float) else x for x in r)) for r in df.select(*sorted(df.columns)).collect())


@pytest.mark.parametrize("name", NAMES)
def test_split_plan_gives_the_same_rows(spark, name):
    wanted = plain(QUERIES[name](spark, SF))
    with hot_keys(True):
        assert plain(QUERIES[name](spark, SF)) == wanted
