"""Registered queries against their SQL, in the plain plan and with every clip cut into time blocks.

CLIPWEAVE_FULL=1 runs all of them; the default is a spread of the ones that depend on order."""

import os
import sys

import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))
import check  # noqa: E402

import __spark_entry__ as entry  # noqa: E402

SF = "/root/testdata/sf0.001"
SPREAD = [
    "run_length_merge", "derive_track", "direction_summary", "deoverlap", "bridge_gaps", "absorb_slivers", "thin_times",
    "segments_from_cuts", "interior_boundaries", "span_frames", "identity_at_time", "smooth_signal", "signal_gradient", "merge_bursts",
    "densest_window", "robust_frames", "build_track", "track_cuts", "fuzzy_merge", "comb_segments", "consensus", "decimate", "linspace_pick",
    "greedy_match", "pick_place_balance", "duration_outliers", "seam_jobs", "timeline_with_findings", "add_missing_events", "sequence_review",
]
NAMES = list(entry.queries()) if os.environ.get("CLIPWEAVE_FULL") else SPREAD


@pytest.fixture(scope="module")
def con():
    return check.duck(SF)


@pytest.mark.parametrize("name", NAMES)
@pytest.mark.parametrize("width", [None, "432000000000"])
def test_query(spark, con, name, width):
    if width:
        spark.conf.set("spark.clipweave.blockWidth", width)
    try:
        ok, msg, _ = check.compare(spark, con, SF, entry.queries()[name], entry.oracle_sql().get(name))
    finally:
        spark.conf.unset("spark.clipweave.blockWidth")
    assert ok, msg


@pytest.mark.parametrize("name", ["clean_timeline", "duration_outliers"])
def test_some_clips_in_blocks(spark, con, name):
    """Every second clip in time blocks, the others plainly."""
    spark.conf.set("spark.clipweave.blockWidth", "432000000000")
    spark.conf.set("spark.clipweave.hotEvery", "2")
    try:
        ok, msg, _ = check.compare(spark, con, SF, entry.queries()[name], entry.oracle_sql()[name])
    finally:
        spark.conf.unset("spark.clipweave.blockWidth")
        spark.conf.unset("spark.clipweave.hotEvery")
    assert ok, msg


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_shuffle_width_does_not_change_results(spark):
    got = []
    for n in ("3", "7"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        got.append(sorted(map(repr, entry.queries()["build_track"](spark, SF).collect())))
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert got[0] == got[1]
