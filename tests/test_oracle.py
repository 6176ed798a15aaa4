"""A cross-section of the registered queries against their comparison SQL (``compare.py`` runs them all)."""

import pytest

import __spark_entry__ as entry
import compare

PATH = "/root/testdata/sf0.001"
SOME = ["union_bridged", "subtract_words_from_turns", "exclusive_turns", "activity_strip", "candidate_windows", "rolling_load", "own_words", "repeated_phrases",
        "line_slots", "fit_lines", "speech_metrics", "plan_stats", "online_pace", "take_pauses", "scene_cut", "brief_parts", "pick_tier", "talk_stats",
        "match_ids", "count_aksharas", "normalize_numbers", "media_refs", "reconcile", "script_problems", "order_tiers", "check_verdicts", "call_usage",
        "time_left", "retention", "shape_cues", "stream_usage_windows", "stream_current_lines"]


@pytest.fixture(scope="module")
def con():
    return compare.connect(PATH)


@pytest.mark.parametrize("name", SOME)
def test_agrees(spark, con, name):
    assert compare.check(spark, con, name, PATH) == ""


def test_registry():
    q, o = entry.queries(), entry.oracle_sql()
    assert set(o) <= set(q) and len(q) > 170
    numbered = [n[2:].split("_")[0] for n in q if n.startswith("op") and n[2:3].isdigit()]
    assert len(numbered) == len(set(numbered))  # one query for each training-data operator, none where they are not installed


def test_entry(spark):
    df = entry.entry(spark)
    assert "silent_s_per_min" in df.columns and df.count() > 0
