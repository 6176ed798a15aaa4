"""All registered queries."""

from __future__ import annotations

from . import interval_queries, lint_queries, ops_queries, reply_queries, scene_queries, segment_queries, speaker_queries, stream_queries, text_queries, timing_queries, transcript_queries  # noqa: F401
from .registry import ORACLES, QUERIES

FLAGSHIP = "speech_metrics"

__all__ = ["FLAGSHIP", "ORACLES", "QUERIES"]
