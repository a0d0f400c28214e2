"""The checked queries over the shared test tables."""
from . import catalogs, states, texts, timelines  # noqa: F401
from .base import ORACLES, QUERIES

# Columns whose SQL type differs from Spark's for the same value.
_SQL_TYPES = {
    "INTEGER": {
        "cached_enrich": ["sent_idx"], "word_count": ["words"], "split_stories": ["story_idx", "n_paragraphs"],
        "sentences": ["sent_idx"], "sentences_conversations": ["sent_idx"],
        "split_oversize": ["sent_idx", "part_idx"], "caption_cards": ["sent_idx", "card_idx"],
        "units": ["sent_idx"], "units_documents": ["sent_idx"], "timeline_chunks": ["sent_idx"],
        "card_events": ["grp"], "union_sources": ["n"], "job_stories": ["story_idx", "n_paragraphs"],
        "split_stories_blocks": ["story_idx", "n_paragraphs"],
        "stream_tail": ["line_no"],
    },
    "BIGINT": {
        "read_provider_hits": ["size_bytes"], "read_provider_hits_array": ["bitrate"], "read_job_state": ["idx"],
        "plan_segments": ["idx"], "plan_segments_long_jobs": ["idx"], "boundary_snap": ["idx"],
        "overlap_clip": ["seg_idx"], "write_captions": ["seg_idx"], "tiling_check": ["idx"],
        "plan_scenes_invariants": ["idx"], "plan_scenes": ["idx"], "assign_round_robin": ["idx"],
    },
    "DOUBLE": {"read_catalog": ["norm_duration_s"], "pool_coverage": ["needed_s"], "progress_stats": ["eta_s"]},
}
for _type, _queries in _SQL_TYPES.items():
    for _name, _columns in _queries.items():
        _casts = ", ".join(f"CAST({c} AS {_type}) AS {c}" for c in _columns)
        ORACLES[_name] = f"SELECT * REPLACE ({_casts}) FROM ({ORACLES[_name]}) AS result"
