from .catalog import (budget_prefix, first_seen_dedupe, fresh_candidates, pick_rendition,
                      pool_coverage, pool_filter, pool_from_clips, rank_candidates,
                      shortfall_report, source_fallback, stranded_rows, union_sources)
from .enrich import PermanentError, cached_enrich, progress_stats
from .intervals import boundary_snap, overlap_clip, tiling_check
from .merging import carry_status, check_allowed, demote_stale, merge_records, patch_fields
from .planning import assign_round_robin, plan_segments
from .quality import (conservation_check, contract_violations, duration_check, final_problems, job_problems,
                      job_report, job_totals, not_built, segment_problems)
from .running import blocks_of, running_before
from .scenes import plan_scenes
from .segmentation import (join_scripts, min_text_filter, plan_budget, sentences, split_oversize, split_stories, split_stories_blocks,
                           story_words, units)
from .shapes import clean_suffix_start, sample_times, shape_classify
from .state import job_board, progress, resume_filter, status_counts
from .timeline import card_events, job_summary, timeline_chunks

__all__ = [n for n in dir() if not n.startswith("_")]
