"""Chat analytics on Spark: parse exports, count activity, find actions, search messages."""

from .operators.actions import (
    actionable,
    dashboard,
    dedup_summary,
    deduplicate_actions,
    filter_actions,
    sections,
    summary,
)
from .operators.candidates import create_batches, filter_candidates, prompt_blocks, score_messages
from .operators.context import (
    action_source,
    attach_context,
    attach_context_text,
    context_for,
    context_text_for,
    store_messages,
)
from .operators.embed import FunctionEncoder, HashingEncoder
from .operators.extract import analyze_candidates, extract_rules, extract_with, parse_extractions
from .operators.search import build_index, grounded_answer, rank_hits, rank_hits_each, search
from .operators.stats import (
    activity_heatmap,
    activity_heatmap_wide,
    busy_users,
    daily_timeline,
    fetch_stats,
    filter_user,
    month_activity,
    monthly_timeline,
    participants,
    stats_rollup,
    user_percent,
    week_activity,
)
from .operators.validate import in_date_order, number_by_date, validate_results
from .operators.vector_index import cluster_index, nearest_each
from .operators.words import clean_corpus, emoji_counts, emoji_share, top_words, word_weights
from .plans.chat import analyze_chat, answer, ask
from .sources.exports import export_rejects, parse_pieces, parse_texts, read_exports
from .sources.results import read_results_csv, read_results_csv_split, write_results_csv
from .sources.stopwords import default_stop_words, read_stop_words

__all__ = [name for name in dir() if not name.startswith("_")]
