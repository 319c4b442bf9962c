"""Structured Streaming jobs over the same operators as the batch jobs."""

from .answers import first_verdict_stream
from .features import feature_stream, load_dictionary, refreshing_features, save_dictionary
from .history import feed_in_order, slice_parts, time_slices
from .sinks import append_stream, foreach_batch_stream, upsert_stream
from .spend import current_spend, spend_stream, spend_table
from .verdicts import promoted_verdict_batches, verdict_batches, verdict_stream, verdict_within_stream

__all__ = [
    "append_stream", "current_spend", "feature_stream", "feed_in_order", "first_verdict_stream", "foreach_batch_stream", "load_dictionary", "promoted_verdict_batches",
    "refreshing_features", "save_dictionary", "slice_parts", "spend_stream", "spend_table", "time_slices", "upsert_stream", "verdict_batches",
    "verdict_stream", "verdict_within_stream",
]
