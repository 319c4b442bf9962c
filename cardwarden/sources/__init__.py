"""Reading and writing collections, tables, change feeds and messages."""

from .change_tables import apply_changes, change_table, documents_of
from .changes import changes_for, unwrap_changes
from .commits import CommitLog
from .indexed import IndexedTable
from .merged import MergedTable, add_up, keep_latest
from .messages import from_messages, to_messages
from .quarantine import message_sink, read_broken, read_good, split_messages
from .tables import (
    load_new_files,
    new_only,
    read_source,
    read_table,
    write_collection,
    write_feature_table,
    write_table,
)
from .upserts import append_batch, compact, read_batches, read_latest, replace_all, upsert_sink, vacuum

__all__ = [
    "CommitLog", "IndexedTable", "MergedTable", "message_sink", "read_broken", "read_good", "split_messages", "add_up", "apply_changes", "change_table", "documents_of", "keep_latest",
    "append_batch", "changes_for", "compact", "from_messages", "load_new_files", "new_only",
    "read_batches", "read_latest", "read_source", "read_table", "replace_all", "to_messages", "unwrap_changes",
    "upsert_sink", "vacuum", "write_collection", "write_feature_table", "write_table",
]
