"""Tables and streams read, tables written."""

from clicktrail.sources.sinks import append_sink, overwrite_table, replace_parts
from clicktrail.sources.streams import file_lines, topic_lines
from clicktrail.sources.tables import read_files, read_table

__all__ = [
    "append_sink", "file_lines", "overwrite_table", "read_files", "read_table", "replace_parts",
    "topic_lines",
]
