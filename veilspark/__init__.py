"""Policy-driven sanitizing of tables, text and streams on Spark."""

from .jobs import DuplicateJob, Stores, import_file, import_table, open_tokens
from .keys import ProjectKey
from .operators.detection import column_findings, residual_scan
from .operators.inference import combined_policy, infer_policies, infer_policy, union_tables
from .operators.profile import profile_columns, profile_tables, value_frequencies
from .operators.report import ExportBlocked, ReviewOverride
from .operators.sanitize import (
    sanitize_records,
    sanitize_table,
    sanitize_tables,
    sanitize_text,
)
from .operators.text_scan import EntityDetector
from .operators.vault import purge_expired
from .policy import Policy, Recognizer
from .sinks.release import read_release, release_tables, releases
from .sinks.writers import write_safe
from .sources.preview import preview_file, preview_table
from .sources.readers import load_any, load_tables
from .streaming.stream import StreamPaths, release_stream, safe_stream, sanitize_stream

__all__ = [
    "DuplicateJob",
    "EntityDetector",
    "ExportBlocked",
    "Policy",
    "ProjectKey",
    "Recognizer",
    "ReviewOverride",
    "Stores",
    "StreamPaths",
    "column_findings",
    "combined_policy",
    "import_file",
    "import_table",
    "infer_policies",
    "infer_policy",
    "load_any",
    "load_tables",
    "open_tokens",
    "preview_file",
    "preview_table",
    "profile_columns",
    "profile_tables",
    "purge_expired",
    "read_release",
    "release_stream",
    "release_tables",
    "releases",
    "residual_scan",
    "safe_stream",
    "sanitize_records",
    "sanitize_stream",
    "sanitize_table",
    "sanitize_tables",
    "sanitize_text",
    "union_tables",
    "value_frequencies",
    "write_safe",
]
