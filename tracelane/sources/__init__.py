"""Readers and writers for the experiment's files."""

from tracelane.sources.files import (
    classify_files,
    file_catalogue,
    read_durations,
    read_events,
    read_lists,
    read_named_csv,
    read_questionnaire,
    read_roster,
    read_table,
    write_design,
    write_table,
)

__all__ = [
    "classify_files",
    "file_catalogue",
    "read_durations",
    "read_events",
    "read_lists",
    "read_named_csv",
    "read_questionnaire",
    "read_roster",
    "read_table",
    "write_design",
    "write_table",
]
