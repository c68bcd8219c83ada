"""Readers and writers."""

from toxiscope.sources.tables import (  # noqa: F401
    TABLES, read_table, label_join, read_comments, labelled_comments,
)
