"""Registered queries, by group."""

from . import basics, documents, files, functions, joined, matching, messages, reports, states, streams  # noqa: F401
