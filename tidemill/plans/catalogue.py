"""Registers all queries."""

from . import analytics, answers, desk, dialogs, ingest, moderation, retrieval, streams, suggest, texts  # noqa: F401
