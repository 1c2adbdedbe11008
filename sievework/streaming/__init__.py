"""Incremental audits with Structured Streaming."""

from .incremental import audit_so_far, audit_stream, latest_facts, latest_files

__all__ = ["audit_so_far", "audit_stream", "latest_facts", "latest_files"]
