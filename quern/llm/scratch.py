"""Shared working folders: what an operator cuts its lineage with."""

from quern.sources.shared import drop, new_path, parts_for, shared_folder, stored, stored_at

__all__ = ["drop", "new_path", "parts_for", "shared_folder", "stored", "stored_at"]
