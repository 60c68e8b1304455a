"""Written intermediate tables of the corpus operators: those of the rest of the library."""

from __future__ import annotations

from linkloom.sources.shared import Tables, drop, new_path, scratch, shared_dir

__all__ = ["Tables", "drop", "new_path", "scratch", "shared_dir"]
