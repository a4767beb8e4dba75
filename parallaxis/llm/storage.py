"""Shared storage, as the rest of the library has it."""

from parallaxis.storage import arrow_rows, contents, create, drop, exists, file_system, fresh, listed, make_dir, materialize, remove, rename, scratch, shared_dir, table

__all__ = ["arrow_rows", "contents", "create", "drop", "exists", "file_system", "fresh", "listed", "make_dir", "materialize", "remove", "rename", "scratch", "shared_dir", "table"]
