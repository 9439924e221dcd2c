"""Clinical-document analytics as Spark DataFrame transforms."""

from chartloom.session import build_session, prepare, shared_dir

__all__ = ["build_session", "prepare", "shared_dir"]
