"""Stream and batch analytics operators on Spark DataFrames."""

from rillcask.session import get_session, shared_dir

__all__ = ["get_session", "shared_dir"]
