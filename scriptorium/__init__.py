"""Corpus and retrieval analytics on Spark DataFrames."""

from scriptorium.session import build_session, checkpoint_root

__all__ = ["build_session", "checkpoint_root"]
