"""Spark-native analytics over the tables that media pipelines leave behind."""

from mediaops.session import build_session

__all__ = ["build_session"]
