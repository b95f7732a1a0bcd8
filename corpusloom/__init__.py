"""Spark-native operators for text corpora, retrieval, conversations, graphs and evaluation logs."""

from corpusloom.session import Scratch, build_session, table

__all__ = ["Scratch", "build_session", "table"]
