"""Spark-native news-sentiment analytics: feeds, scoring, tables and reports."""

from newsignal.model import News

__all__ = ["News"]
