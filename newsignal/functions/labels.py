"""Labels from scores and small lookups."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def label_beyond(score: Column, threshold: float) -> Column:
    """positive / negative strictly beyond ±threshold, else neutral."""
    return (
        F.when(score > threshold, "positive").when(score < -threshold, "negative").otherwise("neutral")
    )


def label_from(score: Column, threshold: float) -> Column:
    """positive / negative from ±threshold on (inclusive), else neutral."""
    return (
        F.when(score >= threshold, "positive").when(score <= -threshold, "negative").otherwise("neutral")
    )


def trend(avg: Column, threshold: float = 0.1) -> Column:
    """Capitalised trend of an average."""
    return F.initcap(label_beyond(avg, threshold))


def position_in(value: Column, items: Sequence[str]) -> Column:
    """1-based position of ``value`` in ``items``, 0 if absent."""
    return F.array_position(F.array(*map(F.lit, items)), value)
