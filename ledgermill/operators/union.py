"""Stacking frames of the same columns."""

from __future__ import annotations

from pyspark.sql import DataFrame


def union_all(*frames: DataFrame) -> DataFrame:
    """Unions by name, pairing halves so that no frame is analyzed many times over."""
    if len(frames) == 1:
        return frames[0]
    half = len(frames) // 2
    return union_all(*frames[:half]).unionByName(union_all(*frames[half:]))
