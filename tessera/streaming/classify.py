"""Range classification of a stream of keys: the ranges are fixed, so each row is looked up on its own, without state."""

from __future__ import annotations

from pyspark.sql import DataFrame

from tessera.operators import ranges


def classify_stream(keys: DataFrame, fixed: DataFrame, strict: bool = False) -> DataFrame:
    """pos, key, range_id of a streaming (pos, key); the ranges must fit the driver."""
    if not keys.isStreaming:
        raise ValueError("keys are no stream; use operators.ranges.classify")
    if fixed.count() > ranges.MAX_LOCAL:
        raise ValueError("too many ranges for a stream without state")
    return ranges.classify(keys, fixed, strict)
