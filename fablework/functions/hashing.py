"""Reproducible randomness and content keys.

Random choices are functions of ``(seed, purpose, row key)``. A recomputed task draws the
same numbers, the optimizer may move the expressions freely, and any SQL engine with md5
can repeat them.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def uniform(seed: int, purpose: str, *keys: Column) -> Column:
    """Uniform number in [0, 1) from the first 32 bits of an md5 digest."""
    parts = [F.lit(f"{seed}|{purpose}")]
    for key in keys:
        parts += [F.lit("|"), key.cast("string")]
    digest = F.substring(F.md5(F.concat(*parts)), 1, 8)
    return F.conv(digest, 16, 10).cast("double") / F.lit(4294967296.0)


def cache_id(model: Column, prompt: Column) -> Column:
    """Key of a scored prompt: md5 of model name and prompt."""
    return F.md5(F.concat(model, prompt))
