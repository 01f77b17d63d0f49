"""Values computed from a row alone: sound loss over a distance, and ids from natural keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def cylindrical_loss(metres: Column, absorption: float = 0.0015) -> Column:
    """Loss in decibels of sound that spreads in shallow water; 0 at no distance or less, null for null."""
    return F.when(metres > 0, 10 * F.log10(metres) + absorption * metres).when(metres.isNotNull(), 0.0)


def expected_similarity(metres: Column, absorption: float = 0.0015) -> Column:
    """1 at the source, falling with the loss."""
    return 1 / (1 + cylindrical_loss(metres, absorption) / 10)


def natural_id(*keys: Column) -> Column:
    """SHA-256 in hex of a natural key: each part behind its length, so that no two keys run together; null is not empty."""
    part = lambda c: F.coalesce(F.concat(F.length(c.cast("string")).cast("string"), F.lit(":"), c.cast("string")), F.lit("-"))
    return F.sha2(F.concat_ws(",", *map(part, keys)), 256)
