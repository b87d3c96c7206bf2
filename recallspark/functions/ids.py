"""Names and content ids."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def slug(name: Column) -> Column:
    """An entity's id: trimmed, lower case, blanks to underscores, no apostrophes."""
    return F.translate(F.lower(F.trim(name)), " '", "_")


def content_id(prefix: str, length: int, *parts: Column) -> Column:
    """prefix and the first hex digits of a SHA-256 over parts, parted by the unit separator; null parts count as empty."""
    return F.concat(F.lit(prefix), F.substring(F.sha2(F.concat_ws(chr(31), *(F.coalesce(p.cast("string"), F.lit("")) for p in parts)), 256), 1, length))


def similarity(distance: Column, metric: str) -> Column:
    """Similarity (0 to 1) of a distance under cosine, l2 or ip."""
    return {"cosine": F.greatest(1 - distance, F.lit(0.0)), "l2": 1 / (1 + distance), "ip": F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - distance))}[metric]
