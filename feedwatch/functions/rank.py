"""Reproducible pseudo-random ranks: the same id and salt give the same number anywhere."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def seeded_rank(id_col: Column | str, salt: str | int) -> Column:
    """48-bit hash of ``id:salt`` as BIGINT; stands in for an unseeded shuffle."""
    c = F.col(id_col) if isinstance(id_col, str) else id_col
    digest = F.md5(F.concat(c.cast("string"), F.lit(f":{salt}")))
    return F.conv(F.substring(digest, 1, 12), 16, 10).cast("bigint")


def coin(id_col: Column | str, salt: str | int, ratio: float) -> Column:
    """True for about ``ratio`` of the ids (resolution 1/1000)."""
    return F.pmod(seeded_rank(id_col, salt), F.lit(1000)) < F.lit(int(round(ratio * 1000)))
