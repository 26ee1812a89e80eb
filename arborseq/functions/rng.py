"""Stateless uniforms: the same draw for the same (seed, trial, ..., draw) in any plan, partitioning or engine."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def draw_key(*parts) -> Column:
    """The md5 text of the parts joined by '|'; ordering by it is a uniform shuffle."""
    return F.md5(F.concat_ws("|", *[p.cast("string") if isinstance(p, Column) else F.lit(str(p)) for p in parts]))


def uniform(*parts) -> Column:
    """A uniform in [0, 1) from the first 13 hex digits of the parts' md5."""
    return F.conv(F.substring(draw_key(*parts), 1, 13), 16, 10).cast("double") / float(1 << 52)


def sql_key(*parts: str) -> str:
    return f"md5(concat_ws('|', {', '.join(parts)}))"


def sql_uniform(*parts: str) -> str:
    return f"(CAST(('0x' || substr({sql_key(*parts)}, 1, 13)) AS BIGINT) / CAST(4503599627370496 AS DOUBLE))"
