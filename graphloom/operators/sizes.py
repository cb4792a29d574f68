"""Broadcasts behind a check of the size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows and bytes up to which a table may be broadcast.
MOST_ROWS, MOST_BYTES = 1_000_000, 64 << 20


def fits(df: DataFrame, most: int = MOST_ROWS, most_bytes: int = MOST_BYTES) -> bool:
    """Whether a table has at most `most` rows of `most_bytes` bytes together; counts no further than that many rows.

    A text or binary value has its own bytes, any other one 16.
    """
    wide = [F.octet_length(F.col(f"`{name}`")) for name, kind in df.dtypes if kind in ("string", "binary")]
    width = sum((F.coalesce(w, F.lit(0)) for w in wide), F.lit(16 * len(df.columns)))
    rows, size = df.limit(most + 1).agg(F.count("*"), F.sum(width)).first()
    return rows <= most and (size or 0) <= most_bytes


def sent_if(small: bool, df: DataFrame) -> DataFrame:
    """`df` marked for a broadcast if a check has shown that it is small; Spark chooses the join otherwise."""
    return F.broadcast(df) if small else df
