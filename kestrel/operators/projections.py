"""Projection helpers: role views over the physical index columns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def role_view(df: DataFrame, mapping: dict, key: str | None = None) -> DataFrame:
    """Expose physical columns under role names.  A role mapped to several content fields is the
    newline-joined text of those fields; several vector/metadata fields keep the first."""
    cols = [F.col(key)] if key else []
    for role, src in mapping.items():
        if isinstance(src, (list, tuple)):
            if len(src) == 1 or role != "content":
                cols.append(F.col(src[0]).alias(role))
            else:
                cols.append(F.concat_ws("\n", *[F.col(s) for s in src]).alias(role))
        else:
            cols.append(F.col(src).alias(role))
    return df.select(*cols)
