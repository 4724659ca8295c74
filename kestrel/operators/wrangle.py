"""Tabular wrangling: literal fills, null-row drops, mean imputation, and the whole job.

``wrangle`` reproduces the executed behaviour of the reference job: CSV in, fill the
named string columns with constants, drop rows that still hold a null (index column
excluded), CSV out.  Mean imputation is a separate operator (``impute_mean``) because the
reference declares an imputer but never applies it; the two are never merged silently.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kestrel.sources.io import csv_scan, csv_sink


def fill_null_literal(df: DataFrame, values: dict) -> DataFrame:
    """Fill nulls of the named columns with constants."""
    return df.na.fill(values)


def drop_null_rows(df: DataFrame, index_col: str | None = None) -> DataFrame:
    """Drop rows with any null outside the index column."""
    subset = [c for c in df.columns if c != index_col]
    return df.na.drop("any", subset=subset)


def impute_mean(df: DataFrame, cols: list[str], decimals: int | None = None) -> DataFrame:
    """Replace nulls of numeric ``cols`` by the column mean (nulls and NaN ignored).

    The means come from one aggregate evaluated as a scalar subquery, so the plan stays a
    single scan + one global partial aggregate; nothing is collected by the caller.
    ``decimals`` rounds the substituted mean (presentation; the mean itself is exact).
    """
    means = df.select(F.struct(*[F.avg(F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double"))).alias(c) for c in cols])).scalar()
    out = df
    for c in cols:
        m = means.getField(c)
        if decimals is not None:
            m = F.round(m, decimals)
        dtype = df.schema[c].dataType
        fill = m if isinstance(dtype, (T.DoubleType, T.FloatType)) else m.cast(dtype)
        out = out.withColumn(c, F.coalesce(F.when(~F.isnan(F.col(c).cast("double")), F.col(c)), fill.cast(dtype)))
    return out


def wrangle(
    spark: SparkSession,
    in_path: str,
    out_path: str,
    fill: dict,
    index_col: str,
    schema: T.StructType | str | None = None,
) -> DataFrame:
    """CSV -> fill constants -> drop rows with nulls left (index excluded) -> CSV.  Returns the written data re-read."""
    df = csv_scan(spark, in_path, schema=schema, index_col=index_col)
    out = drop_null_rows(fill_null_literal(df, fill), index_col=index_col)
    csv_sink(out, out_path, index_col=index_col)
    return csv_scan(spark, out_path, schema=out.schema, index_col=index_col)
