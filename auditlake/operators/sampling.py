"""Deterministic samples and first-wins deduplication.

Order always comes from a column of the data.  ``row_number() <= n`` is pruned
on the map side for small n (window group limit), so a class that holds most
rows sends only n rows per task over the network.  For larger n the same is
done in two steps over salted groups.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Up to here Spark itself prunes ranks before the shuffle.
PRUNED_UP_TO = 1000
SALTS = 64


def _ranked(df: DataFrame, by: list[str | Column], order: list[str | Column], n: int) -> DataFrame:
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= n).drop("_rn")


def first_n(df: DataFrame, by: list[str | Column], order: list[str | Column], n: int) -> DataFrame:
    """First ``n`` rows of every group in the given order (which must be unique).

    The first n of a group are among the first n of each of its salted parts,
    so a group of any size is cut in parallel before it is ordered as a whole.
    """
    if n > PRUNED_UP_TO:
        spread_by = [c for c in order if isinstance(c, str)] or df.columns
        salted = df.withColumn("_salt", F.pmod(F.xxhash64(*spread_by), F.lit(SALTS)))
        df = _ranked(salted, [*by, "_salt"], order, n).drop("_salt")
    return _ranked(df, by, order, n)


def keep_first(df: DataFrame, keys: list[str | Column], order: list[str | Column]) -> DataFrame:
    return first_n(df, keys, order, 1)


def stratified(df: DataFrame, label: str, order: list[str | Column], per_class: int) -> DataFrame:
    return first_n(df, [label], order, per_class)


def two_factor(df: DataFrame, factors: list[str | Column], order: list[str | Column], total: int) -> DataFrame:
    """``total // 4`` rows for each combination of two yes/no factors."""
    return first_n(df, factors, order, total // 4)


def seeded(df: DataFrame, label: str, key: str, seed: int, per_class: int) -> DataFrame:
    """Repeatable random sample per class: order by a hash of key and seed."""
    h = F.md5(F.concat_ws("|", F.col(key).cast("string"), F.lit(str(seed))))
    return first_n(df, [label], [h, F.col(key)], per_class)
