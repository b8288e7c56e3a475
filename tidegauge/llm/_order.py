"""Runs of rows in the order of an integer id, without one sort of everything."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

#: Null ids come before all others, parted by their texts so that many of them don't make one run.
LEAST, _NULLS = -(1 << 63), 1 << 32


def order_key(id_col: str, text_col: str) -> Column:
    """An integer by which rows stand in order of id; ids near the least integer would mix with null ones."""
    return F.coalesce(F.col(id_col).cast("long"), F.lit(LEAST) + F.pmod(F.xxhash64(text_col), F.lit(_NULLS)))


def cut_points(rows: DataFrame, key: str, size: str, most: int) -> list[int]:
    """Values of an integer key that cut the rows into runs of about `most` bytes, or less.

    A row counts by its bytes in units of the average row, so long texts make runs of few rows. The number of runs
    bounds what is collected.
    """
    r = rows.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(size), F.lit(0)).alias("b")).first()
    if not r["n"] or r["b"] <= most:
        return []
    unit = max(64, r["b"] // r["n"])
    weight = F.greatest(F.lit(1), F.ceil(F.coalesce(F.col(size), F.lit(0)) / unit)).cast("int")
    weighed = rows.select(F.col(key).alias("k"), weight.alias("w"))
    n = -(-weighed.agg(F.sum("w").alias("w")).first()["w"] * unit // most)
    entries = weighed.select("k", F.explode(F.sequence(F.lit(1), "w")))
    got = entries.agg(F.percentile_approx("k", [i / n for i in range(1, n)], max(10_000, 20 * n)).alias("c")).first()["c"]
    return sorted(set(got or []))


def run_of(key: Column, cuts: list[int]) -> Column:
    """Number of cut points at or below the key: looked up among every k-th first, then between two of these."""
    if not cuts:
        return F.lit(0)
    k = math.isqrt(len(cuts))
    top = F.lit(cuts[k - 1 :: k])
    block = F.size(F.filter(top, lambda c: c <= key))
    rest = F.slice(F.lit(cuts), block * k + 1, F.lit(k))
    return block * k + F.when(block * k < len(cuts), F.size(F.filter(rest, lambda c: c <= key))).otherwise(0)
