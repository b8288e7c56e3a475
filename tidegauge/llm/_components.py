"""Connected components of a distributed edge list."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tidegauge.llm._frames import spread, written


def _state(e: DataFrame):
    r = e.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
    return r["n"], r["h"]


def components(edges: DataFrame) -> DataFrame:
    """id and component, the least id reachable, of every end of the edges (u, v) other than the least ones themselves.

    Large-star and small-star steps in turn: each vertex hangs its larger neighbours, then its smaller ones, on the
    least of them. The edges never outgrow their number at the start; after a logarithmic number of rounds every vertex hangs on
    its least.
    """
    e = edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    e = written(e)
    state = _state(e)
    while state[0]:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(spread(least), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        near = large.join(spread(least), "u")
        small = near.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))).distinct()
        new = written(small)
        now = _state(new)
        if now == state:
            break
        e, state = new, now
    return e.select(F.col("u").alias("id"), F.col("v").alias("component"))
