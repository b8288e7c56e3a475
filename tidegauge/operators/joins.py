"""Joins on time: as-of, bucket-aligned, overlapping intervals, full outer alignment."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from tidegauge.functions.bucket import Width, parse_width, time_bucket


def asof_join(left: DataFrame, right: DataFrame, keys: list[str], time: str, values: list[str], suffix: str = "") -> DataFrame:
    """left with the values of the right row of its keys at the latest time at or before its own; null if there is none.

    Both sides go through one sort by keys and time, with no comparison of pairs. A key's rows are one window; a
    key that holds a large part of all rows should be split with `asof_join_split`.
    """
    picked = F.struct(*[F.col(v).alias(f"v{i}") for i, v in enumerate(values)])
    columns = left.columns
    a = left.select(*keys, F.col(time), F.struct(*columns).alias("__row"), F.lit(None).cast(picked_type(right, values)).alias("__v"), F.lit(1).alias("__side"))
    b = right.select(*keys, F.col(time), F.lit(None).cast(left.select(F.struct(*columns).alias("r")).schema["r"].dataType).alias("__row"), picked.alias("__v"), F.lit(0).alias("__side"))
    w = Window.partitionBy(*keys).orderBy(time, "__side").rowsBetween(Window.unboundedPreceding, 0)
    out = a.unionByName(b).withColumn("__v", F.last("__v", ignorenulls=True).over(w)).where("__side = 1")
    return out.select("__row.*", *[F.col(f"__v.v{i}").alias(f"{v}{suffix}") for i, v in enumerate(values)])


def picked_type(right: DataFrame, values: list[str]):
    return right.select(F.struct(*[F.col(v).alias(f"v{i}") for i, v in enumerate(values)]).alias("s")).schema["s"].dataType


def asof_join_split(left: DataFrame, right: DataFrame, keys: list[str], time: str, values: list[str], slot: str | Width) -> DataFrame:
    """As asof_join, with the windows of a key cut into slots of time, so that one hot key spreads over many tasks.

    The last right row of each slot is carried to the slots after it by a window over slots alone.
    """
    s = "__slot"
    lb, rb = left.withColumn(s, time_bucket(slot, time)), right.withColumn(s, time_bucket(slot, time))
    last = rb.groupBy(*keys, s).agg(F.max_by(F.struct(time, *values), F.col(time)).alias("__last"))
    slots = lb.select(*keys, s).distinct().join(last, [*keys, s], "full")
    w = Window.partitionBy(*keys).orderBy(s).rowsBetween(Window.unboundedPreceding, -1)
    carried = slots.withColumn("__last", F.last("__last", ignorenulls=True).over(w)).where("__last is not null").select(*keys, s, "__last.*")
    return asof_join(lb, rb.select(*keys, s, time, *values).unionByName(carried), [*keys, s], time, values).drop(s)


def bucket_join(a: DataFrame, b: DataFrame, width: str | Width, time_a: str, time_b: str, keys: list[str] | None = None, how: str = "inner", bucket: str = "bucket") -> DataFrame:
    """Rows of a and b of one bucket and one key; joined by equality of the bucket's start."""
    return a.withColumn(bucket, time_bucket(width, time_a)).join(b.withColumn(bucket, time_bucket(width, time_b)), [*(keys or []), bucket], how)


def full_outer_align(frames: list[DataFrame], key: str) -> DataFrame:
    """One row for each value of the key in any frame."""
    return reduce(lambda a, b: a.join(b, key, "full"), frames)


def overlap_join(a: DataFrame, b: DataFrame, keys: list[str], a_start: str, a_end: str, b_start: str, b_end: str, slot: str | Width, how: str = "inner") -> DataFrame:
    """Pairs of one key whose half-open intervals overlap.

    Intervals are cut into slots of time and joined by equality of key and slot; a pair is kept in the slot in which its overlap begins.
    """
    w = parse_width(slot)

    def slots(df: DataFrame, s: str, e: str) -> DataFrame:
        last = F.col(e) - F.expr("INTERVAL 1 MICROSECOND")
        return df.where(F.col(s) < F.col(e)).withColumn("__slot", F.explode(F.sequence(time_bucket(w, s), time_bucket(w, last), F.expr(f"INTERVAL '{w.micros / 1e6:f}' SECOND") if w.micros else F.expr(f"INTERVAL '{w.months}' MONTH"))))

    x, y = slots(a, a_start, a_end), slots(b, b_start, b_end)
    both = x.join(y, [*keys, "__slot"]).where((F.col(a_start) < F.col(b_end)) & (F.col(b_start) < F.col(a_end)))
    both = both.where(F.col("__slot") == time_bucket(w, F.greatest(a_start, b_start))).drop("__slot")
    if how == "inner":
        return both
    return a.join(both.select(*keys, a_start, a_end).distinct(), [*keys, a_start, a_end], {"semi": "left_semi", "anti": "left_anti"}[how])


def last_before(df: DataFrame, keys: list[str], time: str, is_mark: Column) -> DataFrame:
    """df with mark_time, the time of the latest earlier row of the key for which is_mark holds."""
    w = Window.partitionBy(*keys).orderBy(time).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn("mark_time", F.last(F.when(is_mark, F.col(time)), ignorenulls=True).over(w))


#: Queries and items whose distances are taken in one task, about; distances held at once.
QUERY_BLOCK, ITEM_BLOCK, DISTANCES = 4096, 8192, 1 << 18


def nearest_vectors(queries: DataFrame, items: DataFrame, vector: str, query_id: str, item_id: str, k: int) -> DataFrame:
    """The k nearest items by Euclidean distance of each query, the least id first of those as near; vectors have one length.

    Ids deal both sides to blocks of bounded size. Each pair of blocks is one group, of which k items a query are left. A
    vector that is null or of another length has a null distance, which comes last.
    """
    q = queries.select(F.col(query_id).alias("query_id"), F.col(vector).cast("array<double>").alias("__q"))
    i = items.select(F.col(item_id).alias("item_id"), F.col(vector).cast("array<double>").alias("__v"))
    nq, ni = (max(1, -(-d.count() // size)) for d, size in ((q, QUERY_BLOCK), (i, ITEM_BLOCK)))

    def dealt(d: DataFrame, own: str, n: int, other: str, m: int) -> DataFrame:
        return d.withColumns({own: F.pmod(F.xxhash64(d.columns[0]), F.lit(n)), other: F.explode(F.sequence(F.lit(0), F.lit(m - 1)).cast("array<bigint>"))})

    pairs = dealt(q, "__qb", nq, "__ib", ni).groupBy("__qb", "__ib").cogroup(dealt(i, "__ib", ni, "__qb", nq).groupBy("__qb", "__ib"))
    kinds = T.StructType([T.StructField("query_id", q.schema["query_id"].dataType), T.StructField("item_id", i.schema["item_id"].dataType), T.StructField("distance", T.DoubleType())])
    near = pairs.applyInArrow(lambda a, b: _nearest(a, b, k), kinds)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("distance").asc_nulls_last(), "item_id"))
    return near.withColumn("rank", rank).where(F.col("rank") <= k)


def _nearest(queries, items, k: int):
    """The k nearest of the items of a block for each query of a block, as an Arrow table."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    items = items.take(pc.sort_indices(items["item_id"], null_placement="at_start"))
    columns = [t[c].combine_chunks() for t, c in ((queries, "__q"), (items, "__v"))]
    lengths = [pc.fill_null(pc.list_value_length(c), -1).to_numpy(zero_copy_only=False) for c in columns]
    width = max([0, *(n.max() for n in lengths if len(n))])
    full = []
    for c, n in zip(columns, lengths, strict=True):
        x = np.full((len(n), width), np.nan)
        x[n == width] = c.filter(pa.array(n == width)).flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
        full.append(x)
    q, v = full[0], np.ascontiguousarray(full[1].T)
    k, step, rows, picked, far = min(k, v.shape[1]), max(1, DISTANCES // max(1, v.shape[1])), [], [], []
    for at in range(0, len(q) if k else 0, step):
        d = np.zeros((len(q[at : at + step]), v.shape[1]))
        for j in range(width):
            d += (v[j] - q[at : at + step, j, None]) ** 2
        d = np.sqrt(d)
        d[np.isnan(d)] = np.inf
        most = np.partition(d, k - 1, axis=1)[:, k - 1]
        for r in range(len(d)):
            near = np.flatnonzero(d[r] <= most[r])
            near = near[np.argsort(d[r, near], kind="stable")[:k]]
            rows.append(np.full(len(near), at + r))
            picked.append(near)
            far.append(d[r, near])
    rows, picked, far = (np.concatenate([np.zeros(0, t), *x]).astype(t) for x, t in ((rows, np.int64), (picked, np.int64), (far, np.float64)))
    return pa.table({"query_id": queries["query_id"].take(pa.array(rows)), "item_id": items["item_id"].take(pa.array(picked)), "distance": pa.array(far, mask=np.isinf(far))})
