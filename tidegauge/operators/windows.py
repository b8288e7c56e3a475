"""Window analytics over ordered rows of each key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidegauge.functions.counters import seconds


def _upto(keys: list[str], *order, first: int = Window.unboundedPreceding):
    return Window.partitionBy(*keys).orderBy(*order).rowsBetween(first, 0)


def bollinger(df: DataFrame, keys: list[str], time: str, price: str, n: int = 20, width: float = 2.0) -> DataFrame:
    """df with sma, upper and lower band; deviations are of each row from the average at that row."""
    w = _upto(keys, time, first=-(n - 1))
    d = df.withColumn("sma", F.avg(price).over(w))
    d = d.withColumn("__sd", F.sqrt(F.avg((F.col(price) - F.col("sma")) * (F.col(price) - F.col("sma"))).over(w)))
    return d.withColumn("upper_band", F.col("sma") + width * F.col("__sd")).withColumn("lower_band", F.col("sma") - width * F.col("__sd")).drop("__sd")


def counter_rate(df: DataFrame, keys: list[str], time: str, value: str, modulus: int | None = None) -> DataFrame:
    """df with rate, the growth a second since the row before; after a fall the counter starts anew, or wraps at modulus."""
    w = Window.partitionBy(*keys).orderBy(time)
    v = F.col(value).cast("decimal(22,0)")
    before = F.lag(v).over(w)
    fell = v if modulus is None else v + F.lit(str(modulus)).cast("decimal(22,0)") - before
    gain = F.when(v >= before, v - before).otherwise(fell)
    return df.withColumn("rate", F.when(before.isNotNull(), gain.cast("double") / F.nullif(seconds(F.lag(time).over(w), F.col(time)), F.lit(0.0))))


def avg_cost_pnl(df: DataFrame, keys: list[str], order: list[str], bought: Column, cost: Column, sold: Column, proceeds: Column) -> DataFrame:
    """df with balance, avg_cost, realized and cumulative gain, where sales cost the running average of all purchases."""
    w = _upto(keys, *order)
    d = df.withColumns({"__b": bought, "__c": cost, "__s": sold, "__p": proceeds})
    d = d.withColumns({"__tb": F.sum("__b").over(w), "__tc": F.sum("__c").over(w), "balance": F.sum(F.col("__b") - F.col("__s")).over(w)})
    d = d.withColumn("avg_cost", F.col("__tc") / F.nullif(F.col("__tb"), F.lit(0).cast(dict(d.dtypes)["__tb"])))
    d = d.withColumn("realized", F.when(F.col("__s") > 0, F.col("__p") - F.col("__s") * F.coalesce("avg_cost", F.lit(0))).otherwise(F.lit(0)))
    return d.withColumn("cumulative", F.sum("realized").over(w)).drop("__b", "__c", "__s", "__p", "__tb", "__tc")


def forward_fill(df: DataFrame, keys: list[str], time: str, columns: list[str]) -> DataFrame:
    """df with nulls of the columns replaced by the last value before."""
    w = _upto(keys, time)
    return df.withColumns({c: F.last(c, ignorenulls=True).over(w) for c in columns})


def gaps(df: DataFrame, keys: list[str], time: str, over: str) -> DataFrame:
    """Pairs of neighbouring times further apart than an interval: gap_start, gap_end, gap_seconds."""
    w = Window.partitionBy(*keys).orderBy(time)
    d = df.select(*keys, F.col(time).alias("gap_start"), F.lead(time).over(w).alias("gap_end"))
    return d.where(F.col("gap_end") - F.col("gap_start") > F.expr(f"INTERVAL {over}")).withColumn("gap_seconds", seconds(F.col("gap_start"), F.col("gap_end")))


def latest(df: DataFrame, keys: list[str], *order) -> DataFrame:
    """The last row of each key by order, which should tell rows apart; an aggregate, so each task sends one row a key."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("r")).select(*keys, "r.*").select(df.columns)


def keep_last(df: DataFrame, keys: list[str], order: list[Column], n: int) -> DataFrame:
    """The last n rows of each key; order is from the last on."""
    return df.withColumn("__rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("__rn") <= n).drop("__rn")


def delta(df: DataFrame, keys: list[str], order: list[str], value: str, out: str = "delta") -> DataFrame:
    """df with the change since the row before, 0 for the first."""
    v = F.col(value)
    return df.withColumn(out, F.coalesce(v - F.lag(v).over(Window.partitionBy(*keys).orderBy(*order)), F.lit(0)))
