"""Continuous aggregates: grouped results that are stored, refreshed by range or by change, and stacked on each other."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tidegauge.functions.bucket import bucket_of, buckets_within, next_bucket, time_bucket
from tidegauge.functions.states import merge_intervals
from tidegauge.operators import merge
from tidegauge.sources.storage import ChunkedTable, _Store


def shared_folder(spark: SparkSession) -> str:
    """Where executors and the driver can both write: the folder in spark.checkpoint.dir; a local one only in local mode."""
    sc = spark.sparkContext
    folder = sc.getConf().get("spark.checkpoint.dir")
    if not folder and not sc.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return (folder or "/tmp/checkpoints").rstrip("/")


def scratch(spark: SparkSession) -> str:
    """A new folder name in the shared folder."""
    return f"{shared_folder(spark)}/scratch-{uuid.uuid4().hex}"


@dataclass
class Definition:
    """What is grouped and how. read gives the source's rows in a range of its time column, whose ends may be None.

    Aggregates are Columns or SQL texts; a definition of texts can be kept and opened again. With tz, time has a zone and
    buckets follow that zone's calendar.
    """

    name: str
    read: Callable[[str | None, str | None], DataFrame]
    time: str
    width: str
    keys: list[str]
    aggs: dict[str, Column | str]
    bucket: str = "bucket"
    where: str | None = None
    tz: str | None = None
    materialized_only: bool = True
    chunk: str = "1 month"
    parents: list[str] = field(default_factory=list)

    def over(self, rows: DataFrame) -> DataFrame:
        """The aggregate of the rows."""
        d = rows.where(self.where) if self.where else rows
        return d.groupBy(time_bucket(self.width, self.time, self.tz).alias(self.bucket), *self.keys).agg(*[(F.expr(c) if isinstance(c, str) else c).alias(n) for n, c in self.aggs.items()])

    def kept(self) -> dict:
        """What a catalog writes down; aggregates that are Columns are left out."""
        texts = {n: c for n, c in self.aggs.items() if isinstance(c, str)}
        return {"time": self.time, "width": self.width, "keys": self.keys, "aggs": texts if len(texts) == len(self.aggs) else None, "bucket": self.bucket, "where": self.where, "tz": self.tz, "materialized_only": self.materialized_only, "chunk": self.chunk, "parents": self.parents}


class Aggregate:
    """A stored continuous aggregate."""

    def __init__(self, spark: SparkSession, root: str, definition: Definition):
        self.spark, self.d = spark, definition
        self.schema = definition.over(definition.read(None, None)).schema
        self.table = ChunkedTable.create(spark, f"{root}/{definition.name}", self.schema, definition.bucket, definition.chunk, if_not_exists=True)
        self._read_type = definition.read(None, None).schema[definition.time].dataType
        self._bucket_type = self.schema[definition.bucket].dataType

    @property
    def watermark(self) -> str | None:
        """End of what has been refreshed; it is kept with the table, so it is known after reopening too."""
        return self.table.properties().get("watermark")

    def _whole(self, start: str | None, end: str | None) -> tuple[str | None, str | None]:
        """The part of a range that is of whole buckets of the definition's calendar; for open ends that of the rows."""
        d = self.d
        if start is None or end is None:
            r = d.read(start, end).agg(F.min(d.time).cast("string").alias("a"), F.max(d.time).cast("string").alias("b")).first()
            if r["a"] is None:
                return None, None
            lo, hi = (start or r["a"]), (end or r["b"])
        else:
            lo, hi = start, end
        t = lambda x: F.lit(x).cast(self._read_type)
        a, b = bucket_of(d.width, t(lo), d.tz), bucket_of(d.width, t(hi), d.tz)
        a = a if start is None else F.when(a == t(lo), a).otherwise(next_bucket(d.width, a, d.tz))
        b = next_bucket(d.width, b, d.tz) if end is None else b
        r = self.spark.range(1).select(a.cast("string").alias("a"), b.cast("string").alias("b"), (a < b).alias("some")).first()
        return (r["a"], r["b"]) if r["some"] else (None, None)

    def _time(self, text: str) -> Column:
        return F.lit(text).cast(self._bucket_type)

    def refresh(self, start: str | None = None, end: str | None = None) -> None:
        """Compute the whole buckets of a range again and put them in the place of what is stored of it."""
        a, b = self._whole(start, end)
        if a is None:
            return
        new = self.d.over(self.d.read(a, b))
        bucket = F.col(self.d.bucket)
        self._replace(new, lambda old: old.where(~((bucket >= self._time(a)) & (bucket < self._time(b)))), a, b)
        before = self.watermark
        if before is None or before < b:
            self.table.set_property("watermark", b)

    def _replace(self, new: DataFrame, rest: Callable[[DataFrame], DataFrame], a: str, b: str) -> None:
        chunks = [c for c, x, y in self.table.chunk_bounds() if x < b and y > a]
        self.table.rewrite(lambda old: rest(old).unionByName(new), chunks)

    def read(self, start: str | None = None, end: str | None = None) -> DataFrame:
        """Stored rows; unless materialized_only also the aggregate of rows that lie after the last refreshed bucket."""
        stored = self.table.read(start, end)
        if self.d.materialized_only:
            return stored
        watermark = self.watermark
        since = max(x for x in (watermark, start) if x) if watermark or start else None
        fresh = self.d.over(self.d.read(since, end))
        if watermark:
            stored = stored.where(F.col(self.d.bucket) < self._time(watermark))
        return stored.unionByName(fresh)


class Catalog:
    """Tables and continuous aggregates by name, with what depends on what."""

    def __init__(self, spark: SparkSession, root: str | None = None):
        self.spark, self.root = spark, root or scratch(spark)
        self.tables: dict[str, ChunkedTable] = {}
        self.aggregates: dict[str, Aggregate] = {}
        self.logs: dict[str, InvalidationLog] = {}
        self._store = _Store(spark, self.root)

    @classmethod
    def open(cls, spark: SparkSession, root: str, aggs: dict[str, dict[str, Column]] | None = None) -> Catalog:
        """The catalog that was kept in a folder; aggs has the aggregates of those definitions that were given as Columns."""
        c = cls(spark, root)
        names = c._store.names("catalog")
        kept = json.loads(c._store.read(f"catalog/{names[-1]}")) if names else {"tables": [], "aggregates": {}, "logs": []}
        for n in kept["tables"]:
            c.tables[n] = ChunkedTable(spark, f"{root}/{n}")
        for n, d in kept["aggregates"].items():
            own = (aggs or {}).get(n) or d["aggs"]
            if own is None:
                raise ValueError(f"the aggregates of {n} were given as Columns: give them again")
            c._define(n, d | {"aggs": own})
        for n in kept["logs"]:
            c.logs[n] = InvalidationLog(c.aggregates[n], f"{root}/{n}-log", new=False)
        return c

    def _keep(self) -> None:
        kept = {"tables": list(self.tables), "aggregates": {n: a.d.kept() for n, a in self.aggregates.items()}, "logs": list(self.logs)}
        self._store.put(f"catalog/{len(self._store.names('catalog')):012d}.json", json.dumps(kept))

    def _define(self, name: str, d: dict) -> Aggregate:
        source = d["parents"][0]
        read = (self.tables[source] if source in self.tables else self.aggregates[source]).read
        self.aggregates[name] = Aggregate(self.spark, self.root, Definition(name=name, read=read, **d))
        return self.aggregates[name]

    def create_table(self, name: str, schema, time: str, interval: str = "7 days", **more) -> ChunkedTable:
        self.tables[name] = ChunkedTable.create(self.spark, f"{self.root}/{name}", schema, time, interval, **more)
        self._keep()
        return self.tables[name]

    def create(self, name: str, source: str, time: str, width: str, keys: list[str], aggs: dict[str, Column | str], with_data: bool = True, **more) -> Aggregate:
        """A continuous aggregate of a table or of another aggregate, filled unless with_data is false."""
        a = self._define(name, {"time": time, "width": width, "keys": keys, "aggs": aggs, "parents": [source], **more})
        self._keep()
        if with_data:
            a.refresh()
        return a

    def order(self, name: str | None = None) -> list[str]:
        """Aggregates so that each comes after what it is made of; those that depend on name, or all."""
        out: list[str] = []

        def visit(n: str) -> None:
            for p in self.aggregates[n].d.parents:
                if p in self.aggregates:
                    visit(p)
            if n not in out:
                out.append(n)

        for n in self.aggregates:
            visit(n)
        if name is None:
            return out
        reach = {name}
        for n in out:
            if any(p in reach for p in self.aggregates[n].d.parents):
                reach.add(n)
        return [n for n in out if n in reach]

    def refresh_cascade(self, start: str | None = None, end: str | None = None, name: str | None = None) -> list[str]:
        """Refresh in order of dependence; returns that order."""
        done = self.order(name)
        for n in done:
            self.aggregates[n].refresh(start, end)
        return done

    def append(self, table: str, rows: DataFrame) -> None:
        """Add rows to a table and note the change in the logs of aggregates that are refreshed by change."""
        self.tables[table].append(rows)
        self.changed(table, rows)

    def changed(self, table: str, rows: DataFrame) -> None:
        for n, log in self.logs.items():
            if table in self.aggregates[n].d.parents:
                log.note(rows)

    def update(self, table: str, where: Column, values: dict[str, Column]) -> None:
        """Change rows; the groups that they leave and those that they come to are noted."""
        old = self.tables[table].read().where(where)
        self.changed(table, old.unionByName(merge.update(old, F.lit(True), values)))
        self.tables[table].update(where, values)

    def delete(self, table: str, where: Column) -> None:
        self.changed(table, self.tables[table].read().where(where))
        self.tables[table].delete(where)

    def enable_partial_refresh(self, name: str) -> InvalidationLog:
        self.logs[name] = InvalidationLog(self.aggregates[name], f"{self.root}/{name}-log")
        self._keep()
        return self.logs[name]

    def drop(self, name: str, cascade: bool = False) -> list[str]:
        """Drop a table or an aggregate; with cascade also what depends on it. Returns what was dropped, dependents first."""
        direct = [n for n, a in self.aggregates.items() if name in a.d.parents]
        if direct and not cascade:
            raise ValueError(f"{direct} depend on {name}")
        gone = [x for n in direct if n in self.aggregates for x in self.drop(n, True)]
        if name in self.aggregates:
            self.aggregates.pop(name).table.drop()
            self.logs.pop(name, None)
        elif name in self.tables:
            self.tables.pop(name).drop()
        self._keep()
        return [*gone, name]

    def describe(self) -> DataFrame:
        rows = [(n, "table", t.describe()["time"], t.describe()["chunks"], None) for n, t in self.tables.items()]
        rows += [(n, "aggregate", a.d.bucket, a.table.describe()["chunks"], ",".join(a.d.parents)) for n, a in self.aggregates.items()]
        return self.spark.createDataFrame(rows, "name string, kind string, time string, chunks long, parents string")


class InvalidationLog:
    """Runs of buckets of keys whose stored groups are stale, in files; an entry is pending until its id is among those done."""

    def __init__(self, aggregate: Aggregate, root: str, new: bool = True):
        self.a, self.root, self.spark = aggregate, root, aggregate.spark
        d = aggregate.d
        self.keys = d.keys
        fields = "".join(f"`{k}` {aggregate.schema[k].dataType.simpleString()}, " for k in self.keys)
        kind = aggregate.schema[d.bucket].dataType.simpleString()
        self.kind = f"id string, batch string, {fields}range_start {kind}, range_end {kind}"
        if new:
            self._empty(self.kind, "entries")
            self._empty("id string, status string, error string", "done")

    def _empty(self, kind: str, name: str) -> None:
        self.spark.createDataFrame([], kind).write.mode("append").parquet(f"{self.root}/{name}")

    @staticmethod
    def stale(rows: DataFrame, d: Definition) -> DataFrame:
        """For each key the buckets that changed rows touch, neighbouring ones as one range."""
        b = rows.select(*d.keys, bucket_of(d.width, d.time, d.tz).alias("range_start")).distinct()
        return merge_intervals(b.withColumn("range_end", next_bucket(d.width, "range_start", d.tz)), d.keys, "range_start", "range_end")

    def note(self, rows: DataFrame) -> None:
        """Log what a batch of changed rows makes stale."""
        e = self.stale(rows, self.a.d).select(F.uuid().alias("id"), F.lit(uuid.uuid4().hex).alias("batch"), *self.keys, "range_start", "range_end")
        e.write.mode("append").parquet(f"{self.root}/entries")

    def entries(self) -> DataFrame:
        """All entries with their status, and whether their batch has more than one."""
        from pyspark.sql import Window

        e = self.spark.read.schema(self.kind).parquet(f"{self.root}/entries")
        done = self.spark.read.schema("id string, status string, error string").parquet(f"{self.root}/done")
        e = e.join(done, "id", "left").withColumn("status", F.coalesce("status", F.lit("pending")))
        n = F.count(F.lit(1)).over(Window.partitionBy("batch", *self.keys))
        return e.withColumn("batch_kind", F.when(n > 1, "BULK").otherwise("SINGLE"))

    def process(self, limit: int | None = None, only: Column | None = None) -> int:
        """Refresh the groups of pending entries, as many as limit and of those that only selects; returns how many."""
        p = self.entries().where("status = 'pending'")
        p = p.where(only) if only is not None else p
        p = p.orderBy("range_start", "id").limit(limit) if limit is not None else p
        sc = self.spark.sparkContext
        if sc.getCheckpointDir() is None:
            sc.setCheckpointDir(shared_folder(self.spark))
        p = p.select("id", *self.keys, "range_start", "range_end").checkpoint()
        ends = p.agg(F.count(F.lit(1)).alias("n"), F.min("range_start").cast("string").alias("a"), F.max("range_end").cast("string").alias("b")).first()
        n = ends["n"]
        if not n:
            return 0
        d = self.a.d
        # stale groups one by one, so that rows meet them by equality
        groups = p.select(*[F.col(k).alias(f"__{k}") for k in self.keys], F.explode(buckets_within(d.width, "range_start", "range_end", d.tz)).alias("__b")).distinct()
        status, error = "completed", None
        try:
            def within(rows: DataFrame, bucket: Column, how: str) -> DataFrame:
                on = bucket.eqNullSafe(F.col("__b"))
                for k in self.keys:
                    on = on & F.col(k).eqNullSafe(F.col(f"__{k}"))
                return rows.join(groups, on, how)

            new = d.over(within(d.read(ends["a"], ends["b"]), bucket_of(d.width, d.time, d.tz), "left_semi"))
            self.a._replace(new, lambda old: within(old, F.col(d.bucket), "left_anti"), ends["a"], ends["b"])
        except Exception as e:
            status, error = "failed", str(e)[:500]
        p.select("id", F.lit(status).alias("status"), F.lit(error).cast("string").alias("error")).write.mode("append").parquet(f"{self.root}/done")
        return n


def merge_sources(parts: list[tuple[DataFrame, str, dict[str, Column]]], width: str, bucket: str = "timestamp", count: str = "samples_count") -> DataFrame:
    """One row for each bucket of several sources, each with its own aggregates; counts are added up."""
    out = None
    for rows, time, aggs in parts:
        a = rows.groupBy(time_bucket(width, time).alias(bucket)).agg(*[c.alias(n) for n, c in aggs.items()], F.count(F.lit(1)).alias("__n"))
        if out is None:
            out = a
        else:
            out = out.withColumnRenamed("__n", "__m").join(a, bucket, "full").withColumn("__n", F.coalesce("__n", F.lit(0)) + F.coalesce("__m", F.lit(0))).drop("__m")
    return out.withColumnRenamed("__n", count)


def complete_rows(df: DataFrame, columns: list[str]) -> DataFrame:
    """Rows in which none of the columns is null."""
    return df.dropna(subset=columns)
