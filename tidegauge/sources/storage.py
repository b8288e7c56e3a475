"""Tables in chunks of time: Parquet folders by chunk, with swaps that readers never see half done.

A table is a folder with a manifest for each version; a manifest lists the files of each chunk with row counts and
bounds of time. A change writes new files, then the next manifest; readers take the latest. All of it goes through Spark's own readers and
the Hadoop file system, so any shared store will do.
"""

from __future__ import annotations

import calendar
import json
import time
import uuid
from collections.abc import Callable
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from tidegauge.functions.bucket import Width, parse_width, time_bucket
from tidegauge.operators import merge


class _Store:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self.fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self._jvm = jvm

    def at(self, name: str):
        return self._path(f"{self.root}/{name}")

    def names(self, folder: str) -> list[str]:
        p = self.at(folder)
        return sorted(s.getPath().getName() for s in self.fs.listStatus(p)) if self.fs.exists(p) else []

    def read(self, name: str) -> str:
        s = self.fs.open(self.at(name))
        try:
            return self._jvm.org.apache.commons.io.IOUtils.toString(s, "UTF-8")
        finally:
            s.close()

    def put(self, name: str, text: str) -> None:
        """Write a new file; it must not be there, which the store itself sees to, so of two writers one fails."""
        try:
            out = self.fs.create(self.at(name), False)
        except Exception as e:
            if self.fs.exists(self.at(name)):
                raise RuntimeError(f"{name} exists: another writer was first") from e
            raise
        try:
            out.write(bytearray(text.encode()))
        finally:
            out.close()

    def size(self, name: str) -> int:
        p = self.at(name)
        return self.fs.getContentSummary(p).getLength() if self.fs.exists(p) else 0

    def drop(self, name: str = "") -> None:
        self.fs.delete(self.at(name) if name else self._path(self.root), True)


class ChunkedTable:
    """A table partitioned by buckets of its time column, and by a hash of a second column if asked for."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.store = spark, _Store(spark, root)

    @classmethod
    def create(cls, spark: SparkSession, root: str, schema: T.StructType | str, time_col: str, interval: str = "7 days", space: tuple[str, int] | None = None, if_not_exists: bool = False, rows: DataFrame | None = None) -> ChunkedTable:
        """A new table; rows are its first ones. space: a column and the number of parts that its hash is dealt to."""
        table = cls(spark, root)
        if table.store.names("versions"):
            if if_not_exists:
                return table
            raise ValueError(f"{root} is a table")
        kind = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
        parse_width(interval)
        table._commit({"schema": kind.jsonValue(), "time": time_col, "interval": interval, "space": space, "segment_by": [], "order_by": [], "checks": {}, "chunks": {}}, 0)
        if rows is not None:
            table.append(rows)
        return table

    def _manifest(self) -> tuple[dict, int]:
        names = [n for n in self.store.names("versions") if n.endswith(".json")]
        for n in reversed(names):
            for _ in range(10):
                try:
                    return json.loads(self.store.read(f"versions/{n}")), int(names[-1][:-5])
                except ValueError:  # its writer isn't done yet, or never will be
                    time.sleep(0.2)
        raise ValueError(f"{self.store.root} isn't a table")

    def _commit(self, manifest: dict, version: int) -> None:
        self.store.put(f"versions/{version:012d}.json", json.dumps(manifest))

    @property
    def schema(self) -> T.StructType:
        return T.StructType.fromJson(self._manifest()[0]["schema"])

    def _chunk(self, m: dict) -> Column:
        return F.date_format(time_bucket(m["interval"], m["time"]), "yyyyMMdd'T'HHmmss")

    def _write(self, rows: DataFrame, m: dict) -> dict:
        """Files of the rows by chunk."""
        kind = T.StructType.fromJson(m["schema"])
        own = rows.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in kind.fields])
        d = own.withColumn("__chunk", self._chunk(m))
        parts = ["__chunk"]
        if m["space"]:
            d = d.withColumn("__space", F.pmod(F.xxhash64(m["space"][0]), F.lit(m["space"][1])).cast("int"))
            parts.append("__space")
        folder = f"data/{uuid.uuid4().hex}"
        # chunks that are large are split among tasks, and so into files, and small ones share a task
        d = d.hint("rebalance", *parts, *m["segment_by"]).sortWithinPartitions(*parts, *m["segment_by"], *(m["order_by"] or [m["time"]]))
        d.write.partitionBy("__chunk").option("compression", "zstd").parquet(f"{self.store.root}/{folder}")
        names = [n.split("=", 1)[1] for n in self.store.names(folder) if n.startswith("__chunk=")]
        if not names:
            return {}
        got = self.spark.read.schema(T.StructType([*kind.fields, T.StructField("__chunk", T.StringType())])).parquet(f"{self.store.root}/{folder}")
        stats = got.groupBy("__chunk").agg(F.count(F.lit(1)).alias("n"), F.min(m["time"]).alias("a"), F.max(m["time"]).alias("b")).collect()
        return {r["__chunk"]: {"folder": f"{folder}/__chunk={r['__chunk']}", "rows": r["n"], "min": str(r["a"]), "max": str(r["b"])} for r in stats}

    def _frame(self, m: dict, chunks: list[str]) -> DataFrame:
        kind = T.StructType.fromJson(m["schema"])
        folders = [f"{self.store.root}/{p['folder']}" for c in chunks for p in m["chunks"][c]]
        if not folders:
            return self.spark.createDataFrame([], kind)
        return self.spark.read.schema(kind).parquet(*folders)

    def chunk_bounds(self, m: dict | None = None) -> list[tuple[str, str, str]]:
        """Name, start and end of each chunk, in order."""
        m = m or self._manifest()[0]
        w = parse_width(m["interval"])
        try:
            return sorted((c, *_bounds(c, w)) for c in m["chunks"])
        except (ValueError, OverflowError):
            pass  # years that only Spark's calendar has
        step = F.expr(f"INTERVAL '{w.months}' MONTH") if w.months else F.expr(f"INTERVAL '{w.micros / 1e6:f}' SECOND")
        start = F.to_timestamp_ntz(F.col("n"), F.lit("yyyyMMdd'T'HHmmss"))
        rows = self.spark.createDataFrame([(c,) for c in m["chunks"]], "n string").select("n", start.cast("string").alias("a"), (start + step).cast("string").alias("b"))
        return sorted(map(tuple, rows.collect()))

    def read(self, start: str | None = None, end: str | None = None) -> DataFrame:
        """Rows with start <= time < end; only chunks in that range are opened."""
        m, _ = self._manifest()
        chunks = [c for c, a, b in self.chunk_bounds(m) if (end is None or a < _stamp(end)) and (start is None or b > _stamp(start))]
        d = self._frame(m, chunks)
        t = F.col(m["time"])
        kind = d.schema[m["time"]].dataType
        d = d.where(t >= F.lit(start).cast(kind)) if start is not None else d
        return d.where(t < F.lit(end).cast(kind)) if end is not None else d

    def show_chunks(self, older_than: str | None = None) -> list[str]:
        """Names of chunks, or of those that end at or before a time."""
        return [c for c, _, b in self.chunk_bounds() if older_than is None or b <= _stamp(older_than)]

    def read_chunk(self, name: str) -> DataFrame:
        return self._frame(self._manifest()[0], [name])

    def append(self, rows: DataFrame) -> DataFrame:
        """Add rows, after the table's checks; returns them."""
        m, v = self._manifest()
        for name, condition in m["checks"].items():
            merge.check(rows, name, F.expr(condition))
        for c, part in self._write(rows, m).items():
            m["chunks"].setdefault(c, []).append(part)
        self._commit(m, v + 1)
        return rows

    def rewrite(self, change: Callable[[DataFrame], DataFrame], chunks: list[str] | None = None) -> None:
        """Replace the chunks (all by default) by what change makes of their rows."""
        m, v = self._manifest()
        chunks = list(m["chunks"]) if chunks is None else chunks
        new = self._write(change(self._frame(m, chunks)), m)
        for c in chunks:
            m["chunks"].pop(c, None)
        for c, part in new.items():
            m["chunks"].setdefault(c, []).append(part)
        self._commit(m, v + 1)

    def _names(self, m: dict, rows: DataFrame) -> list[str]:
        """Chunks of the table that rows belong to."""
        names = {r[0] for r in rows.select(self._chunk(m)).distinct().collect()}
        return [c for c in m["chunks"] if c in names]

    def _same_keys(self, m: dict, batch: DataFrame, keys: list[str]) -> list[str]:
        """Chunks that may hold rows with keys of the batch."""
        if m["time"] in keys:
            return self._names(m, batch)
        known = batch.select(*[F.col(k).alias(f"__{k}") for k in keys]).distinct()
        on = [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys]
        old = self._frame(m, list(m["chunks"])).select(m["time"], *[k for k in keys if k != m["time"]])
        return self._names(m, old.join(known, on, "left_semi"))

    def upsert(self, batch: DataFrame, keys: list[str], resolve=None) -> None:
        """Merge a batch in; only chunks that hold keys of the batch are rewritten, and its new rows are written to their own."""
        m, _ = self._manifest()
        self.rewrite(lambda old: merge.upsert(old, batch, keys, resolve), self._same_keys(m, batch, keys))

    def insert_new(self, batch: DataFrame, keys: list[str]) -> None:
        """Add rows of keys that the table hasn't; only chunks that may hold these keys are read for it."""
        m, _ = self._manifest()
        self.append(merge.new_rows(self._frame(m, self._same_keys(m, batch, keys)), batch, keys))

    def update(self, where: Column, values: dict[str, Column]) -> None:
        """Change columns of some rows; only chunks that hold such rows are rewritten."""
        m, _ = self._manifest()
        touched = self._names(m, self._frame(m, list(m["chunks"])).where(where))
        if touched:
            self.rewrite(lambda old: merge.update(old, where, values), touched)

    def delete(self, where: Column) -> None:
        """Drop some rows; only chunks that hold such rows are rewritten."""
        m, _ = self._manifest()
        touched = self._names(m, self._frame(m, list(m["chunks"])).where(where))
        if touched:
            self.rewrite(lambda old: merge.delete(old, where), touched)

    def properties(self) -> dict:
        """What users of the table keep with it, such as how far it is filled."""
        return dict(self._manifest()[0].get("properties", {}))

    def set_property(self, name: str, value) -> None:
        m, v = self._manifest()
        m.setdefault("properties", {})[name] = value
        self._commit(m, v + 1)

    def truncate(self) -> None:
        m, v = self._manifest()
        m["chunks"] = {}
        self._commit(m, v + 1)

    def drop_chunks(self, older_than: str) -> list[str]:
        """Retention: drop chunks that lie wholly before a time."""
        gone = self.show_chunks(older_than)
        m, v = self._manifest()
        for c in gone:
            m["chunks"].pop(c)
        self._commit(m, v + 1)
        return gone

    def set_compression(self, segment_by: list[str], order_by: list[str]) -> None:
        """How rows of a chunk lie: by segment, then in order, so that bounds of row groups tell queries what to skip."""
        m, v = self._manifest()
        m |= {"segment_by": segment_by, "order_by": order_by}
        self._commit(m, v + 1)

    def compress_chunks(self, older_than: str | None = None) -> list[str]:
        """Rewrite chunks in the layout that is set, small files joined."""
        chunks = self.show_chunks(older_than)
        if chunks:
            self.rewrite(lambda d: d, chunks)
        return chunks

    def add_column(self, name: str, kind: str) -> None:
        """A new column, null in the rows that are there."""
        m, v = self._manifest()
        m["schema"] = T.StructType.fromJson(m["schema"]).add(name, T._parse_datatype_string(kind)).jsonValue()
        self._commit(m, v + 1)

    def alter_type(self, name: str, kind: str, using: str | None = None) -> None:
        """Another type for a column, its values made by an SQL expression or a cast."""
        m, v = self._manifest()
        old = self._frame(m, list(m["chunks"]))
        fields = [T.StructField(f.name, T._parse_datatype_string(kind) if f.name == name else f.dataType) for f in T.StructType.fromJson(m["schema"]).fields]
        m["schema"] = T.StructType(fields).jsonValue()
        new = self._write(old.withColumn(name, F.expr(using) if using else F.col(name).cast(kind)), m)
        m["chunks"] = {c: [p] for c, p in new.items()}
        self._commit(m, v + 1)

    def add_check(self, name: str, condition: str) -> None:
        m, v = self._manifest()
        merge.check(self._frame(m, list(m["chunks"])), name, F.expr(condition))
        m["checks"][name] = condition
        self._commit(m, v + 1)

    def drop_check(self, name: str) -> None:
        m, v = self._manifest()
        del m["checks"][name]
        self._commit(m, v + 1)

    def chunk_sizes(self) -> DataFrame:
        """Name, bounds, rows, files' bytes and bounds of time of each chunk."""
        m, _ = self._manifest()
        rows = [(c, a, b, sum(p["rows"] for p in m["chunks"][c]), sum(self.store.size(p["folder"]) for p in m["chunks"][c])) for c, a, b in self.chunk_bounds(m)]
        return self.spark.createDataFrame(rows, "chunk string, range_start string, range_end string, rows long, bytes long")

    def describe(self) -> dict:
        """What the catalog knows of the table."""
        m, v = self._manifest()
        return {k: m[k] for k in ("time", "interval", "space", "segment_by", "order_by")} | {"chunks": len(m["chunks"]), "version": v}

    def vacuum(self) -> None:
        """Remove old manifests and files that the latest doesn't list; only when nobody reads an older version."""
        m, v = self._manifest()
        used = {p["folder"].split("/")[1] for parts in m["chunks"].values() for p in parts}
        for n in self.store.names("versions"):
            if n != f"{v:012d}.json":
                self.store.drop(f"versions/{n}")
        for n in self.store.names("data"):
            if n not in used:
                self.store.drop(f"data/{n}")

    def drop(self) -> None:
        self.store.drop()


def _bounds(chunk: str, w: Width) -> tuple[str, str]:
    """Start and end of a chunk by its name, as Spark writes times."""
    start = datetime.strptime(chunk, "%Y%m%dT%H%M%S")
    if w.months:
        years, month = divmod(start.month - 1 + w.months, 12)
        year = start.year + years
        end = start.replace(year=year, month=month + 1, day=min(start.day, calendar.monthrange(year, month + 1)[1]))
    else:
        end = start + timedelta(microseconds=w.micros)
    texts = (str(start), str(end))
    return tuple(t.rstrip("0") if "." in t else t for t in texts)


def _stamp(text: str) -> str:
    """A time as Spark writes it, so that texts compare as times do."""
    t = str(text).replace("T", " ")
    return t if len(t) > 10 else f"{t} 00:00:00"


def pretty_size(n: int) -> str:
    """Bytes in the largest unit below ten thousand."""
    for unit in ("bytes", "kB", "MB", "GB", "TB"):
        if n < 10240 or unit == "TB":
            return f"{n} {unit}"
        n = (n + 512) // 1024
    raise AssertionError


def route(batch: DataFrame, root: str, by: str) -> None:
    """Append rows to a folder with a partition for each value of a column, as one table for each would hold them."""
    batch.write.mode("append").partitionBy(by).parquet(root)
