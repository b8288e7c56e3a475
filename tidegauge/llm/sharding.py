"""Contiguous shards of near equal bytes, from global prefix sums.

Rows are put into one global order, by the digest of the text and then by id, so that equal texts stand together. Each
partition of that order reports its totals; their prefix sums give every partition its offset, and a row's shard is
where its offset falls among equal targets. Only the totals, one row for each partition, reach the driver.

A group of equal texts is kept in one shard up to `keep` of a shard's target; what is beyond that is dealt on by its own
offset. So no shard is off its target by more than `keep` of it and one row, whatever the groups.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from tidegauge.llm._frames import written

SHARDS = 24
#: Hundredths of a shard's target up to which equal texts stay together.
KEEP = 5


def _groups(h: pa.Array) -> np.ndarray:
    """Rows of a batch at which another text begins, the first row included."""
    if not len(h):
        return np.zeros(0, np.int64)
    if len(h) == 1:
        return np.zeros(1, np.int64)
    changed = pc.not_equal(h.slice(1), h.slice(0, len(h) - 1)).to_numpy(zero_copy_only=False)
    return np.concatenate([[0], np.flatnonzero(changed) + 1])


def _totals(batches):
    n = size = tail = 0
    first = last = None
    for b in batches:
        if not b.num_rows:
            continue
        h, s = b.column("h"), b.column("size").to_numpy()
        starts = _groups(h)
        first = h[0].as_py() if first is None else first
        sums = np.add.reduceat(s, starts)
        tail = int(sums[-1]) + (tail if len(starts) == 1 and h[0].as_py() == last else 0)
        last, n, size = h[-1].as_py(), n + b.num_rows, size + int(s.sum())
    if n:
        yield pa.RecordBatch.from_pydict({"part": [TaskContext.get().partitionId()], "n": [n], "size": [size], "first": [first], "last": [last], "tail": [tail]})


def shards(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n_shards: int = SHARDS, keep: int = KEEP) -> DataFrame:
    """id, size, text_crc32, shard and slot of every row of docs.

    Size is the UTF-8 bytes of the text, none for null, plus 8. Repeated rows count each for itself, null ids come
    first among equal texts, an empty table gives no rows. Other columns of docs are not read.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col), (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.md5(text).alias("h"))
    rows = written(rows.repartitionByRange("h", id_col).sortWithinPartitions("h", id_col))
    parts = sorted(rows.mapInArrow(_totals, "part long, n long, size long, first string, last string, tail long").collect())
    total = sum(p["size"] for p in parts)
    before, n_before, offset, opened, group = {}, 0, 0, None, 0
    for p in parts:
        group = group if p["first"] == opened else offset
        before[p["part"]] = (n_before, offset, opened, group)
        group = group if p["first"] == p["last"] else offset + p["size"] - p["tail"]
        n_before, offset, opened = n_before + p["n"], offset + p["size"], p["last"]
    slack = total * keep // (100 * n_shards)

    def place(batches):
        n, at, h_open, start = before.get(TaskContext.get().partitionId(), (0, 0, None, 0))
        for b in batches:
            if not b.num_rows:
                continue
            h, s = b.column("h"), b.column("size").to_numpy()
            begins = _groups(h)
            off = at + np.concatenate([[0], np.cumsum(s)[:-1]])
            own = off[begins]
            if h[0].as_py() == h_open:
                own[0] = start
            of = np.repeat(own, np.diff(np.append(begins, len(s))))
            shard = np.maximum(of, off - slack) * n_shards // total
            index = n + np.arange(len(s))
            n, at, h_open, start = n + len(s), int(off[-1] + s[-1]), h[-1].as_py(), int(own[-1])
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in (id_col, "size", "text_crc32")), pa.array(shard, pa.int32()), pa.array(index, pa.int64())], names=[id_col, "size", "text_crc32", "shard", "row"])

    kind = docs.schema[id_col].dataType.simpleString()
    placed = rows.mapInArrow(place, f"`{id_col}` {kind}, size long, text_crc32 long, shard int, row long")
    begin = {r["shard"]: r["row"] for r in placed.groupBy("shard").agg(F.min("row").alias("row")).collect()}
    first = F.element_at(F.lit([begin.get(i, 0) for i in range(n_shards)]), F.col("shard") + 1)
    return placed.select(id_col, "size", "text_crc32", "shard", (F.col("row") - first).cast("long").alias("slot"))


def shard_report(docs: DataFrame) -> DataFrame:
    """Shards 0 to 23 of all documents under the law that sizes are near equal."""
    placed = shards(docs)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


# CRC-32 by nibbles, the low one of each byte first; its table of 16 is made from the polynomial.
ORACLE = """
WITH t AS (SELECT list_transform(range(16), lambda n: list_reduce([n, 0, 0, 0, 0], lambda c, z: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END)) AS tab),
b AS (SELECT doc_id, coalesce(text, '') AS text, strlen(coalesce(text, '')) + 8 AS size, md5(coalesce(text, '')) AS h FROM documents),
c AS (SELECT *, string_split(hex(encode(text)), '') AS x FROM b),
crc AS (SELECT c.*, xor(4294967295, list_reduce(list_concat([4294967295::BIGINT], list_transform(range(2 * (size - 8)), lambda i: (strpos('0123456789ABCDEF', x[(xor(i, 1) + 1)::BIGINT]) - 1)::BIGINT)),
  lambda a, v: xor(a // 16, tab[xor(a % 16, v) + 1]))) AS text_crc32 FROM c, t),
o AS (SELECT *, sum(size) OVER (ORDER BY h, doc_id NULLS FIRST ROWS UNBOUNDED PRECEDING) - size AS off, row_number() OVER (ORDER BY h, doc_id NULLS FIRST) AS row, sum(size) OVER () AS total FROM crc),
s AS (SELECT *, (greatest(min(off) OVER (PARTITION BY h), off - total * 5 // 2400) * 24 // total)::INTEGER AS shard FROM o)
SELECT doc_id, size::BIGINT AS size, text_crc32::BIGINT AS text_crc32, 'bytes' AS law, shard, (row - min(row) OVER (PARTITION BY shard))::BIGINT AS slot, NULL::INTEGER AS grown_shard FROM s
"""
