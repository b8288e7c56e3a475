"""Questions to all other chunks about hashes, as packed arrays.

A chunk sends its distinct hashes, sorted, cut into buckets by their high bits: one row for each bucket. The task of a
bucket has all chunks' hashes of that range and answers each row with one bit for each hash, in the order in which
they came. So a hash moves in a few bytes, a hot hash comes once from each chunk, and no pairs are made.

A chunk sends to WAYS buckets at most, however many chunks there are. Beyond that many chunks a bucket is a relay: it joins
what each team of TEAM chunks sent, each hash once, and passes it on in finer buckets; answers go back the same way.
So messages are long and their number grows with the chunks, by WAYS each, and with their number squared only divided by TEAM.
"""

from __future__ import annotations

from collections.abc import Callable
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from tidegauge.llm._frames import written

#: Bytes of text in a chunk, and so of a task's working set.
CHUNK_BYTES = 8 << 20
#: Buckets that a chunk sends to, at most, and chunks whose messages a relay joins.
WAYS, TEAM = 2048, 1024
ASKED = "bucket int, run int, kind int, sent binary"
ANSWERED = "run int, bucket int, kind int, bits binary"


def buckets(h: np.ndarray, n: int) -> np.ndarray:
    """Bucket of each 64-bit hash; sorted hashes have sorted buckets."""
    return (((h >> np.uint64(32)) * np.uint64(n)) >> np.uint64(32)).astype(np.int64)


def cuts(h: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Buckets that sorted hashes fall in, and where each begins, with the end."""
    if not len(h):
        return np.zeros(0, np.int64), np.zeros(1, np.int64)
    b = buckets(h, n)
    first = np.concatenate([[0], np.flatnonzero(b[1:] != b[:-1]) + 1])
    return b[first], np.append(first, len(h))


def pack(x: np.ndarray, size: int) -> np.ndarray:
    """The low bytes of 64-bit numbers, a row each."""
    return np.ascontiguousarray(x.astype("<u8")).view(np.uint8).reshape(len(x), 8)[:, :size]


def unpack(raw: bytes, size: int, at: int, width: int) -> np.ndarray:
    """Numbers of so many bytes that begin at a byte of each record of the given width."""
    rows = np.frombuffer(raw, np.uint8).reshape(-1, width)
    out = np.zeros((len(rows), 8), np.uint8)
    out[:, :size] = rows[:, at : at + size]
    return out.view("<u8").reshape(-1)


def ask(run: int, kind: int, h: np.ndarray, records: np.ndarray, n: int) -> pa.Table:
    """Rows that send records of the sorted hashes h to their buckets."""
    b, edge = cuts(h, n)
    sent = [records[i:j].tobytes() for i, j in zip(edge[:-1], edge[1:], strict=True)] if len(b) else []
    return pa.table({"bucket": pa.array(b, pa.int32()), "run": pa.array(np.full(len(b), run), pa.int32()), "kind": pa.array(np.full(len(b), kind), pa.int32()), "sent": pa.array(sent, pa.binary())})


def answer_rows(asked: pa.Table, bits: list[np.ndarray]) -> pa.Table:
    """Rows that answer rows of one bucket."""
    return pa.table({"run": asked.column("run"), "bucket": asked.column("bucket"), "kind": asked.column("kind"), "bits": pa.array([np.packbits(b).tobytes() for b in bits], pa.binary())})


def heard(answers: pa.Table, kind: int, h: np.ndarray, n: int) -> np.ndarray:
    """The bit of each of the sorted hashes h, from the answers to their chunk."""
    got = {b: x for b, k, x in zip(answers.column("bucket").to_pylist(), answers.column("kind").to_pylist(), answers.column("bits").to_pylist(), strict=True) if k == kind}
    b, edge = cuts(h, n)
    out = np.zeros(len(h), bool)
    for x, i, j in zip(b.tolist(), edge[:-1].tolist(), edge[1:].tolist(), strict=True):
        out[i:j] = np.unpackbits(np.frombuffer(got[x], np.uint8), count=j - i).astype(bool)
    return out


class Records:
    """What relays must know of the records of a question. Each is an id, by which records are equal, and more.

    ids: of packed records, to be sorted; part: of sorted ids, a number below n that doesn't fall; join: one record for each
    distinct id, given all records in order of id and where each distinct one begins; bits: of the records of a team, in order of
    id and of chunk, given the answer to each one's id and whether it's the first of its id.
    """

    width: int

    def ids(self, raw: np.ndarray) -> np.ndarray:
        raise NotImplementedError

    def part(self, ids: np.ndarray, n: int, ways: int) -> np.ndarray:
        raise NotImplementedError

    def join(self, raw: np.ndarray, first: np.ndarray) -> np.ndarray:
        raise NotImplementedError

    def bits(self, answer: np.ndarray, is_first: np.ndarray) -> np.ndarray:
        raise NotImplementedError


def _gather(kind: Records, table: pa.Table):
    """Records of a team's messages in order of id and chunk, that order, and where each distinct id begins."""
    sent = table.column("sent").to_pylist()
    raw = np.frombuffer(b"".join(sent), np.uint8).reshape(-1, kind.width)
    size = np.array([len(x) // kind.width for x in sent], np.int64)
    ids = kind.ids(raw)
    order = np.lexsort((np.repeat(table.column("run").to_numpy(), size), ids))
    ids = ids[order]
    new = np.ones(len(ids), bool)
    new[1:] = ids[1:] != ids[:-1]
    return raw[order], ids, order, new, size


def _parts(kind: Records, ids: np.ndarray, parts: int, ways: int):
    p = kind.part(ids, parts, ways)
    first = np.concatenate([[0], np.flatnonzero(p[1:] != p[:-1]) + 1]) if len(p) else np.zeros(0, np.int64)
    return p[first] if len(p) else first, np.append(first, len(p))


def exchange(asked: DataFrame, chunks: int, kind: Records, answer: Callable, ways: int | None = None, team: int | None = None) -> DataFrame:
    """Answers to all rows that chunks sent with ask(); answer works on the rows of one bucket."""
    ways, team = ways or WAYS, team or TEAM
    if chunks <= ways:
        return asked.groupBy("bucket").applyInArrow(answer, ANSWERED)
    parts = -(-chunks // ways)
    teams = written(asked.withColumn("team", F.expr(f"CAST(run DIV {team} AS INT)")))

    def pass_on(key, table):
        raw, ids, _, new, _ = _gather(kind, table)
        first = np.flatnonzero(new)
        joined = kind.join(raw, first)
        p, edge = _parts(kind, ids[first], parts, ways)
        sent = [joined[i:j].tobytes() for i, j in zip(edge[:-1], edge[1:], strict=True)] if len(p) else []
        bucket, run = key[0].as_py(), key[1].as_py()
        return pa.table({"bucket": pa.array(bucket * parts + p, pa.int32()), "run": pa.array(np.full(len(p), run), pa.int32()), "kind": pa.array(np.full(len(p), 0), pa.int32()), "sent": pa.array(sent, pa.binary())})

    def give_back(key, table, answers):
        if not table.num_rows:
            return pa.table({c: pa.array([], t) for c, t in (("run", pa.int32()), ("bucket", pa.int32()), ("kind", pa.int32()), ("bits", pa.binary()))})
        _, ids, order, new, size = _gather(kind, table)
        first = np.flatnonzero(new)
        p, edge = _parts(kind, ids[first], parts, ways)
        got = dict(zip(answers.column("part").to_pylist(), answers.column("bits").to_pylist(), strict=True))
        bits = [np.unpackbits(np.frombuffer(got[x], np.uint8), count=j - i).astype(bool) for x, i, j in zip(p.tolist(), edge[:-1], edge[1:], strict=True)]
        said = np.concatenate(bits)[np.cumsum(new) - 1] if bits else np.zeros(0, bool)
        out = np.zeros(len(order), bool)
        out[order] = kind.bits(said, new)
        edge = np.concatenate([[0], np.cumsum(size)])
        return answer_rows(table, [out[i:j] for i, j in zip(edge[:-1], edge[1:], strict=True)])

    on = ("bucket", "team")
    finer = teams.groupBy(*on).applyInArrow(pass_on, ASKED).groupBy("bucket").applyInArrow(answer, ANSWERED)
    back = finer.select(F.expr(f"CAST(bucket DIV {parts} AS INT)").alias("bucket"), F.col("run").alias("team"), F.expr(f"bucket % {parts}").alias("part"), "bits")
    return teams.groupBy(*on).cogroup(back.groupBy(*on)).applyInArrow(give_back, ANSWERED)


@contextmanager
def tidy(spark: SparkSession):
    """Within it, shuffle files go as soon as the work that made them has been written."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    old = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.unset(key) if old is None else spark.conf.set(key, old)


def settled(df: DataFrame) -> DataFrame:
    """df, dealt by a key, computed now and kept in the shared folder; later work by that key finds it dealt already."""
    spark, key = df.sparkSession, "spark.sql.adaptive.enabled"
    old = spark.conf.get(key)
    spark.conf.set(key, "false")  # an adaptive plan doesn't say how its rows are dealt
    try:
        return written(df)
    finally:
        spark.conf.set(key, old)
