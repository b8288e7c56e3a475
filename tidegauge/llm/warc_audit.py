"""Fixity audit of WARC replicas by Merkle trees.

Every record is a leaf: the digest of its bytes with its range of offsets. FAN neighbouring ranges of a file in order of offset make
a node over their joint range, and so on up to the file's root. Two replicas are compared at their roots; where these differ the
children are compared, and so down to records. Of a file that agrees nothing but the root is looked at.

Trees are frames of (file, level, idx, start, stop, hash); a level is one aggregation of the level below by groups of FAN rows.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from tidegauge.llm._frames import written

#: Children of a node.
FAN = 16
#: Page ids that share a file.
PER_FILE = 1000

_HEAD = ("WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:", ">\r\nWARC-Target-URI: ", "\r\nContent-Type: text/html\r\nContent-Length: ", "\r\n\r\n")
_END = "\r\n\r\n"


def record(id_: Column, url: Column, html: Column) -> Column:
    """The text of a page's record; null fields are empty."""
    body = F.coalesce(html, F.lit(""))
    size = F.octet_length(body).cast("string")
    return F.concat(F.lit(_HEAD[0]), F.coalesce(id_.cast("string"), F.lit("")), F.lit(_HEAD[1]), F.coalesce(url, F.lit("")), F.lit(_HEAD[2]), size, F.lit(_HEAD[3]), body, F.lit(_END))


def lay_out(records: DataFrame) -> DataFrame:
    """An index of files from (file, record_id, content): idx, start and stop in bytes, and digest; records stand in order of id and content.

    Records of one id in one file are told apart by number: id, id#2, and so on.
    """
    own = records.select("file", "record_id", F.octet_length("content").cast("long").alias("size"), F.sha2(F.col("content").cast("binary"), 256).alias("digest"))
    order = Window.partitionBy("file").orderBy("record_id", "digest")
    stop = F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0))
    again = F.row_number().over(Window.partitionBy("file", "record_id").orderBy("digest"))
    d = own.withColumns({"idx": F.row_number().over(order) - 1, "stop": stop, "again": again})
    name = F.when(F.col("again") > 1, F.concat_ws("#", F.col("record_id").cast("string"), F.col("again").cast("string"))).otherwise(F.coalesce(F.col("record_id").cast("string"), F.lit("")))
    return d.select("file", name.alias("name"), "record_id", F.col("idx").cast("long").alias("idx"), (F.col("stop") - F.col("size")).alias("start"), "stop", "digest")


def levels_for(*indexes: DataFrame) -> int:
    """Levels that the largest file of the indexes needs, leaves not counted."""
    most = max([r or 0 for i in indexes for r in i.agg(F.max("idx")).first()] or [0])
    n, size = 0, most + 1
    while size > 1:
        size, n = -(-size // FAN), n + 1
    return n


def tree(index: DataFrame, levels: int) -> list[DataFrame]:
    """Nodes of each level, leaves first."""
    out = [index.select("file", "idx", "start", "stop", F.col("digest").alias("hash"))]
    for _ in range(levels):
        kids = F.array_sort(F.collect_list(F.struct("idx", "start", "stop", "hash")))
        said = F.array_join(F.transform(kids, lambda k: F.concat_ws(":", k["start"].cast("string"), k["stop"].cast("string"), k["hash"])), ",")
        up = out[-1].groupBy("file", F.floor(F.col("idx") / FAN).alias("idx")).agg(F.min("start").alias("start"), F.max("stop").alias("stop"), F.sha2(said, 256).alias("hash"))
        out.append(written(up))
    return out


def _differ(a: DataFrame, b: DataFrame) -> DataFrame:
    """file and idx of nodes of one level that don't agree."""
    y = b.select("file", "idx", F.struct("start", "stop", "hash").alias("y"))
    return a.select("file", "idx", F.struct("start", "stop", "hash").alias("x")).join(y, ["file", "idx"], "full").where(~F.col("x").eqNullSafe(F.col("y"))).select("file", "idx")


def descend(a: list[DataFrame], b: list[DataFrame]) -> DataFrame:
    """file and idx of the leaves that don't agree, found from the roots down by mismatching branches only."""
    bad = _differ(a[-1], b[-1])
    for x, y in list(zip(a, b, strict=True))[-2::-1]:
        under = bad.select("file", F.col("idx").alias("up"))
        x, y = (d.withColumn("up", F.floor(F.col("idx") / FAN)).join(under, ["file", "up"], "left_semi") for d in (x, y))
        bad = _differ(x, y)
    return bad


def audit(a: DataFrame, b: DataFrame) -> DataFrame:
    """Records that replica b of the files hasn't as a has them: file, name, status and the ranges in both.

    a and b are indexes from lay_out. Status is changed (other bytes), missing, extra, or moved (the same bytes elsewhere in the
    file). A file that only one replica has counts with all its records. Equal replicas give no rows, as empty ones do.
    """
    a, b = written(a), written(b)
    n = levels_for(a, b)
    bad = written(descend(tree(a, n), tree(b, n)))
    x, y = (d.join(bad, ["file", "idx"], "left_semi") for d in (a, b))
    x = x.select("file", "name", F.struct("start", "stop", "digest").alias("x"))
    both = x.join(y.select("file", "name", F.struct("start", "stop", "digest").alias("y")), ["file", "name"], "full")
    status = F.when(F.col("y").isNull(), "missing").when(F.col("x").isNull(), "extra").when(F.col("x.digest") != F.col("y.digest"), "changed").otherwise("moved")
    return both.select("file", "name", status.alias("status"), F.col("x.start").alias("start"), F.col("x.stop").alias("stop"), F.col("y.start").alias("replica_start"), F.col("y.stop").alias("replica_stop"))


def page_records(pages: DataFrame) -> DataFrame:
    """Records of pages, PER_FILE neighbouring ids to a file; a null id goes to file -1."""
    file = F.coalesce(F.floor(F.col("page_id") / PER_FILE), F.lit(-1)).cast("long")
    return pages.select(file.alias("file"), F.col("page_id").alias("record_id"), record(F.col("page_id"), F.col("url"), F.col("html")).alias("content"))


def damaged(records: DataFrame) -> DataFrame:
    """A replica with damage by rule: of ids that leave 5 of 97 the first letter of the record is another, of 7 of 193 the end is cut, of 11 of 389 the record is lost."""
    i, c = F.coalesce(F.col("record_id"), F.lit(0)), F.col("content")
    out = F.when(F.pmod(i, F.lit(97)) == 5, F.concat(F.lit("X"), F.substring(c, 2, 2**31 - 1))).when(F.pmod(i, F.lit(193)) == 7, F.rtrim(c, F.lit("\r\n"))).otherwise(c)
    return records.where(F.pmod(i, F.lit(389)) != 11).withColumn("content", out)


def audit_report(pages: DataFrame) -> DataFrame:
    """Each page's record in the archive and what the audit says of it in a replica that is damaged by rule."""
    records = page_records(pages.select("page_id", "url", "html"))
    index = written(lay_out(records))
    found = audit(index, lay_out(damaged(records)))
    got = index.join(found.select("file", "name", "status"), ["file", "name"], "left")
    return got.select(F.col("record_id").alias("page_id"), "file", F.col("start").alias("record_offset"), (F.col("stop") - F.col("start")).alias("record_length"), "digest", F.coalesce("status", F.lit("ok")).alias("status"))


def parse(content: bytes) -> Iterator[tuple[int, int, str, bytes]]:
    """Offset, length, record id and all bytes of each record of an uncompressed WARC file; what can't be read ends it as one last record without an id."""
    at = 0
    while at < len(content):
        head = content.find(b"\r\n\r\n", at)
        fields = {}
        if head >= 0 and content.startswith(b"WARC/", at):
            fields = {k.strip().lower(): v.strip() for k, _, v in (line.partition(b":") for line in content[at:head].split(b"\r\n")[1:])}
        size = fields.get(b"content-length", b"")
        end = head + 4 + int(size) + 4 if size.isdigit() else -1
        if end < 0 or content[end - 4 : end] != b"\r\n\r\n":
            yield at, len(content) - at, "", content[at:]
            return
        yield at, end - at, fields.get(b"warc-record-id", b"").decode("utf-8", "replace").strip("<>"), content[at:end]
        at = end


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """An index of the WARC files in a folder; a file is read by one task and must fit in its memory."""
    import hashlib

    files = spark.read.format("binaryFile").load(path).select(F.element_at(F.split("path", "/"), -1).alias("file"), "content")

    def f(frames):
        import pandas as pd

        for pdf in frames:
            rows = []
            for name, content in zip(pdf["file"], pdf["content"], strict=True):
                seen: dict[str, int] = {}
                for n, (at, size, id_, raw) in enumerate(parse(bytes(content))):
                    seen[id_] = seen.get(id_, 0) + 1
                    rows.append((name, id_ if seen[id_] == 1 else f"{id_}#{seen[id_]}", n, at, at + size, hashlib.sha256(raw).hexdigest()))
            yield pd.DataFrame(rows, columns=["file", "name", "idx", "start", "stop", "digest"])

    return files.mapInPandas(f, "file string, name string, idx long, start long, stop long, digest string")


ORACLE = r"""
WITH p AS (SELECT page_id, page_id // 1000 AS file, 'WARC/1.0' || chr(13) || chr(10) || 'WARC-Type: response' || chr(13) || chr(10) || 'WARC-Record-ID: <urn:page:' || page_id || '>' || chr(13) || chr(10) || 'WARC-Target-URI: ' || coalesce(url, '') || chr(13) || chr(10)
  || 'Content-Type: text/html' || chr(13) || chr(10) || 'Content-Length: ' || strlen(coalesce(html, '')) || chr(13) || chr(10) || chr(13) || chr(10) || coalesce(html, '') || chr(13) || chr(10) || chr(13) || chr(10) AS c FROM pages),
a AS (SELECT page_id, file, strlen(c) AS n, sum(strlen(c)) OVER (PARTITION BY file ORDER BY page_id) - strlen(c) AS start, sha256(c) AS digest FROM p),
d AS (SELECT page_id, file, CASE WHEN page_id % 97 = 5 THEN 'X' || c[2:] WHEN page_id % 193 = 7 THEN rtrim(c, chr(13) || chr(10)) ELSE c END AS c FROM p WHERE page_id % 389 <> 11),
b AS (SELECT page_id, sum(strlen(c)) OVER (PARTITION BY file ORDER BY page_id) - strlen(c) AS start, sha256(c) AS digest FROM d)
SELECT a.page_id, a.file::BIGINT AS file, a.start::BIGINT AS record_offset, a.n::BIGINT AS record_length, a.digest,
CASE WHEN b.page_id IS NULL THEN 'missing' WHEN a.digest <> b.digest THEN 'changed' WHEN a.start <> b.start THEN 'moved' ELSE 'ok' END AS status
FROM a LEFT JOIN b ON a.page_id = b.page_id
"""
