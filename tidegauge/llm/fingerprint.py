"""Exact fingerprints of canonical texts.

A text is made canonical (Unicode compatibility composition, case folding, runs of white space as one space, none at the
ends) and digested with 128-bit xxhash. Texts of equal digests are compared byte by byte; should they differ, the
fingerprints of all but the first in byte order get the number of the text as a suffix, so that equal fingerprints always mean
equal canonical texts.
"""

from __future__ import annotations

import hashlib
import unicodedata
import zlib

import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from tidegauge.llm._exchange import tidy
from tidegauge.llm._frames import add_columns, spread, written
from tidegauge.llm._order import order_key

#: Bytes of text in a partition of neighbouring ids, about; they are streamed, so this bounds no memory.
RUN_BYTES = 32 << 20


def canonical(text: str) -> str:
    """The text as it is compared."""
    t = unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", text).casefold())
    return " ".join(t.split())


def digest(text: str) -> str:
    return xxhash.xxh3_128_hexdigest(canonical(text).encode("utf-8", "surrogatepass"))


def _digests(texts: pa.Array) -> list[pa.Array]:
    return [pa.array([digest(t or "") for t in texts.to_pylist()], pa.string())]


def settle(rows: DataFrame, digest_col: str, text_col: str) -> DataFrame:
    """rows with digests made unequal where the canonical texts (bytes, plain or packed alike; null if no other row has the digest) differ.

    Least and greatest text of each digest are taken on both sides of the shuffle, so copies don't meet in one task.
    """
    ends = rows.where(F.col(text_col).isNotNull()).groupBy(digest_col).agg(F.min(text_col).alias("lo"), F.max(text_col).alias("hi"))
    differ = written(ends.where(F.col("lo") != F.col("hi")).select(digest_col))
    if differ.isEmpty():
        return rows
    texts = rows.join(differ, digest_col, "left_semi").select(digest_col, text_col).distinct()
    number = F.dense_rank().over(Window.partitionBy(digest_col).orderBy(text_col)) - 1
    ranks = texts.select(F.col(digest_col).alias("__d"), F.col(text_col).alias("__t"), number.alias("__n"))
    joined = rows.join(ranks, (rows[digest_col] == ranks["__d"]) & (rows[text_col] == ranks["__t"]), "left")
    fixed = F.when(F.col("__n") > 0, F.concat_ws("-", digest_col, F.col("__n").cast("string"))).otherwise(F.col(digest_col))
    return joined.withColumn(digest_col, fixed).drop("__d", "__t", "__n")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs' ids with the fingerprint of each text (null: as empty); texts of shared digests are compared.

    Repeated rows have a row each, an empty table none; other columns aren't read. A text of any length is canonical as a whole.
    """
    with_d = add_columns(docs.select(id_col, text_col), [text_col], "fingerprint string", lambda: _digests)
    shared = written(with_d.groupBy("fingerprint").count().where("count > 1").select("fingerprint"))
    both = with_d.join(spread(shared.withColumn("__shared", F.lit(True))), "fingerprint", "left")

    def make():
        def f(texts, flags):
            return [pa.array([canonical(t or "").encode("utf-8", "surrogatepass") if s else None for t, s in zip(texts.to_pylist(), flags.to_pylist(), strict=True)], pa.binary())]

        return f

    full = add_columns(both, [text_col, "__shared"], "__canonical binary", make, drop=(text_col, "__shared"))
    return settle(full, "fingerprint", "__canonical").select(id_col, "fingerprint")


_EDITED = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, canonical binary"
_ROW, _HEAD, _TAIL = 0, 1, 2


def _finish(doc, text: str, nxt: str, keep: bool) -> tuple:
    """A document beside the next one; its canonical text is kept, packed, if another document has its digest."""
    n = len(text)
    q = n // 4
    edited = text[: n - q] + nxt[:q]
    a, b, c = canonical(text), canonical(edited), canonical(nxt)
    raw = a.encode("utf-8", "surrogatepass")
    da = xxhash.xxh3_128_hexdigest(raw)
    db = da if a == b else xxhash.xxh3_128_hexdigest(b.encode("utf-8", "surrogatepass"))
    packed = zlib.compress(raw, 1) if keep else None  # equal if and only if the texts are
    return doc, n, hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest(), da, db, float(a == b), float(a == c), packed


_KINDS = {"doc_id": pa.int64(), "n_chars": pa.int64(), "edited_sha256": pa.string(), "fingerprint": pa.string(), "edited_fingerprint": pa.string(), "near_edited": pa.float64(), "near_next": pa.float64(), "canonical": pa.binary()}
_EDGES = {"part": pa.int32(), "edge": pa.int32(), "shared": pa.bool_(), "text": pa.string()}


def _batch(rows: list[tuple], kinds: dict) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds.values(), strict=True)], names=list(kinds))


def _edit(batches):
    """Rows of a partition in order, the mark of a shared digest before its row: each document beside the next one.

    The first and the last document come out as they are, to be put beside those of other partitions.
    """
    part, kinds = TaskContext.get().partitionId(), _KINDS | _EDGES
    held = mark = None
    out, size = [], 0
    none = (None,) * len(_KINDS)
    for b in batches:
        for key, h, doc, flag, text in zip(*(b.column(c).to_pylist() for c in ("ord", "h", "id", "flag", "text")), strict=True):
            if flag:
                mark = (key, h)
                continue
            text = text or ""
            if held is None:
                out.append((*none, part, _HEAD, False, text))
            else:
                out.append((*_finish(*held[:2], text, held[2]), part, _ROW, False, None))
                size += len(out[-1][len(_KINDS) - 1] or b"") + 300
            held = (doc, text, mark == (key, h))
            if size > 4 << 20:
                yield _batch(out, kinds)
                out, size = [], 0
    if held is not None:
        out.append((held[0], *none[1:], part, _TAIL, held[2], held[1]))
        yield _batch(out, kinds)


def _edit_pairs(batches):
    for b in batches:
        if b.num_rows:
            yield _batch([_finish(d, t or "", n or "", s) for d, t, n, s in zip(*(b.column(c).to_pylist() for c in ("doc_id", "text", "next", "shared")), strict=True)], _KINDS)


def edit_report(docs: DataFrame) -> DataFrame:
    """Fingerprints of every document and of its edit with the start of the next document, and whether they agree.

    Likeness of exact fingerprints is 1 where they are equal and 0 elsewhere. Documents are sorted by id in ranges; each
    range's last one goes along with the next range's first. Null ids come first, by a hash of the text; so do rows of equal ids. A
    single document is its own next; an empty table gives no rows; other columns aren't read.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("id"), "text").withColumns({"ord": order_key("id", "text"), "h": F.xxhash64("text")})
    with tidy(docs.sparkSession):
        return _edit_report(docs)


def _edit_report(docs: DataFrame) -> DataFrame:
    spark = docs.sparkSession
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(2 * spark.sparkContext.defaultParallelism, size // RUN_BYTES)
    digests = written(add_columns(docs, ["text"], "fingerprint string", lambda: _digests, drop=("text",)))
    repeated = digests.groupBy("fingerprint").count().where("count > 1").select("fingerprint")
    flags = digests.join(spread(repeated), "fingerprint", "left_semi").select("ord", "h", "id", F.lit(True).alias("flag"), F.lit(None).cast("string").alias("text"))
    rows = docs.select("ord", "h", "id", F.lit(False).alias("flag"), "text").unionByName(flags)
    rows = rows.repartitionByRange(n, "ord", "h").sortWithinPartitions("ord", "h", F.col("flag").desc(), "text")
    done = written(rows.mapInArrow(_edit, f"{_EDITED}, part int, edge int, shared boolean, text string"))
    heads = done.where(F.col("edge") == _HEAD).select("part", F.col("text").alias("next"))
    # one number for each partition that has rows
    parts = sorted(r["part"] for r in heads.select("part").collect())
    after = spark.createDataFrame(list(zip(parts, parts[1:] + parts[:1], strict=True)), "own int, part int")
    ends = done.where(F.col("edge") == _TAIL).select("doc_id", "text", "shared", F.col("part").alias("own")).join(after, "own").join(heads, "part")
    ends = ends.select("doc_id", "text", "next", "shared").mapInArrow(_edit_pairs, _EDITED)
    every = done.where(F.col("edge") == _ROW).select(*_KINDS).unionByName(ends)
    # a document's own name, should its digest have had to be told apart, is also that of an edit that changes nothing
    fixed = settle(every, "fingerprint", "canonical").drop("canonical")
    return fixed.withColumn("edited_fingerprint", F.when(F.col("near_edited") == 1, F.col("fingerprint")).otherwise(F.col("edited_fingerprint")))
