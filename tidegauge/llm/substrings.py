"""Removal of repeated word sequences by fixed-block anchors.

Each document is cut into blocks of BLOCK words that don't overlap; these are the index. Every rolling window of BLOCK
words is a probe. A sequence of SPAN = 2 * BLOCK words that stands in two places holds, in either, a whole block of that place, and
the other place has a probe that meets it. So all places of repeated sequences lie around hits. There, windows of SPAN
words are compared among all documents by 96-bit hashes, and each but the first is a repeat; windows that
overlap extend to maximal repeats.

Documents stand in chunks of neighbouring ids and of about as many bytes. Both questions (which windows meet a block, which
sequences stand earlier) are asked with packed hashes; see _exchange. Texts are dealt to chunks once and kept so in the shared folder.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tidegauge.llm import _exchange as X
from tidegauge.llm._frames import trim, written
from tidegauge.llm._order import cut_points, order_key, run_of
from tidegauge.llm._text import NOT_SPACE, grams, join_words, mix, slices, tokenise, within

BLOCK = 10
SPAN = 2 * BLOCK
#: Bits of a hash, beside its bucket, by which a window meets a block; a false meeting only costs work.
_BITS = 38


class _Probes(X.Records):
    """Hashes of windows with whether they stand more than once and whether they are a block's."""

    width = 5

    def ids(self, raw):
        wide = np.zeros((len(raw), 8), np.uint8)
        wide[:, :5] = raw
        return wide.view("<u8").reshape(-1) >> np.uint64(2)

    def part(self, ids, n, ways):
        return ((ids >> np.uint64(_BITS - 32)) * np.uint64(n) >> np.uint64(32)).astype(np.int64)

    def join(self, raw, first):
        flags = raw[:, 0] & 3
        each = np.diff(np.append(first, len(raw)))
        out = raw[first].copy()
        out[:, 0] = (out[:, 0] & 0xFC) | np.bitwise_or.reduceat(flags, first) | np.where(each > 1, 2, 0).astype(np.uint8) if len(first) else 0
        return out

    def bits(self, answer, is_first):
        return answer


class _Spans(X.Records):
    """96-bit hashes of sequences; what isn't the first of its team is later whatever the others say."""

    width = 12

    def ids(self, raw):
        return np.ascontiguousarray(raw).view([("k", "<u8"), ("m", "<u4")]).reshape(-1)

    def part(self, ids, n, ways):
        rest = (ids["k"] >> np.uint64(32)) * np.uint64(ways) & np.uint64(0xFFFFFFFF)
        return (rest * np.uint64(n) >> np.uint64(32)).astype(np.int64)

    def join(self, raw, first):
        return raw[first]

    def bits(self, answer, is_first):
        return answer | ~is_first


class _Chunk:
    """Words of the documents of one chunk in order of id."""

    def __init__(self, table: pa.Table):
        trim()  # what the chunk before has left
        table = table.sort_by([("ord", "ascending"), ("text", "ascending")]) if table.num_rows > 1 else table
        self.ids, self.texts = table.column("id"), table.column("text")
        parts = []
        for _, _, data, offsets in slices(self.texts):
            t = tokenise(data, offsets, NOT_SPACE)
            parts.append((t.hashes(), np.diff(t.first)))
        self.words = np.concatenate([p[0] for p in parts]) if parts else np.zeros(0, np.uint64)
        self.first = np.concatenate([[0], *[p[1] for p in parts]]).astype(np.int64).cumsum()

    def probes(self):
        """Places of all windows of BLOCK words, their distinct hashes with where each place's is, and whether it's often or a block's."""
        at = np.flatnonzero(within(self.first, BLOCK))
        h, inverse, count = np.unique(grams(self.words, BLOCK)[at], return_inverse=True, return_counts=True)
        doc = np.searchsorted(self.first, at, "right") - 1
        is_block = np.zeros(len(h), bool)
        is_block[inverse[(at - self.first[doc]) % BLOCK == 0]] = True
        return at, h, inverse, count > 1, is_block

    def spans(self, hit: np.ndarray):
        """Places of windows of SPAN words that hold a hit, and their distinct hashes with where each place's is and its first place."""
        near = np.zeros(len(self.words) + 1, bool)
        for o in range(SPAN - BLOCK + 1):
            near[hit[hit >= o] - o] = True
        ok = within(self.first, SPAN)
        at = np.flatnonzero(ok & near[: len(ok)])
        key = grams(self.words, SPAN)[at]
        more = grams(mix(self.words, 9), SPAN)[at] & np.uint64(0xFFFFFFFF)
        order = np.lexsort((at, more, key))
        k, m = key[order], more[order]
        new = np.ones(len(k), bool)
        new[1:] = (k[1:] != k[:-1]) | (m[1:] != m[:-1])
        inverse = np.empty(len(k), np.int64)
        inverse[order] = np.cumsum(new) - 1
        return at, k[new], m[new], inverse, at[order][new]


def _probe(n: int):
    def f(key, table):
        c = _Chunk(table)
        _, h, _, often, is_block = c.probes()
        code = ((h & np.uint64((1 << _BITS) - 1)) << np.uint64(2)) | (often.astype(np.uint64) << np.uint64(1)) | is_block.astype(np.uint64)
        return X.ask(key[0].as_py(), 0, h, X.pack(code, 5), n)

    return f


def _meet(key, table):
    """Which hashes stand in more than one place, one of them a block."""
    trim()
    sent = table.column("sent").to_pylist()
    code = [X.unpack(x, 5, 0, 5) for x in sent]
    size = np.cumsum([0, *map(len, code)])
    every = np.concatenate(code)
    h, inverse, count = np.unique(every >> np.uint64(2), return_inverse=True, return_counts=True)
    often, block = count > 1, np.zeros(len(h), bool)
    often[inverse[(every & np.uint64(2)) > 0]] = True
    block[inverse[(every & np.uint64(1)) > 0]] = True
    met = (often & block)[inverse]
    return X.answer_rows(table, [met[i:j] for i, j in zip(size[:-1], size[1:], strict=True)])


def _hits(c: _Chunk, answers: pa.Table, n: int) -> np.ndarray:
    at, h, inverse, _, _ = c.probes()
    return at[X.heard(answers, 0, h, n)[inverse]]


def _compare(n: int):
    def f(key, table, answers):
        if not table.num_rows:
            return X.ask(0, 1, np.zeros(0, np.uint64), np.zeros((0, 12), np.uint8), n)
        c = _Chunk(table)
        _, k, m, _, _ = c.spans(_hits(c, answers, n))
        return X.ask(key[0].as_py(), 1, k, np.hstack([X.pack(k, 8), X.pack(m, 4)]), n)

    return f


def _earlier(key, table):
    """Which sequences stand in a chunk before."""
    trim()
    sent, run = table.column("sent").to_pylist(), table.column("run").to_numpy()
    size = np.array([len(x) // 12 for x in sent])
    k = np.concatenate([X.unpack(x, 8, 0, 12) for x in sent])
    m = np.concatenate([X.unpack(x, 4, 8, 12) for x in sent])
    r = np.repeat(run, size)
    order = np.lexsort((r, m, k))
    same = np.zeros(len(k), bool)
    same[1:] = (k[order][1:] == k[order][:-1]) & (m[order][1:] == m[order][:-1])
    later = np.zeros(len(k), bool)
    later[order] = same
    edge = np.concatenate([[0], np.cumsum(size)])
    return X.answer_rows(table, [later[i:j] for i, j in zip(edge[:-1], edge[1:], strict=True)])


_OUT = (("id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept", pa.string()), ("kept_sha256", pa.string()))


def _remove(n: int, with_text: bool):
    def f(key, table, answers):
        if not table.num_rows:
            return pa.schema(_OUT).empty_table()
        c = _Chunk(table)
        at, k, _, inverse, first = c.spans(_hits(c, answers, n))
        cover = np.zeros(len(c.words) + 1, np.int64)
        cover[at[X.heard(answers, 1, k, n)[inverse] | (at != first[inverse])]] = 1
        near = np.concatenate([[0], np.cumsum(cover)])
        w = np.arange(len(c.words))
        gone = near[w + 1] - near[np.maximum(w - SPAN + 1, 0)] > 0
        total = np.concatenate([[0], np.cumsum(gone)])
        removed = total[c.first[1:]] - total[c.first[:-1]]
        kept, digest = [], []
        for i, j, data, offsets in slices(c.texts):
            t = tokenise(data, offsets, NOT_SPACE)
            keep = ~gone[c.first[i] : c.first[j]]
            for d in range(j - i):
                text = join_words(t, keep, d)
                digest.append(hashlib.sha256(text).hexdigest())
                kept.append(text.decode("utf-8", "replace") if with_text else None)
        return pa.table({"id": c.ids.cast(pa.int64()), "n_words": np.diff(c.first), "n_removed": removed, "kept": pa.array(kept, pa.string()), "kept_sha256": pa.array(digest, pa.string())}, schema=pa.schema(_OUT))

    return f


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_text: bool = True, chunk_bytes: int = X.CHUNK_BYTES, ways: int | None = None, team: int | None = None) -> DataFrame:
    """id (an integer), n_words, n_removed, kept text (null unless with_text) and its SHA-256 for every row of docs.

    A word goes if a window of SPAN words over it stands earlier, in a document of a smaller id or before in its own;
    windows are judged on the input. A null or empty text has no words. Null ids come first, by a hash of their texts; rows
    of equal ids are in order of text, so of repeated rows the first keeps its words. Texts of fewer words than SPAN lose
    none. An empty table gives no rows; other columns aren't read. Rows of one id stand in one chunk, as does a text of any
    length, so these should fit into a task. ways and team are those of _exchange.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).withColumn("ord", order_key("id", "text"))
    cuts = cut_points(docs.select("ord", F.octet_length("text").alias("size")), "ord", "size", chunk_bytes)
    n = len(cuts) + 1
    ways = min(n, X.WAYS if ways is None else ways)
    with X.tidy(docs.sparkSession):
        chunks = X.settled(docs.select(run_of(F.col("ord"), cuts).cast("int").alias("run"), "ord", "id", "text").repartition(2 * n, "run")).groupBy("run")
        met = written(X.exchange(chunks.applyInArrow(_probe(ways), X.ASKED), n, _Probes(), _meet, ways, team))
        later = written(X.exchange(chunks.cogroup(met.groupBy("run")).applyInArrow(_compare(ways), X.ASKED), n, _Spans(), _earlier, ways, team))
    out = "id long, n_words long, n_removed long, kept string, kept_sha256 string"
    return chunks.cogroup(met.unionByName(later).groupBy("run")).applyInArrow(_remove(ways, with_text), out)


def repeat_report(docs: DataFrame) -> DataFrame:
    """Per document: words, removed words, and the digest of the kept ones."""
    return remove_repeats(docs, with_text=False).select(F.col("id").alias("doc_id"), "n_words", "n_removed", "kept_sha256")


ORACLE = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, p, md5(array_to_string(list_slice(w, p, p + 19), ' ')) AS h FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS p FROM d WHERE len(w) >= 20)),
r AS (SELECT doc_id, p FROM (SELECT doc_id, p, row_number() OVER (PARTITION BY h ORDER BY doc_id, p) AS n FROM s) WHERE n > 1),
g AS (SELECT DISTINCT doc_id, unnest(range(p, p + 20)) AS i FROM r),
x AS (SELECT doc_id, list(i) AS gone FROM g GROUP BY doc_id),
t AS (SELECT d.doc_id, len(w) AS n_words, coalesce(len(gone), 0) AS n_removed, CASE WHEN gone IS NULL THEN w ELSE [w[i] FOR i IN range(1, len(w) + 1) IF NOT list_contains(gone, i)] END AS kept FROM d LEFT JOIN x ON d.doc_id = x.doc_id)
SELECT doc_id, n_words::BIGINT AS n_words, n_removed::BIGINT AS n_removed, sha256(coalesce(array_to_string(kept, ' '), '')) AS kept_sha256 FROM t
"""
