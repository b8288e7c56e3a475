"""Benchmark decontamination by winnowing.

Of each run of consecutive k-gram hashes the smallest are kept as fingerprints, of benchmark items and of documents
alike. Two texts that share a span of `span` words share all the k-grams of that span, hence its smallest, so a join on
fingerprints meets every such span. Each hit is then extended: the spans of `span` words around it are compared with
the benchmark's.

The join is by the benchmark's size, which is looked at first. Up to BROADCAST_BYTES of texts its fingerprints and spans are one
index that all executors get; spans are compared by the 64-bit hashes of all their words. Beyond that, fingerprints of documents and
of items are dealt by hash and joined, and so are the spans around hits, by their very words. Results are the same.
Items of fewer words than `span` count as one span of their own length, for which every hash is a fingerprint.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tidegauge.llm._frames import add_columns, spread, written
from tidegauge.llm._text import ALNUM, LOWER, Words, grams, mix, slices, tokenise, within

#: Words in a span that counts as shared, and in a k-gram.
SPAN, K = 13, 7
#: Bytes of benchmark texts up to which their index is broadcast.
BROADCAST_BYTES = 8 << 20
_FILTER_BITS = 20


def winnow(g: np.ndarray, whole: np.ndarray, w: int) -> np.ndarray:
    """Positions of hashes that are the smallest in some run of w; whole says for each position whether a run starts there."""
    n = len(whole)
    if n <= 0:
        return np.zeros(0, np.int64)
    m, have = g, 1
    while have < w:
        step = min(have, w - have)
        m = np.minimum(m[:-step], m[step:])
        have += step
    m = m[:n]
    kept = np.zeros(len(g), bool)
    for j in range(w):
        kept[j : j + n] |= (g[j : j + n] == m) & whole
    return np.flatnonzero(kept)


class _Table:
    """Spans of one length by hash: their items, and for each hash a place where the words stand."""

    def __init__(self, length: int, hashes: np.ndarray, items: np.ndarray, places: np.ndarray):
        order = np.lexsort((places, items, hashes))
        h, i, p = hashes[order], items[order], places[order]
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (i[1:] != i[:-1])
        self.length, self.items = length, i[new]
        self.keys, first = np.unique(h[new], return_index=True)
        self.first = np.append(first, len(self.items))
        self.place = p[new][first]


class Index:
    """What is broadcast of a small benchmark."""

    def __init__(self, ids: list, texts: pa.Array, span: int = SPAN, k: int = K):
        self.span, self.k, self.ids = span, k, list(ids)
        words, lengths = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
        for _, _, data, offsets in slices(texts):
            t = tokenise(data, offsets, ALNUM, LOWER)
            words.append(t.hashes())
            lengths.append(np.diff(t.first))
        self.words, n = np.concatenate(words), np.concatenate(lengths)
        first = np.concatenate([[0], np.cumsum(n)]).astype(np.int64)
        item = np.repeat(np.arange(len(n)), n)
        self.tables = []
        for size in sorted({int(x) for x in n if 0 < x < span}):
            own = np.flatnonzero(n == size)
            self.tables.append(_Table(size, grams(self.words, size)[first[own]], own, first[own]))
        whole = np.flatnonzero(within(first, span))
        self.tables.append(_Table(span, grams(self.words, span)[whole], item[whole], whole))
        g = grams(self.words, k)
        self.prints = np.unique(g[winnow(g, within(first, span), span - k + 1)])
        self.maybe = np.zeros(1 << _FILTER_BITS, bool)
        self.maybe[self.prints >> np.uint64(64 - _FILTER_BITS)] = True

    def near(self, words: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Starts of spans that hold a fingerprint of the benchmark."""
        whole = within(first, self.span)
        g = grams(words, self.k)
        at = winnow(g, whole, self.span - self.k + 1)
        h = g[at]
        some = self.maybe[h >> np.uint64(64 - _FILTER_BITS)]
        at, h = at[some], h[some]
        if not len(at) or not len(self.prints):
            return np.zeros(0, np.int64)
        at = at[self.prints[np.minimum(np.searchsorted(self.prints, h), len(self.prints) - 1)] == h]
        near = np.zeros(len(words) + self.span, bool)
        for j in range(self.span - self.k + 1):
            near[at[at >= j] - j] = True
        near = near[: len(whole)] & whole
        return np.flatnonzero(near)

    def hits(self, words: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
        """Which words are hit, and pairs of document and item as arrays."""
        hit, pairs = np.zeros(len(words), bool), []
        for t in self.tables:
            if not len(t.keys) or len(words) < t.length:
                continue
            g = grams(words, t.length)
            at = self.near(words, first) if t.length == self.span else np.flatnonzero(within(first, t.length))
            k = np.minimum(np.searchsorted(t.keys, g[at]), len(t.keys) - 1)
            same = t.keys[k] == g[at]
            at, k = at[same], k[same]
            same = np.ones(len(at), bool)
            for j in range(t.length):
                same &= words[at + j] == self.words[t.place[k] + j]
            at, k = at[same], k[same]
            for j in range(t.length):
                hit[at + j] = True
            doc = np.searchsorted(first, at, "right") - 1
            pair = np.unique(doc * len(t.keys) + k)
            doc, k = pair // len(t.keys), pair % len(t.keys)
            many = t.first[k + 1] - t.first[k]
            start = np.repeat(t.first[k] - np.concatenate([[0], np.cumsum(many)[:-1]]), many) if len(k) else k
            pairs.append((np.repeat(doc, many), t.items[start + np.arange(int(many.sum()))] if len(k) else k))
        return hit, pairs


_FOUND = "n_words long, hits array<long>, items array<string>"


def _by_index(docs: DataFrame, text_col: str, items: DataFrame, span: int) -> DataFrame:
    """docs with what is found, by an index of a benchmark whose size has been looked at."""
    block = items.toArrow()
    index = docs.sparkSession.sparkContext.broadcast(Index(block.column("id").to_pylist(), block.column("text").combine_chunks(), span))

    def make():
        own = index.value

        def f(texts):
            n_words, hits, items = [], [], []
            for _, _, data, offsets in slices(texts):
                t = tokenise(data, offsets, ALNUM, LOWER)
                hit, pairs = own.hits(t.hashes(), t.first)
                met: dict[int, set] = {}
                for d, i in pairs:
                    for x, y in zip(d.tolist(), i.tolist(), strict=True):
                        if own.ids[y] is not None:
                            met.setdefault(x, set()).add(own.ids[y])
                at = np.flatnonzero(hit)
                cut = np.searchsorted(at, t.first)
                n_words += np.diff(t.first).tolist()
                hits += [(at[cut[d] : cut[d + 1]] - t.first[d]).tolist() if cut[d + 1] > cut[d] else [] for d in range(len(offsets) - 1)]
                items += [sorted(met[d]) if d in met else [] for d in range(len(offsets) - 1)]
            return pa.array(n_words, pa.int64()), pa.array(hits, pa.list_(pa.int64())), pa.array(items, pa.list_(pa.string()))

        return f

    return add_columns(docs, [text_col], _FOUND, make)


def _fingerprints(t: Words, span: int, short: list[int]) -> list[np.ndarray]:
    """Distinct fingerprints of each text, and hashes of all its spans of the short lengths, told apart by length."""
    h = t.hashes()
    g = grams(h, K)
    at = winnow(g, within(t.first, span), span - K + 1)
    found, doc = [g[at]], [np.searchsorted(t.first, at, "right") - 1]
    for n in short:
        at = np.flatnonzero(within(t.first, n))
        found.append(mix(grams(h, n)[at], n))
        doc.append(np.searchsorted(t.first, at, "right") - 1)
    found, doc = np.concatenate(found), np.concatenate(doc)
    order = np.lexsort((found, doc))
    found, doc = found[order], doc[order]
    new = np.ones(len(found), bool)
    new[1:] = (found[1:] != found[:-1]) | (doc[1:] != doc[:-1])
    found, doc = found[new], doc[new]
    cut = np.searchsorted(doc, np.arange(len(t.first)))
    return [found[i:j] for i, j in zip(cut[:-1], cut[1:], strict=True)]


def _prints(span: int, short: list[int]):
    def f(texts):
        n, out = [], []
        for _, _, data, offsets in slices(texts):
            t = tokenise(data, offsets, ALNUM, LOWER)
            n += np.diff(t.first).tolist()
            out += [x.view(np.int64).tolist() for x in _fingerprints(t, span, short)]
        return pa.array(n, pa.int64()), pa.array(out, pa.list_(pa.int64()))

    return f


def _spans(t: Words, d: int, at: list[int], n: int) -> list[str]:
    """The words of spans of a text that start at the words at, as one string each."""
    a, b = int(t.first[d]), int(t.first[d + 1])
    w = [t.data[x:y].tobytes() for x, y in zip(t.starts[a:b].tolist(), t.ends[a:b].tolist(), strict=True)]
    return [b" ".join(w[i : i + n]).decode("utf-8", "replace") for i in at]


def _item_spans(span: int):
    """All spans of each item, as one string each; an item of fewer words is one."""

    def f(texts):
        out = []
        for _, _, data, offsets in slices(texts):
            t = tokenise(data, offsets, ALNUM, LOWER)
            for d, n in enumerate(np.diff(t.first).tolist()):
                out.append(_spans(t, d, range(n - min(n, span) + 1), min(n, span)) if n else [])
        return [pa.array(out, pa.list_(pa.string()))]

    return f


def _spans_at_hits(span: int, short: list[int]):
    """Starts, lengths and words of the spans of each text that hold one of its hits."""

    def f(texts, met):
        out = []
        for text, hits in zip(texts.to_pylist(), met.to_pylist(), strict=True):
            for _, _, data, offsets in slices(pa.array([text], pa.large_string())):
                t = tokenise(data, offsets, ALNUM, LOWER)
                h, hits = t.hashes(), np.sort(np.array(hits, np.int64).view(np.uint64))
                known = lambda x: hits[np.minimum(np.searchsorted(hits, x), len(hits) - 1)] == x  # noqa: E731, B023
                whole, g = within(t.first, span), grams(h, K)
                at = winnow(g, whole, span - K + 1)
                at = at[known(g[at])]
                near = np.zeros(len(whole) + span, bool)
                for j in range(span - K + 1):
                    near[at[at >= j] - j] = True
                starts = [(np.flatnonzero(near[: len(whole)] & whole), span)]
                for n in short:
                    x = grams(h, n)
                    starts.append((np.flatnonzero(known(mix(x, n))) if len(x) else np.zeros(0, np.int64), n))
                rows = []
                for p, n in starts:
                    rows += [{"p": i, "n": n, "span": x} for i, x in zip(p.tolist(), _spans(t, 0, p.tolist(), n), strict=True)]
                out.append(rows)
        return [pa.array(out, pa.list_(pa.struct([("p", pa.int64()), ("n", pa.int32()), ("span", pa.string())])))]

    return f


def _by_join(docs: DataFrame, text_col: str, items: DataFrame, span: int) -> DataFrame:
    """docs with what is found, by joins of fingerprints and of spans; a text that stands in many documents goes through them once."""
    items = written(add_columns(items, ["text"], "spans array<string>", lambda: _item_spans(span)))
    length = F.size(F.split(F.get("spans", F.lit(0)), " "))
    # at most span - 1 numbers
    short = sorted(r["n"] for r in items.where(F.size("spans") > 0).select(length.alias("n")).where(f"n < {span}").distinct().collect())
    ours = add_columns(items.select("id", "text"), ["text"], "n_words long, prints array<long>", lambda: _prints(span, short))
    known = ours.select(F.explode("prints").alias("print")).distinct()
    tagged = add_columns(docs.withColumn("__key", F.unhex(F.md5(F.coalesce(F.col(text_col), F.lit(""))))), [text_col], "n_words long, __prints array<long>", lambda: _prints(span, short))
    prints = tagged.select("__key", F.explode("__prints").alias("print")).distinct()
    met = prints.join(spread(known), "print", "left_semi").groupBy("__key").agg(F.collect_list("print").alias("met"))
    texts = docs.select(F.unhex(F.md5(F.coalesce(F.col(text_col), F.lit("")))).alias("__key"), F.col(text_col).alias("__text")).join(spread(met), "__key").groupBy("__key").agg(F.min("__text").alias("__text"), F.first("met").alias("met"))
    around = add_columns(texts, ["__text", "met"], "at array<struct<p:long,n:int,span:string>>", lambda: _spans_at_hits(span, short), drop=("__text", "met"))
    around = written(around.select("__key", F.explode("at").alias("x")).select("__key", "x.*"))
    theirs = items.select("id", F.explode("spans").alias("span")).distinct()
    at = around.join(spread(theirs.select("span").distinct()), "span", "left_semi").groupBy("__key").agg(F.collect_list(F.struct("p", "n")).alias("at"))
    hits = at.select("__key", F.array_sort(F.array_distinct(F.flatten(F.transform("at", lambda x: F.sequence(x["p"], x["p"] + x["n"] - 1))))).alias("__hits"))
    of = around.select("__key", "span").distinct().join(spread(theirs), "span").select("__key", "id").distinct()
    of = of.groupBy("__key").agg(F.array_sort(F.collect_list("id")).alias("__items"))
    found = written(hits.join(of, "__key"))
    none = lambda c, kind: F.coalesce(F.col(c), F.array().cast(f"array<{kind}>"))
    out = tagged.drop("__prints", "hits", "items").join(spread(found), "__key", "left")
    return out.select(*[c for c in docs.columns if c not in ("n_words", "hits", "items")], "n_words", none("__hits", "long").alias("hits"), none("__items", "string").alias("items"))


def find_overlap(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", span: int = SPAN, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """docs with n_words, hits (indexes of hit words, ascending) and items (ids as strings, sorted) of each document.

    A null or empty text has no words and no hits, an item with no words is never met, an empty benchmark hits
    nothing. Documents and items that are repeated count each for itself, but an item id once; an item whose id is null has its
    words hit but isn't listed. Columns of docs with these three names are replaced; other columns pass through.
    """
    items = benchmark.select(F.col(item_id).cast("string").alias("id"), F.col(item_text).alias("text")).where("text is not null")
    total = items.agg(F.sum(F.octet_length("text") + 64)).first()[0] or 0
    return (_by_index if total <= broadcast_bytes else _by_join)(docs, text_col, items, span)


def overlap_report(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Per document: counts of words, hit words and items, a digest of the item ids, and whether a twentieth of it is hit."""
    found = find_overlap(docs.select("doc_id", "text"), benchmark).drop("text")
    n_hit = F.size("hits").cast("long")
    return found.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        ((n_hit > 0) & (20 * n_hit >= F.col("n_words"))).alias("contaminated"),
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents of which less than a twentieth of the words is hit, with their own columns."""
    tag = "__overlap"
    kept = docs.withColumn(tag, F.col("text"))
    found = find_overlap(kept.withColumnsRenamed({c: f"__own_{c}" for c in docs.columns}), benchmark, text_col=tag)
    n_hit = F.size("hits")
    return found.where(~((n_hit > 0) & (20 * n_hit >= F.col("n_words")))).select(*[F.col(f"__own_{c}").alias(c) for c in docs.columns])


ORACLE = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
sized AS (SELECT item_id, w, least(13, len(w)) AS n FROM b WHERE len(w) > 0),
spans AS (SELECT DISTINCT item_id, n, list_slice(w, s, s + n - 1) AS span FROM (SELECT *, unnest(range(1, len(w) - n + 2)) AS s FROM sized)),
places AS (SELECT doc_id, n, s, list_slice(w, s, s + n - 1) AS span FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM d, (SELECT DISTINCT n FROM sized) WHERE len(w) >= n)),
met AS (SELECT p.doc_id, p.n, p.s, x.item_id FROM places p JOIN spans x ON p.n = x.n AND p.span = x.span),
hit AS (SELECT doc_id, count(DISTINCT pos) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + n)) AS pos FROM (SELECT DISTINCT doc_id, s, n FROM met)) GROUP BY doc_id),
it AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids FROM (SELECT DISTINCT doc_id, item_id FROM met) GROUP BY doc_id)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(d.w) AS contaminated
FROM d LEFT JOIN hit ON d.doc_id = hit.doc_id LEFT JOIN it ON d.doc_id = it.doc_id
"""
