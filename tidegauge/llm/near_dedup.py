"""Near duplicates by an inverted join of MinHash signature coordinates.

A document is the set of its five-word shingles. Equal sets are one class, under its least id. Each class has a signature of K
coordinates; classes are posted under coordinate-value pairs. Two sets of similarity 0.85 agree in 54 of 64 coordinates
on average and in fewer than T = 36 7.5 times in 1,000,000,000 (1.5 at 0.86); such a pair is missed unless other sets
link it. That is the one thing here that isn't exact. Tests measure the recall of pairs at the limit.

How many classes have a pair is counted first, with partial sums, so a frequent pair is a few rows in a shuffle. Classes that
agree in T pairs have T shared pairs each, and one of the m - T + 1 rarest of a class's m shared pairs is common to both: only
this prefix is posted. The lists of pairs that many documents share, of common lines or passages, are skipped.

Posting lists aren't expanded to pairs: a list is a star around its least class, and connected stars are a
neighbourhood. Within it each class's collisions with the others are counted on the signatures, and pairs of T or more that
aren't linked already are confirmed on the full sets. Neighbourhoods over BLOCK classes are dealt to blocks: each block
is clustered, the largest clusters are linked through one of their sets, and what is left over goes to all blocks. So no link
between different clusters is missed, and copies of one another aren't compared in pairs.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from tidegauge.llm._components import components
from tidegauge.llm._exchange import tidy
from tidegauge.llm._frames import add_columns, spread, written
from tidegauge.llm._text import LOWER, NOT_SPACE, grams, mix, slices, tokenise

SHINGLE = 5
K, T = 64, 36
#: Similarity in hundredths from which documents are linked.
LIKE = 85
#: Classes in a block, and bytes of their sets.
BLOCK, BLOCK_BYTES = 512, 16 << 20

_rng = np.random.default_rng(20)
_MUL = _rng.integers(1, 1 << 63, K, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _rng.integers(0, 1 << 63, K, dtype=np.uint64)


def shingle_sets(texts) -> list[np.ndarray]:
    """Sorted distinct hashes of each text's shingles; a text of fewer words is one shingle, of none has none."""
    out = []
    for i, j, data, offsets in slices(texts):
        t = tokenise(data, offsets, NOT_SPACE, LOWER)
        h = t.hashes()
        g = grams(h, SHINGLE)
        for a, b in zip(t.first[:-1].tolist(), t.first[1:].tolist(), strict=True):
            if b - a >= SHINGLE:
                s = np.sort(g[a : b - SHINGLE + 1])
                new = np.ones(len(s), bool)
                new[1:] = s[1:] != s[:-1]
                out.append(s[new])
            else:
                out.append(mix(grams(h[a:b], b - a), b - a) if b > a else np.zeros(0, np.uint64))
    return out


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """K coordinates of each set; sets must not be empty."""
    out = np.empty((len(sets), K), np.uint32)
    if sets:
        h = np.concatenate(sets)
        first = np.concatenate([[0], np.cumsum([len(s) for s in sets])[:-1]])
        for c in range(K):
            out[:, c] = np.minimum.reduceat(((h + _ADD[c]) * _MUL[c]) >> np.uint64(32), first)
    return out


def _describe():
    def f(texts):
        n, key, sig = [], [], []
        for _, _, data, offsets in slices(texts):
            part = pa.LargeStringArray.from_buffers(len(offsets) - 1, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data)))
            sets = shingle_sets(part)
            some = [s for s in sets if len(s)]
            signed = iter(signatures(some))
            n += [len(s) for s in sets]
            key += [xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets]
            sig += [next(signed).tobytes() if len(s) else None for s in sets]
        return pa.array(n, pa.int64()), pa.array(key, pa.binary()), pa.array(sig, pa.binary())

    return f


def _unroll(batches):
    """Rows (pair, rep): a hash of each coordinate-value pair of each class."""
    place = np.arange(K, dtype=np.uint64) << np.uint64(32)
    for b in batches:
        if b.num_rows:
            sig = np.frombuffer(b"".join(b.column("sig").to_pylist()), np.uint32).reshape(-1, K)
            pairs = mix(sig.astype(np.uint64) | place, 3).view(np.int64).ravel()
            yield pa.RecordBatch.from_arrays([pa.array(pairs), b.column("rep").take(pa.array(np.repeat(np.arange(b.num_rows), K)))], names=["pair", "rep"])


def _posts(classes: DataFrame) -> DataFrame:
    """Rows (pair, rep) of the prefix of each class: its rarest shared pairs but for the last T - 1."""
    pairs = classes.select("rep", "sig").mapInArrow(_unroll, "pair long, rep long")
    often = pairs.groupBy("pair").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    shared = pairs.join(spread(often), "pair")
    own = shared.groupBy("rep").agg(F.sort_array(F.collect_list(F.struct("n", "pair"))).alias("p")).where(F.size("p") >= T)  # K at most
    return own.select("rep", F.explode(F.slice("p", F.lit(1), F.size("p") - (T - 1))).alias("x")).select("x.pair", "rep")


def alike(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two sorted sets have LIKE hundredths of their union in common."""
    if 100 * min(len(a), len(b)) < LIKE * max(len(a), len(b)):
        return False
    both = np.concatenate([a, b])
    both.sort()
    common = int((both[1:] == both[:-1]).sum())
    return 100 * common >= LIKE * (len(a) + len(b) - common)


class _Sets:
    """Rows of a block: ids, signatures and sets."""

    def __init__(self, table: pa.Table):
        self.rep = table.column("rep").to_numpy()
        self.sig = np.frombuffer(b"".join(table.column("sig").to_pylist()), np.uint32).reshape(-1, K)
        self.sets = [np.frombuffer(x, np.uint64) for x in table.column("set").to_pylist()]

    def collide(self, sig: np.ndarray) -> np.ndarray:
        return (self.sig == sig).sum(axis=1) >= T


def _cluster(key, table):
    """Clusters of one block, each under its least id."""
    s = _Sets(table.sort_by("rep"))
    n = len(s.rep)
    root = np.arange(n)
    for i in range(n):
        met = np.flatnonzero(s.collide(s.sig[i]))
        for j in met[met > i].tolist():
            if root[i] != root[j] and alike(s.sets[i], s.sets[j]):
                a, b = min(root[i], root[j]), max(root[i], root[j])
                root[root == b] = a
    size = np.bincount(root, minlength=n)
    full = lambda v, kind: pa.array(np.full(n, v), kind)
    return pa.table({"hood": full(key[0].as_py(), pa.int64()), "block": full(key[1].as_py(), pa.int32()), "rep": s.rep, "cluster": s.rep[root], "size": pa.array(size[root], pa.int64())})


def _across(key, table):
    """Links (u, v) between guests of a block and its own rows that aren't of one cluster."""
    table = table.sort_by([("guest", "ascending"), ("rep", "ascending")])
    guest = table.column("guest").to_numpy(zero_copy_only=False)
    cut = int((~guest).sum())
    own, more = _Sets(table.slice(0, cut)), _Sets(table.slice(cut))
    own_c, more_c = (x.column("cluster").to_numpy() for x in (table.slice(0, cut), table.slice(cut)))
    u, v, joined = [], [], set()
    for i in range(len(more.rep)):
        for j in np.flatnonzero(own.collide(more.sig[i]) & (own_c != more_c[i])).tolist():
            pair = (int(more_c[i]), int(own_c[j]))
            if pair not in joined and alike(more.sets[i], own.sets[j]):
                joined.add(pair)
                u.append(pair[0])
                v.append(pair[1])
    return pa.table({"u": pa.array(u, pa.int64()), "v": pa.array(v, pa.int64())})


def _visit(rows: DataFrame, guests: DataFrame) -> DataFrame:
    """Links between clusters, from guests (rows with block) shown to all blocks of their neighbourhood."""
    per = guests.groupBy("hood").agg(F.ceil(F.count(F.lit(1)) / 2048).cast("int").alias("parts"))
    columns = ["hood", "block", "part", "guest", "rep", "cluster", "sig", "set"]
    part = F.pmod(F.xxhash64("rep"), F.col("parts")).cast("int")
    out = guests.join(per, "hood").withColumn("part", part).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    out = out.where("other <> block").drop("block").withColumnRenamed("other", "block").withColumn("guest", F.lit(True))
    own = rows.join(per, "hood").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).withColumn("guest", F.lit(False))
    return own.select(columns).unionByName(out.select(columns)).repartition("hood", "block", "part").groupBy("hood", "block", "part").applyInArrow(_across, "u long, v long")


def _join_blocks(sets: DataFrame, clusters: DataFrame) -> DataFrame:
    """Links between clusters of neighbourhoods of several blocks."""
    rows = written(sets.where("blocks > 1").join(clusters.select("rep", "cluster", "size"), "rep"))
    if rows.isEmpty():
        return rows.sparkSession.createDataFrame([], "u long, v long")
    main = rows.groupBy("hood", "block").agg(F.max(F.struct("size", (-F.col("cluster")).alias("c"))).alias("m")).select("hood", "block", (-F.col("m.c")).alias("main"))
    rows = written(rows.join(main, ["hood", "block"]))
    lead = rows.where("block = 0 and rep = main")
    first = written(_visit(rows, lead).distinct())
    # clusters linked to the lead's, directly or as its own, need no visits to one another
    tied = first.select("u").unionByName(first.select(F.col("v").alias("u"))).unionByName(lead.select(F.col("cluster").alias("u"))).distinct().withColumnRenamed("u", "cluster")
    rest = rows.join(tied, "cluster", "left_anti")
    return first.unionByName(_visit(rows, rest)).distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_shingles and component_id of every row of docs; see the module for the method.

    A null or empty text has no shingles and a component of its own. A null id has no component. Rows of one id
    are one node, whatever their texts. Other columns aren't read.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    with tidy(spark):
        about = written(add_columns(docs, ["text"], "n_shingles long, key binary, sig binary", _describe, drop=("text",)))
        known = about.where("n_shingles > 0 and id is not null")
        classes = written(known.groupBy("key").agg(F.min("id").alias("rep"), F.first("sig").alias("sig"), F.first("n_shingles").alias("n")))
        posts = written(_posts(classes))
        least = posts.groupBy("pair").agg(F.min("rep").alias("v"), F.max("rep").alias("last")).where("v < last").select("pair", "v")
        hoods = components(posts.join(spread(least), "pair").select(F.col("rep").alias("u"), "v"))
        hoods = written(hoods.unionByName(hoods.select(F.col("component").alias("id"), "component").distinct()).select(F.col("id").alias("rep"), F.col("component").alias("hood")))
        sized = hoods.join(classes.select("rep", "n"), "rep").groupBy("hood").agg(F.ceil(F.greatest(F.count(F.lit(1)) / BLOCK, F.sum(F.col("n") * 8) / BLOCK_BYTES)).cast("int").alias("blocks"))
        placed = hoods.join(sized, "hood").withColumn("block", F.pmod(F.xxhash64("rep", F.lit(1)), F.col("blocks")).cast("int"))

        def make():
            def f(texts):
                sets = shingle_sets(texts)
                signed = signatures([s if len(s) else np.zeros(1, np.uint64) for s in sets])
                return pa.array([x.tobytes() for x in signed], pa.binary()), pa.array([s.tobytes() for s in sets], pa.binary())

            return f

        texts = docs.join(placed, docs["id"] == placed["rep"]).select("hood", "blocks", "block", "rep", "text")
        sets = written(add_columns(texts, ["text"], "sig binary, set binary", make, drop=("text",)).where(F.length("set") > 0))
        clusters = written(sets.groupBy("hood", "block").applyInArrow(_cluster, "hood long, block int, rep long, cluster long, size long"))
        links = clusters.select(F.col("rep").alias("u"), F.col("cluster").alias("v")).unionByName(_join_blocks(sets, clusters))
        found = components(links)
    got = about.join(classes.select("key", "rep"), "key", "left").join(found.withColumnRenamed("id", "rep"), "rep", "left")
    return got.select("id", "n_shingles", F.coalesce("component", "rep", "id").alias("component_id"))


def near_report(docs: DataFrame) -> DataFrame:
    """Per document: size of its set, its component, and whether it's the one that stays."""
    got = near_duplicates(docs)
    return got.select(F.col("id").alias("doc_id"), "n_shingles", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents that are the least of their component, with their own columns; rows of a null id stay."""
    got = near_duplicates(docs, id_col, text_col)
    gone = got.where("id <> component_id").select(F.col("id").alias("__gone")).distinct()
    return docs.join(gone, F.col(id_col).cast("long") == F.col("__gone"), "left_anti")
