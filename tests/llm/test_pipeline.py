"""The pipeline's stages, one by one against brute force on what each is given, and as a whole."""

from pyspark.sql import functions as F

import corpus_pipeline as P
from tests.llm import brute


def test_stages(spark, small, docs, odd):
    given = docs.unionByName(odd.select(docs.columns)).cache()
    columns = docs.columns
    f = dict(P.STAGES)
    first = f["language identification"](spark, given, small)
    want = sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in given.collect() if any(c.isalpha() for c in r["text"] or ""))
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in first.collect()) == want and first.columns == columns

    own = docs.cache()
    second = f["near-duplicate removal"](spark, own, small)
    parts = brute.components([(r["doc_id"], r["text"]) for r in own.collect()])
    assert {r["doc_id"] for r in second.collect()} == {c for _, c in parts.values()} and second.columns == columns

    third = f["benchmark decontamination"](spark, own, small)
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{small}/benchmark.parquet").collect()]
    met = brute.overlap([(r["doc_id"], r["text"]) for r in own.collect()], items)
    assert {r["doc_id"] for r in third.collect()} == {k for k, (n, h, _) in met.items() if not (h and 20 * h >= n)} and third.columns == columns

    fourth = f["personal data redaction"](spark, own, small)
    text = {r["doc_id"]: r["text"] for r in own.collect()}
    for r in fourth.collect():
        assert not brute.pii(r["text"]) and r["n_chars"] == len(r["text"])
        if not brute.pii(text[r["doc_id"]]):
            assert r["text"] == text[r["doc_id"]] or "[" in r["text"]
    assert fourth.columns == columns and fourth.count() == own.count()

    last = f["sentencepiece encoding"](spark, own.limit(30), small)
    assert last.where("not round_trip").isEmpty() and last.select("doc_id").distinct().count() == 30


def test_run(spark, small, docs):
    assert 4 <= len(P.STAGES) <= 5
    got = P.run(spark, small)
    out = docs
    for _, stage in P.STAGES:
        out = stage(spark, out, small)
    key = lambda d: sorted(map(tuple, d.select("doc_id", "draw", "ids_sha256").collect()))
    a, b = key(got), key(out)
    assert a == b and len({r[0] for r in a}) < docs.count()
    assert P.ORACLE_SQL is None
    assert got.select(F.size("ids").cast("long") == F.col("n_tokens")).distinct().collect()[0][0]


def test_stages_on_odd_and_empty_tables(spark, small, odd):
    """Nulls, empty and repeated rows, and extra columns of names that operators use themselves; then no rows at all."""
    clash = ("spans", "score", "lang_pred", "hits", "items", "n_words", "draws", "key", "rep", "size")
    given = odd.withColumns({c: F.lit(5) for c in clash})
    plain = lambda d: sorted(str((r["doc_id"], r["text"])) for r in d.collect())
    kept = {
        "language identification": lambda r: any(c.isalpha() for c in r["text"] or ""),
        "near-duplicate removal": lambda r: r["doc_id"] != 4,
        "benchmark decontamination": lambda r: True,
        "personal data redaction": lambda r: True,
    }
    for name, stage in P.STAGES:
        got = stage(spark, given, small)
        assert stage(spark, given.limit(0), small).count() == 0
        if name in kept:
            assert got.columns == given.columns
            assert plain(got) == sorted(str((r["doc_id"], r["text"])) for r in odd.collect() if kept[name](r))
            assert got.select(*clash).distinct().count() == 1
        else:
            assert got.where("not round_trip").isEmpty() and got.select("doc_id").distinct().count() == odd.select("doc_id").distinct().count()
