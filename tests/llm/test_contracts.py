"""Queries of the operators against brute force on small tables, and their edge cases."""

import hashlib
import math
import random
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tests import oracle
from tests.llm import brute
from tidegauge.llm import decontaminate, fingerprint, language, license as lic, near_dedup, pii, registry, sentencepiece_sampling as sps, sharding, substrings, warc_audit


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_oracle(spark, small, name):
    oracle.assert_same(registry.QUERIES[name](spark, small).toPandas(), oracle.connect(small).execute(registry.ORACLE_SQL[name]).df())


@pytest.mark.parametrize("report", [pii.pii_report, lic.license_report, language.language_report, near_dedup.near_report, fingerprint.edit_report, substrings.repeat_report, sharding.shard_report, sps.sampling_report])
def test_odd_and_empty(odd, report):
    got = report(odd)
    assert got.select("doc_id").distinct().count() == 9 and got.count() >= 10
    assert report(odd.limit(0)).count() == 0
    assert got.columns[0] == "doc_id"


def test_pii(spark, texts):
    extra = [None, "", "a@b.c%d@e.f x@y", "1.2.3.4.5.6.7.8 256.1.1.1 001.0.0.255", "+1 (408) 555-7800 +1+2 345", "4111 1111 1111 1111, 4111-1111-1111-1112", "é\U0001f600 a@b.co \U0001f600 10.0.0.1", "1" * 50000 + " a@" * 1000 + "x.y@z.w" * 300]
    every = texts + [(10**6 + i, t) for i, t in enumerate(extra)]
    got = {r["doc_id"]: r for r in pii.pii_report(spark.createDataFrame(every, "doc_id long, text string")).collect()}
    for d, t in every:
        want = brute.pii(t)
        base = ",".join(f"{k}:{s}:{e}" for s, _, e, k in want)
        g = got[d]
        assert g["base_sha256"] == brute.sha(base), t
        assert [g[f"n_{k}"] for k in pii.BASE] == [sum(w[3] == k for w in want) for k in pii.BASE]
        assert set(base.split(",")) <= set(g["spans"].split(","))


def test_pii_card_of_parted_digits(spark):
    """A card whose digits never stand side by side, by spaces and by hyphens, and one that fails Luhn."""
    card = "4" + "1" * 15
    t = [f"card {' '.join(card)} please", f"card {'-'.join(card)} please", f"card {' '.join(card[:-1])} 2 please", "1 2-3"]
    d = spark.createDataFrame(list(enumerate(t)), "doc_id long, text string")
    got = {r["doc_id"]: r for r in pii.pii_report(d).collect()}
    for i, x in enumerate(t):
        base = ",".join(f"{k}:{s}:{e}" for s, _, e, k in brute.pii(x))
        assert got[i]["base_sha256"] == brute.sha(base) and got[i]["n_card"] == (i < 2)
    assert [r["text"] for r in pii.redact(d).orderBy("doc_id").collect()] == ["card [CARD] please"] * 2 + t[2:]


def test_pii_judged_and_redacted(spark):
    t = ["call me at 408-555-7800 order 408-555-7800", "SSN: 123-45-6789", "write a@b.co or +1 (408) 555-7800.", "nothing here, 12 of 34"]
    d = spark.createDataFrame([(i, x, 5) for i, x in enumerate(t)], "doc_id long, text string, spans int")
    assert [r["text"] for r in pii.redact(d).orderBy("doc_id").collect()] == ["call me at [PHONE_LOCAL] order 408-555-7800", "SSN: [NATIONAL_ID]", "write [EMAIL] or [PHONE].", t[3]]
    assert pii.redact(d).columns == d.columns
    assert "Python" not in pii.redact(d)._jdf.queryExecution().toString()


def test_pii_base_kinds_on_random_texts(spark):
    """Runs of digits and what may part them, in all mixtures: every base span, and redaction from the same spans."""
    r, texts = np.random.default_rng(12), []
    alphabets = ["0123456789 -", "0125.", "0123456789.", "0123456789. +()-", "ab.@-0", "41 ", "4-1 +", "a@b.c1% "]
    for n in range(3000):
        letters = alphabets[n % len(alphabets)]
        texts.append("".join(letters[i] for i in r.integers(0, len(letters), int(r.integers(1, 60)))))
    for n in range(600):  # cards and phones of parted digits, right and wrong
        digits = "4" + "".join(map(str, r.integers(0, 10, int(r.integers(12, 19)))))
        sep = ["", " ", "-"][n % 3]
        texts.append("x " + sep.join(digits) + " y +" + "".join(d + [" ", "", ".", "-", "("][i % 5] for i, d in enumerate(digits[:12])))
    got = {r["doc_id"]: r for r in pii.pii_report(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    seen = Counter()
    for i, t in enumerate(texts):
        want = brute.pii(t)
        seen.update(w[3] for w in want)
        assert got[i]["base_sha256"] == brute.sha(",".join(f"{k}:{s}:{e}" for s, _, e, k in want)), t
    assert all(seen[k] > 20 for k in pii.BASE), seen


def test_pii_many_matches_in_one_text(spark):
    """A hundred thousand spans of a text of megabytes take seconds, found or redacted."""
    one = "call me 408-555-7800 a@b.co 😀 "
    d = spark.createDataFrame([(1, one * 50000)], "doc_id long, text string")
    pii.fit(spark)
    began = time.perf_counter()
    r = pii.pii_report(d).collect()[0]
    assert r["n_email"] == 50000 and r["spans"].count(",") == 99999 and r["spans"].endswith(f"email:{49999 * len(one) + 21}:{49999 * len(one) + 27}")
    assert pii.redact(d).collect()[0]["text"] == "call me [PHONE_LOCAL] [EMAIL] 😀 " * 50000
    assert time.perf_counter() - began < 120


def test_pii_redacts_long_stretches(spark):
    """Pieces that cross blocks, end at their edges, or hold whole blocks."""
    t = ["é" * n + "a@b.co" + "😀" * m + "c@d.ef" + "\n" * k for n in (0, 1, 1018, 1023, 1024, 5000) for m in (1, 1012, 1024, 3000) for k in (0, 1, 2048)]
    t = [x.replace("éa", "é a").replace("😀c", "😀 c") for x in t]
    d = spark.createDataFrame(list(enumerate(t)), "doc_id long, text string")
    want = [x.replace("a@b.co", "[EMAIL]").replace("c@d.ef", "[EMAIL]") for x in t]
    assert [r["text"] for r in pii.redact(d).orderBy("doc_id").collect()] == want


def test_pii_probabilities_are_calibrated(spark):
    """Over examples made anew, the share of personal data among spans of a bin is near their mean probability."""
    table = pii.reliability(spark)
    assert {r[0] for r in table} == set(pii.JUDGED)
    assert sum(n * abs(p - share) for _, _, n, p, share in table) / sum(r[2] for r in table) < 0.05


def test_pii_trees_on_unseen_examples(spark):
    made = pii.examples(seed=99, n=40)
    d = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(made)], "doc_id long, text string")
    found = {r["doc_id"]: bool(r["spans"]) for r in pii.find(d).collect()}
    assert np.mean([found[i] == bool(y) for i, (_, y) in enumerate(made)]) > 0.93


def test_overlap(spark, texts, small):
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{small}/benchmark.parquet").collect()]
    items += [(1001, "one two three"), (1002, None), (1003, "!!"), (1004, "One TWO three"), (1005, "ab " * 14), (1006, "q" * 10 + " w e r t y u i o p a s")]
    every = texts + [(10**6, "zero one two three four"), (10**6 + 1, "ab " * 500), (10**6 + 2, None), (10**6 + 3, "é " * 20 + items[0][1] + " é"), (10**6 + 4, items[1][1][: len(items[1][1]) // 2])]
    d, b = spark.createDataFrame(every, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    want = brute.overlap(every, items)
    for most in (decontaminate.BROADCAST_BYTES, 900):  # one index for all, and joins
        got = {r["doc_id"]: (r["n_words"], len(r["hits"]), r["items"]) for r in decontaminate.find_overlap(d, b, broadcast_bytes=most).collect()}
        assert got == want
    kept = {r["doc_id"] for r in decontaminate.drop_contaminated(d, b).collect()}
    assert kept == {k for k, (n, h, _) in want.items() if not (h and 20 * h >= n)}
    assert decontaminate.drop_contaminated(d, b.limit(0)).count() == len(every)


@pytest.mark.parametrize("most", [decontaminate.BROADCAST_BYTES, 0])
def test_overlap_odd(spark, odd, most):
    """Nulls, repeated rows and items, columns of the result's names, no documents, no items."""
    b = spark.createDataFrame([(1, "lorem ipsum dolor"), (1, "lorem ipsum dolor"), (None, "ex"), (2, None), (3, ""), (4, "x")], "item_id long, text string")
    named = odd.withColumns({"hits": F.lit(1), "items": F.lit("q"), "n_words": F.lit("w")})
    want = brute.overlap([(i, r["text"]) for i, r in enumerate(odd.collect())], [(1, "lorem ipsum dolor"), (None, "ex"), (4, "x")])
    got = decontaminate.find_overlap(named, b, broadcast_bytes=most)
    assert set(got.columns) == set(named.columns) and got.count() == odd.count()
    flat = lambda n, h, i: (n, h, [x for x in i if x not in ("None", None)])
    assert sorted(str(flat(r["n_words"], len(r["hits"]), r["items"])) for r in got.collect()) == sorted(str(flat(*w)) for w in want.values())
    assert decontaminate.find_overlap(named.limit(0), b, broadcast_bytes=most).count() == 0
    assert decontaminate.find_overlap(named, b.limit(0), broadcast_bytes=most).where("size(hits) = 0 and size(items) = 0").count() == odd.count()


def test_winnow_meets_every_span():
    g = np.random.default_rng(1).integers(0, 50, 400, dtype=np.uint64)
    kept = set(decontaminate.winnow(g, np.ones(394, bool), 7).tolist())
    assert all(kept & set(range(i, i + 7)) for i in range(394)) and len(kept) < 400


def test_license_labels_and_scores(spark):
    rng = random.Random(5)
    texts = ["", None, "the quick brown fox"]
    for _ in range(300):
        parts = []
        for _ in range(rng.randint(1, 4)):
            w = list(rng.choice(lic.TEMPLATES).words)
            for _ in range(rng.choice([0, 0, 0, 1, 2])):
                w[rng.randrange(len(w))] = rng.choice(["the", "license", "of", "software", "zebra"])
            parts += w[rng.choice([0, 0, 0, 3]) :] + ["filler"] * rng.randint(0, 2)
        texts.append(" ".join(parts).replace(" the ", "; THE "))
    every = list(enumerate([*texts, *texts[:20]]))
    words = {i: brute.ALNUM.findall(brute.lower(t)) for i, t in every}
    df = Counter(w for ws in words.values() for w in set(ws))
    idf = {w: math.log((1 + len(every)) / (1 + df[w])) + 1e-9 for t in lic.TEMPLATES for w in t.words}
    got = {r["doc_id"]: r for r in lic.license_report(spark.createDataFrame(every, "doc_id long, text string")).collect()}
    assert len(got) == len(every)
    for i, ws in words.items():
        labels, score = set(), 0.0
        for t in lic.TEMPLATES:
            for s in range(-len(t.words), len(ws)):
                at = {k: s + t.offset(k) for k in t.keys}
                if all(a >= 0 and ws[a : a + len(k.split())] == k.split() for k, a in at.items()):
                    labels.add(t.label)
                    own = sum(idf[x] for j, x in enumerate(t.words) if 0 <= s + j < len(ws) and ws[s + j] == x)
                    score = max(score, 1.0 if t.base else own / sum(idf[x] for x in t.words))
        assert got[i]["labels"] == ",".join(sorted(labels)), texts[i % len(texts)]
        assert abs(got[i]["score"] - score) < 1e-9
        assert got[i]["n_words"] == len(ws)


def test_license(spark, texts):
    extra = ["Released UNDER the MIT License under the mit license", None, "", "rights reserved of gnu general public", "GNU General Public License", "cc by nc CC-BY-NC", "x" * 1000]
    every = texts + [(10**6 + i, t) for i, t in enumerate(extra)]
    phrases = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
    got = {r["doc_id"]: r for r in lic.license_report(spark.createDataFrame(every, "doc_id long, text string")).collect()}
    for d, t in every:
        w = brute.ALNUM.findall(brute.lower(t))
        at = [(i, k) for p, k in phrases.items() for i in range(len(w)) if w[i : i + len(p.split())] == p.split()]
        g = got[d]
        assert (g["n_words"], g["n_base"], g["first_word"], g["last_word"], g["base_labels"]) == (len(w), len(at), min((i for i, _ in at), default=None), max((i for i, _ in at), default=None), ",".join(sorted({k for _, k in at})))
        assert {k for _, k in at} <= set(g["labels"].split(",")) and 0 <= g["score"] <= 1
    assert got[10**6 + 4]["labels"] == "gpl" and 0 < got[10**6 + 4]["score"] < 1


def test_language_held_out(spark):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    r = language.language_report(d).join(d.select("doc_id", "lang"), "doc_id").where("held_out")
    assert r.count() > 100 and r.where("lang = lang_pred").count() / r.count() > 0.97
    assert r.where("held_out").select((F.crc32(F.col("doc_id").cast("string")) % 4).alias("m")).distinct().collect()[0]["m"] == 2


def test_language_ignores_labels_of_held_out_rows(spark):
    d = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    held = F.crc32(F.col("doc_id").cast("string")) % 4 == 2
    other = d.withColumn("lang", F.when(held, F.lit("zz")).otherwise(F.col("lang"))).withColumn("source", F.lit("q"))
    assert rows(language.language_report(d)) == rows(language.language_report(other))


def test_language_predictions_against_plain_python(spark, texts):
    """Predictions from the learned weights, worked out text by text: families by the largest margin, then votes of pairs."""
    d = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    m = language.fit(d)
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in language.predict(d.select("doc_id", "text"), m).collect()}
    prob = lambda x: 1 / (1 + math.exp(-max(-50, min(50, 4 * x))))
    for i, t in texts:
        if t is None or not any(c.isalpha() for c in t):
            assert got[i] == ("und", 0.0)
            continue
        raw = bytes(b | 0x20 if 65 <= b <= 90 else b if b >= 128 or 97 <= b <= 122 else 0x20 for b in t.encode())
        count = Counter(raw[p : p + 3] for p in range(len(raw) - 2) if raw[p : p + 3] != b"   ")
        x = Counter()
        for g, n in count.items():
            x[(int.from_bytes(g, "big") * 0x9E3779B1 & 0xFFFFFFFF) >> (32 - language.BITS)] += n
        total = sum(x.values())
        margin = [float(w[-1]) + sum(float(w[k]) * math.sqrt(n / total) for k, n in x.items()) for w in m.w]
        names = dict(zip([str(k) for k in m.machines], margin, strict=True))
        best, sure = m.families[0], 1.0
        if len(m.families) > 1:
            p = {f: prob(names[f]) for f in m.families}
            best = max(m.families, key=lambda f: names[f])
            sure = p[best] / sum(p.values())
        votes = dict.fromkeys(m.of[best], 1.0 if len(m.of[best]) == 1 else 0.0)
        for f, a, b in m.pairs:
            if f == best:
                p = prob(names[str((f, a, b))])
                votes[a] += p
                votes[b] += 1 - p
        won = max(votes, key=votes.get)
        assert got[i][0] == won and abs(got[i][1] - sure * votes[won] / max(len(votes) - 1, 1)) < 1e-3


def test_language_sample_is_bounded(spark):
    """Copies of one text and a column of many languages don't make the sample grow."""
    d = spark.range(4000).selectExpr("id AS doc_id", "IF(id % 2 = 0, 'the same text', concat('text number ', id)) AS text", "IF(id < 3000, 'en', concat('l', id)) AS lang")
    own = language._sample(d, "doc_id", "text", "lang", 20, 5, 60)
    got = own.groupBy("lang").count().collect()
    assert len(got) == 5 and sum(r["count"] for r in got) <= 60 and {r["lang"]: r["count"] for r in got}["en"] <= 12


def test_language_odd(spark, odd):
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in language.language_report(odd).collect()}
    assert got[1] == got[2] == got[5] == ("und", 0.0) and got[6][0] != "und"
    kept = language.keep_known(odd)
    assert kept.columns == odd.columns and {r["doc_id"] for r in kept.collect()} == {3, 4, 6, None, 7, 8}
    one = spark.createDataFrame([(1, "only one language here", "en")], "doc_id long, text string, lang string")
    assert language.language_report(one).collect()[0]["lang_pred"] in ("en", "und")


@pytest.fixture(scope="module")
def families(spark):
    """Groups of near copies: edits of one base, chains, and unrelated texts."""
    r, out = np.random.default_rng(3), []
    for g in range(6):
        base = [f"w{x}" for x in r.integers(0, 500, 120)]
        for i in range(25):
            w = list(base)
            for p in r.integers(0, 120, i % 5):
                w[p] = f"e{r.integers(0, 10**6)}"
            out.append((len(out), " ".join(w)))
    chain = [f"c{i}" for i in range(200)]
    out += [(len(out) + i, " ".join(chain[3 * i : 3 * i + 100])) for i in range(20)]
    out += [(300 + i, " ".join(f"u{x}" for x in r.integers(0, 10**6, 60))) for i in range(20)]
    out += [(400, "Two words"), (401, "two WORDS"), (402, None), (403, ""), (404, "one two three four five"), (405, "one two three four five six")]
    return out


def test_near_miss_rate_is_the_stated_one():
    k, n = near_dedup.K, near_dedup.T
    missed = {s: round(1e9 * sum(math.comb(k, i) * s**i * (1 - s) ** (k - i) for i in range(n)), 1) for s in (0.85, 0.86)}
    assert f"fewer than T = {n} {missed[0.85]} times in 1,000,000,000 ({missed[0.86]} at 0.86)" in " ".join(near_dedup.__doc__.split())


def test_near_recall_of_borderline_pairs(spark):
    """Two thousand pairs of a similarity just over the limit are all linked, and none of as many just under it."""
    r, out, want = np.random.default_rng(8), [], {}
    for i in range(4000):
        a = [f"x{x}" for x in r.integers(0, 10**9, 104)]  # 100 shingles
        cut = 8 if i % 2 else 9  # replaced words at the end: 92 or 91 shingles in common
        b = a[: 104 - cut] + [f"y{x}" for x in r.integers(0, 10**9, cut)]
        out += [(2 * i, " ".join(a)), (2 * i + 1, " ".join(b))]
        common = 100 - cut
        want[2 * i + 1] = 2 * i if 100 * common >= 85 * (200 - common) else 2 * i + 1
    got = {x["doc_id"]: x["component_id"] for x in near_dedup.near_report(spark.createDataFrame(out, "doc_id long, text string")).collect()}
    assert {k: got[k] for k in want} == want and len({i for i, v in want.items() if i != v}) == 2000


@pytest.mark.parametrize("block", [512, 4])
def test_near_duplicates(spark, texts, families, monkeypatch, block):
    monkeypatch.setattr(near_dedup, "BLOCK", block)
    every = families + [(1000 + d, t) for d, t in texts]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in near_dedup.near_report(spark.createDataFrame(every, "doc_id long, text string")).collect()}
    assert got == {k: (n, c, c == k) for k, (n, c) in brute.components(every).items()}


def test_keep_one(odd):
    kept = near_dedup.keep_one(odd)
    assert kept.columns == odd.columns and Counter(r["doc_id"] for r in kept.collect()) == {1: 1, 2: 1, 3: 1, 5: 1, 6: 2, None: 1, 7: 1, 8: 1}


@pytest.mark.parametrize("n", [None, 1, 2, 9])
def test_fingerprints(spark, texts, monkeypatch, n):
    monkeypatch.setattr(fingerprint, "RUN_BYTES", 30_000)
    every = sorted(texts)[:n]
    got = {r["doc_id"]: r for r in fingerprint.edit_report(spark.createDataFrame(every, "doc_id long, text string")).collect()}
    assert len(got) == len(every)
    c, dig = brute.canonical, lambda t: xxhash.xxh3_128_hexdigest(brute.canonical(t).encode())
    for i, (k, t) in enumerate(every):
        nxt = every[(i + 1) % len(every)][1]
        ed = t[: len(t) - len(t) // 4] + nxt[: len(t) // 4]
        g = got[k]
        assert tuple(g)[1:] == (len(t), hashlib.sha256(ed.encode()).hexdigest(), dig(t), dig(ed), float(c(t) == c(ed)), float(c(t) == c(nxt)))


def test_fingerprint_canonical_and_collisions(spark):
    d = spark.createDataFrame([(1, "Café  A"), (2, "café a\n"), (3, "Ａ"), (4, "a"), (5, None), (6, "")], "doc_id long, text string")
    f = {r["doc_id"]: r["fingerprint"] for r in fingerprint.fingerprints(d).collect()}
    assert f[1] == f[2] and f[3] == f[4] and f[5] == f[6] and len(set(f.values())) == 3
    same = spark.createDataFrame([(1, "d", b"x"), (2, "d", b"y"), (3, "d", b"x"), (4, "e", b"z"), (5, "e", None)], "i int, d string, t binary")
    assert rows(fingerprint.settle(same, "d", "t").select("i", "d")) == [(1, "d"), (2, "d-1"), (3, "d"), (4, "e"), (5, "e")]


def test_repeats(spark, texts):
    every = texts + [(10**6, "a b " * 60), (10**6 + 1, None), (10**6 + 2, "a b " * 12), (10**6 + 3, " ".join(map(str, range(30)))), (10**6 + 4, "y " + " ".join(map(str, range(5, 27))) + " z")]
    d = spark.createDataFrame(every, "doc_id long, text string")
    want = brute.without_repeats(every)
    for size, more in ((8 << 20, {}), (40_000, {}), (20_000, {"ways": 3, "team": 2})):  # the last goes through relays
        got = {r["id"]: (r["n_words"], r["n_removed"], r["kept"], r["kept_sha256"]) for r in substrings.remove_repeats(d, chunk_bytes=size, **more).collect()}
        assert got == {k: (*v, brute.sha(v[2])) for k, v in want.items()}


def test_shards(spark, texts):
    every = texts + [(10**6 + i, "the same text " * 30) for i in range(300)] + [(2 * 10**6, None)]
    got = sharding.shard_report(spark.createDataFrame(every, "doc_id long, text string").repartition(7)).collect()
    size, slots, at = Counter(), defaultdict(list), {}
    for r in got:
        size[r["shard"]] += r["size"]
        slots[r["shard"]].append(r["slot"])
        at[r["doc_id"]] = r["shard"]
    text = dict(every)
    assert all(r["size"] == len((text[r["doc_id"]] or "").encode()) + 8 and r["text_crc32"] == zlib.crc32((text[r["doc_id"]] or "").encode()) for r in got)
    assert len(got) == len(every) and all(sorted(v) == list(range(len(v))) for v in slots.values()) and set(size) <= set(range(24))
    target = sum(size.values()) / 24
    assert all(abs(v - target) <= target * 0.05 + max(r["size"] for r in got) for v in size.values())


def _segments(v, text):
    plain = "▁" + text.replace(" ", "▁")
    ids = {v.raw[i].decode("utf-8", "replace"): i for i in range(259, len(v.raw)) if v.raw[i]}

    def go(p):
        if p == len(plain):
            yield (), 0.0
        for q in range(p + 1, len(plain) + 1):
            if plain[p:q] in ids:
                for rest, w in go(q):
                    yield (ids[plain[p:q]], *rest), w + v.weight[ids[plain[p:q]]]

    found = list(go(0))
    z = math.log(sum(math.exp(w) for _, w in found))
    return {s: w - z for s, w in found}


def test_sampling_without_replacement():
    v = sps.vocabulary(sps.read_model(sps.default_model()))
    n, want = 6000, _segments(v, "hint a")
    s = sps._Slice(v, ["hint a"] * n, np.arange(n, dtype=np.uint64) * np.uint64(7919))
    drawn = s.draw(3)
    first, second, weight = Counter(), Counter(), []
    for d, got in enumerate(drawn):
        kappa, paths = got[-1], [tuple(s.ids(p, d).tolist()) for p, _, _ in got[:-1]]
        assert len(set(paths)) == 3 and all(abs(l - want[x]) < 1e-9 for x, (_, l, _) in zip(paths, got, strict=False))
        first[paths[0]] += 1
        second[paths[1]] += 1
        weight.append(sum(math.exp(l - sps.log_inclusion(l, kappa)) for _, l, _ in got[:-1]))
    p = {k: math.exp(x) for k, x in want.items()}
    assert max(abs(first[k] / n - p[k]) for k in p) < 0.03
    assert max(abs(second[k] / n - sum(p[a] * p[k] / (1 - p[a]) for a in p if a != k)) for k in p) < 0.03
    assert abs(np.mean(weight) - 1) < 0.01


def test_sampling_query_against_all_segmentations(spark):
    """The query itself, over short texts whose segmentations can all be listed: probabilities, order of draws, distinct paths."""
    v = sps.vocabulary(sps.read_model(sps.default_model()))
    texts, n = ["hint a", "the", "on it"], 2000
    d = spark.createDataFrame([(len(texts) * i + j, t) for i in range(n) for j, t in enumerate(texts)], "doc_id long, text string")
    got = defaultdict(dict)
    for r in sps.sampling_report(d).collect():
        got[r["doc_id"]][r["draw"]] = r
    for j, t in enumerate(texts):
        every = {hashlib.sha256(np.array(s, "<i4").tobytes()).hexdigest(): (w, len(s)) for s, w in _segments(v, t).items()}
        first = Counter()
        for i in range(n):
            a, b = (got[len(texts) * i + j][x] for x in (1, 2))
            first[a["ids_sha256"]] += 1
            assert a["ids_sha256"] != b["ids_sha256"] and a["round_trip"] and b["round_trip"]
            for x in (a, b):
                w, tokens = every[x["ids_sha256"]]
                assert abs(x["log_prob"] - w) < 1e-9 and x["n_tokens"] == tokens
        assert max(abs(first[k] / n - math.exp(w)) for k, (w, _) in every.items()) < 0.05


def test_encode_is_the_models_own(spark, odd, docs):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=sps.default_model())
    both = odd.select("doc_id", "text").unionByName(docs.select("doc_id", "text").limit(40))
    got = sps.encode(both).collect()
    assert len(got) == odd.count() + 40
    assert all((r["ids"] is None) == (r["text"] is None) and (r["ids"] or []) == sp.encode(r["text"] or "") and r["n_tokens"] == len(r["ids"] or []) for r in got)
    assert sps.encode(both.limit(0)).count() == 0


def test_sampling_few_segmentations_and_early_bound(monkeypatch):
    v = sps.vocabulary(sps.read_model(sps.default_model()))
    s = sps._Slice(v, ["", "龘", "a"], np.arange(3, dtype=np.uint64))
    got = s.draw(4)
    assert [len(g) - 1 for g in got] == [1, 1, 2] or len(got[1]) == 2
    assert all(g[-1] == -math.inf for g in got[:1])
    text = ["the quick brown fox jumps over the lazy dog " * 30] * 5
    a = sps._Slice(v, text, np.arange(5, dtype=np.uint64))
    ra = a.draw(3)
    monkeypatch.setattr(sps, "EARLY", 2)
    b = sps._Slice(v, text, np.arange(5, dtype=np.uint64))
    rb = b.draw(3)
    assert ra == rb and all((a.ids(x[0], d) == b.ids(y[0], d)).all() for d in range(5) for x, y in zip(ra[d][:-1], rb[d][:-1], strict=True))


def test_round_trip(spark, odd, docs):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=sps.default_model())
    both = odd.select("doc_id", "text").unionByName(docs.select("doc_id", "text").limit(40))
    got = sps.sample_segmentations(both).select("doc_id", "text", F.explode("draws").alias("d")).select("doc_id", "text", "d.*")
    decoded = sps.decode(got).collect()
    assert decoded and all(r["round_trip"] and r["decoded"] == (r["text"] or "") and sp.decode(list(r["ids"])) == (r["text"] or "") for r in decoded)
    assert all(r["n_tokens"] == len(r["ids"]) and r["log_prob"] <= 1e-9 and r["log_inclusion"] <= 0 for r in decoded)
    again = sps.sample_segmentations(both.repartition(3)).select("doc_id", F.explode("draws").alias("d")).select("doc_id", "d.ids_sha256", "d.draw")
    assert rows(again) == rows(got.select("doc_id", "ids_sha256", "draw"))


def _index(spark, files):
    r = [(f, k, c) for f, rows_ in files.items() for k, c in rows_]
    return warc_audit.lay_out(spark.createDataFrame(r, "file long, record_id long, content string"))


def test_audit(spark):
    a = {f: [(i, f"record {f} {i} " * (1 + i % 3)) for i in range(n)] for f, n in ((0, 300), (1, 40), (2, 1), (3, 17))}
    b = {f: list(x) for f, x in a.items()}
    b[0][123] = (123, b[0][123][1].replace("r", "R"))
    b[1] = b[1][:30] + b[1][31:]
    del b[3]
    b[4] = [(1, "new")]
    got = {(r["file"], r["name"]): r["status"] for r in warc_audit.audit(_index(spark, a), _index(spark, b)).collect()}
    lost = sorted((x[0] for x in a[1]))[30]
    want = {(0, "123"): "changed", (1, str(lost)): "missing", (4, "1"): "extra"} | {(1, str(k)): "moved" for k, _ in b[1] if k > lost} | {(3, str(k)): "missing" for k, _ in a[3]}
    assert got == want
    assert warc_audit.audit(_index(spark, a), _index(spark, a)).count() == 0
    assert warc_audit.audit(_index(spark, a).limit(0), _index(spark, a).limit(0)).count() == 0
    twice = {0: [(1, "a"), (1, "a"), (1, "b"), (None, "n")]}
    assert sorted(r["name"] for r in _index(spark, twice).collect()) == ["", "1", "1#2", "1#3"]


def test_descent_reads_only_bad_branches(spark):
    a = warc_audit.tree(_index(spark, {0: [(i, str(i)) for i in range(600)], 1: [(1, "x")]}), 3)
    b = warc_audit.tree(_index(spark, {0: [(i, str(i) if i != 77 else "no") for i in range(600)], 1: [(1, "x")]}), 3)
    assert [(r["file"], r["idx"]) for r in warc_audit._differ(a[-1], b[-1]).collect()] == [(0, 0)]
    assert [(r["file"], r["idx"]) for r in warc_audit._differ(a[1], b[1]).collect()] == [(0, 77 // 16)]
    assert [tuple(r) for r in warc_audit.descend(a, b).collect()] == [(0, 77)]


def test_audit_nulls(spark):
    p = spark.createDataFrame([(None, None, None, 1), (5, "u", None, 2), (5, "u", None, 3), (11, None, "é", 4)], "page_id long, url string, html string, digest int")
    got = rows(warc_audit.audit_report(p).select("page_id", "status"))
    assert got == sorted([(None, "ok"), (5, "changed"), (5, "changed"), (11, "missing")], key=str)
    assert warc_audit.audit_report(p.limit(0)).count() == 0


def test_warc_files(spark, small, tmp_path):
    pages = spark.read.parquet(f"{small}/pages.parquet").orderBy("page_id").limit(20)
    made = [r["content"].encode() for r in warc_audit.page_records(pages).orderBy("record_id").collect()]
    (tmp_path / "a.warc").write_bytes(b"".join(made))
    found = list(warc_audit.parse(b"".join(made)))
    assert [x[3] for x in found] == made and found[1][0] == len(made[0])
    index = warc_audit.read_index(spark, str(tmp_path))
    assert sorted(r["digest"] for r in index.collect()) == sorted(hashlib.sha256(m).hexdigest() for m in made)
    assert list(warc_audit.parse(b"junk")) == [(0, 4, "", b"junk")] and list(warc_audit.parse(b"")) == []
