"""Language identification by hierarchical discrimination.

A linear support vector machine for each language family decides the family; within it, one machine for each pair of
languages votes. Features are the frequencies of three-byte sequences of the whole text, hashed, as unit vectors of
square roots. Machines are trained by dual coordinate descent on a bounded sample of labelled texts: of the LANGS most
frequent languages SAMPLE different texts each, those of the smallest hashes, and MOST in all. The sample goes to the driver as
sparse rows and from there to the tasks that train, one for each machine.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from tidegauge.llm._frames import add_columns, trim
from tidegauge.llm._text import slices

#: Labelled texts of each language that are learned from, languages, and texts in all, at most.
SAMPLE, LANGS, MOST = 1000, 256, 32_000
BITS = 12
SIZE = 1 << BITS
#: Families by language code; a code that isn't here is a family of its own.
FAMILIES = {
    "germanic": ("en", "de", "nl", "sv", "da", "no", "nb", "nn", "is", "af", "lb"),
    "romance": ("fr", "es", "it", "pt", "ro", "ca", "gl", "oc"),
    "slavic": ("ru", "uk", "be", "pl", "cs", "sk", "bg", "sr", "hr", "sl", "mk"),
    "uralic": ("fi", "et", "hu"),
    "turkic": ("tr", "az", "kk", "uz", "ky"),
    "iranian": ("fa", "ps", "ku", "tg"),
    "indic": ("hi", "bn", "mr", "ur", "pa", "gu", "ne"),
    "semitic": ("ar", "he", "mt", "am"),
    "celtic": ("ga", "cy", "br", "gd"),
    "baltic": ("lt", "lv"),
}
UND = "und"

_FOLD = np.full(256, 0x20, np.uint8)
_FOLD[0x41:0x5B] = np.arange(0x61, 0x7B)
_FOLD[0x61:0x7B] = np.arange(0x61, 0x7B)
_FOLD[0x80:] = np.arange(0x80, 0x100)
_ASCII_LETTER = (_FOLD != 0x20) & (np.arange(256) < 0x80)


def features(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A row of SIZE features for each text."""
    n = len(offsets) - 1
    b = _FOLD[data].astype(np.uint32)
    if len(b) < 3:
        return np.zeros((n, SIZE), np.float32)
    code = (b[:-2] << np.uint32(16)) | (b[1:-1] << np.uint32(8)) | b[2:]
    doc = np.repeat(np.arange(n, dtype=np.int64), np.diff(offsets))
    ok = (doc[:-2] == doc[2:]) & (code != 0x202020)
    at = ((code * np.uint32(0x9E3779B1)) >> np.uint32(32 - BITS)).astype(np.int64)
    x = np.bincount((doc[:-2] * SIZE + at)[ok], minlength=n * SIZE).reshape(n, SIZE).astype(np.float32)
    total = x.sum(axis=1, keepdims=True)
    return np.sqrt(x / np.maximum(total, 1))


def has_letter(text: str | None) -> bool:
    return text is not None and any(c.isalpha() for c in text)


class Rows:
    """Sparse rows of features, each with a last feature of 1 for the constant."""

    def __init__(self, at: list[np.ndarray], values: list[np.ndarray]):
        one = np.ones(1, np.float32)
        self.at = [np.append(a, np.uint16(SIZE)) for a in at]
        self.values = [np.concatenate([v, one]) for v in values]

    def __len__(self) -> int:
        return len(self.at)

    def take(self, which: np.ndarray) -> Rows:
        out = Rows([], [])
        out.at, out.values = [self.at[i] for i in which], [self.values[i] for i in which]
        return out


def svm(x: Rows, y: np.ndarray, c: float = 10.0, epochs: int = 15) -> np.ndarray:
    """Weights, the last for the constant, of a linear machine for labels -1 and 1: squared hinge loss, dual coordinate descent."""
    w, a = np.zeros(SIZE + 1), np.zeros(len(x))
    share = np.where(y > 0, np.mean(y < 0), np.mean(y > 0)) * 2
    diag = 1 / (2 * c * np.maximum(share, 1e-6))
    q = np.array([float(v @ v) for v in x.values]) + diag
    rng = np.random.default_rng(7)
    for _ in range(epochs):
        for i in rng.permutation(len(x)).tolist():
            at, v = x.at[i], x.values[i]
            g = y[i] * (w[at] @ v) - 1 + diag[i] * a[i]
            new = max(a[i] - g / q[i], 0.0)
            if new != a[i]:
                w[at] += (new - a[i]) * y[i] * v
                a[i] = new
    return w


class Model:
    """Machines for families and for pairs of languages."""

    def __init__(self, langs: list[str]):
        known = {code: family for family, codes in FAMILIES.items() for code in codes}
        self.langs = sorted(set(langs))
        self.family = {v: known.get(v, v) for v in self.langs}
        self.families = sorted(set(self.family.values()))
        self.of = {f: [v for v in self.langs if self.family[v] == f] for f in self.families}
        self.pairs = [(f, a, b) for f in self.families for i, a in enumerate(self.of[f]) for b in self.of[f][i + 1 :]]
        self.machines = [*(self.families if len(self.families) > 1 else []), *self.pairs]
        self.w = np.zeros((len(self.machines), SIZE + 1), np.float32)

    def train(self, machine: int, x: Rows, lang: np.ndarray) -> np.ndarray:
        """Weights of one machine from rows and their languages."""
        m = self.machines[machine]
        if isinstance(m, str):
            return svm(x, np.where([self.family[v] == m for v in lang], 1.0, -1.0))
        own = np.flatnonzero((lang == m[1]) | (lang == m[2]))
        return svm(x.take(own), np.where(lang[own] == m[1], 1.0, -1.0))

    def predict(self, x: np.ndarray) -> tuple[list[str], np.ndarray]:
        """Language and score of each row of features."""
        n = len(x)
        m = (x @ self.w[:, :-1].T + self.w[:, -1]).astype(np.float64)
        k = len(self.families) if len(self.families) > 1 else 0
        best, sure = np.zeros(n, np.int64), np.ones(n)
        if k:
            p = 1 / (1 + np.exp(-np.clip(4 * m[:, :k], -50, 50)))
            best = m[:, :k].argmax(axis=1)
            sure = p[np.arange(n), best] / p.sum(axis=1)
        out, score = np.empty(n, object), np.zeros(n)
        for j, f in enumerate(self.families):
            at = np.flatnonzero(best == j)
            votes = np.zeros((len(at), len(self.of[f])))
            for c, (g, a, b) in enumerate(self.pairs):
                if g == f:
                    p = 1 / (1 + np.exp(-np.clip(4 * m[at, k + c], -50, 50)))
                    votes[:, self.of[f].index(a)] += p
                    votes[:, self.of[f].index(b)] += 1 - p
            if len(self.of[f]) == 1:
                votes += 1
            won = votes.argmax(axis=1)
            out[at] = np.array(self.of[f], object)[won]
            score[at] = sure[at] * votes[np.arange(len(at)), won] / np.maximum(len(self.of[f]) - 1, 1)
        return out.tolist(), score


def _remainder(id_col: str):
    return F.crc32(F.col(id_col).cast("string")) % 4


def _unpack(packed: list[bytes]) -> Rows:
    n = [len(p) // 6 for p in packed]
    return Rows([np.frombuffer(p[: 2 * k], np.uint16) for p, k in zip(packed, n, strict=True)], [np.frombuffer(p[2 * k :], np.float32) for p, k in zip(packed, n, strict=True)])


def _sample(docs: DataFrame, id_col: str, text_col: str, lang_col: str, sample: int, langs: int, most: int) -> DataFrame | None:
    """Texts and languages to learn from; None if there are none."""
    rows = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & (_remainder(id_col) != 2))
    rows = rows.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text"), F.pmod(F.xxhash64(text_col, F.lit(11)), F.lit(1 << 40)).alias("h"))
    per = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.approx_count_distinct("h").alias("texts"))
    counts = {r["lang"]: r["texts"] for r in per.orderBy(F.col("n").desc(), "lang").limit(langs).collect()}
    if not counts:
        return None
    each = max(1, min(sample, most // len(counts)))
    # of each language the smallest hashes, from among those below a cut that about 4 * each of its texts pass: so no task ranks more
    cut = F.create_map(*[F.lit(x) for lang, n in sorted(counts.items()) for x in (lang, min(1.0, 4 * each / n))])
    low = rows.select("lang", "h").where(F.col("h") < F.element_at(cut, F.col("lang")) * (1 << 40)).distinct()
    picked = low.withColumn("n", F.row_number().over(Window.partitionBy("lang").orderBy("h"))).where(F.col("n") <= each).select("lang", "h")
    # `most` rows of two numbers: small enough to send to all
    return rows.join(F.broadcast(picked), ["lang", "h"], "left_semi").groupBy("lang", "h").agg(F.min("text").alias("text")).select("lang", "text")


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample: int = SAMPLE, langs: int = LANGS, most: int = MOST) -> Model | None:
    """Learn from rows with a text and a language whose id doesn't belong to the held out quarter; None if there are none.

    A text that stands in many rows counts once for each of its languages.
    """
    spark = docs.sparkSession
    own = _sample(docs, id_col, text_col, lang_col, sample, langs, most)
    if own is None:
        return None

    def make():
        def f(texts):
            out = []
            for _, _, data, offsets in slices(texts):
                for row in features(data, offsets):
                    at = np.flatnonzero(row)
                    out.append(at.astype(np.uint16).tobytes() + row[at].astype(np.float32).tobytes())
            return [pa.array(out, pa.binary())]

        return f

    got = add_columns(own, ["text"], "f binary", make, drop=("text",)).toArrow()
    if not got.num_rows:
        return None
    rows = sorted(zip(got.column("lang").to_pylist(), got.column("f").to_pylist(), strict=True))
    model = Model([r[0] for r in rows])
    if not model.machines:
        return model
    shared = spark.sparkContext.broadcast((model, rows))

    def train(batches):
        model, rows = shared.value
        x, lang = None, np.array([r[0] for r in rows], object)
        for b in batches:
            for m in b.column("machine").to_pylist():
                x = _unpack([r[1] for r in rows]) if x is None else x
                trim()
                yield pa.RecordBatch.from_pydict({"machine": pa.array([m], pa.int32()), "w": pa.array([model.train(m, x, lang).astype(np.float32).tobytes()], pa.binary())})

    n = len(model.machines)
    machines = spark.range(0, n, 1, n).select(F.col("id").cast("int").alias("machine"))
    for r in machines.mapInArrow(train, "machine int, w binary").collect():  # a row for each machine
        model.w[r["machine"]] = np.frombuffer(r["w"], np.float32)
    return model


def predict(docs: DataFrame, model: Model | None, text_col: str = "text", drop: tuple[str, ...] = ()) -> DataFrame:
    """docs with lang_pred and score. Null texts, texts without a letter, and all texts if nothing was learned: und, 0.

    Other columns pass through; columns of these two names are replaced.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        model = shared.value

        def f(texts):
            langs, scores = [], []
            for i, j, data, offsets in slices(texts):
                n = j - i
                letters = np.concatenate([[0], np.cumsum(_ASCII_LETTER[data])])[offsets]
                some = np.diff(letters) > 0
                for d in np.flatnonzero(~some):
                    some[d] = has_letter(data[offsets[d] : offsets[d + 1]].tobytes().decode("utf-8", "replace"))
                pred, score = model.predict(features(data, offsets)) if model is not None else ([UND] * n, np.zeros(n))
                langs += [p if s else UND for p, s in zip(pred, some, strict=True)]
                scores.append(np.where(some, score, 0.0))
            return pa.array(langs, pa.string()), pa.array(np.concatenate(scores) if scores else [], pa.float64())

        return f

    return add_columns(docs, [text_col], "lang_pred string, score double", make, drop)


def language_report(docs: DataFrame) -> DataFrame:
    """Predicted language and score of every document, and whether it is held out from learning."""
    held = F.coalesce(_remainder("doc_id") == 2, F.lit(False)).alias("held_out")
    return predict(docs.select("doc_id", "text", held), fit(docs), drop=("text",))


def keep_known(docs: DataFrame, min_score: float = 0.0) -> DataFrame:
    """Documents that have a language with at least that score, with their own columns."""
    tag = "__text"
    renamed = docs.withColumnsRenamed({c: f"__own_{c}" for c in docs.columns}).withColumn(tag, F.col("__own_text"))
    found = predict(renamed, fit(docs), text_col=tag, drop=(tag,))
    return found.where((F.col("lang_pred") != UND) & (F.col("score") >= min_score)).select(*[F.col(f"__own_{c}").alias(c) for c in docs.columns])
