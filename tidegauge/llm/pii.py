"""Personal data by generated candidates and boosted trees.

Generators with high recall propose spans, which may overlap. Spans of the four base kinds hold by their format alone
and always stay. Of the other kinds a span is kept if gradient boosted trees, over features of its format, of its checksum and of
the text around it, give it a probability over a threshold; probabilities and thresholds are calibrated on examples that the
trees haven't seen. The trees are learned on the driver from a few thousand examples that are made by rule; they are applied as SQL
expressions. Only DataFrame functions touch documents, in one pass and without a shuffle.
"""

from __future__ import annotations

import functools
import json
import math
import random
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: Base kinds in the order in which spans of one start are listed. Repeats are possessive and runs begin where no
#: character of the run stands before, which gives the same matches in time linear in the text.
BASE = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Kinds whose spans the trees judge. Generators are wide; words around a span decide.
JUDGED = {
    "phone_local": r"(?<![0-9A-Za-z+.-])\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9A-Za-z])",
    "national_id": r"(?<![0-9A-Za-z-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z-])",
    "iban": r"(?<![0-9A-Za-z])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){3,7}(?:\x20?[A-Z0-9]{1,3})?(?![0-9A-Za-z])",
    "email_spelled": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++\x20?[\[(]at[\])]\x20?[A-Za-z0-9-]++(?:\x20?(?:\.|[\[(]dot[\])])\x20?[A-Za-z0-9-]++)++",
    "secret": r"(?<![A-Za-z0-9])(?:[Pp]assword|[Pp]asswd|[Tt]oken|[Ss]ecret|[Aa]pi[_-]?[Kk]ey)\x20?[=:]\x20?\"?[A-Za-z0-9_-]{8,}+\"?",
    "mac": r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{2}:){5}[0-9A-Fa-f]{2}(?![0-9A-Fa-f:])",
}
KINDS = [*BASE, *JUDGED]
#: What must stand in a text for a generator to run.
_GUARD = {"email": "@", "phone": "+", "email_spelled": "at", "mac": ":"}
#: Words before a span that speak for a kind, and words that speak against any.
_CUES = {
    "phone_local": r"(?:phone|tel|call|mobile|fax|cell|contact|dial|reach)",
    "national_id": r"(?:ssn|social|security|national|tax|id\b)",
    "iban": r"(?:iban|account|bank|transfer|payment)",
    "email_spelled": r"(?:mail|contact|write|reach|address)",
    "secret": r"(?:login|user|credential|auth|key|access)",
    "mac": r"(?:mac|device|hardware|adapter|ether)",
}
_AGAINST = r"(?:order|part|version|isbn|serial|item|page|example|model|invoice|lot|ref)"

_SPANS = "array<struct<s:int,k:int,e:int,m:string,l:string,r:string>>"
#: Code points in a block of a text that is put together anew.
_BLOCK_BITS = 10


def _empty() -> Column:
    return F.expr(f"cast(array() as {_SPANS})")


def _let(value: Column, f: Callable[[Column], Column]) -> Column:
    """f of a value that is worked out once, however often f uses it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def _scan(values: Column, op: Callable[[Column, Column], Column]) -> Column:
    """Running results of an associative operation over an array, in as many passes as its length has binary digits."""

    def step(acc: Column, k: Column) -> Column:
        back = F.call_function("shiftleft", F.lit(1), k)
        return F.transform(acc, lambda v, i: F.when(i >= back, op(v, F.get(acc, i - back))).otherwise(v))

    def run(a: Column) -> Column:
        passes = F.sequence(F.lit(0), F.ceil(F.log2(F.size(a))).cast("int"))
        return F.when(F.size(a) > 1, F.aggregate(passes, a, step)).otherwise(a)

    return _let(values, run)


def _guard(k: str, t: Column) -> Column:
    """Something that a text with a match of the kind always holds; it follows from the kind's pattern."""
    if k in _GUARD:
        return t.contains(_GUARD[k])
    return {"secret": F.lit(True), "ip": t.rlike(r"[0-9]\.[0-9]"), "card": t.rlike(r"[0-9][\x20-]?[0-9]")}.get(k, t.rlike("[0-9]{2}"))


def _located(t: Column, k: str, pattern: str) -> Column:
    """Spans of one kind in a text: start, the kind's number, end, what matches and what stands around it; code points.

    Ends are running sums of the lengths of matches and of the pieces between, so the work is in proportion to the text
    and to n log n of its n matches.
    """
    number = KINDS.index(k)

    def placed(m: Column, p: Column) -> Column:
        ends = _scan(F.transform(m, lambda x, i: F.length(F.get(p, i)) + F.length(x)), lambda a, b: a + b)

        def span(c: Column):
            return lambda x, i: F.struct(
                (F.get(c, i) - F.length(x)).alias("s"), F.lit(number).alias("k"), F.get(c, i).alias("e"), x.alias("m"),
                F.right(F.get(p, i), F.lit(40)).alias("l"), F.left(F.get(p, i + 1), F.lit(8)).alias("r"),
            )

        return _let(ends, lambda c: F.transform(m, span(c)))

    def some(m: Column) -> Column:
        return F.when(F.size(m) > 0, _let(F.split(t, pattern, -1), lambda p: placed(m, p))).otherwise(_empty())

    return F.when(_guard(k, t), _let(F.regexp_extract_all(t, F.lit(pattern), F.lit(0)), some)).otherwise(_empty())


def _piece(blocks: Column, a: Column, b: Column) -> Column:
    """Code points a to b of a text that is given in blocks; only blocks that the piece touches are looked at."""
    i, j, low = F.shiftright(a, _BLOCK_BITS), F.shiftright(b, _BLOCK_BITS), (1 << _BLOCK_BITS) - 1
    at = a.bitwiseAND(low) + 1
    between = F.when(j > i + 1, F.array_join(F.transform(F.sequence(i + 1, j - 1), lambda x: F.get(blocks, x)), "")).otherwise("")
    across = F.concat(F.substring(F.get(blocks, i), at, F.lit(low + 1)), between, F.coalesce(F.substring(F.get(blocks, j), F.lit(1), b.bitwiseAND(low)), F.lit("")))
    return F.when(b <= a, "").when(i == j, F.substring(F.get(blocks, i), at, b - a)).otherwise(across)


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def _holds(span: Column) -> Column:
    """Whether a match of a base kind has the right format."""
    n = F.length(_digits(span["m"]))
    part_ok = F.forall(F.split(span["m"], r"\."), lambda x: F.ltrim(x, F.lit("0")).rlike("^(?:[0-9]{0,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$"))
    return (
        F.when(span["k"] == KINDS.index("email"), True)
        .when(span["k"] == KINDS.index("ip"), part_ok)
        .when(span["k"] == KINDS.index("card"), n.between(14, 19) & F.call_function("luhn_check", _digits(span["m"])))
        .otherwise(n.between(10, 15))
    )


def _mod97(m: Column) -> Column:
    """Remainder of an account number by 97, letters as two digits and its first four characters last; 1 if it is right."""
    plain = F.replace(m, F.lit(" "), F.lit(""))
    chars = F.filter(F.split(F.concat(F.substring(plain, 5, 64), F.left(plain, F.lit(4))), ""), lambda c: c != "")

    def step(acc: Column, c: Column) -> Column:
        return F.when(c.between("0", "9"), acc * 10 + F.ascii(c) - 48).otherwise(acc * 100 + F.ascii(c) - 55) % 97

    return F.aggregate(chars, F.lit(0), step)


def _features(x: Column) -> list[Column]:
    """Numbers that the trees look at, for a span of a judged kind: its format, its checksum, and the text around it."""
    left, m = F.lower(x["l"]), x["m"]
    digits = _digits(m)
    cue = F.lit(0.0)
    for k, words in _CUES.items():
        cue = F.when((x["k"] == KINDS.index(k)) & left.rlike(words), 1.0).otherwise(cue)
    return [
        x["k"].cast("double"),
        F.length(m).cast("double"),
        F.length(digits).cast("double"),
        F.length(F.regexp_replace(m, "[A-Za-z0-9]", "")).cast("double"),
        F.size(F.array_distinct(F.split(digits, ""))).cast("double"),
        cue,
        F.when(left.rlike(_AGAINST), 1.0).otherwise(0.0),
        F.when(m.rlike(r"[A-Za-z].*[0-9]|[0-9].*[A-Za-z]"), 1.0).otherwise(0.0),
        F.when(left.rlike(r"[:=]\s*\"?$"), 1.0).otherwise(0.0),
        F.when(digits.rlike("^(?:000|666|9)|^0|^123|(?:0000)$"), 1.0).otherwise(0.0),
        F.when(x["r"].rlike(r"^[A-Za-z0-9]"), 1.0).otherwise(0.0),
        F.when(x["k"] == KINDS.index("iban"), F.when(_mod97(m) == 1, 1.0).otherwise(0.0)).otherwise(0.0),
        F.size(F.array_distinct(F.split(F.lower(m), ""))).cast("double"),
        F.when(left.rlike(r"[.!?\n]\s*$"), 1.0).otherwise(0.0),
        F.when(left.rlike(r"[0-9]"), 1.0).otherwise(0.0),
        F.length(F.regexp_extract(left, r"([a-z]*)[^a-z]*$", 1)).cast("double"),
    ]


def examples(seed: int = 5, n: int = 240) -> list[tuple[str, int]]:
    """Texts that hold one candidate each, with 1 if it is personal data; n for each judged kind."""
    r = random.Random(seed)
    filler = "the and of that there with on ed er ing tion was report we le de la und der value result see also".split()
    num = lambda k: "".join(r.choice("0123456789") for _ in range(k))
    word = lambda k: "".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(k))
    hexa = lambda k: "".join(r.choice("0123456789abcdef") for _ in range(k))
    some = lambda: " ".join(r.choice(filler) for _ in range(r.randint(1, 6)))

    def account(country: str, digits: str) -> str:
        rest = int(digits + "".join(str(ord(c) - 55) for c in country) + "00") % 97
        sep = r.choice(["", " "])
        return f"{country}{98 - rest:02d}{sep}" + sep.join(digits[i : i + 4] for i in range(0, len(digits), 4))

    first = lambda: r.choice("2345678") + num(2)
    good = {
        "phone_local": (("phone", "Tel:", "call me at", "mobile", "contact", "fax:", "reach us on"), lambda: r.choice(["({}) {}-{}", "{}-{}-{}", "{}.{}.{}", "{} {} {}"]).format(first(), num(3), num(4))),
        "national_id": (("SSN", "social security number", "SSN:", "national id", "tax id"), lambda: f"{r.choice('12345')}{num(2)}-{num(2)}-{num(3)}{r.choice('123456789')}"),
        "iban": (("IBAN", "bank account", "IBAN:", "transfer to", "payment to"), lambda: account(r.choice(["DE", "FR", "ES", "IT"]), num(4 * r.randint(4, 5)))),
        "email_spelled": (("mail", "write to", "contact", "reach me:", "", "address"), lambda: f"{word(5)}.{word(4)} [at] {word(6)} [dot] {r.choice(['com', 'org'])}"),
        "secret": (("", "login with", "user", "auth", "credentials"), lambda: r.choice(["password=", 'token = "', "secret: ", "api_key="]) + hexa(r.randint(16, 40))),
        "mac": (("MAC", "device", "hardware address", "adapter"), lambda: ":".join(hexa(2) for _ in range(6))),
    }
    bad = {
        "phone_local": (("order", "part", "version", "serial", "", "", "item", "ref"), good["phone_local"][1]),
        "national_id": (("order", "part no", "invoice", "", "lot", "model"), lambda: r.choice([f"000-{num(2)}-{num(4)}", f"9{num(2)}-{num(2)}-{num(4)}", f"{num(3)}-{num(2)}-0000", f"{num(3)}-{num(2)}-{num(4)}"])),
        "iban": (("model", "serial", "part", "", "version"), lambda: "".join(r.choice("ABCDEFGH") for _ in range(2)) + num(2) + " " + " ".join("".join(r.choice("ABCDEFGHIJKLMNOP") for _ in range(4)) for _ in range(r.randint(3, 5)))),
        "email_spelled": (("example", "ref", "item", "page"), lambda: f"{word(3)} (at) {word(4)}.{num(2)}"),
        "secret": (("example", "page", "", "see"), lambda: r.choice(["token: ", "password: ", "secret: "]) + r.choice(["required", "forgotten", "incorrect", "management", "expiration"])),
        "mac": (("version", "ref", "page", "order", "example"), lambda: ":".join(num(2) for _ in range(6))),
    }
    out = []
    for kind in JUDGED:
        for i in range(n):
            cues, make = (good if i % 2 else bad)[kind]
            out.append((f"{some()} {r.choice(cues)} {make()} {some()}", i % 2))
    r.shuffle(out)
    return out


class Trees:
    """Gradient boosting with logistic loss; trees as nested tuples (feature, cut, left, right) or leaves."""

    def __init__(self, x: np.ndarray, y: np.ndarray, rounds: int = 30, rate: float = 0.3, depth: int = 3):
        p = np.clip(y.mean(), 1e-3, 1 - 1e-3)
        self.base, self.trees = float(np.log(p / (1 - p))), []
        f = np.full(len(y), self.base)
        for _ in range(rounds):
            p = 1 / (1 + np.exp(-f))
            tree = self._grow(x, y - p, p * (1 - p), np.arange(len(y)), depth, rate)
            self.trees.append(tree)
            f += np.array([self._one(tree, row) for row in x])

    def _grow(self, x, g, h, at, depth, rate):
        leaf = round(float(rate * g[at].sum() / (h[at].sum() + 1.0)), 6)
        if not depth or len(at) < 10:
            return leaf
        best, gain = None, 1e-6
        whole = g[at].sum() ** 2 / (h[at].sum() + 1.0)
        for j in range(x.shape[1]):
            for cut in np.unique(x[at, j])[:-1][:40]:
                left = x[at, j] <= cut
                a, b = at[left], at[~left]
                now = g[a].sum() ** 2 / (h[a].sum() + 1.0) + g[b].sum() ** 2 / (h[b].sum() + 1.0) - whole
                if now > gain and len(a) >= 5 and len(b) >= 5:
                    best, gain = (j, float(cut), a, b), now
        if best is None:
            return leaf
        j, cut, a, b = best
        return j, cut, self._grow(x, g, h, a, depth - 1, rate), self._grow(x, g, h, b, depth - 1, rate)

    def _one(self, tree, row):
        while isinstance(tree, tuple):
            tree = tree[2] if row[tree[0]] <= tree[1] else tree[3]
        return tree

    def margin(self, x: np.ndarray) -> np.ndarray:
        return np.array([self.base + sum(self._one(t, row) for t in self.trees) for row in x])

    def sql(self, names: list[str]) -> str:
        """The sum of all trees as an SQL expression over the named features."""

        def one(t):
            return f"IF({names[t[0]]} <= {t[1]}D, {one(t[2])}, {one(t[3])})" if isinstance(t, tuple) else f"{t}D"

        return " + ".join([f"{self.base}D", *map(one, self.trees)])


def platt(margin: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset of the logistic curve that makes margins probabilities; the slope is positive."""
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * margin + b, -35, 35)))
        w = p * (1 - p) + 1e-6
        g = np.array([((y - p) * margin).sum() - 0.01 * (a - 1), (y - p).sum()])
        h = np.array([[(w * margin * margin).sum() + 0.01, (w * margin).sum()], [(w * margin).sum(), w.sum()]])
        step = np.linalg.solve(h, g)
        a, b = max(a + float(step[0]), 0.05), b + float(step[1])
        if np.abs(step).max() < 1e-9:
            break
    return a, b


@dataclass(frozen=True)
class Judge:
    """Trees, the curve from margins to probabilities, and the least probability for each judged kind."""

    trees: Trees
    curve: tuple[float, float]
    least: dict[int, float]

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.curve[0] * self.trees.margin(x) + self.curve[1], -35, 35)))

    def margins(self) -> dict[int, float]:
        """The margin at each kind's least probability."""
        a, b = self.curve
        return {k: (math.log(p / (1 - p)) - b) / a for k, p in self.least.items()}


@functools.lru_cache(maxsize=2)
def _learn(rows: str) -> Judge:
    """Learn on three quarters of the examples and calibrate on the last.

    A kind's least probability is the least one from which on 49 of 50 unseen examples are right, 0.6 at least.
    """
    data = json.loads(rows)
    x, y = np.array([r[0] for r in data], float), np.array([r[1] for r in data], float)
    fold = np.arange(len(y)) % 4 == 0
    trees = Trees(x[~fold], y[~fold])
    curve = platt(trees.margin(x[fold]), y[fold])
    judge = Judge(trees, curve, {})
    p, kind = judge.probability(x[fold]), x[fold, 0]
    for name in JUDGED:
        k = KINDS.index(name)
        m, t = p[kind == k], y[fold][kind == k]
        order = np.argsort(-m, kind="stable")
        right = np.cumsum(t[order]) / np.arange(1, len(order) + 1)
        good = np.flatnonzero(right >= 0.98)
        if not len(good):
            raise ValueError(f"no threshold makes spans of {name} right often enough")
        s = np.append(m[order], 0.0)
        judge.least[k] = min(max(0.6, float(s[good[-1]] + s[good[-1] + 1]) / 2), 1 - 1e-6)
    return judge


def _featured(spark: SparkSession, made: list[tuple[str, int]]) -> list:
    """Features and label of each candidate in made texts, by the expressions that documents go through."""
    rows = [{"i": i, "t": t, "y": y} for i, (t, y) in enumerate(made)]
    df = spark.range(1).select(F.explode(F.from_json(F.lit(json.dumps(rows)), "array<struct<i:int,t:string,y:int>>")).alias("x")).select("x.*")
    df = df.select("i", "y", F.explode(F.concat(*[_located(F.col("t"), k, p) for k, p in JUDGED.items()])).alias("c"))
    got = df.select("i", F.col("c.s").alias("s"), F.array(*_features(F.col("c"))).alias("f"), "y").orderBy("i", "s", F.col("c.k")).collect()
    return [[list(r["f"]), r["y"]] for r in got]


@functools.lru_cache(maxsize=1)
def fit(spark: SparkSession) -> Judge:
    """Learn from the examples, once in a session."""
    return _learn(json.dumps(_featured(spark, examples())))


def reliability(spark: SparkSession, seed: int = 99, n: int = 200, bins: int = 5) -> list[tuple[str, float, int, float, float]]:
    """For each kind and bin of probability, over examples made anew: lower edge, number, mean probability, share that is personal data."""
    judge, rows = fit(spark), _featured(spark, examples(seed, n))
    x, y = np.array([r[0] for r in rows], float), np.array([r[1] for r in rows], float)
    p, out = judge.probability(x), []
    for name in JUDGED:
        for b in range(bins):
            at = (x[:, 0] == KINDS.index(name)) & (np.minimum((p * bins).astype(int), bins - 1) == b)
            if at.any():
                out.append((name, b / bins, int(at.sum()), round(float(p[at].mean()), 4), round(float(y[at].mean()), 4)))
    return out


def find(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with spans, an array of (s, e, k): start and end in code points and the number of the kind, by start and kind.

    A null or empty text has no spans; repeated rows each have their own; an empty table gives no rows. Spans of base kinds
    are those of the right format; a span of another kind that lies within one of these isn't listed again. Spans of other
    kinds may overlap each other and parts of base spans. Other columns pass through; a column named spans is replaced.
    Work is in proportion to the text, and to n log n of the n matches in it.
    """
    judge = fit(docs.sparkSession)
    df = docs.withColumn("__t", F.coalesce(F.col(text_col), F.lit("")))
    t = F.col("__t")
    base = F.filter(F.concat(*[_located(t, k, p) for k, p in BASE.items()]), _holds)
    df = df.withColumns({"__base": base, "__more": F.concat(*[_located(t, k, p) for k, p in JUDGED.items()])}).drop("__t")
    bare = lambda c: F.struct(c["s"].alias("s"), c["e"].alias("e"), c["k"].alias("k"))

    def outside(every: Column) -> Column:
        """Spans by start and kind, without judged ones that lie within a base span; base kinds come first at a start."""
        reach = _scan(F.transform(every, lambda c: F.when(c["k"] < len(BASE), c["e"]).otherwise(0)), F.greatest)
        kept = _let(reach, lambda top: F.filter(every, lambda c, i: (c["k"] < len(BASE)) | (F.get(top, i) < c["e"])))
        none = F.array().cast("array<double>")
        return F.transform(kept, lambda c: F.struct(c["s"].alias("s"), c["e"].alias("e"), c["k"].alias("k"), F.when(c["k"] >= len(BASE), F.array(*_features(c))).otherwise(none).alias("f")))

    df = df.withColumn("__all", F.when(F.size("__more") > 0, _let(F.array_sort(F.concat("__base", "__more")), outside)))
    width = len(_features(F.struct(F.lit(0).alias("k"), *[F.lit("").alias(c) for c in "mlr"])))
    margin = judge.trees.sql([f"c.f[{j}]" for j in range(width)])
    limit = " ".join(f"WHEN {k} THEN {v}D" for k, v in judge.margins().items())
    chosen = F.transform(F.expr(f"filter(__all, c -> c.k < {len(BASE)} OR ({margin}) >= CASE c.k {limit} ELSE 1e9D END)"), bare)
    return df.withColumn("spans", F.when(F.size("__more") > 0, chosen).otherwise(F.transform(F.array_sort("__base"), bare))).drop("__base", "__more", "__all")


def _names() -> Column:
    return F.array(*map(F.lit, KINDS))


def pii_report(docs: DataFrame) -> DataFrame:
    """Per document: counts of base spans by kind, their digest, and all spans as kind:start:end."""
    found = find(docs.select("doc_id", "text")).drop("text")
    said = lambda a: F.array_join(F.transform(a, lambda c: F.concat_ws(":", F.element_at(_names(), c["k"] + 1), c["s"].cast("string"), c["e"].cast("string"))), ",")
    base = F.filter("spans", lambda c: c["k"] < len(BASE))
    counts = [F.size(_of(n)).cast("long").alias(f"n_{k}") for n, k in enumerate(BASE)]
    return found.select("doc_id", *counts, F.sha2(said(base), 256).alias("base_sha256"), said(F.col("spans")).alias("spans"))


def _of(n: int) -> Column:
    return F.filter("spans", lambda c: c["k"] == n)


def redact(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with each span in the text replaced by its kind in brackets; spans that overlap are replaced as one, under the first kind.

    Null and empty texts stay; other columns pass through, whatever their names. The text is put together from blocks,
    so the work is in proportion to it.
    """
    columns = docs.columns
    found = find(docs.withColumnsRenamed({c: f"__own_{c}" for c in columns}), f"__own_{text_col}")
    text = F.col(f"__own_{text_col}")

    def clean(blocks: Column) -> Column:
        def around(reach: Column) -> Column:
            before = lambda i: F.when(i > 0, F.get(reach, i - 1)).otherwise(0)
            heads = F.filter(F.transform("spans", lambda c, i: F.struct(before(i).alias("a"), c["s"].alias("b"), c["k"].alias("k"))), lambda x: x["b"] >= x["a"])
            marked = F.transform(heads, lambda x: F.concat(_piece(blocks, x["a"], x["b"]), F.lit("["), F.upper(F.element_at(_names(), x["k"] + 1)), F.lit("]")))
            return F.concat(F.array_join(marked, ""), _piece(blocks, F.element_at(reach, -1), F.length(text)))

        return _let(_scan(F.transform("spans", lambda c: c["e"]), F.greatest), around)

    blocks = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{1 << _BLOCK_BITS}}}"), F.lit(0))
    return found.withColumn(f"__own_{text_col}", F.when(F.size("spans") > 0, _let(blocks, clean)).otherwise(text)).select(*[F.col(f"__own_{c}").alias(c) for c in columns])
