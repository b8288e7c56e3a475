"""Licence scan by a positional index of rare words.

Templates are word sequences with key phrases that must stand in the file as they are. The words of all templates form
the vocabulary; a pass over all files counts in how many files each of its words stands. Each template is posted under
its rarest words with their places in it. In a file, the places of these words, each less its place in the template,
are intersected: what remains are the starts at which all of them stand in the right relative position. There the key
phrases are verified word by word.

Only DataFrame functions are used. Texts are cut into words once; of each file that has all mandatory words of some template
the words' numbers in the vocabulary are kept. What reaches the driver is one count for each word of the vocabulary.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from tidegauge.llm._frames import written

#: Rare words that a template is posted under, at most.
RARE = 3

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Template:
    """A licence's label, its words, and phrases among them that are mandatory; base phrases are mandatory as a whole."""

    label: str
    text: str
    keys: tuple[str, ...]
    base: bool = False

    @property
    def words(self) -> list[str]:
        return self.text.split()

    @property
    def must(self) -> dict[str, int]:
        """Words of the key phrases, without which the template can't be found, each with its first place in one of them."""
        at = sorted((self.offset(k) + i, w) for k in self.keys for i, w in enumerate(k.split()))
        return {w: i for i, w in reversed(at)}

    def offset(self, phrase: str) -> int:
        w, p = self.words, phrase.split()
        return next(i for i in range(len(w)) if w[i : i + len(p)] == p)


def _base(label: str, text: str) -> Template:
    return Template(label, text, (text,), True)


#: The phrases of the base, and wordings by which other licences are known.
TEMPLATES = (
    _base("mit", "under the mit license"),
    _base("apache-2", "apache license version 2"),
    _base("cc-by-nc", "cc by nc"),
    Template("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software", ("permission is hereby granted", "free of charge")),
    Template("apache-2", "you may not use this file except in compliance with the license", ("use this file except in compliance",)),
    Template("gpl", "licensed under the gnu general public license", ("gnu general public license",)),
    Template("lgpl", "licensed under the gnu lesser general public license", ("gnu lesser general public license",)),
    Template("agpl", "licensed under the gnu affero general public license", ("gnu affero general public license",)),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are permitted", ("redistribution and use in source and binary forms",)),
    Template("isc", "permission to use copy modify and or distribute this software for any purpose", ("permission to use copy modify",)),
    Template("mpl-2", "subject to the terms of the mozilla public license version 2", ("mozilla public license",)),
    Template("cc-by", "licensed under a creative commons attribution license", ("creative commons attribution",)),
    Template("cc-by-nc", "licensed under a creative commons attribution noncommercial license", ("creative commons attribution noncommercial",)),
    Template("unlicense", "this is free and unencumbered software released into the public domain", ("free and unencumbered software",)),
    Template("bsd-3", "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission", ("nor the names of its contributors may be used to endorse or promote products", "without specific prior written permission")),
    Template("zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software", ("without any express or implied warranty", "in no event will the authors be held liable")),
    Template("mit", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software", ("this permission notice shall be included in all copies or substantial portions",)),
    Template("apache-2", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis", ("unless required by applicable law or agreed to in writing",)),
    Template("gpl", "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation", ("under the terms of the gnu general public license",)),
    Template("lgpl", "you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation", ("under the terms of the gnu lesser general public license",)),
    Template("agpl", "you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation", ("under the terms of the gnu affero general public license",)),
    Template("boost", "boost software license version 1 0", ("boost software license",)),
    Template("epl", "made available under the terms of the eclipse public license", ("eclipse public license",)),
    Template("cddl", "common development and distribution license", ("common development and distribution license",)),
    Template("ofl", "this font software is licensed under the sil open font license version 1 1", ("sil open font license",)),
    Template("eupl", "licensed under the european union public licence", ("european union public licence",)),
    Template("cc0", "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work", ("waived all copyright and related or neighboring rights",)),
    Template("cc-by-sa", "licensed under a creative commons attribution sharealike license", ("creative commons attribution sharealike",)),
    Template("odbl", "made available under the open database license", ("open database license",)),
    Template("all-rights-reserved", "all rights reserved", ("all rights reserved",)),
)


def words(text: Column) -> Column:
    """Words of a text: runs of ASCII letters, lower-cased, digits and what isn't ASCII."""
    plain = F.trim(F.regexp_replace(F.translate(F.coalesce(text, F.lit("")), _UPPER, _LOWER), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", " "))
    return F.when(plain == "", F.array().cast("array<string>")).otherwise(F.split(plain, " ", -1))


def rarity(own: DataFrame, own_col: str, vocabulary: list[str]) -> dict[str, float]:
    """Inverse document frequency of each word of the vocabulary, by the column that has those of its words a file has."""
    # one row more for each file counts the files
    counts = own.select(F.explode(F.array_append(own_col, F.lit(""))).alias("w")).groupBy("w").count()
    df = {r["w"]: r["count"] for r in counts.collect()}
    return {w: math.log((1 + df.get("", 0)) / (1 + df.get(w, 0))) for w in vocabulary}


def _rarest(t: Template, idf: dict[str, float]) -> list[tuple[str, int]]:
    return sorted(t.must.items(), key=lambda x: (-idf[x[0]], x[1]))[:RARE]


def _coded(files: DataFrame, text_col: str, templates: tuple[Template, ...], vocabulary: list[str]) -> DataFrame:
    """files with n_words, __own (words of the vocabulary that a file has), __may (templates all of whose mandatory words
    are among them) and, if there is one, __w: for each word of the file its number in the vocabulary, or 0."""
    known = F.array(*map(F.lit, vocabulary))
    kind = "smallint" if len(vocabulary) < 1 << 15 else "int"
    number = F.transform("__s", lambda x: F.when(x.isin(vocabulary), F.array_position(known, x)).otherwise(F.lit(0)).cast(kind))
    may = [F.when(F.size(F.array_intersect("__own", F.array(*map(F.lit, sorted(t.must))))) == len(t.must), F.lit(n)) for n, t in enumerate(templates)]
    split = files.withColumn("__s", words(F.col(text_col)))
    split = split.withColumns({"n_words": F.size("__s").cast("long"), "__own": F.array_intersect("__s", known)})
    split = split.withColumn("__may", F.array_compact(F.array(*may)))
    return split.withColumn("__w", F.when(F.size("__may") > 0, number)).drop("__s")


def scan(files: DataFrame, text_col: str = "text", templates: tuple[Template, ...] = TEMPLATES, drop: tuple[str, ...] = ()) -> DataFrame:
    """files with n_words and found, an array of (template, start, share) by template and start.

    share is the part of the template's words, weighted by rarity, that stand in their places. A null or empty text
    has no words and nothing is found; a text of any length is read as a whole. Other columns pass through but for those
    in drop; columns named n_words and found are replaced. Repeated rows have a row each, an empty table none.

    Texts are cut into words once: what later steps need of them, and the columns that pass through, are kept in the
    shared folder, so the text should be in drop where it isn't needed.
    """
    vocabulary = sorted({w for t in templates for w in t.words})
    code = {w: n for n, w in enumerate(vocabulary, 1)}
    split = written(_coded(files, text_col, templates, vocabulary).drop(*drop))
    idf = rarity(split, "__own", vocabulary)
    posted = [_rarest(t, idf) for t in templates]
    wanted = sorted({code[w] for p in posted for w, _ in p})
    w = F.col("__w")
    kind = split.schema["__w"].dataType.elementType
    places = F.filter(F.transform(w, lambda x, i: F.struct(x.alias("w"), i.alias("i"))), lambda x: x["w"].isin(wanted))
    split = split.withColumn("__at", places)

    def starts(word: str, rel: int) -> Column:
        return F.transform(F.filter(F.col("__at"), lambda x: x["w"] == code[word]), lambda x: x["i"] - rel)

    def stands(key: list[str], off: int):
        phrase = F.array(*[F.lit(code[x]).cast(kind) for x in key])
        return lambda s: F.when(s + off >= 0, F.slice(w, s + off + 1, F.lit(len(key))) == phrase).otherwise(False)

    def found(n: int, t: Template) -> Column:
        at = starts(*posted[n][0])
        for word, rel in posted[n][1:]:
            at = F.array_intersect(at, starts(word, rel))
        for key in t.keys:
            at = F.filter(at, stands(key.split(), t.offset(key)))
        if t.base:
            return F.transform(F.array_distinct(at), lambda s: F.struct(F.lit(n).alias("template"), s.alias("start"), F.lit(1.0).alias("share")))
        weights = F.array(*[F.struct(F.lit(code[x]).cast(kind).alias("w"), F.lit(i).alias("i"), F.lit(idf[x] + 1e-9).alias("v")) for i, x in enumerate(t.words)])
        total = sum(idf[x] + 1e-9 for x in t.words)

        def share(s: Column) -> Column:
            def one(acc, x):
                return acc + F.when((s + x["i"] >= 0) & (F.get(w, s + x["i"]) == x["w"]), x["v"]).otherwise(0.0)

            return F.least(F.lit(1.0), F.aggregate(weights, F.lit(0.0), one) / total)

        return F.transform(F.array_distinct(at), lambda s: F.struct(F.lit(n).alias("template"), s.alias("start"), share(s).alias("share")))

    empty = F.expr("cast(array() as array<struct<template:int,start:int,share:double>>)")
    each = [F.when(F.array_contains("__may", n), found(n, t)).otherwise(empty) for n, t in enumerate(templates)]
    every = F.when(w.isNull(), empty).otherwise(F.array_sort(F.concat(*each)))
    return split.withColumn("found", every).drop("__own", "__may", "__w", "__at")


def license_report(docs: DataFrame) -> DataFrame:
    """Per document: words, places of base phrases, labels of base and of all templates, and the best share.

    A null text counts as empty; repeated rows have a row each, an empty table gives none; other columns aren't read.
    """
    got = scan(docs.select("doc_id", "text"), drop=("text",))
    names = F.array(*[F.lit(t.label) for t in TEMPLATES])
    n_base = sum(t.base for t in TEMPLATES)  # they come first
    base = F.filter("found", lambda x: x["template"] < n_base)

    def labels(found: Column) -> Column:
        return F.array_join(F.array_sort(F.array_distinct(F.transform(found, lambda x: F.element_at(names, x["template"] + 1)))), ",")

    got = got.withColumn("base", base)
    starts = F.transform("base", lambda x: x["start"].cast("long"))
    return got.select(
        "doc_id", "n_words", F.size("base").cast("long").alias("n_base"), F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"),
        labels(F.col("base")).alias("base_labels"), labels(F.col("found")).alias("labels"),
        F.coalesce(F.array_max(F.transform("found", lambda x: x["share"])), F.lit(0.0)).alias("score"),
    )
