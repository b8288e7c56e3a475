"""Plain Python versions of the operators' contracts."""

import hashlib
import re
import unicodedata
from collections import defaultdict

SPACE = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
UPPER = {i: i + 32 for i in range(65, 91)}


def lower(text):
    return (text or "").translate(UPPER)


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def canonical(text):
    """Compatibility composition before and after case folding; white space runs as one space, none at the ends."""
    t = unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", text or "").casefold())
    return re.sub(r"\s+", " ", re.sub(r"[\x1c-\x1f]", " ", t)).strip()


def pii(text):
    """Base spans (start, kind's number, end, kind) in order."""
    t, out = text or "", []
    out += [(m.start(), 0, m.end(), "email") for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [(m.start(), 1, m.end(), "ip") for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = re.sub("[^0-9]", "", m[0])
        if 14 <= len(d) <= 19 and sum(sum(divmod(int(c) * 2, 10)) if i % 2 else int(c) for i, c in enumerate(reversed(d))) % 10 == 0:
            out.append((m.start(), 2, m.end(), "card"))
    out += [(m.start(), 3, m.end(), "phone") for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 10 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return sorted(out)


def overlap(docs, items, span=13):
    """For each document (words, hit words, item ids)."""
    spans = defaultdict(set)
    for i, text in items:
        w = ALNUM.findall(lower(text))
        n = min(span, len(w))
        for p in range(len(w) - n + 1) if n else []:
            spans[tuple(w[p : p + n])].add(i)
    sizes = {len(s) for s in spans}
    out = {}
    for d, text in docs:
        w, hit, met = ALNUM.findall(lower(text)), set(), set()
        for n in sizes:
            for p in range(len(w) - n + 1):
                if (s := tuple(w[p : p + n])) in spans:
                    hit |= set(range(p, p + n))
                    met |= spans[s]
        out[d] = (len(w), len(hit), sorted(map(str, met)))
    return out


def shingles(text):
    w = SPACE.findall(lower(text))
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def components(docs):
    """For each id the size of its set and the least id reachable."""
    s = {k: shingles(t) for k, t in docs}
    places = defaultdict(list)
    for k, x in s.items():
        for g in x:
            places[g].append(k)
    common = defaultdict(int)
    for ids in places.values():
        for i, a in enumerate(ids):
            for b in ids[i + 1 :]:
                common[a, b] += 1
    up = {k: k for k in s}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for (a, b), c in common.items():
        if 100 * c >= 85 * (len(s[a]) + len(s[b]) - c):
            a, b = root(a), root(b)
            up[max(a, b)] = min(a, b)
    return {k: (len(s[k]), root(k)) for k in s}


def without_repeats(docs, span=20):
    """For each document, in order of id: words, removed words, kept text."""
    seen, out = set(), {}
    for d, text in sorted(docs, key=lambda x: x[0]):
        w, gone = SPACE.findall(text or ""), set()
        for p in range(len(w) - span + 1):
            s = tuple(w[p : p + span])
            if s in seen:
                gone |= set(range(p, p + span))
            seen.add(s)
        out[d] = (len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone))
    return out
