"""Sampled SentencePiece segmentations without replacement, and their decoding.

The pieces of a given vocabulary that match a text make a lattice; a path is a segmentation, and its probability is
proportional to the product of its pieces' weights. A piece's weight falls with its rank in the vocabulary as in Zipf's law. Backward
sums over the lattice give each arc its probability given that its start is reached.

K distinct paths are drawn by perturbed A*: every path has its log probability and Gumbel noise, and those of the
largest sums are wanted. The search goes from the start of the lattice downward. A node's maximum is that of one of its children,
each with its probability: that child goes on, the others get the maxima of what lies below them, given that they are smaller, and
wait; the largest that waits is taken next. The (K+1)-th largest sum, kappa, gives the chance of a path to be drawn: 1 - exp(-exp(log p - kappa)).

No piece reaches over the start of a run of spaces, so a document's lattice is a chain of the lattices of its units (a run of
spaces and what follows). Lattices are built once for each distinct unit of a slice, and all units of a slice walk at once.
Noise comes from a hash of the row's key, the draw, and the place in the document, so a row's result depends on nothing else.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from tidegauge.llm._frames import add_columns
from tidegauge.llm._text import mix, powers

#: Segmentations drawn of each text.
DRAWS = 2
SEED = 17
#: Characters of text in a slice.
SLICE = 1 << 17
#: Characters below this have their first step in a table.
_TOP = 1 << 16
#: Units whose alternatives are looked at first. Noise is bounded, so no alternative beyond a point can be among the largest.
EARLY, BOUND = 16, 40.0

_SPACE = 0x2581
_EMPTY = np.int64(-1)


#: The model that is taken where none is named, and the most bytes that a model may have, as it is sent to all executors.
MODEL, MODEL_BYTES = "/opt/tokenizers/piece_bpe_32k.model", 64 << 20


def default_model() -> str:
    return MODEL


class Vocabulary:
    """Pieces of a model as a trie in a hash table, with their log weights."""

    def __init__(self, model: bytes):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        n = sp.get_piece_size()
        self.byte = np.full(256, -1, np.int32)
        self.raw: list[bytes] = [b""] * n
        weight = np.zeros(n)
        children: dict[int, int] = {}
        ends = [-1]
        for i in range(n):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                self.byte[int(piece[3:5], 16)] = i
                self.raw[i] = bytes([int(piece[3:5], 16)])
            elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
                self.raw[i] = piece.encode()
                node = 0
                for c in piece:
                    key = node << 21 | ord(c)
                    node = children.setdefault(key, len(ends))
                    if node == len(ends):
                        ends.append(-1)
                ends[node] = i
            # by rank: scores fall by one from piece to piece
            weight[i] = -math.log(min(max(1.0 - sp.get_score(i), 2.0), float(n)) + 2.7)
        self.ends = np.array(ends, np.int32)
        bits = max(4, (4 * len(children)).bit_length())
        self.shift = np.uint64(64 - bits)
        self.keys, self.next = np.full(1 << bits, _EMPTY), np.zeros(1 << bits, np.int32)
        self.mask = (1 << bits) - 1
        keys = np.array(list(children), np.int64)
        for key, slot, node in zip(children, self._slot(keys).tolist(), children.values(), strict=True):
            while self.keys[slot] != _EMPTY:
                slot = (slot + 1) & self.mask
            self.keys[slot], self.next[slot] = key, node
        first = np.arange(_TOP, dtype=np.int64)
        self.top = self.step(np.zeros(_TOP, np.int64), first)
        self.weight, self.byte_weight = weight, -math.log(n + 2.7)
        self.size = np.array([len(x) for x in self.raw], np.int64)
        self.at = np.concatenate([[0], np.cumsum(self.size)[:-1]])
        self.bytes = np.frombuffer(b"".join(self.raw), np.uint8)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def start(self, char: np.ndarray) -> np.ndarray:
        """The node below the root by each character, or -1."""
        out = self.top[np.minimum(char, _TOP - 1)]
        far = np.flatnonzero(char >= _TOP)
        out[far] = self.step(np.zeros(len(far), np.int64), char[far])
        return out

    def step(self, node: np.ndarray, char: np.ndarray) -> np.ndarray:
        """The node below each node by a character, or -1."""
        key = (node.astype(np.int64) << 21) | char
        slot = self._slot(key)
        there = self.keys[slot]
        hit = there == key
        out = np.where(hit, self.next[slot], np.int64(-1))
        left = np.flatnonzero(~hit & (there != _EMPTY))
        while len(left):
            slot[left] = (slot[left] + 1) & self.mask
            there = self.keys[slot[left]]
            hit = there == key[left]
            out[left[hit]] = self.next[slot[left[hit]]]
            left = left[~hit & (there != _EMPTY)]
        return out


_loaded: dict[bytes, Vocabulary] = {}


def read_model(path: str) -> bytes:
    """Bytes of a model file of the driver's; executors get these and need no file."""
    with open(path, "rb") as f:
        raw = f.read(MODEL_BYTES + 1)
    if len(raw) > MODEL_BYTES:
        raise ValueError(f"{path} has more than {MODEL_BYTES} bytes")
    return raw


def vocabulary(model: bytes) -> Vocabulary:
    """The vocabulary of a model, made once in a process."""
    key = hashlib.sha256(model).digest()
    if key not in _loaded:
        _loaded[key] = Vocabulary(model)
    return _loaded[key]


def _uniform(x: np.ndarray) -> np.ndarray:
    """Numbers between 0 and 1, neither included, from hashes."""
    return ((x >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53


def _spread(start: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For ragged ranges: the range of each element, the element, and where each range begins."""
    begin = np.cumsum(count) - count
    of = np.repeat(np.arange(len(count)), count)
    return of, start[of] + np.arange(len(of)) - begin[of], begin


class Lattice:
    """Arcs of all units, sorted by their start; positions are characters of the units one after the other."""

    def __init__(self, v: Vocabulary, chars: np.ndarray, first: np.ndarray):
        n = len(chars)
        end = np.repeat(first[1:], np.diff(first))
        src, size, piece = [], [], []
        at, node, step = np.arange(n), np.zeros(n, np.int64), 0
        while len(at):
            node = v.step(node, chars[at + step]) if step else v.start(chars)
            on = node >= 0
            at, node = at[on], node[on]
            p = v.ends[node]
            on = p >= 0
            src.append(at[on])
            piece.append(p[on])
            step += 1
            size.append(np.full(len(src[-1]), step))
            more = at + step < end[at]
            at, node = at[more], node[more]
        known = np.zeros(n, bool)
        if src:
            known[src[0]] = True
        odd = np.flatnonzero(~known)
        src.append(odd)
        size.append(np.ones(len(odd), np.int64))
        piece.append(np.full(len(odd), -1, np.int32))
        self.src, self.size, self.piece = np.concatenate(src), np.concatenate(size), np.concatenate(piece)
        c = chars[odd]
        width = 1 + (c > 0x7F).astype(np.int64) + (c > 0x7FF) + (c > 0xFFFF)
        w = v.weight[self.piece]
        w[len(w) - len(odd) :] = v.byte_weight * width
        # arcs by the distance of their start from its unit's end, then by start, long ones first: starts stay together, and backward sums go through from left to right
        level = end - np.arange(n)
        longest = int(self.size.max()) + 1 if len(self.size) else 1
        place = (level * np.int64(n + 1) + np.arange(n)) * longest + (longest - 1)
        order = np.argsort(place[self.src] - self.size)
        self.src, self.size, self.piece, w = self.src[order], self.size[order], self.piece[order], w[order]
        dst = self.src + self.size
        self.lp, p = np.empty(len(w)), np.empty(len(w))
        self.arcs = np.bincount(self.src, minlength=n)
        new = np.concatenate([[0], np.flatnonzero(self.src[1:] != self.src[:-1]) + 1]) if n else np.zeros(0, np.int64)
        heads = self.src[new]
        self.begin = np.zeros(n, np.int64)
        self.begin[heads] = new
        beta = np.zeros(n + 1)
        last = end[self.src] == dst if n else np.zeros(0, bool)
        depth = level[heads]
        edges = np.concatenate([[0], np.flatnonzero(depth[1:] != depth[:-1]) + 1, [len(depth)]]) if n else [0]
        bound = np.append(new, len(w))
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            i, j = bound[a], bound[b]
            x = w[i:j] + np.where(last[i:j], 0.0, beta[dst[i:j]])
            start, many = new[a:b] - i, bound[a + 1 : b + 1] - bound[a:b]
            top = np.maximum.reduceat(x, start)
            p[i:j] = np.exp(x - np.repeat(top, many))
            mass = np.add.reduceat(p[i:j], start)
            p[i:j] /= np.repeat(mass, many)
            total = top + np.log(mass)
            beta[heads[a:b]] = total
            self.lp[i:j] = x - np.repeat(total, many)
        np.minimum(self.lp, 0.0, out=self.lp)
        sums = np.cumsum(p)
        self.cdf = sums - np.repeat(sums[new] - p[new], np.diff(bound)) if n else sums
        self.cdf[bound[1:] - 1] = 2.0
        self.end, self.chars, self.first = end, chars, first


class _Path:
    """One drawn path for each document of a slice: arcs by unit and step."""

    def __init__(self, count: np.ndarray, arcs: np.ndarray):
        self.count, self.arcs = count, arcs
        self.begin = np.cumsum(count) - count


class _Slice:
    """Documents of a slice: units, their lattices, and draws."""

    def __init__(self, v: Vocabulary, texts: list[str], keys: np.ndarray):
        self.v, self.keys = v, keys
        plain = ["▁" + t.replace(" ", "▁") if t else "" for t in texts]
        chars = np.frombuffer("".join(plain).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        size = np.array([len(p) for p in plain], np.int64)
        edge = np.concatenate([[0], np.cumsum(size)])
        space = chars == _SPACE
        starts = space.copy()
        starts[1:] &= ~space[:-1]
        starts[edge[:-1][size > 0]] = True
        at = np.flatnonzero(starts)
        self.first = np.searchsorted(at, edge)  # of each document, in units
        n = len(chars)
        ends = np.append(at[1:], n)
        p, inv = powers(n + 1)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum((chars.astype(np.uint64) + np.uint64(1)) * p[:n], out=sums[1:])
        h = mix((sums[ends] - sums[at]) * inv[at], 5) ^ (ends - at).astype(np.uint64)
        _, one, self.unit = np.unique(h, return_index=True, return_inverse=True)
        width = (ends - at)[one]
        of, char, begin = _spread(at[one], width)
        self.lattice = Lattice(v, chars[char], np.append(begin, len(char)))
        self.doc = np.repeat(np.arange(len(texts)), np.diff(self.first))
        self.index = np.arange(len(at)) - self.first[self.doc]
        self._flat: dict[int, tuple[np.ndarray, np.ndarray]] = {}  # ids by path, filled as asked for

    def walk(self, draw: np.ndarray, occ: np.ndarray, pos: np.ndarray, step: np.ndarray) -> list[np.ndarray]:
        """Let the units occ walk on from positions pos to their ends, their next arcs being number step: (unit, step, arc) of what is drawn.

        A node's maximum falls to each child with the child's probability, whatever its value.
        """
        lat = self.lattice
        base = self._noise(draw, occ, 2)
        offset, end = lat.first[self.unit[occ]], lat.first[self.unit[occ] + 1]
        pos, step = pos.copy(), step.copy()
        go = np.flatnonzero(pos < end)
        drawn = []
        while len(go):
            p = pos[go]
            arc = lat.begin[p]
            left = np.flatnonzero(lat.arcs[p] > 1)
            u = _uniform(mix(base[go[left]] + (p[left] - offset[go[left]]).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))
            while len(left):
                on = u >= lat.cdf[arc[left]]
                left, u = left[on], u[on]
                arc[left] += 1
            drawn.append((occ[go], step[go], arc))
            pos[go] += lat.size[arc]
            step[go] += 1
            go = go[pos[go] < end[go]]
        return [np.concatenate(c) for c in zip(*drawn, strict=True)] if drawn else [np.zeros(0, np.int64)] * 3

    def _noise(self, draw: np.ndarray, occ: np.ndarray, salt: int) -> np.ndarray:
        d = self.doc[occ]
        return mix(self.keys[d] ^ mix((draw[d].astype(np.uint64) << np.uint64(40)) + self.index[occ].astype(np.uint64), salt), 4)

    def draw(self, k: int) -> list[list[tuple[int, float, float]]]:
        """For each document its draws, as (number of the path, log probability, perturbed log probability), and last the kappa in place of a draw."""
        n = len(self.first) - 1
        lat = self.lattice
        none = np.zeros(n, np.int64)
        gumbel = -np.log(-np.log(_uniform(mix(self.keys, 6))))
        out: list[list] = [[] for _ in range(n)]
        waiting: list[list] = [[] for _ in range(n)]  # (perturbed, path, unit, step, arc, log probability with it)
        self.paths: list[_Path] = []
        todo = np.flatnonzero(np.diff(self.first) > 0)
        for d in np.flatnonzero(np.diff(self.first) == 0):
            out[d] = [(-1, 0.0, 0.0), -math.inf]
        origin = {int(d): (float(gumbel[d]), -1, int(self.first[d]), 0, -1, 0.0) for d in todo}
        for number in range(k):
            docs = np.array(sorted(origin), np.int64)
            if not len(docs):
                break
            g, parent, unit, step, arc, before = (np.array(c) for c in zip(*(origin[d] for d in docs.tolist()), strict=True))
            many = self.first[docs + 1] - unit
            of, occ, begin = _spread(unit, many)
            pos, at = lat.first[self.unit[occ]].copy(), np.zeros(len(occ), np.int64)
            branch = arc >= 0
            pos[begin[branch]] = lat.src[arc[branch]] + lat.size[arc[branch]]
            at[begin[branch]] = step[branch] + 1
            draws = none.copy()
            draws[docs] = number
            u, s, a = self.walk(draws, occ, pos, at)
            # the path: what it has of its parent, the arc at which it leaves, what is drawn
            count = np.zeros(len(self.unit), np.int64)
            count += np.bincount(u, minlength=len(count))
            count[unit[branch]] += step[branch] + 1
            old_u, old_s, old_a = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for j in np.unique(parent[branch]) if branch.any() else []:
                mine = branch & (parent == j)
                path = self.paths[j]
                o, x, _ = _spread(self.first[docs[mine]], unit[mine] - self.first[docs[mine]])
                count[x] += path.count[x]
                w, y, b = _spread(path.begin[x], path.count[x])
                old_u.append(x[w]), old_s.append(np.arange(len(w)) - b[w]), old_a.append(path.arcs[y])
                w, y, b = _spread(path.begin[unit[mine]], step[mine])
                old_u.append(unit[mine][w]), old_s.append(np.arange(len(w)) - b[w]), old_a.append(path.arcs[y])
            if branch.any():
                old_u.append(unit[branch]), old_s.append(step[branch]), old_a.append(arc[branch])
            path = _Path(count, np.zeros(int(count.sum()), np.int64))
            for uu, ss, aa in ((u, s, a), (np.concatenate(old_u), np.concatenate(old_s), np.concatenate(old_a))):
                path.arcs[path.begin[uu] + ss] = aa
            self.paths.append(path)
            lp = np.concatenate([[0.0], np.cumsum(lat.lp[path.arcs])])
            edge = np.append(path.begin, len(path.arcs))
            total = lp[edge[self.first[docs + 1]]] - lp[edge[self.first[docs]]]
            for i, d in enumerate(docs.tolist()):
                out[d].append((number, float(total[i]), float(g[i])))
            self._alternatives(number, docs, g, unit, np.where(branch, step + 1, 0), path, lp, edge, waiting, k, draws)
            origin = {}
            for d in docs.tolist():
                if waiting[d]:
                    waiting[d].sort(reverse=True)
                    if number < k - 1:
                        origin[d] = waiting[d].pop(0)
                    else:
                        out[d].append(waiting[d][0][0])
                else:
                    out[d].append(-math.inf)
        return out

    def _alternatives(self, number, docs, g, unit, step, path, lp, edge, waiting, k, draws):
        """Put the k largest alternatives along each new path, from a unit and step on, on the documents' lists.

        The children that don't attain their node's maximum have independent noise, cut off at that maximum.
        """
        lat, left, low, reach = self.lattice, np.arange(len(docs)), 0, EARLY
        limit = np.full(len(docs), -np.inf)  # what a value must be over, once k are known
        for i, d in enumerate(docs.tolist()):
            limit[i] = waiting[d][k - 1][0] if len(waiting[d]) >= k else -np.inf
        while len(left):
            close = self.first[docs[left] + 1]
            begin = np.where(low == 0, path.begin[unit[left]] + step[left], edge[np.minimum(unit[left] + low, close)])
            stop = edge[np.minimum(unit[left] + reach, close)]
            row, node, _ = _spread(begin, stop - begin)
            chosen = path.arcs[node]
            p = lat.src[chosen]
            of, arc, _ = _spread(lat.begin[p], lat.arcs[p])
            side = arc != chosen[of]
            of, arc = of[side], arc[side]
            row = left[row]
            u = np.searchsorted(path.begin, node, "right") - 1
            base = self._noise(draws, u, 8) + (p - lat.first[self.unit[u]]).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
            before = lp[node] - lp[edge[self.first[docs[row]]]]
            x = _uniform(mix(base[of] + lat.size[arc].astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)))
            after = before[of] + lat.lp[arc]
            may = x >= np.exp(-np.exp(np.minimum(after - limit[row][of], 50.0)))
            of, arc, x, after = of[may], arc[may], x[may], after[may]
            row, node, u = row[of], node[of], u[of]
            value = -np.logaddexp(-g[row], -(after - np.log(-np.log(x))))
            order = np.lexsort((-value, row))
            rank = np.arange(len(order)) - np.searchsorted(row[order], row[order])
            met = set()
            for i in order[rank < k].tolist():
                r = int(row[i])
                met.add(r)
                waiting[docs[r]].append((float(value[i]), number, int(u[i]), int(node[i] - path.begin[u[i]]), int(arc[i]), float(after[i])))
            for r in met:
                best = waiting[docs[r]]
                best.sort(reverse=True)
                del best[k:]
                limit[r] = best[-1][0] if len(best) == k else -np.inf
            last = np.minimum(unit[left] + reach, close)
            beyond = lp[edge[last]] - lp[edge[self.first[docs[left]]]] + BOUND
            left = left[(last < close) & (beyond > limit[left])]
            low, reach = reach, reach * 8

    def ids(self, number: int, d: int) -> np.ndarray:
        """Piece ids of a document's draw."""
        if number < 0:
            return np.zeros(0, np.int32)
        if number not in self._flat:
            path, lat, v = self.paths[number], self.lattice, self.v
            piece = lat.piece[path.arcs]
            odd = np.flatnonzero(piece < 0)
            many = np.ones(len(piece), np.int64)
            raw = [chr(c).encode("utf-8", "surrogatepass") for c in lat.chars[lat.src[path.arcs[odd]]].tolist()]
            many[odd] = [len(x) for x in raw]
            begin = np.concatenate([[0], np.cumsum(many)])
            out = np.empty(int(begin[-1]), np.int32)
            plain = piece >= 0
            out[begin[:-1][plain]] = piece[plain]
            for i, x in zip(odd.tolist(), raw, strict=True):
                out[begin[i] : begin[i + 1]] = v.byte[list(x)]
            edge = begin[np.append(path.begin, len(path.arcs))]
            self._flat[number] = (out, edge)
        out, edge = self._flat[number]
        return out[edge[self.first[d]] : edge[self.first[d + 1]]]


def decode_ids(v: Vocabulary, ids: np.ndarray) -> str:
    """The text of a sequence of piece ids."""
    size = v.size[ids]
    _, at, _ = _spread(v.at[ids], size)
    text = v.bytes[at].tobytes().decode("utf-8", "replace").replace("▁", " ")
    return text[1:] if text.startswith(" ") else text


def log_inclusion(log_p: float, kappa: float) -> float:
    """Logarithm of 1 - exp(-exp(log_p - kappa))."""
    x = log_p - kappa
    return 0.0 if x > 4 else math.log(-math.expm1(-math.exp(x))) if x > -30 else x


_FIELDS = "array<struct<draw:int,n_tokens:long,ids:array<int>,ids_sha256:string,log_prob:double,log_inclusion:double,round_trip:boolean>>"


def sample_segmentations(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", draws: int = DRAWS, seed: int = SEED, model: str | None = None, with_ids: bool = True, drop: tuple[str, ...] = ()) -> DataFrame:
    """docs with draws, an array of distinct sampled segmentations of the whole text in the order drawn.

    A text with fewer segmentations than draws gives them all, with log_inclusion 0. A null or empty text has one, of no
    tokens. Rows of equal id and text have equal draws. ids is null unless with_ids; round_trip says whether the
    ids decode to the text (U+2581 is a space to the vocabulary and decodes to one). Other columns pass through; one named draws is replaced.
    An empty table gives no rows. A text's lattice is in memory as a whole, about 350 bytes a character. model is the path of a
    model file that the driver can read.
    """
    raw = docs.sparkSession.sparkContext.broadcast(read_model(model or default_model()))
    source = docs.withColumn("__key", F.col(id_col).cast("string"))

    def make():
        v = vocabulary(raw.value)

        def f(texts, ids):
            texts, ids = texts.to_pylist(), ids.to_pylist()
            count, draw, tokens, kept, digest, log_p, log_q, same = [], [], [], [], [], [], [], []
            i = 0
            while i < len(texts):
                j, size = i, 0
                while j < len(texts) and (j == i or size + len(texts[j] or "") <= SLICE):
                    size += len(texts[j] or "")
                    j += 1
                part = [t or "" for t in texts[i:j]]
                keys = np.array([xxhash.xxh3_64_intdigest(x or "", seed) for x in ids[i:j]], np.uint64)
                s = _Slice(v, part, keys)
                for d, got in enumerate(s.draw(draws)):
                    kappa = got.pop()
                    plain = part[d].replace("▁", " ") if "▁" in part[d] else part[d]
                    count.append(len(got))
                    for number, (p, log, _) in enumerate(got):
                        x = s.ids(p, d)
                        draw.append(number + 1)
                        tokens.append(len(x))
                        kept.append(x)
                        digest.append(hashlib.sha256(x.astype("<i4").tobytes()).hexdigest())
                        log_p.append(log)
                        log_q.append(log_inclusion(log, kappa))
                        same.append(decode_ids(v, x) == plain)
                if not with_ids:
                    kept.clear()
                i = j
            if with_ids:
                flat = np.concatenate(kept) if kept else np.zeros(0, np.int32)
                own = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(tokens)]), pa.int32()), pa.array(flat, pa.int32()))
            else:
                own = pa.nulls(len(draw), pa.list_(pa.int32()))
            cols = [pa.array(draw, pa.int32()), pa.array(tokens, pa.int64()), own, pa.array(digest, pa.string()), pa.array(log_p, pa.float64()), pa.array(log_q, pa.float64()), pa.array(same, pa.bool_())]
            rows = pa.StructArray.from_arrays(cols, names=["draw", "n_tokens", "ids", "ids_sha256", "log_prob", "log_inclusion", "round_trip"])
            return [pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(count)]), pa.int32()), rows)]

        return f

    return add_columns(source, [text_col, "__key"], f"draws {_FIELDS}", make, ("__key", *drop))


def decode(rows: DataFrame, ids_col: str = "ids", model: str | None = None) -> DataFrame:
    """rows with decoded, the text of an array of piece ids (null: null; none: empty). Other columns pass through; one named decoded is replaced."""
    raw = rows.sparkSession.sparkContext.broadcast(read_model(model or default_model()))

    def make():
        v = vocabulary(raw.value)
        return lambda ids: [pa.array([None if x is None else decode_ids(v, np.array(x, np.int64)) for x in ids.to_pylist()], pa.string())]

    return add_columns(rows, [ids_col], "decoded string", make)


def encode(docs: DataFrame, text_col: str = "text", model: str | None = None, drop: tuple[str, ...] = ()) -> DataFrame:
    """docs with ids, the one segmentation of the whole text that the model itself gives (null: null; empty: none), and n_tokens.

    Repeated rows have equal ids; an empty table gives no rows; other columns pass through, columns of these names are replaced.
    """
    raw = docs.sparkSession.sparkContext.broadcast(read_model(model or default_model()))

    def make():
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_proto=raw.value)

        def f(texts):
            texts = texts.to_pylist()
            ids = sp.encode([t or "" for t in texts], num_threads=1) if texts else []
            ids = [None if t is None else x for t, x in zip(texts, ids, strict=True)]
            return pa.array(ids, pa.list_(pa.int32())), pa.array([len(x or ()) for x in ids], pa.int64())

        return f

    return add_columns(docs, [text_col], "ids array<int>, n_tokens long", make, drop)


def sampling_report(docs: DataFrame) -> DataFrame:
    """A row for each document and draw: tokens, digest of the ids, log probability, log of the inclusion chance, and whether it decodes to the text."""
    got = sample_segmentations(docs.select("doc_id", "text"), with_ids=False, drop=("text",))
    return got.select("doc_id", F.explode("draws").alias("d")).select("doc_id", "d.draw", "d.n_tokens", "d.ids_sha256", "d.log_prob", "d.log_inclusion", "d.round_trip")
