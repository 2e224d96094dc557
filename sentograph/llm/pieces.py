"""SentencePiece encoding and decoding with sampled segmentations: Gumbel top-k without replacement.

A text is a chain of units (a word with the space before it, or a line break), and a unit's lattice has an edge for
each piece of the vocabulary at each place. An edge weighs (rank of the piece + 3) ** -power; sums over all ways to
the unit's end give each place an exact bound, and the chance of each edge from there. A search over the document's
lattice keeps groups of segmentations in a queue by perturbed value, which is the largest among a group's members:
the best group is taken out, a member reaches that value and is emitted, and what is left of the group (all that leaves
the emitted path at some step) goes back, perturbed below it. So segmentations come out in order of log probability
plus Gumbel noise, distinct, as exact samples without replacement. All noise is a hash of the row's key, so results
don't depend on partitions. inclusion is the log of the chance to be among the k, given the (k+1)-th value.

A character without a piece, and U+2581 itself, are its UTF-8 bytes as byte pieces, so decoding gives back the text.
Pieces don't reach over a space or a line break into the next unit. A long unit (text without spaces) is cut up between characters
that no piece has side by side; that is exact. What can't be cut takes steps in proportion to its length; more of it than a window (PART characters) is cut, and no piece crosses that.

Lattices are computed once for each distinct unit of a part of the texts, and all paths of the part descend together
in numpy. A text longer than a part goes through in windows of its units (``LongText``), so memory doesn't follow the length of a
text, but for its ids.

Defined results: a null or empty text is the one segmentation of the leading space mark; a text with fewer than k
segmentations has all of them, with inclusion 0 (certain); a null key counts as the key "null"; equal keys draw
equal noise; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import bounded_batches
from .token_files import gather, slices

SPACE = "▁"
LETTER = "([A-Za-zÀ-ɏ])"
#: Bytes of text whose paths descend together. More of them share more lattices, and take more memory: 100 MB for this many, 200 MB for three times as many.
PART = 500_000
#: Bytes of an Arrow batch; a part is taken from one.
BATCH = 2 << 20


def mix(x):
    """64 well-mixed bits of each of an array of unsigned 64-bit numbers."""
    import numpy as np

    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def uniform(seed, place):
    """Numbers in (0, 1) that depend on seed and place alone."""
    import numpy as np

    h = mix(seed + np.asarray(place, np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return ((h >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53


class Pieces:
    """The vocabulary of a SentencePiece model as tables."""

    BASE = 0x100000001B3

    def __init__(self, model: str, power: float = 1.0):
        import re

        import numpy as np
        import sentencepiece

        own = sentencepiece.SentencePieceProcessor(model_file=model)
        n = own.get_piece_size()
        self.names = [own.id_to_piece(k) for k in range(n)]
        self.byte_id = np.zeros(256, np.int64)
        for k in range(n):
            if own.is_byte(k):
                self.byte_id[int(self.names[k][1:-1], 16)] = k
        plain = [k for k in range(n) if not (own.is_byte(k) or own.is_control(k) or own.is_unknown(k) or own.is_unused(k))]
        rank = {k: r for r, k in enumerate(sorted(plain, key=lambda k: (-own.get_score(k), k)))}
        self.score = np.full(n, -np.inf)
        for k, r in rank.items():
            self.score[k] = -power * np.log(r + 3.0)
        self.byte_score = -power * float(np.log(len(plain) + 3.0))
        inner = [k for k in plain if SPACE not in self.names[k][1:]]
        self.marks = not any(re.search(LETTER + "[.,]", self.names[k]) for k in inner)
        self.longest = max((len(self.names[k]) for k in inner), default=1)
        self.keys = np.array([self.hash(self.names[k]) for k in inner], np.uint64)
        self.ids = np.array(inner, np.int64)
        order = np.argsort(self.keys)
        self.keys, self.ids = self.keys[order], self.ids[order]
        self.width = np.array([len(self.names[k]) for k in self.ids])
        if len(np.unique(self.keys)) != len(self.keys):
            raise AssertionError("pieces share a hash")
        self.pairs = np.array(sorted({ord(a) << 21 | ord(b) for k in inner for a, b in zip(self.names[k], self.names[k][1:])}), np.int64)
        self.ODD = np.uint64(0x9E3779B97F4A7C15)
        self._slots()
        self.bytes = [bytes([int(x[1:-1], 16)]) if own.is_byte(k) else b"" if own.is_control(k) else x.replace(SPACE, " ").encode() for k, x in enumerate(self.names)]
        self.byte_length = np.fromiter(map(len, self.bytes), np.int64, n)
        self.byte_begin = np.cumsum(self.byte_length) - self.byte_length
        self.byte_flat = np.frombuffer(b"".join(self.bytes), np.uint8)

    def hash(self, text: str) -> int:
        h = 0
        for c in text:
            h = (h * self.BASE + ord(c) + 1) % 2**64
        return h

    def _slots(self):
        """A table of 2**18 slots by the upper bits of a product, small enough for a cache; pieces whose slot is taken are searched."""
        import numpy as np

        slot = (self.keys * self.ODD) >> np.uint64(46)
        first = np.unique(slot, return_index=True)[1]
        rest = np.setdiff1d(np.arange(len(self.keys)), first)
        self.slot = np.zeros(1 << 18, np.uint16 if len(self.keys) < 2**16 else np.uint32)
        self.slot[slot[first]] = first
        self.crowded = np.zeros(1 << 18, bool)
        self.crowded[slot[rest]] = True
        self.rest, self.rest_keys = rest, self.keys[rest]

    def find(self, hashes, width: int):
        """Numbers of the pieces of a width that have these hashes, -1 for none."""
        import numpy as np

        slot = (hashes * self.ODD) >> np.uint64(46)
        got = self.slot[slot]
        hit = self.keys[got] == hashes
        out = np.where(hit, got.astype(np.int32), np.int32(-1))
        if len(self.rest):
            more = np.flatnonzero(self.crowded[slot] & ~hit)
            at = np.minimum(np.searchsorted(self.rest_keys, hashes[more]), len(self.rest) - 1)
            own = self.rest_keys[at] == hashes[more]
            out[more[own]] = self.rest[at[own]]
        found = np.flatnonzero(out >= 0)
        out[found[self.width[out[found]] != width]] = -1
        return out

    def decode(self, ids) -> str:
        """The text of ids, without the leading space mark."""
        text = b"".join(map(self.bytes.__getitem__, ids))
        return (text[1:] if text[:1] == b" " else text).decode("utf-8", "replace")


class Lattice:
    """The lattices of units. Place 0 is the end of all; the others go by distance from their unit's end, so that those of
    a distance lie side by side. Edges from place p are first[p] to first[p + 1]."""

    def __init__(self, pieces: Pieces, units: list[str], marked: list[bool]):
        import numpy as np

        mark = np.array(marked, bool)
        size = np.fromiter(map(len, units), np.int64, len(units)) + mark
        codes = np.frombuffer("".join([SPACE + u if m else u for u, m in zip(units, marked)]).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
        ends = np.cumsum(size)
        longest = int(size.max(initial=0))
        order = np.argsort(-size, kind="stable")
        rank = np.empty(len(units), np.int64)
        rank[order] = np.arange(len(units))
        count = np.searchsorted(-size[order], -np.arange(1, longest + 1), "right")  # units of at least that length
        base = np.append([0, 1], 1 + np.cumsum(count))  # base[d]: first place at distance d
        n = int(base[-1])
        distance = np.append(0, np.repeat(np.arange(1, longest + 1), count))
        nth = np.arange(n) - base[distance]
        self.start = np.where(size > 0, base[size] + rank, 0)
        following = np.where(distance > 1, base[np.maximum(distance - 1, 0)] + nth, 0)
        at = ends[order][nth] - distance
        at[0] = 0
        code = codes[at] if len(codes) else np.zeros(n, np.int64)
        literal = code == ord(SPACE)
        literal[0] = False
        literal[self.start[mark]] = False
        code = (code + 1).astype(np.uint64)
        any_literal = literal.any()

        most = min(pieces.longest, longest)
        hashes, ahead, power = np.zeros(n, np.uint64), np.arange(n), np.uint64(1)
        hits, within = [], np.zeros(n, bool)
        spelled: list[bytes] = []
        for width in range(1, most + 1):
            lo = int(base[width])
            hashes[lo:] = code[lo:] * power + hashes[following[lo:]]
            ahead = following[ahead]
            power = power * np.uint64(pieces.BASE)
            got = pieces.find(hashes[lo:], width)
            if any_literal:  # a space mark in the text itself is only ever bytes
                within[lo:] = literal[lo:] | within[following[lo:]]
                got[within[lo:]] = -1
            if width == 1:  # characters without a piece: numbers after those of the vocabulary, one for each distinct character
                bare = np.flatnonzero(got < 0)
                kinds, which = np.unique(code[lo:][bare], return_inverse=True)
                spelled = [chr(c - 1).encode("utf-8", "surrogatepass") for c in kinds.tolist()]
                got[bare] = len(pieces.ids) + which
                hits.append((np.arange(lo, n, dtype=np.int32), got.astype(np.int32), ahead[lo:].astype(np.int32)))
            else:
                own = np.flatnonzero(got >= 0)
                hits.append(((own + lo).astype(np.int32), got[own].astype(np.int32), ahead[own + lo].astype(np.int32)))
        self.run_ids = np.concatenate([pieces.ids, pieces.byte_id[np.frombuffer(b"".join(spelled), np.uint8)]])
        self.run_length = np.concatenate([np.ones(len(pieces.ids), np.int64), np.fromiter(map(len, spelled), np.int64, len(spelled))])
        self.run_begin = np.cumsum(self.run_length) - self.run_length
        score = np.concatenate([pieces.score[pieces.ids], pieces.byte_score * self.run_length[len(pieces.ids) :]])

        edges = np.zeros(n, np.int64)
        for where, _, _ in hits:
            edges[where] += 1
        self.first = np.append(0, np.cumsum(edges))
        total, free = int(self.first[-1]), self.first[:-1].copy()
        self.to, self.run = np.empty(total, np.int32), np.empty(total, np.int32)
        for where, got, to in hits:
            slot = free[where]
            self.to[slot], self.run[slot] = to, got
            free[where] += 1
        del hits, hashes, ahead, code, following, free
        self.place = np.repeat(np.arange(n, dtype=np.int32), edges)
        # Sums over all ways to the end, from the nearest places outwards.
        self.log, self.upto, beta = score[self.run], np.empty(total), np.zeros(n)
        for d in range(1, longest + 1):
            p0, p1 = int(base[d]), int(base[d + 1])
            e0, e1 = int(self.first[p0]), int(self.first[p1])
            ways, own = self.log[e0:e1] + beta[self.to[e0:e1]], edges[p0:p1]
            seg = self.first[p0:p1] - e0
            top = np.maximum.reduceat(ways, seg)
            chance = np.exp(ways - np.repeat(top, own))
            mass = np.add.reduceat(chance, seg)
            beta[p0:p1] = top + np.log(mass)
            self.log[e0:e1] = ways - np.repeat(beta[p0:p1], own)
            sums = np.cumsum(chance / np.repeat(mass, own))
            self.upto[e0:e1] = sums - np.repeat(np.append(0.0, sums)[seg], own)
        self.upto[self.first[2:] - 1] = 2.0  # the last edge of a place takes what is left


def descend(lattice: Lattice, at, seed, place):
    """Follows random edges from each place to the end, all together. Returns (edges one after another, count for each)."""
    import numpy as np

    n = len(at)
    steps, who, counts, step = [], np.flatnonzero(at), np.zeros(n, np.int64), 0
    at, seed, place = at[who], seed[who], place[who]
    while len(who):
        u = uniform(seed, place + np.uint64(step))
        edge = lattice.first[at]
        open_ = np.flatnonzero(u > lattice.upto[edge])
        while len(open_):
            edge[open_] += 1
            open_ = open_[u[open_] > lattice.upto[edge[open_]]]
        steps.append((who, edge.astype(np.int32)))
        counts[who] += 1
        step += 1
        at = lattice.to[edge]
        more = np.flatnonzero(at)
        at, who, seed, place = at[more], who[more], seed[more], place[more]
    begin = np.cumsum(counts) - counts
    out = np.empty(int(counts.sum()), np.int32)
    for k, (who, edge) in enumerate(steps):
        out[begin[who] + k] = edge
    return out, counts


def below(mass: float, bound: float, u: float) -> float:
    """The perturbed value of a group of the given log mass, kept below a bound: exp(-value) = exp(-bound) - log(u) exp(-mass)."""
    import math

    a, b = -bound, math.log(-math.log(u)) - mass
    top = max(a, b)
    return -(top + math.log1p(math.exp(min(a, b) - top)))


class Path:
    """Edges over the lattices of a document's units, one after another, and the count of them in each unit."""

    __slots__ = ("counts", "edges")

    def __init__(self, edges, counts):
        self.edges, self.counts = edges, counts


class Group:
    """Segmentations that leave a path at some step from ``since`` on, but not by the edges in ``gone`` (step -> edges).

    base: log probability of the path up to since.
    """

    __slots__ = ("base", "gone", "path", "since", "value")

    def __init__(self, path: Path, since: int, base: float):
        self.path, self.since, self.base, self.gone, self.value = path, since, base, {}, 0.0

    def masses(self, lattice: Lattice):
        """(mass of those that leave at each step, log probability of the path before it). Steps so far on that they weigh nothing are left out."""
        import numpy as np

        limit = 96
        while True:
            path = self.path.edges[self.since : self.since + limit]
            logs = lattice.log[path]
            before = self.base + np.append(0.0, np.cumsum(logs))
            if len(path) < limit or before[-1] < self.base - 60:
                break
            limit *= 8
        before = before[:-1]
        if not len(path):
            return np.zeros(0), before
        place = lattice.place[path]
        lo, hi = lattice.first[place], lattice.first[place + 1]
        n = hi - lo
        ends = np.cumsum(n)
        chances = np.exp(lattice.log[np.repeat(lo - (ends - n), n) + np.arange(ends[-1])])
        chances[ends - n + path - lo] = 0.0
        for step, edges in self.gone.items():
            if 0 <= (k := step - self.since) < len(path):
                for e in edges:
                    chances[ends[k] - n[k] + e - lo[k]] = 0.0
        return np.exp(before) * np.add.reduceat(chances, ends - n), before

    def mass(self, lattice: Lattice, whole: float) -> float:
        """The mass of a group from which nothing is gone, by the path's log probability: all from base on, without the path."""
        import math

        if whole - self.base < -40:
            return math.exp(self.base)
        return float(self.masses(lattice)[0].sum())

    def perturb(self, mass: float, bound: float, u: float) -> bool:
        """Sets the value; False if nothing is left in the group."""
        import math

        if mass <= 0.0:
            return False
        self.value = below(math.log(mass), bound, u)
        return True

    def leave(self, lattice: Lattice, u: float):
        """(step, edge, log probability up to and with the edge, mass of the group without that edge): where a member leaves
        the path, chosen by mass. The mass is None where rounding would tell."""
        import numpy as np

        masses, before = self.masses(lattice)
        k, total, rest = chosen(masses, before, u)
        step = self.since + k
        edge, log = other_edge(lattice, int(self.path.edges[step]), self.gone.get(step, ()), rest, before[k])
        left = total - float(np.exp(log))
        return step, edge, log, left if left > 1e-6 * total else None


def chosen(masses, before, u: float):
    """(step, sum of masses, what is left for the step by its path's chance): a step by mass, for a uniform number."""
    import numpy as np

    upto = np.cumsum(masses)
    k = min(int(np.searchsorted(upto, u * upto[-1], "right")), int(np.flatnonzero(masses)[-1]))
    return k, float(upto[-1]), (u * upto[-1] - (upto[k - 1] if k else 0.0)) / np.exp(before[k])  # uniform within the step's own mass


def other_edge(lattice: Lattice, own: int, gone, rest: float, before: float):
    """(edge, log probability with it): one from the place of the path's own edge, by chance, but neither that nor any that is gone."""
    import numpy as np

    place, barred = lattice.place[own], {own, *gone}
    for edge in [e for e in range(lattice.first[place], lattice.first[place + 1]) if e not in barred]:
        rest -= np.exp(lattice.log[edge])
        if rest <= 0:
            break
    return edge, float(before + lattice.log[edge])


def units_of(texts: pa.Array, marks: bool = False):
    """(distinct units, number of each unit of all texts in order, bounds of the texts in that). A unit after a space begins
    with the space mark; a line break is a unit; one that follows it and begins with a space mark of its own has a break before that.
    marks: a full stop or comma after a letter begins a unit as well, which loses nothing where no piece has the two."""
    import re

    import numpy as np
    import pyarrow.compute as pc

    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    marked = pc.replace_substring(pc.binary_join_element_wise(pa.scalar(SPACE, pa.large_string()), texts, pa.scalar("", pa.large_string())), " ", " " + SPACE)
    cut = pc.replace_substring(marked, "\n", " \n ")
    if pc.any(odd := pc.match_substring(texts, "\n" + SPACE)).as_py():
        again = [re.sub("\n(?=(" + SPACE + ")?)", lambda m: " \n \n" if m[1] else " \n ", x) if o else c for x, o, c in zip(marked.to_pylist(), odd.to_pylist(), cut.to_pylist())]
        cut = pa.array(again, pa.large_string())
    if marks:
        cut = pc.replace_substring_regex(cut, LETTER + "([.,])", "\\1 \\2")
    split = pc.split_pattern(cut, " ")
    coded = split.flatten().dictionary_encode()
    bounds = split.offsets.to_numpy(zero_copy_only=False).astype(np.int64)
    return coded.dictionary.to_pylist(), coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), bounds - bounds[0]


#: Longer units are cut up where that loses nothing.
LONG = 256


def cut_up(pieces: Pieces, units: list[str], index, bounds, longest: int = LONG):
    """The same with each longer unit as several: cut between two characters that stand side by side in no piece. What comes
    after a cut has no mark, so there is none before a space mark or a line break."""
    import numpy as np

    number = {u: k for k, u in enumerate(units)}
    parts = [[k] for k in range(len(units))]
    for k, unit in enumerate(units):
        if len(unit) > longest:
            code = np.frombuffer(unit.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
            pair = code[:-1] << 21 | code[1:]
            cuts = np.flatnonzero(~np.isin(pair, pieces.pairs) & (code[1:] != ord(SPACE)) & (code[1:] != 10) & (code[:-1] != 10)) + 1
            own = [unit[a:b] for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(unit)])]
            parts[k] = [number.setdefault(u, len(number)) for u in own]
    if len(number) == len(units) and all(len(p) == 1 for p in parts):
        return units, index, bounds
    lengths = np.fromiter(map(len, parts), np.int64, len(parts))
    ends = np.append(0, np.cumsum(lengths[index]))
    flat = np.fromiter((u for p in parts for u in p), np.int64, int(lengths.sum()))
    return list(number), gather(flat, np.cumsum(lengths) - lengths, lengths, index), ends[bounds]


def sample_part(pieces: Pieces, texts: pa.Array, seeds, k: int):
    """For each text a list of (path, log probability, value) in order of value, and the (k+1)-th value; and the lattice."""
    import math

    import numpy as np

    units, index, bounds = cut_up(pieces, *units_of(texts, pieces.marks))
    body = [u[1:] if u[:1] == SPACE or (u[:1] == "\n" and len(u) > 1) else u for u in units]
    lattice = Lattice(pieces, body, [u[:1] == SPACE for u in units])
    starts = lattice.start[index]
    n = np.diff(bounds)
    ordinal = (np.arange(len(index)) - np.repeat(bounds[:-1], n)).astype(np.uint64) << np.uint64(24)
    rounds = [mix(seeds + np.uint64(0x632BE59BD9B4E019) * np.uint64(r + 1)) for r in range(k)]
    noise = uniform(seeds[:, None], np.uint64(1 << 60) + np.arange(3 * k + 1, dtype=np.uint64))
    edges, counts = descend(lattice, starts, np.repeat(rounds[0], n), ordinal)
    step_bounds = np.append(0, np.cumsum(counts))[bounds]
    logs = np.append(0.0, np.cumsum(lattice.log[edges]))
    found, queues = [], []
    for d in range(len(n)):
        path = Path(edges[step_bounds[d] : step_bounds[d + 1]], counts[bounds[d] : bounds[d + 1]])
        value = -math.log(-math.log(noise[d, 0]))
        found.append([(path, float(logs[step_bounds[d + 1]] - logs[step_bounds[d]]), value)])
        group = Group(path, 0, 0.0)
        queues.append([group] if group.perturb(group.mass(lattice, found[-1][0][1]), value, noise[d, 1]) else [])
    for r in range(1, k):
        left, at, seed, place = [], [], [], []
        for d, queue in enumerate(queues):
            if not queue:
                continue
            group = queue.pop(max(range(len(queue)), key=lambda i: queue[i].value))
            step, edge, log, rest = group.leave(lattice, noise[d, 3 * r - 1])
            own = group.path.counts
            upto = np.cumsum(own)
            w = int(np.searchsorted(upto, step, "right"))
            lo, hi = bounds[d] + w, bounds[d + 1]
            at.append(np.append(lattice.to[edge], starts[lo + 1 : hi]))
            seed.append(np.full(hi - lo, rounds[r][d]))
            place.append(ordinal[lo:hi])
            left.append((d, group, step, edge, log, rest, w, int(upto[w] - own[w])))
        if not left:
            break
        more, count = descend(lattice, np.concatenate(at), np.concatenate(seed), np.concatenate(place))
        spans = np.append(0, np.cumsum([len(x) for x in at]))
        cuts = np.append(0, np.cumsum(count))[spans]
        sums = np.append(0.0, np.cumsum(lattice.log[more]))
        for i, (d, group, step, edge, log, rest, w, before_unit) in enumerate(left):
            new_counts = np.append(group.path.counts[:w], count[spans[i] : spans[i + 1]])
            new_counts[w] += step + 1 - before_unit
            path = Path(np.concatenate([group.path.edges[:step], [edge], more[cuts[i] : cuts[i + 1]]]), new_counts)
            value = group.value
            whole = log + float(sums[cuts[i + 1]] - sums[cuts[i]])
            found[d].append((path, whole, value))
            group.gone.setdefault(step, set()).add(edge)
            if group.perturb(rest if rest is not None else float(group.masses(lattice)[0].sum()), value, noise[d, 3 * r]):
                queues[d].append(group)
            new = Group(path, step + 1, log)
            if new.perturb(new.mass(lattice, whole), value, noise[d, 3 * r + 1]):
                queues[d].append(new)
    return lattice, found, [max((g.value for g in q), default=-math.inf) for q in queues]


#: How a window begins: with a space mark, with a line break, or within a unit.
MARK, BREAK, WITHIN = range(3)


def windows(pieces: Pieces, text: str, size: int) -> list[tuple[int, int, int]]:
    """(begin, end, how it begins) of the windows of a long text, of about ``size`` characters at most: cut at a space, which the mark of the next window stands for,
    else before a line break, else between characters that no piece has side by side; where a window has none of these, at its end, and no piece crosses that."""
    import numpy as np

    out, at, how = [], 0, MARK
    while len(text) - at > size:
        low, end = at + size // 2, at + size
        space, line = text.rfind(" ", low, end), text.rfind("\n", low, end)
        if space > 0 and text[space + 1] != SPACE:
            out.append((at, space, how))
            at, how = space + 1, MARK
        elif line > 0 and text[line + 1] != SPACE:
            out.append((at, line, how))
            at, how = line, BREAK
        else:
            code = np.frombuffer(text[low - 1 : end].encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
            odd = np.isin(code, [ord(" "), 10])
            free = np.flatnonzero(~np.isin(code[:-1] << 21 | code[1:], pieces.pairs) & ~odd[:-1] & ~odd[1:])
            plain = np.flatnonzero(~odd[:-1] & ~odd[1:])
            cut = low + int(free[-1] if len(free) else plain[-1] if len(plain) else len(code) - 2)
            out.append((at, cut, how))
            at, how = cut, WITHIN
    return [*out, (at, len(text), how)]


class LongText:
    """Segmentations of a text, a window at a time: one window's lattice and steps are held, and of each segmentation its ids, and those edges on which it may still be left.

    The ways through the units of a window don't depend on other windows, so each window's are drawn by themselves. A group's mass lies where its path is left, nearly always in
    the first window, as a path's chance falls with each step; windows are gone through until what follows weighs nothing."""

    def __init__(self, pieces: Pieces, text: str, seed: int, k: int, size: int):
        import numpy as np

        self.pieces, self.text, self.k = pieces, text, k
        self.parts, self.begins, self.now = windows(pieces, text, size), {0: 0}, (-1, None)
        own = np.array([seed], np.uint64)
        self.rounds = [mix(own + np.uint64(0x632BE59BD9B4E019) * np.uint64(r + 1)) for r in range(k)]
        self.noise = uniform(own[:, None], np.uint64(1 << 60) + np.arange(3 * k + 1, dtype=np.uint64))[0]

    def window(self, i: int):
        """(lattice, start and ordinal of each unit) of a window."""
        import numpy as np

        if self.now[0] != i:
            self.now = (-1, None)
            a, b, how = self.parts[i]
            units, index, _ = units_of(pa.array([self.text[a:b]], pa.large_string()), self.pieces.marks)
            if how == BREAK:
                index = index[1:]
            elif how == WITHIN:
                first = units[index[0]][1:]
                first = "\n" + first if first[:1] == SPACE else first  # as after a line break: a mark of the text's own
                units = units if first in units else [*units, first]
                index = np.append(units.index(first), index[1:])
            units, index, _ = cut_up(self.pieces, units, index, np.array([0, len(index)]))
            body = [u[1:] if u[:1] == SPACE or (u[:1] == "\n" and len(u) > 1) else u for u in units]
            lattice = Lattice(self.pieces, body, [u[:1] == SPACE for u in units])
            self.begins[i + 1] = self.begins[i] + len(index)
            self.now = (i, (lattice, lattice.start[index], np.arange(self.begins[i], self.begins[i + 1]).astype(np.uint64) << np.uint64(24)))
        return self.now[1]

    def spelled(self, i: int, edges):
        """(ids as bytes, whether they are the window's text)."""
        import numpy as np

        lattice = self.window(i)[0]
        runs = lattice.run[edges]
        tokens = gather(lattice.run_ids, lattice.run_begin, lattice.run_length, runs)
        a, b, how = self.parts[i]
        body = (b" " if how == MARK else b"") + self.text[a:b].encode("utf-8", "surrogatepass")
        return np.asarray(tokens).astype("<i4").tobytes(), gather(self.pieces.byte_flat, self.pieces.byte_begin, self.pieces.byte_length, tokens).tobytes() == body

    def follow(self, r: int, before: list, first: int, base: float, start: float, head=None) -> list:
        """A path: a list of (edges, counts, ids, whether they restore, log) by window. ``before`` are the windows it has in common with another; from window ``first`` on it is drawn
        in round r. head: (edges, counts, place of the next step, number of its unit) of a path that begins within the window. base: log probability from
        which it may be left; edges and counts of windows so far on that this weighs nothing are None. start: the log at the beginning of window ``first``."""
        import numpy as np

        out, log = list(before), start
        for i in range(first, len(self.parts)):
            lattice, starts, ordinal = self.window(i)
            if head is None:
                edges, counts = descend(lattice, starts, np.repeat(self.rounds[r], len(starts)), ordinal)
            else:
                old, old_counts, to, unit = head
                at = np.append(to, starts[unit + 1 :])
                more, count = descend(lattice, at, np.repeat(self.rounds[r], len(at)), ordinal[unit:])
                edges, counts = np.concatenate([old, more]), np.append(old_counts[:unit], count)
                counts[unit] += len(old) - int(old_counts[:unit].sum())
                head = None
            own = float(lattice.log[edges].sum())
            kept = log >= base - 60
            out.append((edges if kept else None, counts.astype(np.int32) if kept else None, *self.spelled(i, edges), own))
            log += own
        return out

    def masses(self, path: list, since: tuple[int, int], base: float, gone: dict):
        """(window, first step, masses, logs before) of each window where the group has mass."""
        out, step, log = [], since[1], base
        for i in range(since[0], len(self.parts)):
            edges = path[i][0]
            if edges is None or log < base - 60:
                break
            lattice = self.window(i)[0]
            group = Group(Path(edges, None), step, log)
            group.gone = {s: e for (w, s), e in gone.items() if w == i}
            mass, before = group.masses(lattice)
            out.append((i, step, mass, before))
            log, step = log + float(lattice.log[edges[step:]].sum()), 0
        return out

    def sample(self):
        """A list of (path, log probability, value) in order of value, and the (k+1)-th value."""
        import math

        import numpy as np

        total = lambda own: sum(float(m.sum()) for _, _, m, _ in own)
        path = self.follow(0, [], 0, 0.0, 0.0)
        value = -math.log(-math.log(self.noise[0]))
        found, queue = [(path, sum(w[4] for w in path), value)], []

        def push(path, since, base, gone, mass, bound, u):
            if mass > 0:
                queue.append((below(math.log(mass), bound, u), path, since, base, gone))

        mass_of = lambda path, since, base, whole: math.exp(base) if whole - base < -40 else total(self.masses(path, since, base, {}))
        push(path, (0, 0), 0.0, {}, mass_of(path, (0, 0), 0.0, found[0][1]), value, self.noise[1])
        for r in range(1, self.k):
            if not queue:
                break
            value, path, since, base, gone = queue.pop(max(range(len(queue)), key=lambda i: queue[i][0]))
            own = self.masses(path, since, base, gone)
            at, mass, rest = chosen(np.concatenate([x[2] for x in own]), np.concatenate([x[3] for x in own]), self.noise[3 * r - 1])
            for i, first, masses, before in own:
                if at < len(masses):
                    break
                at -= len(masses)
            edges, counts = path[i][:2]
            step, (lattice, _, _) = first + at, self.window(i)
            edge, log = other_edge(lattice, int(edges[step]), gone.get((i, step), ()), rest, before[at])
            unit = int(np.searchsorted(np.cumsum(counts), step, "right"))
            start = sum(w[4] for w in path[:i])
            new = self.follow(r, path[:i], i, log, start, (np.append(edges[:step], edge).astype(edges.dtype), counts.astype(np.int64), lattice.to[edge], unit))
            whole = sum(w[4] for w in new)
            found.append((new, whole, value))
            gone = gone | {(i, step): {*gone.get((i, step), ()), edge}}
            left = mass - math.exp(log)
            push(path, since, base, gone, left if left > 1e-6 * mass else total(self.masses(path, since, base, gone)), value, self.noise[3 * r])
            push(new, (i, step + 1), log, {}, mass_of(new, (i, step + 1), log, whole), value, self.noise[3 * r + 1])
        return found, max((g[0] for g in queue), default=-math.inf)


def inclusion(log: float, least: float) -> float:
    """The log of the chance that a segmentation's value is over the (k+1)-th."""
    import math

    if least == -math.inf:
        return 0.0
    x = log - least
    return x if x < -30 else math.log(-math.expm1(-math.exp(min(x, 700.0))))


def sample(documents: DataFrame, model: str, k: int = 2, seed: int = 1, power: float = 1.0, key: str = "doc_id", text: str = "text", part: int = PART) -> DataFrame:
    """(key, rank from 1, ids, n_pieces, log_probability, perturbed, log_inclusion, restores): k distinct segmentations a row.

    ids: little-endian signed 32-bit numbers; restores: whether they decode to the text.
    """
    bounded_batches(documents.sparkSession, BATCH)
    kind = documents.schema[key].dataType.simpleString()
    rows = documents.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"), F.xxhash64(F.coalesce(F.col(key).cast("string"), F.lit("null")), F.lit(seed)).alias("seed"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        pieces = Pieces(model, power)

        def long_rows(pieces, batch):
            """Each segmentation of a long text as a batch of its own."""
            own = LongText(pieces, batch.column("text")[0].as_py(), batch.column("seed").to_numpy().view(np.uint64)[0], k, part)
            with np.errstate(over="ignore"):
                found, least = own.sample()
            for rank, (path, log, value) in enumerate(found, 1):
                ids = b"".join(w[2] for w in path)
                columns = [pa.array([x], t) for x, t in zip((rank, ids, len(ids) // 4, log, value, inclusion(log, least), all(w[3] for w in path)), (pa.int32(), pa.binary(), pa.int64(), pa.float64(), pa.float64(), pa.float64(), pa.bool_()))]
                yield pa.RecordBatch.from_arrays([batch.column("key"), *columns], names=["key", "rank", "ids", "n_pieces", "log_probability", "perturbed", "log_inclusion", "restores"])

        for whole in batches:
            for batch in slices(whole, "text", part):
                texts = batch.column("text")
                if len(batch) == 1 and len(texts[0].as_buffer()) > part:
                    yield from long_rows(pieces, batch)
                    continue
                with np.errstate(over="ignore"):
                    lattice, found, least = sample_part(pieces, texts, batch.column("seed").to_numpy().view(np.uint64), k)
                bodies = [b" " + x.encode("utf-8", "surrogatepass") for x in texts.to_pylist()]
                row, ids, out = [], [], []
                for rank in range(1, k + 1):
                    docs = [d for d, own in enumerate(found) if len(own) >= rank]
                    if not docs:
                        break
                    edges = np.concatenate([found[d][rank - 1][0].edges for d in docs])
                    ends = np.cumsum([len(found[d][rank - 1][0].edges) for d in docs])
                    runs = lattice.run[edges]
                    tokens = gather(lattice.run_ids, lattice.run_begin, lattice.run_length, runs)
                    upto = np.append(0, np.cumsum(lattice.run_length[runs]))[np.append(0, ends)]
                    flat = tokens.astype("<i4").tobytes()
                    text = gather(pieces.byte_flat, pieces.byte_begin, pieces.byte_length, tokens).tobytes()
                    at = np.append(0, np.cumsum(pieces.byte_length[tokens]))[upto].tolist()
                    cut = upto.tolist()
                    for i, d in enumerate(docs):
                        _, log, value = found[d][rank - 1]
                        row.append(d)
                        ids.append(flat[4 * cut[i] : 4 * cut[i + 1]])
                        out.append((rank, cut[i + 1] - cut[i], log, value, inclusion(log, least[d]), text[at[i] : at[i + 1]] == bodies[d]))
                columns = list(zip(*out)) if out else [[]] * 6
                kinds = (pa.int32(), pa.int64(), pa.float64(), pa.float64(), pa.float64(), pa.bool_())
                rank, n, log, value, score, same = (pa.array(c, t) for c, t in zip(columns, kinds))
                yield pa.RecordBatch.from_arrays([batch.column("key").take(pa.array(row, pa.int64())), rank, pa.array(ids, pa.binary()), n, log, value, score, same], names=["key", "rank", "ids", "n_pieces", "log_probability", "perturbed", "log_inclusion", "restores"])

    schema = f"key {kind}, rank int, ids binary, n_pieces long, log_probability double, perturbed double, log_inclusion double, restores boolean"
    return rows.mapInArrow(run, schema).withColumnRenamed("key", key)


def decode(rows: DataFrame, model: str, ids: str = "ids") -> DataFrame:
    """Adds the text of ids."""

    @F.pandas_udf("string", F.PandasUDFType.SCALAR_ITER)
    def run(parts):
        import numpy as np
        import pandas as pd

        pieces = Pieces(model)
        for part in parts:
            yield pd.Series([None if x is None else pieces.decode(np.frombuffer(x, "<i4").tolist()) for x in part], dtype=object)

    return rows.withColumn("text", run(F.col(ids)))


def encode(documents: DataFrame, model: str, text: str = "text") -> DataFrame:
    """Adds ids (little-endian signed 32-bit numbers in a binary): the library's own best segmentation of the whole text."""

    @F.pandas_udf("binary", F.PandasUDFType.SCALAR_ITER)
    def run(parts):
        import numpy as np
        import pandas as pd
        import sentencepiece

        own = sentencepiece.SentencePieceProcessor(model_file=model)
        for part in parts:
            yield pd.Series([np.array(x, "<i4").tobytes() for x in own.encode([x or "" for x in part], num_threads=1)], dtype=object)

    return documents.withColumn("ids", run(F.col(text)))
