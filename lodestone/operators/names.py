"""Names alike, by blocks: names with common beginnings meet by groups, a pair of groups is compared once for each pattern of its beginnings."""

from __future__ import annotations

import difflib
from collections.abc import Iterator

import numpy as np


def similarity(a: str, b: str) -> float:
    return difflib.SequenceMatcher(None, a, b).ratio()


#: Cells of a chunk's arrays, and classes of letters for the bound by counts.
CELLS, LETTERS = 20_000_000, 64
#: Letters at the end of a name that its group leaves open, most letters of two blocks that meet by groups, and pairs of names that a pair of groups then has on average.
ENDS, ALPHABET, DENSE = 2, 64, 100
#: Pairs of groups at once. Bytes of tables that a worker keeps, and those it has: it meets the same ones in many blocks.
GROUPS, TABLES = 150_000, 192 << 20
_TABLES: dict[bytes, _Table] = {}
_ABSENT = 1 << 20
#: From this length on SequenceMatcher leaves frequent letters out.
_LONG = 200


def _common(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Lengths of the longest common subsequences of rows (up to 64 letters each in x), no ratio matches more; by bits of x."""
    ones = np.full(len(x), np.uint64(0xFFFFFFFFFFFFFFFF))
    equal = np.zeros((len(x), 64), bool)
    for at in range(y.shape[1]):
        equal[:, : x.shape[1]] = x == y[:, at : at + 1]
        hit = np.packbits(equal, axis=1, bitorder="little").view("<u8").ravel()
        both = ones & hit
        ones = (ones + both) | (ones & ~hit)
    return np.bitwise_count(~ones).astype(np.int64)


def _matched(x: np.ndarray, y: np.ndarray, m: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Letters in the matching blocks of SequenceMatcher, of rows with m and n letters: the longest block, the first in x, then in y; then what lies on its left and its right."""
    out = np.zeros(len(x), np.int64)
    rows, top = np.arange(len(x)), np.zeros(len(x), np.int64)
    spans = np.stack([top, m, top, n])
    kind = np.int8 if max(x.shape[1], y.shape[1]) < 127 else np.int32
    while True:
        some = (spans[0] < spans[1]) & (spans[2] < spans[3])
        rows, spans = rows[some], spans[:, some]
        if not len(rows):
            return out
        lo, hi = int(spans[0].min()), int(spans[1].max())
        left, right = int(spans[2].min()), int(spans[3].max())
        at, to = np.arange(lo, hi), np.arange(left, right)
        a = np.where((at >= spans[0][:, None]) & (at < spans[1][:, None]), x[rows, lo:hi], -1)
        b = np.where((to >= spans[2][:, None]) & (to < spans[3][:, None]), y[rows, left:right], -2)
        run = np.zeros((len(rows), right - left + 1), kind)
        best, i, j = (np.zeros(len(rows), np.int64) for _ in range(3))
        for t in range(hi - lo):
            run[:, 1:] = (run[:, :-1] + 1) * (a[:, t : t + 1] == b)
            longer = np.flatnonzero(run.max(1) > best)
            if len(longer):
                end = run[longer].argmax(1)
                best[longer] = run[longer, end]
                i[longer], j[longer] = lo + t + 1 - best[longer], left + end - best[longer]
        np.add.at(out, rows, best)
        hit = best > 0
        rows, best, i, j, spans = rows[hit], best[hit], i[hit], j[hit], spans[:, hit]
        spans = np.concatenate([np.stack([spans[0], i, spans[2], j]), np.stack([i + best, spans[1], j + best, spans[3]])], axis=1)
        rows = np.concatenate([rows, rows])


def _verdicts(a: np.ndarray, b: np.ndarray, cutoff: float) -> np.ndarray:
    """Whether similarity(x, y) >= cutoff, for rows x of a and y of b: codes of letters, -1 past a name's end."""
    m, n = (a >= 0).sum(1), (b >= 0).sum(1)
    out = m + n == 0
    if cutoff > 1:
        return np.zeros(len(a), bool)
    b = np.where(b < 0, -2, b)
    ratio = lambda matched, which: 2.0 * matched / np.maximum(m[which] + n[which], 1) >= cutoff
    todo = np.flatnonzero(~out)
    if a.shape[1] <= 64:
        todo = todo[ratio(_common(a[todo], b[todo]), todo)]
    plain = todo[n[todo] < _LONG]
    out[plain] = ratio(_matched(a[plain], b[plain], m[plain], n[plain]), plain)
    for i in todo[n[todo] >= _LONG]:
        out[i] = similarity("".join(map(chr, a[i, : m[i]])), "".join(map(chr, b[i, : n[i]]))) >= cutoff
    return out


def _letters(names: list[str]) -> list[str]:
    return sorted(set("".join(names)))


def _linked(names: list[str], left: np.ndarray, right: np.ndarray, cutoff: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of all pairs of names alike, one of each block (two of a block where both are the same), in chunks; names stand in order of place."""
    lengths = np.array([len(n) for n in names])
    letters = {c: i for i, c in enumerate(_letters(names))}
    codes = np.full((len(names), max(1, lengths.max())), -1, np.int32)
    counts = np.zeros((min(LETTERS, max(1, len(letters))), len(names)), np.int16)
    for i, name in enumerate(names):
        codes[i, : len(name)] = [letters[c] for c in name]
        for c in name:
            counts[letters[c] % LETTERS, i] += 1
    step = max(1, CELLS // (20 * max(64, codes.shape[1])))
    for row in np.array_split(left, max(1, len(left) * len(right) * 8 // CELLS)):
        shared = np.zeros((len(row), len(right)), np.int16)
        for letter in counts:
            shared += np.minimum(letter[row][:, None], letter[right][None, :])
        both = lengths[row][:, None] + lengths[right][None, :]
        # as the ratio, with all letters in common matched
        may = np.where(both > 0, 2.0 * shared / np.maximum(both, 1), 1.0) >= cutoff
        if left is right:
            may &= row[:, None] < right[None, :]
        x, y = np.nonzero(may)
        x, y = row[x], right[y]
        first, second = np.minimum(x, y), np.maximum(x, y)
        for at in range(0, len(first), step):
            a, b = first[at : at + step], second[at : at + step]
            kept = _verdicts(codes[a], codes[b], cutoff)
            yield a[kept], b[kept]


def _joined(low: np.ndarray, first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """low (the least place that each place is known to reach) after links from first to second."""
    while True:
        a, b = low[first], low[second]
        apart = a != b
        if not apart.any():
            return low
        first, second, a, b = first[apart], second[apart], a[apart], b[apart]
        low = low.copy()
        np.minimum.at(low, np.maximum(a, b), np.minimum(a, b))
        while (low[low] != low).any():
            low = low[low]


class _Table:
    """Verdicts on names p + s and q + t for one pattern of beginnings p and q, by places of the endings s and t among those met; back: q + t comes first."""

    def __init__(self, p: np.ndarray, q: np.ndarray, sizes: tuple[int, int], base: int, back: bool, cutoff: float):
        self.heads, self.sizes, self.base, self.back, self.cutoff = (p, q), sizes, base, back, cutoff
        self.open = int(max(h.max(initial=-1) for h in self.heads)) + 1  # codes from here on stand for letters of no beginning
        self.at = [np.full(base**n, -1, np.int16) for n in sizes]
        self.ends = [np.zeros(0, np.int16), np.zeros(0, np.int16)]
        self.bits, self.asked = np.zeros(0, np.uint8), np.zeros((0, 0), bool)

    def bytes(self) -> int:
        return self.bits.nbytes + (0 if self.asked is None else self.asked.nbytes) + sum(a.nbytes for a in (*self.at, *self.ends, *self.heads)) + 2_000

    def yes(self) -> np.ndarray:
        u, v = map(len, self.ends)
        return np.unpackbits(self.bits, count=u * v).reshape(u, v)

    def places(self, one: np.ndarray, two: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of endings (numbers in the base) of either side; verdicts on all of one with all of two are there then."""
        asked, known = (0, 0), tuple(map(len, self.ends))
        for side, ends in enumerate((one, two)):
            new = np.unique(ends[self.at[side][ends] < 0])
            if len(new):
                self.at[side][new] = len(self.ends[side]) + np.arange(len(new))
                self.ends[side] = np.concatenate([self.ends[side], new.astype(np.int16)])
        shape = tuple(map(len, self.ends))
        x, y = self.at[0][one], self.at[1][two]
        if shape == known and self.asked is None:
            return x, y
        yes, asked = np.zeros(shape, np.uint8), np.zeros(shape, bool)
        u, v = known
        yes[:u, :v] = np.unpackbits(self.bits, count=u * v).reshape(u, v)
        asked[:u, :v] = True if self.asked is None else self.asked
        rows, columns = np.zeros(shape[0], bool), np.zeros(shape[1], bool)
        rows[x], columns[y] = True, True
        u, v = np.nonzero(~asked & rows[:, None] & columns[None, :])
        for at in range(0, len(u), CELLS // 200):
            some = slice(at, at + CELLS // 200)
            yes[u[some], v[some]] = self._found(u[some], v[some])
        asked[u, v] = True
        self.bits, self.asked = np.packbits(yes), None if asked.all() else asked
        return x, y

    def _found(self, u: np.ndarray, v: np.ndarray) -> np.ndarray:
        tails = [(e.astype(np.int64)[:, None] // self.base ** np.arange(n)[None, :]) % self.base for e, n in zip(self.ends, self.sizes)]
        shared = np.zeros(len(u), np.int16)
        for c in range(self.base):
            one, two = (((h == c).sum() + (t == c).sum(1)).astype(np.int16) for h, t in zip(self.heads, tails))
            if one.any() and two.any():
                shared += np.minimum(one[u], two[v])
        length = sum(map(len, self.heads)) + sum(self.sizes)
        out = 2.0 * shared / max(length, 1) >= self.cutoff if length else np.full(len(u), self.cutoff <= 1.0)
        may = np.flatnonzero(out)
        if not len(may) or not length:
            return out
        tail = np.concatenate([tails[0][u[may]], tails[1][v[may]]], axis=1)
        was = tail.copy()
        for t in range(tail.shape[1]):  # of a letter of no beginning it counts only where it stands first
            tail[:, t] = np.where(was[:, t] < self.open, was[:, t], self.open + (was[:, : t + 1] == was[:, t : t + 1]).argmax(1))
        packed = (tail << (8 * np.arange(tail.shape[1]))[None, :]).sum(1)
        _, i, of = np.unique(packed, return_index=True, return_inverse=True)
        n = self.sizes[0]
        full = [np.concatenate([np.broadcast_to(h, (len(i), len(h))), t], axis=1).astype(np.int16) for h, t in zip(self.heads, (tail[i, :n], tail[i, n:]))]
        if self.back:
            full.reverse()
        out[may] = _verdicts(*full, self.cutoff)[of.ravel()]
        return out


class _Groups:
    """Names of a block by their beginnings, those of one class of sizes: a row of places (`none` past a group's end), weights and endings for each."""

    def __init__(self, names: list[str], groups: list[tuple[int, str, int, list[int]]], letters: dict[str, int], weight: np.ndarray, none: int):
        base, count, most = len(letters), len(groups), max(len(of) for *_, of in groups)
        self.ids = np.array([i for i, *_ in groups])
        self.length = np.array([len(head) for _, head, *_ in groups])
        self.ends = np.array([n for _, _, n, _ in groups])
        self.starts = np.full((count, base), _ABSENT)  # where a beginning has a letter first
        self.heads = np.full((count, self.length.max()), base + 1)
        self.places = np.full((count, most), none)
        self.tails = np.full((count, most, ENDS), base)
        for g, (_, head, n, of) in enumerate(groups):
            codes = np.array([letters[c] for c in head], np.int64)
            self.starts[g, codes[::-1]] = np.arange(len(head))[::-1]
            self.heads[g, : len(head)] = codes
            self.places[g, : len(of)] = of
            if n:
                self.tails[g, : len(of), :n] = [[letters[c] for c in names[i][len(head) :]] for i in of]
            self.tails[g, len(of) :] = self.tails[g, 0]
        self.first, self.last = self.places[:, 0], np.where(self.places < none, self.places, -1).max(1)
        # past a group's end its first name stands again; what it gets goes to no place
        self.weight = weight[np.where(self.places < none, self.places, self.places[:, :1])].astype(float)


def _classes(names: list[str], block: np.ndarray) -> tuple[int, list[list[tuple[int, str, int, list[int]]]]]:
    """The number of groups of a block, and groups (number, beginning, letters of the endings, places) by classes of their sizes."""
    by: dict[tuple[str, int], list[int]] = {}
    for i in block.tolist():
        by.setdefault((names[i][:-ENDS], min(len(names[i]), ENDS)), []).append(i)
    out: dict[int, list] = {}
    for i, ((head, n), of) in enumerate(by.items()):
        out.setdefault(len(of).bit_length(), []).append((i, head, n, of))
    return len(by), list(out.values())


def linked(names: list[str], left: np.ndarray, right: np.ndarray, weight: np.ndarray, cutoff: float) -> tuple[np.ndarray, np.ndarray]:
    """(sums, low): the weight of the names that each is alike to, of pairs with one name of each block (two of a block where both are the same), and the least
    place that it reaches by them; names stand in order of place.

    Blocks of names with common beginnings meet by groups: which endings are alike depends on the pattern of both beginnings, so a table of verdicts serves all
    pairs of groups of one pattern, and a group's sums are its product with the weights of the other group. Other blocks meet name by name.
    """
    letters = {c: i for i, c in enumerate(_letters(names))}
    ours, mine = _classes(names, left)
    theirs, yours = (ours, mine) if left is right else _classes(names, right)
    if not letters or len(letters) > ALPHABET or len(left) * len(right) < DENSE * ours * theirs:
        sums, low = np.zeros(len(names)), np.arange(len(names))
        for first, second in _linked(names, left, right, cutoff):
            sums += np.bincount(first, weight[second], len(names)) + np.bincount(second, weight[first], len(names))
            low = _joined(low, first, second)
        return sums, low
    met = _Met(len(names), len(letters), cutoff)
    one = [_Groups(names, c, letters, weight, len(names)) for c in mine]
    two = one if left is right else [_Groups(names, c, letters, weight, len(names)) for c in yours]
    for a in one:
        for b in two:
            width = max(1, min(len(b.ids), GROUPS))
            for i in range(0, len(a.ids), max(1, GROUPS // width)):
                for j in range(0, len(b.ids), width):
                    g, h = np.meshgrid(np.arange(len(a.ids))[i : i + max(1, GROUPS // width)], np.arange(len(b.ids))[j : j + width], indexing="ij")
                    g, h = g.ravel(), h.ravel()
                    if left is right:
                        once = a.ids[g] <= b.ids[h]
                        g, h = g[once], h[once]
                    met.add(a, b, g, h, left is right)
    return met.sums[:-1], met.low[:-1]


class _Met:
    """What pairs of groups add up to: sums and the least place reached, with one more place for none."""

    def __init__(self, count: int, base: int, cutoff: float):
        self.sums, self.low, self.base, self.cutoff = np.zeros(count + 1), np.arange(count + 1), base, cutoff
        self.whole = False  # whether all names are known to reach one another
        self.power = base ** np.arange(ENDS)
        self.kept = sum(t.bytes() for t in _TABLES.values())

    def add(self, a: _Groups, b: _Groups, g: np.ndarray, h: np.ndarray, same: bool) -> None:
        """Pairs of groups g of a and h of b."""
        base = self.base
        # letters in the order in which both beginnings have them first; the others follow in their own order
        order = np.argsort(np.where(a.starts[g] < _ABSENT, a.starts[g], a.length[g][:, None] + b.starts[h]), axis=1, kind="stable")
        codes = np.zeros((len(g), base + 2), np.uint8)
        np.put_along_axis(codes, order, np.broadcast_to(np.arange(base, dtype=np.uint8), order.shape), 1)
        codes[:, base + 1] = 255
        back = b.last[h] < a.first[g]
        mixed = ~back & (a.last[g] >= b.first[h])
        kinds = np.concatenate([np.take_along_axis(codes, a.heads[g], 1), np.take_along_axis(codes, b.heads[h], 1), np.stack([a.ends[g], b.ends[h], back], axis=1).astype(np.uint8)], axis=1)
        _, of = np.unique(np.ascontiguousarray(kinds).view(f"V{kinds.shape[1]}").ravel(), return_inverse=True)
        for i in np.flatnonzero(mixed):
            self.mixed(a, b, g[i], h[i], kinds[i], codes[i], same and a.ids[g[i]] == b.ids[h[i]])
        plain = np.flatnonzero(~mixed)
        plain = plain[np.argsort(of.ravel()[plain], kind="stable")]
        edges = np.flatnonzero(np.diff(of.ravel()[plain])) + 1
        most = max(1, CELLS // (64 * (a.places.shape[1] + b.places.shape[1])))
        for some in np.split(plain, edges) if len(plain) else []:
            for at in range(0, len(some), most):
                pairs = some[at : at + most]
                self.plain(a, b, g[pairs], h[pairs], kinds[pairs[0]], codes[pairs])

    def table(self, kind: np.ndarray, length: int, back: bool, ends: tuple[np.ndarray, np.ndarray]) -> tuple[_Table, np.ndarray, np.ndarray]:
        p, q = kind[:length], kind[length:-3]
        p, q = p[p < 255].astype(np.int64), q[q < 255].astype(np.int64)
        key = f"{self.cutoff},{self.base},{len(p)},{kind[-3]},{kind[-2]},{back},".encode() + p.astype(np.uint8).tobytes() + q.astype(np.uint8).tobytes()
        if self.kept > TABLES:
            _TABLES.clear()
            self.kept = 0
        found = _TABLES.get(key)
        if found is None:
            found = _TABLES[key] = _Table(p, q, (int(kind[-3]), int(kind[-2])), self.base, back, self.cutoff)
            size = 0
        else:
            size = found.bytes()
        x, y = found.places(*ends)
        self.kept += found.bytes() - size
        return found, x, y

    def numbers(self, tails: np.ndarray, codes: np.ndarray) -> np.ndarray:
        return codes[np.arange(len(codes))[:, None, None], tails] @ self.power

    def plain(self, a: _Groups, b: _Groups, g: np.ndarray, h: np.ndarray, kind: np.ndarray, codes: np.ndarray) -> None:
        """Pairs of one pattern, all names of one group before those of the other."""
        ends = self.numbers(a.tails[g], codes), self.numbers(b.tails[h], codes)
        table, x, y = self.table(kind, a.heads.shape[1], bool(kind[-1]), ends)
        yes = table.yes().astype(float)
        rows = np.arange(len(g))[:, None]
        of, to = np.zeros((len(g), yes.shape[0])), np.zeros((len(g), yes.shape[1]))
        of[rows, x], to[rows, y] = a.weight[g], b.weight[h]
        one, two = (to @ yes.T)[rows, x], (of @ yes)[rows, y]
        mine, yours = a.places[g], b.places[h]
        np.add.at(self.sums, mine.ravel(), one.ravel())
        np.add.at(self.sums, yours.ravel(), two.ravel())
        none = len(self.low) - 1
        one, two = (one > 0) & (mine < none), (two > 0) & (yours < none)
        todo = np.arange(len(g))
        while len(todo) and not self.whole:
            seen = [(hit[todo], self.low[of[todo]]) for hit, of in ((one, mine), (two, yours))]
            least = np.minimum(*(np.where(hit, low, none).min(1) for hit, low in seen))
            most = np.maximum(*(np.where(hit, low, -1).max(1) for hit, low in seen))
            apart = todo[least < most]
            now, todo = apart[:64], apart[64:]
            i, u, v = np.nonzero((yes[x[now][:, :, None], y[now][:, None, :]] > 0) & one[now][:, :, None] & two[now][:, None, :])
            self.join(mine[now][i, u], yours[now][i, v])

    def mixed(self, a: _Groups, b: _Groups, g: int, h: int, kind: np.ndarray, codes: np.ndarray, same: bool) -> None:
        """A pair of groups, or a group with itself, whose names' places lie among each other."""
        none = len(self.low) - 1
        here, there = a.places[g] < none, b.places[h] < none
        mine, yours = a.places[g][here], b.places[h][there]
        if same and len(mine) == 1:
            return
        ends = self.numbers(a.tails[g][here][None], codes[None])[0], self.numbers(b.tails[h][there][None], codes[None])[0]
        found = []
        for back in (False,) if same else (False, True):
            table, x, y = self.table(kind, a.heads.shape[1], back, ends)
            found.append(table.yes()[np.ix_(x, y)] > 0)
        before = mine[:, None] < yours[None, :]
        links = found[0] & before if same else np.where(before, *found)
        self.sums[mine] += links @ b.weight[h][there]
        self.sums[yours] += a.weight[g][here] @ links
        if not self.whole:
            u, v = np.nonzero(links)
            self.join(mine[u], yours[v])

    def join(self, first: np.ndarray, second: np.ndarray) -> None:
        low = _joined(self.low, first, second)
        if low is not self.low:
            self.low, self.whole = low, bool((low[:-1] == low[0]).all())
