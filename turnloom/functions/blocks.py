"""Longest common blocks of two sequences, as difflib defines them, without its quadratic search.

The longest block comes first (ties: earliest in a, then in b), then the same on both sides of it. Sequences are compared as
strings, an item a character. A block holds a whole piece of a, of half its length; so long blocks are found by a search for few
pieces. Short ones come from the pairs of equal items, where there are few, else from a suffix automaton of b, in linear time. All blocks of the greatest
length are taken in one go, as each next one is the longest to the right of the one before; so many blocks of the same
length do not make deep recursions.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter, defaultdict
from collections.abc import Sequence

#: Pairs of equal items for each item up to which they are looked at one by one.
FEW = 12
#: Pairs of items up to which nothing else is tried; the shortest pieces that are searched for; pieces up to which each is searched for by itself.
TINY, SHORTEST, SINGLE = 32, 2, 128

Block = tuple[int, int, int]


def by_pairs(a: Sequence, b: Sequence) -> tuple[int, list[tuple[int, int]]]:
    """The greatest length of a common block, and where blocks of it start in a and b, each behind the one before in both."""
    places = defaultdict(list)
    for j, x in enumerate(b):
        places[x].append(j)
    best, starts, before = 0, [], {}
    none: list[int] = []
    for i, x in enumerate(a):
        here = {}
        for j in places.get(x, none):
            k = here[j] = before.get(j - 1, 0) + 1
            if k > best:
                best, starts = k, [(i - k + 1, j - k + 1)]
            elif k == best:
                starts.append((i - k + 1, j - k + 1))
        before = here
    out, i, j = [], 0, 0
    for x, y in starts:
        if x >= i and y >= j:
            out.append((x, y))
            i, j = x + best, y + best
    return best, out


class Automaton:
    """The suffix automaton of a sequence: each state is a set of substrings that end at the same places."""

    def __init__(self, b: Sequence):
        #: Of each state: items of its longest substring, the state of the longest suffix that ends elsewhere too, the states one item on.
        self.length, self.link, self.next = [0], [-1], [{}]
        length, link, next_ = self.length, self.link, self.next
        last = 0
        for x in b:
            new = len(length)
            length.append(length[last] + 1)
            link.append(0)
            next_.append({})
            p = last
            while p >= 0 and x not in next_[p]:
                next_[p][x] = new
                p = link[p]
            if p >= 0:
                q = next_[p][x]
                if length[p] + 1 == length[q]:
                    link[new] = q
                else:
                    copy = len(length)
                    length.append(length[p] + 1)
                    link.append(link[q])
                    next_.append(dict(next_[q]))
                    while p >= 0 and next_[p].get(x) == q:
                        next_[p][x] = copy
                        p = link[p]
                    link[q] = link[new] = copy
            last = new

    def ends(self, a: Sequence, most: int | None = None) -> list[tuple[int, int]]:
        """For each place of a: items that the longest match ending there has (at most `most`), and its state."""
        length, link, next_ = self.length, self.link, self.next
        out, state, n = [], 0, 0
        for x in a:
            while state and x not in next_[state]:
                state = link[state]
                n = length[state]
            if x in next_[state]:
                state = next_[state][x]
                n += 1
                if most is not None and n >= most:
                    n = most
                    while length[link[state]] >= most:
                        state = link[state]
            out.append((n, state))
        return out


def by_automaton(a: Sequence, b: Sequence) -> tuple[int, list[tuple[int, int]]]:
    """The same as `by_pairs`."""
    found = Automaton(b)
    ends = found.ends(a)
    best = max((n for n, _ in ends), default=0)
    if not best:
        return 0, []
    # Substrings of one length are the same if they have the same state.
    places = defaultdict(list)
    for j, (n, state) in enumerate(found.ends(b, best)):
        if n == best:
            places[state].append(j - best + 1)
    out, i, j = [], 0, 0
    for end, (n, state) in enumerate(ends):
        start = end - best + 1
        if n == best and start >= i:
            at = bisect_left(places[state], j)
            if at < len(places[state]):
                out.append((start, places[state][at]))
                i, j = start + best, places[state][at] + best
    return best, out


def hits(a: str, b: str, h: int):
    """Where pieces of a, each of h items and right behind the one before, occur in a and b."""
    n, m = len(a), len(b)
    if n // h <= SINGLE:
        for p in range(0, n - h + 1, h):
            piece = a[p : p + h]
            q = b.find(piece)
            while q >= 0:
                yield p, q
                q = b.find(piece, q + 1)
        return
    places = defaultdict(list)
    for p in range(0, n - h + 1, h):
        places[a[p : p + h]].append(p)
    for q in range(m - h + 1):
        if found := places.get(b[q : q + h]):
            for p in found:
                yield p, q


def by_pieces(a: str, b: str, most: int) -> tuple[int, list[tuple[int, int]]] | None:
    """The same as `by_pairs` where no common block is longer than `most`; None if pieces occur too often, for the items of both, or blocks are too short."""
    n, m = len(a), len(b)
    h, left = (min(most, n, m) + 1) // 2, FEW * (n + m)
    while h >= SHORTEST:
        best, starts, seen = 0, set(), {}
        for p, q in hits(a, b, h):
            left -= 1
            if left < 0:
                return None
            # On a diagonal, what the last block that was found there reaches over is in it.
            if seen.get(p - q, -1) >= p + h:
                continue
            i, j = p, q
            while i and j and a[i - 1] == b[j - 1]:
                i, j = i - 1, j - 1
            k, e = p + h, q + h
            while k < n and e < m and a[k] == b[e]:
                k, e = k + 1, e + 1
            seen[p - q] = k
            left -= k - i
            if k - i > best:
                best, starts = k - i, {(i, j)}
            elif k - i == best:
                starts.add((i, j))
        if best >= 2 * h - 1:
            out, i, j = [], 0, 0
            for x, y in sorted(starts):
                if x >= i and y >= j:
                    out.append((x, y))
                    i, j = x + best, y + best
            return best, out
        h = (best + 1) // 2 if best else h // 2
    return None


def greatest(a: Sequence, b: Sequence, most: int) -> tuple[int, list[tuple[int, int]]]:
    """The greatest length of a common block, at most `most`, and where blocks of it start, as `by_pairs` gives them."""
    if isinstance(a, str):
        if len(a) <= len(b):
            if (at := b.find(a)) >= 0:
                return len(a), [(0, at)]
        elif (at := a.find(b)) >= 0:
            return len(b), [(at, 0)]
        if len(a) * len(b) > TINY and (found := by_pieces(a, b, most)):
            return found
    many = Counter(b)
    few = sum(map(many.__getitem__, a)) <= FEW * (len(a) + len(b))
    return (by_pairs if few else by_automaton)(a, b)


def characters(a: Sequence, b: Sequence) -> tuple[Sequence, Sequence]:
    """Both sequences as strings, a character for each different item; as they are, if there are more items than characters."""
    if isinstance(a, str) and isinstance(b, str):
        return a, b
    ids: dict = {}
    x, y = ([ids.setdefault(v, len(ids)) for v in s] for s in (a, b))
    if len(ids) > 0x10F000:
        return a, b
    letter = [chr(k if k < 0xD800 else k + 0x800) for k in range(len(ids))]
    return "".join(map(letter.__getitem__, x)), "".join(map(letter.__getitem__, y))


def matching(a: Sequence, b: Sequence) -> list[Block]:
    """(place in a, place in b, length) of all common blocks, in order; blocks that touch in both are one."""
    a, b = characters(a, b)
    found: list[Block] = []
    todo = [(0, len(a), 0, len(b), len(a))]
    while todo:
        alo, ahi, blo, bhi, most = todo.pop()
        if alo == ahi or blo == bhi:
            continue
        best, starts = greatest(a[alo:ahi], b[blo:bhi], most)
        if not best:
            continue
        i, j = alo, blo
        for p, q in starts:
            found.append((alo + p, blo + q, best))
            todo.append((i, alo + p, j, blo + q, best))
            i, j = alo + p + best, blo + q + best
        todo.append((i, ahi, j, bhi, best))
    out: list[Block] = []
    for i, j, k in sorted(found):
        if out and out[-1][0] + out[-1][2] == i and out[-1][1] + out[-1][2] == j:
            out[-1] = (*out[-1][:2], out[-1][2] + k)
        else:
            out.append((i, j, k))
    return out


def ratio(a: Sequence, b: Sequence) -> float:
    """Twice the items in common blocks over all items; 1 if there are none."""
    n = len(a) + len(b)
    return 2.0 * sum(k for _, _, k in matching(a, b)) / n if n else 1.0


def steps(a: Sequence, b: Sequence) -> list[tuple[str, int, int, int, int]]:
    """(what, start in a, end, start in b, end) from the one to the other: equal, replace, delete or insert."""
    out, i, j = [], 0, 0
    for p, q, k in [*matching(a, b), (len(a), len(b), 0)]:
        if i < p or j < q:
            out.append(("replace" if i < p and j < q else "delete" if i < p else "insert", i, p, j, q))
        if k:
            out.append(("equal", p, p + k, q, q + k))
        i, j = p + k, q + k
    return out
