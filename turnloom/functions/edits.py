"""Similarity, edit counts and matching of pairs of texts, as Arrow UDFs.

Edit counts are minimal, with ties going to substitution, then deletion, then insertion; beyond
MOST_CELLS of the table they come from longest common blocks and say so.
"""

from __future__ import annotations

import unicodedata
from collections import Counter
from functools import cache

import numpy as np
import pandas as pd
import regex

from . import blocks, spoken
from .udf import listed, short, vectorized

#: Cells of an edit table (reference length times hypothesis length) that are computed exactly.
MOST_CELLS = 2_000_000

COUNTS = "struct<substitutions:long,deletions:long,insertions:long,correct:long,approximate:long,reference:long>"
_MARK = regex.compile(r"(?<=[\p{L}\p{N}_])@!")
_ANNOTATED = regex.compile(r"([\p{L}\p{N}]+(?:['’][\p{L}\p{N}]+)*)(@!)?")


@short(1 << 10)
def word_counts(s: str) -> Counter:
    return Counter(spoken.words(s))


@short(1 << 10)
def parts(s: str) -> Counter:
    """`word_counts` of a normalized text, whose words are its parts: folding twice is folding once."""
    return Counter(s.split())


def token_overlap(a: str, b: str, counts=word_counts) -> float:
    x, y = counts(a), counts(b)
    if not x or not y:
        return 0.0
    common = sum(min(n, y[w]) for w, n in x.items() if w in y)
    return common / (x.total() + y.total() - common)


def difference_rate(a: str, b: str) -> float:
    x, y = word_counts(a), word_counts(b)
    if not x and not y:
        return 0.0
    return min(1.0, ((x - y).total() + (y - x).total()) / max(1, x.total(), y.total()))


def similarity(a: str | None, b: str | None) -> float:
    """0.65 of the ratio of matching characters plus 0.35 of the words' Jaccard; not symmetric."""
    x, y = spoken.normalized(a), spoken.normalized(b)
    return 0.65 * blocks.ratio(x, y) + 0.35 * token_overlap(x, y, parts) if x and y else 0.0


def agreement(texts: list[str], alike=similarity) -> float:
    """Mean similarity of each two present texts; 0 for fewer than two."""
    have = [t for t in texts if t.strip()]
    pairs = [alike(have[i], have[j]) for i in range(len(have)) for j in range(i + 1, len(have))]
    return sum(pairs) / len(pairs) if pairs else 0.0


def characters(s: str | None) -> str:
    """What character error rates compare: annotations dropped, compatibility form, folded."""
    return unicodedata.normalize("NFKC", _MARK.sub("", s or "")).replace("’", "'").casefold()


def encoded(ref, hyp) -> tuple[np.ndarray, np.ndarray]:
    """Both sequences as small integers."""
    ids: dict = {}
    return np.array([ids.setdefault(x, len(ids)) for x in ref], np.int64), np.array([ids.setdefault(x, len(ids)) for x in hyp], np.int64)


def edit_counts(ref, hyp) -> tuple[int, int, int, int, int]:
    """(substitutions, deletions, insertions, correct, approximate) that turn ref into hyp.

    Only a band of diagonals is computed. A path of cost t leaves it neither by its deletions nor by its insertions, so a
    result of at most t is final; else the band doubles. All cells of cheapest paths are exact then, and a cell outside
    of them can only look dearer, so ties fall as in the whole table.
    """
    n, m = len(ref), len(hyp)
    if n * m > MOST_CELLS:
        return *block_counts(ref, hyp), 1
    if not n or not m:
        return 0, n, m, 0, 0
    t = max(BAND, abs(n - m))
    while True:
        deletions, insertions = min(n, (t + n - m) // 2), min(m, (t + m - n) // 2)
        cost, rows = band(ref, hyp, deletions, insertions)
        if cost <= t or deletions == n and insertions == m:
            return *walked(ref, hyp, deletions, rows), 0
        t = 2 * t + 1


#: Errors for which the first band is wide enough.
BAND = 62


def band(ref, hyp, left: int, right: int) -> tuple[int, list[tuple[int, int]]]:
    """The cost, and the rows of the table of edits, on diagonals from -left to right.

    A row is two integers. Bit k stands for hypothesis item i - left + k beside reference item i (both from 1): in the one, whether
    the cell costs what the one before both costs; in the other, whether it costs one more than the cell above. Rows follow
    from each other by a few operations on whole integers (Myers's and Hyyro's rules). Before the first item of the hypothesis
    the table is as if nothing there were equal.
    """
    width, m = left + right + 1, len(hyp)
    whole = (1 << width) - 1
    places: dict = {}
    for j, x in enumerate(hyp):
        places[x] = places.get(x, 0) | 1 << j
    # Whether a cell costs one more, or one less, than the one to its left; aligned with the next row.
    more, less = whole & ~((1 << left) - 1), 0
    rows, lowest = [], 0
    for i, x in enumerate(ref):
        at = places.get(x, 0)
        at = (at >> i - left if i >= left else at << left - i) & whole
        same = ((((at & more) + more) ^ more) | at | less) & whole
        above = less | whole ^ (same | more)
        below = same & more
        lowest += not same & 1
        more, less = below | whole ^ (same >> 1 | above), same >> 1 & above
        rows.append((same, above))
    upto = (1 << m - len(ref) + left) - 1
    return lowest + (more & upto).bit_count() - (less & upto).bit_count(), rows


def walked(ref, hyp, left: int, rows: list[tuple[int, int]]) -> tuple[int, int, int, int]:
    """(substitutions, deletions, insertions, correct) along the path from the ends: equal items and substitutions first, then deletions."""
    i, j = len(ref), len(hyp)
    s = d = c = 0
    while i and j:
        if ref[i - 1] == hyp[j - 1]:
            c += 1
            i, j = i - 1, j - 1
            continue
        same, above = rows[i - 1]
        bit = 1 << j - i + left
        if not same & bit:
            s += 1
            i, j = i - 1, j - 1
        elif above & bit:
            d += 1
            i -= 1
        else:
            j -= 1
    d += i
    return s, d, len(hyp) - s - c, c


def block_counts(ref, hyp) -> tuple[int, int, int, int]:
    """Counts by longest common blocks: of unequal stretches, the shorter side counts as substitutions."""
    s = d = i = c = 0
    for tag, a, b, x, y in blocks.steps(ref, hyp):
        left, right = b - a, y - x
        if tag == "equal":
            c += left
        else:
            s += min(left, right)
            d += max(0, left - right)
            i += max(0, right - left)
    return s, d, i, c


def counted(pairs) -> pd.DataFrame:
    rows = [(*edit_counts(r, h), len(r)) for r, h in pairs]
    return pd.DataFrame(rows, columns=["substitutions", "deletions", "insertions", "correct", "approximate", "reference"]).astype("int64")


@vectorized("double")
def text_similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([similarity(x, y) for x, y in zip(a, b, strict=True)])


@vectorized(COUNTS)
def word_edits(ref: pd.Series, hyp: pd.Series) -> pd.DataFrame:
    return counted((spoken.words(r), spoken.words(h)) for r, h in zip(ref, hyp, strict=True))


@vectorized(COUNTS)
def char_edits(ref: pd.Series, hyp: pd.Series) -> pd.DataFrame:
    return counted((characters(r), characters(h)) for r, h in zip(ref, hyp, strict=True))


def error_rate(counts: tuple, reference: int, hypothesis: int) -> float:
    """Errors over the reference; of an empty reference 0 if the hypothesis is empty too, else 1."""
    return (counts[0] + counts[1] + counts[2]) / reference if reference else float(hypothesis > 0)


def word_error(ref: str, hyp: str) -> float:
    r, h = spoken.words(ref), spoken.words(hyp)
    return error_rate(edit_counts(r, h), len(r), len(h))


def char_error(ref: str, hyp: str) -> float:
    r, h = characters(ref), characters(hyp)
    return error_rate(edit_counts(r, h), len(r), len(h))


@vectorized("double")
def word_error_rate(ref: pd.Series, hyp: pd.Series) -> pd.Series:
    return pd.Series([word_error(r or "", h or "") for r, h in zip(ref, hyp, strict=True)])


@vectorized("double")
def char_error_rate(ref: pd.Series, hyp: pd.Series) -> pd.Series:
    return pd.Series([char_error(r or "", h or "") for r, h in zip(ref, hyp, strict=True)])


# --- events of two texts ------------------------------------------------------------------------


def event_matches(ref: str | None, hyp: str | None) -> tuple[int, int, int]:
    """(reference events, hypothesis events, one-to-one matches at aligned places).

    A pair must share its key. With aligned words inside both events, or without, an aligned word
    next to both (on the same side) must locate it; events without any aligned word about them are
    taken by the words inside alone, or if each is its whole text.
    """
    left, right = spoken.events(ref), spoken.events(hyp)
    a, b = spoken.words(ref), spoken.words(hyp)
    to = np.full(len(a) + 1, -1)
    for i, j, k in blocks.matching(a, b):
        to[i : i + k] = np.arange(j, j + k)
    aligned = np.flatnonzero(to[:-1] >= 0) if len(a) else np.zeros(0, int)
    free = dict(enumerate(right))
    matched = 0
    for e in left:
        s, t = e[4], e[5]
        k = np.searchsorted(aligned, s)
        before = int(to[aligned[k - 1]]) if k else None
        k = np.searchsorted(aligned, t)
        after = int(to[aligned[k]]) if k < len(aligned) else None
        best = None
        for j, f in free.items():
            if spoken.key(e) != spoken.key(f):
                continue
            inside = int(((to[s:t] >= f[4]) & (to[s:t] < f[5])).sum())
            sides = int(before is not None and before == f[4] - 1) + int(after is not None and after == f[5])
            if not sides:
                alone = before is None and after is None
                whole = (s, t) == (0, len(a)) and (f[4], f[5]) == (0, len(b))
                if not (alone if inside else whole):
                    continue
            score = (inside, sides, -abs(s - f[4]), j)
            best = score if best is None or score > best else best
        if best:
            del free[best[3]]
            matched += 1
    return len(left), len(right), matched


@vectorized("struct<reference_events:long,hypothesis_events:long,matches:long>")
def matched_events(ref: pd.Series, hyp: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([event_matches(r, h) for r, h in zip(ref, hyp, strict=True)], columns=["reference_events", "hypothesis_events", "matches"]).astype("int64")


# --- annotated words ----------------------------------------------------------------------------


def annotated(s: str | None) -> list[tuple[str, bool]]:
    """(word, whether marked @!) of each word."""
    return [(m[1].replace("’", "'").casefold(), m[2] is not None) for m in _ANNOTATED.finditer(s or "")]


def preserved_words(gold: str | None, hyp: str | None) -> tuple[int, int, int, int]:
    """(marked words, kept, replaced, dropped) under a cheapest alignment that prefers matches."""
    ref = annotated(gold)
    if not any(mark for _, mark in ref):
        return 0, 0, 0, 0
    a, b = encoded([w for w, _ in ref], [w for w, _ in annotated(hyp)])
    n, m = len(a), len(b)
    # Costs of the rests of both texts; the path is then read forwards from them.
    table = np.zeros((n + 1, m + 1), np.int32)
    table[:, m] = np.arange(n, -1, -1)
    table[n] = np.arange(m, -1, -1)
    place = np.arange(m, -1, -1)
    for i in range(n - 1, -1, -1):
        best = np.minimum(table[i + 1, :-1] + 1, table[i + 1, 1:] + (b != a[i]))
        row = np.concatenate([best, [table[i, m]]])
        table[i] = np.minimum.accumulate((row - place)[::-1])[::-1] + place
    kept = swapped = gone = 0
    i = j = 0
    while i < n:
        mark = ref[i][1]
        if j < m and table[i, j] == table[i + 1, j + 1] + (a[i] != b[j]) and (a[i] == b[j] or table[i, j] != table[i, j + 1] + 1):
            kept += mark and a[i] == b[j]
            swapped += mark and a[i] != b[j]
            i, j = i + 1, j + 1
        elif j < m and table[i, j] == table[i, j + 1] + 1 and not table[i, j] == table[i + 1, j] + 1:
            j += 1
        elif table[i, j] == table[i + 1, j] + 1:
            gone += mark
            i += 1
        else:
            j += 1
    return sum(mark for _, mark in ref), int(kept), int(swapped), int(gone)


@vectorized("struct<evaluated:long,preserved:long,substituted:long,deleted:long>")
def grammar_words(gold: pd.Series, hyp: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([preserved_words(g, h) for g, h in zip(gold, hyp, strict=True)], columns=["evaluated", "preserved", "substituted", "deleted"]).astype("int64")


# --- differences on display ---------------------------------------------------------------------


def different_spans(a: str | None, b: str | None) -> list[tuple[int, int, int, int]]:
    """Character spans (of a, of b) of words that differ; an empty side is an empty span."""
    word = regex.compile(r"[\p{L}\p{N}_']+")
    x, y = list(word.finditer(a or "")), list(word.finditer(b or ""))

    def span(found, i, j, s):
        if i < j:
            return found[i].start(), found[j - 1].end()
        at = found[i].start() if i < len(found) else len(s or "")
        return at, at

    codes = blocks.steps([m[0].casefold() for m in x], [m[0].casefold() for m in y])
    return [(*span(x, i, j, a), *span(y, k, m, b)) for tag, i, j, k, m in codes if tag != "equal"]


@listed("struct<a_start:int,a_end:int,b_start:int,b_end:int>")
def difference_spans(a, b):
    return different_spans(a, b)


# --- choice between sources ---------------------------------------------------------------------


def initial_text(model: str, chatgpt: str, zoom: str) -> str:
    """The source text that agrees best with the others, or a more verbatim one that says the same."""
    have = [t for t in (model, chatgpt, zoom) if t and t.strip()]
    if len(have) < 2:
        return have[0] if have else ""

    def support(i: int) -> tuple[float, int, int]:
        others = [similarity(have[i], t) for j, t in enumerate(have) if j != i]
        votes = sum(spoken.normalized(have[i]) == spoken.normalized(t) for t in have)
        return sum(others) / len(others), votes, -i

    best = max(range(len(have)), key=support)
    counts = [sum(e[0] in spoken.VERBATIM for e in spoken.events(t)) for t in have]
    more = [i for i, n in enumerate(counts) if n > counts[best]]
    plain = spoken.skeleton(have[best]) if more else ""
    fuller = [(counts[i], close, -i) for i in more if (close := similarity(spoken.skeleton(have[i]), plain)) >= 0.65]
    return have[-max(fuller)[2]] if fuller else have[best]


@vectorized("string")
def best_text(model: pd.Series, chatgpt: pd.Series, zoom: pd.Series) -> pd.Series:
    return pd.Series([initial_text(a or "", b or "", c or "") for a, b, c in zip(model, chatgpt, zoom, strict=True)])


@vectorized("struct<agreement:double,zoom_model:double,chatgpt_model:double,zoom_chatgpt:double,disagreement:double,exact_majority:boolean,present:int>")
def source_agreement(zoom: pd.Series, chatgpt: pd.Series, model: pd.Series) -> pd.DataFrame:
    rows = []
    for z, c, m in zip(zoom, chatgpt, model, strict=True):
        z, c, m = z or "", c or "", m or ""
        have = [t for t in (z, c, m) if t.strip()]
        rates = [difference_rate(have[i], have[j]) for i in range(len(have)) for j in range(i + 1, len(have))]
        forms = [f for f in map(spoken.normalized, have) if f]
        alike = cache(similarity)  # the agreement is of the same pairs
        rows.append((
            agreement(have, alike), alike(z, m) if z.strip() else 0.0, alike(c, m) if c.strip() else 0.0,
            alike(z, c) if z.strip() and c.strip() else 0.0, sum(rates) / len(rates) if rates else 1.0,
            bool(forms) and max(forms.count(f) for f in forms) >= 2, len(have),
        ))
    out = pd.DataFrame(rows, columns=["agreement", "zoom_model", "chatgpt_model", "zoom_chatgpt", "disagreement", "exact_majority", "present"])
    return out.astype({"present": "int32", "exact_majority": "bool", **{c: "float64" for c in out.columns[:5]}})
