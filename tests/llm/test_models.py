"""The language models of languages and of toxicity against plain versions, also with tables of many shards."""
import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from turnloom.llm import common, langid, toxicity


def fold(i, n):
    return zlib.crc32(str(i).encode()) % n


#: A document of the calibration fold.
ALONE = next(i for i in range(2000, 2100) if fold(i, 5) == 1)

# --- languages


def plain_symbols(text):
    out = []
    for c in text:
        if c.isalpha():
            out.append(c.lower() if len(c.lower()) == 1 else c)
        elif out and out[-1] != " ":
            out.append(" ")
    return out if out and out[0] != " " else out[1:]


def plain_language_models(rows):
    """For each language a function of a text to its log probabilities."""
    grams = defaultdict(Counter)
    alone = {lang for _, _, lang in rows} - {lang for i, _, lang in rows if fold(i, 5) != 1}
    for i, text, lang in rows:
        if lang is not None and text and fold(i, 5) != 0 and (fold(i, 5) != 1 or lang in alone):
            s = ["^"] * 3 + plain_symbols(text)
            for k in range(3, len(s)):
                grams[lang][tuple(s[k - 3 : k + 1])] += 1
    symbols = {g[-1] for own in grams.values() for g in own}
    models = {}
    for lang, top in grams.items():
        orders = [top]
        while len(orders) < 4:
            orders.append(Counter(g[1:] for g in orders[-1]))
        orders.reverse()
        tables = []
        for own in orders:
            n1, n2 = (sum(v == k for v in own.values()) for k in (1, 2))
            d = n1 / (n1 + 2 * n2) if n1 and n2 else 0.5
            total, kinds = Counter(), Counter()
            for g, n in own.items():
                total[g[:-1]] += n
                kinds[g[:-1]] += 1
            tables.append((own, d, total, kinds))

        def p(g, tables=tables):
            out = 1 / (len(symbols) + 1)
            for k, (own, d, total, kinds) in enumerate(tables):
                part = g[3 - k :]
                if total[part[:-1]]:
                    out = max(own[part] - d, 0) / total[part[:-1]] + d * kinds[part[:-1]] / total[part[:-1]] * out
            return out

        models[lang] = p
    return models


def sample(rng, words, n):
    return " ".join(rng.choice(words) + rng.choice(["", "a", "en", "ти"]) for _ in range(n))


@pytest.fixture(scope="module")
def languages(spark):
    rng = random.Random(17)
    words = {k: ["".join(rng.choice(letters) for _ in range(rng.randint(2, 6))) for _ in range(40)] for k, letters in (("aa", "abcdeé"), ("bb", "bdfgüß"), ("cc", "жзикл日"))}
    rows = [(i, sample(rng, words[k], rng.randint(1, 25)), k) for i, k in enumerate(["aa", "bb", "cc"] * 40)]
    rows += [(900, None, "aa"), (901, "12 !! 3", "bb"), (902, "", "cc"), (None, "dada", "aa"), (903, "ƱƲƳ ƴƵƶ " * 30, None), (904, "Only ONE\tword-here", None), (7, rows[7][1], rows[7][2]), (905, "abc " * 20000, None), (ALONE, "qq ww ee", "one")]
    return rows, spark.createDataFrame([(*r, "x", 1.0) for r in rows], "doc_id long, text string, lang string, gram string, key double")


def test_cross_entropies_match_a_plain_version(languages):
    rows, d = languages
    models = plain_language_models([r for r in rows if r[0] is not None])
    assert set(models) == {"aa", "bb", "cc", "one"}
    got = defaultdict(list)
    for r in langid.identify(d).collect():
        got[r["doc_id"]].append(r)
    assert sum(map(len, got.values())) == len(rows)
    for i, text, _ in rows:
        s = plain_symbols(text or "")
        r = got[i][0]
        assert r["held_out"] == (i is None or fold(i, 5) == 0) and 0 <= r["score"] <= 1
        if not any(c != " " for c in s):
            assert (r["lang_pred"], r["score"], r["rejected"]) == ("und", 0.0, True)
            continue
        s = ["^"] * 3 + s
        each = {k: -sum(math.log(p(tuple(s[j - 3 : j + 1]))) for j in range(3, len(s))) / (len(s) - 3) for k, p in models.items()}
        assert r["cross_entropy"] == pytest.approx(min(each.values()), rel=1e-4) and r["lang_pred"] == min(each, key=lambda k: (round(each[k], 6), k))
    assert got[903][0]["rejected"] and len({(r["lang_pred"], r["score"]) for r in got[7]}) == 1


def test_languages_do_not_depend_on_shards(languages, monkeypatch):
    _, d = languages
    found = lambda: sorted(((r["doc_id"], r["lang_pred"], round(r["score"], 4), None if r["cross_entropy"] is None else round(r["cross_entropy"], 4), r["rejected"]) for r in langid.identify(d).collect()), key=repr)
    whole = found()
    monkeypatch.setattr(common, "SHARD", 150)
    assert found() == whole
    kept = langid.keep_known(d, langid.fit(langid.training(d)))
    assert kept.columns == d.columns and sorted(str(r["doc_id"]) for r in kept.collect()) == sorted(str(r[0]) for r in whole if not r[4])


# --- toxicity


def plain_words(text):
    out, word = [], ""
    for c in (text or "").lower() + "\n":
        own = any(a <= ord(c) <= b for a, b in toxicity.UNSPACED) and c.isalnum()
        if c.isalnum() and not own:
            word += c
            continue
        if word:
            out.append(word)
        word = ""
        if own:
            out.append(c)
    return out


class PlainModels:
    """Both class's distributions, as the module defines them, word by word."""

    def __init__(self, rows, labels):
        self.counts = [Counter(), Counter()]
        for i, text in rows:
            if i in labels and text is not None and fold(i, 4) not in (toxicity.HELD_OUT, toxicity.CALIBRATED):
                s = plain_words(text)
                self.counts[0 if labels[i] else 1].update(set(zip(["^", *s], s, strict=False)))
        self.follows = [Counter(w for _, w in c) for c in self.counts]
        self.vocabulary = sorted(self.follows[0] | self.follows[1])
        self.contexts = sorted({v for c in self.counts for v, _ in c})
        n = sum(map(len, self.counts))
        self.both = {w: (self.follows[0][w] + self.follows[1][w]) / n for w in self.vocabulary}
        self.a = sum(min(x, toxicity.DISCOUNT) for c in self.follows for x in c.values()) / n

    @staticmethod
    def kept(n):
        return max(n - toxicity.DISCOUNT, 0)

    def word(self, w, k):
        own = sum(map(self.kept, self.follows[k].values()))
        return (1 - self.a) * self.kept(self.follows[k][w]) / own + self.a * self.both[w] if own else self.both[w]

    def distribution(self, v, k):
        n = {w: self.counts[0][v, w] + self.counts[1][v, w] for w in self.vocabulary}
        seen = sum(n.values())
        b = 1 - sum(map(self.kept, n.values())) / seen if seen else 1.0
        shared = {w: (self.kept(n[w]) / seen if seen else 0.0) + b * self.both[w] for w in self.vocabulary}
        tilted = {w: shared[w] * self.word(w, k) / self.both[w] for w in self.vocabulary}
        z, own = sum(tilted.values()), sum(self.kept(self.counts[k][v, w]) for w in self.vocabulary)
        if not own:
            return {w: tilted[w] / z for w in self.vocabulary}
        return {w: (1 - b) * self.kept(self.counts[k][v, w]) / own + b * tilted[w] / z for w in self.vocabulary}


@pytest.fixture(scope="module")
def speech(spark):
    rng = random.Random(23)
    plain = ["alpha", "beta", "gamma", "delta", "omega", "zeta", "kappa", "straße", "日本"]
    rows, labels = [], {}
    for i in range(600):
        w = [rng.choice(plain) + rng.choice(["", "s", "x"]) for _ in range(rng.randint(5, 60))]
        bad = i % 5 == 0
        for _ in range(4 if bad else 0):
            # A word, words with a common start, and a pair of words that are ordinary apart.
            w.insert(rng.randrange(len(w) + 1), rng.choice(["scumbag", "numbskull" + rng.choice("abcdef"), "shut up", "馬鹿"]))
        for _ in range(2 if not bad and i % 3 == 0 else 0):
            w.insert(rng.randrange(len(w) + 1), rng.choice(["shut alpha", "beta up"]))
        rows.append((i, " ".join(w)))
        if i % 2 == 0 or bad:
            labels[i] = bad
    rows += [(1000, None), (1001, ""), (1002, "... !"), (None, "scumbag scumbag"), (3, rows[3][1]), (1003, "alpha " * 30000 + "scumbag")]
    d = spark.createDataFrame([(*r, "x", 2) for r in rows], "doc_id long, text string, gain string, key int")
    lab = spark.createDataFrame([*((i, 1, int(x)) for i, x in labels.items()), (0, 0, None), (None, 0, 1), (5, 0, 0)], "doc_id long, quality int, toxic int")
    return rows, labels, d, lab


def test_evidence_matches_a_plain_version(speech):
    rows, labels, d, lab = speech
    models, fitted = toxicity.fit(d, lab)
    plain = PlainModels(dict((i, t) for i, t in rows if i is not None).items(), labels)
    given = {v: [plain.distribution(v, k) for k in (0, 1)] for v in [*plain.contexts, "?"]}
    for both in given.values():
        assert all(sum(p.values()) == pytest.approx(1, abs=1e-9) for p in both)

    def gain(v, w):
        toxic, ordinary = given.get(v, given["?"])
        return math.log(toxic[w] / ordinary[w]) if w in toxic else 0.0

    got = {r["doc_id"]: r for r in toxicity.predict(d, models, fitted).collect()}
    margin = fitted[0]
    assert margin in toxicity.MARGINS
    for i, text in rows:
        s = plain_words(text)
        each = [gain(v, w) for v, w in zip(["^", *s], s, strict=False)]
        want = sum(math.copysign(max(abs(x) - margin, 0), x) for x in each) / max(len(each), 1)
        assert got[i]["evidence"] == pytest.approx(want, abs=1e-9)
    held = [i for i in range(600) if fold(i, 4) == 2]
    assert sum(got[i]["predicted"] == int(i % 5 == 0) for i in held) >= 0.97 * len(held)
    assert got[1000]["score"] == got[1001]["score"] == got[1002]["score"] < toxicity.THRESHOLD and got[None]["predicted"] == 1


def test_toxicity_does_not_depend_on_shards(speech, monkeypatch):
    _, _, d, lab = speech
    found = lambda: sorted(((r["doc_id"], round(r["score"], 9), r["predicted"]) for r in toxicity.rate(d, lab).collect()), key=repr)
    whole = found()
    monkeypatch.setattr(common, "SHARD", 7)
    assert found() == whole


def test_hash_arrays_find_every_key():
    rng = np.random.default_rng(4)
    keys = np.unique(rng.integers(0, 1 << 63, 5000, dtype=np.uint64) | np.uint64(1 << 63))
    keys = np.concatenate([keys, np.arange(100, dtype=np.uint64)])
    table = common.HashArray(keys, np.arange(len(keys)))
    at, there = table.find(keys)
    assert there.all() and (table.values[at] == np.arange(len(keys))).all()
    assert not table.find(np.arange(1000, 2000, dtype=np.uint64))[1].any()
    assert not common.HashArray(keys[:0], np.zeros((0, 2))).find(keys)[1].any()
