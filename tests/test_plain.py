"""Queries that SQL cannot express, against plain versions on the smallest tables."""
import difflib
import os
import re
import unicodedata
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from turnloom import catalogue
from turnloom.functions import spoken
from turnloom.queries import base

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the tables")
CHECKED = {}


def checks(name):
    def wrap(f):
        CHECKED[name] = f
        return f

    return wrap


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.ORACLE_SQL)))
def test_matches_a_plain_version(spark, tables, name):
    rows = [r.asDict(recursive=True) for r in catalogue.QUERIES[name](spark, SF).collect()]
    assert rows
    CHECKED[name](rows, tables)


@pytest.fixture(scope="module")
def tables(spark):
    t = [r.asDict() for r in base.turns(spark, SF).collect()]
    c = [r.asDict() for r in base.table(spark, SF, "conversations").collect()]
    d = [r.asDict() for r in base.table(spark, SF, "documents").collect()]
    return {"turns": {(r["project_id"], r["turn_id"]): r for r in t}, "conversations": {(r["conv_id"], r["turn"]): r for r in c}, "documents": {r["doc_id"]: r for r in d}, "customer": [r.asDict() for r in base.table(spark, SF, "customer").collect()]}


# --- plain versions


def folded(s):
    return unicodedata.normalize("NFKC", s or "").casefold().replace("’", "'")


def plain_words(s):
    return [m[0] for m in re.finditer(r"[\w']+", folded(s))]


def md5(s):
    import hashlib

    return hashlib.md5(s.encode()).hexdigest()


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def overlap(a, b):
    x, y = Counter(a), Counter(b)
    return sum((x & y).values()) / sum((x | y).values()) if x and y else 0.0


def alike(a, b):
    x, y = " ".join(plain_words(a)), " ".join(plain_words(b))
    return 0.65 * difflib.SequenceMatcher(None, x, y, autojunk=False).ratio() + 0.35 * overlap(x.split(), y.split()) if x and y else 0.0


def by(rows, *key):
    out = defaultdict(list)
    for r in rows:
        out[tuple(r[k] for k in key)].append(r)
    return out


@checks("f2_normalize")
def _(rows, t):
    assert {r["doc_id"]: r["text_md5"] for r in rows} == {i: md5(" ".join(plain_words(d["text"]))) for i, d in t["documents"].items()}


@checks("f3_word_spans")
def _(rows, t):
    got = by(rows, "conv_id", "turn")
    for k, c in t["conversations"].items():
        want = [(m.start(), m.end()) for m in re.finditer(r"[\w'’]+", c["text"])]
        assert [(r["char_start"], r["char_end"]) for r in sorted(got.get(k, []), key=lambda r: r["char_start"])] == want
        assert all(plain_words(c["text"][r["char_start"] : r["char_end"]]) == [r["value"]] for r in got.get(k, []))


def repeats_itself(w):
    return any(w[i : i + n] == w[i + n : i + 2 * n] for i in range(len(w)) for n in range(1, 5) if i + 2 * n <= len(w) and not set(w[i : i + n]) <= {"uh", "um", "erm", "er", "ah", "eh", "hmm", "mm", "mhm"})


@checks("f10_repetitions")
def _(rows, t):
    said = {k: plain_words(c["text"]) for k, c in t["conversations"].items()}
    # Any repetition has one of a single word or of several; fillers that repeat do not count.
    assert {(r["conv_id"], r["turn"]): r["repeats"] for r in rows} == {k: repeats_itself(w) for k, w in said.items()}


@checks("f11_hesitation")
def _(rows, t):
    for r in rows:
        s = t["conversations"][r["conv_id"], r["turn"]]["text"]
        kinds = {e[0] for e in spoken.events(s)}
        assert r["hesitation_or_repetition"] == bool(kinds & {"filler", "partial_word", "repetition"})
        assert not kinds & {"self_correction"} or r["self_correction"]


@checks("f12_events")
def _(rows, t):
    for k, found in by(rows, "conv_id", "turn").items():
        s, w = t["conversations"][k]["text"], plain_words(t["conversations"][k]["text"])
        assert found == sorted(found, key=lambda e: (e["char_start"], e["char_end"], e["kind"], e["value"]))
        for e in found:
            part = s[e["char_start"] : e["char_end"]]
            if e["kind"] in ("repetition", "hebrew", "filler"):
                assert plain_words(part) == e["value"].split() == w[e["token_start"] : e["token_end"]]
            if e["kind"] == "repetition":
                n = e["token_end"] - e["token_start"]
                assert w[e["token_start"] - n : e["token_start"]] == w[e["token_start"] : e["token_end"]] and 1 <= n <= 4
            if e["kind"] == "filler":
                assert re.fullmatch(r"(?i)uh+|um+|erm+|er+|ah+|eh+|hmm+|mm+|mhm+", part)
    held = by(rows, "conv_id", "turn")
    for k, c in t["conversations"].items():
        assert any(e["kind"] == "repetition" for e in held.get(k, [])) == repeats_itself(plain_words(c["text"]))


@checks("f13_event_counts")
def _(rows, t):
    want = Counter()
    for c in t["conversations"].values():
        for e in spoken.events(c["text"]):
            want[c["role"], spoken.key(e)] += 1
    assert {(r["role"], r["event_key"]): r["n"] for r in rows} == want
    kinds = {"partial_word": "partial_word", "repetition": "repetition", "hebrew": "hebrew"}
    assert all(r["event_type"] for r in rows if r["event_key"].split(":")[0] in kinds)


@checks("f18_similarity")
def _(rows, t):
    for r in rows:
        x = t["turns"][r["project_id"], r["turn_id"]]
        assert r["similarity"] == pytest.approx(alike(x["gold"], x["cut"]), abs=1e-12)


@checks("f26_human_names")
def _(rows, t):
    assert all(r["name"] is None for r in rows) and len(rows) == len(t["customer"])  # names with a number


@checks("f32_rendered")
def _(rows, t):
    for r in rows:
        words = t["turns"][r["project_id"], r["turn_id"]]["text"].split()
        shown = r["shown"]
        assert re.sub(r"\s*\[pause \d+\.\d\ds\]\s*", " ", shown).split() == words
        assert shown.count("[pause 0.50s]") == shown.count("[pause 0.80s]") == 1
        if len(words) > 1:
            assert shown.split().index("[pause") == 1 and shown.rstrip().endswith("[pause 0.80s]")


@checks("f34_difference_spans")
def _(rows, t):
    found = by(rows, "project_id", "turn_id")
    for k, x in t["turns"].items():
        out, at = [], 0
        for s in sorted(found.get(k, []), key=lambda s: s["a_start"]):
            out += x["gold"][at : s["a_start"]].split() + x["alien"][s["b_start"] : s["b_end"]].split()
            at = s["a_end"]
        assert out + x["gold"][at:].split() == x["alien"].split()
        assert (k in found) == (x["gold"] != x["alien"])


@checks("g2_char_edits")
def _(rows, t):
    for r in rows:
        x = t["turns"][r["project_id"], r["turn_id"]]
        a, b = folded(x["gold"]), folded(x["cut"])
        assert r["reference"] == len(a) == r["substitutions"] + r["deletions"] + r["correct"]
        assert len(b) == r["substitutions"] + r["insertions"] + r["correct"]
        if not r["approximate"] and len(a) < 400:
            assert r["substitutions"] + r["deletions"] + r["insertions"] == distance(a, b)


@checks("g6_all_metrics")
def _(rows, t):
    for r in rows:
        own = [x for (p, _), x in t["turns"].items() if p == r["project_id"] and x["n"]]
        if own:
            assert r["wer"] == pytest.approx(sum(x["n"] // 7 for x in own) / sum(x["n"] for x in own))
            assert r["deletions"] == sum(x["n"] // 7 for x in own) and r["substitutions"] == r["insertions"] == 0
        for name, value in r.items():
            if name.endswith(("_accuracy", "_f1", "_precision", "_recall", "_rate", "_preservation")) and value is not None:
                assert 0 <= value <= 1, name


@checks("d1_grammar_evidence")
def _(rows, t):
    for r in rows:
        x = t["turns"][r["project_id"], r["turn_id"]]
        a, b = plain_words(x["gold"]), plain_words(x["cut"])
        assert plain_words(r["baseline_fragment"]) == a[r["baseline_token_start"] : r["baseline_token_end"]]
        assert plain_words(r["final_fragment"]) == b[r["final_token_start"] : r["final_token_end"]]
        assert plain_words(r["baseline_fragment"]) != plain_words(r["final_fragment"])


@checks("d7_evidence")
def _(rows, t):
    assert len({(r["project_id"], r["turn_id"], r["fingerprint"]) for r in rows}) == len(rows)
    assert all(re.fullmatch("[0-9a-f]{64}", r["fingerprint"]) and 1 <= r["sources"] <= 4 for r in rows)


@checks("d8_sync")
def _(rows, t):
    for own in by(rows, "project_id").values():
        n = len(own)
        assert len({(r["turn_id"], r["fingerprint"]) for r in own}) == n
        kept = sorted((r for r in own if r["state"] == "kept"), key=lambda r: r["event_id"])
        new = sorted((r for r in own if r["state"] == "new"), key=lambda r: r["event_id"])
        assert [r["event_id"] for r in kept] == list(range(2, n + 1, 2))
        last = kept[-1]["event_id"] if kept else 0
        assert [r["event_id"] for r in new] == list(range(last + 1, last + 1 + n - len(kept)))
        for part in (kept, new):  # ids go by turn
            assert [r["turn_id"] for r in part] == sorted(r["turn_id"] for r in part)
        assert all((r["reviewed"], r["decision"]) == ((True, "confirmed") if r["state"] == "kept" and r["event_id"] % 4 == 0 else (False, None)) for r in own)


def words_by_project(t):
    out = defaultdict(list)
    for (p, _), x in sorted(t["turns"].items()):
        out[p] += x["w"]
    return out


@checks("a8_align")
def _(rows, t):
    got = defaultdict(list)
    for r in sorted(rows, key=lambda r: (r["project_id"], r["turn_id"])):
        got[r["project_id"]] += r["text"].split()
    assert {p: w for p, w in got.items() if w} == {p: w for p, w in words_by_project(t).items() if w}
    same = sum(r["text"].split() == t["turns"][r["project_id"], r["turn_id"]]["w"] for r in rows)
    assert same >= 0.9 * len(rows)  # the same words, cut differently, come back to their turns


@checks("a11_align_all")
def _(rows, t):
    for c in ("zoom_text", "gold_text"):
        got = defaultdict(list)
        for r in sorted(rows, key=lambda r: (r["project_id"], r["turn_id"])):
            got[r["project_id"]] += (r[c] or "").split()
        assert {p: w for p, w in got.items() if w} == {p: w for p, w in words_by_project(t).items() if w}


@checks("a14_initial_text")
def _(rows, t):
    for r in rows:
        x = t["turns"][r["project_id"], r["turn_id"]]
        have = [s for s in (x["gold"], x["cut"], x["alien"]) if s.strip()]
        if len(have) < 2:
            assert r["text"] == "".join(have)
            continue
        mean = [sum(alike(a, b) for j, b in enumerate(have) if j != i) / (len(have) - 1) for i, a in enumerate(have)]
        plain = have[max(range(len(have)), key=lambda i: (mean[i], sum(have[i] == h for h in have), -i))]
        count = lambda s: sum(e[0] in spoken.VERBATIM for e in spoken.events(s))
        assert r["text"] == plain or (r["text"] in have and count(r["text"]) > count(plain))


def evaluated(x):
    """Texts of a turn as the queries of evaluation have them."""
    return x["alien"], x["gold"], x["cut"] if x["turn_id"] % 3 == 1 else ""


@checks("q1_features")
def _(rows, t):
    for r in rows:
        z, c, m = evaluated(t["turns"][r["project_id"], r["turn_id"]])
        have = [s for s in (z, c, m) if s.strip()]
        assert r["source_presence_ratio"] == pytest.approx(len(have) / 3)
        pairs = [(have[i], have[j]) for i in range(len(have)) for j in range(i + 1, len(have))]
        assert r["agreement"] == pytest.approx(sum(alike(*p) for p in pairs) / len(pairs) if pairs else 0.0, abs=1e-9)
        assert r["zoom_model_similarity"] == pytest.approx(alike(z, m) if z.strip() else 0.0, abs=1e-9)
        rates = [min(1.0, sum(((Counter(a.split()) - Counter(b.split())) + (Counter(b.split()) - Counter(a.split()))).values()) / max(1, len(a.split()), len(b.split()))) for a, b in pairs]
        assert r["word_disagreement_rate"] == pytest.approx(sum(rates) / len(rates) if rates else 1.0, abs=1e-9)
        assert all(0 <= v <= 1 for k, v in r.items() if k not in ("project_id", "turn_id"))


@checks("q6_score")
def _(rows, t):
    for r in rows:
        assert 0 <= r["quality_score"] <= 100 and r["quality_label"]
    assert len({r["quality_label"] for r in rows}) > 1 and {r["manual_review"] for r in rows} == {True, False}


@checks("l9_compare")
def _(rows, t):
    assert len(rows) == 4 and sum(r["selected"] for r in rows) == 1
    for r in rows:
        assert r["selection"] == pytest.approx(0.7 * r["macro_f1"] + 0.2 * r["balanced_accuracy"] + 0.1 * r["accuracy"])
        assert r["accuracy"] > 0.5 and r["selection"] <= next(x["selection"] for x in rows if x["selected"]) + 1e-12  # classes follow the features


@checks("i_resolve_speakers")
def _(rows, t):
    assert {(r["project_id"], r["turn_id"]) for r in rows} == set(t["turns"])
    # A label that names a role is never mapped away.
    assert all(r["speaker_raw"] == t["turns"][r["project_id"], r["turn_id"]]["speaker_raw"] for r in rows if t["turns"][r["project_id"], r["turn_id"]]["speaker_raw"].strip())
    assert all(r["speaker"] for r in rows)
