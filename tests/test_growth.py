"""Queries on larger tables: results as before, by steps whose cost grows with the input."""
import random

from pyspark.sql import functions as F

from turnloom.operators import intervals as I


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_overlaps_are_running_values_and_join_nothing(spark):
    rng = random.Random(5)
    rows = []
    for p in range(60):
        for k in range(rng.randint(1, 14)):
            s = rng.choice([rng.randint(0, 12), rng.uniform(0, 12)])
            rows.append((f"p{p}", k, rng.choice(["a", "b", "c", None]), float(s), s + rng.choice([0.15, 0.1, 0.2, 1.0, 7.0, -1.0])))
    rows.append(("p0", 99, "d", None, 4.0))
    timed = [r for r in rows if r[3] is not None and r[4] > r[3]]
    want = {a[:2] for a in timed for b in timed if a[0] == b[0] and a[1] != b[1] and a[2] != b[2] and min(a[4], b[4]) - max(a[3], b[3]) > I.OVERLAP}
    found = I.overlapping_ids(spark.createDataFrame(rows, "project_id string, turn_id int, speaker_raw string, start double, end double"))
    assert {tuple(r) for r in found.collect()} == want and 0 < len(want) < len(timed)
    assert "Join" not in plan(found) and "Generate" not in plan(found)


def test_repetitions_find_their_words_once_a_row(spark):
    import time

    from turnloom.functions import spoken
    from turnloom.functions import text as T

    rng = random.Random(6)
    texts = [None, "", "a", "a a", "um um", "um a um a", "a b c d a b c d", "Go, GO on", "x y z x y"] + [" ".join(rng.choice(["um", "a", "b", "straße", "d’or", "e"]) for _ in range(rng.randint(0, 9))) for _ in range(150)]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(texts)], "i int, t string")
    got = {r["i"]: r["r"] for r in df.select("i", T.has_repetition("t").alias("r")).collect()}

    def plain(w):
        return any(w[i : i + n] == w[i + n : i + 2 * n] and not spoken.BARE_FILLERS.issuperset(w[i : i + n]) for n in range(1, 5) for i in range(len(w) - 2 * n + 1))

    assert got == {i: plain(spoken.words(x)) for i, x in enumerate(texts)}
    long = spark.createDataFrame([(" ".join(f"w{i}" for i in range(8000)),)], "t string")
    at = time.time()
    assert long.select(T.has_repetition("t").alias("r"), T.repetition_rate("t").alias("q")).collect()[0] == (False, 0.0)
    assert time.time() - at < 20  # a search of the text for each of its words took minutes


def variants(n: int) -> tuple[str, str, str]:
    rng = random.Random(7)
    words = ["".join(rng.choice("aeiounrst") for _ in range(rng.randint(2, 8))) for _ in range(n)]
    join = " ".join
    return join(words), join(w for i, w in enumerate(words) if (i + 1) % 7), join("zzq" if (i + 1) % 5 == 0 else w for i, w in enumerate(words))


def test_blocks_of_like_texts_are_found_by_few_pieces(monkeypatch):
    from difflib import SequenceMatcher

    from turnloom.functions import blocks

    looked = []
    pairs, automaton = blocks.by_pairs, blocks.by_automaton
    monkeypatch.setattr(blocks, "by_pairs", lambda a, b: looked.append(len(a) * len(b)) or pairs(a, b))
    monkeypatch.setattr(blocks, "by_automaton", lambda a, b: looked.append(len(a) * len(b)) or automaton(a, b))
    whole, *others = variants(300)
    for other in others:
        for a, b in ((whole, other), (other, whole), (whole.split(), other.split()), (whole[200:300], whole)):
            looked.clear()
            assert blocks.matching(a, b) == [tuple(m) for m in SequenceMatcher(None, a, b, autojunk=False).get_matching_blocks()[:-1]]
            assert sum(looked) < 20 * (len(a) + len(b))


def test_blocks_do_not_depend_on_how_pieces_are_searched(monkeypatch):
    from turnloom.functions import blocks

    rng = random.Random(8)
    for _ in range(1500):
        k = rng.choice([1, 2, 3, 26])
        a = "".join(chr(97 + rng.randrange(k)) for _ in range(rng.randint(0, 90)))
        b = "".join(x for x in a if rng.random() < 0.9) if rng.random() < 0.6 else "".join(chr(97 + rng.randrange(k)) for _ in range(rng.randint(0, 90)))
        found = set()
        for single, tiny, few in ((0, 0, 12), (128, 32, 12), (128, 10**9, 0), (3, 0, 1)):
            monkeypatch.setattr(blocks, "SINGLE", single), monkeypatch.setattr(blocks, "TINY", tiny), monkeypatch.setattr(blocks, "FEW", few)
            found.add(tuple(blocks.matching(a, b)))
        assert len(found) == 1, (a, b)


def test_lists_of_structs_become_arrow_a_few_rows_at_a_time(spark, monkeypatch):
    from turnloom.functions import spoken, udf

    texts = [None, "", "Um, wan- I mean I went went"] * 300 + ["’tis"]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(texts)], "i int, t string").coalesce(1)
    got = {r["i"]: r for r in df.select("i", spoken.word_spans(F.col("t")).alias("w"), spoken.located_events(F.col("t")).alias("e")).collect()}
    for i, x in enumerate(texts):
        assert [tuple(w) for w in got[i]["w"]] == spoken.spans(x) and [tuple(e) for e in got[i]["e"]] == spoken.events(x)
    assert df.where("i < 0").select(spoken.word_spans(F.col("t"))).collect() == []
    assert 0 < udf.AT_ONCE <= 1024 and "ArrowEvalPython" in plan(df.select(spoken.word_spans(F.col("t"))))


def test_what_is_kept_of_texts_is_bounded():
    from turnloom.functions import spoken, udf

    seen = []
    count = udf.short(2)(lambda s: seen.append(s) or len(s))
    long = "x" * (udf.LONG + 1)
    assert [count("a"), count("a"), count(long), count(long)] == [1, 1, udf.LONG + 1, udf.LONG + 1] and len(seen) == 3
    assert spoken.normalized("Don’t  STOP") == "don't stop" and spoken.normalized(None) == ""


def test_intervals_take_three_cells_at_most_of_their_own_size(spark):
    rng = random.Random(9)
    many = [(0.0, 1e9), (-1e9, 1e9), (599.9, 600.0), (0.0, 0.0)] + [(s, s + rng.choice([0, 1, 500, 7000, 10**5, 10**7])) for s in (rng.uniform(-1e6, 1e6) for _ in range(60))]
    moments = sorted({x for p in many for x in p} | {rng.uniform(-2e6, 2e6) for _ in range(200)})
    t = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(many)], "i int, s double, e double").select("*", F.explode(I.sized(F.col("s"), F.col("e"))).alias("c"))
    assert max(r["count"] for r in t.groupBy("i").count().collect()) <= 3
    m = spark.createDataFrame([(x,) for x in moments], "x double").select("x", F.explode(I.sizes_at(F.col("x"))).alias("c"))
    assert sorted((r["i"], r["x"]) for r in t.join(m, "c").where("x BETWEEN s AND e").collect()) == sorted((i, x) for i, (a, b) in enumerate(many) for x in moments if a <= x <= b)
