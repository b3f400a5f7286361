import hashlib
import random
import re
import zlib
from fractions import Fraction

import pytest

from turnloom.llm import articles, compaction, runs

DDL = "doc_id long, text string, lang string, source string, number long, slot long, line string"


def docs(spark, rows):
    """Rows of (doc_id, text, source), among columns whose names the operators use themselves."""
    return spark.createDataFrame([(i, t, "en", s, 1, 2, "x") for i, t, s in rows], DDL)


# --- periodic runs


def plain_runs(t, exponent, least):
    n, out = len(t), []
    for p in range(1, n // exponent + 1):
        i = 0
        while i + p < n:
            j = i
            while j + p < n and t[j] == t[j + p]:
                j += 1
            length = j - i + p
            if j > i and length >= max(least, exponent * p) and not any(all(t[x] == t[x + q] for x in range(i, i + length - q)) for q in range(1, p)):
                out.append((i, length, p))
            i = max(j, i + 1)
    return sorted(out, key=lambda x: (x[0], x[2]))


def random_words(rng, most=50):
    n, k = rng.randint(0, most), rng.randint(1, 4)
    t = [rng.randrange(k) for _ in range(n)]
    if n and rng.random() < 0.5:
        a, p = rng.randrange(n), rng.randint(1, 7)
        t = [t[i] if i < a else t[min(n - 1, a + (i - a) % p)] for i in range(n)]
    return t


def test_edges_are_next_smaller_suffixes_and_common_prefixes():
    rng = random.Random(3)
    for _ in range(1000):
        t = random_words(rng, 30)
        after, shared = runs.edges(t)
        for i in range(len(t)):
            j = next((j for j in range(i + 1, len(t)) if t[j:] < t[i:]), len(t))
            k = 0
            while j + k < len(t) and t[i + k] == t[j + k]:
                k += 1
            assert (after[i], shared[i]) == (j, k), t


@pytest.mark.parametrize(("exponent", "least"), [(2, 1), (3, 1), (4, 6)])
def test_runs_equal_all_runs_found_by_trial(exponent, least):
    rng = random.Random(4)
    many = [random_words(rng) for _ in range(800)]
    for t in many:
        assert runs.runs(t, exponent, least) == plain_runs(t, exponent, least), t
    words = [[b"%d" % x for x in t] for t in many]
    assert runs.of_texts(words, exponent, least) == [plain_runs(t, exponent, least) for t in many]


def test_long_and_nested_repetitions():
    fib = [[0], [0, 1]]
    while len(fib[-1]) < 3000:
        fib.append(fib[-1] + fib[-2])
    t = ([1] * 9 + [2]) * 8 + fib[-1][:60] * 5 + [7] * 3000
    assert runs.runs(t) == [r for r in plain_runs(t[:500], 4, 6) if r[0] + r[1] <= 380] + [(380, 3000, 1)]
    assert runs.runs(fib[-1][:700], 3, 1) == plain_runs(fib[-1][:700], 3, 1)


def plain_digest(doc_id, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n, h = len(words), zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    g = h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    found = plain_runs(words, 4, 6)
    gone = {i for s, length, q in found for i in range(s + q, s + length)}
    best = min(found, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    figures = (best[0], best[1], best[2], 1000 * best[1] // best[2]) if best else (None,) * 4
    return doc_id, len(found), *figures, sha("".join(f"{s},{m},{q}\n" for s, m, q in found)), sha(" ".join(w for i, w in enumerate(words) if i not in gone))


def test_the_query_equals_its_plain_version(spark):
    rng = random.Random(5)
    rows = [(i, " ".join(rng.choice(["a", "bé", "c c"]) for _ in range(rng.randint(0, 40))), "s") for i in range(300)]
    rows += [(7, "x " * 20, "s"), (7, "x " * 20, "s"), (None, "y\ty\ny\x0by\x0cy\ry  y", "s"), (301, None, None), (302, "", None), (303, "\x0b\n ", ""), (304, "long " + "w v " * 30_000, "s")]
    got = sorted((tuple(r) for r in runs.digest(runs.find(runs.with_repeats(docs(spark, rows)))).collect()), key=repr)
    small = [r for r in rows if r[0] != 304]
    assert [g for g in got if g[0] != 304] == sorted((plain_digest(i, t) for i, t, _ in small), key=repr)
    assert next(g for g in got if g[0] == 304)[1:5] == (1, 1, 60_000, 2)
    assert runs.digest(runs.find(runs.with_repeats(docs(spark, [])))).count() == 0


def test_collapse_keeps_rows_columns_and_other_texts(spark):
    df = docs(spark, [(1, "a  b\tstays", "s"), (2, "go go go go go go go on", "s"), (None, None, None)])
    out = runs.collapse(df)
    assert out.columns == df.columns
    assert {(r["doc_id"], r["text"], r["line"]) for r in out.collect()} == {(1, "a  b\tstays", "x"), (2, "go on", "x"), (None, None, "x")}
    with pytest.raises(ValueError, match="two periods"):
        runs.find(df, exponent=1)


# --- compaction


def test_stretches_compose_to_the_sequential_rule():
    rng = random.Random(6)
    for _ in range(1500):
        limit = rng.choice([5, 20, 100])
        files = [(i, rng.randrange(3), rng.choice([0, 0, 1, 3, 7, limit, limit + 1, 3 * limit])) for i in range(rng.randint(1, 14))]
        at = rng.randint(1, len(files))
        made = compaction.Stretch.of_files(limit, files[:at])
        if files[at:]:
            made = made.then(compaction.Stretch.of_files(limit, files[at:]))
        made = compaction.Stretch.from_row(limit, made.row())
        assert made.upto[-1] == limit + 1
        for c in range(limit + 2):
            open_, first, slot = c, -9, -9
            for number, own, live in files:
                if open_ + live > limit:
                    open_, first, slot = 0, number, own
                open_ = min(limit + 1, open_ + live)
            assert made.apply(c, -9, -9) == (open_, first, slot)


def test_groups_of_sparse_numbers_through_many_levels(spark):
    rng = random.Random(7)
    files = [(s, n, slot, rng.choice([0, 1, 5, 30, 99, 100, 101, 250])) for s in ("", "é", "z") for n in rng.sample(range(5000), 150) for slot in rng.sample(range(4), 2)]
    df = spark.createDataFrame(files, "source string, number long, slot long, live_bytes long").repartition(5)
    got = {tuple(r) for r in compaction.group_starts(df, 100, 3).collect()}
    want = set()
    for source in ("", "é", "z"):
        own = sorted((n, slot, live) for s, n, slot, live in files if s == source)
        want |= {(source, n, slot, *start) for (n, slot, _), start in zip(own, compaction.grouped(100, own, 101, 0, 0), strict=True)}
    assert got == want


def test_the_boundary_equals_the_sorted_prefix(spark):
    rng = random.Random(8)
    for k in range(6):
        rows = [(rng.randint(1, 3), rng.choice([0, 5, 5, 70_000]) if k else 0, rng.choice(["", "a", "ab", "é", "b"]), i, 1) for i in range(60)]
        queue = spark.createDataFrame(rows, "n_files long, bytes long, source string, first long, first_slot long")
        order = sorted(rows, key=lambda r: (-r[0], r[1], r[2].encode(), r[3], r[4]))
        whole, upto, kept = sum(r[1] for r in rows), 0, set()
        for r in order:
            upto += r[1]
            if 100 * upto > 30 * whole:
                break
            kept.add(r)
        assert {tuple(r) for r in queue.where(compaction.before(compaction.boundary(queue, 30))).collect()} == kept


def plain_plan(rows):
    files = {}
    for i, t, s in rows:
        h = zlib.crc32(str(i).encode()) if i is not None else 0
        block, slot = (None if i is None else i // 2000), min(h % 8, h // 8 % 8)
        gone = h // 64 % 100 < 9 * ((slot + (block or 0)) % 8)
        files.setdefault((s or "", block, slot), []).append((i, t or "", gone))
    order = lambda k: (k[0].encode(), k[1] is not None, k[1] or 0, k[2])
    size = lambda k: sum(len(t.encode()) for _, t, _ in files[k])
    live = lambda k: sum(len(t.encode()) for _, t, g in files[k] if not g)
    dirty = lambda k: 100 * sum(g for _, _, g in files[k]) >= 50 * len(files[k])
    groups, open_ = [], 0
    for k in sorted(files, key=order):
        if dirty(k) or 4 * size(k) < 3 * 131072:
            if not groups or groups[-1][0][0] != k[0] or open_ + live(k) > 131072:
                groups.append([])
                open_ = 0
            groups[-1].append(k)
            open_ += live(k)
    queue = sorted((g for g in groups if len(g) > 1 or dirty(g[0])), key=lambda g: (-len(g), sum(map(size, g)), order(g[0])))
    whole, upto, out, taken = sum(size(k) for g in queue for k in g), 0, [], set()

    def row(g, cost, wave):
        lines = sorted((i if i is not None else -1, f"{'' if i is None else i}:{t}\n".encode()) for k in g for i, t, gone in files[k] if not gone)
        return (*g[0], len(g), len(lines), sum(map(size, g)), cost, wave, hashlib.sha256(b"".join(x for _, x in lines)).hexdigest())

    for i, g in enumerate(queue):
        upto += sum(map(size, g))
        if 100 * upto > 30 * whole:
            break
        out.append(row(g, sum(map(size, g)) + sum(map(live, g)) + 4096 * len(g), i // 4))
        taken |= set(g)
    return out + [row([k], None, None) for k in files if k not in taken]


def test_the_plan_equals_its_plain_version(spark):
    rng = random.Random(9)
    rows = [(rng.randrange(30_000), "t" * rng.choice([0, 10, 3000, 40_000]) + "é", rng.choice(["hot", "hot", "b", "ü", "", None])) for _ in range(1500)]
    rows += [(5, "same", "hot"), (5, "same", "hot"), (5, "other", "hot"), (None, "x", "hot"), (None, None, None), (8, None, "b"), (-3, "below", "b"), (31, "z" * 300_000, "b")]
    got = sorted((tuple(r) for r in compaction.document_plan(docs(spark, rows)).collect()), key=repr)
    assert got == sorted(plain_plan(rows), key=repr)


@pytest.mark.parametrize("rows", [[], [(None, None, None)], [(1, "", "s"), (2, "", "s")]])
def test_plans_of_next_to_nothing(spark, rows):
    got = sorted((tuple(r) for r in compaction.document_plan(docs(spark, rows)).collect()), key=repr)
    assert got == sorted(plain_plan(rows), key=repr)


# --- main text

LONG = "A sentence of the article that goes on for quite some time, as such sentences do."
PAGES = {
    "": "", "plain  text\nonly": "plain text only", "<nav>menu <a href=x>only</a></nav>": "",
    f"<html><head><title>t</title></head><body class='has-sidebar'><div id=header><h1>Site</h1></div><div class='cookie-notice'>{LONG}</div><div id=content><h1>Big</h1><p>First &nbsp;A&#8217;s</p>"
    f"<p>Second <a href=x>with link</a> and<b>!</b>bold.</p></div><div class=sidebar><p>{LONG}</p></div><div id=comments><article><p>{LONG} {LONG}</p></article></div><div id=footer>foot</div>":
        "Big\nFirst A’s\nSecond with link and!bold.",
    "<body><div class=ad>Buy!<article><h1>T</h1><p>x<p>y</article><p>z</body>": "T\nx\ny",
    f"<div><a href=1>Home</a><a href=2>About</a></div><h1>Head</h1><p>{LONG}</p><p>{LONG}</p><ul><li><a href=3>{LONG}</a></li></ul>": f"Head\n{LONG}\n{LONG}",
    "<ARTICLE><P>Up &lt;b&gt; <IMG alt='a>b' src=x>case</P><script>if(a<b)'</p>'</script><style>p{}</style><form>f<input></form><aside>x</aside><p>second<!-- c <p> --></p></ARTICLE>": "Up <b> case\nsecond",
    f"<main><article><p>{LONG}</p><table><tr><td>1<td>2</table><ul><li>a<li>b</ul><footer>f</footer></article><section class=comments><p>{LONG}{LONG}</p></section></main>": f"{LONG}\n1\n2\na\nb",
    "<p>cut off &am": "cut off &am", "<article><p>&amp&lt;&#x41;&unknown;</p></article>": "&<A&unknown;", "<div><p>a</div></p></p>b": "a\nb",
    f"<header>top</header><aside><article><p>teaser</p></article></aside><article><p>{LONG}</p></article>": LONG,
}


@pytest.mark.parametrize(("page", "text"), PAGES.items())
def test_main_text(page, text):
    assert articles.main_text(page) == text


def test_broken_markup_takes_linear_time():
    import time

    for page in ("<b>" * 10**5, '<p class="x>' * 50_000, "<div>" * 50_000 + "x" + "</i></b>" * 50_000, "<a x='" * 30_000 + '<b y="' * 30_000, "<!--" * 30_000, "<i><b></p>" * 50_000, "<script>" * 30_000):
        began = time.time()
        articles.main_text(page)
        assert time.time() - began < 5


def test_pages_of_all_kinds_of_rows(spark):
    page = f"<article><p>{LONG}</p></article>"
    rows = [(1, "u", page), (1, "u", page), (None, None, None), (2, "v", ""), (3, "w", "<p>" + "é " * 200_000)]
    df = spark.createDataFrame([(*r, "x", 5) for r in rows], "page_id long, url string, html string, text string, n_chars long")
    got = sorted(((r["page_id"], r["url"], r["text"], r["n_chars"]) for r in articles.extract(df).collect()), key=repr)
    long = ("é " * 200_000).strip()
    assert got == sorted([(1, "u", LONG, len(LONG))] * 2 + [(None, None, "", 0), (2, "v", "", 0), (3, "w", long, len(long))], key=repr)
    assert articles.extract(df.limit(0)).count() == 0


def test_the_pages_of_the_tables(spark):
    """An independent cut by the template that the tables' pages share."""
    import html

    found = articles.extract(pages := spark.read.parquet("/root/testdata/sf0.001/pages.parquet"))
    want = set()
    for r in pages.collect():
        inner = r["html"][r["html"].index("<article>") : r["html"].index("</article>")]
        lines = (" ".join(html.unescape(re.sub(r"<[^>]*>", "", x)).split()) for x in re.split(r"</?(?:p|h1|br)>", inner))
        want.add((r["page_id"], "\n".join(x for x in lines if x)))
    assert {(r["page_id"], r["text"]) for r in found.collect()} == want
