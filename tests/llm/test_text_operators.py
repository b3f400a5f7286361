import base64
import bz2
import gzip
import hashlib
import json
import lzma
import random
import re
import zlib

import numpy as np
import pytest

from turnloom.llm import chat, chunks, decontaminate, jaccard, langid, neighbours, secrets, sentencepieces, tokenfiles, toxicity
from turnloom.llm.common import code_points

P = pytest.importorskip("public_tokenizers")
DDL = "doc_id long, text string, lang string, source string, n_chars long, doc_id2 string"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", 1, "x") for i, t in rows], DDL)


# --- secrets


def plain_spans(s):
    out = []
    for m in re.finditer(r"""((?a:(?i:password|passwd|secret|token|api_?key)))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", s):
        if len(m[2]) >= 6:
            out.append((m.start(), 0, m.end()))
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", s) if m.end() - m.start() >= 20]
    out += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", s) if m.end() - m.start() >= 24]
    return ",".join(f"{secrets.KINDS[k]}:{a}:{b}" for a, k, b in sorted(out))


def test_base_spans_match_the_plain_rule(spark):
    rng = random.Random(2)
    bits = ["password", "Token", "API_key", "ſecret", "secret", ": ", "=", "'", '"', " ", "abcdefgh", "é", "AKIA" + "A1" * 9, "AKIA", "0a" * 13, "f" * 23, "\n", "x9", "==", "a.b-c_d"]
    rows = [(i, "".join(rng.choice(bits) for _ in range(rng.randint(0, 30)))) for i in range(400)] + [(900, None), (901, ""), (901, "secret: token: abcdefgh"), (None, "é" * 70000 + " token=abcdefg")]
    got = {(r["doc_id"], r["base_sha256"]) for r in secrets.scan(docs(spark, rows)).collect()}
    assert got == {(i, hashlib.sha256(plain_spans(t or "").encode()).hexdigest()) for i, t in rows}


def test_layers_are_unwrapped_and_mapped():
    said = b"password=hunter2xyz"
    for wrapped in (
        b"password%3Dhunter2xyz", b"p\\u0061ssword\\u003dhunter2xyz", b"x " + base64.b64encode(said), b"y " + base64.b64encode(gzip.compress(said)),
        b"z " + base64.b64encode(base64.b64encode(said)), b"q " + base64.b64encode(b"password%3Dhunter2xyz").replace(b"=", b"%3D"),
    ):
        base, found, layers, _ = secrets.all_spans(wrapped, None)
        inside = [f for f in found if f[1] == 0]
        assert inside and layers > 1 and all(0 <= a < b <= len(wrapped) for a, _, b in inside), wrapped
    assert secrets.all_spans(b"100%25%25 plain %zz \\u12", None)[0] == []


def test_wide_letters_references_and_other_packers_are_unwrapped(spark):
    said = "password=hunter2xyz"
    b64, bare = base64.b64encode, zlib.compressobj(9, zlib.DEFLATED, -15)
    deflated = bare.compress(said.encode() * 3) + bare.flush()
    for wrapped in (
        b64(said.encode("utf-16-le")), b64(said.encode("utf-16-be")), b64(said.encode("utf-16")), said.encode("utf-16-le"), b64(gzip.compress(said.encode("utf-16-be"))),
        b"pass&#119;ord&#x3d;hunter2xyz", b"password&equals;hunter2xyz", b64(b"password&#61;hunter2xyz"), b"password&#37;3Dhunter2xyz",
        b64(bz2.compress(said.encode())), b64(b"head" + bz2.compress(said.encode())), b64(lzma.compress(said.encode())), b64(deflated), b64(b64(deflated)),
    ):
        base, found, _, _ = secrets.all_spans(b"x: " + wrapped + b" .", None)
        inside = [f for f in found - set(base) if f[1] == 0]
        assert inside and all(3 <= a < b <= 3 + len(wrapped) for a, _, b in inside), wrapped
    for plain in (b"AT&T; a &b; &#; &#xfffffff; R&D", b"a\0b\0", b64(bytes(range(256)))):
        assert secrets.all_spans(plain, None)[1] == set()
    rows = [(1, "a pass&#119;ord&#x3d;hunter2xyz b"), (2, "\0".join("token=abcdefgh") + "\0"), (3, "x &amp; y"), (4, b64(said.encode("utf-16-le")).decode())]
    kept = {r["doc_id"]: r["text"] for r in secrets.redact(docs(spark, rows)).collect()}
    assert kept[3] == "x &amp; y" and "hunter2xyz" not in kept[1] and "hunter" not in kept[1] and "a\0b\0c" not in kept[2] and kept[4] != rows[3][1]


def test_nested_binary_and_misaligned_layers_are_unwrapped(monkeypatch):
    said = b"password=hunter2xyz"
    pack, b64 = gzip.compress, base64.b64encode
    hexed = lambda lead, d: b"".join(lead + b"%02x" % c for c in d)
    for wrapped in (
        b64(pack(pack(said))), b64(pack(zlib.compress(said))), hexed(b"%", pack(said)), hexed(b"\\x", pack(said)), hexed(b"%", zlib.compress(said)),
        b64(pack(b"first member ") + pack(said)), b64(pack(b"a\x00b\x01 \xe9 " + said)), b64(b"\x00\xff\xe9 " + said),
        b"path/to/" + b64(said), b"key-" + b64(pack(said)), b"a_b+" + b64(said), *(b"x" * k + b64(pack(pack(said))) for k in range(1, 5)),
        b64(pack(b64(pack(b"\x00" + said)))),
    ):
        _, found, layers, _ = secrets.all_spans(wrapped, None)
        inside = [f for f in found if f[1] == 0]
        assert inside and layers > 1 and all(0 <= a < b <= len(wrapped) for a, _, b in inside), wrapped
    monkeypatch.setattr(secrets, "MAX_LAYER", 5000)
    monkeypatch.setattr(secrets, "OVERLAP", 100)
    for at in (0, 4990, 9895, 30000):
        _, found, _, cut = secrets.all_spans(b64(pack(b"." * at + said + b"." * 7000)), None)
        assert found and cut == 1, at
    assert secrets.all_spans(b"an ordinary sentence with ordinaryandratherlongwords in it", None)[1:] == (set(), 1, 0)


def test_every_place_of_a_layer_is_mapped():
    said = b"password=hunter2xyz"
    blob, packed = base64.b64encode(said), base64.b64encode(gzip.compress(b"." * 50 + said))
    for part in (blob, packed, blob.replace(b"=", b"%3D") + b"%20"):
        text = b"one " + part + b" two " + part + b"\n" + part + b" %41 \\x41 end " + part
        _, found, _, _ = secrets.all_spans(text, None)
        at = [m.start() for m in re.finditer(re.escape(part), text)]
        spans = [(a, b) for a, k, b in found if k == 0]
        assert all(any(x <= a and b <= x + len(part) for a, b in spans) for x in at), part
        assert b"hunter2" not in b"".join(x for x, *_ in [(secrets.masked(text, sorted(found), b"*"),)])
        left = secrets.masked(text, [(a, k, b) for a, k, b in found], b"*")
        assert not secrets.all_spans(left, None)[1]
    exact = b"x=" + base64.b64encode(b"abc password=hunter2xyz tail")
    assert {(a, b) for a, k, b in secrets.all_spans(exact, None)[1] if k == 0} == {(2 + 5, 2 + 31)}
    lines = base64.b64encode(b"A" * 50 + said + b"B" * 60)
    broken = b"\r\n".join(lines[i : i + 64] for i in range(0, len(lines), 64))
    inside = [f for f in secrets.all_spans(b"key\r\n" + broken, None)[1] if f[1] == 0]
    assert inside and all(5 <= a < b <= 5 + len(broken) for a, _, b in inside)
    assert secrets.all_spans(base64.b64encode(gzip.compress(b"0" * (40 << 20) + said)), None)[3] == 1  # a bomb is read to its end
    loop = b"%25" * 40 + b"41"
    assert secrets.all_spans(loop, None)[2] > 2


def test_redaction_keeps_columns_and_clean_rows(spark):
    blob = base64.b64encode(b"password=hunter2xyz").decode()
    rows = [(1, "é my password: hunter2xyz ok"), (2, "clean"), (3, None), (4, f"{blob} and {blob}")]
    got = {r["doc_id"]: r["text"] for r in secrets.redact(docs(spark, rows)).collect()}
    assert got == {1: "é my [secret] ok", 2: "clean", 3: None, 4: "[secret]== and [secret]=="}
    assert secrets.redact(docs(spark, rows)).columns == docs(spark, rows).columns


# --- benchmark search


def plain_words(s):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), s or ""))


def plain_contamination(texts, items):
    windows = {}
    for name, t in items:
        w = plain_words(t)
        n = min(10, len(w))
        for i in range(len(w) - n + 1 if n else 0):
            windows.setdefault(tuple(w[i : i + n]), set()).add(name)
    out = []
    for i, t in texts:
        w, hit, names = plain_words(t), set(), set()
        for n in {len(x) for x in windows}:
            for a in range(len(w) - n + 1):
                if tuple(w[a : a + n]) in windows:
                    hit |= set(range(a, a + n))
                    names |= windows[tuple(w[a : a + n])]
        out.append((i, len(w), len(hit), tuple(sorted(str(x) for x in names))))
    return out


def test_search_matches_brute_force(spark, monkeypatch):
    rng = random.Random(4)
    word = lambda: rng.choice(["the", "a", "Of", "é", "x1", "that", "b"])
    items = [(i, " ".join(word() for _ in range(rng.choice([1, 2, 4, 9, 10, 11, 25])))) for i in range(12)] + [(50, None), (51, "..."), (0, "repeated id here")]
    texts = [(i, " ".join(word() for _ in range(rng.randint(0, 60))) + rng.choice(["", ", "]) + (items[i % 12][1] if i % 3 else "")) for i in range(60)] + [(99, None), (99, ""), (None, items[3][1])]
    bench = spark.createDataFrame(items, "item_id long, text string")
    for most in (1 << 20, 40):
        monkeypatch.setattr(decontaminate.blocks, "__defaults__", (most,))
        got = [(r["doc_id"], r["n_words"], r["n_hit"], tuple(r["items"])) for r in decontaminate.contamination(docs(spark, texts), bench).collect()]
        assert sorted(got, key=repr) == sorted(plain_contamination(texts, items), key=repr)
    monkeypatch.undo()
    none = bench.where("item_id < 0")
    assert decontaminate.contamination(docs(spark, texts), none).where("contaminated").count() == 0
    kept = decontaminate.decontaminate(docs(spark, texts), bench)
    assert kept.columns == docs(spark, texts).columns and kept.count() == sum(not x[2] for x in plain_contamination(texts, items))


# --- token files


def test_token_files_match_the_library(spark, tmp_path, monkeypatch):
    from tokenizers import Tokenizer

    path = P.path("byte_bpe_50k.json")
    rows = [(5, "Hello  world"), (3, None), (3, ""), (9, "naïve\n\n text 12.5 <|endoftext|>"), (None, "a"), (-4, "日本 x" * 50)]
    folder = f"file://{tmp_path}/t"
    (tmp_path / "t").mkdir()
    manifest = tokenfiles.write(docs(spark, rows), path, 2, folder, added=True)
    got = sorted((r["start"], r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in tokenfiles.read(manifest, folder).collect())
    t = Tokenizer.from_file(path)
    want, at = [], 0
    for i, s in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, len(r[1] or ""))):
        ids = t.encode(s or "", add_special_tokens=False).ids + [2]
        want.append((at, i, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert got == want
    name = next(r["name"] for r in manifest.collect() if 9 in tokenfiles.open_shard(folder, r["name"]).doc_ids)
    shard = tokenfiles.open_shard(folder, name)
    assert shard.get(9)[-1] == 2 and shard.get(123456) is None
    monkeypatch.setattr(tokenfiles, "mixed", lambda keys, seed, real=tokenfiles.mixed: real(keys, seed) * np.uint64(seed != 999))  # all fingerprints agree
    assert tokenfiles.open_shard(folder, name).get(9) is None and all(shard.get(k) is None for k in range(1000, 3000))


def test_token_ids_of_added_tokens_are_the_library_s_default(spark):
    from tokenizers import Tokenizer

    path = P.path("byte_bpe_50k.json")
    rows = [(1, "a <|endoftext|> b"), (2, "plain  text"), (3, "<|endoftext|><|endoftext|>"), (4, "x<|endoftext|"), (5, "é <|endoftext|>\n 's"), (6, "<|endoftext|")]
    got = {r["doc_id"]: (r["start"], r["n_tokens"], r["ids_crc32"]) for r in tokenfiles.digest(docs(spark, rows), path, 2).collect()}
    t, at = Tokenizer.from_file(path), 0
    assert 50256 in t.encode(rows[0][1], add_special_tokens=False).ids
    for i, s in rows:
        ids = t.encode(s, add_special_tokens=False).ids + [2]
        assert got[i] == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)


def test_ids_of_all_kinds_of_gaps_match_the_libraries():
    from turnloom.llm.tokens import ByteLevel, Pieces

    rng = random.Random(21)
    bits = ["a", "Word", " ", "  ", "\n", "\t", "\u00a0", "\u0085", "\u2003", "\u3000", "\u1680", "\x1c", "\x7f", "é", "日本", "'s", "12", "!?", "𝒳", "<|endoftext|>", "▁"]
    some = ["", " ", "\n ", *("".join(rng.choice(bits) for _ in range(rng.randint(1, 30))) for _ in range(3000)), "long " * 60_000]
    for coder in (ByteLevel(P.path("byte_bpe_50k.json")), Pieces(P.path("piece_bpe_32k.model"))):
        for part in (some[:1500], some[1500:], some[:50]):
            data = [s.encode() for s in part]
            ids, ends = coder.encode(data, True) if isinstance(coder, ByteLevel) else coder.encode(data)
            got = [x.tolist() for x in np.split(ids, ends[:-1])]
            want = [coder.tokenizer.encode(s, add_special_tokens=False).ids for s in part] if isinstance(coder, ByteLevel) else coder.model.encode(part)
            assert got == want
    coder = ByteLevel(P.path("byte_bpe_50k.json"))
    ids, ends = coder.encode([s.encode() for s in some], False)
    assert [x.tolist() for x in np.split(ids, ends[:-1])] == [coder.plain.encode(s, add_special_tokens=False).ids for s in some]


def test_perfect_hash_is_minimal():
    keys = tokenfiles.key_hash(np.arange(5000), np.zeros(5000, np.int64))
    h = tokenfiles.PerfectHash.build(keys)
    assert sorted(h.slots(keys)) == list(range(5000))
    assert not len(tokenfiles.PerfectHash.build(keys[:0]).slots(keys[:0]))


# --- pieces


def test_scan_by_chunks_equals_the_library(spark, monkeypatch):
    from turnloom.llm.tokens import Pieces

    path = P.path("piece_bpe_32k.model")
    pieces = Pieces(path)
    rng = random.Random(6)
    some = ["", " ", "a  b ", "the" * 400, "a" * 700, "日本語テキスト" * 60, "".join(rng.choice("abcdeé hin \n") for _ in range(3000)), "x" + " " * 900 + "▁ ▁y", "one two " * 300]
    for s in some:
        want = pieces.model.encode(s)
        for size in (37, 500):
            assert sentencepieces.scan_text(path, s, size) == want
    rows = [(i, s) for i, s in enumerate(some)] + [(4, some[4]), (4, some[4]), (None, None), (None, some[6]), (77, "word " * 9000)]
    want = sorted((str(i), pieces.model.encode(s or "")) for i, s in rows)
    for chunk, fan in ((500, 64), (100, 4), (1, 64)):  # the last: every text, character by character
        monkeypatch.setattr(sentencepieces, "CHUNK", chunk)
        monkeypatch.setattr(sentencepieces, "FAN", fan)
        own = rows if chunk > 1 else [r for r in rows if len(r[1] or "") < 500]
        out = sentencepieces.encode(docs(spark, own), path).collect()
        assert sorted((str(r["doc_id"]), r["ids"]) for r in out) == (want if chunk > 1 else sorted((str(i), pieces.model.encode(s or "")) for i, s in own))
        assert all(r["restored"] == (r["doc_id"] != 7) and r["n_ids"] == len(r["ids"]) and r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes()) for r in out)
    ids = spark.createDataFrame([(1, pieces.model.encode("Hé  x")), (2, [None, -3, 1, 10**8, 259]), (3, None)], "doc_id long, ids array<int>")
    assert {r["doc_id"]: r["text"] for r in sentencepieces.decode(ids, path).collect()} == {1: "Hé  x", 2: " ", 3: ""}


def test_products_of_matrices_are_associative():
    rng = random.Random(13)
    states = [(i, "x") for i in range(4)]
    some = [{i: {j: rng.choice([0.0, -1.0, -2.0]) for j in rng.sample(states, 3)} for i in rng.sample(states, 3)} for _ in range(3)]
    a, b, c = some
    clean = lambda m: {i: row for i, row in m.items() if row}
    assert clean(sentencepieces.product(sentencepieces.product(a, b), c)) == clean(sentencepieces.product(a, sentencepieces.product(b, c)))


# --- chat


def test_turns_read_back(spark):
    ddl = "conv_id long, turn long, role string, text string"
    rows = [(1, 0, "user", "hi ### x </turn>\\h"), (1, 1, "assistant", None), (1, 1, "assistant", "b\n"), (2, 0, "assistant", "###"), (None, 0, "r:ole", "x"), (2, None, None, "first")]
    got = {r["conv_id"]: r for r in chat.read_back(chat.conversations(chat.from_turns(chat.with_probe(spark.createDataFrame(rows, ddl))))).collect()}
    assert set(got) == {1, 2, None, -7}
    order = {1: [("user", rows[0][3]), ("assistant", ""), ("assistant", "b\n")], 2: [("", "first"), ("assistant", "###")], None: [("r:ole", "x")]}
    for key, said in order.items():
        assert got[key]["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in said).encode()).hexdigest()
        loss = "".join(t for r, t in said if r == "assistant")
        assert (got[key]["loss_chars"], got[key]["loss_sha256"]) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert got[-7]["n_turns"] == 2


def test_best_path_of_a_tree(spark):
    rows = [("t", 1, None, 0.0, "user", "q"), ("t", 2, 1, 1.0, "assistant", "a"), ("t", 3, 1, 2.0, "assistant", "b"), ("t", 4, 2, 5.0, "user", "c"), ("t", 5, 3, 1.0, "user", "d"), ("u", 1, 1, 0.0, "user", "alone"), ("c", 1, 2, 0.0, "user", "x"), ("c", 2, 1, 0.0, "user", "y")]
    m = spark.createDataFrame(rows, "tree string, msg long, parent long, score double, role string, text string")
    got = {(r["tree"], r["leaf"]): chat.parsed(r["text"]) for r in chat.conversations(m, 2).collect()}
    assert got == {("t", 4): [("user", "q"), ("assistant", "a"), ("user", "c")], ("t", 5): [("user", "q"), ("assistant", "b"), ("user", "d")], ("u", 1): [("user", "alone")]}


def test_repeated_messages_count_once_and_long_conversations_are_whole(spark):
    ddl = "tree string, msg long, parent long, score double, role string, text string, leaf string, depth long"
    rows = [("t", 1, None, 0.0, "user", "q", "x", 1), ("t", 2, 1, 1.0, "assistant", "a", "x", 1), ("t", 2, 1, 1.0, "assistant", "a", "x", 1), ("t", 3, 2, 2.0, "user", "b", "x", 1), ("t", 3, 2, 2.0, "user", "b", "y", 2), ("t", 3, 1, 1.0, "user", "other", "x", 1)]
    rows += [("long", i, i - 1 if i else None, 0.0, "user", f"m{i}", None, None) for i in range(700)]
    got = {(r["tree"], r["leaf"]): chat.parsed(r["text"]) for r in chat.conversations(spark.createDataFrame(rows, ddl)).collect()}
    assert got == {("t", 3): [("user", "q"), ("assistant", "a"), ("user", "b")], ("long", 699): [("user", f"m{i}") for i in range(700)]}


# --- near copies, substrings


def plain_components(rows, width=3, percent=90):
    sets = {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[i] = frozenset(tuple(w[k : k + width]) for k in range(len(w) - width + 1)) if len(w) >= width else frozenset([tuple(w)] if w else [])
    root = {i: i for i in sets}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            x, y = sets[a], sets[b]
            if a < b and x and y and 100 * len(x & y) >= percent * len(x | y):
                ra, rb = top(a), top(b)
                root[max(ra, rb)] = min(ra, rb)
    return {i: (len(sets[i]), top(i)) for i in sets}


def test_jaccard_join_matches_brute_force(spark, monkeypatch):
    rng = random.Random(8)
    base = [[rng.choice("abcdefghijklmnopqrstuvwxyz") + rng.choice("xyz") for _ in range(rng.choice([2, 8, 11, 12, 40, 90]))] for _ in range(14)]
    rows = []
    for _ in range(150):
        w = list(rng.choice(base))
        for _ in range(rng.choice([0, 0, 1, 1, 2, 4])):
            w[rng.randrange(len(w))] = rng.choice(["new", "Ax", "q"])
        rows.append((len(rows), (" " if rng.random() < 0.5 else "\n").join(w).upper() if rng.random() < 0.2 else " ".join(w)))
    rows += [(500, None), (501, ""), (502, " \t ")]
    for paired, block, bits, width, percent in ((24, 1024, 20, 3, 90), (2, 8, 21, 3, 90), (2, 4, 22, 5, 80), (24, 3, 20, 2, 70)):
        monkeypatch.setattr(jaccard, "PAIRED", paired)
        monkeypatch.setattr(jaccard, "BLOCK", block)
        monkeypatch.setattr(jaccard, "LEAST_BITS", bits)
        got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.join(docs(spark, rows), width, percent).collect()}
        assert got == plain_components(rows, width, percent)


def test_representatives_keep_columns_of_any_name(spark):
    rows = [(1, "a b c d e f", 1, True, "x"), (2, "a b c d e f", 2, None, "y"), (3, "p q r s t u", 3, None, None), (3, "p q r s t u", 3, None, None)]
    d = spark.createDataFrame(rows, "doc_id long, text string, kept_ long, own_0 boolean, `a.b` string")
    out = jaccard.representatives(d)
    assert out.columns == d.columns and sorted(r["doc_id"] for r in out.collect()) == [1, 3]


def test_jaccard_join_tells_rows_without_an_id_apart(spark):
    rng = random.Random(12)
    text = lambda: [f"w{rng.randrange(10**6)}" for _ in range(60)]
    a, b, c, e, f = (text() for _ in range(5))
    near = lambda w: " ".join([*w[:-1], "other"])
    plain = " ".join
    rows = [(1, plain(a)), (None, near(a)), (None, plain(b)), (None, near(b)), (None, near(b)), (None, plain(c)), (None, None), (None, " ")]
    rows += [(7, plain(e)), (7, plain(f)), (7, None), (9, near(f)), (8, plain(e)), (8, plain(e))]
    n, key = 58, lambda r: tuple(-1 if v is None else v for v in r)
    got = sorted((key((r["doc_id"], r["component_id"], r["n_shingles"])) for r in jaccard.join(docs(spark, rows)).collect()))
    want = [(1, 1, n), (None, 1, n), *[(None, None, n)] * 4, *[(None, None, 0)] * 2, (7, 7, n), (7, 7, n), (7, 7, 0), (9, 7, n), (8, 7, n), (8, 7, n)]
    assert got == sorted(map(key, want))
    kept = [(r["doc_id"], r["text"]) for r in jaccard.representatives(docs(spark, rows)).collect()]
    assert len(kept) == 7 and {(1, plain(a)), (None, plain(c)), (None, None), (None, " "), (7, None)} < set(kept)
    assert sum(t in (plain(b), near(b)) for _, t in kept) == 1 and sum(t in (plain(e), plain(f)) for i, t in kept if i == 7) == 1


def test_passages_are_found_and_clean_texts_left(spark):
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 9)))
    text = lambda n: " ".join(word() for _ in range(n))
    shared = [text(60) for _ in range(8)]
    rows = [(i, f"{text(30)} é {shared[i % 8]} {text(30)}") for i in range(40)] + [(100 + i, text(120)) for i in range(40)] + [(200, None), (201, ""), (300, "b" * 9000)]
    got = {r["doc_id"]: r for r in chunks.by_document(docs(spark, rows)).collect()}
    assert len(set(range(40)) & set(got)) >= 39 and not set(got) - set(range(40))
    r = got[next(iter(got))]
    a, b = (int(x) for x in r["spans"].split(",")[0].split(":"))
    assert dict(rows)[r["doc_id"]][a:b] in shared[r["doc_id"] % 8]
    left = {r["doc_id"]: r["text"] for r in chunks.deduplicate(docs(spark, rows)).collect()}
    assert left[0] == dict(rows)[0] and left[100] == dict(rows)[100] and len(left[32]) < len(dict(rows)[32])


def plain_passages(rows, within, least):
    """Passages and what is left of each row, by position in `rows`."""
    cut = [[(t.encode()[a:b], len(t.encode()[:a].decode()), len(t.encode()[:b].decode())) for a, b in zip(at, at[1:], strict=False)] if (at := chunks.bounds((t or "").encode())) else [] for _, t in rows]
    places = {}
    order = sorted(range(len(rows)), key=lambda r: (rows[r][0] is None, rows[r][0] or 0, r))
    for r in order:
        for piece, a, _ in cut[r]:
            places.setdefault(piece, []).append((r, a))
    found, left = [], []
    for r, (_, t) in enumerate(rows):
        def again(piece, own=within):
            return len(places[piece]) > 1 and (own or len({x for x, _ in places[piece]}) > 1)
        runs = [[]]
        for c in cut[r]:
            if again(c[0]):
                runs[-1].append(c)
            elif runs[-1]:
                runs.append([])
        runs = [x for x in runs if sum(len(p) for p, _, _ in x) >= least]
        found.append([(x[0][1], x[-1][2]) for x in runs])
        out = t
        for p, a, b in reversed([c for x in runs for c in x]):
            if places[p][0] != (r, a):
                out = out[:a] + out[b:]
        left.append(out)
    return found, left


def test_passages_match_a_plain_version(spark):
    rng = random.Random(31)
    word = lambda: "".join(rng.choice("abcdeéfghij日") for _ in range(rng.randint(2, 9)))
    text = lambda n: " ".join(word() for _ in range(n))
    shared = [text(60) for _ in range(3)]
    rows = [(1, f"{text(40)} {shared[0]} {text(9)}"), (5, f"{shared[0]} {text(50)}"), (5, text(200)), (5, f"{text(20)}"), (None, f"{shared[1]} {text(9)}"), (None, f"{text(7)} {shared[1]}"), (None, text(90))]
    rows += [(9, f"{shared[2]} {text(30)} {shared[2]} {text(5)} {shared[2]}"), (10, None), (11, ""), (12, "tiny"), (13, text(3000)), (14, f"{text(30)} {shared[0]}")]
    found, left = plain_passages(rows, False, chunks.LEAST)
    got = sorted(((r["doc_id"], r["spans"]) for r in chunks.by_document(docs(spark, rows)).collect()), key=repr)
    assert got == sorted(((rows[r][0], ",".join(f"{a}:{b}" for a, b in x)) for r, x in enumerate(found) if x), key=repr) and [x for x, _ in got].count(None) == 2
    found, left = plain_passages(rows, True, chunks.LEAST)
    d = docs(spark, rows)
    out = chunks.deduplicate(d)
    assert out.columns == d.columns and len(found[7]) >= 1 and len(left[7]) < len(rows[7][1])
    assert sorted(((r["doc_id"], r["text"]) for r in out.collect()), key=repr) == sorted(((i, t) for (i, _), t in zip(rows, left, strict=True)), key=repr)
    # Rows that are equal in everything are copies of each other.
    twice = [(3, shared[0]), (3, shared[0]), (None, shared[1]), (None, shared[1])]
    assert len(chunks.by_document(docs(spark, twice)).collect()) == 4
    assert sorted(len(r["text"]) > 100 for r in chunks.deduplicate(docs(spark, twice)).collect()) == [False, False, True, True]


def test_chunks_resist_shifts():
    rng = random.Random(1)
    s = "".join(rng.choice("abcdefghijklmnop é") for _ in range(5000)).encode()
    a, b = chunks.bounds(s), chunks.bounds(b"shift" + s)
    assert len({x + 5 for x in a} & set(b)) > 0.9 * len(a)
    assert all(y - x <= chunks.MOST for x, y in zip(a, a[1:], strict=False)) and code_points(b"ab") is None


# --- models


def test_language_and_rejection(spark):
    rng = random.Random(3)
    said = {"aa": ["lana", "mola", "tani", "reno"], "bb": ["skrt", "vrch", "plzn", "brno"]}
    rows = [(i, " ".join(rng.choice(said[k]) for _ in range(20)), k) for i, k in enumerate(["aa", "bb"] * 60)]
    rows += [(900, None, "aa"), (901, "12 !!", None), (902, "", "bb"), (None, "lana mola", "aa"), (903, "ЖЩЮЯЪЫЭ ЙФЦХЧШ " * 40, None)]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r["doc_id"]: r for r in langid.identify(d).collect()}
    assert all(got[i]["lang_pred"] == k and 0 <= got[i]["score"] <= 1 and not got[i]["rejected"] for i, _, k in rows[:120])
    assert [got[i]["lang_pred"] for i in (900, 901, 902)] == ["und"] * 3 and got[None]["held_out"] and got[903]["rejected"]
    assert {r["doc_id"] for r in langid.keep_known(d, langid.fit(langid.training(d))).collect()} == {*range(120), None}
    nothing = d.withColumn("lang", d.lang.substr(9, 1)).where("doc_id < 0")
    assert langid.identify(nothing).count() == 0


def test_toxic_words_are_learned(spark):
    rng = random.Random(5)
    word = lambda: rng.choice(["alpha", "beta", "gamma", "delta", "omega", "zeta", "kappa"]) + rng.choice(["", "s", "x"])
    rows, labels = [], []
    for i in range(400):
        w = [word() for _ in range(60)]
        bad = i % 5 == 0
        if bad:
            for k in range(4):
                w[rng.randrange(60)] = rng.choice(["scumbag", "dolt"])
        rows.append((i, " ".join(w)))
        if i % 2 == 0 or bad:
            labels.append((i, 1, int(bad)))
    rows += [(1000, None), (1001, "")]
    lab = spark.createDataFrame([*labels, (0, 1, None), (None, 0, 1)], "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r for r in toxicity.rate(docs(spark, rows), lab).collect()}
    held = [i for i in range(400) if got[i]["held_out"]]
    assert all(got[i]["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2) for i in range(400))
    assert sum(got[i]["predicted"] == int(i % 5 == 0) for i in held) / len(held) > 0.97
    assert got[1000]["predicted"] == 0 and 0 <= got[1001]["score"] < 0.3
    assert toxicity.rate(docs(spark, rows), lab.where("toxic = 0")).where("predicted = 1").count() == 0


# --- neighbours


def test_neighbours_recall_and_cases(spark, monkeypatch):
    rng = np.random.default_rng(1)
    x = rng.standard_normal((900, 12))
    x[100:160] = x[100]  # copies
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)] + [(2000, None), (2020, [0.0] * 12), (2040, [float("nan")] + [1.0] * 11), (2060, [1.0, None] + [1.0] * 10), (None, [1.0] * 12), (3000, [1.0, 2.0]), (3020, [2.0, 1.0])]
    monkeypatch.setattr(neighbours, "CELL", 200)
    d = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {}
    for r in neighbours.search(d).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append(r["vec_id"])
    assert got.pop(3000) == [3020] and got.pop(3020) == [3000] and set(got) == set(range(0, 900, 20))
    hit = 0
    for q, found in got.items():
        s = x @ x[q]
        s[q] = -np.inf
        want = np.lexsort((np.arange(900), -s))[:20].tolist()
        assert len(found) == 20 and q not in found
        hit += len(set(found) & set(want))
    assert hit >= 0.9 * 20 * len(got)
    assert abs(neighbours.chi_square_quantile(0.95, 10) - 18.307) < 0.01


def test_neighbours_of_huge_components_and_repeated_ids(spark):
    rng = np.random.default_rng(2)
    x = rng.standard_normal((45, 4))
    x[7] = [1e200, -1e200, 1.0, 0.0]
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)] + [(20, [9.0, 9.0, 9.0, 9.0]), (20, [9.0, 9.0, 9.0, 9.0]), (3, [5.0, 5.0, 5.0, 5.0])]
    got = {}
    for r in neighbours.search(spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, embedding array<double>, key string, score int")).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    for q in (0, 20, 40):
        best = {}
        for i, a in rows:
            for j, b in rows:
                if i == q and j != q:
                    best[j] = max(best.get(j, -np.inf), float(np.dot(a, b)))
        want = sorted(best.items(), key=lambda p: (-p[1], p[0]))[:20]
        assert [j for j, _ in got[q]] == [j for j, _ in want] and np.allclose([s for _, s in got[q]], [s for _, s in want], rtol=1e-12)


def test_empty_tables(spark):
    none = docs(spark, [(1, "x")]).where("doc_id < 0")
    bench = spark.createDataFrame([], "item_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    for out in (
        secrets.scan(none), decontaminate.contamination(none, bench), toxicity.rate(none, labels), jaccard.join(none), langid.identify(none),
        chunks.by_document(none), tokenfiles.digest(none, P.path("byte_bpe_50k.json"), 2), sentencepieces.digest(none, P.path("piece_bpe_32k.model")),
        neighbours.search(spark.createDataFrame([], "vec_id long, embedding array<float>")),
    ):
        assert out.count() == 0
    assert json.dumps([r.asDict() for r in chat.read_back(chat.conversations(chat.from_turns(spark.createDataFrame([], "conv_id long, turn long, role string, text string")))).collect()]) == "[]"


def test_other_columns_of_any_name_do_no_harm(spark):
    names = ["row", "key", "digest", "node", "family", "n", "prefix", "token", "gid", "root", "k", "a", "b", "start", "end", "size", "first", "fold", "toxic", "pair", "gain", "lang", "label", "spans", "items", "words", "score", "rank", "ids", "left", "last", "text_key", "count", "salt", "block", "sets", "evidence", "held_out", "row_", "gone_", "own_0", "own_1"]
    plain = [(i, " ".join(f"w{(i // 2 * 7 + j * j) % 50}" for j in range(60))) for i in range(12)]
    d = spark.createDataFrame([(*r, *["x"] * len(names)) for r in plain], ", ".join(["doc_id long", "text string", *(f"`{c}` string" for c in names)]))
    bare = d.select("doc_id", "text", "lang")
    labels = spark.createDataFrame([(i, 1, i % 2, "x", "y") for i in range(12)], "doc_id long, quality int, toxic int, text string, fold string")
    bench = spark.createDataFrame([(1, plain[3][1], "x", "y")], "item_id long, text string, doc_id string, words string")
    piece, byte = P.path("piece_bpe_32k.model"), P.path("byte_bpe_50k.json")
    for run in (
        secrets.scan, lambda x: decontaminate.contamination(x, bench), lambda x: toxicity.rate(x, labels), jaccard.join, langid.identify, chunks.by_document,
        lambda x: tokenfiles.digest(x, byte, 2), lambda x: sentencepieces.digest(x, piece),
    ):
        assert sorted(map(repr, run(d).collect())) == sorted(map(repr, run(bare).collect()))
    for run in (secrets.redact, lambda x: decontaminate.decontaminate(x, bench), jaccard.representatives, chunks.deduplicate, lambda x: langid.keep_known(x, langid.fit(langid.training(x)))):
        assert run(d).columns == d.columns and run(d).count() > 0
    turns = spark.createDataFrame([(1, 0, "user", "hi", "x", 1), (1, 1, "assistant", "yo", "y", 2)], "conv_id long, turn long, role string, text string, tree string, depth int")
    assert chat.read_back(chat.conversations(chat.from_turns(turns))).first()["n_turns"] == 2
    near = spark.createDataFrame([(i, [float(i), 1.0], "x", 0.5, 2) for i in range(25)], "vec_id long, embedding array<double>, v string, score double, cell int")
    assert neighbours.search(near).count() == 40
