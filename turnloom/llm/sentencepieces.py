"""SentencePiece encoding and decoding by a max-plus scan over chunks of texts.

The model is a BPE one: a sequence of pieces is a text's encoding if and only if each two adjacent
pieces are the encoding of their own concatenation. So encoding is a best-path problem in the
max-plus semiring over states "piece that covers the last character", with weight 0 between
compatible pieces and minus infinity between others; exactly one path has weight 0.

Texts are cut into chunks of CHUNK characters anywhere, also inside pieces, and written once. Each
chunk yields, on its own, the transfer matrix from the states at its left edge to those at its right
edge. Matrices are combined by their associative product in a tree, FAN at a time, one level after
another; on the way down each node learns the states at its edges from those of its parent, so no task
holds more than FAN matrices of a text. Then each chunk is backtraced on its own from its known states.
Between the first and the last place in a chunk that no piece can cross (before a space), the matrix
has rank one, and the library gives the ids of its path. A text of one chunk has nothing to combine.

Cases: null and empty texts have no ids and decode to the empty text; ties and repeated rows give
equal rows; a null doc_id stays null; in `decode`, null ids and ids that the model lacks stand for
nothing; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import CACHES, discard, materialize, shared_dir, slices, texts
from .tokens import Pieces, loaded

#: A chunk's characters, and matrices that are combined at a time.
CHUNK = 1 << 13
FAN = 64
#: Answers that a worker's lattice keeps of each kind.
KNOWN = 100_000

NEVER = float("-inf")
SPACE = "▁"


class Lattice:
    """Paths of compatible pieces through a text."""

    def __init__(self, path: str):
        self.pieces = loaded(Pieces, path)
        self.scores, self.longest = self.pieces.scores, self.pieces.longest
        self.known: dict[tuple[str, str], bool] = {}
        self.wholes: dict[str, bool] = {}
        CACHES.extend((self.known.clear, self.wholes.clear))

    def merged(self, text: str) -> list[str]:
        """The encoding of a short text: best-scored merge first, leftmost of equals."""
        parts = list(text)
        while True:
            best, at = NEVER, -1
            for i in range(len(parts) - 1):
                score = self.scores.get(parts[i] + parts[i + 1], NEVER)
                if score > best:
                    best, at = score, i
            if at < 0:
                return parts
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def fit(self, a: str, b: str) -> bool:
        """Whether b may follow a."""
        key = a, b
        ok = self.known.get(key)
        if ok is None:
            if len(self.known) > KNOWN:
                self.known.clear()
            ok = self.known[key] = self.merged(a + b) == [a, b]
        return ok

    def whole(self, p: str) -> bool:
        """Whether a piece is its own encoding."""
        ok = self.wholes.get(p)
        if ok is None:
            if len(self.wholes) > KNOWN:
                self.wholes.clear()
            ok = self.wholes[p] = self.merged(p) == [p]
        return ok

    def starting(self, text: str, at: int) -> Iterator[str]:
        """Pieces at a place; a character that the model lacks is a piece of its own."""
        yield text[at]
        for end in range(at + 2, min(len(text), at + self.longest) + 1):
            if (p := text[at:end]) in self.scores:
                yield p

    def covering(self, text: str, cut: int) -> list[tuple[int, str]]:
        """The states at a cut: pieces (with their start) that cover the character before it."""
        out = []
        for at in range(max(0, cut - self.longest), cut):
            out += [(at, p) for p in self.starting(text, at) if at + len(p) >= cut and self.whole(p)]
        return out

    def onward(self, text: str, state: tuple[int, str] | None, start: int, stop: int) -> dict[int, tuple[int, str]]:
        """For each place at which a path from the state ends a piece, that piece (one at most).

        Pieces start before `stop`. Without a state, the path starts freely at `start`.
        """
        ends: dict[int, tuple[int, str]] = {}
        first = start if state is None else state[0] + len(state[1])
        todo = {first: None if state is None else state[1]}
        at = first
        while at < stop:
            if at in todo:
                last = todo.pop(at)
                for p in self.starting(text, at):
                    if self.whole(p) if last is None else self.fit(last, p):
                        ends[at + len(p)] = (at, p)
                        todo[at + len(p)] = p
            at += 1
        return ends


def wall_from(text: str, at: int) -> int:
    """The first place from `at` on that no piece crosses, before a space that follows something else; the length if none."""
    while (at := text.find(SPACE, at)) > 0 and text[at - 1] == SPACE:
        at += 1
    return at if at >= 0 else len(text)


def wall_to(text: str, at: int) -> int:
    """The last such place up to `at`; 0 if none."""
    while (at := text.rfind(SPACE, 0, at + 1)) > 0 and text[at - 1] == SPACE:
        at -= 1
    return max(at, 0)


class Chunk:
    """One chunk: `raw` holds the characters from `left` on; the chunk is [start, stop) in the text with its leading space."""

    def __init__(self, lattice: Lattice, raw: str, left: int, start: int, stop: int, last: bool):
        self.lattice, self.raw, self.text, self.left = lattice, raw, raw.replace(" ", SPACE), left
        self.a, self.b, self.last = start - left, stop - left, last
        first, final = wall_from(self.text, max(1, self.a + lattice.longest)), wall_to(self.text, self.b - lattice.longest)
        self.walls = (first, final) if first <= final else ()

    def shown(self, state: tuple[int, str]) -> tuple[int, str]:
        return state[0] + self.left, state[1]

    def held(self, state: tuple[int, str]) -> tuple[int, str]:
        return state[0] - self.left, state[1]

    def entries(self) -> list[tuple[int, str] | None]:
        return self.lattice.covering(self.text, self.a) if self.a + self.left else [None]

    def exits(self) -> list[tuple[int, str]]:
        found = self.lattice.covering(self.text, self.b)
        return [s for s in found if s[0] + len(s[1]) == self.b] if self.last else found

    def reached(self, ends: dict, exits: list) -> list:
        return [s for s in exits if ends.get(s[0] + len(s[1])) == s]

    def matrix(self) -> list[tuple[tuple[int, str] | None, tuple[int, str], float]]:
        """The finite entries: (state at the left edge, state at the right edge, weight)."""
        exits, out = self.exits(), []
        if self.walls:
            tail = self.reached(self.lattice.onward(self.text, None, self.walls[-1], self.b), exits)
        for state in self.entries():
            if self.walls:
                ends = self.lattice.onward(self.text, state, self.a, self.walls[0])
                to = tail if self.walls[0] in ends else []
            else:
                ends = self.lattice.onward(self.text, state, self.a, self.b)
                to = self.reached(ends, exits)
                if state is not None and state in exits:
                    to = [*to, state]
            out += [(state and self.shown(state), self.shown(x), 0.0) for x in to]
        return out

    def path(self, ends: dict, to: int, begin: int) -> list[str]:
        out = []
        while to > begin:
            at, p = ends[to]
            out.append(p)
            to = at
        return out[::-1]

    def trace(self, entry: tuple[int, str] | None, leave: tuple[int, str]) -> tuple[list[str], bytes, list[str], bytes]:
        """What comes after the entry state up to the leaving one: first pieces, the text between the walls, last pieces;
        and the whole text of these."""
        begin = 0 if entry is None else entry[0] + len(entry[1]) - self.left
        to = leave[0] + len(leave[1]) - self.left
        if entry == leave:
            return [], b"", [], b""
        entry, own = entry and self.held(entry), self.raw[begin:to].encode()
        if not self.walls:
            return self.path(self.lattice.onward(self.text, entry, self.a, self.b), to, begin), b"", [], own
        first, final = self.walls
        head = self.path(self.lattice.onward(self.text, entry, self.a, first), first, begin)
        tail = self.path(self.lattice.onward(self.text, None, final, self.b), to, final)
        return head, self.text[first:final].replace(SPACE, " ").encode(), tail, own

State = tuple[int, str] | None  # a piece with its start; None: the text's start
Matrix = dict  # {entry state: {leaving state: weight}}


def product(m: Matrix, n: Matrix) -> Matrix:
    """The max-plus product; associative."""
    out: Matrix = {}
    for i, row in m.items():
        for k, w in row.items():
            for j, v in n.get(k, {}).items():
                if w + v > out.setdefault(i, {}).get(j, NEVER):
                    out[i][j] = w + v
    return out


def as_matrix(entries) -> Matrix:
    out: Matrix = {}
    for i, j, w in entries:
        out.setdefault(i, {})[j] = w
    return out


def edges(matrices: list[Matrix], entry: State, leave: State) -> list[tuple[State, State]]:
    """For each of some matrices in a row its (entry, leaving) states on the best path from `entry` to `leave`."""
    reached: list[dict] = [{entry: 0.0}]
    for m in matrices:
        to: dict = {}
        for i, w in reached[-1].items():
            for j, v in m.get(i, {}).items():
                to[j] = max(w + v, to.get(j, NEVER))
        reached.append(to)
    out, state = [], leave
    for m, before in zip(reversed(matrices), reversed(reached[:-1]), strict=True):
        at = max((i for i in before if state in m.get(i, {})), key=lambda i: before[i] + m[i][state])
        out.append((at, state))
        state = at
    return out[::-1]


def cut(text: str, longest: int, size: int) -> Iterator[tuple[int, int, int, int, bool, str]]:
    """(index, left, start, stop, last, characters with a margin on both sides) of each chunk."""
    full = " " + text
    n = len(full)
    for k, start in enumerate(range(0, n, size)):
        stop, left = min(n, start + size), max(0, start - longest)
        yield k, left, start, stop, stop == n, full[left : stop + longest]


def traces(pieces: Pieces, found: list[tuple[list[str], bytes, list[str], bytes]]) -> tuple[list[np.ndarray], list[bool]]:
    """The ids of chunks' traces, and whether they decode to the texts of these."""
    middle, ends = pieces.spaced([m for _, m, _, _ in found])
    out, back = [], []
    for (head, _, tail, own), ids in zip(found, np.split(middle, ends[:-1]), strict=True):
        named = [np.array([i for x in part for i in ([pieces.ids[x]] if x in pieces.ids else [pieces.byte_ids[b] for b in x.encode()])], pieces.dtype) for part in (head, tail)]
        out.append(np.concatenate([named[0], ids, named[1]]))
        back.append(pieces.surface(out[-1])[0] == own)
    return out, back


def scan_text(path: str, text: str, size: int) -> list[int]:
    """The whole scan of one text in one place (for tests)."""
    if not text:
        return []
    lattice = loaded(Lattice, path)
    chunks = [Chunk(lattice, t, left, a, b, last) for _, left, a, b, last, t in cut(text, lattice.longest, size)]
    tables = [as_matrix(c.matrix()) for c in chunks]
    whole = tables[0]
    for m in tables[1:]:
        whole = product(whole, m)
    (leave,) = whole[None]
    return np.concatenate(traces(lattice.pieces, [c.trace(*e) for c, e in zip(chunks, edges(tables, None, leave), strict=True)])[0]).tolist()


CHUNK_SCHEMA = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("k", pa.int64()), ("left", pa.int64()), ("a", pa.int64()), ("b", pa.int64()), ("last", pa.bool_()), ("text", pa.string())])
STATE = pa.struct([("s", pa.int64()), ("p", pa.string())])
MATRICES = pa.list_(pa.struct([("i", STATE), ("j", STATE), ("w", pa.float64())]))
MATRIX = "array<struct<i: struct<s: long, p: string>, j: struct<s: long, p: string>, w: double>>"


def chunked(path: str, docs: DataFrame) -> DataFrame:
    """All chunks of (doc_id, text); `row` tells rows apart, so this is written before it is used."""
    size = CHUNK

    def step(batches):
        longest, row = loaded(Pieces, path).longest, TaskContext.get().partitionId() << 40
        for batch in slices(batches):
            found = []
            for doc_id, doc in zip(batch.column(0).to_pylist(), texts(batch.column(1)), strict=True):
                found += [(row, doc_id, *c) for c in cut(doc.decode(), longest, size)]
                row += 1
            columns = zip(*found, strict=True) if found else [[] for _ in CHUNK_SCHEMA]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, CHUNK_SCHEMA, strict=True)], schema=CHUNK_SCHEMA)

    return docs.mapInArrow(step, "row long, doc_id long, k long, left long, a long, b long, last boolean, text string")


def chunk_of(path: str, r: dict) -> Chunk:
    return Chunk(loaded(Lattice, path), r["text"], r["left"], r["a"], r["b"], r["last"])


def shown_state(x: State) -> dict | None:
    return None if x is None else {"s": x[0], "p": x[1]}


def held_state(x: dict | None) -> State:
    return None if x is None else (int(x["s"]), x["p"])


def shown_matrix(m: Matrix) -> list[dict]:
    return [{"i": shown_state(i), "j": shown_state(j), "w": w} for i, row in m.items() for j, w in row.items()]


def held_matrix(entries) -> Matrix:
    return as_matrix((held_state(e["i"]), held_state(e["j"]), e["w"]) for e in entries)


def transfer(path: str, chunks: DataFrame) -> DataFrame:
    """(row, k, m): each chunk's transfer matrix."""
    def step(batches):
        for batch in slices(batches):
            rows = batch.to_pylist()
            found = [shown_matrix(as_matrix(chunk_of(path, r).matrix())) for r in rows]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(found, MATRICES)], names=["row", "k", "m"])

    return chunks.mapInArrow(step, f"row long, k long, m {MATRIX}")


def combined(matrices: DataFrame) -> DataFrame:
    """(row, k, m) of the next level: products of FAN neighbours."""

    def step(batches):
        for batch in batches:
            found = []
            for own in batch.column(2).to_pylist():
                tables = [held_matrix(x["m"]) for x in sorted(own, key=lambda x: x["k"])]
                whole = tables[0]
                for m in tables[1:]:
                    whole = product(whole, m)
                found.append(shown_matrix(whole))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, MATRICES)], names=["row", "k", "m"])

    own = matrices.groupBy("row", F.expr(f"k div {FAN}").alias("up")).agg(F.collect_list(F.struct("k", "m")).alias("own"))
    return own.mapInArrow(step, f"row long, k long, m {MATRIX}")


def parted(matrices: DataFrame, parents: DataFrame) -> DataFrame:
    """(row, k, entry, leave) of a level, from its matrices and the edges of the level above."""

    def step(batches):
        for batch in batches:
            rows, places, entry, leave = [], [], [], []
            for r in batch.to_pylist():
                own = sorted(r["own"], key=lambda x: x["k"])
                found = edges([held_matrix(x["m"]) for x in own], held_state(r["entry"]), held_state(r["leave"]))
                rows += [r["row"]] * len(own)
                places += [x["k"] for x in own]
                entry += [shown_state(i) for i, _ in found]
                leave += [shown_state(j) for _, j in found]
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.int64()), pa.array(places, pa.int64()), pa.array(entry, STATE), pa.array(leave, STATE)], names=["row", "k", "entry", "leave"])

    own = matrices.groupBy("row", F.expr(f"k div {FAN}").alias("up")).agg(F.collect_list(F.struct("k", "m")).alias("own"))
    both = own.join(parents.withColumnRenamed("k", "up").hint("merge"), ["row", "up"]).select("row", "own", "entry", "leave")
    return both.mapInArrow(step, "row long, k long, entry struct<s: long, p: string>, leave struct<s: long, p: string>")


def chosen_edges(matrices: DataFrame, folder: str) -> DataFrame:
    """Each chunk's states on its text's one path: up the tree by products, and down again."""
    levels = [matrices]
    while (levels[-1].agg(F.max("k")).first()[0] or 0) > 0:  # a level for each power of FAN
        levels.append(materialize(combined(levels[-1]), f"level{len(levels)}", folder))
    found = levels.pop().select("row", "k", F.expr("m[0].i").alias("entry"), F.expr("m[0].j").alias("leave"))
    while levels:
        found = materialize(parted(levels.pop(), found), f"edges{len(levels)}", folder)
    discard(matrices.sparkSession, folder, "chunks", "matrices", "edges0")
    return found


def traced(path: str, chunks: DataFrame) -> DataFrame:
    """(row, doc_id, k, ids, restored) of chunks with their states."""

    def step(batches):
        pieces = loaded(Pieces, path)
        for batch in slices(batches):
            rows = batch.to_pylist()
            ids, back = traces(pieces, [chunk_of(path, r).trace(held_state(r["entry"]), held_state(r["leave"])) for r in rows])
            kept = {n: batch.column(batch.schema.get_field_index(n)) for n in ("row", "doc_id", "k")}
            yield pa.RecordBatch.from_pydict({**kept, "ids": pa.array([x.tobytes() for x in ids], pa.binary()), "restored": pa.array(back, pa.bool_())})

    return chunks.mapInArrow(step, "row long, doc_id long, k long, ids binary, restored boolean")


def result(doc_ids: pa.Array, ids: np.ndarray, ends: np.ndarray, restored: list[bool], with_ids: bool) -> pa.RecordBatch:
    """Rows of the result, from all texts' ids in a row and where each text's end."""
    raw = memoryview(ids.astype("<u4").tobytes())
    bounds = np.concatenate([[0], ends]).tolist()
    crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(bounds, bounds[1:])]  # noqa: B905
    out = {"doc_id": doc_ids, "n_ids": pa.array(np.diff(bounds)), "ids_crc32": pa.array(crc, pa.int64()), "restored": pa.array(restored, pa.bool_())}
    if with_ids:
        out["ids"] = pa.ListArray.from_arrays(pa.array(np.array(bounds, np.int32)), pa.array(ids.astype(np.int32)))
    return pa.RecordBatch.from_pydict(out)


def encoded(docs: DataFrame, path: str, with_ids: bool) -> DataFrame:
    folder = shared_dir(docs.sparkSession)
    schema = "doc_id long, n_ids long, ids_crc32 long, restored boolean" + ", ids array<int>" * with_ids
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))

    def alone(batches):
        pieces = loaded(Pieces, path)
        for batch in slices(batches, most=6 << 20):
            data = texts(batch.column(1))
            ids, ends = pieces.encode(data)
            said, id_ends = pieces.surface(ids)
            to = np.concatenate([[0], id_ends])[ends].tolist()
            yield result(batch.column(0), ids, ends, [said[a + 1 : b] == d for a, b, d in zip([0, *to], to, data, strict=False)], with_ids)

    def together(batches):
        kind = loaded(Pieces, path).dtype
        for batch in (b.slice(i, 64) for b in batches for i in range(0, b.num_rows, 64)):
            data = [np.frombuffer(b"".join(p["ids"] for p in parts), kind) for parts in batch.column(1).to_pylist()]
            yield result(batch.column(0), np.concatenate(data), np.cumsum([len(x) for x in data]), batch.column(2).to_pylist(), with_ids)

    small = docs.where(F.length("text") < CHUNK).mapInArrow(alone, schema)  # with the leading space one chunk
    chunks = materialize(chunked(path, docs.where(F.length("text") >= CHUNK)), "chunks", folder, "zstd")
    states = chosen_edges(materialize(transfer(path, chunks), "matrices", folder), folder)
    # States grow with the corpus and are not broadcast, however few they are here.
    parts = traced(path, chunks.join(states.hint("merge"), ["row", "k"]))
    texts_ = parts.groupBy("row").agg(F.first("doc_id").alias("doc_id"), F.sort_array(F.collect_list(F.struct("k", "ids"))).alias("parts"), F.min("restored").alias("restored"))
    return small.unionByName(texts_.select("doc_id", "parts", "restored").mapInArrow(together, schema))


def encode(docs: DataFrame, path: str) -> DataFrame:
    """Per row of (doc_id, text): ids array<int>, their number and crc32, whether they decode to the text."""
    return encoded(docs, path, True)


def digest(docs: DataFrame, path: str) -> DataFrame:
    """As encode, without the ids."""
    return encoded(docs, path, False)


def decode(rows: DataFrame, path: str) -> DataFrame:
    """(doc_id, text) of rows of (doc_id, ids); null ids give the empty text."""

    def step(batches):
        pieces = loaded(Pieces, path)
        for batch in batches:
            out = []
            for ids in batch.column(1).to_pylist():
                known = np.array([i for i in ids or [] if i is not None and 0 <= i < len(pieces.surface_sizes)], np.int64)
                out.append(pieces.decode(known).decode("utf-8", "replace"))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], names=["doc_id", "text"])

    return rows.select(F.col("doc_id").cast("long").alias("doc_id"), "ids").mapInArrow(step, "doc_id long, text string")
