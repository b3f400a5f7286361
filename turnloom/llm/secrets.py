"""Secret scans: a recursive decoding worklist over every whole text.

Each text is a first layer. A layer is scanned for three kinds of secret, then everything in it
that is encoded (percent escapes, backslash escapes, character references, letters of two bytes in either order,
base64 at any alignment, gzip, zlib, bz2 or xz data at any place, of any number of members where gzip, and layers that
are bare deflate data) is unwrapped into further layers, binary ones too, until none
yields a new one. A layer whose digest has been seen at the same place of this text ends there, so cycles
end, while copies at other places are all read. Every layer knows how its places map to those of the layer
that held it, so that what is found in it points at the original text.

Cases: null text is empty and has no span; an empty table gives an empty result; repeated rows
give repeated rows; a null doc_id stays null; other columns of the input are not read by `scan`
and pass unchanged through `redact`. Decompressed data of over MAX_LAYER bytes is read whole, in
windows that overlap, which bounds memory; `n_cut` counts it, as what is encoded in it across two
windows is read in parts.
"""

from __future__ import annotations

import binascii
import bz2
import hashlib
import html
import lzma
import re
import zlib
from bisect import bisect_right
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import code_points, slices, texts

# The kinds in their order, their patterns and least lengths.
KINDS = ("assign", "access", "hex")
ASSIGN = re.compile(rb"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I)
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
HEX = re.compile(rb"[0-9a-f]{24,}")
ASSIGN_LEAST, ACCESS_LEAST = 6, 20

#: Bytes of decompressed data that are read at a time, and those that two such windows share.
MAX_LAYER, OVERLAP = 16 << 20, 1 << 20
#: Bytes of compressed data that are fed at a time.
PIECE = 1 << 16
#: Shortest base64 run that is tried.
BASE64_LEAST = 16

PERCENT = re.compile(rb"(?:%[0-9A-Fa-f]{2})+")
UNICODE = re.compile(rb"\\u\{([0-9A-Fa-f]{1,6})\}|\\u([0-9A-Fa-f]{4})|\\U([0-9A-Fa-f]{8})|\\x([0-9A-Fa-f]{2})")
BASE64 = re.compile(rb"[A-Za-z0-9+/]{16,}={0,2}")
BASE64_URL = re.compile(rb"[A-Za-z0-9_-]{16,}={0,2}")
GZIP = b"\x1f\x8b"
PACKED = re.compile(rb"\x1f\x8b\x08|\x78[\x01\x5e\x9c\xda]")
RUN_TABLE = np.zeros(256, bool)
RUN_TABLE[list(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-")] = True
CONTROL = re.compile(rb"[\x00-\x08\x0e-\x1f\x7f]")

SCHEMA = (
    "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, "
    "n_spans long, n_layers long, n_cut long"
)


def base_spans(data: bytes) -> list[tuple[int, int, int]]:
    """(start, kind, end) in bytes of one layer, in the order of the result."""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(data) if m.end(2) - m.start(2) >= ASSIGN_LEAST]
    found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(data) if m.end() - m.start() >= ACCESS_LEAST]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(data)]
    return sorted(found)



#: Character references; letters of two bytes each; where bz2 and xz data starts.
ENTITY = re.compile(rb"&(?:#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]{1,30});")
WIDE_LITTLE, WIDE_BIG = re.compile(rb"(?:[\x09-\x7e]\0){6,}"), re.compile(rb"(?:\0[\x09-\x7e]){6,}")
OTHER_PACKED = re.compile(rb"BZh[1-9]1AY&SY|\xfd7zXZ\0")


class Layer:
    """Bytes, and how their places map to the layer that they were unwrapped from (none: the original text)."""

    __slots__ = ("data", "parent", "up")

    def __init__(self, data: bytes, parent: Layer | None = None, up: Callable[[int, int], tuple[int, int]] | None = None):
        self.data, self.parent, self.up = data, parent, up

    def origin(self, a: int, b: int) -> tuple[int, int]:
        """The original span that this layer's bytes a to b come from."""
        layer = self
        while layer.parent is not None:
            a, b = layer.up(a, b)
            layer = layer.parent
        return a, b

    def rewritten(self, edits: list[tuple[int, int, bytes, int]]) -> Layer:
        """With (from, to, new bytes, old bytes for each new one or 0) applied."""
        parts, at, size = [], 0, 0
        news, olds = [], []  # where each edit's new and old bytes start
        for a, b, new, _ in edits:
            parts += [self.data[at:a], new]
            news.append(size + a - at)
            olds.append(a)
            size = news[-1] + len(new)
            at = b
        parts.append(self.data[at:])

        def old(place: int, last: bool) -> int:
            """Where the old bytes for a new one start, or end."""
            k = bisect_right(news, place) - 1
            if k < 0:
                return place + last
            a, b, new, step = edits[k]
            inside = place - news[k]
            if inside >= len(new):
                return b + inside - len(new) + last
            if not step:
                return b if last else a
            return a + (inside + last) * step

        return Layer(b"".join(parts), self, lambda a, b: (old(a, False), old(b - 1, True)) if b > a else (old(a, False),) * 2)

    def whole(self, a: int, b: int, data: bytes) -> Layer:
        """Data each of whose bytes comes from this layer's bytes a to b together."""
        return Layer(data, self, lambda _a, _b: (a, b))

    def unbased(self, places: list[tuple[int, int]], data: bytes) -> Layer:
        """Data whose base64 letters are those at some places in a row."""
        starts = [0]
        for a, b in places:
            starts.append(starts[-1] + b - a)

        def letter(i: int) -> int:
            k = min(bisect_right(starts, i) - 1, len(places) - 1)
            return min(places[k][0] + i - starts[k], places[k][1] - 1)

        return Layer(data, self, lambda a, b: (letter(a // 3 * 4 + a % 3), letter((b - 1) // 3 * 4 + (b - 1) % 3 + 1) + 1))


def inflated(data: bytes, at: int) -> Iterator[tuple[bytes, bool, int]]:
    """What gzip or zlib data at a place holds, all its members in a row, in windows of MAX_LAYER bytes
    that share OVERLAP; whether it is of two windows or more (told once), and where its last whole member ends.

    What precedes an error or the end of cut data counts.
    """
    held, end, windows = bytearray(), 0, 0
    unpack = zlib.decompressobj(47)
    try:
        while at < len(data):
            rest = data[at : at + PIECE]
            at += len(rest)
            while rest and not unpack.eof:
                held += unpack.decompress(rest, MAX_LAYER - len(held))
                rest = unpack.unconsumed_tail
                if len(held) >= MAX_LAYER:
                    windows += 1
                    yield bytes(held), windows == 2, end
                    del held[:-OVERLAP]
            if unpack.eof:
                end = at = at - len(unpack.unused_data)
                if data[at : at + 2] != GZIP:
                    break
                unpack = zlib.decompressobj(47)
    except zlib.error:
        pass
    if held and (not windows or len(held) > OVERLAP):
        yield bytes(held), windows == 1, end


def readable(data: bytes) -> bool:
    try:
        data.decode()
    except UnicodeDecodeError:
        return False
    return bool(data) and not CONTROL.search(data)


def compressed_layers(layer: Layer) -> Iterator[tuple[Layer, bool, bool]]:
    """What gzip or zlib data anywhere in the layer holds."""
    done = 0
    for m in PACKED.finditer(layer.data):
        if m.start() < done:
            continue
        for data, cut, end in inflated(layer.data, m.start()):
            done = max(done, end)
            yield layer.whole(m.start(), end or len(layer.data), data), cut, end > 0 or readable(data)


def streamed(unpack, data: bytes, at: int) -> Iterator[tuple[bytes, bool, bool]]:
    """What a decompressor of bz2, xz or bare deflate data makes of it, in windows as above; whether it is of two or more, and whether it came to its end."""
    held, windows, n = bytearray(), 0, len(data)
    try:
        while not unpack.eof and (at < n or not getattr(unpack, "needs_input", True)):
            rest = data[at : at + PIECE]
            at += len(rest)
            while True:
                held += unpack.decompress(rest, MAX_LAYER - len(held))
                rest = getattr(unpack, "unconsumed_tail", b"")
                if len(held) >= MAX_LAYER:
                    windows += 1
                    yield bytes(held), windows == 2, False
                    del held[:-OVERLAP]
                if unpack.eof or not (rest or not getattr(unpack, "needs_input", True)):
                    break
    except (zlib.error, OSError, EOFError, lzma.LZMAError):
        pass
    if held and (not windows or len(held) > OVERLAP):
        yield bytes(held), windows == 1, unpack.eof


def other_packed_layers(layer: Layer) -> Iterator[tuple[Layer, bool, bool]]:
    """What bz2 and xz data anywhere in the layer holds, and the layer as a whole if it is bare deflate data."""
    for m in OTHER_PACKED.finditer(layer.data):
        for data, cut, ended in streamed(bz2.BZ2Decompressor() if m[0][:1] == b"B" else lzma.LZMADecompressor(memlimit=1 << 26), layer.data, m.start()):
            yield layer.whole(m.start(), len(layer.data), data), cut, ended or readable(data)
    if layer.data[:1] and layer.data[0] & 6 != 6:  # a block of a known kind
        for data, cut, ended in streamed(zlib.decompressobj(-15), layer.data, 0):
            if len(data) >= BASE64_LEAST // 2:
                yield layer.whole(0, len(layer.data), data), cut, ended and readable(data)


def base64_runs(data: bytes) -> list[tuple[int, int]]:
    """The maximal runs of either base64 alphabet."""
    return sorted({m.span() for pattern in (BASE64, BASE64_URL) for m in pattern.finditer(data)})


def wrapped(data: bytes, runs: list[tuple[int, int]]) -> Iterator[list[tuple[int, int]]]:
    """Runs that are the lines of one, all but the last of the same length."""
    i = 0
    while i < len(runs):
        k = i
        size = runs[i][1] - runs[i][0]
        while k + 1 < len(runs) and data[runs[k][1] - 1] != 0x3D and runs[k][1] - runs[k][0] == size and runs[k + 1][1] - runs[k + 1][0] <= size and data[runs[k][1] : runs[k + 1][0]] in (b"\n", b"\r\n"):
            k += 1
        if k > i:
            yield runs[i : k + 1]
        i = k + 1


def base64_layers(layer: Layer, runs: list[tuple[int, int]] | None) -> Iterator[tuple[Layer, bool, bool]]:
    """What base64 runs hold, each alone and lines of one together, read from each of their first four letters,
    as data may follow other letters."""
    data = layer.data
    runs = base64_runs(data) if runs is None else runs
    for places in [*([r] for r in runs), *wrapped(data, runs)]:
        run = b"".join(data[a:b] for a, b in places).rstrip(b"=").replace(b"-", b"+").replace(b"_", b"/")
        for k in range(4):
            part = run[k : len(run) - ((len(run) - k) % 4 == 1)]
            if len(part) < BASE64_LEAST - 3:
                break
            raw = binascii.a2b_base64(part + b"=" * (-len(part) % 4))
            (a, b), *others = places
            yield layer.unbased([(a + k, b), *others], raw), False, readable(raw)


def unwrapped(layer: Layer, runs: list[tuple[int, int]] | None = None) -> Iterator[tuple[Layer, bool, bool]]:
    """All that is encoded in a layer, whether it is longer than a layer may be, and whether it is surely no chance."""
    if b"%" in layer.data:
        edits = []
        for m in PERCENT.finditer(layer.data):
            edits.append((m.start(), m.end(), bytes.fromhex(m[0].replace(b"%", b"").decode()), 3))
        if edits:
            yield layer.rewritten(edits), False, True
    if b"\\" in layer.data:
        edits, raw = [], []
        for m in UNICODE.finditer(layer.data):
            code = int(m[1] or m[2] or m[3] or m[4], 16)
            if code <= 0x10FFFF:
                edits.append((m.start(), m.end(), chr(code).encode("utf-8", "replace"), 0))
                raw.append((*edits[-1][:2], bytes([code]) if m[4] else edits[-1][2], 0))
        if edits:
            yield layer.rewritten(edits), False, True
        if raw != edits:  # \\x may stand for a byte as well as for a character
            yield layer.rewritten(raw), False, True
    if b"&" in layer.data:
        edits = []
        for m in ENTITY.finditer(layer.data):
            new = html.unescape(m[0].decode()).encode("utf-8", "replace")
            if new != m[0]:
                edits.append((*m.span(), new, 0))
        if edits:
            yield layer.rewritten(edits), False, True
    if b"\0" in layer.data:  # text of two bytes a letter, in either order
        for pattern, first in ((WIDE_LITTLE, 0), (WIDE_BIG, 1)):
            edits = [(*m.span(), m[0][first::2], 2) for m in pattern.finditer(layer.data)]
            if edits:
                yield layer.rewritten(edits), False, True
    if layer.parent is not None:  # the original is UTF-8, which compressed data is not
        yield from compressed_layers(layer)
        yield from other_packed_layers(layer)
    yield from base64_layers(layer, runs)


def all_spans(data: bytes, runs: list[tuple[int, int]] | None = None) -> tuple[list, set, int, int]:
    """Base spans, all spans as (start, kind, end) in the original's bytes, layers, layers cut.

    Every decoded byte string is scanned and unwrapped further; those that may be chance (letters that
    happen to be base64) count as layers only if something is found in them.
    """
    base = base_spans(data)
    found, seen, n_layers, n_cut = set(base), {(hashlib.blake2b(data, digest_size=16).digest(), (0, len(data)))}, 1, 0
    work = [unwrapped(Layer(data), runs)]  # innermost last, so that one window of each is held
    while work:
        step = next(work[-1], None)
        if step is None:
            work.pop()
            continue
        new, cut, sure = step
        n_cut += cut
        # Equal data from another place is another layer; equal data from the same place is a cycle, or known.
        key = hashlib.blake2b(new.data, digest_size=16).digest(), new.origin(0, len(new.data))
        if key in seen:
            continue
        seen.add(key)
        spans = base_spans(new.data)
        for a, kind, b in spans:
            s, e = new.origin(a, b)
            found.add((s, kind, e))
        n_layers += bool(sure or spans)
        work.append(unwrapped(new))
    return base, found, n_layers, n_cut


def encoded_runs(docs: list[bytes]) -> list[list[tuple[int, int]]]:
    """For each text its maximal runs of base64 letters that are long enough."""
    out: list[list[tuple[int, int]]] = [[] for _ in docs]
    whole = b"\n".join(docs)
    hit = np.empty(len(whole) + 2, bool)
    hit[0] = hit[-1] = False
    np.take(RUN_TABLE, np.frombuffer(whole, np.uint8), out=hit[1:-1])
    edges = np.flatnonzero(hit[1:] != hit[:-1])
    starts, ends = edges[::2], edges[1::2]
    keep = ends - starts >= BASE64_LEAST
    starts, ends = starts[keep], ends[keep]
    offsets = np.cumsum([0] + [len(d) + 1 for d in docs])
    for i, a, b in zip((np.searchsorted(offsets, starts, side="right") - 1).tolist(), starts.tolist(), ends.tolist(), strict=True):
        out[i].append((a - int(offsets[i]), b - int(offsets[i])))
    return out


def mixed(docs: list[bytes], runs: list[list[tuple[int, int]]]) -> list[list[tuple[int, int]]]:
    """Splits runs that hold letters of both base64 alphabets into the runs of each."""
    for doc, own in zip(docs, runs, strict=True):
        for k in range(len(own) - 1, -1, -1):
            a, b = own[k]
            part = doc[a:b]
            if (b"-" in part or b"_" in part) and (b"+" in part or b"/" in part):
                own[k : k + 1] = [(a + x, a + y) for x, y in base64_runs(part)]
    return runs


def shown(spans, points: np.ndarray | None) -> str:
    if points is None:
        return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)
    return ",".join(f"{KINDS[k]}:{points[a]}:{points[b]}" for a, k, b in spans)


def suspects(array: pa.Array) -> np.ndarray:
    """Rows in which a span or an escape is possible; all others have at most base64 runs."""
    marks = [
        pc.match_substring_regex(array, r"""(?i)(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]"""),
        pc.match_substring(array, "AKIA"),
        pc.match_substring_regex(array, "[0-9a-f]{24}"),
        pc.match_substring_regex(array, r"%[0-9A-Fa-f]{2}|\\[uUx]|&#?[A-Za-z0-9]{1,31};|\x00"),
    ]
    out = marks[0]
    for m in marks[1:]:
        out = pc.or_(out, m)
    return pc.fill_null(out, False).to_numpy(zero_copy_only=False)


NOTHING = hashlib.sha256(b"").hexdigest()


def found_in(batch: pa.RecordBatch) -> Iterator[tuple[int, bytes, list, list, int, int]]:
    """(row, text, base spans, all spans, layers, layers cut) of rows that have more than one layer or any span."""
    array = batch.column(batch.schema.get_field_index("text"))
    docs = texts(array)
    runs = mixed(docs, encoded_runs(docs))
    may = suspects(array)
    for i, doc in enumerate(docs):
        if not may[i] and not runs[i]:
            continue
        base, found, layers, cut = all_spans(doc, runs[i])
        if found or layers > 1:
            yield i, doc, base, sorted(found), layers, cut


def scan_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        n = batch.num_rows
        counts = np.zeros((5, n), np.int64)
        layers = np.ones(n, np.int64)
        digest, spans = [NOTHING] * n, [""] * n
        for i, doc, base, found, n_layers, cut in found_in(batch):
            points = code_points(doc)
            for _, k, _ in base:
                counts[k, i] += 1
            counts[3, i], counts[4, i], layers[i] = len(found), cut, n_layers
            digest[i] = hashlib.sha256(shown(base, points).encode()).hexdigest()
            spans[i] = shown(found, points)
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), *map(pa.array, counts[:3]), pa.array(digest), pa.array(spans), pa.array(counts[3]), pa.array(layers), pa.array(counts[4])],
            names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_spans", "n_layers", "n_cut"],
        )


def scan(docs: DataFrame) -> DataFrame:
    """Per row of (doc_id, text): counts of base spans, their digest, and all spans in code points."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(scan_batches, SCHEMA)


def masked(doc: bytes, spans: list[tuple[int, int, int]], mask: bytes) -> bytes:
    """The text with every span's characters replaced; overlapping spans count as one."""
    out, at, end = [], 0, -1
    for a, _, b in sorted(spans):
        if a >= end:
            if end >= 0:
                out.append(mask)
                at = end
            out.append(doc[at:a])
            end = b
        else:
            end = max(end, b)
    return b"".join(out) + mask + doc[end:] if spans else doc


def whole(doc: bytes, a: int, b: int) -> tuple[int, int]:
    """The span widened to whole characters."""
    while a and doc[a] & 0xC0 == 0x80:
        a -= 1
    while b < len(doc) and doc[b] & 0xC0 == 0x80:
        b += 1
    return a, b


def redact(docs: DataFrame, mask: str = "[secret]") -> DataFrame:
    """All rows and columns, with every found secret replaced by `mask`; null text stays null."""
    schema = docs.schema

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            at = batch.schema.get_field_index("text")
            changed = {}
            for i, doc, _, found, _, _ in found_in(batch):
                if found:
                    changed[i] = masked(doc, [(*whole(doc, a, b)[:1], k, whole(doc, a, b)[1]) for a, k, b in found], mask.encode()).decode()
            if changed:
                column = batch.column(at).to_pylist()
                for i, text in changed.items():
                    column[i] = text
                batch = batch.set_column(at, batch.schema.field(at), pa.array(column, batch.schema.field(at).type))
            yield batch

    return docs.mapInArrow(step, schema)
