"""Token ids of whole texts, through the distinct chunks between their spaces.

Both tokenizers split a text before a space that a word follows in any case, so a text's ids are its
chunks' ids in a row. Arrow tells the chunks of a batch of texts apart, the library encodes the distinct
ones, and NumPy gathers their ids into texts again.
"""

from __future__ import annotations

import os

import numpy as np
import pyarrow as pa

from .common import CACHES

#: Chunks whose ids a worker keeps, in two generations of half as many. Bounds memory, not results.
CACHE_ENTRIES = 100_000
#: Chunks that the library is given as one text, and such texts (or chunks) that it is asked for at a time.
JOINED, ASKED_TEXTS, ASKED = 100, 200, 20_000

#: First bytes of characters that are surely no white space.
VISIBLE = np.array([c > 0x20 and c not in (0x7F, 0xC2, 0xE1, 0xE2, 0xE3) for c in range(256)])


def gathered(flat: np.ndarray, begins: np.ndarray, sizes: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Runs of a flat array, in the order `at`; and where each ends in the result."""
    each = sizes[at]
    ends = np.cumsum(each)
    if not len(ends):
        return flat[:0], ends
    kind = np.int32 if max(len(flat), ends[-1]) < 1 << 31 else np.int64
    places = np.repeat((begins[at] - (ends - each)).astype(kind), each)
    places += np.arange(ends[-1], dtype=kind)
    return flat[places], ends


def told_apart(whole: bytes, starts: np.ndarray) -> pa.DictionaryArray:
    """The chunks of some text, that start at ascending places from 0 on."""
    offsets = np.append(starts, len(whole)).astype(np.int64)
    return pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(whole)]).dictionary_encode()


class ChunkIds:
    """Ids of chunks, kept from batch to batch. Subclasses ask their library for new ones."""

    dtype: np.dtype

    def __init__(self):
        self.young: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}
        CACHES.append(self.clear)

    def clear(self) -> None:
        self.young, self.old = {}, {}

    def asked(self, chunks: list[bytes]) -> list[bytes]:
        raise NotImplementedError

    def known(self, chunks: list[bytes]) -> list[bytes]:
        """The ids of distinct chunks."""
        out = list(map(self.young.get, chunks))
        lost = [i for i, ids in enumerate(out) if ids is None]
        if len(self.young) + len(lost) > CACHE_ENTRIES // 2:
            self.old, self.young = self.young, {}
        new = []
        for i in lost:
            ids = out[i] = self.old.get(chunks[i])
            if ids is None:
                new.append(i)
            else:
                self.young[chunks[i]] = ids
        for a in range(0, len(new), ASKED):
            part = new[a : a + ASKED]
            for i, ids in zip(part, self.asked([chunks[i] for i in part]), strict=True):
                out[i] = self.young[chunks[i]] = ids
        return out

    def of_chunks(self, whole: bytes, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all chunks in a row, and where each chunk's end; `starts` ascend from 0."""
        if not len(starts):
            return np.zeros(0, self.dtype), np.zeros(0, np.int64)
        told = told_apart(whole, starts)
        ids = self.known(told.dictionary.to_pylist())
        sizes = np.fromiter(map(len, ids), np.int64, len(ids)) // self.dtype.itemsize
        return gathered(np.frombuffer(b"".join(ids), self.dtype), np.cumsum(sizes) - sizes, sizes, told.indices.to_numpy())


def per_text(ends: np.ndarray, chunks_before: np.ndarray) -> np.ndarray:
    """Where each text's ids end, from where its chunks' do."""
    return np.concatenate([[0], ends])[chunks_before]


class ByteLevel:
    """A byte-level BPE tokenizer file (tokenizers library)."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer, self.plain = Tokenizer.from_file(path), Tokenizer.from_file(path)
        self.plain.encode_special_tokens = True
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        self.bytes_of = np.zeros(self.tokenizer.get_vocab_size(), np.int64)
        for token, i in self.tokenizer.get_vocab().items():
            self.bytes_of[i] = len(token)  # a letter for each byte
        self.added = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]

    def of_chunks(self, whole: bytes, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all chunks in a row, and where each chunk's end; `starts` ascend from 0.

        The distinct chunks lie in a row, so the library is given many as one text, which it cuts before a chunk that
        starts with a space and what is surely visible; how many bytes each id stands for tells their ids apart.
        """
        if not len(starts):
            return np.zeros(0, self.dtype), np.zeros(0, np.int64)
        told = told_apart(whole, starts)
        distinct = told.dictionary
        at = np.frombuffer(distinct.buffers()[1], np.int64, len(distinct) + 1, 8 * distinct.offset)
        row = distinct.buffers()[2].to_pybytes()[at[0] : at[-1]]
        at = at - at[0]
        data = np.frombuffer(row, np.uint8)
        sizes = np.diff(at)
        joins = (sizes > 1) & (data[at[:-1]] == 0x20) & VISIBLE[data[np.minimum(at[:-1] + 1, len(data) - 1)]]
        bounds = np.append(at[:-1][~joins | (np.arange(len(sizes)) % JOINED == 0)], len(row)).tolist()
        parts = []
        for k in range(0, len(bounds) - 1, ASKED_TEXTS):
            asked = [row[a:b].decode() for a, b in zip(bounds[k : k + ASKED_TEXTS], bounds[k + 1 : k + 1 + ASKED_TEXTS], strict=False)]
            parts += [np.array(e.ids, self.dtype) for e in self.plain.encode_batch_fast(asked, add_special_tokens=False)]
        ids = np.concatenate(parts)
        ends = np.searchsorted(np.cumsum(self.bytes_of[ids]), at[1:]) + 1
        counts = np.diff(ends, prepend=0)
        return gathered(ids, ends - counts, counts, told.indices.to_numpy())

    @staticmethod
    def starts(data: np.ndarray, text_starts: np.ndarray) -> np.ndarray:
        """Where chunks start: at each text, and at each space that a visible character of its text follows."""
        lead = data[1:]
        second = np.append(data[2:], 0)
        # No character that may be white space: not cutting there is always right.
        seen = (lead > 0x20) & (lead != 0x7F)
        seen &= ~((lead == 0xC2) & ((second == 0x85) | (second == 0xA0))) & ~((lead == 0xE1) & (second == 0x9A))
        seen &= ~((lead == 0xE2) & ((second == 0x80) | (second == 0x81))) & ~((lead == 0xE3) & (second == 0x80))
        hit = np.zeros(len(data) + 1, bool)
        hit[: len(data) - 1] = (data[:-1] == 0x20) & seen
        hit[np.maximum(text_starts - 1, 0)] = False  # a text's last character
        hit[text_starts] = True
        return np.flatnonzero(hit[: len(data)])

    def encode(self, docs: list[bytes], added: bool) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in a row, and where each text's end.

        With `added` the strings of added tokens are their ids, as by the library's default (texts that hold
        one go to it whole); else they are ordinary text.
        """
        special = {i: doc for i, doc in enumerate(docs) if added and any(t in doc for t in self.added)}
        plain = [b"" if i in special else doc for i, doc in enumerate(docs)] if special else docs
        whole = b"".join(plain)
        bounds = np.cumsum([0, *map(len, plain)])
        starts = self.starts(np.frombuffer(whole, np.uint8), bounds[:-1][np.diff(bounds) > 0]) if whole else np.zeros(0, np.int64)
        ids, chunk_ends = self.of_chunks(whole, starts)
        ends = per_text(chunk_ends, np.searchsorted(starts, bounds[1:]))
        if not special:
            return ids, ends
        parts = np.split(ids, ends[:-1])
        for i, doc in special.items():
            parts[i] = np.array(self.tokenizer.encode(doc.decode(), add_special_tokens=False).ids, self.dtype)
        return np.concatenate(parts), np.cumsum([len(p) for p in parts])


class Pieces(ChunkIds):
    """A SentencePiece BPE model with byte fallback and no text normalization."""

    def __init__(self, path: str):
        super().__init__()
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2 as pb

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        spec = pb.ModelProto()
        with open(path, "rb") as f:
            spec.ParseFromString(f.read())
        norm = spec.normalizer_spec
        if norm.precompiled_charsmap or norm.remove_extra_whitespaces or not norm.add_dummy_prefix or spec.trainer_spec.model_type != 2:
            raise ValueError("a BPE model that keeps texts as they are is needed")
        self.scores = {p.piece: p.score for p in spec.pieces if p.type == 1}
        self.ids = {p.piece: i for i, p in enumerate(spec.pieces) if p.type == 1}
        self.byte_ids = {int(p.piece[1:-1], 16): i for i, p in enumerate(spec.pieces) if p.type == 6}
        if len(self.byte_ids) != 256 or any("▁" in p.lstrip("▁") for p in self.ids):
            raise ValueError("byte pieces, and no piece with a space inside, are needed")
        surfaces = [b""] * len(spec.pieces)
        for p, i in self.ids.items():
            surfaces[i] = p.replace("▁", " ").encode()
        for b, i in self.byte_ids.items():
            surfaces[i] = bytes([b])
        self.surfaces = np.frombuffer(b"".join(surfaces), np.uint8)
        self.surface_sizes = np.array([len(s) for s in surfaces], np.int64)
        self.surface_begins = np.cumsum(self.surface_sizes) - self.surface_sizes
        self.longest = max(map(len, self.ids))
        self.dtype = np.dtype("<u2" if len(spec.pieces) <= 1 << 16 else "<u4")

    def asked(self, chunks: list[bytes]) -> list[bytes]:
        """The library's ids of chunks that start with the one space that it adds itself."""
        bare = np.array([self.ids["▁"]], self.dtype).tobytes()
        got = self.model.encode([c[1:].decode() for c in chunks], num_threads=1)
        return [np.array(ids, self.dtype).tobytes() if c != b" " else bare for c, ids in zip(chunks, got, strict=True)]

    def spaced(self, parts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of parts in a row, and where each part's end; each part starts with a space, or is empty,
        and ends before a run of spaces or at its text's end."""
        whole = b"".join(parts)
        bounds = np.cumsum([0, *map(len, parts)])
        if not whole:
            return np.zeros(0, self.dtype), np.zeros(len(parts), np.int64)
        data = np.frombuffer(whole, np.uint8)
        space = data == 0x20
        hit = np.append(space, False)
        hit[1:-1] &= ~space[:-1]
        if "▁".encode() in whole:  # the library takes it for a space
            same = np.flatnonzero((data[2:] == 0x81) & (data[1:-1] == 0x96) & (data[:-2] == 0xE2)) + 3
            hit[same] = False
        hit[bounds[:-1]] = True
        starts = np.flatnonzero(hit[:-1])
        ids, chunk_ends = self.of_chunks(whole, starts)
        return ids, per_text(chunk_ends, np.searchsorted(starts, bounds[1:]))

    def encode(self, docs: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in a row, and where each text's end."""
        return self.spaced([b" " + d if d else b"" for d in docs])

    def surface(self, ids: np.ndarray) -> tuple[bytes, np.ndarray]:
        """The bytes that ids stand for, in a row, and where each id's end."""
        data, ends = gathered(self.surfaces, self.surface_begins, self.surface_sizes, ids.astype(np.int64))
        return data.tobytes(), ends

    def decode(self, ids: np.ndarray) -> bytes:
        """The text's UTF-8 bytes: pieces' surfaces in a row without the space added in front."""
        data = self.surface(ids)[0]
        return data[1:] if data[:1] == b" " else data


_loaded: dict = {}


def loaded(kind: type, path: str):
    """One tokenizer of each file in a worker."""
    if (kind, path) not in _loaded:
        _loaded[kind, path] = kind(path)
    return _loaded[kind, path]
