"""Language ID by interpolated Kneser-Ney character models, one per language.

Texts become lower-case letters and single spaces. The models' highest order counts 4-grams of all
training texts; lower orders count in how many contexts an n-gram occurs, each order interpolated
with the next. Counts, discounts and probabilities are computed as tables, so no n-gram is left out
however many there are. All languages' n-grams of an order (four 16-bit symbols side by side; symbols
past 16 bits are folded) stand in one array sorted by their hashes, with a row of log probabilities
for each; n-grams that no language has back off. An array of over SHARD entries is broadcast in parts
that a task holds one after another, adding up its texts' log probabilities.

The language with the lowest cross-entropy per symbol wins. Rejection is calibrated on a training
fold that the models have not seen (but for languages that occur in it alone): a text is rejected if its
cross-entropy lies beyond Z standard errors above the model's mean and a room above that, twice what
99.9 % of the language's calibration texts need and at least LEAST_ROOM.

Cases: null text and text without letters is `und`, score 0, rejected; rows with null lang are not
learned from; with nothing to learn from, all is `und`; a language without a calibration text has the
least room; ties go to the first language in the order of names; repeated rows count as often as they
occur and get equal results; a null doc_id counts as held out from learning; texts are read whole; an
empty table gives no rows; other columns are ignored by `predict` and kept by `keep_known`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Shards, added_by_owner, crc_mod, discard, materialize, shared_dir, slices, texts

ORDER = 4
#: Rejection: standard errors above the language's mean cross-entropy, and least nats above those.
Z, LEAST_ROOM = 6.0, 1.0
#: The share of a language's calibration texts that its room is measured by, and nats of a bin.
WITHIN, BIN = 0.999, 0.02
#: Learned from: documents whose crc32 modulo FOLDS is not 0; the room is measured on fold CALIBRATED.
FOLDS, CALIBRATED = 5, 1
#: Distinct n-grams that a counting task holds before it merges them.
HELD = 2 << 20

START, SPACE = 1, 32
_tables: list[np.ndarray] = []


def tables() -> tuple[np.ndarray, np.ndarray]:
    """For each code point its 16-bit lower-case symbol, and whether it is a letter."""
    if not _tables:
        low = np.arange(0x110000, dtype=np.uint32)
        letter = np.zeros(0x110000, bool)
        for c in range(0x20000):
            s = chr(c)
            if s.isalpha():
                letter[c] = True
                if len(t := s.lower()) == 1:
                    low[c] = ord(t)
        letter[0x20000:0x32000] = True  # ideographs; what is unassigned there does not occur
        low = np.where(low >= 1 << 16, 0xE000 + low % 0x1900, low)  # into the private use area
        _tables.extend([low.astype(np.uint16), letter])
    return _tables[0], _tables[1]


def symbols(docs: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All texts' symbols in a row, each text led by ORDER - 1 start symbols; where each starts; letters in each."""
    low, letter = tables()
    decoded = [d.decode() for d in docs]
    pad = "\n" * (ORDER - 1)
    points = np.frombuffer((pad + pad.join(decoded) + "\n").encode("utf-32-le", "surrogatepass"), np.uint32)
    is_letter = letter[points]
    sizes = np.array([len(d) for d in decoded], np.int64)
    begins = np.cumsum(np.concatenate([[0], sizes[:-1] + (ORDER - 1)]))  # of the padding before each
    sym = np.where(is_letter, low[points], SPACE).astype(np.uint64)
    keep = is_letter.copy()
    keep[1:] |= is_letter[:-1]  # one space after each run of letters
    for k in range(ORDER - 1):
        sym[begins + k] = START
        keep[begins + k] = True
    keep[-1] = False  # no space follows a text's last run of letters, wherever the text stands
    kept = np.concatenate([[0], np.cumsum(keep)])
    heard = np.concatenate([[0], np.cumsum(is_letter)])
    ends = begins + (ORDER - 1) + sizes
    return sym[keep], kept[begins], heard[ends] - heard[begins]


def grams(sym: np.ndarray) -> np.ndarray:
    """The 64-bit hash of the ORDER symbols that end at each place (places before have no context)."""
    out = sym.copy()
    for k in range(1, ORDER):
        out[k:] |= sym[:-k] << np.uint64(16 * k)
    return out


def predicted(docs: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """4-grams of all predicted symbols, the text of each text's first, how many each has, letters in each."""
    sym, starts, letters = symbols(docs)
    keys = grams(sym)
    mask = np.ones(len(sym), bool)
    for k in range(ORDER - 1):
        mask[starts + k] = False
    mask[sym == START] = False
    before = np.concatenate([[0], np.cumsum(mask)])
    first = before[starts]
    counts = np.diff(np.concatenate([first, [before[-1]]]))
    return keys[mask], first, counts, letters


def merged(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, int)
    return keys[first], np.add.reduceat(counts, first) if len(keys) else counts


def counted(docs: DataFrame) -> DataFrame:
    """(lang, gram, n, held) of rows of (lang, text, calibrating), pre-aggregated in each task; `held`: of n, those of calibrating texts."""

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, list] = {}

        def add(kind, keys, counts):
            own = held.setdefault(kind, [])
            own.append((keys, counts))
            if len(own) > 1 and sum(len(k) for k, _ in own) > HELD:
                held[kind] = [merged(np.concatenate([k for k, _ in own]), np.concatenate([c for _, c in own]))]

        for batch in slices(batches):
            kinds = list(zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True))
            docs_ = texts(batch.column(1))
            for kind in sorted(set(kinds)):
                add(kind, *np.unique(predicted([d for d, own in zip(docs_, kinds, strict=True) if own == kind])[0], return_counts=True))
        for (lang, calibrating), own in held.items():
            keys, counts = merged(np.concatenate([k for k, _ in own]), np.concatenate([c for _, c in own]))
            for at in range(0, len(keys), 1 << 17):
                k, c = keys[at : at + (1 << 17)], counts[at : at + (1 << 17)].astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(k), pa.string()), pa.array(k.view(np.int64)), pa.array(c), pa.array(c * calibrating)], names=["lang", "gram", "n", "held"])

    found = docs.select("lang", "text", "calibrating").mapInArrow(step, "lang string, gram long, n long, held long")
    return found.groupBy("lang", "gram").agg(F.sum("n").alias("n"), F.sum("held").alias("held"))


def wide(counts: DataFrame, langs: list[str], n) -> DataFrame:
    """(gram, n0, n1, ...) with a count for each language."""
    return counts.where(n > 0).groupBy("gram").agg(*(F.sum(F.when(F.col("lang") == x, n).otherwise(0)).cast("double").alias(f"n{j}") for j, x in enumerate(langs)))


class Models:
    """The languages' models, from the counts of 4-grams (gram, n0, n1, ...).

    logs[k]: n-grams of order k + 1 with a column for each language; backs[k]: their contexts' back-off weights.
    """

    def __init__(self, langs: list[str], top: DataFrame, folder: str):
        self.langs, width = langs, len(langs)
        levels = [top]  # the highest order first
        for k in range(ORDER - 1, 0, -1):
            lower = F.col("gram").bitwiseAND((1 << 16 * k) - 1).alias("gram")
            each = (F.sum((F.col(f"n{j}") > 0).cast("double")).alias(f"n{j}") for j in range(width))
            levels.append(materialize(levels[-1].groupBy(lower).agg(*each), f"order{k}", folder))
        levels.reverse()
        # How many n-grams of each order there are, and how many of each language occur once and twice.
        few = [F.sum((F.col(f"n{j}") == i).cast("long")) for i in (1, 2) for j in range(width)]
        seen = [level.agg(F.count("*"), *few).first() for level in levels]
        self.floor = -float(np.log(seen[0][0] + 1.0))
        self.logs: list[Shards] = []
        self.backs: list[Shards] = []
        below = None
        for k, level in enumerate(levels):
            n, ones = seen[k][0], seen[k][1:]
            d = [one / (one + 2 * two) if one and two else 0.5 for one, two in zip(ones[:width], ones[width:], strict=True)]
            context = F.shiftrightunsigned("gram", 16)
            sums = [F.sum(f"n{j}").alias(f"t{j}") for j in range(width)] + [F.sum((F.col(f"n{j}") > 0).cast("double")).alias(f"k{j}") for j in range(width)]
            contexts = level.groupBy(context.alias("context")).agg(*sums)
            back = [F.when(F.col(f"t{j}") > 0, d[j] * F.col(f"k{j}") / F.col(f"t{j}")).otherwise(1.0).alias(f"b{j}") for j in range(width)]
            contexts = materialize(contexts.select("context", *(f"t{j}" for j in range(width)), *back), f"contexts{k + 1}", folder)
            rows = level.join(contexts, context == F.col("context"))
            lower = [F.exp(F.lit(self.floor))] * width
            if below is not None:
                rows = rows.join(below, F.col("gram").bitwiseAND((1 << 16 * k) - 1) == F.col("low"))
                lower = [F.exp(f"p{j}") for j in range(width)]
            own = [F.when(F.col(f"n{j}") > d[j], (F.col(f"n{j}") - d[j]) / F.col(f"t{j}")).otherwise(0.0) for j in range(width)]
            logs = [F.log(F.greatest(own[j] + F.col(f"b{j}") * lower[j], F.lit(1e-300))).alias(f"l{j}") for j in range(width)]
            done = materialize(rows.select("gram", *(f"n{j}" for j in range(width)), *logs), f"logs{k + 1}", folder)
            self.logs.append(Shards(done.withColumnRenamed("gram", "key"), [f"l{j}" for j in range(width)], n))
            weights = contexts.select(F.col("context").alias("key"), *(F.log(F.greatest(f"b{j}", F.lit(1e-12))).alias(f"b{j}") for j in range(width)))
            self.backs.append(Shards(weights, [f"b{j}" for j in range(width)], n))  # no more contexts than n-grams
            below = done.select(F.col("gram").alias("low"), *(F.col(f"l{j}").alias(f"p{j}") for j in range(width)))
        # The mean and deviation of the cross-entropy per symbol, from the counts.
        moments = [F.sum(f"n{j}") for j in range(width)] + [F.sum(-F.col(f"n{j}") * F.col(f"l{j}")) for j in range(width)] + [F.sum(F.col(f"n{j}") * F.col(f"l{j}") * F.col(f"l{j}")) for j in range(width)]
        n, first, second = np.array([x or 0.0 for x in done.agg(*moments).first()]).reshape(3, width)
        self.mean = first / np.maximum(n, 1)
        self.deviation = np.sqrt(np.maximum(second / np.maximum(n, 1) - self.mean**2, 0))
        self.room = np.full(width, LEAST_ROOM)

    def totals(self, docs: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Each text's log probabilities by language, its predicted symbols and its letters."""
        keys, _, counts, letters = predicted(docs)
        total = np.zeros((len(docs), len(self.langs)))
        owner = np.repeat(np.arange(len(docs)), counts)
        for k in range(ORDER - 1, -1, -1):
            lost = np.ones(len(keys), bool)
            for at, rows in self.logs[k].find(keys):
                added_by_owner(total, owner[at], rows)
                lost[at] = False
            keys, owner = keys[lost], owner[lost]
            for at, rows in self.backs[k].find(keys >> np.uint64(16)):
                added_by_owner(total, owner[at], rows)
            keys = keys & np.uint64((1 << 16 * k) - 1)
        total += np.bincount(owner, minlength=len(docs))[:, None] * self.floor
        return total, counts, letters

    def excess(self, entropy: np.ndarray, which: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Nats by which cross-entropies lie beyond Z standard errors above a language's mean."""
        return entropy - self.mean[which] - Z * self.deviation[which] / np.sqrt(np.maximum(counts, 1))

    def judged(self, docs: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Each text's best language (-1: none), its score, its cross-entropy, and whether it is rejected."""
        n = len(docs)
        if not self.langs:
            return np.full(n, -1), np.zeros(n), np.full(n, np.nan), np.ones(n, bool)
        total, counts, letters = self.totals(docs)
        entropy = -total / np.maximum(counts, 1)[:, None]
        ok = letters > 0
        best, least = entropy.argmin(axis=1), entropy.min(axis=1)
        # Neighbouring symbols depend on each other: the evidence grows with the root of the length.
        weight = np.exp(-(entropy - least[:, None]) * np.sqrt(np.maximum(counts, 1))[:, None])
        score = np.where(ok, np.minimum(1 / weight.sum(axis=1), 1.0), 0.0)
        rejected = ~ok | (self.excess(least, best, counts) > self.room[best])
        return np.where(ok, best, -1), score, np.where(ok, least, np.nan), rejected

    @property
    def batch_bytes(self) -> int:
        return max([2 << 20, *(x.batch_bytes for x in (*self.logs, *self.backs) if x.n > 1)])


def rooms(docs: DataFrame, models: Models) -> np.ndarray:
    """Each language's room, from rows of (lang, text) that the models have not seen."""
    shared = docs.sparkSession.sparkContext.broadcast(models)

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        place = {x: j for j, x in enumerate(own.langs)}
        for batch in slices(batches, most=own.batch_bytes):
            which = np.array([place.get(x, -1) for x in batch.column(0).to_pylist()])
            total, counts, letters = own.totals(texts(batch.column(1)))
            at = np.flatnonzero((which >= 0) & (letters > 0))
            over = own.excess(-total[at, which[at]] / np.maximum(counts[at], 1), which[at], counts[at])
            found, n = np.unique(np.stack([which[at], np.maximum(np.ceil(over / BIN), 0).astype(np.int64)]), axis=1, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(found[0].astype(np.int64)), pa.array(found[1].astype(np.int64)), pa.array(n.astype(np.int64))], names=["lang", "bin", "n"])

    found = docs.select("lang", "text").mapInArrow(step, "lang long, bin long, n long").groupBy("lang", "bin").agg(F.sum("n").alias("n"))
    out = np.full(len(models.langs), LEAST_ROOM)
    histogram: dict[int, list] = {}
    for r in sorted(found.collect()):  # a row for each language and bin
        histogram.setdefault(r.lang, []).append((r.bin, r.n))
    for j, own in histogram.items():
        seen = np.cumsum([n for _, n in own])
        out[j] = max(LEAST_ROOM, 2 * BIN * own[int(np.searchsorted(seen, WITHIN * seen[-1]))][0])
    return out


def untrained() -> Models:
    """Models of no language."""
    models = Models.__new__(Models)
    models.langs, models.logs, models.backs, models.room = [], [], [], np.zeros(0)
    return models


def fit(docs: DataFrame) -> Models:
    """The models of all rows of (lang, text, calibrating) with a language."""
    folder = shared_dir(docs.sparkSession)
    docs = docs.where("lang IS NOT NULL AND text IS NOT NULL")
    counts = materialize(counted(docs), "grams", folder)
    # A row for each language; those that occur among calibration texts alone are learned from these.
    learned = {r.lang: r.learned for r in counts.groupBy("lang").agg(F.max(F.col("n") > F.col("held")).alias("learned")).collect()}
    if not learned:
        return untrained()
    langs = sorted(learned)
    only = [x for x in langs if not learned[x]]
    n = F.when(F.col("lang").isin(only), F.col("n")).otherwise(F.col("n") - F.col("held"))
    models = Models(langs, materialize(wide(counts, langs, n), "top", folder), folder)
    models.room = rooms(docs.where("calibrating").where(~F.col("lang").isin(only)), models)
    discard(docs.sparkSession, folder)
    return models


def training(docs: DataFrame) -> DataFrame:
    """(lang, text, calibrating) of the documents that may be learned from."""
    fold = crc_mod("doc_id", FOLDS)
    return docs.where(fold != 0).select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"), (fold == CALIBRATED).alias("calibrating"))


def predict(docs: DataFrame, models: Models) -> DataFrame:
    """Per row of (doc_id, text): lang_pred, score, cross_entropy, rejected."""
    shared = docs.sparkSession.sparkContext.broadcast(models)

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        names = np.array([*own.langs, "und"], object)
        for batch in slices(batches, most=own.batch_bytes):
            best, score, entropy, rejected = own.judged(texts(batch.column(1)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(names[best], pa.string()), pa.array(score), pa.array(entropy, from_pandas=True), pa.array(rejected)],
                names=["doc_id", "lang_pred", "score", "cross_entropy", "rejected"],
            )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(step, "doc_id long, lang_pred string, score double, cross_entropy double, rejected boolean")


def keep_known(docs: DataFrame, models: Models) -> DataFrame:
    """All columns of the documents that are not rejected."""
    shared = docs.sparkSession.sparkContext.broadcast(models)

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, most=shared.value.batch_bytes):
            at = batch.schema.get_field_index("text")
            yield batch.filter(pa.array(~shared.value.judged(texts(batch.column(at)))[3]))

    return docs.mapInArrow(step, docs.schema)


def identify(docs: DataFrame) -> DataFrame:
    """Learns from the training folds and predicts every row; `held_out` marks the other fold."""
    out = predict(docs, fit(training(docs)))
    held = crc_mod("doc_id", FOLDS) == 0
    return out.select("doc_id", F.coalesce(held, F.lit(True)).alias("held_out"), "lang_pred", "score", "cross_entropy", "rejected")
