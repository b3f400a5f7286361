"""Chat formatting of reply trees.

Messages point at the message they reply to. Pointer doubling (self-joins of the table, each of
which doubles the reach) gives every message its root, depth and the sum of scores up to the root;
leaves are ranked within a root by that score; a second run of doublings marks the messages on the
chosen leaves' paths. Both take a number of joins that grows with the logarithm of the depth. Each
chosen path becomes one formatted conversation.

Template: a turn is `### role: text</turn>` and a line end. In roles and texts a backslash,
`###`, `</turn>` and (in roles) a colon are escaped, so no control string can occur in them and
parsing restores them exactly.

Cases: null text and null role are empty; a reply to a missing message, or to itself, is a root;
messages in a cycle have no root and belong to no path; ties in score go to the smaller leaf; of rows
that repeat a message one counts (turns of `from_turns` are all messages of their own, repeated or not);
a conversation is formatted as a whole, however long; an empty table gives no conversation; other columns
are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import discard, materialize, shared_dir, slices

# The template's control strings and what stands for them inside a text.
HEAD, MIDDLE, END = "### ", ": ", "</turn>\n"
ESCAPES = {"\\": "\\\\", "###": "\\h", "</turn>": "\\t"}
ROLE_ESCAPES = {**ESCAPES, ":": "\\c", "\n": "\\n"}
RESTORED = {"\\\\": "\\", "\\h": "###", "\\t": "</turn>", "\\c": ":", "\\n": "\n"}
TO_ESCAPE = re.compile(r"\\|###|</turn>")
ROLE_TO_ESCAPE = re.compile(r"\\|###|</turn>|:|\n")
TO_RESTORE = re.compile(r"\\[\\htcn]")
TURN = re.compile(r"### ([^:]*): (.*?)</turn>\n", re.S)

TRAINED_ROLE = "assistant"


def escape(text: str, role: bool = False) -> str:
    table = ROLE_ESCAPES if role else ESCAPES
    return (ROLE_TO_ESCAPE if role else TO_ESCAPE).sub(lambda m: table[m[0]], text)


def restore(text: str) -> str:
    return TO_RESTORE.sub(lambda m: RESTORED[m[0]], text)


def formatted(turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
    """The conversation's text, and the loss mask: spans (code points) of what the assistant says."""
    out, spans, at = [], [], 0
    for role, text in turns:
        head, body = f"{HEAD}{escape(role, True)}{MIDDLE}", escape(text)
        if role == TRAINED_ROLE:
            spans.append((at + len(head), at + len(head) + len(body)))
        out.append(f"{head}{body}{END}")
        at += len(out[-1])
    return "".join(out), spans


def parsed(text: str) -> list[tuple[str, str]]:
    """The (role, text) turns of a formatted conversation."""
    out, at = [], 0
    while at < len(text):
        m = TURN.match(text, at)
        if not m:
            raise ValueError(f"no turn at {at}")
        out.append((restore(m[1]), restore(m[2])))
        at = m.end()
    return out


def distinct_messages(messages: DataFrame) -> DataFrame:
    """One row for each tree and msg: of several, that with the greatest score, then the first by its other columns."""
    others = [c for c in ("parent", "role", "text") if c in messages.columns]
    order = [F.col("score").desc_nulls_last(), *(F.col(c).asc_nulls_last() for c in others)]
    found = messages.withColumn("nth_", F.row_number().over(Window.partitionBy("tree", "msg").orderBy(*order)))
    return found.where("nth_ = 1").select(messages.columns)


def chosen_paths(messages: DataFrame, top: int = 1) -> DataFrame:
    """(tree, leaf, rank, depth, msg) of the `top` best-scored root-to-leaf paths of each tree.

    messages: tree, msg, parent (null for a root), score; of rows with one tree and msg, the one that
    `distinct_messages` keeps counts.
    """
    return paths_of(distinct_messages(messages), top)


def paths_of(messages: DataFrame, top: int) -> DataFrame:
    folder = shared_dir(messages.sparkSession)
    nodes = messages.select("tree", "msg", F.when(~F.col("parent").eqNullSafe(F.col("msg")), F.col("parent")).alias("parent"), F.coalesce(F.col("score").cast("double"), F.lit(0.0)).alias("score"))
    known = nodes.select(F.col("tree").alias("t"), F.col("msg").alias("m"))
    nodes = nodes.join(known, nodes.tree.eqNullSafe(known.t) & (nodes.parent == known.m), "left").select("tree", "msg", F.col("m").alias("up"), "score")
    # far: how many steps `up` is away; total: scores from the message to just below `up`.
    jumps = materialize(nodes.withColumn("far", F.lit(1).cast("long")).withColumn("total", F.col("score")), "jump0", folder)
    levels, k, n = [jumps], 0, jumps.count()
    while (1 << k) <= n and not jumps.where("up IS NOT NULL").isEmpty():  # beyond, only cycles are left
        b = jumps.select(F.col("tree").alias("t"), F.col("msg").alias("m"), F.col("up").alias("up2"), F.col("far").alias("far2"), F.col("total").alias("total2"))
        # Messages that have reached their root are done; only the others go on.
        open_ = jumps.where("up IS NOT NULL")
        j = open_.join(b, open_.tree.eqNullSafe(b.t) & (open_.up == b.m))
        k += 1
        j = j.select("tree", "msg", F.col("up2").alias("up"), "score", (F.col("far") + F.col("far2")).alias("far"), (F.col("total") + F.col("total2")).alias("total"))
        jumps = materialize(jumps.where("up IS NULL").unionByName(j), f"jump{k}", folder)
        levels.append(jumps)
    rooted = jumps.where("up IS NULL").select("tree", "msg", (F.col("far") - 1).alias("depth"), "total")
    parents = levels[0].where("up IS NOT NULL").select(F.col("tree").alias("t"), F.col("up").alias("m")).distinct()
    leaves = rooted.join(parents, rooted.tree.eqNullSafe(parents.t) & (rooted.msg == parents.m), "left_anti")
    rank = F.row_number().over(Window.partitionBy("tree").orderBy(F.col("total").desc(), "msg"))
    best = leaves.withColumn("rank", rank).where(F.col("rank") <= top)
    marked = materialize(best.select("tree", F.col("msg").alias("leaf"), "rank", "depth", "msg"), "marked", folder)
    for k, level in enumerate(levels[:-1]):
        up = level.where("up IS NOT NULL").select(F.col("tree").alias("t"), F.col("msg").alias("m"), "up")
        more = marked.join(up, marked.tree.eqNullSafe(up.t) & (marked.msg == up.m)).select("tree", "leaf", "rank", (F.col("depth") - (1 << k)).alias("depth"), F.col("up").alias("msg"))
        marked = materialize(marked.unionByName(more), f"marked{k}", folder)  # else the plan doubles each time
    discard(messages.sparkSession, folder, f"marked{len(levels) - 2}" if len(levels) > 1 else "marked")
    return marked


def render(paths: DataFrame) -> DataFrame:
    """(tree, leaf, turns array of (depth, role, text)) to (tree, leaf, text, mask array of spans)."""

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in (batch.slice(i, 256) for i in range(0, batch.num_rows, 256)):
                made = [formatted([(t["role"], t["text"]) for t in turns]) for turns in part.column(2).to_pylist()]
                mask = [[{"start": a, "end": b} for a, b in spans] for _, spans in made]
                kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array([t for t, _ in made], pa.string()), pa.array(mask, kind)], names=["tree", "leaf", "text", "mask"])

    tree, leaf = paths.schema["tree"].dataType.simpleString(), paths.schema["leaf"].dataType.simpleString()
    return paths.select("tree", "leaf", "turns").mapInArrow(step, f"tree {tree}, leaf {leaf}, text string, mask array<struct<start: long, end: long>>")


def conversations(messages: DataFrame, top: int = 1) -> DataFrame:
    """Formats the `top` best paths of each tree.

    messages: tree, msg, parent, score, role, text. Returns tree, leaf, text, mask.
    """
    messages = materialize(distinct_messages(messages.select("tree", "msg", "parent", "score", "role", "text")), "messages")
    paths = paths_of(messages, top)
    said = messages.select(F.col("tree").alias("t"), F.col("msg").alias("m"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    turns = paths.join(said, paths.tree.eqNullSafe(said.t) & (paths.msg == said.m))
    turns = turns.groupBy("tree", "leaf").agg(F.sort_array(F.collect_list(F.struct("depth", "role", "text"))).alias("turns"))
    return render(turns)


def from_turns(turns: DataFrame) -> DataFrame:
    """Rows of (conv_id, turn, role, text) as trees of one branch each: every row replies to the one before.

    Rows of the same turn follow each other by role and text; repeated rows are all kept.
    """
    w = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), F.coalesce("role", F.lit("")), F.coalesce("text", F.lit("")))
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    rows = rows.withColumn("msg", F.row_number().over(w).cast("long"))
    return rows.select(F.col("conv_id").alias("tree"), "msg", F.when(F.col("msg") > 1, F.col("msg") - 1).alias("parent"), F.lit(0.0).alias("score"), "role", "text")


def with_probe(turns: DataFrame) -> DataFrame:
    """The turns plus conversation -7, whose texts hold the template's own control strings."""
    spark: SparkSession = turns.sparkSession
    said = "\\### Assistant: </turn> ok"
    probe = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    return turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text")).unionByName(probe)


DIGEST = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def read_back(made: DataFrame) -> DataFrame:
    """Parses formatted conversations and digests their turns and what the loss mask covers."""

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            rows = []
            for tree, text, mask in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                turns = parsed(text)
                loss = "".join(restore(text[m["start"] : m["end"]]) for m in mask)
                whole = "".join(f"{r}\n{t}\n" for r, t in turns)
                rows.append((tree, len(turns), hashlib.sha256(whole.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(text)))
            columns = list(zip(*rows, strict=True))
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    return made.select(F.col("tree").alias("conv_id"), "text", "mask").mapInArrow(step, DIGEST)
