"""Transcript files (VTT, SRT, CSV, TSV, XLSX, plain text, Markdown) as segments.

Files are read with Spark's binary reader, so they may be on any file system; a task parses whole
files, since a caption or a workbook has no meaning by line. Neighbouring segments are then merged
as a DataFrame (turns.merge_segments).
"""

from __future__ import annotations

import csv
import io
import math
import posixpath
import re
import zipfile
from collections.abc import Callable
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..functions import text as T
from ..operators import turns as turn_ops

# Column headers by meaning; a source's own come before the general ones.
TEXT_HEADERS = ("text", "transcript", "utterance", "content", "final transcript", "manual transcript", "corrected transcript", "תמלול", "תמלול סופי")
SOURCE_HEADERS = {
    "zoom": ("zoom transcript", "zoom transcription", "zoom text"),
    "chatgpt": ("chatgpt transcript", "chat gpt transcript", "chatgpt transcription", "chatgpt text", "chat gpt text"),
    "gold": ("gold standard", "gold standard transcript", "gold transcript", "gold text", "reference transcript", "human transcript", "manually corrected transcript"),
}
START_HEADERS = ("start", "start time", "start_time", "start seconds", "start (s)", "begin", "זמן התחלה")
END_HEADERS = ("end", "end time", "end_time", "end seconds", "end (s)", "finish", "זמן סיום")
SPEAKER_HEADERS = ("speaker", "speaker role", "raw speaker", "gold speaker", "name", "participant", "דובר")
TIME_FORMATS = frozenset((18, 19, 20, 21, 22, 45, 46, 47))
HEADER_ROWS = 25

_STAMP = r"(?:\d{1,2}:)?\d{1,2}:\d{2}(?:[.,]\d+)?"
RANGE = re.compile(rf"({_STAMP})\s*--?>\s*({_STAMP})")
VOICE = re.compile(r"\s*<v(?:\.[^ >]+)?\s+([^>]+)>(.*?)(?:</v>)?\s*$", re.I | re.S)
PREFIX = re.compile(r"^(?:\[([^\]]+)\]\s*)?([^:\n]{1,80}):\s*(.+)$")
SENTENCE = re.compile(r"(?<=[.!?])\s+(?=[A-Z֐-׿])")
UNKNOWN = "Unknown"

Row = tuple  # (start, end, speaker, text)


def seconds(stamp: str) -> float:
    """Of HH:MM:SS[.f] or MM:SS[.f]; ValueError for anything else."""
    parts = stamp.strip().replace(",", ".").split(":")
    if len(parts) not in (2, 3):
        raise ValueError(f"not a time: {stamp}")
    *whole, last = parts
    total = 0
    for p in whole:
        total = total * 60 + int(p)
    return total * 60 + float(last)


def moment(cell: str, days: bool = False) -> float | None:
    """Seconds of a cell, None if it is blank or not a time; days: a number is a share of a day."""
    raw = cell.strip().replace(",", ".")
    try:
        if not raw or ":" in raw:
            return seconds(raw) if raw else None
        x = float(raw) * (86400.0 if days else 1.0)
    except ValueError:
        return None
    return x if math.isfinite(x) else None


def plain(s: str) -> str:
    return " ".join(re.sub(r"<[^>]+>", "", s).replace("&nbsp;", " ").split())


def spoken_by(s: str) -> tuple[str, str]:
    m = PREFIX.match(s.strip())
    return (m[2].strip(), m[3].strip()) if m else (UNKNOWN, s.strip())


def decoded(data: bytes) -> str:
    return data.decode("utf-8-sig", "replace")


def captions(data: bytes, source: str | None) -> list[Row]:
    """VTT and SRT: a time range, then lines up to a blank one; lines of digits alone are counters."""
    out, block, span = [], [], None

    def close() -> None:
        if span is None:
            return
        raw = " ".join(block)
        m = VOICE.match(raw)
        who, said = (plain(m[1]) or UNKNOWN, plain(m[2])) if m else (UNKNOWN, "")
        if who == UNKNOWN:
            who, said = spoken_by(plain(raw))
        if said:
            out.append((*span, who, said))

    for line in [*(x.strip() for x in decoded(data).splitlines()), ""]:
        hit = RANGE.search(line) if span is None else None
        if hit:
            span, block = (seconds(hit[1]), seconds(hit[2])), []
        elif span is not None and not line:
            close()
            span = None
        elif span is not None and not line.isdigit():
            block.append(line)
    return out


def headers_of(source: str | None) -> tuple[str, ...]:
    return SOURCE_HEADERS.get((source or "").casefold(), ()) + TEXT_HEADERS


def delimited(data: bytes, source: str | None) -> list[Row]:
    """CSV and TSV: the delimiter is found from the file's start; of several text columns the first with a value counts."""
    text = decoded(data)
    try:
        dialect = csv.Sniffer().sniff(text[:4096], delimiters=",;\t")
    except csv.Error:
        dialect = csv.excel
    out = []
    for record in csv.DictReader(io.StringIO(text, newline=""), dialect=dialect):
        cells = {T.header_name(k): v.strip() for k, v in record.items() if isinstance(k, str) and isinstance(v, str)}
        pick = lambda names, cells=cells: next((v for n in names if (v := cells.get(T.header_name(n), ""))), "")
        said = pick(headers_of(source))
        if said:
            who = pick(SPEAKER_HEADERS) or UNKNOWN
            if who == UNKNOWN:
                who, said = spoken_by(said)
            out.append((moment(pick(START_HEADERS)), moment(pick(END_HEADERS)), who, said))
    return out


def prose(data: bytes, source: str | None) -> list[Row]:
    """Text and Markdown: a segment for each line; one long untimed line becomes its sentences (never merged)."""
    text = decoded(data)
    out = []
    for line in filter(None, map(str.strip, text.splitlines())):
        start = end = None
        if m := RANGE.search(line):
            start, end = seconds(m[1]), seconds(m[2])
            line = (line[: m.start()] + line[m.end() :]).strip(" -[]")
        who, said = spoken_by(line)
        head = PREFIX.match(line) if who != UNKNOWN and start is None else None
        if head and head[1] and (stamp := re.search(_STAMP, head[1])):
            start = seconds(stamp[0])
        if said:
            out.append((start, end, who, said))
    if len(out) == 1 and out[0][2] == UNKNOWN and len(text) > 300:
        return [(None, None, UNKNOWN, part.strip()) for part in SENTENCE.split(text.strip()) if part.strip()]
    return out


class Workbook:
    """Cells of an XLSX file: (text, whether the cell shows a time)."""

    def __init__(self, data: bytes):
        try:
            self.zip = zipfile.ZipFile(io.BytesIO(data))
            self.strings = ["".join(t.text or "" for t in self.all(si, "t")) for si in self.all(self.xml("xl/sharedStrings.xml", False), "si")]
            self.time_styles = self.styles()
            self.sheets = [(name, self.rows(path)) for name, path in self.places()]
        except zipfile.BadZipFile as e:
            raise ValueError("not an XLSX workbook") from e
        except ElementTree.ParseError as e:
            raise ValueError("broken XML in the workbook") from e

    def xml(self, path: str, needed: bool = True):
        try:
            return ElementTree.fromstring(self.zip.read(path))
        except KeyError:
            if needed:
                raise ValueError(f"the workbook lacks {path}") from None
            return ElementTree.Element("none")

    @staticmethod
    def all(node, name: str) -> list:
        return node.findall(f".//{{*}}{name}")

    def styles(self) -> set[int]:
        root = self.xml("xl/styles.xml", False)
        number = lambda n, k: int(n.get(k, "-1")) if n.get(k, "").isdigit() else -1
        own = {number(n, "numFmtId"): n.get("formatCode", "") for n in self.all(root, "numFmt")}
        cells = root.findall("{*}cellXfs/{*}xf")
        return {i for i, x in enumerate(cells) if number(x, "numFmtId") in TIME_FORMATS or self.shows_time(own.get(number(x, "numFmtId"), ""))}

    @staticmethod
    def shows_time(code: str) -> bool:
        code = re.sub(r'"[^"]*"|\\.', "", code.casefold())
        return any(f"[{x}]" in code for x in "hms") or ("h" in code and ("m" in code or "s" in code))

    def places(self) -> list[tuple[str, str]]:
        to = {r.get("Id"): r.get("Target", "") for r in self.all(self.xml("xl/_rels/workbook.xml.rels"), "Relationship")}
        out = []
        for sheet in self.all(self.xml("xl/workbook.xml"), "sheet"):
            link = next((v for k, v in sheet.attrib.items() if k.endswith("}id")), None)
            if target := to.get(link):
                out.append((sheet.get("name", "Sheet"), target.lstrip("/") if target[0] == "/" else posixpath.normpath(f"xl/{target}")))
        return out

    def cell(self, c) -> tuple[str, bool]:
        kind, v = c.get("t", ""), c.find("{*}v")
        text = "".join(t.text or "" for t in self.all(c, "t")) if kind == "inlineStr" else (v.text or "" if v is not None else "")
        if kind == "s":
            text = self.strings[int(text)] if text.isdigit() and int(text) < len(self.strings) else ""
        elif kind == "b":
            text = "TRUE" if text == "1" else "FALSE"
        style = c.get("s", "0")
        return text, style.isdigit() and int(style) in self.time_styles

    def rows(self, path: str) -> list[list[tuple[str, bool]]]:
        out = []
        for r in self.all(self.xml(path), "row"):
            cells: dict[int, tuple[str, bool]] = {}
            for c in r.findall("{*}c"):
                letters = re.match(r"[A-Za-z]+", c.get("r", ""))
                at = max(cells, default=-1) + 1
                if letters:
                    at = 0
                    for x in letters[0].upper():
                        at = at * 26 + ord(x) - 64
                    at -= 1
                cells[at] = self.cell(c)
            out.append([cells.get(i, ("", False)) for i in range(max(cells, default=-1) + 1)])
        return out


def workbook(data: bytes, source: str | None) -> list[Row]:
    """XLSX: the first table with a text column that yields segments; else a sheet of one column."""
    book = Workbook(data)
    blank = ("", False)
    for _, rows in book.sheets:
        for k, head in enumerate(rows[:HEADER_ROWS]):
            names: dict[str, int] = {}
            for i, (text, _) in enumerate(head):
                names.setdefault(T.header_name(text), i)
            at = lambda wanted, names=names: next((names[h] for w in wanted if (h := T.header_name(w)) in names), None)
            if at(headers_of(source)) is None:
                continue
            get = lambda row, i: row[i] if i is not None and i < len(row) else blank
            out = []
            for row in rows[k + 1 :]:
                said = get(row, at(headers_of(source)))[0].strip()
                if said:
                    who = get(row, at(SPEAKER_HEADERS))[0].strip() or UNKNOWN
                    if who == UNKNOWN:
                        who, said = spoken_by(said)
                    out.append((moment(*get(row, at(START_HEADERS))), moment(*get(row, at(END_HEADERS))), who, said))
            if out:
                return out
    return column(book, source)


def column(book: Workbook, source: str | None) -> list[Row]:
    """A sheet with one filled column, sheets named after the source first; never merged."""
    key = (source or "").casefold()
    heads = {T.header_name(h) for h in headers_of(source)}
    for _, rows in sorted(book.sheets, key=lambda s: not (key and key in s[0].casefold().replace(" ", ""))):
        filled = {i for r in rows for i, (text, _) in enumerate(r) if text.strip()}
        if len(filled) == 1:
            (i,) = filled
            values = [r[i][0].strip() for r in rows if len(r) > i and r[i][0].strip()]
            out = [(None, None, *spoken_by(v)) for v in values[values[0] and T.header_name(values[0]) in heads :]]
            if out := [r for r in out if r[3]]:
                return out
    raise ValueError("the workbook has no transcript column; name one " + ", ".join(headers_of(source)[:6]))


#: Parsers by suffix.
PARSERS: dict[str, Callable[[bytes, str | None], list[Row]]] = {
    **dict.fromkeys((".vtt", ".srt"), captions), **dict.fromkeys((".csv", ".tsv"), delimited),
    ".xlsx": workbook, **dict.fromkeys((".txt", ".text", ".md"), prose),
}


def parser(path: str) -> Callable[[bytes, str | None], list[Row]]:
    suffix = posixpath.splitext(path)[1].casefold()
    if suffix not in PARSERS:
        raise ValueError(f"no parser for {suffix or 'files without a suffix'}; there are {', '.join(sorted(PARSERS))}")
    return PARSERS[suffix]


def raw_segments(files: DataFrame) -> DataFrame:
    """Segments of rows (project_id, source, path, content), unmerged, with `merges`: whether neighbours may merge."""

    def step(batches):
        for batch in batches:
            out = []
            for r in batch.itertuples():
                rows = parser(r.path)(bytes(r.content), r.source)
                merges = any(x[0] is not None for x in rows)
                out += [(r.project_id, r.source, i, *x, None, merges) for i, x in enumerate(rows)]
            names = ["project_id", "source", "seg_idx", "start", "end", "speaker", "text", "confidence", "merges"]
            yield pd.DataFrame(out, columns=names).astype({"start": "float64", "end": "float64", "confidence": "float64", "seg_idx": "int32", "merges": "bool"})

    ddl = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in schemas.SEGMENTS) + ", merges boolean"
    out = files.select("project_id", "source", "path", "content").mapInPandas(step, ddl)
    return out.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in ("start", "end", "confidence")})


def read(spark: SparkSession, paths: dict[str, str], project_id: str) -> DataFrame:
    """Merged segments of one project's files, source name to path; suffixes are checked before anything is read."""
    for p in paths.values():
        parser(p)
    found = None
    for source, path in sorted(paths.items()):
        one = spark.read.format("binaryFile").load(path).select(F.lit(project_id).alias("project_id"), F.lit(source).alias("source"), "path", "content")
        found = one if found is None else found.unionByName(one)
    if found is None:
        return spark.createDataFrame([], schemas.SEGMENTS)
    return turn_ops.merge_segments(raw_segments(found).drop("merges"))


def reload(spark: SparkSession, paths: dict[str, str], project_id: str, known: DataFrame) -> tuple[DataFrame, dict[str, int]]:
    """All of a project's segments with its three sources replaced at once, and their counts.

    Every file is parsed before the result exists; if one fails, `known` stays what it was. An empty
    path removes its source.
    """
    wanted = {k: v for k in ("zoom", "chatgpt", "gold") if (v := (paths.get(k) or "").strip())}
    new = read(spark, wanted, project_id).persist()
    counts = {r["source"]: r["count"] for r in new.groupBy("source").count().collect()}  # three rows
    rest = known.where((F.col("project_id") != project_id) | ~F.col("source").isin("zoom", "chatgpt", "gold"))
    return rest.unionByName(new), {k: counts.get(k, 0) for k in ("zoom", "chatgpt", "gold")}


def recognized(rows: DataFrame) -> DataFrame:
    """Segments of speech recognition output (project_id, idx, t0, t1 in hundredths, text, probability)."""
    p = F.col("probability").cast("double")
    fine = p.isNotNull() & ~F.isnan(p) & (F.abs(p) < float("inf"))
    return rows.where(F.trim(T.text("text")) != "").select(
        "project_id", F.lit("model").alias("source"), F.col("idx").cast("int").alias("seg_idx"), (F.col("t0") / 100.0).alias("start"), (F.col("t1") / 100.0).alias("end"),
        F.lit(UNKNOWN).alias("speaker"), F.trim("text").alias("text"), F.when(fine, T.clamp(p)).alias("confidence"),
    )
