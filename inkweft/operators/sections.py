"""Lines, headings, sections and overlapping fragments of markdown documents."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from inkweft.config import Settings
from inkweft.functions import text as T
from inkweft.runtime import arrow_rows

# Sentence ends and headings.
_SENTENCE = re.compile(r"(?<=[.!?:])\s+|(?=[•▪✅❌⛔⚠])")
_HEADING = re.compile(r"^(#{1,6})\s+(.*)$")
_LINKED = re.compile(r"\[([^\]]*)\]\([^)]*\)")
_MARKS = re.compile(r"\*{1,3}|`")


def document_lines(docs: DataFrame, name: str = "name", text: str = "body") -> DataFrame:
    """``name, pos, line, fenced``: every line with whether it is in a fence or marks one."""
    rows = docs.select(F.col(name).alias("name"), F.posexplode(T.lines(F.col(text))).alias("pos", "line"))
    mark = F.col("line").rlike(T.FENCE).cast("int")
    before = F.sum(mark).over(Window.partitionBy("name").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return rows.withColumn("fenced", (before % 2 == 1) | (mark == 1))


def document_titles(docs: DataFrame, name: str = "name", text: str = "body") -> DataFrame:
    """``name, title``: the first heading of the first level outside fences, else the name."""
    head = F.regexp_extract("line", r"^#\s+(?:\[)?(.+?)(?:\]\(|$)", 1)
    first = document_lines(docs, name, text).where(~F.col("fenced") & (head != "")).groupBy("name").agg(F.min_by(head, "pos").alias("_head"))
    return docs.select(F.col(name).alias("name")).distinct().join(first, "name", "left").select("name", F.coalesce(F.trim(T.clean(F.col("_head"))), "name").alias("title"))


def outline(docs: DataFrame, name: str = "name", text: str = "body", deepest: int = 4, longest: int = 90) -> DataFrame:
    """``name, pos, level, heading``: headings outside fences up to the generated list of links at the end."""
    rows = document_lines(docs, name, text).where(~F.col("fenced"))
    tail = F.col("line").rlike(r"^#+ (?:Links found (?:on this page|in this document)|Посилання, знайдені .*)\s*$").cast("int")
    past = F.max(tail).over(Window.partitionBy("name").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    heads = rows.withColumn("_past", past).where("_past = 0").select("name", "pos", F.length(F.regexp_extract("line", T.HEADING, 1)).alias("level"), F.trim(T.clean(F.regexp_extract("line", T.HEADING, 2))).alias("heading"))
    return heads.where((F.col("level") >= 1) & (F.col("level") <= deepest) & (F.col("heading") != "") & (F.length("heading") < longest))


def sentence_ranges(text: str) -> list[tuple[int, int]]:
    """Begin and end of each sentence."""
    out, at = [], 0
    for m in _SENTENCE.finditer(text):
        if m.start() > at:
            out.append((at, m.start()))
        at = max(at, m.end())
    return [*out, (at, len(text))] if at < len(text) else out


def pack(lengths: list[int], most: int, overlap: int) -> list[tuple[int, int]]:
    """Ranges [a, b) of sentences, packed greedily.

    A range is closed before a sentence with which it, one blank behind each sentence, would pass ``most``; the next
    range goes back over the whole sentences at the end that fit into ``overlap`` characters.
    """
    out, a, held = [], 0, 0
    for i, n in enumerate(lengths):
        if i > a and held + n > most:
            out.append((a, i))
            back, size = i, 0
            while overlap > 0 and back > a and size + lengths[back - 1] <= overlap:
                back -= 1
                size += lengths[back]
            a, held = back, size + (i - back)
        held += n + 1
    return [*out, (a, len(lengths))] if a < len(lengths) else out


def fragments_of(md: str, most: int, overlap: int) -> list[tuple[int, str, str]]:
    """(line number, heading, text) of each fragment of a document."""
    parts = re.split(T.LINE_BREAK, md)
    if parts and parts[-1] == "":
        parts.pop()
    heads = [(i, _HEADING.match(x)) for i, x in enumerate(parts)]
    marks = [(i, _MARKS.sub("", _LINKED.sub(r"\1", m.group(2)))[:120]) for i, m in heads if m]
    spans = [(-1, "", 0, marks[0][0] if marks else len(parts))] + [(i, h, i + 1, marks[k + 1][0] if k + 1 < len(marks) else len(parts)) for k, (i, h) in enumerate(marks)]
    out = []
    for at, heading, lo, hi in spans:
        if lo >= hi:
            if heading:  # a heading without a body is found by itself
                out.append((at + 1, heading, heading))
            continue
        kept = [(i, parts[i]) for i in range(lo, hi) if parts[i].strip()]
        text, begins, size = " ".join(x for _, x in kept), [], 0
        for i, x in kept:
            begins.append((size, i + 1))
            size += len(x) + 1
        ranges = sentence_ranges(text)
        for a, b in pack([e - s for s, e in ranges], most, overlap):
            piece = " ".join(text[s:e] for s, e in ranges[a:b]).strip()
            if piece:
                out.append((max((n for s, n in begins if s <= ranges[a][0]), default=lo + 1), heading, piece))
    return out


def fragments(docs: DataFrame, settings: Settings, name: str = "name", text: str = "body") -> DataFrame:
    """``name, seq, line_no, heading, body``: fragments in document order.  Null and empty texts have none."""
    most, overlap = settings.chunk_chars, settings.overlap_chars

    def run(batch: pa.RecordBatch) -> pa.Table:
        rows = [(n, k, *f) for n, md in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) if md for k, f in enumerate(fragments_of(md, most, overlap))]
        cols = list(zip(*rows)) or [[], [], [], [], []]
        return pa.table({"name": pa.array(cols[0], pa.string()), "seq": pa.array(cols[1], pa.int32()), "line_no": pa.array(cols[2], pa.int32()), "heading": pa.array(cols[3], pa.string()), "body": pa.array(cols[4], pa.string())})

    return arrow_rows(docs.select(F.col(name), F.col(text)), run, "name string, seq int, line_no int, heading string, body string")


def read_section(docs: DataFrame, doc: str, line: int = 1, count: int = 40, name: str = "name", text: str = "body") -> DataFrame:
    """``line_no, line`` of at most 200 lines from ``line`` on."""
    begin, n = max(line, 1), min(max(count, 0), 200)
    rows = docs.where(F.col(name) == doc).select(F.posexplode(F.slice(T.lines(F.col(text)), begin, n)).alias("pos", "line"))
    return rows.select((F.col("pos") + begin).alias("line_no"), "line")
